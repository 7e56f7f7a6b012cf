"""A linear-chain conditional random field with two states, on long token streams.

Forward and backward passes are blocked scans: the stream is cut into equal
chunks, the 2x2 transfer matrices of each chunk are multiplied in lock step
over all chunks, the chunk products are chained, and a second lock-step pass
gives every position its messages. A sequence start is a matrix with equal
rows, which forgets what came before; so any mix of short and very long
sequences costs the same per token.
"""

from __future__ import annotations

import numpy as np

#: Positions whose messages are held at once in training.
CHUNK = 250_000


def messages(e: np.ndarray, start: np.ndarray, trans: np.ndarray, first: float) -> tuple[np.ndarray, ...]:
    """Normalised forward (T, 2), backward (T, 2) and the transfer matrices (T, 4).

    e: score of state 1 over state 0 by position; start: True at the first position of a sequence;
    trans: 2x2 log potentials; first: score of state 1 at a start.
    """
    n = len(e)
    L = max(1, int(np.sqrt(n)))
    C = -(-n // L)
    ex = np.exp(np.clip(e, -30, 30))
    a = np.exp(trans)
    m = np.empty((4, C * L))
    m[:, n:] = np.array([1, 0, 0, 1])[:, None]
    m[0, :n] = np.where(start, 1, a[0, 0])
    m[1, :n] = ex * np.where(start, np.exp(first), a[0, 1])
    m[2, :n] = np.where(start, 1, a[1, 0])
    m[3, :n] = ex * np.where(start, np.exp(first), a[1, 1])
    m /= m.sum(0)
    by_step = np.ascontiguousarray(m.reshape(4, C, L).transpose(2, 0, 1))
    p = np.zeros((4, C))
    p[0] = p[3] = 1
    for x in by_step:
        q = np.stack([p[0] * x[0] + p[1] * x[2], p[0] * x[1] + p[1] * x[3], p[2] * x[0] + p[3] * x[2], p[2] * x[1] + p[3] * x[3]])
        p = q / q.sum(0)
    fa, ba = np.empty((C, 2)), np.empty((C, 2))
    v = np.array([0.5, 0.5])
    for c in range(C):
        fa[c] = v
        v = np.array([v[0] * p[0, c] + v[1] * p[2, c], v[0] * p[1, c] + v[1] * p[3, c]])
        v /= v.sum()
    v = np.array([0.5, 0.5])
    for c in range(C - 1, -1, -1):
        ba[c] = v
        v = np.array([p[0, c] * v[0] + p[1, c] * v[1], p[2, c] * v[0] + p[3, c] * v[1]])
        v /= v.sum()
    f, b = np.empty((L, 2, C)), np.empty((L, 2, C))
    v = fa.T
    for t in range(L):
        x = by_step[t]
        v = np.stack([v[0] * x[0] + v[1] * x[2], v[0] * x[1] + v[1] * x[3]])
        v = v / v.sum(0)
        f[t] = v
    v = ba.T
    for t in range(L - 1, -1, -1):
        b[t] = v
        x = by_step[t]
        v = np.stack([x[0] * v[0] + x[1] * v[1], x[2] * v[0] + x[3] * v[1]])
        v = v / v.sum(0)
    unblock = lambda y: y.transpose(2, 0, 1).reshape(C * L, 2)[:n]
    return unblock(f), unblock(b), m[:, :n].T


def chunks(start: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of whole sequences, each of about ``size`` positions or one sequence."""
    begins = np.flatnonzero(start)
    at = np.searchsorted(begins, np.arange(size, len(start), size), side="right") - 1
    cuts = np.unique(np.concatenate([[0], begins[at.clip(0)] if len(begins) else [], [len(start)]])).astype(np.int64)
    return list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))


class BinaryCRF:
    """Emission score = sum of ``w`` at the feature numbers of a position; feature numbers are (T, F)."""

    def __init__(self, size: int):
        self.w = np.zeros(size, np.float64)
        self.trans = np.zeros((2, 2))
        self.first = 0.0

    def emission(self, feats: np.ndarray) -> np.ndarray:
        e = np.zeros(len(feats))
        for j in range(feats.shape[1]):
            e += self.w[feats[:, j]]
        return e

    def marginals(self, feats: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Log odds of state 1 at each position."""
        if not len(feats):
            return np.zeros(0)
        out, tiny = np.empty(len(feats)), 1e-300
        for a, z in chunks(start, CHUNK):
            f, b, _ = messages(self.emission(feats[a:z]), start[a:z], self.trans, self.first)
            out[a:z] = np.log(f[:, 1] * b[:, 1] + tiny) - np.log(f[:, 0] * b[:, 0] + tiny)
        return out

    def fit(self, feats: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, rate: float = 0.3, l2: float = 1e-4, chunk: int = CHUNK) -> "BinaryCRF":
        """Full-batch Adam on the (weighted) conditional log-likelihood; deterministic.

        Gradients are summed over chunks of whole sequences, so that messages
        are held for ``chunk`` positions (or one sequence) at a time.
        """
        n = max(1.0, weight.sum())
        size = len(self.w)
        mask = np.zeros(size, bool)
        mask[feats.reshape(-1)] = True
        used, at = np.flatnonzero(mask), (np.cumsum(mask, dtype=np.int32) - 1)[feats]
        theta = np.zeros(len(used) + 5)
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        own = BinaryCRF(0)
        for r in range(1, rounds + 1):
            own.w, own.trans, own.first = theta[:-5], theta[-5:-1].reshape(2, 2), float(theta[-1])
            g = np.zeros_like(theta)
            for a, b in chunks(start, chunk):
                own.add_gradient(g, at[a:b], start[a:b], y[a:b], weight[a:b])
            g = g / n - l2 * theta
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.99 * m2 + 0.01 * g * g
            theta = theta + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-9)
        self.w = np.zeros(size)
        self.w[used] = theta[:-5]
        self.trans, self.first = theta[-5:-1].reshape(2, 2).copy(), float(theta[-1])
        return self

    def add_gradient(self, g: np.ndarray, feats: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        f, b, m = messages(self.emission(feats), start, self.trans, self.first)
        p = f * b
        d = weight * (y - p[:, 1] / p.sum(1))
        for j in range(feats.shape[1]):
            g[:-5] += np.bincount(feats[:, j], d, len(g) - 5)
        cur = np.flatnonzero(~start[1:]) + 1
        prev = cur - 1
        emp = np.bincount(2 * y[prev] + y[cur], weight[cur], 4)
        x = np.stack([f[prev, i] * m[cur, 2 * i + j] * b[cur, j] for i in (0, 1) for j in (0, 1)])
        x *= weight[cur] / x.sum(0)
        g[-5:-1] += emp - x.sum(1)
        g[-1] += d[start].sum()


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Coefficients (last: constant) of a logistic regression by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - l2 * len(y) * w
        h = (z * (p * (1 - p))[:, None]).T @ z + (l2 * len(y) + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The cut on x with the fewest errors (y = 1 above), in the middle of the widest such gap."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(ys)]) + np.concatenate([np.cumsum((1 - ys)[::-1])[::-1], [0]])
    ok = np.ones(len(x) + 1, bool)
    ok[1:-1] = xs[1:] > xs[:-1]
    wrong = np.where(ok, wrong, len(x) + 1)
    at = np.flatnonzero(wrong == wrong.min())
    edge = np.concatenate([[xs[0] - 1], xs, [xs[-1] + 1]])
    gaps = edge[at + 1] - edge[at]
    i = at[int(np.argmax(gaps))]
    return float((edge[i] + edge[i + 1]) / 2)
