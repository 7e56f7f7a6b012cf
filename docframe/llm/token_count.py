"""Token counts of byte-level BPE by compiled finite-state transducers.

Two machines count tokens without producing them.

* The *splitter* is a deterministic transducer over character classes. Its
  transitions are annotated with the piece starts they emit (at this character
  or, where the decision comes late, at the one before). A batch is cut into
  equal chunks; each chunk yields a map from entry state to exit state, the
  maps are composed by a parallel prefix scan, and a second lock-step pass
  writes the starts. The length of single texts does not matter.
* The *piece machine* is a deterministic transducer over bytes whose
  transitions are annotated with the number of tokens they emit. It follows
  from the merge rules: a token sequence is the encoding of its bytes if and
  only if every two neighbours are, so the partial hypotheses of a byte string
  form a finite set. Subsets are determinised when first met and kept (bounded;
  beyond the bound they are built anew).

Defined results: null and empty texts have 0 bytes and 0 tokens. The special
tokens of the file count as one token wherever their strings occur in a text.
Very long texts are counted whole, in chunks; one unbroken piece of them takes
states in proportion to its length. Repeated rows are counted each, rows with a
null id too; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.textkit import Texts, hash_spans, slices
from docframe.ship import ship

# Character classes.
OTHER, LETTER, NUMBER, SPACE, BLANK, APOS, STMD, R, V, L, E, MORE, END = range(13)
# States of the splitter: at a start; in letters, numbers, others; in white space whose last character is
# a space or not, of length one or more; after an apostrophe that began a piece, and r, v or l after it.
S0, LET, NUM, OTH, SP1, WS1, SP2, WS2, Q, QR, QV, QL = range(12)
HERE, BACK = 1, 2
#: White space as regular expressions know it.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted starts) by state and class."""
    n_states, n_classes = 12, 13
    nxt, out = np.zeros((n_states, n_classes), np.uint8), np.zeros((n_states, n_classes), np.uint8)
    letters = {LETTER, STMD, R, V, L, E}

    def fresh(c: int) -> int:
        return LET if c in letters else {NUMBER: NUM, OTHER: OTH, APOS: Q, SPACE: SP1, BLANK: WS1, END: S0}[c]

    for s in range(n_states):
        for c in range(n_classes):
            blank = c in (SPACE, BLANK)
            if c == MORE:
                nxt[s, c] = s
                continue
            to, emit = fresh(c), HERE
            if s == LET and c in letters or s == NUM and c == NUMBER:
                emit = 0
            elif s == OTH and c in (OTHER, APOS):
                to, emit = OTH, 0
            elif s in (SP1, SP2, WS1, WS2):
                if blank:
                    to, emit = (SP2 if c == SPACE else WS2), 0
                elif c != END:
                    late = BACK if s in (SP2, WS2) else 0
                    if s in (SP1, SP2):
                        to, emit = (OTH if c == APOS else to), late
                    else:
                        emit = HERE | late
            elif s == Q:
                if c in (OTHER, APOS):
                    to, emit = OTH, 0
                elif c == STMD:
                    to, emit = S0, 0
                elif c in (R, V, L):
                    to, emit = {R: QR, V: QV, L: QL}[c], 0
            elif s in (QR, QV, QL):
                if c == (L if s == QL else E):
                    to, emit = S0, 0
                elif c in letters:
                    to, emit = LET, BACK
                else:
                    emit = HERE | BACK
            nxt[s, c], out[s, c] = to, emit
    return nxt, out


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            table[cp] = LETTER
        elif k == "N":
            table[cp] = NUMBER
    table[WHITE] = BLANK
    table[32], table[39] = SPACE, APOS
    for ch, c in (("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(ch)] = c
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class by byte: that of the character at its first byte, MORE at the others, END at 0xFF."""
    table = _classes()
    low = np.full(256, MORE, np.uint8)
    low[:128] = table[:128]
    low[255] = END
    cls = low[buf]
    lead = np.flatnonzero((buf >= 0xC0) & (buf != 0xFF))
    if lead.size:
        b = buf.astype(np.uint32)
        at = lambda k: b[np.minimum(lead + k, len(b) - 1)] & 0x3F
        x = b[lead]
        cp = np.where(x < 0xE0, (x & 0x1F) << 6 | at(1), np.where(x < 0xF0, (x & 0x0F) << 12 | at(1) << 6 | at(2), (x & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        cls[lead] = table[np.minimum(cp, 0x10FFFF)]
    return cls


_NEXT, _OUT = compile_splitter()


def emitted(cls: np.ndarray) -> np.ndarray:
    """What the splitter emits at each position, from state S0: chunk maps, prefix scan, lock-step replay."""
    n = len(cls)
    length = max(1, int(np.sqrt(n)))
    chunks = -(-n // length)
    padded = np.full(chunks * length, MORE, np.uint8)
    padded[:n] = cls
    steps = np.ascontiguousarray(padded.reshape(chunks, length).T).astype(np.int16)
    k = _NEXT.shape[1]
    nxt, out = _NEXT.reshape(-1).astype(np.int16), _OUT.reshape(-1)
    maps = np.repeat(np.arange(len(_NEXT), dtype=np.int16)[:, None], chunks, 1)
    for x in steps:
        maps = nxt[maps * k + x]
    d = 1
    while d < chunks:  # maps[:, i] becomes the map of chunks 0..i
        later = np.take_along_axis(maps[:, d:], maps[:, :-d].astype(np.int64), 0)
        maps = np.concatenate([maps[:, :d], later], 1)
        d *= 2
    state = np.concatenate([[S0], maps[S0, :-1]]).astype(np.int16)
    got = np.empty((length, chunks), np.uint8)
    for t, x in enumerate(steps):
        at = state * k + x
        got[t] = out[at]
        state = nxt[at]
    return got.T.reshape(-1)[:n]


class PieceMachine:
    """Counts the tokens of a piece; merge rules and vocabulary from a tokenizer file."""

    MOST_STATES = 200_000

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        parts, self.rank, made = [], {}, {}
        ids: dict[bytes, int] = {}
        for b in range(256):
            ids[bytes([b])] = b
            parts.append((-1, -1))
        birth = [-1] * 256
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = bytes(byte_of[c] for c in a), bytes(byte_of[c] for c in b)
            x, y = ids[a], ids[b]
            self.rank[x, y] = r
            if a + b not in ids:
                ids[a + b] = len(parts)
                parts.append((x, y))
                birth.append(r)
            made[r] = ids[a + b]
        # outer edges of each token's merge tree: (part, rank of the merge that takes it up)
        top = 1 << 60
        self.right, self.left = [], []
        for t, (x, y) in enumerate(parts):
            self.right.append([(t, top)] + ([(p, min(u, birth[t])) for p, u in self.right[y]] if y >= 0 else []))
            self.left.append([(t, top)] + ([(p, min(u, birth[t])) for p, u in self.left[x]] if x >= 0 else []))
        sound = [True] * len(parts)
        for t, (x, y) in enumerate(parts):
            if x >= 0:
                sound[t] = sound[x] and sound[y] and self._first_cross(x, y, birth[t]) is None
        # trie of the tokens that are encodings of their own bytes
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for raw, t in ids.items():
            if sound[t]:
                node = 0
                for b in raw:
                    self.inner[node] = True
                    key = node << 8 | b
                    if key not in self.child:
                        self.child[key] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(False)
                    node = self.child[key]
                self.token[node] = t
        self.fits: dict[tuple[int, int], bool] = {}
        self.counts: dict[int, int] = {}
        self._reset()

    def _first_cross(self, l: int, r: int, before: int) -> int | None:  # noqa: E741
        """A merge over the border of l and r that comes before rank ``before`` and before either part is taken up."""
        rank = self.rank
        for x, up in self.right[l]:
            for y, up2 in self.left[r]:
                m = rank.get((x, y))
                # at equal ranks the leftmost pair merges first
                if m is not None and m < before and m < up and m <= up2:
                    return m
        return None

    def neighbours(self, l: int, r: int) -> bool:  # noqa: E741
        got = self.fits.get((l, r))
        if got is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            got = self.fits[l, r] = self._first_cross(l, r, 1 << 60) is None
        return got

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.state_id, self.states, self.final, self.arcs = {start: 0}, [start], [0], {}

    def _arc(self, state: int, b: int) -> int:
        """Determinise one transition: next state << 16 | emitted tokens."""
        new: dict[tuple[int, int], int] = {}
        for node, last, c in self.states[state]:
            to = self.child.get(node << 8 | b)
            if to is None:
                continue
            if self.inner[to]:
                new[to, last] = c
            t = self.token[to]
            if t >= 0 and (last < 0 or self.neighbours(last, t)):
                new[0, t] = c + 1
        least = min(new.values())
        key = tuple(sorted((n, t, c - least) for (n, t), c in new.items()))
        to = self.state_id.get(key)
        if to is None:
            to = self.state_id[key] = len(self.states)
            self.states.append(key)
            self.final.append(next(c for n, _, c in key if n == 0))
        got = self.arcs[state << 8 | b] = to << 16 | least
        return got

    def count(self, piece: bytes) -> int:
        if len(self.states) > self.MOST_STATES:
            self._reset()
        arcs, state, n = self.arcs, 0, 0
        for b in piece:
            v = arcs.get(state << 8 | b)
            if v is None:
                v = self._arc(state, b)
            state = v >> 16
            n += v & 0xFFFF
        return n + self.final[state]


@lru_cache(2)
def machine(path: str) -> PieceMachine:
    return PieceMachine(path)


def count_tokens(t: Texts, m: PieceMachine) -> np.ndarray:
    """Tokens of each text."""
    extra = np.zeros(t.n, np.int64)
    seg_doc = np.arange(t.n)
    buf, offs = t.buf, t.offs
    if m.special:
        whole = buf.tobytes()
        marks = sorted((i, len(s)) for s in (x.encode() for x in m.special) for i in _find(whole, s))
        if marks:
            pieces, seg = [], []
            k = 0
            for d in range(t.n):
                a, b = int(offs[d]), int(offs[d + 1])
                while k < len(marks) and marks[k][0] < b:
                    i, n = marks[k]
                    k += 1
                    if i < a or i + n > b:
                        continue
                    pieces.append(buf[a:i])
                    seg.append(d)
                    extra[d] += 1
                    a = i + n
                pieces.append(buf[a:b])
                seg.append(d)
            buf = np.concatenate(pieces)
            offs = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            seg_doc = np.array(seg)
    stream = np.insert(buf, offs[1:], 255)
    emit = emitted(byte_classes(stream))
    mark = (emit & HERE) > 0
    back = np.flatnonzero(emit & BACK) - 1
    for _ in range(3):
        more = (stream[back] & 0xC0) == 0x80
        if not more.any():
            break
        back = back - more
    mark[back] = True
    mark[stream == 255] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], len(stream))
    real = stream[starts] != 255
    starts, ends = starts[real], ends[real]
    if not len(starts):
        return extra
    (h,) = hash_spans(stream, starts, ends)
    uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
    if len(m.counts) > 1_000_000:
        m.counts.clear()
    known = m.counts
    raw = stream.tobytes()
    counts = np.empty(len(uniq), np.int64)
    for i, (key, a, b) in enumerate(zip(uniq.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
        c = known.get(key)
        if c is None:
            c = known[key] = m.count(raw[a:b])
        counts[i] = c
    seg_of = np.searchsorted(offs[1:] + np.arange(1, len(offs)), starts, side="right")
    return extra + np.bincount(seg_doc[seg_of], counts[inv], t.n).astype(np.int64)


def _find(whole: bytes, s: bytes) -> Iterator[int]:
    i = whole.find(s)
    while i >= 0:
        yield i
        i = whole.find(s, i + len(s))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per input row, no shuffle. ``tokenizer``: a file that every worker can open."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        for b in batches:
            for part, t in slices(b.column(1), 2 << 20):
                n = count_tokens(t, m)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(np.diff(t.offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
