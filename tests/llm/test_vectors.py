"""Vector codes, resampling and embedding near-dedup against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from docframe.llm import codes, collisions, resample

VECTORS = "vec_id long, embedding array<float>, label int, score string, n long"


def table(spark, rows):
    # columns named like results must not matter
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], VECTORS)


def odd_vectors(dim=16, n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], i % 3) for i in range(n)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(3, rows[3][1], 0), (None, rows[4][1], 1), (None, rows[7][1], None)]
    return rows + [(300, None, 1), (301, [], 1), (302, [None] * dim, 1), (303, [1.0] * (dim - 1) + [math.nan], 1), (304, [math.inf] * dim, 1), (305, [0.0] * dim, 1), (306, [1.0] * 5, 1), (307, [0.5] * 5, 1)]


# codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    fine = [(i, v, y) for i, v, y in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fine = sorted(((i, [math.floor(4096 * c) for c in v], y) for i, v, y in fine), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    wide = -(-len(fine[0][1]) // parts)
    cut = lambda v: [(v + [0] * (wide * parts - len(v)))[p * wide : p * wide + wide] for p in range(parts)]
    x = [cut(v) for _, v, _ in fine]
    books = [[list(r[p]) for r in x[:entries]] for p in range(parts)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(r[p], books[p])[1] for r in x]
            books[p] = [[sum(r[p][c] for r, o in zip(x, of, strict=True) if o == k) // of.count(k) for c in range(wide)] if k in of else e for k, e in enumerate(books[p])]
    found = [[nearest(r[p], books[p]) for p in range(parts)] for r in x]
    total = {}
    for (_, _, y), f in zip(fine, found, strict=True):
        total[y] = total.get(y, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[y], sha) for (i, _, y), f in zip(fine, found, strict=True)), key=str)


@pytest.mark.parametrize("dim", [16, 13, 5])
def test_codes_equal_plain_search(spark, dim):
    rows = odd_vectors(dim)
    assert sorted(map(tuple, codes.compress(table(spark, rows)).collect()), key=str) == plain_codes(rows)


def test_codes_of_few_rows_and_none(spark):
    rows = odd_vectors()
    assert sorted(map(tuple, codes.compress(table(spark, rows[:3])).collect()), key=str) == plain_codes(rows[:3])
    nothing = codes.compress(table(spark, []))
    assert nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and nothing.count() == 0
    assert codes.compress(table(spark, [(1, None, 1), (2, [math.nan], 1)])).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-3000, 3000, (16, 8)), rng.integers(-4000, 4000, (2000, 8))
    entries[5] = entries[2]  # a tie
    cells = codes.Cells(entries)
    exact = ((x[:, None] - entries[None]) ** 2).sum(2)
    under, over = cells.bounds(x)
    assert (under <= exact).all() and (exact <= over).all()
    best, distance, refined = cells.nearest(x)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all() and refined < 0.4 * exact.size
    wide = codes.Cells(entries.astype(object) * 2**30).nearest(x.astype(object) * 2**30)
    assert (wide[0] == best).all() and (wide[1] == distance.astype(object) * 2**60).all()


def test_codes_of_great_components(spark):
    rows = [(i, [float(np.float32(s * 3e38)), 1.0], 0) for i, s in enumerate((1, -1, 1e-30, 0.5))]
    got = codes.compress(table(spark, rows)).collect()
    assert len(got) == 4 and {r.error for r in got} == {0}


# resampling


def plain_draw(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def feats(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    def count(texts):
        out = [0] * 10_000
        for t in texts:
            for b in feats(t):
                out[b] += 1
        return out

    s, t = count(x for _, x in docs), count(bench)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10_000) / ((a + 1.0) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in docs:
        f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_plain_draw(spark):
    rng = np.random.default_rng(5)
    vocab = ["alpha", "Béta", "GAMMA", "x9", "naïve", "日本", "test-case", "the", "ΔX"]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(1, 60)))) for i in range(150)]
    docs += [(7, docs[7][1]), (500, None), (501, ""), (502, " - \x7f"), (503, "long " * 50_000), (504, "a" * 100_000)] + [(None, "no id " * 15)] * 3
    bench = ["alpha Béta x9 " * 5, None, "", "the naïve 日本"]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, weight int")
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = resample.resample(d, b).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_draw(docs, bench)
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1))


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(empty, bench).count() == 0
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in resample.resample(one, bench).select("doc_id", "n_features", "rank").collect()] == [(1, 59, None)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_emits_every_run(n):
    words = [b"ab", b"c", b"\xc3\xa9", b"7", b"ab"]
    want = sorted(zlib.crc32(b" ".join(words[a : a + k])) for k in range(1, n + 1) for a in range(len(words) - k + 1))
    assert (sorted(resample.emitted(b"AB, c " + "é".encode() + b".7 ab", n)[0]), resample.emitted(b"", n)[1]) == (want, 0)


# near copies


def plain_links(rows, cosine=0.93):
    unit = []
    for _, v, y in rows:
        ok = y is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, n[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def crowd(n, dim, spread, seed, label=1, first=0):
    """Rows around one centre, at various distances from it."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim) / math.sqrt(dim)
    return [(first + i, [float(np.float32(x)) for x in centre + rng.normal(size=dim) * rng.uniform(0, spread) / math.sqrt(dim)], label) for i in range(n)]


def test_links_of_odd_rows(spark):
    rows = odd_vectors()
    assert sorted(map(tuple, collisions.near_copies(table(spark, rows)).collect()), key=str) == plain_links(rows)
    nothing = collisions.near_copies(table(spark, []))
    assert nothing.columns == ["vec_id", "n_links", "component_id", "kept"] and nothing.count() == 0


@pytest.mark.parametrize(("bits_tables", "crowded", "group"), [(None, 1 << 20, 1 << 20), ((2, 20), 40, 30), ((0, 1), 40, 30), ((2, 20), 1 << 20, 30), ((0, 1), 40, 1 << 20)])
def test_crowds_are_counted_exactly(spark, bits_tables, crowded, group):
    """One close crowd, one about as wide as the threshold, a scattered rest, and many equal rows; in cliques, groups and shards."""
    rows = crowd(150, 32, 0.2, 1) + crowd(120, 32, 0.45, 2, first=1000) + crowd(60, 32, 9, 3, first=2000) + crowd(50, 32, 0.2, 1, label=2, first=3000)
    rows += [(4000 + i, rows[0][1], 1) for i in range(40)]
    got = collisions.near_copies(table(spark, rows), crowd=crowded, group=group, bits_tables=bits_tables)
    assert sorted(map(tuple, got.collect()), key=str) == plain_links(rows)


def test_recall_at_the_threshold():
    """Pairs of the threshold's cosine itself are missed no more often than calibrated, unrelated ones mostly ruled out."""
    assert collisions.calibrated() == 11
    rng, dim, cosine = np.random.default_rng(9), 64, 0.9301
    a = collisions.units(rng.normal(size=(1500, dim)))
    b = rng.normal(size=a.shape)
    b = collisions.units(b - (a * b).sum(1, keepdims=True) * a)
    x = np.concatenate([a, cosine * a + math.sqrt(1 - cosine**2) * b])
    window = collisions.Window(x, collisions.COSINE)
    counts = window.counts(0, 1500)
    met = counts[np.arange(1500), np.arange(1500) + 1500] >= 11
    assert met.sum() >= 1499 and (counts >= 11).mean() < 0.1
    bits, tables = collisions.plan(20_000)
    side = (x @ collisions.directions(dim, bits * tables, collisions.SEED + 1) > 0).reshape(-1, tables, bits)
    assert (side[:1500] == side[1500:]).all(2).any(1).mean() > 0.999
