"""The vectorised kernels against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from docframe.llm import crf, decontam, shingles, simhash, token_count, url_filter
from docframe.llm.textkit import ALNUM, LOWER, NOT_BLANK, Texts, chain, hash_spans, slices


def test_spans_keep_texts_apart():
    xs = ["ab c", "", "d", "  ", "é f" + "x" * 100]
    t = Texts.of(xs)
    s, e, d = t.spans(NOT_BLANK)
    got = [(int(k), t.buf[a:b].tobytes().decode()) for a, b, k in zip(s, e, d, strict=True)]
    assert got == [(i, w) for i, x in enumerate(xs) for w in x.split()]


def test_hashes_depend_on_the_bytes_only():
    t = Texts.of(["Alpha beta", "beta alpha alphabet " + "z" * 200, "z" * 200])
    s, e, _ = t.spans(ALNUM)
    h, p = hash_spans(LOWER[t.buf], s, e, (5,))
    assert h[0] == h[3] and h[1] == h[2] and h[5] == h[6] and len(set(h.tolist())) == 4
    assert p[0] == p[3] == p[4] == h[0]


def test_slices_hold_whole_texts():
    col = pa.array(["a" * 10, None, "b" * 30, "c"])
    parts = [(p.start, p.stop, [t.text(i) for i in range(t.n)]) for p, t in slices(col, 12)]
    assert parts == [(0, 2, [b"a" * 10, b""]), (2, 3, [b"b" * 30]), (3, 4, [b"c"])]


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    e = rng.normal(size=9)
    start = np.array([1, 0, 0, 0, 1, 0, 1, 0, 0], bool)
    trans, first = rng.normal(size=(2, 2)), 0.4
    total, one = 0.0, np.zeros(9)
    for code in range(1 << 9):
        y = [(code >> i) & 1 for i in range(9)]
        w = np.exp(sum(e[i] * y[i] + (first * y[i] if start[i] else trans[y[i - 1], y[i]]) for i in range(9)))
        total += w
        one += w * np.array(y)
    f, b, _ = crf.messages(e, start, trans, first)
    p = f * b
    assert np.allclose(p[:, 1] / p.sum(1), one / total)


def test_crf_learns_from_context():
    rng = np.random.default_rng(1)
    y = np.repeat(rng.integers(0, 2, 200), 5)
    feats = np.where(rng.random(1000) < 0.75, y, 1 - y)[:, None]
    start = np.arange(1000) % 50 == 0
    m = crf.BinaryCRF(2).fit(feats, start, y, np.ones(1000), rounds=80)
    assert ((m.marginals(feats, start) > 0) == y).mean() > (feats[:, 0] == y).mean() + 0.02


def test_token_counts_match_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, m = Tokenizer.from_file(path), token_count.machine(path)
    rnd = random.Random(3)
    parts = list("aabcdersttvlm'''  \n\t  019.,!-é漢ß　  😀") + ["<|endoftext|>", "'re", "'ve", "'ll", " the", "ing", "\r\n", "aaaa", "    "]
    xs = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["", "'", "'r", "<|endoftext|>", "a" * 5000, " " * 5000, "'" * 4001, "　　a", "x'lll"]
    want = [len(e.ids) for e in lib.encode_batch(xs, add_special_tokens=False)]
    assert token_count.count_tokens(Texts.of(xs), m).tolist() == want
    long = "".join(xs)
    assert token_count.count_tokens(Texts.of([long]), m)[0] == len(lib.encode(long, add_special_tokens=False).ids)


def _fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hs) * 2 > len(hs))


def test_simhash_bits():
    xs = ["", "One", "a b", "Straße Ä b c d e", "x y z " * 30, None, "a\x0bb\x85c\u00a0d e f g"]
    assert simhash.fingerprints(xs).view(np.uint64).tolist() == [_fp(x or "") for x in xs]


def test_tree_links_span_all_near_pairs():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    x = np.concatenate([seeds, *[seeds[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for _ in range(2)]])
    x = np.unique(x)
    forest = simhash.Forest(len(x))
    shingles.tree_links(x, np.arange(len(x)), 3, forest)
    brute = simhash.Forest(len(x))
    shingles._compare(x, np.arange(len(x)), None, 3, brute)
    assert (forest.root == brute.root).all()


def test_forest_of_near_pairs_is_a_least_one(monkeypatch):
    monkeypatch.setattr(shingles.Pairs, "MOST", 500)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, (4, 4), dtype=np.uint64)[np.repeat(np.arange(4), 40)]
    for _ in range(6):
        x[np.arange(160), rng.integers(0, 4, 160)] ^= np.uint64(1) << rng.integers(0, 64, 160, dtype=np.uint64)
    key = np.repeat([1, 2, 3], [100, 30, 30])
    spanning = shingles.Pairs(160)
    shingles._shards(key, x, 10, spanning)
    a, b, _ = spanning.forest()
    pairs = sorted((int(shingles.apart_of(x, i, j)), i, j) for i in range(160) for j in range(i) if key[i] == key[j] and shingles.apart_of(x, i, j) <= 10)
    root, weights = list(range(160)), []
    for d, i, j in pairs:
        if root[i] != root[j]:
            weights.append(d)
            root = [root[j] if r == root[i] else r for r in root]
    assert sorted(shingles.apart_of(x, a, b).tolist()) == weights and (key[a] == key[b]).all()


def test_similarities_by_plain_sets():
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["a", "B", "c"], int(rng.integers(0, 30)))) for _ in range(60)]
    made = [" ".join(t.split()[: int(rng.integers(0, 30))]).upper() for t in texts]

    def plain(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    want = [len(plain(t) & plain(u)) / len(plain(t) | plain(u)) if plain(t) | plain(u) else 1.0 for t, u in zip(texts, made, strict=True)]
    assert np.allclose(shingles.similarities(Texts.of(texts), Texts.of(made)), want)


def test_tiles_catch_reordered_passages():
    rng = np.random.default_rng(6)
    p = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    doc = np.concatenate([rng.integers(0, 1 << 60, 9).astype(np.uint64), p[20:], rng.integers(0, 1 << 60, 3).astype(np.uint64), p[:20]])
    assert sorted(decontam.tiles(p, doc)) == [(0, 32, 20), (20, 9, 20)]
    assert decontam.tiles(p, rng.integers(0, 1 << 60, 50).astype(np.uint64)) == []


def _tiles_plain(p, t, least):
    mp, mt, out = [False] * len(p), [False] * len(t), 0
    while True:
        best = 0
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                best = max(best, k)
        if best < least:
            return out
        for j in range(len(t)):
            for i in range(len(p)):
                if i + best <= len(p) and j + best <= len(t) and not any(mp[i : i + best]) and not any(mt[j : j + best]) and list(p[i : i + best]) == list(t[j : j + best]):
                    mp[i : i + best] = mt[j : j + best] = [True] * best
                    out += best
        # all of this length are marked


def test_tiles_cover_as_much_as_the_plain_algorithm():
    rng = np.random.default_rng(7)
    for _ in range(60):
        p, t = (rng.integers(1, 4, rng.integers(3, 25)).astype(np.uint64) for _ in range(2))
        assert sum(n for *_, n in decontam.tiles(p, t, 3)) == _tiles_plain(p, t, 3)


def test_seeds_do_not_cross_texts_or_gaps():
    block = decontam.Block([(1, "a b c d e f g h i j"), (2, "short one"), (3, None)], 5)
    met = block.meet(Texts.of(["x a b c d e f g h i j y", "a b c", "d e f g h i j", "", "F g H, i. J a B c-d e"]))
    assert met[0] == [(1, 1.0)] and met[1] == [] and met[2] == [(1, 0.7)] and met[3] == [] and met[4] == [(1, 1.0)]


def test_markov_probabilities_sum_to_one():
    m = url_filter.MarkovModel().fit(["ab", "abb", "b"])
    # over all texts of at most two bytes, and all starts of longer ones, nothing is lost or gained
    one = [bytes([c]).decode("latin-1") for c in range(128) if c != url_filter.TEXT_END and not 65 <= c < 91]
    p = np.exp(m.log_likelihood(Texts.of(["", *one])))
    assert 0.2 < p.sum() < 1 and p[1 + one.index("b")] > p[1 + one.index("a")] > p[1 + one.index("c")]
    assert m.log_likelihood(Texts.of(["abb"]))[0] > m.log_likelihood(Texts.of(["bba"]))[0]


def test_chain_rolls():
    h = np.arange(10, dtype=np.uint64) ** 3
    assert len(chain(h, 5)) == 6 and len(chain(h[:4], 5)) == 0
    assert chain(h[2:], 5)[0] == chain(h, 5)[2]


def test_crf_learns_the_same_in_chunks_and_from_a_very_long_text():
    rng = np.random.default_rng(12)
    n = 3000
    start = np.zeros(n, bool)
    start[[0, 40, 41, 300, 2900]] = True
    feats = rng.integers(0, 30, (n, 3))
    y = ((feats[:, 0] > 20) | (np.roll(feats[:, 0], 1) > 25)).astype(np.int64)
    whole, parts = (crf.BinaryCRF(40).fit(feats, start, y, np.ones(n), rounds=15, chunk=c) for c in (10**9, 50))
    assert np.allclose(whole.w, parts.w, atol=1e-6) and np.allclose(whole.trans, parts.trans, atol=1e-6)
    assert crf.chunks(start, 50)[-1] == (2900, 3000) and [a for a, _ in crf.chunks(start, 50)][0] == 0
    from docframe.llm.toxicity import ToxicModel
    from docframe.llm.textkit import Texts

    texts = [" ".join(f"t{i}x{j}" + (" vile" if i % 2 and j % 5 == 0 else " calm") for j in range(10)) for i in range(120)]
    texts[1] = "lorem vile ipsum " * 7000  # 119,000 characters
    m = ToxicModel().fit(texts, np.arange(120) % 2)
    assert m.score(Texts.of(["quiet vile words", "quiet calm words", "z " * 60_000 + "vile"]))[0].round().tolist() == [1, 0, 1]
