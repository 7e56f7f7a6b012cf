"""Operators on small tables with nulls, empty, long and repeated texts, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import backoff_lm, decontam, license_scan, mixing, quality, simhash, token_count, toxicity, url_filter, winnow

SF = "/root/testdata/sf0.001"
ODD = [(1, "One two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (None, "no id here at all, none"), (5, "x " * 30_000), (6, "A" * 70_000), (7, "one two three four five six eight"), (9, " \t\n ")]


@pytest.fixture(scope="module")
def odd(spark):
    # a column named like a result must not matter
    return spark.createDataFrame([(i, t, "en", 0.5, 1) for i, t in ODD], "doc_id long, text string, lang string, score double, shard int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity(spark, odd, empty, real):
    docs, labels = real
    m = toxicity.train(docs, labels)
    assert toxicity.score_documents(odd, m).count() == len(ODD)
    assert toxicity.score_documents(empty, m).count() == 0
    none = toxicity.train(empty, labels)
    assert {r.score for r in toxicity.score_documents(odd, none).collect()} == {0.0}
    made = [(i, f"tail{i} vile end{i * 7} grub more{i * 3} word" if i % 2 else f"tail{i} calm end{i * 7} quiet more{i * 3} word", i % 2) for i in range(200)]
    d = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    m = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score_documents(d, m).collect()}
    held = [r for r in made if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in held)
    hit = next(r for r in made if r[2])
    assert any("vile" in hit[1][s.start : s.end] or "grub" in hit[1][s.start : s.end] for s in got[hit[0]].spans)
    kept = toxicity.drop_toxic(d, m)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_quality(odd, empty, real):
    docs, labels = real
    m = quality.train(docs, labels)
    assert quality.score_documents(odd, m).count() == len(ODD) and quality.score_documents(empty, m).count() == 0
    assert {r.score for r in quality.score_documents(odd, quality.train(empty, labels)).collect()} == {1.0}
    y = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score >= quality.CUT, bool(y[r.doc_id])) for r in quality.score_documents(docs, m).collect() if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.8
    assert quality.drop_low(odd, m).columns == odd.columns


def test_token_counts(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(odd, path).collect())
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    assert got == sorted((i or 0, len((t or "").encode()), n, n > 512) for (i, t), n in zip(ODD, want, strict=True))
    assert token_count.token_counts(empty, path).count() == 0


def test_license_scan(spark, odd, empty):
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0
    rows = [(1, "RELEASED  under the M.I.T. license"), (2, "Copyright (c) 2001 Someone\nReleased under the MIT Licence!"), (3, "text\nLicensed under CC BY-NC 4.0.\nmore"), (3, "other"), (None, "Licensed under CC0 1.0"), (5, None)]
    got = {(r.doc_id, r.license_id, tuple(r.line_licenses)) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, None, ()), (2, "MIT", ("MIT",)), (3, None, ("CC-BY-NC-4.0",)), (3, None, ()), (None, "CC0-1.0", ("CC0-1.0",)), (5, None, ())}


def test_license_scan_of_whole_licences_and_any_known_text(spark):
    from docframe.llm.licences import LICENCES

    mit = LICENCES[0][1]
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.replace("license", "licence").upper()), (2, mit + " and more"), (3, "x\nYou may copy and modify this work freely.\ny"), (4, "a sub licence: whilst favour favour, favour"), (5, "A SUBLICENSE while favor  favor favor")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None and got[4].digest == got[5].digest
    own = spark.createDataFrame([("OWN", "You may copy and modify this work, freely!"), ("B", "same words here"), ("A", "Same words: here.")], "license_id string, text string")
    known = license_scan.known_digests(spark, own)
    assert {r.doc_id: r.line_licenses for r in license_scan.scan(docs, known).collect()}[3] == ["OWN"]
    assert license_scan.scan(docs.limit(1).select("doc_id", F.lit("same words here").alias("text")), known).first().license_id == "A"
    assert license_scan.scan(docs, known.limit(0)).where("license_id is not null or size(line_licenses) > 0").count() == 0


def test_url_models_carry_rules_on_to_unseen_hosts(spark):
    rules = (("block", "ads.biz", "/"), ("block", "more-ads.biz", "/"), ("allow", "site.com", "/"))
    rows = [f"http://{'ab'[i % 2]}.win-slots.ads.biz/play/{i}" for i in range(150)] + [f"http://slots-win.more-ads.biz/win/slots/{i}" for i in range(150)]
    rows += [f"https://{h}.site.com/story/{i}" for h in ("news", "blog", "docs") for i in range(100)] + [f"https://unlabelled.net/win-slots/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    model = url_filter.train(pages, rules)
    more = ["http://win-slots2.net/play/77", "https://news.other.org/story/5", "https://plain.example.org/x", "http://c.ads.biz/", "https://site.com/slots/win", None, ""]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(more)), "page_id long, url string"), model, rules).collect()}
    assert [got[i].verdict for i in range(7)] == ["block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert [got[i].rule for i in range(5)] == [None, None, None, "ads.biz/", "site.com/"]
    real = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    judged = url_filter.judge(real, url_filter.train(real))
    rows = [(r.page_id, r.rule, r.verdict) for r in judged.collect()]
    assert len(rows) == real.count() and all(v == ("allow" if rule in ("example.net/en/", "org/fr/") else "block") for _, rule, v in rows if rule)
    # brute force of the score
    m = url_filter.UrlModel().fit(["abc", "abd", "xbc"] * 3, ["zzz", "zzy"] * 3)
    def ll(mm, u):
        total, u = 0.0, u + "\n"
        for i, ch in enumerate(u):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                ctx = (" " * k + u[:i])[-k:] if k else ""
                n = sum(g == ctx + ch for g in mm[k])
                c = [g for g in mm[k] if g[:-1] == ctx]
                if c:
                    p = (n + len(set(c)) * p) / (len(c) + len(set(c)))
            total += math.log(p)
        return total
    def table(urls):
        return [[(" " * k + u + "\n")[i : i + k + 1] for u in urls for i in range(len(u) + 1)] for k in range(url_filter.ORDER + 1)]
    hold = lambda x: [u for i, u in enumerate(x) if i % 5 != 4]
    good, bad = table(hold(["abc", "abd", "xbc"] * 3)), table(hold(["zzz", "zzy"] * 3))
    for u in ("abc", "zzy", "q", "abcabc"):
        assert abs(m.score(url_filter.Texts.of([u]))[0] - (ll(good, u) - ll(bad, u)) / (len(u) + 1)) < 1e-9


def test_url_models_learn_from_all_urls(spark):
    rng = np.random.default_rng(8)
    urls = [f"https://a{i}.site.com/{'xyz'[i % 3]}/{rng.integers(10**5)}" for i in range(13_000)] + [f"http://b{i}.ads.biz/q/{rng.integers(10**5)}" for i in range(300)]
    rules = (("block", "ads.biz", "/"), ("allow", "site.com", "/"))
    pages = spark.createDataFrame(list(enumerate(urls + urls[:50])), "page_id long, url string")
    model = url_filter.train(pages, rules)
    seen = pages.select(url_filter.look(F.col("url"), rules).alias("u"), F.col("url").contains("site.com").alias("yes")).distinct().where("pmod(xxhash64(u, 4), 5) <> 4").collect()
    for m, yes in ((model.accepted, True), (model.rejected, False)):
        want = url_filter.MarkovModel().fit([r.u for r in seen if r.yes == yes])
        assert all((a == b).all() for x, y in zip(m.grams + m.contexts, want.grams + want.contexts, strict=True) for a, b in zip(x, y, strict=True))
    # the cut by numbers of scores is that by scores
    x, y = np.sort(rng.integers(-40, 40, 200)) / 8.0, rng.integers(0, 2, 200)
    at = np.unique(x)
    count = lambda k: np.array([((x == v) & (y == k)).sum() for v in at])
    want = min(0.0, url_filter.best_cut(x, y), float(np.median(x[y == 0])) * url_filter.EVIDENCE, float(x[y == 1][int(url_filter.LOSS * y.sum())]))
    assert url_filter.cut_of(at, count(1), count(0)) == want


def test_a_rule_left_out_is_carried_by_the_others(spark):
    """Pages of a block rule that is left out are mostly blocked for their looks, plain hosts that no rule knows are allowed."""
    rng = np.random.default_rng(4)
    pick = lambda *x: str(rng.choice(x))
    bad = lambda h: f"http://{pick('win', 'free', 'best')}-{pick('casino', 'slots', 'bets')}{rng.integers(99)}.{h}/{pick('bonus', 'spin', 'jackpot')}?ref={rng.integers(10**6)}"
    good = lambda h: f"https://{pick('news', 'docs', 'city', 'library')}.{h}/{pick('story', 'guide', 'archive')}/{rng.integers(2000, 2030)}/{rng.integers(10**4)}"
    rules = {"one.biz": ("block", "one.biz", "/"), "two.info": ("block", "two.info", "/"), "three.top": ("block", "three.top", "/")}
    allow = (("allow", "good.net", "/"), ("allow", "fine.org", "/"))
    urls = [bad(h) for h in rules for _ in range(200)] + [good(h) for h in ("good.net", "fine.org", "plain.io", "other.edu") for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for out in rules:
        left = (*(r for h, r in rules.items() if h != out), *allow)
        got = [(r.host, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.train(pages, left), left).collect()]
        unseen = [v for h, rule, v in got if h.endswith(out)]
        plain = [v for h, rule, v in got if h.endswith(("plain.io", "other.edu"))]
        assert not any(rule for h, rule, _ in got if h.endswith((out, "plain.io", "other.edu")))
        assert unseen.count("block") > 0.9 * len(unseen) and plain.count("allow") > 0.9 * len(plain)


def test_what_url_models_see(spark):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"))
    cases = {"http://a.example.net/en/x?q": "a/x?q", "https://A.b.NET/en": "a.b/en", "ftp://net": "", "x://net/": "", "http://c.org/en/": "c.org", "no scheme": "no scheme", "http://example.net?x": "/?x", "http://planet/en/1": "planet/1"}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select(url_filter.look(F.col("u"), rules)).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_url_filter(spark):
    rows = [(1, "http://net/x"), (2, "http://a.NET/x?y"), (3, "http://a.net"), (4, "https://w.example.net/en/1#t"), (5, "https://example.com/de/"), (6, "https://xorg/fr/1"), (7, "https://b.org/fr/1"), (8, None), (9, "no scheme"), (10, ""), (10, ""), (11, "x://y://z/en/")]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.train(df)).collect()}
    assert [got[i].rule for i in range(1, 8)] == ["net/", "net/", None, "example.net/en/", "example.com/de/", None, "org/fr/"]
    assert [got[i].verdict for i in (1, 2, 4, 5, 7)] == ["block", "block", "allow", "block", "allow"]
    assert (got[2].host, got[2].path, got[3].path, got[4].path, got[8].host, got[9].path) == ("a.net", "/x", "", "/en/1", "", "")
    assert (got[11].host, got[11].path) == ("y:", "//z/en/") and got[8].verdict == "allow"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    m = url_filter.train(pages)
    assert url_filter.judge(pages, m).count() == pages.count()
    assert url_filter.judge(pages.limit(0), url_filter.train(pages.limit(0))).count() == 0


def test_url_model_tells_kinds_apart():
    good = [f"https://news{i % 7}.site.com/story/{i}" for i in range(200)]
    bad = [f"http://win-casino{i % 5}.biz/slots?{i}" for i in range(200)]
    m = url_filter.UrlModel().fit(good, bad)
    s = m.score(url_filter.Texts.of(["https://news3.site.com/story/9999", "http://win-casino9.biz/slots?77777"]))
    assert s[0] >= m.cut > s[1]


def test_simhash_components(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    rows = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in got)
    fps = simhash.fingerprints([t for _, t in ODD]).view(np.uint64)
    root = list(range(len(ODD)))
    for _ in ODD:
        for a in range(len(ODD)):
            for b in range(len(ODD)):
                if (int(fps[a]) ^ int(fps[b])).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    least = {r: min((ODD[i][0] for i in range(len(ODD)) if root[i] == r and ODD[i][0] is not None), default=None) for r in set(root)}
    assert rows == sorted((ODD[i][0] or 0, f"{int(fps[i]):016x}", least[root[i]]) for i in range(len(ODD)))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(2) == 0 and ids.count(1) == 1 and ids.count(None) == 1 and ids.count(3) == 1


def _brute_roots(x):
    f = simhash.Forest(len(x))
    simhash.compare(x.view(np.uint64), np.arange(len(x)), np.arange(len(x)), 3, f)
    return f.root


def _same_groups(x, got):
    root = _brute_roots(x)
    for r in set(root.tolist()):
        members = x[root == r].tolist()
        if len(members) == 1 and members[0] not in got or {got[m] for m in members} == {min(members)}:
            continue
        return False
    return True


@pytest.mark.parametrize(("m", "shard_rows"), [(1, None), (3, 100), (5, 40)])
def test_simhash_hot_shards(spark, m, shard_rows):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 900, dtype=np.uint64)) for b in base], rng.integers(0, 2**63, 400, dtype=np.uint64)])).view(np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in x], "fp long")
    from docframe.llm.components import components

    got = {r.node: r.root for r in components(simhash.near_links(nodes, shard_rows=shard_rows, m=m)).collect()}
    assert _same_groups(x, got)


def test_a_fingerprint_is_sent_to_few_shards(spark):
    rng = np.random.default_rng(8)
    nodes = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, 300)] + [(0,), (-1,)], "fp long")
    for m in (1, 4, 7, 10):
        each = [r["count"] for r in simhash.in_vantage_shards(nodes, m).groupBy("node").count().collect()]
        assert len(each) == 302 and max(each) <= 66 and sum(each) <= 302 * min(66, 2 + 2**m)


def test_vantage_point_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    far = x[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    x = np.unique(np.concatenate([x, far]))
    forest, count = simhash.Forest(len(x)), 0
    for j in (0, 1):
        every = np.arange(len(x))
        count += simhash.tree_links(x, x >> np.uint64(32 * j) & np.uint64(0xFFFFFFFF), every, every, 3, forest)
    assert (forest.root == _brute_roots(x.view(np.int64))).all()
    assert count < len(x) ** 2  # two trees compare less than one brute force
    assert simhash.vantage_points(200) == 1 and simhash.vantage_points(250_000) == 4 and simhash.vantage_points(10**10) == 10


def _winnow_plain(text):
    """Hashes chosen from every window of four grams of five words, one window at a time."""
    import xxhash

    low = lambda b: xxhash.xxh64_intdigest(b, 42) & 0x7FFFFFFF
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    if len(words) < 5:
        grams = [low(" ".join(words).encode())] if words else []
    else:
        grams = []
        for i in range(len(words) - 4):
            g = 0
            for w in words[i : i + 5]:
                g = (g * 1103515245 + low(w.encode())) % 2147483647
            grams.append(g)
    grams = [low(g.to_bytes(8, "little")) for g in grams]
    if len(grams) <= 4:
        return {min(grams)} if grams else set()
    return {min(grams[i : i + 4]) for i in range(len(grams) - 3)}


def test_winnowing_likeness_by_brute_force(spark):
    rng = np.random.default_rng(37)
    texts = [" ".join(f"W{k}" for k in rng.integers(0, 12 if i % 3 else 400, int(rng.integers(0, 60)))) for i in range(40)]
    texts[7] = texts[8]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id // 3: r for r in winnow.edited_fingerprints(docs).collect()}
    assert len(got) == 40 and got[7].fingerprint == got[8].fingerprint and got[7].near_next == 1
    for i, t in enumerate(texts):
        after = texts[(i + 1) % 40]
        c = len(t) // 4
        edited = t[: len(t) - c] + after[:c]
        assert abs(got[i].near_edited - like(_winnow_plain(t), _winnow_plain(edited))) < 1e-9
        assert abs(got[i].near_next - like(_winnow_plain(t), _winnow_plain(after))) < 1e-9


def test_winnowing(spark, odd, empty):
    got = winnow.edited_fingerprints(odd).collect()
    assert len(got) == len(ODD)
    order = sorted(range(len(ODD)), key=lambda i: (ODD[i][0] is not None, ODD[i][0] or 0, ODD[i][1] or ""))
    want = Counter()
    for k, i in enumerate(order):
        a, b = ODD[i][1] or "", ODD[order[(k + 1) % len(order)]][1] or ""
        c = len(a) // 4
        want[ODD[i][0], len(a), hashlib.sha256((a[: len(a) - c] + b[:c]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert by[1, 33] == by[2, 33] and len(by[2, 33]) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert winnow.edited_fingerprints(empty).count() == 0


def test_winnowing_selection_and_guarantee(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 30, 300)]
    shared = " ".join(f"s{k}" for k in range(winnow.GRAM + winnow.WINDOW - 1))
    rows = [(1, " ".join(words) + " " + shared), (2, shared + " " + " ".join(words[::-1])), (3, "a b c"), (4, "a b c d e f g h a b c d e f g h a b c d e")]
    df = winnow.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "fp").select("doc_id", "fp", winnow.hashes("fp").alias("h"))
    got = {r.doc_id: r for r in df.collect()}
    assert set(got[1].h) & set(got[2].h) and len(got[3].fp) == 1
    # brute force over the packed grams of text 4: least per window, rightmost of equal ones
    pos = [winnow._POS - 1 - (p & (winnow._POS - 1)) for p in got[4].fp]
    period, n = 8, 21 - winnow.GRAM + 1
    h_of = {p: v >> 28 for p, v in zip(pos, got[4].fp, strict=True)}
    assert pos == sorted(set(pos)) and all(0 <= p < n for p in pos)
    assert all(any(i <= p < i + winnow.WINDOW for p in pos) for i in range(n - winnow.WINDOW + 1))
    assert all(h_of[a] == h_of[b] for a in pos for b in pos if (a - b) % period == 0)


def test_next_text_by_ranges(spark):
    rows = [(i * 3 % 1009, f"t{i * 3 % 1009}") for i in range(1009)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in winnow.with_next(df, 13).where("not is_guest").collect()}
    assert got == {i: f"t{(i + 1) % 1009}" for i in range(1009)}


def test_backoff_lm(spark, odd, empty):
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(False))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = real.unionByName(odd.select("doc_id", "text"))
    rows = backoff_lm.score_documents(both, backoff_lm.train(both, learn), held, shard_bytes=200_000).collect()
    texts = [(r.doc_id, r.text) for r in both.collect()]
    assert len(rows) == len(texts)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    c = Counter()
    for i, t in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in texts:
        w = [*words(t), None]
        want[i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score <= 0 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert backoff_lm.score_documents(empty, backoff_lm.train(empty, learn), held).count() == 0
    assert {r.n_tokens for r in backoff_lm.score_documents(odd.where("doc_id in (3, 4)"), backoff_lm.train(empty, learn), held).collect()} == {1}


def test_backoff_lm_equals_a_walk_over_the_automaton_of_all_training_texts(spark):
    rng = np.random.default_rng(23)
    passage = [f"p{k}" for k in range(12)]
    texts = [[f"w{k}" for k in rng.integers(0, 20000 if i % 2 else 40, 200)] for i in range(200)] + [passage, passage, passage[::-1], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    learn = F.col("doc_id") % 3 != 1
    model = backoff_lm.train(docs, learn)
    got = {r.doc_id: r.score for r in backoff_lm.score_documents(docs, model, F.lit(False), shard_bytes=20_000).collect()}
    words, pairs, triples = Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if i % 3 != 1:
            s = ["<", *t, ">"]
            words.update(s[1:])
            pairs.update(zip(s, s[1:]))
            triples.update(zip(s, s[1:], s[2:]))
    assert (model.root.n, model.root.v) == (sum(words.values()), len(words))
    walk = backoff_lm.Automaton(model.root, words, pairs, triples).walk
    assert all(abs(got[i] - walk([*t, ">"])) < 1e-6 for i, t in enumerate(texts))
    assert got[201] > got[202] + 12  # a passage that was learned, and its words the other way round
    # arcs of a state, and its failure arc, sum to 1
    root = model.root
    seen = [root.p(np.array([c]))[0] for c in words.values()]
    assert abs(sum(seen) + root.p(np.array([0]))[0] - 1) < 1e-9
    # another table than the one learned from
    other = docs.select("doc_id", "text").where("doc_id >= 200").withColumn("learn", F.lit(7))
    more = {r.doc_id: r.score for r in backoff_lm.score_documents(other, model, F.lit(False), shard_bytes=500).collect()}
    assert more.keys() == {200, 201, 202, 203} and all(abs(more[i] - got[i]) < 1e-9 for i in more)


def test_blocks_round_trip():
    from docframe.llm.blocks import pack, pack_counts, unpack, unpack_counts

    rng = np.random.default_rng(3)
    for n, width in ((0, 5), (1, 64), (1, 3), (7, 3), (1000, 40), (100_000, 64), (300, 12), (5, 0)):
        keys = np.unique(rng.integers(0, 2 ** min(width, 63), n, dtype=np.uint64))
        assert (unpack(pack(keys, width)) == keys).all()
    c = rng.integers(0, 2000, 1000)
    assert (unpack_counts(pack_counts(c)) == c).all() and not len(unpack_counts(pack_counts(c[:0])))


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(10, "one two three four five six seven"), (11, "short"), (12, None)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated, r.item_ids) for r in decontam.contamination(odd, bench, chars=10).collect())
    hit = {1, 2, 7}
    assert got == sorted((i or 0, i in hit, [10] if i in hit else []) for i, _ in ODD)
    assert decontam.contamination(empty, bench).count() == 0
    # slices with and without a hit in one partition
    many = odd.select("doc_id", "text").unionByName(spark.range(3).selectExpr("id + 100 as doc_id", "repeat('clean text ', 500000) as text")).coalesce(1)
    assert decontam.contamination(many, bench).where("contaminated").count() == 4
    assert not any(r.contaminated for r in decontam.contamination(odd, bench.limit(0)).collect())
    few = spark.createDataFrame([(20, "Two  words!"), (21, "x"), (22, "long enough to be sought by its tiles")], "item_id long, text string")
    lines = spark.createDataFrame([(1, "first line\ntwo words\nlast"), (2, "here two words are within a line"), (3, "X"), (4, "a x"), (5, None), (6, "x\nand x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_ids) for r in decontam.contamination(lines, few).collect()) == [(1, [20]), (2, []), (3, [21]), (4, []), (5, []), (6, [21])]
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4


def test_mixing_meets_targets(spark, odd, empty):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 900)), *map(float, rng.dirichlet([2, 1, 0.3]))) for i in range(3000)]
    m = spark.createDataFrame(rows, "doc_id long, tokens long, p_high double, p_low double, p_toxic double")
    got = mixing.fit_rates(m, (0.7, 0.25, 0.05)).toPandas()
    total = got.tokens.sum()
    for name, want in (("p_high", 0.7), ("p_low", 0.25), ("p_toxic", 0.05)):
        assert abs((got.tokens * got[name] * got.rate).sum() / total - want) < 5e-4
    assert (got.rate >= 0).all() and not got.unmet.str.len().any()
    assert {r.rate for r in mixing.fit_rates(m.limit(0).union(spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0)], m.schema))).collect()} == {1.0}
    tox, qual = toxicity.ToxicModel(), quality.QualityModel()
    assert mixing.mix(odd, tox, qual).count() == len(ODD) and mixing.mix(empty, tox, qual).count() == 0


def test_mixing_solves_the_least_squares_problem(spark):
    """Against plain projected gradient descent on all rows: as close to the targets, also where some can't be met."""
    rng = np.random.default_rng(10)
    p = rng.dirichlet([3, 1, 0.05], 800)
    w = rng.integers(1, 500, 800)
    never = np.column_stack([p[:, 0], 1 - p[:, 0], np.zeros(800)])
    for rows, want in ((p, (0.2, 0.6, 0.2)), (p, (0.001, 0.9, 0.099)), (never, (0.7, 0.25, 0.05)), (never, (0.0, 1.0, 0.0))):
        df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(w, rows, strict=True)], "tokens long, p_high double, p_low double, p_toxic double")
        got = mixing.fit(df, want)
        a = rows * (w / w.sum())[:, None]
        r = np.ones(800)
        for _ in range(20_000):
            r = np.maximum(0, r - rows @ (a.T @ r - want))
        best = np.abs(a.T @ r - want)
        off = np.abs(got.reached - want)
        assert off.max() < 1.2 * best.max() + 5e-4 and got.unmet == [n for n, x in zip(mixing.DOMAINS, off, strict=True) if x > 5e-4]
        assert np.allclose(mixing.rates(rows, got.steps), [x.rate for x in df.withColumns(got.columns()).collect()])
        assert np.allclose(a.T @ mixing.rates(rows, got.steps), got.reached)


def test_keep_one_of_repeated_ids_nulls_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, "a"), (1, "other text altogether here now", "b"), (1, long, "c"), (2, "a third text of some words", "d"), (3, None, "e"), (4, "  ", "f"), (None, long, "g"), (None, long, "h"), (5, long + " more", "i"), (6, "x " * 60_000, "j"), (7, "X " * 50_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string").withColumn("key", F.lit(1)).withColumn("n", F.lit("n"))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id or 0, r.text, r.row_key) for r in got.collect() if r.text is not None)
    assert [(i, t) for i, t, _ in kept] == sorted([(0, long), (0, long), (1, long), (1, rows[1][1]), (2, rows[3][1]), (6, "x " * 60_000)])
    assert [r.doc_id for r in got.where("text is null").collect()] == [3]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    from docframe.llm import shingles

    rows = [(i, " ".join(f"w{(i // 3) * 50 + k}" for k in range(30))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(shingles.sieve, "__defaults__", (64,))
    assert {r.doc_id for r in shingles.keep_one(df).collect()} == set(range(0, 90, 3))


def test_counts_of_classes_bound_the_difference():
    from docframe.llm import shingles

    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = (np.unique(rng.integers(0, 4000, int(rng.integers(1, 3000)), dtype=np.uint64)) for _ in range(2))
        g, of = np.concatenate([a, b]) * np.uint64(0x9E3779B97F4A7C15), np.repeat([0, 1], [len(a), len(b)])
        x = shingles.johnson(shingles.class_counts(g, of, 2))
        assert np.bitwise_count(x[0] ^ x[1]).sum() <= len(np.setxor1d(a, b))
        fine = shingles.fine_counts(g, of, 2)
        assert shingles.fine_apart(fine[0].as_py(), fine[1].as_py()) <= len(np.setxor1d(a, b))
        assert shingles.fine_apart(fine[0].as_py(), fine[0].as_py()) == 0


def test_similar_texts_keep_one(spark):
    rng = np.random.default_rng(13)
    vocab = np.array([f"w{k}" for k in range(5000)])
    rows, group, n = [], {}, 0
    for g in range(40):
        words = vocab[rng.integers(0, 5000, 300)]
        for c in range(3 if g % 2 else 1):
            w = words.copy()
            w[rng.integers(0, 300, 2 * c)] = "changed"  # similarity of five-word shingles stays over 0.8
            rows.append((n, " ".join(w)))
            group[n] = g
            n += 1
    rows += [(n, "too short"), (n + 1, "Too  SHORT"), (n + 2, "too brief")]
    group |= {n: 100, n + 1: 100, n + 2: 101}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {min(i for i in group if group[i] == g) for g in set(group.values())}


def test_no_group_without_links_of_the_stated_similarity(spark):
    rng = np.random.default_rng(17)
    vocab = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(150):
        words = [vocab[k] for k in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        for _ in range(4):
            w = list(words)
            for k in rng.integers(0, len(w), int(rng.integers(0, len(w) // 14))):
                w[k] = vocab[int(rng.integers(0, 5000))]
            texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for g in range(0, len(texts), 4):
        for _ in range(3):
            for i in range(g, g + 4):
                for j in range(g, g + 4):
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        root[i] = root[j] = min(root[i], root[j])
    want = {i for i, r in enumerate(root) if i == r}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == want


def test_copies_of_a_text_that_are_nearer_to_each_other(spark):
    rng = np.random.default_rng(19)
    words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    texts = [" ".join(words)]
    for c in range(300):  # four changed words a copy: 0.815 or more to the first text, less between copies
        w = list(words)
        for k in rng.choice(200, 4, replace=False):
            w[k] = f"c{c}x{k}"
        texts.append(" ".join(w))
    for _ in range(400):  # lone pairs at 0.815 or more
        words = [f"v{k}" for k in rng.integers(0, 50000, 200)]
        other = list(words)
        for k in (20, 60, 100, 140):
            other[k + int(rng.integers(0, 20))] = "y"
        texts += [" ".join(words), " ".join(other)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0, *range(301, 1101, 2)}


def test_a_hot_group_of_copies_around_one_text(spark, monkeypatch):
    from docframe.llm import shingles

    monkeypatch.setattr(shingles, "SHARD_ROWS", 40)
    rng = np.random.default_rng(29)
    words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    texts = []
    for c in range(260):  # each 0.815 or more to the first text, less to the others; a third of all
        w = list(words)
        for k in rng.choice(200, 4 if c else 0, replace=False):
            w[k] = f"c{c}x{k}"
        texts.append(" ".join(w))
    for c in range(200):  # one word changed: similar to each other
        w = [f"u{k}" for k in range(150)]
        w[c % 150] = f"d{c}"
        texts.append(" ".join(w))
    texts += [" ".join([*words[:60], *[f"l{c}x{k}" for k in range(100)]]) for c in range(120)]  # a shared passage, not similar
    kept = {r.doc_id for r in shingles.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0, 260, *range(460, 580)}


def test_components_in_one_task_and_in_rounds(spark):
    from docframe.llm.components import components

    rng = np.random.default_rng(31)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(5000, k) for k in range(1000, 1400)] + [(k, k + 1) for k in range(2000, 2200)] + [(7, 7), (1, 2), (1, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, rounds = ({(r.node, r.root) for r in components(df, few=n).collect()} for n in (10**6, 0))
    assert one == rounds and (1399, 1000) in one and (2200, 2000) in one
    assert components(df.limit(0)).count() == 0


def test_near_duplicates_of_a_whole_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = simhash.fingerprints([r.text for r in rows])
    root = _brute_roots(fps)
    least = {r: min(rows[i].doc_id for i in np.flatnonzero(root == r)) for r in set(root.tolist())}
    want = {r.doc_id: (f"{int(f) & (1 << 64) - 1:016x}", least[k]) for r, f, k in zip(rows, fps, root.tolist(), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_keep_one_links_near_fingerprints_first(spark, monkeypatch):
    rng = np.random.default_rng(31)
    texts = []
    for _ in range(30):
        words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:200], "x", *words[201:]])]
    fps = simhash.fingerprints(texts).view(np.uint64)
    asked = []
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda distinct, *a: asked.append(distinct.count()) or real(distinct, *a))
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    forest = simhash.Forest(len(texts))
    for r in simhash.near_pairs(rows, rows.select(F.col("key").alias("node"))).collect():
        forest.link(np.array([r.a]), np.array([r.b]))
    assert (forest.root == _brute_roots(fps)).all() and (forest.root != np.arange(len(texts))).any()
    kept = {r.doc_id for r in simhash.keep_one(rows.withColumnRenamed("key", "doc_id")).collect()}
    assert kept == set(range(0, 90, 3)) and len(asked) == 2


def test_only_shards_in_doubt_are_searched_again(spark, monkeypatch):
    from docframe.llm import shingles

    texts, again, real = [], [], shingles.meet_in_shards
    for g in range(40):
        words = [f"g{g}w{k}" for k in range(200)]
        near = list(words)  # 176 of 221 shingles are shared: just below 0.8
        for k in (20, 60, 100, 140):
            near[k] = f"g{g}x{k}"
        texts += [" ".join(words), " ".join([*near, *[f"g{g}e{k}" for k in range(5)]])]
        texts += [" ".join([*words[a : a + 20], *[f"g{g}p{a}q{k}" for k in range(150)]]) for a in range(0, 200, 20)]  # passages of it

    def meet(rows, *rest):
        if "root" in rows.columns:
            again.append(rows.count())
        return real(rows, *rest)

    monkeypatch.setattr(shingles, "meet_in_shards", meet)
    kept = shingles.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert kept == len(texts) and 0 < again[0] <= 160  # two shards a pair at most


def test_what_stays_does_not_hang_on_the_pairs_proposed_first(spark):
    """A head whose links fail stands for members that are similar: they meet in the search that follows."""
    from docframe.llm import shingles

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in ((r.text or "").lower().split() for r in rows)]
    root = list(range(len(rows)))
    links = [(a, b) for b in range(len(rows)) for a in range(b) if 5 * len(sets[a]) >= 4 * len(sets[b]) and 4 * len(sets[a]) <= 5 * len(sets[b]) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    for _ in rows:
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    want = {r.doc_id for k, r in enumerate(rows) if root[k] == k}
    star = lambda texts, nodes: nodes.crossJoin(nodes.agg(F.min("node").alias("head"))).select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b")  # noqa: E731 - links that all fail
    for first in (simhash.near_pairs, star, None):
        assert {r.doc_id for r in shingles.keep_one(docs, first).collect()} == want
    assert links and len(want) < len(rows)
