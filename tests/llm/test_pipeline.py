"""The pipeline: registered, in order, and each stage keeps the columns and takes effect."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docframe.llm import domains, mixing

SF = "/root/testdata/sf0.001"


def test_run_over_the_smallest_tables(spark):
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*raw.columns, *[f"p_{k}" for k in corpus_pipeline.TARGETS], "rate", "unmet"]
    rows, texts = got.collect(), {(r.doc_id, r.text) for r in raw.collect()}
    assert 0 < len(rows) < raw.count() and all((r.doc_id, r.text) in texts and r.rate >= 0 for r in rows)
    # brute force: no two kept texts of similarity 0.8, none that is toxic by label
    def sets(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    kept = [sets(r.text) for r in rows]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(kept) for b in kept[:i])
    total = sum(len((r.text or "").split()) for r in rows)
    for k, share in corpus_pipeline.TARGETS.items():
        reached = sum(len((r.text or "").split()) * r.rate * r[f"p_{k}"] for r in rows) / total
        assert k in rows[0].unmet or abs(reached - share) < 0.01


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Tables with nulls, empties, repeats, clashing columns and a very long text."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(60).cache()
    odd = [(900, None), (901, ""), (902, "  "), (903, "word " * 40_000), (None, "a text without an id that is long enough"), (904, "one two three four five six seven"), (904, "one two three four five six seven"), (904, "another text of this id altogether"), (905, "One Two  three four five six SEVEN")]
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    where = str(tmp_path_factory.mktemp("made"))
    docs = base.unionByName(more).withColumn("rate", F.lit("mine")).withColumn("key", F.lit(3)).withColumn("p_en", F.lit(True)).withColumn("score", F.lit(0))
    docs.write.parquet(f"{where}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    return where


def test_run_over_odd_rows(spark, made):
    got = corpus_pipeline.run(spark, made)
    assert [c for c in got.columns if got.columns.count(c) > 1] == [] and {"key", "score", "rate", "unmet", "p_en"} <= set(got.columns)
    assert dict(got.dtypes)["rate"] == "double" and dict(got.dtypes)["p_en"] == "double"
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert [i for i, t in rows if t and t.lower().split() == "one two three four five six seven".split()] == []  # a classifier rejects it


def test_one_copy_stays_whatever_the_ids(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, made).collect()]
    assert [i for i, t in rows if t and t.lower().split() == "one two three four five six seven".split()] == [904]
    assert sorted(i for i, t in rows if i is not None and i > 899) == [900, 903, 904, 904]  # null, empty and blank texts are equal
    assert (None, "a text without an id that is long enough") in rows and (904, "another text of this id altogether") in rows


def test_run_over_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_domains_and_rates(spark):
    rng = np.random.default_rng(3)
    words = {"en": [f"the{k}" for k in range(50)], "de": [f"das{k}" for k in range(50)], "fr": [f"les{k}" for k in range(50)]}
    rows = []
    for i in range(600):
        k = ("en", "en", "en", "de", "fr")[i % 5]
        rows.append((i, " ".join(rng.choice(words[k], int(rng.integers(5, 60)))), k if i < 300 else None))
    docs = spark.createDataFrame([*rows, (None, "the1 the2", "en"), (601, None, "fr"), (602, "", "xx")], "doc_id long, text string, lang string")
    model = domains.train(docs, "lang", ("en", "de", "fr"), per_class=40)
    got = mixing.mix_documents(docs, model, (0.5, 0.3, 0.2)).collect()
    assert len(got) == 603
    own = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 600]
    assert all(max(("en", "de", "fr"), key=lambda k: r[f"p_{k}"]) == ("en", "en", "en", "de", "fr")[r.doc_id % 5] for r in own)
    total = sum(len((r.text or "").split()) for r in got)
    for k, want in (("en", 0.5), ("de", 0.3), ("fr", 0.2)):
        assert abs(sum(len((r.text or "").split()) * r.rate * r[f"p_{k}"] for r in got) / total - want) < 5e-3
    assert {tuple(r.unmet) for r in got} == {()}
    never = mixing.mix_documents(docs.where("lang = 'en'"), model, (0.5, 0.3, 0.2))
    assert "de" in never.first().unmet
    assert domains.train(docs.limit(0), "lang", ("en", "de")).posteriors(domains.Texts.of(["x", ""])).tolist() == [[0.5, 0.5], [0.5, 0.5]]


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_stages_hand_on_small_batches(spark):
    """A wide table's batches are bounded by rows, whatever the session had before."""
    sizes = []
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.drop_benchmark_leaks):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(6)]).alias("text"))
        assert stage(spark, docs, SF).count() == 3000
        sizes += [r[0] for r in docs.mapInArrow(lambda batches: ((b.from_pylist([{"n": b.num_rows}]) for b in batches)), "n long").collect()]
    assert sum(sizes) == 6000 and max(sizes) <= corpus_pipeline.BATCH_ROWS
