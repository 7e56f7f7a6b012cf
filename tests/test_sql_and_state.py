"""Table functions in SQL against the forms on DataFrames; keyed state of a stream against its definition."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docframe.functions import tables
from docframe.operators import relational as rel
from docframe.streaming.titles import first_seen


@pytest.fixture(scope="module")
def pieces(spark):
    tables.register(spark)
    df = spark.range(400).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("pos"), (F.col("id") * 13 % 9 + F.when(F.col("id") % 50 == 0, 20).otherwise(0)).alias("cost"), (F.col("id") * 7 % 4).alias("depth"), F.concat(F.lit("line "), "id", F.lit("😀")).alias("line"), (F.col("id") % 3).alias("list_id")).repartition(5)
    df.createOrReplaceTempView("pieces")
    return df


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_functions_equal_dataframe_forms(spark, pieces):
    assert rows(spark.sql("select * from pack_pages(table(pieces), room => 14)"), "doc_id", "pos", "page") == rows(rel.pack(pieces, 14), "doc_id", "pos", "page")
    assert rows(spark.sql("select * from list_numbers(table(select * from pieces where pos > 3))"), "list_id", "pos", "number") == rows(rel.list_numbers(pieces.where("pos > 3")), "list_id", "pos", "number")
    assert rows(spark.sql("select * from row_budget(table(pieces), 100)"), "doc_id", "pos", "used") == rows(rel.row_budget(pieces, 100), "doc_id", "pos", "used")
    # other columns are passed on, and the result is a table like any other
    got = spark.sql("select p.line, count(*) over (partition by p.page) as n from pack_pages(table(pieces), 14) p join pieces using (doc_id, pos) where p.page = 0")
    assert got.count() == rel.pack(pieces, 14).where("page = 0").count()
    assert spark.sql("select * from pack_pages(table(select * from pieces where false), 14)").columns == [*pieces.columns, "page"]


@pytest.mark.parametrize(("call", "why"), [("pack_pages(table(select doc_id, pos from pieces), 14)", "no column cost"), ("pack_pages(table(pieces), 0)", "whole number"), ("pack_pages(3, 14)", "must be a table"), ("list_numbers(table(select *, 1 as number from pieces))", "of its own"), ("row_budget(table(select pos, line from pieces), 5)", "no column doc_id")])
def test_wrong_tables_are_refused(spark, pieces, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"select * from {call}").collect()


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_first_sightings(spark, tmp_path):
    """Batches in a row, the stream started anew for each: late rows, earlier sightings, nulls, repeated rows, forgotten titles."""
    batches = [
        [("a", "x", 10), ("a", "x", 12), ("b", "x", 30), ("a", None, 5), (None, "x", 5), ("a", "y", 40)],  # mark then 30
        [("a", "y", 35), ("a", "z", 29), ("b", "w", 41), ("b", "w", 41), ("c", "q", 60)],  # z is late; y was seen earlier; mark 50
        [("a", "x", 75), ("b", "v", 49), ("b", "w", 80)],  # v is late; mark 70
        [("d", "end", 200)],
    ]

    def run(forget):
        base = tmp_path / str(forget)
        told = []
        for k, rows in enumerate(batches):
            spark.createDataFrame([(a, b, at(m)) for a, b, m in rows], "key string, title string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{base}/in")
            arrivals = spark.readStream.schema("key string, title string, ts timestamp").parquet(f"{base}/in")
            got = first_seen(arrivals, "key", "title", "ts", timedelta(minutes=10), forget)
            got.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
            out = spark.read.parquet(f"{base}/out").collect()
            new = sorted((r.key, r.title, round((r.first_seen - at(0)).total_seconds() / 60)) for r in out)
            told.append([x for x in new if x not in sum(told, [])])
        return told

    zone = spark.conf.get("spark.sql.session.timeZone")
    assert zone == "UTC"
    assert run(None) == [[("a", "x", 10)], [("a", "y", 35), ("b", "w", 41), ("b", "x", 30)], [("c", "q", 60)], []]
    assert run(timedelta(minutes=20)) == [[("a", "x", 10)], [("a", "y", 35), ("b", "w", 41), ("b", "x", 30)], [("c", "q", 60)], [("a", "x", 75), ("b", "w", 80)]]
    assert run(timedelta(minutes=39)) == [[("a", "x", 10)], [("a", "y", 35), ("b", "w", 41), ("b", "x", 30)], [("c", "q", 60)], [("a", "x", 75), ("b", "w", 80)]]
    assert run(timedelta(minutes=40))[3] == [("a", "x", 75)]


def test_tiles_are_those_of_a_window(spark):
    from pyspark.sql import Window

    for n, of in ((3, 100), (7, 5), (3, 0)):
        df = spark.range(of).select((F.col("id") * 37 % 101).alias("a"), "id").repartition(3)
        want = df.withColumn("tile", F.ntile(n).over(Window.orderBy("a", "id")) - 1)
        got = rel.tiles(df, n, "a", "id")
        assert rows(got, "a", "id", "tile") == rows(want, "a", "id", "tile")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan


class _Handle:
    """What a processor asks of its state, counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_a_batch_asks_for_a_keys_state_a_few_times_only(spark):
    from pyspark.sql import Row

    from docframe.streaming.titles import FirstSeen

    p, h = FirstSeen(None), _Handle()
    p.init(h)
    p.handleInputRows(("a",), iter([Row(title=str(k), us=5_000_000 - k * 1000) for k in range(500)]), _Mark(0))
    assert len(h.timers) == 1 and h.calls <= 4
    (first,) = h.timers
    told = list(p.handleExpiredTimer(("a",), _Mark(4_900), None))
    assert first == 4_502 and {r.title for r in told} == {str(k) for k in range(102, 500)}
    assert h.calls <= 8 and max(h.timers) == 4_900
    assert len(list(p.handleExpiredTimer(("a",), _Mark(10_000), None))) == 102


def test_titles_of_a_key_in_slots(spark, tmp_path):
    spark.createDataFrame([("a", f"t{k}", at(k)) for k in range(60)], "key string, title string, ts timestamp").write.parquet(f"{tmp_path}/in")
    arrivals = spark.readStream.schema("key string, title string, ts timestamp").parquet(f"{tmp_path}/in")
    got = first_seen(arrivals, "key", "title", "ts", timedelta(minutes=10), slots=4)
    got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert {r.title for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {f"t{k}" for k in range(49)}


def test_list_numbers_of_runs_are_those_of_items(spark, pieces):
    want = rows(rel.list_numbers(pieces), "list_id", "pos", "number")
    for most in (1, 7, 1000):
        runs = pieces.groupBy("list_id", F.floor(F.col("pos") / most).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "depth"))).alias("i")).select("list_id", F.col("i.pos")[0].alias("pos"), F.col("i.pos").alias("places"), F.col("i.depth").alias("depth"))
        got = spark.sql("select * from list_numbers(table({t}))", t=runs).select("list_id", F.inline(F.arrays_zip("places", "number")))
        assert rows(got, "list_id", "places", "number") == want


def test_the_query_calls_its_function_by_runs(spark, monkeypatch):
    """A call takes a run of a list, not an item, and runs of any length give the rows of ``list_numbering``."""
    from docframe import queries_text
    from docframe.queries import QUERIES

    asked = []
    plain = queries_text._in_sql
    monkeypatch.setattr(queries_text, "_in_sql", lambda s, table, call: asked.append(table) or plain(s, table, call))
    monkeypatch.setattr(queries_text, "RUN_ITEMS", 2, raising=False)
    there = "/root/testdata/sf0.001"
    columns = ("list_id", "pos", "depth", "number")
    assert rows(QUERIES["sql_list_numbers"](spark, there), *columns) == rows(QUERIES["list_numbering"](spark, there), *columns)
    assert asked[0].count() < 5_000  # of 6,000 items
