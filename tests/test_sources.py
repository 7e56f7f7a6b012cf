"""Packages as a planned, filtered source; documents as a committed sink."""

import io
import os
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docframe.sources import files, packages, sink
from docframe.sources.packages import Reader, Slice, planned


def zipped(parts, stored=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    for i in range(6):
        (tmp_path / f"p{i}.zip").write_bytes(zipped({"a.xml": f"<a>{i}</a>", "dir/b.txt": "b" * (100 * i), "mimetype": "x/y"}, ("mimetype",)))
    (tmp_path / "bad.zip").write_bytes(b"PK nothing of the kind")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "none.zip").write_bytes(zipped({}))
    (tmp_path / "_hidden.zip").write_bytes(zipped({"h": "h"}))
    (tmp_path / "notes.txt").write_text("no package")
    return tmp_path


def base(c):
    return F.element_at(F.split(c, "/"), -1)


def test_members_without_contents(spark, folder):
    got = packages.members(spark, str(folder), pattern="*.zip")
    assert got.columns == ["file", "ord", "name", "compressed_size", "original_size", "crc", "error"]
    rows = {(r.f, r.ord, r.name): (r.original_size, r.error) for r in got.withColumn("f", base("file")).collect()}
    assert {k: v for k, v in rows.items() if k[0] == "p3.zip"} == {("p3.zip", 0, "a.xml"): (8, None), ("p3.zip", 1, "dir/b.txt"): (300, None), ("p3.zip", 2, "mimetype"): (3, None)}
    assert rows["bad.zip", None, None][1] == rows["empty.zip", None, None][1] == "the archive could not be read" and rows["none.zip", None, None][1] == "the archive is empty"
    assert len(rows) == 6 * 3 + 3
    assert packages.members(spark, str(folder), pattern="*.nothing").count() == 0


def test_filters_choose_as_spark_does(spark, folder):
    at = {"path": str(folder), "contents": True}
    whole = packages.members(spark, **at)
    p2 = f"{folder}/p2.zip"
    asked = {
        (("name", "endswith", ".txt"), ("original_size", ">=", 200)): "name like '%.txt' and original_size >= 200",
        (("name", "=", "a.xml"),): "name = 'a.xml'",
        (("name", "in", ("a.xml", "mimetype")), ("ord", ">", 0)): "name in ('a.xml', 'mimetype') and ord > 0",
        (("file", "=", p2),): f"file = '{p2}'",
        (("file", "startswith", str(folder)), ("compressed_size", "<", 9)): "compressed_size < 9",
        (("name", "like", "dir/*"), ("original_size", "<=", 100)): "name like 'dir/%' and original_size <= 100",
        (("name", "contains", "ime"),): "name like '%ime%'",
    }
    as_text = lambda df: sorted(str(r) for r in df.collect())
    for where, condition in asked.items():
        assert as_text(packages.members(spark, **at, where=list(where))) == as_text(whole.where(condition)) != []
    # scans of one DataFrame under different filters, and of filtered reads, in one plan
    names = lambda df: sorted(r.name for r in df.select("name").collect())
    x, y = (packages.members(spark, str(folder), where=[("name", "=", n)]) for n in ("a.xml", "mimetype"))
    assert names(x.union(y)) == names(whole.where("name = 'a.xml'").select("name").union(whole.where("name = 'mimetype'").select("name"))) == ["a.xml"] * 6 + ["mimetype"] * 6
    with pytest.raises(ValueError, match="no filter"):
        packages.members(spark, str(folder), where=[("content", "=", b"x")])


def test_files_are_chosen_before_planning(folder):
    reader = Reader(str(folder), "*.zip", True, 1, [("file", "endswith", "p2.zip")])
    assert {f for s in reader.partitions() for f, _, _ in s.files} == {f"{folder}/p2.zip"}


class Spy(io.BytesIO):
    """A file that remembers which bytes were read."""

    def __init__(self, data):
        super().__init__(data)
        self.ranges = []

    def read(self, n=-1):
        at = self.tell()
        out = super().read(n)
        self.ranges.append((at, at + len(out)))
        return out


def test_unasked_members_are_never_inflated(spark, tmp_path):
    noise = os.urandom(3_000_000)
    data = bytearray(zipped({"big.bin": noise, "small.xml": "<x/>", "more.bin": noise}))
    data[1_000_000:1_000_016] = b"\0" * 16  # big.bin is broken
    (tmp_path / "p.zip").write_bytes(data)
    got = packages.members(spark, str(tmp_path), contents=True)
    (one,) = packages.members(spark, str(tmp_path), contents=True, where=[("name", "=", "small.xml")]).collect()
    assert bytes(one.content) == b"<x/>" and one.error is None
    assert {r.name: r.error for r in got.collect()} == {"big.bin": "part big.bin could not be read", "small.xml": None, "more.bin": None}
    reader = Reader(str(tmp_path), "*", True, 1 << 26, [("name", "=", "small.xml")])
    spy = Spy(bytes(data))
    assert [r["name"] for r in reader.rows(spy, "p", 0, len(data))] == ["small.xml"]
    assert sum(b - a for a, b in spy.ranges) < 100_000
    reader.contents, spy = False, Spy(bytes(data))
    reader.tests = []
    assert len(list(reader.rows(spy, "p", 0, len(data)))) == 3 and all(a > 5_000_000 for a, b in spy.ranges if b > a)


def test_plans_group_small_files_and_cut_large_ones(spark, tmp_path):
    mb = 1 << 20
    assert [len(s.files) for s in planned([(str(i), mb) for i in range(10)], True, 8 * mb)] == [4, 4, 2]
    assert [s.files for s in planned([("x", 20 * mb)], True, 8 * mb)] == [[("x", 0, 8 * mb)], [("x", 8 * mb, 16 * mb)], [("x", 16 * mb, 20 * mb)]]
    assert planned([("x", 20 * mb), ("y", 0)], False, 8 * mb) == [Slice([("x", 0, 20 * mb), ("y", 0, 0)])] and planned([], True, mb) == []
    parts = {f"m{i}": os.urandom(50_000) for i in range(40)}
    (tmp_path / "p.zip").write_bytes(zipped(parts))
    got = packages.members(spark, str(tmp_path), contents=True, partition_bytes=300_000)
    assert got.rdd.getNumPartitions() == 7 and {r.name: bytes(r.content) for r in got.collect()} == parts


def visible(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file()) if Path(path).exists() else []


def test_documents_are_written_and_read(spark, tmp_path):
    to = str(tmp_path / "out")
    df = spark.range(50).select(F.concat(F.lit("d"), "id", F.lit(".txt")).alias("filename"), F.encode(F.concat(F.lit("text "), "id"), "UTF-8").alias("content"), F.lit(1).alias("other"))
    sink.write_documents(df, to)
    sink.write_documents(df.where("id < 3"), to)
    got = files.documents(spark, to).select("filename", F.decode("content", "UTF-8").alias("t")).collect()
    assert sorted((r.filename, r.t) for r in got) == sorted([(f"d{i}.txt", f"text {i}") for i in range(50)] + [(f"d{i}.txt", f"text {i}") for i in range(3)])
    sink.write_documents(df.where("id < 2"), to, mode="overwrite")
    assert [Path(p).name for p in visible(to)] == ["d0.txt", "d1.txt"]
    sink.write_documents(df.where("id < 0"), str(tmp_path / "none"))
    assert visible(tmp_path / "none") == [] and (tmp_path / "none").is_dir()
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("._")] == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    to = tmp_path / "out"
    df = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d"), "id").alias("filename"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.encode(F.lit("x"), "UTF-8")).alias("content"))
    for bad in (df, df.withColumn("content", F.lit(None).cast("binary")), df.withColumn("filename", F.lit("../d")).withColumn("content", F.lit(b"x")), df.withColumn("filename", F.lit("same")).withColumn("content", F.lit(b"x"))):
        with pytest.raises(Exception):  # noqa: B017
            sink.write_documents(bad, str(to))
        assert visible(tmp_path) == [] and not to.exists()


def test_a_task_that_is_tried_again_leaves_no_double(tmp_path):
    row = [{"filename": "a", "content": b"1"}, {"filename": "b", "content": b"2"}]
    w = sink.BatchWriter(str(tmp_path / "out"), False)
    lost, told = w.write(iter(row)), w.write(iter(row))  # the first attempt's word never comes
    assert visible(tmp_path / "out") == [] and lost.attempt != told.attempt
    w.commit([told, None])
    assert [Path(p).name for p in visible(tmp_path)] == ["a", "b"]
    again = sink.BatchWriter(str(tmp_path / "out"), False)
    again.abort([again.write(iter(row))])
    assert len(visible(tmp_path)) == 2


def test_a_stream_is_written_once(spark, tmp_path):
    source, to, ck = tmp_path / "in", tmp_path / "out", str(tmp_path / "ck")
    source.mkdir()

    def run():
        arrivals = files.document_stream(spark, str(source), "*.txt").select("filename", "content")
        q = sink.write_stream(arrivals, str(to), ck).trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(3):
        (source / f"f{i}.txt").write_text(str(i))
    run()
    (source / "f3.txt").write_text("3")
    run()
    assert sorted(Path(p).name for p in visible(to)) == ["f0.txt", "f1.txt", "f2.txt", "f3.txt"] and len(list(to.iterdir())) == 2
    # a batch that is sent again after its files were put
    w = sink.StreamWriter(str(to), )
    w.commit([w.write(iter([{"filename": "f0.txt", "content": b"0"}]))], 0)
    assert len(visible(to)) == 4
    # the last batch is not known to be done: it is sent again
    last = max((p for p in Path(ck, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (Path(ck) / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    time.sleep(0.1)
    run()
    assert len(visible(to)) == 4
