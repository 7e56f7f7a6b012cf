"""Registered queries against their SQL, operators against kernels, and the entry point."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from docframe import api
from docframe.functions import documents as fn
from docframe.kernels import lines, sheets, xmlscan
from docframe.kernels.errors import Refused
from docframe.operators import kernels
from docframe.queries import ORACLES, QUERIES
from docframe.streaming.ingest import read_continuously
from docframe.writers import xlsx
from tools_compare import canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        assert canon(got).equals(canon(want))
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_corpus_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    import shutil

    shutil.copytree(root / "docframe", tmp_path / "docframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.strip() == str(len(QUERIES)), out.stderr


TEXTS = [" a \t b  c | | ", "", " | ", "x 　y", "﻿z", "1 |  | 2 |", "tab\tonly", "&amp;lt; &quot;q&quot; <b>", "한글 wide", "a😀b", "name.HTML ", "../../etc/passwd", "...", "Z9", "AAB12"]


def test_expressions_agree_with_kernels(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", fn.tidy_line(F.col("t")).alias("tidy"), fn.units(F.col("t")).alias("units"), fn.escape_xml(F.col("t")).alias("esc"), fn.decode_named(F.col("t")).alias("dec"), fn.column_of(F.col("t")).alias("col"), fn.cut_units(F.col("t"), 2).alias("cut"), fn.safe_filename(F.col("t"), "pdf").alias("file"), fn.extension_of(F.col("t")).alias("ext")).collect()
    for r in got:
        assert r.tidy == lines.tidy(r.t) and r.units == lines.units(r.t) and r.esc == xmlscan.escape(r.t) and r.dec == xmlscan.decode(r.t)
        assert r.col == sheets.column_of(r.t) and r.cut == lines.cut(r.t, 2)
    by = {r.t: r for r in got}
    assert by["../../etc/passwd"].file == "etc passwd.pdf" and by["..."].file == "document.pdf" and by["name.HTML "].ext == "html"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_escape_then_decode_is_the_same(text):
    assert xmlscan.decode(xmlscan.escape(text)) == text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_packing_loses_nothing(costs):
    from docframe.plans.deck import pack

    pages = pack([{"kind": "paragraph", "text": str(i), "indent": 0, "cost": c} for i, c in enumerate(costs)])
    assert [p["text"] for s in pages for p in s] == [str(i) for i in range(len(costs))]
    assert all(len(s) == 1 or sum(p["cost"] for p in s) <= 14 for s in pages)


def test_refusals_are_rows(spark):
    rows = [(1, "a.bin", b""), (2, "a.bin", None), (3, "a.doc", b"\x01\x02"), (4, "x.xlsx", b"PK\x03\x04broken"), (5, None, b"\x00\x01\x02")]
    got = kernels.read_documents(spark.createDataFrame(rows, "doc_id long, filename string, content binary")).collect()
    assert len(got) == 5 and all(r.error.code == "UNSUPPORTED_FORMAT" and r.text is None for r in got)


def test_api(spark):
    data = xlsx.render([{"name": "S", "rows": [["a", {"formula": "1+1", "cached": 2}], ["b", 3]]}])
    df = spark.createDataFrame([(1, bytearray(data))], "doc_id long, content binary")
    assert {(r.address, r.value) for r in api.run("inspect_spreadsheet", df).collect()} == {("A1", "a"), ("B1", "2"), ("A2", "b"), ("B2", "3")}
    assert [r.formula for r in api.run("inspect_spreadsheet", df, mode="formulas").collect()] == ["1+1"]
    with pytest.raises(Refused):
        api.run("other", df)
    with pytest.raises(Refused):
        api.run("inspect_spreadsheet", df, mode="x")
    bad = spark.createDataFrame([(1, "odt", "executive", "x"), (2, "docx", "none", "x"), (3, "docx", "executive", "  ")], "doc_id long, format string, profile string, markdown string")
    assert [r.error.field for r in kernels.render_documents(bad).orderBy("doc_id").collect()] == ["format", "profile", "content"]


def test_stream_and_batch_files(spark, tmp_path):
    from docframe.sources.files import documents

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.rtf").write_bytes(rb"{\rtf1 hello\par world}")
    (src / "b.xlsx").write_bytes(xlsx.render([{"name": "S", "rows": [["x", 1]]}]))
    q = read_continuously(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    got = {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"hello\nworld", "## S\nx | 1"} == {r.text for r in kernels.read_documents(documents(spark, str(src))).collect()}


def test_wrapping(spark):
    text = "a bb ccc " + "x" * 25 + " dd " * 20
    got = [r.line for r in kernels.wrapped_lines(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), 10).where("doc_id = 1").orderBy("line_no").collect()]
    assert "".join(got).replace(" ", "") == text.replace(" ", "") and all(0 < len(x) <= 10 for x in got)
    assert all(len(a) + 1 + len(b.split()[0]) > 10 for a, b in zip(got, got[1:], strict=False))


def test_inspection_bounds_and_modes(spark):
    data = xlsx.render([{"name": "S", "rows": [["a", {"formula": "1+1", "cached": 2}], ["b", 3]]}, {"name": "T", "rows": [["c"]]}], "Title")
    df = spark.createDataFrame([(1, "b.xlsx", bytearray(data)), (2, None, bytearray(b"junk")), (3, "", None)], "doc_id long, filename string, content binary")
    look = lambda **o: {r.doc_id: r for r in kernels.inspect_workbooks(df, **o).collect()}
    got = look()
    assert got[1].text == "## S\nA1: a\nB1: =1+1 → 2\nA2: b\nB2: 3\n\n## T\nA1: c" and got[1].complete and got[1].total_sheets == 2
    assert got[2].error.code and got[3].error.code and got[2].answer.startswith("Error: could not inspect the workbook — ")
    assert look(mode="formulas")[1].text == "## S\nB1: =1+1\n\n## T"
    for most, whole in ((3, False), (4, False), (5, True)):
        r = look(cap=most)[1]
        assert r.complete is whole and r.text.count(": ") == most
    short = look(budget=14)[1]
    assert short.text == "## S\nA1: a" and not short.complete and "a bounded prefix of cells" in short.answer


def test_validation_wants_every_required_part(spark):
    import io
    import zipfile

    asked = spark.createDataFrame([(k, f, "standard", "# A\n\ntext & more") for k, f in enumerate(("docx", "pptx", "hwpx"))], "doc_id long, format string, profile string, markdown string")
    made = {r.doc_id: (f, bytes(r.content)) for r, f in zip(kernels.render_documents(asked).orderBy("doc_id").collect(), ("docx", "pptx", "hwpx"), strict=True)}
    made[3] = ("xlsx", xlsx.render([{"name": "S", "rows": [["a", 1]]}], "T & U"))
    rows, want = [], {}
    for form, data in made.values():
        old = zipfile.ZipFile(io.BytesIO(data))
        for gone in (None, *kernels.REQUIRED[form]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for name in old.namelist():
                    if name != gone:
                        z.writestr(name, old.read(name))
            want[len(rows)] = gone
            rows.append((len(rows), form, bytearray(out.getvalue())))
    got = {r.doc_id: r for r in kernels.validate_outputs(spark.createDataFrame(rows, "doc_id long, format string, content binary")).collect()}
    assert all(got[k].structure is (gone is None) for k, gone in want.items())
    assert all(got[k].content_ok for k, gone in want.items() if gone is None)


def test_inline_sources(spark):
    rows = [(1, "a.rtf", "e1xydGYxIGhpfQ=="), (2, None, "*"), (3, "b.rtf", None)]
    got = {r.doc_id: r for r in api.run("read_document", spark.createDataFrame(rows, "doc_id long, filename string, content string")).collect()}
    assert got[1].text == "hi" and got[1].answer.startswith("[Read from a.rtf — untrusted content.") and got[1].answer.endswith("\n\nhi")
    assert [got[k].error.code for k in (2, 3)] == ["INVALID_INPUT"] * 2


@pytest.mark.parametrize("name", ["list_numbering", "section_ids"])
def test_tasks_hold_so_many_rows_whatever_the_shuffle_partitions(spark, monkeypatch, name):
    from docframe.operators import relational as rel

    monkeypatch.setattr(rel, "TASK_ROWS", 500, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tasks = [r["count"] for r in QUERIES[name](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(tasks) == 6000 and max(tasks) < 1000


def test_assets_are_judged_in_tasks_of_so_many_rows(spark, monkeypatch):
    from docframe.operators import relational as rel

    monkeypatch.setattr(rel, "TASK_ROWS", 500, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tasks = [r["count"] for r in QUERIES["asset_rules"](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    orders = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    assert sum(tasks) == orders and max(tasks) < orders / 4


def test_rtf_of_odd_rows_as_its_sql_says(spark, tmp_path):
    """Rows without a line, repeated ids, ids that are null, and a text beyond ten million characters."""
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "same\ntext"), (4, "same\ntext"), (8, "b\nd\n"), (8, "a\n\nc"), (8, "b"), (5, "a | |\n\n\tb 😀"), (None, "no id"), (6, None), (6, "one of two"), (7, "x\n" + "ab" * 5_100_000 + "\nend")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect(config={"threads": 1})  # which takes rows whose place is the same in the table's order
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["rtf_read"](spark, str(tmp_path)).toPandas()
    assert len(got) == 6 and canon(got).equals(canon(con.execute(ORACLES["rtf_read"]).df()))


def test_workbooks_are_dealt_to_tasks_by_their_number(spark):
    """Their rows are few bytes, which would leave all the work to a task or two."""
    got = QUERIES["inspect_cell_cap"](spark, SF)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and got.rdd.getNumPartitions() >= 4
