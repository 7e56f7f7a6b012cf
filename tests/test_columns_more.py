"""Column expressions against the helpers that work on one document."""

import random
import struct

from pyspark.sql import functions as F

from docframe.functions import documents as fn
from docframe.kernels import markdown
from docframe.kernels.lines import normalize, tidy
from docframe.operators import kernels
from docframe.operators import relational as rel


def jpeg_walk(b):
    """The size in a JPEG, read segment by segment."""
    at = 2
    if b[:2] != b"\xff\xd8":
        return None
    while at + 9 < len(b):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xD8 or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        (n,) = struct.unpack(">H", b[at + 2 : at + 4])
        if n < 2:
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return (w, h) if w and h else None
        at += 2 + n
    return None


def test_jpeg_sizes(spark):
    r = random.Random(2)
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    files = [b"", b"\xff", b"\xff\xd8", b"GIF89a", b"\xff\xd8\xff\xc0"]
    for _ in range(200):
        b = b"\xff\xd8"
        for _ in range(r.randint(0, 5)):
            k = r.random()
            body = bytes(r.choice([0xFF, 0xC0, 0, 17, r.randrange(256)]) for _ in range(r.randint(0, 60)))
            b += b"\xff\xd1" if k < 0.1 else bytes([r.randrange(256)]) if k < 0.15 else b"\xff\xe0\x00\x01" if k < 0.18 else segment(r.choice([0xE0, 0xDB, 0xC4, 0xC8, 0xCC, 0xFE]), body)
        b += segment(r.choice([0xC0, 0xC2, 0xCF]), b"\x08" + struct.pack(">HH", r.choice([0, 5, 700]), r.randint(0, 900)) + b"\x03" + bytes(9)) + bytes(r.choices([0xFF, 0, 3], k=40))
        files.append(b[: r.randint(2, len(b))] if r.random() < 0.2 else b)
    files.append(b"\xff\xd8" + segment(0xE2, bytes(65533)) * 40 + segment(0xC1, b"\x08\x00\x07\x00\x09" + bytes(12)))
    got = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "i int, b binary").select("i", fn.image_size(F.col("b")).alias("s")).collect()
    assert [tuple(x.s) if x.s else None for x in sorted(got)] == [jpeg_walk(b) for b in files]
    assert sum(jpeg_walk(b) is not None for b in files) > 50


def test_a_file_is_walked_once(spark):
    """The walk over a picture's segments stands once in the plan, however many fields are asked for."""
    df = spark.createDataFrame([(bytearray(b"\xff\xd8"), 1)], "b binary, i int")
    plan = df.select(fn.image_size(F.concat("b", "b")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("concat(b") == 1


def test_normal_lines(spark):
    r = random.Random(3)
    texts = ["", "\n\n", "a", "\n a \n\n\n\tb\t|\n", "| | |", "x |  | \n   \n \n y"] + ["\n".join(r.choice(["", " ", "a  b", "\t|", "c \t d", "　"]) for _ in range(r.randint(1, 12))) for _ in range(40)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_join(fn.normal_lines(F.split("t", "\n")), "\n")).collect()
    assert [x[0] for x in got] == [normalize(t.split("\n")) for t in texts]
    plan = spark.createDataFrame([("a", 1)], "t string, i int").select(fn.normal_lines(F.split("t", "\n")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_lines_are_tidied_once_and_in_linear_time(spark):
    """Each line passes two expressions, however often the result is asked for; long runs of blanks and cells take no square of their length."""
    texts = ["a" + " " * 200_000 + "b", "x" + "| " * 100_000 + "y", "z" + " |" * 100_000, "\t " * 100_000 + "end"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x[0] for x in df.select(fn.tidy_line(F.col("t"))).collect()] == [tidy(t) for t in texts]
    plan = spark.createDataFrame([("a", 1)], "t string, i int").select(fn.normal_lines(F.split("t", "\n")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4


def test_bold_faces(spark):
    texts = ["plain *italic*", "**bold** word", "# Heading", "- a\n- **b**", "- a\n- b", "> **q**", "> q", "| a | b |\n|-|-|\n| 1 | 2 |", "```\n**code**\n```", "1. x\n2. y **z**"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    got = {r.doc_id: r.bold for r in rel.uses_bold(kernels.parse_markdown(df)).collect()}
    for i, t in enumerate(texts):
        want = any(b["kind"] in ("heading", "table") or b["kind"] in ("paragraph", "quote") and any(x["bold"] for x in b["runs"]) or b["kind"] == "list" and any(x["bold"] for item in b["items"] for x in item["runs"]) for b in markdown.parse(t))
        assert got[i] == want, t


def test_cells_are_capped_as_by_windows(spark):
    cell = lambda s: {"kind": "string", "s": s, "n": None, "b": None, "formula": None}
    books = [(i, [{"name": f"S{k}", "rows": [[cell(f"{i}{k}{r}{c}") for c in range(3)] for r in range(i % 4)]} for k in range(3)]) for i in range(9)]
    df = spark.createDataFrame(books, "doc_id long, sheets array<struct<name:string,rows:array<array<struct<kind:string,s:string,n:double,b:boolean,formula:string>>>>>")
    made = kernels.render_spreadsheets(df)
    for cap in (1, 4, 9, 18, 100):
        columns = ["doc_id", "sheet_idx", "address", "n", "complete"]
        want = rel.cell_cap(kernels.workbook_cells(made).where("error is null"), cap).select(columns)
        assert sorted(map(tuple, kernels.workbook_cells(made, cap=cap).where("error is null").select(columns).collect())) == sorted(map(tuple, want.collect()))
