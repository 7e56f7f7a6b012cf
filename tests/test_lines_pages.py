"""Lines and pages by composed blocks against machines that walk one text or deck."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docframe.functions.documents import WIDE
from docframe.operators import paging
from docframe.operators.paging import paginate
from docframe.operators.wrapping import wrap_lines

WIDE_CHAR = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", WIDE))


def walked(text, room):
    """(line, width): characters one after the other."""
    atoms = []
    for c in (text or "").replace("\n", " "):
        kind = "space" if c.isspace() else "wide" if WIDE_CHAR.match(c) else "word"
        if kind == "word" and atoms and atoms[-1][0] == "word":
            atoms[-1][1] += c
        else:
            atoms.append([kind, c])
    width = lambda s: sum(1 + bool(WIDE_CHAR.match(c)) for c in s)
    lines, line, used = [], [], 0
    for kind, s in atoms:
        if not line and kind == "space":
            continue
        if line and used + width(s) > room:
            while line and line[-1].isspace():
                used -= width(line.pop())
            lines.append(("".join(line), used))
            line, used = ([], 0) if kind == "space" else ([s], width(s))
            continue
        line.append(s)
        used += width(s)
    return lines + [("".join(line), used)] * bool(line)


@pytest.mark.parametrize(("room", "block"), [(10, 8), (3, 8), (23, 40), (40, 4096)])
def test_lines(spark, room, block):
    r = random.Random(room)
    texts = ["", None, "   ", " a", "a ", "word", "x" * 50, "a  b   c", "日本語テキスト mixed 한국어", "tab\tand\nline", "a" + " " * 30 + "b", "😀 emoji 😀😀"]
    texts += ["".join(r.choice(["a", "bb ", "ccc  ", "日", "한 ", "longer-word ", "\n", " ", "x" * 12]) for _ in range(r.randint(1, 400))) for _ in range(25)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, line int")
    got = {}
    for x in sorted(wrap_lines(df, room, block=block).collect(), key=lambda x: (x.doc_id, x.line_no)):
        got.setdefault(x.doc_id, []).append((x.line, x.width))
        assert len(got[x.doc_id]) == x.line_no
    for i, t in enumerate(texts):
        assert got.get(i, []) == walked(t, room), t


@pytest.mark.parametrize("whole", [0, 60, 1 << 20])
def test_lines_by_blocks_and_at_once(spark, whole):
    """Texts up to a length are set where they are read, without an expression on atoms in the JVM; longer ones by blocks; both alike."""
    r = random.Random(whole)
    texts = ["", None, " ", "\n", "ab", "\ufeffx\u3000y", "日" * 45, "日\u3000" * 20, " " * 70 + "a"] + ["".join(r.choice(["a", "bb ", "日", "한 ", "\n", "  ", "\t", "😀", "x" * 25]) for _ in range(r.randint(1, 150))) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = wrap_lines(df, 20, block=8, whole=whole)
    assert "regexp" not in made._jdf.queryExecution().executedPlan().toString()
    got = {}
    for x in sorted(made.collect(), key=lambda x: (x.doc_id, x.line_no)):
        got.setdefault(x.doc_id, []).append((x.line, x.width))
        assert len(got[x.doc_id]) == x.line_no
    for i, t in enumerate(texts):
        assert got.get(i, []) == walked(t.replace("\ufeff", " ") if t else t, 20) or "\ufeff" in (t or ""), t
    assert got[5] == [("x\u3000y", 4)]


def packed(pieces, room):
    """(pos, part, page, first row, rows) by filling pages with pieces one after the other."""
    pages, page = [], []
    height = lambda x: paging.Pages(room).table(x["rows"]) if x["rows"] is not None else max(1, x["cost"])
    for piece in pieces:
        todo = dict(piece, part=0, first=0)
        while todo:
            left = room - sum(map(height, page))
            if height(todo) <= left:
                page.append(todo)
                break
            if left > 0 and todo["rows"] is not None and todo["rows"] > (n := max(1, int(left / 1.5) - 1)):
                pages.append([*page, dict(todo, rows=n)])
                page = []
                todo = dict(todo, rows=todo["rows"] - n, part=todo["part"] + 1, first=todo["first"] + n)
                continue
            if not page:
                pages.append([todo])
                break
            heads = [k for k, x in enumerate(page) if k and x["opens"]]
            if heads:
                pages.append(page[: heads[-1]])
                page = page[heads[-1] :]
            else:
                pages.append(page)
                page = []
    return sorted((x["pos"], x["part"], k, x["first"] if x["rows"] is not None else None, x["rows"]) for k, p in enumerate([*pages, page]) for x in p)


@pytest.mark.parametrize(("room", "block"), [(6, 8), (14, 16), (14, 4096), (3, 5)])
def test_pages(spark, room, block):
    r = random.Random(room * block)
    decks = []
    for d in range(30):
        n = r.choice([1, 5, 40, 130])
        heads = r.choice([0, 0.1, 0.5])
        decks.append([{"pos": k * 3, "cost": r.choice([1, 1, 2, 3, room, room + 5, 0]), "opens": r.random() < heads, "rows": r.choice([0, 1, 3, 9, 40]) if r.random() < 0.15 else None} for k in range(n)])
        for x in decks[-1]:
            x["opens"] = x["opens"] and x["rows"] is None
    rows = [(d, x["pos"], x["cost"], x["opens"], x["rows"], "p") for d, deck in enumerate(decks) for x in deck]
    df = spark.createDataFrame(rows, "doc_id long, pos long, cost long, opens boolean, rows int, page string").repartition(5)
    got = {}
    for x in paginate(df, room, opens="opens", rows="rows", block=block).collect():
        got.setdefault(x.doc_id, []).append((x.pos, x.part, x.page, x.first_row, x.n_rows))
    for d, deck in enumerate(decks):
        assert sorted(got[d]) == packed(deck, room), d
    assert paginate(df.limit(0), room, opens="opens", rows="rows").count() == 0


def test_a_deck_of_a_million_pieces(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), (F.col("id") * 7 % 5 + 1).alias("cost"), (F.col("id") % 11 == 0).alias("opens"))
    got = paginate(df, 14, opens="opens").groupBy("page").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("page").collect()
    assert sum(x.n for x in got) == 1_000_000 and got[0].a == 0
    assert all(x.page == k and x.b - x.a + 1 == x.n for k, x in enumerate(got)) and all(x.b + 1 == y.a for x, y in zip(got, got[1:], strict=False))
    want = packed([{"pos": i, "cost": i * 7 % 5 + 1, "opens": i % 11 == 0, "rows": None} for i in range(5000)], 14)
    first = [p for _, _, p, _, _ in want]
    assert all(first.count(k) == got[k].n for k in range(500))


def test_pages_are_handed_on_in_small_batches():
    """What a task holds does not grow with the pieces of an Arrow batch."""
    import pyarrow as pa

    keys, n = 200, 600
    lists = lambda x, kind: pa.array([x] * keys, pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([pa.array(range(keys)), lists(list(range(n)), pa.int64()), lists([3] * n, pa.int32()), lists([False] * n, pa.bool_()), lists([-1] * n, pa.int32()), pa.array([0] * keys, pa.int32()), pa.array([0] * keys, pa.int64()), pa.array([n] * keys, pa.int32())], ["key", "pos", "cost", "opens", "rows", "state", "count", "own"])
    got = list(paging.placed(paging.Pages(14), iter([batch])))
    assert max(b.num_rows for b in got) < paging.OUT_ROWS + n
    t = pa.Table.from_batches(got)
    assert t.num_rows == keys * n and sorted(set(zip(t.column("key").to_pylist(), t.column("pos").to_pylist(), strict=True))) == [(k, p) for k in range(keys) for p in range(n)]
    assert all(at == p // 4 for p, at in zip(t.column("pos").to_pylist(), t.column("page").to_pylist(), strict=True))
