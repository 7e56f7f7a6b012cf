"""Regions of lines, contents with page numbers, columns side by side and paths of relationships against plain versions."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from docframe.kernels.markdown import DIRECTIVE, FENCE, MOST_DEPTH
from docframe.kernels.markdown import parse
from docframe.operators import relational as rel
from docframe.operators.contents import contents_pages
from docframe.operators.paging import paginate
from docframe.operators.regions import line_regions
from docframe.operators.xmltree import xml_events


def gathered(lines, depth=0):
    """(depth, fenced, mark) of lines, a region gathered from its first line to its last."""
    out, at = [], 0
    while at < len(lines):
        fence, directive = FENCE.match(lines[at]), DIRECTIVE.match(lines[at])
        if fence:
            end = next((k for k in range(at + 1, len(lines)) if lines[k].lstrip().startswith(fence[1])), None)
            inner = lines[at + 1 : end]
            out += [(depth, True, True)] + [(depth, True, False)] * len(inner) + [(depth, True, True)] * (end is not None)
        elif directive and directive[1] and depth < MOST_DEPTH:
            end = next((k for k in range(at + 1, len(lines)) if (m := DIRECTIVE.match(lines[k])) and not m[1]), None)
            inner = gathered(lines[at + 1 : end], depth + 1)
            # the closing line belongs to what is open where it stands
            out += [(depth + 1, False, True), *inner] + ([None] if end is not None else [])
        else:
            out.append((depth, False, False))
            at += 1
            continue
        at = len(lines) if end is None else end + 1
    return out


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_regions(spark, block):
    r = random.Random(block)
    some = ["text", "", "```", "```python", "~~~", "~~~~~", "````", "   ```", "      ```", ":::", "::: note", ":::x", "::: Bad", "``", "a ``` b", ":::  "]
    texts = ["", "one", None, "```\nnever closed", ":::a\n:::b\n```\n:::\nout", "\n".join([":::a"] * 7 + [":::"]), "```\r\nx\r```"]
    texts += ["\n".join(r.choice(some) if r.random() < 0.6 else "line" for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, mark boolean")
    got = {}
    for x in sorted(line_regions(df, block=block).collect(), key=lambda x: (x.doc_id, x.pos)):
        assert x.pos == len(got.setdefault(x.doc_id, []))
        got[x.doc_id].append((x.line, (x.depth, x.fenced, x.mark)))
    assert 2 not in got
    for i, t in enumerate(texts):
        if t is not None:
            lines = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            want = gathered(lines)
            assert [x for x, _ in got[i]] == lines
            for (line, found), w in zip(got[i], want, strict=True):
                assert found == w if w else found[2] and found[0] > 0, (t, line)


def test_code_of_regions_is_code_of_blocks(spark):
    text = "# T\n```sql\nselect 1\n:::\n```\n::: cards\n### a\n~~~\ncode in\n~~~\n:::\nend\n````\n```\nlast"
    rows = sorted(line_regions(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect(), key=lambda x: x.pos)
    runs, open_ = [], False
    for x in rows:
        if x.fenced and not x.mark:
            runs[-1] += [x.line]
        elif x.fenced and x.mark and not open_:
            runs.append([])
        open_ = x.fenced and (not x.mark or not open_)
    assert ["\n".join(x) for x in runs] == [b["text"] for b in parse(text) if b["kind"] == "code"]


def test_contents_settle(spark):
    """Page numbers of two digits make entries longer, contents a page longer, and move headings."""
    deck = [(1, k, 10, 1, f"chapter {k:02d}" if k else None) for k in range(11)] + [(2, 0, 3, 2, "x"), (3, 5, 14, 1, "long title " * 5)]
    df = spark.createDataFrame(deck, "doc_id int, pos long, cost int, level int, text string")
    heads = df.join(paginate(df, 14).select("doc_id", "pos", F.col("page").alias("body_page")), ["doc_id", "pos"])

    def settled(rows, room, width):
        n = 1
        while True:
            page, used, at = 0, 0, []
            for _, _, _, level, text, body in rows:
                cost = -(-((level - 1) * 2 + len(text or "") + 1 + len(str(body + n + 2))) // width)
                page, used = (page + 1, cost) if used and used + cost > room else (page, used + cost)
                at.append((body + n + 2, page + 2))
            if page + 1 <= n:
                return [(p, c, n) for p, c in at]
            n = page + 1

    for room, width in ((11, 12), (12, 12), (4, 12), (5, 40)):
        got = {}
        for x in sorted(contents_pages(heads, room, width).collect(), key=lambda x: (x.doc_id, x.pos)):
            got.setdefault(x.doc_id, []).append((x.page, x.contents_page, x.contents_pages))
        for d in (1, 2, 3):
            rows = [(*r, k) for k, r in enumerate(r for r in deck if r[0] == d)]
            assert got[d] == settled(rows, room, width), (room, width, d)
    one = {x.doc_id: x.contents_pages for x in contents_pages(heads, 11, 12).collect()}
    assert one[1] == 2  # eleven entries would fit one page, were no number of two digits
    assert contents_pages(heads.limit(0), 4, 12).count() == 0


def test_columns_side_by_side(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], ["y", None]), (3, None, []), (4, ["c"], None)], "doc_id int, l array<string>, r array<string>")
    got = sorted(map(tuple, rel.columns_joined(df, "l", "r").collect()))
    assert got == [(1, 0, "a", "x"), (1, 1, "b", ""), (2, 0, "", "y"), (2, 1, "", ""), (4, 0, "c", "")]


def test_paths(spark):
    cases = [("word/", "media/a.png"), ("word/", "../x.xml"), ("word/", "/word/./b//c.xml"), ("", "word/document.xml"), ("a/b/", "../../../c"), ("a/", ""), ("a/b/", "../c/../d/."), ("a/", "/")]
    got = spark.createDataFrame(cases, "b string, t string").select(rel.resolved_path(F.col("b"), F.col("t"))).collect()
    assert [r[0] for r in got] == [posixpath.normpath("/" + (t if t.startswith("/") else b + t)).strip("/") for b, t in cases]
    xml = '<Relationships><Relationship Id="1" Target="../m/x &amp; y"/><r:Relationship Target="http://a/../b" TargetMode="External" Id="2"></r:Relationship><Relationship Id="3"/></Relationships>'
    events = xml_events(spark.createDataFrame([(7, "word/_rels/document.xml.rels", xml)], "doc_id int, part string, xml string"))
    assert sorted((r.id, r.target, r.external) for r in rel.relationships(events).collect()) == [("1", "m/x &amp; y", False), ("2", "http://a/../b", True), ("3", "word", False)]
