"""XML as rows against the scanner that walks one document."""

import random

import pytest
from pyspark.sql import functions as F

from docframe.functions.documents import decode_entities
from docframe.kernels.errors import Refused
from docframe.kernels.flow import DOCX, lines_of
from docframe.kernels.lines import normalize
from docframe.kernels.xmlscan import decode
from docframe.kernels.xmlscan import events as walked
from docframe.operators import xmltree as xt


def made(seed, depth=0):
    r = random.Random(seed)

    def some(d):
        out = ""
        for _ in range(r.randint(1, 4)):
            k = r.random()
            if d > 5 or k < 0.3:
                out += r.choice(["text ", "a &amp; b", "&#65;&#x42;", "\n", "<!-- no <b> -->", "<![CDATA[<raw> & ]]>", "<?pi x='>'?>", "<e/>", "<w:tab />", "", "</stray>" if r.random() < 0.3 else ""])
            else:
                n = r.choice(["a", "b", "w:t", "w:p", "w:del", "w:tc", "w:tr"])
                out += f'<{n} x="1>2" y=\'"\'>' + some(d + 1) + ("" if r.random() < 0.05 else f"</{n}>")
        return out

    return "﻿<?xml version='1.0'?>" * (seed % 2) + "<root>" + some(depth) + "</root>" + ("<cut off" if seed % 7 == 0 else "")


ODD = ["", "plain", "<a", "</a>", "<a></a></a><b>x</b>", "<a><b>unclosed", "< a>x</ a >", "<a x='>'>&lt;</a>", "<![CDATA[open", "<!-- open", "<a/><a/>", "&", "<p><p/></p>", "<a>" * 256 + "x" + "</a>" * 256]


def plain(xml):
    """(kind, name, level) of all events, the parent and whether inside a ``w:del``, by a stack."""
    out, stack = [], []
    for kind, name, _, alone in walked(xml.removeprefix("﻿")):
        if kind == "close":
            out.append(("close", name, len(stack), None, None))
            del stack[-1:]
            continue
        level = len(stack) + (kind == "open")
        out.append((kind, name, level, stack[-1] if stack else None, "w:del" in stack))
        if kind == "open" and not alone:
            stack.append(name)
    return out


def test_events_parents_and_nesting(spark):
    texts = ODD + [made(i) for i in range(60)]
    df = spark.createDataFrame([(i, "p", x) for i, x in enumerate(texts)] + [(900, "p", None)], "doc_id int, part string, xml string")
    e = xt.within(xt.xml_events(df), "deleted", "w:del").cache()
    parent = {(r.doc_id, r.seq): (r.parent_name, r.parent) for r in xt.parents(e).collect()}
    got = {}
    for r in sorted(e.collect(), key=lambda r: (r.doc_id, r.seq)):
        assert r.error is None
        around = parent[r.doc_id, r.seq][0] if r.kind != "close" else None
        got.setdefault(r.doc_id, []).append((r.kind, r.name, r.level, around, r.deleted if r.kind != "close" else None))
    for i, x in enumerate(texts):
        assert got.get(i, []) == plain(x), x
    inside = {}
    for r in xt.intervals(e).collect():
        inside.setdefault(r.doc_id, []).append(r)
        assert r.pre <= r.post
    # a parent is the narrowest interval around a node
    for (doc, seq), (_, up) in parent.items():
        around = [r.pre for r in inside.get(doc, ()) if r.pre < seq < r.post]
        assert up == (max(around) if around else None)


def test_refused_parts(spark):
    bad = ["<!DOCTYPE x><a/>", "<a><!ENTITY b 'c'></a>", "<a>" * 257]
    df = spark.createDataFrame([(i, "p", x) for i, x in enumerate(bad)], "doc_id int, part string, xml string")
    rows = xt.xml_events(df).collect()
    assert len(rows) == 3
    for r in rows:
        with pytest.raises(Refused) as e:
            list(walked(bad[r.doc_id]))
        assert (r.error, r.kind) == (e.value.message, None)


def test_entities(spark):
    texts = ["&amp;lt; &#38;lt; &#x26;amp; &LT; &unknown; &#xD800;&#1114112;&#0065;&#x1F600; &#99999999999999999999; &#x000000000041; &# &#x; && &nbsp;", "none", "", "&#38;#65;", "&#x26;#65;", "é&#233;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(decode_entities(F.col("t"))).collect()
    assert [r[0] for r in got] == [decode(t) for t in texts]


def test_text_of_documents(spark):
    p = lambda inner, style="": f"<w:p>{style and f'<w:pPr>{style}</w:pPr>'}{inner}</w:p>"
    run = lambda t: f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>'
    cell = lambda *x: "<w:tc>" + "".join(x) + "</w:tc>"
    bodies = [
        p(run("Title"), '<w:pStyle w:val="Heading1"/>') + p(run("one") + "<w:r><w:tab/></w:r>" + run("two &amp; three")),
        p(run("item"), '<w:numPr><w:ilvl w:val="0"/></w:numPr>') + p("") + p("") + p(run("a") + "<w:r><w:br/></w:r>" + run("b")),
        "<w:tbl><w:tr>" + cell(p(run("x")), p(run("y"))) + cell(p("")) + "</w:tr><w:tr>" + cell(p(run("z"))) + "<w:tc/></w:tr></w:tbl>" + p(run("after")),
        p('<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins>' + run("new") + "</w:ins>"),
        p("<w:r><w:t/></w:r>loose" + run("  spaced   out  ")),
        "",
    ]
    docs = [f"<w:document><w:body>{b}</w:body></w:document>" for b in bodies] + [made(i) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, xml string")
    got = {r.doc_id: r.text for r in xt.docx_text(xt.xml_events(df, key=("doc_id",))).collect()}
    for i, x in enumerate(docs):
        assert got.get(i, "") == normalize(lines_of(x.removeprefix("﻿"), DOCX)[0]), x
    plan = xt.docx_text(xt.xml_events(df, key=("doc_id",)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents_in_volumes_have_the_text_of_one(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    whole = ["", "a", "", "", "b", "c", "", "", "d", "", "", *map(str, range(12)), ""]
    cut = [(0, 4), (4, 7), (7, 8), *((i, i + 1) for i in range(8, len(whole)))]
    of = lambda lines: "<w:document><w:body>" + "".join(map(p, lines)) + "</w:body></w:document>"
    df = spark.createDataFrame([(1, v, of(whole[a:b])) for v, (a, b) in enumerate(cut)] + [(2, 0, of(["x"]))], "doc_id int, volume int, xml string")
    got = {r.doc_id: r.text for r in xt.docx_text(xt.xml_events(df, key=("doc_id", "volume")), volume="volume").collect()}
    assert got == {1: normalize(lines_of(of(whole), DOCX)[0]), 2: "x"}


def test_nations_beyond_the_limits_of_a_part_are_read_whole(spark, tmp_path, monkeypatch):
    """1,000 customers of a nation have some 16,000 tags, and a part may have 5,000 here."""
    import duckdb

    import __spark_entry__ as entry
    from docframe import queries_text

    monkeypatch.setattr(xt, "XML_EVENTS", 5_000)
    monkeypatch.setattr(queries_text, "VOLUME_ROWS", 150, raising=False)
    db = duckdb.connect()
    db.execute("create table customer as select i::bigint as c_custkey, 'Customer#' || i as c_name, case when i < 1000 then 3 else 4 end as c_nationkey, 0.0::double as c_acctbal, 'SEG' || i % 5 as c_mktsegment from range(1010) t(i)")
    db.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    for name in ("docx_tree", "xml_parents"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = db.execute(entry.oracle_sql()[name]).fetchall()
        assert sorted(map(tuple, got.select(*[d[0] for d in db.description]).collect())) == sorted(want)
