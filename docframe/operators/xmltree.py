"""XML as rows: events, intervals and what holds what, as windows over (key, part) in document order.

A part is cut to tokens by one regular expression in the JVM; every event is a
row with its place ``seq``. Depth is a running count that never falls below zero
(closing tags that close nothing are let pass). A closing tag closes the last
element that was opened at its level, so an element is the interval (pre, post)
of the places of its two tags, and all questions on the tree are questions on
intervals: the parent of a node is the last one opened a level above; a node is
inside an element of some name while more of these have begun than ended.

All windows are over one part, which the limits bound; parts of one document are
dealt apart. Nothing here runs in Python.

Defined results: a null part has no events; a tag that never ends ends the part;
comments, declarations and instructions are no events; a part that declares a
DTD, has more elements or is nested deeper than the limits gives one row with an
error and no events; elements that are never closed end with their part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.documents import attribute, decode_entities
from docframe.limits import XML_DEPTH, XML_EVENTS
from docframe.operators.relational import join_lines, normalize_lines

#: Quoted values may hold '>'; all repeats are possessive, so long tags take no stack.
_INNER = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
TOKEN = rf"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<!(?:DOCTYPE|ENTITY)|<{_INNER}>|<.*|[^<]++"
_BAD = "document XML "


def _order(key: list[str], *more: str) -> Window:
    return Window.partitionBy(*key, *more).orderBy("seq")


def _upto(key: list[str], *more: str) -> Window:
    return _order(key, *more).rowsBetween(Window.unboundedPreceding, 0)


def counted(events: DataFrame, name: str, opens: Column, closes: Column, key: list[str]) -> DataFrame:
    """Adds a column: how many are open after each event, by a running sum less its least value so far below zero."""
    t = events.withColumn("_sum", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(_upto(key)))
    return t.withColumn(name, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(_upto(key)))).drop("_sum")


def xml_events(parts: DataFrame, xml: str = "xml", key: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """(key, seq, kind, name, attrs, alone, level, error): ``kind`` is open, close or text (``name`` is the text).

    ``level`` of an element is its depth (the root has 1), of a text that of the element around it, and 0 of a tag that closes nothing.
    """
    key = list(key)
    cut = F.transform(F.regexp_extract_all(F.regexp_replace(xml, "^﻿", ""), F.lit(TOKEN), F.lit(0)), lambda t, i: F.struct(i.alias("seq"), t.alias("token"), F.lit(None).cast("string").alias("error")))
    t = parts.where(F.col(xml).isNotNull()).select(*key, cut.alias("_cut"))
    tag = F.exists("_cut", lambda t: t["token"].rlike(r"^<!(?:DOCTYPE|ENTITY)"))
    elements = F.size(F.filter("_cut", lambda t: t["token"].rlike(r"^<[^!?]")))
    told = lambda why: F.array(F.struct(F.lit(0).alias("seq"), F.lit(None).cast("string").alias("token"), F.lit(_BAD + why).alias("error")))
    # a refused part is one row on the same way as all events: a filter, or a union of the two, would cut the part anew
    rows = t.select(*key, F.inline(F.when(tag, told("may not declare a DTD or entity")).when(elements > XML_EVENTS, told(f"has more than {XML_EVENTS:,} elements")).otherwise(F.col("_cut"))))
    x = F.col("token")
    data = x.startswith("<![CDATA[")
    ended = x.endswith(">")
    aside = ~data & (x.startswith("<!") | x.startswith("<?") | (x.startswith("<") & ~ended))
    closing = x.startswith("</")
    alone = x.startswith("<") & x.endswith("/>") & ~closing
    inner = F.regexp_replace(x, r"(?s)^</?|/?>\z", "")
    kind = F.when(data | ~x.startswith("<"), "text").when(closing, "close").otherwise("open")
    name = F.when(data, F.regexp_replace(x, r"(?s)^<!\[CDATA\[|\]\]>\z", "")).when(~x.startswith("<"), decode_entities(x)).when(closing, F.trim(inner)).otherwise(F.regexp_extract(inner, r"^(\S*)", 1))
    rows = rows.where(F.col("error").isNotNull() | ~aside).select(*key, "error", F.col("seq").cast("long").alias("seq"), F.when(x.isNotNull(), kind).alias("kind"), name.alias("name"), F.when(kind == "open", F.trim(F.regexp_replace(inner, r"(?s)^\S*", ""))).alias("attrs"), F.coalesce(alone, F.lit(False)).alias("alone"))
    rows = counted(rows, "_after", (F.col("kind") == "open") & ~F.col("alone"), F.col("kind") == "close", key)
    before = F.coalesce(F.lag("_after").over(_order(key)), F.lit(0))
    level = F.when(F.col("kind") == "close", before).when(F.col("alone"), F.col("_after") + 1).otherwise(F.col("_after"))
    rows = rows.withColumns({"level": level, "_first": F.row_number().over(_order(key)) == 1}).drop("_after")
    deepest = F.max(F.when((F.col("kind") == "open") & ~F.col("alone"), F.col("level"))).over(Window.partitionBy(*key))
    rows = rows.withColumn("_deep", F.coalesce(deepest > XML_DEPTH, F.lit(False))).where("not _deep or _first")
    error = F.when(F.col("_deep"), F.lit(f"{_BAD}is nested more than {XML_DEPTH} elements deep")).otherwise(F.col("error"))
    return rows.select(*key, *[F.when(error.isNull(), F.col(c)).alias(c) for c in ("seq", "kind", "name", "attrs", "alone", "level")], error.alias("error"))


def intervals(events: DataFrame, key: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """(key, pre, post, level, name, attrs) of every element; its contents have places between ``pre`` and ``post``."""
    key = list(key)
    tags = events.withColumn("_end", F.max("seq").over(Window.partitionBy(*key)) + 1).where(F.col("kind").isin("open", "close"))
    # at one level tags alternate: what follows an opening tag is its closing one
    post = F.when(F.col("alone"), F.col("seq")).otherwise(F.coalesce(F.lead("seq").over(_order(key, "level")), F.col("_end")))
    return tags.withColumn("post", post).where("kind = 'open'").select(*key, F.col("seq").alias("pre"), "post", "level", "name", "attrs")


def parents(events: DataFrame, key: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """(key, seq, kind, name, level, parent, parent_name): the element around every element and text; null at the top."""
    key = list(key)
    nodes = events.where(F.col("kind").isin("open", "text"))
    above = F.when(F.col("kind") == "open", F.col("level") - 1).otherwise(F.col("level"))
    own = F.lit(None).cast("struct<seq:bigint,name:string>")
    ask = nodes.select(*key, above.alias("at"), "seq", "kind", "name", "level", own.alias("own"))
    opened = events.where("kind = 'open' and not alone").select(*key, F.col("level").alias("at"), "seq", F.lit(None).cast("string").alias("kind"), "name", "level", F.struct("seq", "name").alias("own"))
    last = F.last("own", ignorenulls=True).over(_upto(key, "at"))
    found = ask.union(opened).withColumn("_p", F.when(F.col("at") > 0, last)).where("kind is not null")
    return found.select(*key, "seq", "kind", "name", "level", F.col("_p.seq").alias("parent"), F.col("_p.name").alias("parent_name"))


def within(events: DataFrame, column: str, *names: str, key: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """Adds a boolean: is this event inside an element of one of these names? A sweep over interval ends, no join."""
    key = list(key)
    # at one level tags alternate, so the tag before a closing one opened its element
    opened = F.lag("name").over(_order(key, "level", "_tag"))
    t = events.withColumn("_tag", F.col("kind").isin("open", "close")).withColumn("_of", F.when(F.col("kind") == "close", opened))
    opens = (F.col("kind") == "open") & ~F.col("alone") & F.col("name").isin(*names)
    closes = (F.col("kind") == "close") & (F.col("level") > 0) & F.col("_of").isin(*names)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(_upto(key))
    return t.withColumn(column, (depth - F.when(opens, 1).otherwise(0)) > 0).drop("_tag", "_of")


def docx_lines(events: DataFrame, key: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """(key, pos, line): the lines of a document's body from its events.

    Text counts in ``w:t`` only. A paragraph ends a line but for those in a table's
    cell, where rows end it; headings and list items get their sign. An empty rest behind the last end is no line.
    """
    key = list(key)
    kind, name, alone = F.col("kind"), F.col("name"), F.col("alone")
    t = counted(events.where("kind is not null"), "in_text", (kind == "open") & (name == "w:t") & ~alone, (kind == "close") & (name == "w:t"), key)
    t = counted(t, "in_cell", (kind == "open") & (name == "w:tc"), (kind == "close") & (name == "w:tc"), key)
    level = F.regexp_extract(F.coalesce(attribute(F.col("attrs"), "w:val"), F.lit("")), r"^[Hh]eading\s*([1-6])\z", 1)
    piece = (
        F.when((kind == "text") & (F.col("in_text") > 0), name)
        .when((kind == "open") & (name == "w:tab"), "\t")
        .when((kind == "open") & name.isin("w:br", "w:cr"), "\n")
        .when((kind == "close") & (name == "w:tc"), " | ")
        .when((kind == "close") & (name == "w:p") & (F.col("in_cell") > 0), " ")
    )
    lead = F.when((kind == "open") & (name == "w:p"), "").when((kind == "open") & (name == "w:numPr"), "- ").when((kind == "open") & (name == "w:pStyle") & (level != ""), F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" ")))
    ends = (kind == "close") & ((name == "w:tr") | (name == "w:p") & (F.col("in_cell") == 0))
    t = t.withColumns({"piece": piece, "lead": lead, "ends": ends})
    t = t.withColumn("group", F.sum(F.col("ends").cast("int")).over(_upto(key)) - F.col("ends").cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("seq", "piece")))), lambda x: x["piece"]), "")
    lines = t.groupBy(*key, "group").agg(body.alias("body"), F.max_by("lead", F.when(F.col("lead").isNotNull(), F.col("seq"))).alias("lead"), F.max("ends").alias("ended"))
    whole = F.concat(F.coalesce("lead", F.lit("")), F.col("body"))
    # what follows the last end is a line only if it says something
    cut = lines.where(F.col("ended") | (whole != "")).select(*key, "group", F.posexplode(F.split(whole, "\n", -1)).alias("i", "line"))
    return cut.select(*key, F.struct("group", "i").alias("pos"), "line")


def docx_text(events: DataFrame, key: str = "doc_id", volume: str | None = None) -> DataFrame:
    """(key, text) of documents whose events are those of their body alone; a document may come in parts, which ``volume`` puts in order."""
    if volume is None:
        lines = docx_lines(events, (key,))
    else:
        lines = docx_lines(events, (key, volume)).select(key, F.struct(volume, "pos").alias("pos"), "line")
    return join_lines(normalize_lines(lines, key), key)
