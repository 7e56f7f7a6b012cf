"""Registered queries of sources and sinks, trees, lines and pages, each over whole tables, with DuckDB SQL beside it."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.checkpoints import shared_folder
from docframe.functions.documents import BLANK, WIDE
from docframe.operators import kernels
from docframe.operators import relational as rel
from docframe.operators import xmltree as xt
from docframe.operators.paging import paginate
from docframe.operators.wrapping import wrap_lines
from docframe.queries import ORACLES, _ordered_lines, _query, _t
from docframe.sources import files, packages, sink

#: Members of fewer bytes are not asked for.
LEAST_BYTES = 200
#: Customers of a volume of a nation's document: some 65,000 tags and a megabyte, far within the limits of a part.
VOLUME_ROWS = 4_000
#: Customers whose event rows (some 36 each) a task takes.
EVENT_ROWS = 10_000
#: Items of a list that a table function takes in a call.
RUN_ITEMS = 1_024


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{spark.sparkContext.applicationId}_{uuid4().hex}"


def _joined(value: Column, order: str, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v")))), lambda x: x["v"]), sep)


def _written(df: DataFrame, name: str) -> str:
    """(filename, content) through the sink; the folder."""
    to = _folder(df.sparkSession, name)
    sink.write_documents(df, to)
    return to


@_query("""
select c_nationkey::bigint as doc_id, strlen(string_agg(c_name || ' ' || c_mktsegment, chr(10) order by c_custkey))::bigint as length, md5(string_agg(c_name || ' ' || c_mktsegment, chr(10) order by c_custkey)) as digest
from customer group by c_nationkey""")
def document_files(spark, sf_dir):
    """Documents written as files by the committing sink, and read as files."""
    made = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(_joined(F.concat_ws(" ", "c_name", "c_mktsegment"), "c_custkey").alias("text"))
    to = _written(made.select(F.concat(F.lit("nation"), "c_nationkey", F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content")), "files")
    return files.documents(spark, to, "*.txt").select(F.regexp_extract("filename", r"(\d+)", 1).cast("long").alias("doc_id"), "length", F.md5("content").alias("digest"))


@_query(f"""
select c_nationkey::bigint as doc_id, 'segments/' || c_mktsegment || '.txt' as name, strlen(string_agg(c_name, chr(10) order by c_custkey))::bigint as original_size, md5(string_agg(c_name, chr(10) order by c_custkey)) as digest
from customer group by c_nationkey, c_mktsegment having strlen(string_agg(c_name, chr(10) order by c_custkey)) >= {LEAST_BYTES}""")
def package_members(spark, sf_dir):
    """Packages written by the sink; of their members only those of some folder and size are inflated."""
    parts = _t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(_joined(F.col("c_name"), "c_custkey").alias("body"))
    one = F.struct(F.concat(F.lit("segments/"), "c_mktsegment", F.lit(".txt")).alias("name"), "body")
    rest = F.array(F.struct(F.lit("mimetype").alias("name"), F.lit("text/plain").alias("body")), F.struct(F.lit("notes/long.txt").alias("name"), F.repeat(F.lit("not asked for "), 1000).alias("body")))
    books = parts.groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.concat(rest, F.array_sort(F.collect_list(one))).alias("parts"))
    made = kernels.build_packages(books)
    to = _written(made.select(F.concat(F.lit("nation"), "doc_id", F.lit(".zip")).alias("filename"), "content"), "packages")
    got = packages.members(spark, to, contents=True, where=[("name", "startswith", "segments/"), ("original_size", ">=", LEAST_BYTES)])
    return got.select(F.regexp_extract("file", r"nation(\d+)\.zip\z", 1).cast("long").alias("doc_id"), "name", "original_size", F.md5("content").alias("digest"))


def _run(text: Column) -> Column:
    return F.concat(F.lit('<w:r><w:t xml:space="preserve">'), text, F.lit("</w:t></w:r>"))


def _customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCX packages of a nation: a heading, and for each customer a line with a tab and a deletion, a list item, or a row of a table.

    A nation has as many volumes as its customers need, so no part meets the limits, however large the table is.
    """
    c = _t(spark, sf_dir, "customer")
    name, seg, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 3
    gone = F.concat(F.lit("<w:del><w:r><w:delText>was "), name, F.lit("</w:delText></w:r></w:del>"))
    cell = lambda x: F.concat(F.lit("<w:tc><w:p>"), _run(x), F.lit("</w:p></w:tc>"))
    line = (
        F.when(k == 0, F.concat(F.lit("<w:p>"), _run(name), F.lit("<w:r><w:tab/></w:r>"), _run(F.concat(F.lit("R&amp;D &#x2013; "), seg)), gone, F.lit("</w:p>")))
        .when(k == 1, F.concat(F.lit("<w:p><w:pPr><w:numPr><w:ilvl w:val='0'/></w:numPr></w:pPr>"), _run(F.concat(F.lit("<![CDATA[<"), name, F.lit(">]]>"))), F.lit("<!-- <w:t>no</w:t> --></w:p>")))
        .otherwise(F.concat(F.lit("<w:tbl><w:tr>"), cell(name), cell(seg), F.lit("</w:tr></w:tbl>")))
    )
    lines = c.select(F.col("c_nationkey").cast("long").alias("doc_id"), "c_custkey", line.alias("line"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("c_custkey", "line")) - 1
    body = lines.withColumn("volume", F.floor(at / VOLUME_ROWS).cast("int")).groupBy("doc_id", "volume").agg(_joined(F.col("line"), "c_custkey", "").alias("body"))
    head = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'), _run(F.concat(F.lit("Nation "), "doc_id")), F.lit("</w:p>"))
    xml = F.concat(F.lit("<?xml version='1.0'?><w:document><w:body>"), F.when(F.col("volume") == 0, head).otherwise(""), "body", F.lit("</w:body></w:document>"))
    part = lambda n, b: F.struct(F.lit(n).alias("name"), b.alias("body"))
    return body.select("doc_id", "volume", F.array(part("[Content_Types].xml", F.lit("<Types/>")), part("word/document.xml", xml)).alias("parts"))


def _customer_events(spark: SparkSession, sf_dir: str, parts: DataFrame) -> DataFrame:
    """Events of (doc_id, volume, xml): volumes are dealt before they are cut, so no event row is shuffled for the windows on it."""
    key = ("doc_id", "volume")
    return xt.xml_events(rel.dealt(parts, _t(spark, sf_dir, "customer").count(), *key, each=EVENT_ROWS), key=key)


@_query("""
with c as (select c_nationkey::bigint as doc_id, c_custkey, c_custkey % 3 as k, c_name, c_mktsegment as seg from customer)
select doc_id, '## Nation ' || doc_id || chr(10) || string_agg(case k when 0 then c_name || chr(9) || 'R&D – ' || seg when 1 then '- <' || c_name || '>' else c_name || ' | ' || seg end, chr(10) order by c_custkey) as text,
 sum(case k when 0 then length('was ' || c_name) else 0 end)::bigint as deleted, 1 + sum(case k when 2 then 2 else 1 end)::bigint as paragraphs, max(case k when 2 then 8 when 0 then 6 else 6 end)::bigint as deepest
from c group by doc_id""")
def docx_tree(spark, sf_dir):
    """DOCX text from event rows, with what is deleted, its paragraphs and its depth; no Python after the scan."""
    made = kernels.build_packages(_customer_documents(spark, sf_dir).select((F.shiftleft("doc_id", 32) + F.col("volume")).alias("doc_id"), "parts"))
    doc, volume = F.shiftright("doc_id", 32), F.col("doc_id").bitwiseAND(F.lit((1 << 32) - 1))
    to = _written(made.select(F.concat(F.lit("nation"), doc, F.lit("-"), volume, F.lit(".docx")).alias("filename"), "content"), "docx")
    body = packages.members(spark, to, contents=True, where=[("name", "=", "word/document.xml")])
    of = lambda n: F.regexp_extract("file", r"nation(\d+)-(\d+)\.docx\z", n)
    parts = body.select(of(1).cast("long").alias("doc_id"), of(2).cast("int").alias("volume"), F.decode("content", "UTF-8").alias("xml"))
    events = _customer_events(spark, sf_dir, parts)
    inside = xt.within(events, "deleted", "w:del", key=("doc_id", "volume"))
    opens = F.col("kind") == "open"
    found = inside.groupBy("doc_id").agg(
        F.sum(F.when((F.col("kind") == "text") & F.col("deleted"), F.length("name")).otherwise(0)).alias("deleted"),
        F.count_if(opens & (F.col("name") == "w:p")).alias("paragraphs"),
        F.max(F.when(opens, F.col("level"))).cast("long").alias("deepest"),
    )
    return xt.docx_text(events, volume="volume").join(found, "doc_id")


@_query("""
with c as (select c_nationkey::bigint as doc_id, c_custkey % 3 as k, count(*)::bigint as n from customer group by 1, 2),
p as (select doc_id, 'w:p' as name, 'w:body' as parent_name, sum(case k when 2 then 0 else n end) + 1 as n from c group by doc_id union all select doc_id, 'w:p', 'w:tc', 2 * n from c where k = 2 union all select doc_id, 'w:r', 'w:p', 1 + sum(case k when 0 then 3 * n when 1 then n else 2 * n end) from c group by doc_id union all select doc_id, 'w:r', 'w:del', n from c where k = 0 union all select doc_id, 'w:del', 'w:p', n from c where k = 0)
select doc_id, name, parent_name, n::bigint as n from p""")
def xml_parents(spark, sf_dir):
    """How often elements stand right below which others, by the interval encoding."""
    parts = _customer_documents(spark, sf_dir).select("doc_id", "volume", F.col("parts")[1]["body"].alias("xml"))
    p = xt.parents(_customer_events(spark, sf_dir, parts), ("doc_id", "volume"))
    return p.where("kind = 'open' and name in ('w:p', 'w:r', 'w:del')").groupBy("doc_id", "name", "parent_name").agg(F.count("*").alias("n"))


@_query("""
with c as (select c_nationkey::bigint as doc_id, c_custkey % 6 as k, count(*) as n from customer group by 1, 2)
select doc_id, sum(case when k in (3, 4) then n else 0 end)::bigint as dangling, sum(case when k = 5 then n else 0 end)::bigint as external, sum(n)::bigint + 1 as relationships from c group by doc_id""")
def package_links(spark, sf_dir):
    """Where a package's relationships lead: to parts of it by various ways, to none, or out of it."""
    k, name = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    target = F.when(k == 0, "document.xml").when(k == 1, "/word/../word/./document.xml").when(k == 2, "../../docProps//app.xml").when(k == 3, F.concat(F.lit("media/"), name, F.lit(".png"))).when(k == 4, "../document.xml").otherwise(F.concat(F.lit("https://example.net/"), name))
    link = F.concat(F.lit('<Relationship Id="r'), name, F.lit('" Type="t" Target="'), target, F.lit('"'), F.when(k == 5, ' TargetMode="External"').otherwise(""), F.lit("/>"))
    body = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.concat(F.lit("<Relationships>"), _joined(link, "c_custkey", ""), F.lit("</Relationships>")).alias("rels"))
    part = lambda n, b: F.struct(F.lit(n).alias("name"), (b if isinstance(b, Column) else F.lit(b)).alias("body"))
    made = kernels.build_packages(body.select("doc_id", F.array(part("_rels/.rels", '<Relationships><Relationship Id="r" Target="word/document.xml"/></Relationships>'), part("word/document.xml", "<w:document/>"), part("docProps/app.xml", "<p/>"), part("word/_rels/document.xml.rels", F.col("rels"))).alias("parts")))
    to = _written(made.select(F.concat(F.lit("nation"), "doc_id", F.lit(".docx")).alias("filename"), "content"), "links")
    of = F.regexp_extract("file", r"nation(\d+)\.docx\z", 1).cast("long").alias("doc_id")
    rels = packages.members(spark, to, contents=True, where=[("name", "endswith", ".rels")]).select(of, F.col("name").alias("part"), F.decode("content", "UTF-8").alias("xml"))
    found = rel.relationships(xt.xml_events(rels))
    parts = packages.members(spark, to).select(of, F.col("name").alias("target"), F.lit(True).alias("there"))
    met = found.join(parts, ["doc_id", "target"], "left")
    return met.groupBy("doc_id").agg(F.count_if(~F.col("external") & F.col("there").isNull()).alias("dangling"), F.count_if("external").alias("external"), F.count("*").alias("relationships"))


def _class(pattern: str) -> str:
    return pattern.replace("\n", "\\n").replace("\t", "\\t").replace("\f", "\\f").replace("\r", "\\r")


_B, _W = _class(BLANK)[1:-1], _class(WIDE)[1:-1]


@_query(f"""
with recursive u as (select doc_id, unnest(a) as atom, generate_subscripts(a, 1) - 1 as i from (select doc_id, regexp_extract_all(replace(text, chr(10), ' '), '[{_B}]+|[{_W}]|[^{_B}{_W}]+') as a from documents where length(text) > 0)),
w as materialized (select doc_id, i, atom, length(atom) + length(regexp_replace(atom, '[^{_W}]', '', 'g')) as width, regexp_matches(atom, '^[{_B}]') as space from u),
s as materialized (select *, sum(width) over (partition by doc_id order by i) - width as begin, count(*) over (partition by doc_id) as n from w),
x as (select doc_id, i, begin from s union all select doc_id, count(*), sum(width) from w group by doc_id),
e as materialized (select s.doc_id, s.i, s.n, greatest(x.i, s.i + 1) as stop from s asof join x on s.doc_id = x.doc_id and s.begin + 80 >= x.begin),
g as materialized (select e.*, stop + coalesce(s.space::int, 0) as next, stop - (stop < e.n and stop - 1 > e.i and b.space)::int as last from e left join s on s.doc_id = e.doc_id and s.i = stop join s b on b.doc_id = e.doc_id and b.i = stop - 1),
l as (select doc_id, space::int as i, 1 as line_no from s where i = 0 union all select l.doc_id, g.next, line_no + 1 from l join g on g.doc_id = l.doc_id and g.i = l.i where g.next < g.n),
r as (select g.doc_id, line_no, g.i, g.last from l join g using (doc_id, i))
select s.doc_id, line_no::bigint as line_no, string_agg(atom, '' order by s.i) as line, sum(width)::bigint as width from s asof join r on s.doc_id = r.doc_id and s.i >= r.i where s.i < r.last group by s.doc_id, line_no""")
def wrapped_lines(spark, sf_dir):
    """All texts in lines of 80 half widths."""
    return wrap_lines(_t(spark, sf_dir, "documents"), 80)


_TURN = "case when p.rows is null then p.cost else ceil((p.rows - f.first + 1) * 1.5)::int end"


@_query(f"""
with recursive p as materialized (select *, case when r % 10 <> 3 and r % 7 = 0 then true else false end as opens, case when r % 10 = 3 then q % 12 end as rows from (
  select l_suppkey::bigint as doc_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as k, l_partkey as r, l_quantity::int as q, l_quantity::int % 4 + 1 as cost from lineitem)),
f as (
 select distinct doc_id, 0::bigint as k, 0 as part, 0 as first, 0 as used, 0 as tail, -1::bigint as head, 0 as page, 'start' as act, 0::bigint as ak, 0 as apart, 0 as afirst, null::int as an, 0 as apage from p
 union all
 select doc_id, case when act in ('put', 'alone') then k + 1 else k end, case when act = 'cut' then part + 1 when act in ('put', 'alone') then 0 else part end, case when act = 'cut' then first + fits when act in ('put', 'alone') then 0 else first end,
  case act when 'put' then used + need when 'move' then tail else 0 end, case when act <> 'put' then 0 when opens and used > 0 then need when tail > 0 then tail + need else 0 end, case when act <> 'put' then -1 when opens and used > 0 then k else head end,
  case when act = 'put' then page else page + 1 end, act, case act when 'move' then head else k end, part, case when act = 'move' then k::int else first end, case act when 'cut' then fits else rows - first end, page
 from (select *, case when need <= 14 - used then 'put' when used < 14 and rows - first > fits then 'cut' when used = 0 then 'alone' when tail > 0 then 'move' else 'end' end as act from (
  select f.doc_id, f.k, f.part, f.first, f.used, f.tail, f.head, f.page, p.opens, p.rows, {_TURN} as need, greatest(1, floor((14 - f.used) / 1.5)::int - 1) as fits from f join p using (doc_id, k)))),
m as (select doc_id, ak as head, afirst as before from f where act = 'move')
select f.doc_id, ak as pos, apart as part, apage + (m.head is not null)::int as page, case when an is not null then afirst end as first_row, an as n_rows
from f left join m on m.doc_id = f.doc_id and ak >= m.head and ak < m.before where act in ('put', 'alone', 'cut')""")
def deck_pages(spark, sf_dir):
    """Long decks of pieces, sub-headings and tables on slides: tables cut with their heads repeated, sub-headings carried along."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")) - 1
    q, table = F.col("l_quantity").cast("int"), F.col("l_partkey") % 10 == 3
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("doc_id"), pos.alias("pos"), (q % 4 + 1).alias("cost"), (~table & (F.col("l_partkey") % 7 == 0)).alias("opens"), F.when(table, q % 12).alias("rows"))
    return paginate(p, 14, opens="opens", rows="rows")


def _contents_round(k: int) -> str:
    """Entries of round k set on pages of 12 lines, one after the other."""
    return f"""
e{k} as materialized (select doc_id, pos, text, j, greatest(1, ceil((length(text) + 1 + length((bp + 2 + n)::varchar)) / 24.0))::int as cost, bp + 2 + n as page from h join n{k} using (doc_id)),
q{k} as (select doc_id, 1::bigint as j, 0 as cp, cost as used from e{k} where j = 1 union all
 select e.doc_id, e.j, case when q.used + e.cost > 12 then q.cp + 1 else q.cp end, case when q.used + e.cost > 12 then e.cost else q.used + e.cost end from q{k} q join e{k} e on e.doc_id = q.doc_id and e.j = q.j + 1),
n{k + 1} as materialized (select doc_id, greatest(max(cp) + 1, any_value(n))::int as n from q{k} join n{k} using (doc_id) group by doc_id)"""


@_query(f"""
with recursive p as materialized (select l_suppkey::bigint as doc_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as k, l_quantity::int % 4 + 1 as cost, l_partkey from lineitem),
f as (select doc_id, k, 0 as page, cost as used from p where k = 0 union all
 select p.doc_id, p.k, case when f.used + p.cost > 14 then f.page + 1 else f.page end, case when f.used + p.cost > 14 then p.cost else f.used + p.cost end from f join p on p.doc_id = f.doc_id and p.k = f.k + 1),
h as materialized (select doc_id, k as pos, 'Chapter on part no. ' || l_partkey as text, page as bp, row_number() over (partition by doc_id order by k) as j from f join p using (doc_id, k) where l_partkey % 5 = 0),
n0 as (select distinct doc_id, 1 as n from h),{",".join(_contents_round(k) for k in range(5))}
select e.doc_id, e.pos, e.text, e.page::int as page, (q.cp + 2)::int as contents_page, n.n::int as contents_pages from e4 e join q4 q using (doc_id, j) join n5 n using (doc_id)""")
def contents_with_pages(spark, sf_dir):
    """Headings of long documents with the pages they stand on, behind contents whose length depends on these numbers."""
    from pyspark.sql import Window

    from docframe.operators.contents import contents_pages

    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")) - 1
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("doc_id"), pos.cast("long").alias("pos"), (F.col("l_quantity").cast("int") % 4 + 1).alias("cost"), "l_partkey")
    on = paginate(p, 14).select("doc_id", "pos", F.col("page").alias("body_page"))
    heads = p.where("l_partkey % 5 = 0").select("doc_id", "pos", F.lit(1).alias("level"), F.concat(F.lit("Chapter on part no. "), "l_partkey").alias("text"))
    return contents_pages(heads.join(on, ["doc_id", "pos"]), 12, 24).drop("level")


_MARKED = """(select c_nationkey::bigint as doc_id, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos,
 case when c_custkey % 11 = 0 then '```sql' when c_custkey % 11 = 4 then '~~~~' when c_custkey % 11 = 7 then '````' when c_custkey % 11 = 9 then '     ~~~~~' when c_custkey % 13 = 3 then '::: note' when c_custkey % 13 = 9 then ':::' else c_name end as line from customer)"""


@_query(f"""
with recursive l as materialized (select *, regexp_extract(line, '^ *(`{{3,}}|~{{3,}})', 1) as run, line like '   %' as far from {_MARKED}),
f as (select doc_id, 0::bigint as ix, 0 as d, '' as m, 0 as bd, '' as bm, false as mark from l where pos = 0 union all
 select doc_id, ix + 1, nd, nm, d, m, nd <> d or nm <> m from (select *,
  case when line = ':::' and d > 0 then 0 when line = '::: note' and m = '' and d < 4 then d + 1 else d end as nd,
  case when line = ':::' and d > 0 then '' when run <> '' and m <> '' and starts_with(run, m) then '' when run <> '' and m = '' and not far then run else m end as nm
  from (select f.doc_id, f.ix, f.d, f.m, l.line, l.run, l.far from f join l on l.doc_id = f.doc_id and l.pos = f.ix)))
select l.doc_id, l.pos::bigint as pos, l.line, case when mark then greatest(d, bd) else d end as depth, case when mark and (d < bd or d = bd and m = '') then bm <> '' else m <> '' end as fenced, mark from f join l on l.doc_id = f.doc_id and l.pos = f.ix - 1""")
def line_regions(spark, sf_dir):
    """Where each line of texts with fences and directives lies: nested, mixed, never closed."""
    from docframe.operators.regions import line_regions as regions

    k, t = F.col("c_custkey"), F.when
    line = t(k % 11 == 0, "```sql").when(k % 11 == 4, "~~~~").when(k % 11 == 7, "````").when(k % 11 == 9, "     ~~~~~").when(k % 13 == 3, "::: note").when(k % 13 == 9, ":::").otherwise(F.col("c_name"))
    texts = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(_joined(line, "c_custkey").alias("text"))
    return regions(texts)


def _in_sql(spark: SparkSession, table: DataFrame, call: str) -> DataFrame:
    """A table function called in SQL text on a DataFrame."""
    from docframe.functions import tables

    tables.register(spark)
    return spark.sql(f"select * from {call}".replace("$", "table({t})"), t=table)


@_query(ORACLES["pack_slides"])
def sql_pack_pages(spark, sf_dir):
    """``pack_slides`` by a table function of SQL."""
    p = _ordered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_quantity").cast("int") % 9 + 1).cast("long").alias("cost"))
    return _in_sql(spark, p, "pack_pages($, 14)").drop("cost")


@_query(ORACLES["list_numbering"])
def sql_list_numbers(spark, sf_dir):
    """``list_numbering`` by a table function of SQL, which is given a list's items in runs."""
    items = _ordered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity").cast("int") % 5).alias("depth"))
    runs = items.groupBy("list_id", F.floor(F.col("pos") / RUN_ITEMS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "depth"))).alias("i"))
    runs = runs.select("list_id", F.col("i.pos")[0].alias("pos"), F.col("i.pos").alias("places"), F.col("i.depth").alias("depth"))
    return _in_sql(spark, runs, "list_numbers($)").select("list_id", F.inline(F.arrays_zip("places", "depth", "number"))).withColumnRenamed("places", "pos")


@_query(ORACLES["row_budget"])
def sql_row_budget(spark, sf_dir):
    """``row_budget`` by a table function of SQL."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("pos"), F.concat_ws(" | ", "c_name", "c_mktsegment").alias("line"))
    return _in_sql(spark, c, "row_budget($, 500)")


@_query("""
with e as (select user_id, event_type || '/' || (event_id % 20) as title, ts, case when event_id % 40 = 0 then 2 else ntile(3) over (order by ts, event_id) - 1 end as arrival from events),
w as (select k, (select max(ts) - interval 6 hour from e where arrival < k) as mark from range(4) r(k)),
g as (select user_id, title, min(ts) as first_seen from e join w on arrival = k where mark is null or ts >= date_trunc('milliseconds', mark) group by user_id, title)
select user_id::varchar as key, title, epoch_us(first_seen) as first_us from g where first_seen < (select date_trunc('milliseconds', mark) - interval 1 millisecond from w where k = 3)""")
def stream_first_seen(spark, sf_dir):
    """The events table as arrivals in three parts, each after a new start of the stream; some rows come late."""
    from datetime import timedelta

    from docframe.streaming.titles import first_seen

    base = _folder(spark, "first_seen")
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.col("event_type"), F.lit("/"), F.col("event_id") % 20).alias("title"), F.col("ts").cast("timestamp").alias("ts"))
    e = rel.tiles(e, 3, "ts", "event_id").withColumn("arrival", F.when(F.col("event_id") % 40 == 0, 2).otherwise(F.col("tile"))).drop("tile")
    for k in range(3):
        e.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{base}/in")
        arrivals = spark.readStream.schema(e.drop("arrival").schema).parquet(f"{base}/in")
        told = first_seen(arrivals, "user_id", "title", "ts", timedelta(hours=6))
        told.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("key", "title", F.unix_micros("first_seen").alias("first_us"))


@_query("""
with p as (select page_id, html, page_id % 8 as k from pages)
select page_id, case when k = 7 then 'rtf' else 'unsupported' end as format, case k when 0 then 'image/png, an image rather than a document' when 1 then 'a web page' when 2 then 'a PDF is read by the caller' when 3 then 'served as application/vnd.hancom.hwpx, but its contents are not HWPX' when 4 then 'a plain-text document is read by the caller' when 5 then 'named .docx, but its contents are not DOCX' when 6 then 'a plain-text document is read by the caller' end as reason from p where length(html) > 0""")
def detect_served(spark, sf_dir):
    """What pages are that were served under various MIME types; bytes come first, then the type, then the name."""
    from docframe.functions import documents as fn

    k = F.col("page_id") % 8
    of = lambda *x: F.element_at(F.array(*[F.lit(v).cast("string") for v in x]), (k + 1).cast("int"))
    mime = of("Image/PNG ", "text/html", "application/pdf", "application/vnd.hancom.hwpx", "application/json", "application/octet-stream", None, "image/gif")
    name = of("a.docx", "a.docx", "a.docx", "a.docx", "a.docx", "a.docx", "a.txt", "a.docx")
    body = F.when(k == 7, F.concat(F.lit("{\\rtf1 "), "html")).otherwise(F.col("html"))
    d = fn.detect(F.encode(body, "UTF-8"), name, mime)
    return _t(spark, sf_dir, "pages").where("length(html) > 0").select("page_id", d.alias("d")).select("page_id", "d.format", "d.reason")
