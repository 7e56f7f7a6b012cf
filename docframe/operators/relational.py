"""Ordered and relational operators on document tables. Every input has an explicit position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.functions.documents import attribute, tidy_line, units
from docframe.limits import ASSET_BYTES, ASSETS, ZIP_ENTRIES, ZIP_ENTRY, ZIP_RATIO, ZIP_TOTAL
from docframe.operators.paging import paginate

#: Rows that ``dealt`` gives a task.
TASK_ROWS = 500_000


def _upto(key: list[str], *order: str) -> Window:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def tiles(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Adds tile: which of ``n`` equal parts (0 first; the first ones a row longer) of all rows in order a row lies in.

    Ranges of the order are sorted apart; only their numbers of rows are collected.
    """
    placed = cut(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    total, before = 0, []
    for p, count in sizes:
        before.append((int(p), total))
        total += count
    begins = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _begin long"))
    most, more = total // n, total % n
    k, edge = F.col("_begin") + at, more * (most + 1)
    tile = F.when(k < edge, F.floor(k / (most + 1))).otherwise(more + F.floor((k - edge) / max(1, most))).cast("int")
    return placed.withColumn("_part", part).join(begins, "_part").withColumn("tile", tile).drop("_id", "_part", "_begin")


def dealt(rows: DataFrame, n: int, *key: str, each: int | None = None) -> DataFrame:
    """``rows``, dealt by key to tasks of some ``each`` (``TASK_ROWS``) of the ``n`` rows (one a core at least), whatever the session's number of shuffle partitions.

    Windows and groups on these keys (and more) take no other shuffle, so what a task holds of them does not grow with the table.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (each or TASK_ROWS))), *key)


def normalize_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line): tidy, no two empty lines in a row, none at the ends."""
    t = lines.select(key, "pos", tidy_line(F.col("line")).alias("line"))
    w, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    full = F.when(F.col("line") != "", F.col("pos"))
    t = t.withColumns({"_before": F.lag("line").over(w), "_first": F.min(full).over(whole), "_last": F.max(full).over(whole)})
    return t.where(F.col("pos").between(F.col("_first"), F.col("_last")) & ((F.col("line") != "") | (F.col("_before") != ""))).select(key, "pos", "line")


def join_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): lines in order, one a row."""
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def row_budget(rows: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, pos, line) of the whole rows that a budget of UTF-16 units holds; it ends at the first that does not fit."""
    used = F.sum(units(F.col("line")) + 1).over(_upto([key], "pos"))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def cell_cap(cells: DataFrame, cap: int, key: str = "doc_id", order: tuple[str, ...] = ("sheet_idx", "cell_ord")) -> DataFrame:
    """The first ``cap`` cells of each workbook, over all sheets, and whether there were more."""
    w = Window.partitionBy(key).orderBy(*order)
    return cells.withColumns({"n": F.row_number().over(w), "total": F.count("*").over(Window.partitionBy(key))}).where(F.col("n") <= cap).withColumn("complete", F.col("total") <= cap).drop("total")


def sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds section_id (headings of level 1 and 2 begin one), is_cover and chapter (level 1 headings after the cover)."""
    top = F.when((F.col("kind") == "heading") & (F.col("level") <= 2), 1).otherwise(0)
    one = F.when((F.col("kind") == "heading") & (F.col("level") == 1), 1).otherwise(0)
    w = _upto([key], "pos")
    first = F.min("pos").over(Window.partitionBy(key))
    out = blocks.withColumns({"section_id": F.sum(top).over(w), "is_cover": (one == 1) & (F.col("pos") == first)})
    return out.withColumn("chapter", F.sum(F.when((one == 1) & ~F.col("is_cover"), 1).otherwise(0)).over(w))


def contents(blocks: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """(key, pos, level, text, entries, shown): headings of level 1 and 2 after the cover; shown if there is a cover and enough of them."""
    s = sections(blocks, key)
    w = Window.partitionBy(key)
    s = s.withColumn("cover", F.max(F.col("is_cover").cast("int")).over(w)).where((F.col("kind") == "heading") & (F.col("level") <= 2) & ~F.col("is_cover"))
    return s.withColumn("entries", F.count("*").over(w)).select(key, "pos", "level", "text", "entries", ((F.col("cover") == 1) & (F.col("entries") >= least)).alias("shown"))


def list_numbers(items: DataFrame, key: str = "list_id", deepest: int = 4) -> DataFrame:
    """Adds number: counts at its depth since the last shallower item."""
    w = _upto([key], "pos")
    shallower = F.lit(None).cast("long")
    cols: dict[str, Column] = {f"_s{d}": F.max(F.when(F.col("depth") < d, F.col("pos"))).over(w) for d in range(1, deepest + 1)}
    t = items.withColumns(cols)
    for d in range(1, deepest + 1):
        shallower = F.when(F.col("depth") == d, F.col(f"_s{d}")).otherwise(shallower)
    t = t.withColumn("_from", F.coalesce(shallower, F.lit(-1)))
    return t.withColumn("number", F.row_number().over(Window.partitionBy(key, "depth", "_from").orderBy("pos"))).drop("_from", *cols)


def merge_runs(runs: DataFrame, style: list[str], key: str = "doc_id") -> DataFrame:
    """(key, island, pos, text, style...): neighbours of equal style become one run; empty runs vanish."""
    runs = runs.where(F.col("text") != "")
    w = Window.partitionBy(key).orderBy("pos")
    same = F.lit(True)
    for s in style:
        same = same & F.lag(s).over(w).eqNullSafe(F.col(s))
    t = runs.withColumn("_new", F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1))
    t = t.withColumn("island", F.sum("_new").over(_upto([key], "pos")))
    return t.groupBy(key, "island", *style).agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


def first_seen(rows: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """(key, value, ord): distinct values in the order in which they first occur."""
    return rows.groupBy(key, value).agg(F.min("pos").alias("pos")).withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).drop("pos")


def block_summary(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, summary), as in ``1 heading, 2 paragraphs``."""
    kinds = (("heading", "heading"), ("paragraph", "paragraph"), ("table", "table"), ("list", "list"), ("code", "code block"))
    counted = blocks.groupBy(key).agg(*[F.count_if((F.col("kind") == k) & (F.col("depth") == 0)).alias(f"_{k}") for k, _ in kinds])
    word = lambda k, w: F.when(F.col(f"_{k}") > 0, F.concat(F.col(f"_{k}").cast("string"), F.lit(f" {w}"), F.when(F.col(f"_{k}") == 1, "").otherwise("s")))
    return counted.select(key, F.coalesce(F.nullif(F.concat_ws(", ", *[word(k, w) for k, w in kinds]), F.lit("")), F.lit("nothing")).alias("summary"))


def column_shares(cells: DataFrame, key: str = "doc_id", column: str = "col_no", text: str = "value") -> DataFrame:
    """(key, column, share): by each column's longest text (4 at least), within 0.1 and 0.6, summing to 1."""
    need = cells.groupBy(key, column).agg(F.greatest(F.lit(4), F.max(F.length(text))).alias("need"))
    w = Window.partitionBy(key)
    part = need.withColumn("part", F.least(F.lit(0.6), F.greatest(F.lit(0.1), F.col("need") / F.sum("need").over(w))))
    return part.withColumn("share", F.col("part") / F.sum("part").over(w)).select(key, column, "share")


def column_widths(cells: DataFrame, key: str = "doc_id", column: str = "col_no", text: str = "value") -> DataFrame:
    return cells.groupBy(key, column).agg(F.least(F.lit(60), F.greatest(F.lit(10), F.max(F.length(text) + 2))).alias("width"))


def sheet_names(sheets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds valid: 1 to 31 characters, none reserved, no quote at an end, unique in any case."""
    n = F.col("name")
    twice = F.count("*").over(Window.partitionBy(key, F.lower(n)))
    return sheets.withColumn("valid", F.length(n).between(1, 31) & ~n.rlike(r"[\\/:?*\[\]]") & ~n.startswith("'") & ~n.endswith("'") & (twice == 1))


def zip_budget(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, verdict) from declared sizes alone; the first reason that holds, or null."""
    name, size = F.col("name"), F.col("original_size")
    leaves = name.startswith("/") | F.array_contains(F.split(name, "/"), "..")
    a = parts.groupBy(key).agg(F.count("*").alias("n"), F.max(size).alias("most"), F.max(size / F.greatest(F.lit(1), F.col("compressed_size"))).alias("ratio"), F.sum(size).alias("total"), F.max(leaves.cast("int")).alias("leaves"))
    return a.select(key, F.when(F.col("n") > ZIP_ENTRIES, "entries").when(F.col("most") > ZIP_ENTRY, "entry").when(F.col("ratio") > ZIP_RATIO, "ratio").when(F.col("total") > ZIP_TOTAL, "total").when(F.col("leaves") == 1, "path").alias("verdict"))


def missing_parts(required: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, missing): required part names that a package lacks, in order; packages that lack none are left out."""
    gone = required.join(parts.select(key, "name"), [key, "name"], "left_anti")
    return gone.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("missing"))


def shared_lookup(cells: DataFrame, strings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells of type ``s`` get the string of their index, or an empty one; others keep their value."""
    s = strings.select(F.col(key).alias("_k"), F.col("idx").alias("_i"), F.col("string"))
    joined = cells.join(s, (F.col(key) == F.col("_k")) & (F.col("type") == "s") & (F.col("raw").try_cast("int") == F.col("_i")), "left")
    return joined.withColumn("value", F.when(F.col("type") == "s", F.coalesce("string", F.lit(""))).otherwise(F.col("raw"))).drop("_k", "_i", "string")


def sheet_parts(sheets: DataFrame, rels: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sheet_idx, part): from the relationship, else by position; only parts that exist."""
    r = rels.select(F.col(key).alias("_k"), F.col("id").alias("rid"), "target").where(F.col("target") != "")
    t = sheets.join(r, (F.col(key) == F.col("_k")) & (F.col("rel_id") == F.col("rid")), "left")
    t = t.withColumn("name", F.coalesce(F.concat(F.lit("xl/"), F.regexp_replace("target", "^/?(xl/)?", "")), F.concat(F.lit("xl/worksheets/sheet"), (F.col("sheet_idx") + 1).cast("string"), F.lit(".xml"))))
    return t.join(parts.select(key, "name"), [key, "name"], "left_semi").select(key, "sheet_idx", F.col("name").alias("part"))


def uses_bold(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bold): whether a document's blocks need a bold face; headings and heads of tables are set in it."""
    some = lambda runs: F.coalesce(F.exists(runs, lambda r: F.coalesce(r["bold"], F.lit(False))), F.lit(False))
    listed = F.coalesce(F.exists("items", lambda i: F.exists(i["runs"], lambda r: F.coalesce(r["bold"], F.lit(False)))), F.lit(False))
    bold = F.col("kind").isin("heading", "table") | F.col("kind").isin("paragraph", "quote") & some(F.col("runs")) | (F.col("kind") == "list") & listed
    return blocks.where(F.col("depth") == 0).groupBy(key).agg(F.max(bold).alias("bold"))


def pack(pieces: DataFrame, room: int, key: str = "doc_id") -> DataFrame:
    """(key, pos, page): whole pieces in order, a new page when one does not fit (a piece over ``room`` stands alone)."""
    return paginate(pieces, room, key).select(key, "pos", "page")


def columns_joined(df: DataFrame, left: str, right: str, key: str = "doc_id") -> DataFrame:
    """(key, row, left, right) of two arrays set side by side, the shorter one filled up with empty texts; null arrays are empty, two empty ones have no rows."""
    one = lambda c: df.select(key, F.posexplode(c).alias("row", c))
    return one(left).join(one(right), [key, "row"], "full_outer").select(key, "row", F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))


def resolved_path(base: Column, target: Column) -> Column:
    """``target`` as a path from the top of a package, seen from the folder ``base``: ``..`` leaves a folder (none above the top), ``.`` and empty steps stay, a slash in front begins at the top."""
    steps = F.concat(F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.split(base, "/")), F.split(target, "/"))
    step = lambda stack, s: F.when(s.isin("", "."), stack).when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(s)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")


def relationships(events: DataFrame, key: str = "doc_id", part: str = "part") -> DataFrame:
    """(key, source, id, target, external) from the events of relationship parts: internal targets as paths in the package."""
    of = events.where("kind = 'open'").where(F.element_at(F.split("name", ":"), -1) == "Relationship")
    target = F.coalesce(attribute(F.col("attrs"), "Target"), F.lit(""))
    out = F.coalesce(attribute(F.col("attrs"), "TargetMode") == "External", F.lit(False))
    base = F.regexp_replace(part, r"_rels/[^/]*\z", "")
    return of.select(key, F.col(part).alias("source"), attribute(F.col("attrs"), "Id").alias("id"), F.when(out, target).otherwise(resolved_path(base, target)).alias("target"), out.alias("external"))


def text_sheet(rows: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, text, kept, total) of (key, pos, line) under a heading that counts towards the budget."""
    used = F.sum(units(F.col("line")) + 1).over(_upto([key], "pos")) + units(F.col("sheet")) + 4
    t = rows.withColumn("fits", used <= budget)
    line = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("fits", "pos", "line")), lambda x: x["fits"])), lambda x: x["line"]), "\n")
    return t.groupBy(key, "sheet").agg(line.alias("body"), F.count_if("fits").alias("kept"), F.count("*").alias("total")).select(key, F.concat(F.lit("## "), F.col("sheet"), F.when(F.col("kept") > 0, F.concat(F.lit("\n"), F.col("body"))).otherwise("")).alias("text"), "kept", "total")


def asset_rules(assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ok): at most so many assets and bytes in all, plain names, PNG or JPEG."""
    plain = F.col("name").rlike(r"^[A-Za-z0-9가-힣][A-Za-z0-9가-힣._-]{0,63}$")
    return assets.groupBy(key).agg(((F.count("*") <= ASSETS) & F.min(plain) & F.min(F.col("mime").isin("image/png", "image/jpeg")) & (F.sum("bytes") <= ASSET_BYTES)).alias("ok"))


def figure_assets(refs: DataFrame, assets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, name, bytes, error) of every reference."""
    return refs.join(assets, [key, "name"], "left").select(key, "pos", "name", "bytes", F.when(F.col("bytes").isNull(), F.concat(F.lit("no asset is named "), "name")).alias("error"))


def numbered_parts(parts: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, name, ord) of parts that fit, by the number that the pattern captures."""
    t = parts.where(F.col("name").rlike(pattern)).withColumn("_n", F.regexp_extract("name", pattern, 1).cast("long"))
    return t.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("_n", "name"))).drop("_n")


def inspection_budget(cells: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, sheet_idx, pos, line): headings (pos -1) and lines of (key, sheet, pos, line), sheets by name, up to a budget."""
    t = cells.withColumn("sheet_idx", F.dense_rank().over(Window.partitionBy(key).orderBy("sheet")))
    heads = t.select(key, "sheet_idx", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("## "), "sheet").alias("line"), (units(F.col("sheet")) + 4 + F.when(F.col("sheet_idx") > 1, 1).otherwise(0)).alias("cost")).distinct()
    whole = heads.unionByName(t.select(key, "sheet_idx", F.col("pos").cast("long").alias("pos"), "line", (units(F.col("line")) + 1).alias("cost")))
    return whole.withColumn("used", F.sum("cost").over(_upto([key], "sheet_idx", "pos"))).where(F.col("used") <= budget).select(key, "sheet_idx", "pos", "line")


def size_guard(workbooks: DataFrame, rows: int, cells: int, key: str = "doc_id") -> DataFrame:
    """(key, error) of (key, sheet, row, cells): more rows in a sheet, or cells in a workbook, than allowed."""
    sheets = workbooks.groupBy(key, "sheet").agg(F.count("*").alias("n"), F.sum("cells").alias("c"))
    return sheets.groupBy(key).agg(F.when(F.max("n") > rows, "rows").when(F.sum("c") > cells, "cells").alias("error"))
