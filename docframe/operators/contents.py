"""Page numbers in a table of contents that stands before the body it lists.

The page of a heading depends on how many pages the contents take; these depend
on how many lines the entries take, and an entry that is widened by a digit may
take one more. So pages are assigned again until nothing changes: every round
sets the entries of the documents that changed on pages, and joins the count
back. Contents only grow from round to round, so this ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.operators.paging import paginate

#: Characters by which an entry is indented below level 1.
INDENT = 2


def entry_lines(text: Column, level: Column, page: Column, width: int) -> Column:
    """Lines of an entry: indented text, a blank and the page number."""
    return F.greatest(F.lit(1), F.ceil(((level - 1) * INDENT + F.length(text) + 1 + F.length(page.cast("string"))) / width)).cast("int")


def contents_pages(headings: DataFrame, room: int, width: int, before: int = 1, key: str = "doc_id", rounds: int = 50) -> DataFrame:
    """(key, pos, level, text, page, contents_page, contents_pages) of (key, pos, level, text, body_page).

    ``body_page`` counts from 0; ``before`` pages (a cover) stand before the contents, which have ``room`` lines of ``width``
    characters a page. Pages count from 1. Defined results: a document without headings has no rows; a null text is empty.
    """
    h = cut(headings.select(key, "pos", "level", F.coalesce("text", F.lit("")).alias("text"), "body_page"))
    now = cut(h.select(key).distinct().withColumn("n", F.lit(1)))
    settled = None
    for _ in range(rounds):
        entries = h.join(now, key).withColumn("page", F.col("body_page") + before + F.col("n") + 1)
        entries = cut(entries.withColumn("cost", entry_lines(F.col("text"), F.col("level"), F.col("page"), width)))
        placed = entries.join(paginate(entries, room, key).select(key, "pos", F.col("page").alias("contents_page")), [key, "pos"])
        need = placed.groupBy(key).agg((F.max("contents_page") + 1).alias("need"))
        placed = cut(placed.join(need, key))
        done = placed.where("need = n").select(key, "pos", "level", "text", "page", (F.col("contents_page") + before + 1).alias("contents_page"), F.col("n").alias("contents_pages"))
        settled = done if settled is None else settled.union(done)
        now = cut(placed.where("need <> n").groupBy(key).agg(F.max(F.greatest("need", "n")).alias("n")))
        if now.isEmpty():
            return settled
    raise RuntimeError(f"contents did not settle in {rounds} rounds")
