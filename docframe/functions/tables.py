"""Relational operators as table functions of SQL: ``select * from pack_pages(table(pieces), 14)``.

Each looks at the columns of the table it is called on, refuses one that lacks
what it needs, and passes all of its columns on with its own behind them. It says
itself by what the rows are to be dealt and in which order it needs them, so a
caller names neither (``PARTITION BY`` and ``WITH SINGLE PARTITION`` in the call
are refused by Spark then); a key is one partition, rows stream through, and only
the state of a key is held. The forms on DataFrames stay in the JVM and are the
faster ones; these are for callers who have nothing but SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from docframe.ship import ship


def _result(table: AnalyzeArgument, key: str, more: list[tuple[str, T.DataType]], *needed: str) -> AnalyzeResult:
    """The table's columns and these behind them, dealt by key in the order of ``pos``."""
    if not table.isTable:
        raise ValueError("the first argument must be a table, as in TABLE(name)")
    have = table.dataType.fieldNames()
    lack = [c for c in (key, "pos", *needed) if c not in have]
    if lack:
        raise ValueError(f"the table has no column {', '.join(lack)}")
    taken = [n for n, _ in more if n in have]
    if taken:
        raise ValueError(f"the table has a column {', '.join(taken)} of its own")
    schema = T.StructType(list(table.dataType.fields) + [T.StructField(n, k) for n, k in more])
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn("pos")])


@F.udtf
class PackPages:
    """Adds ``page``: whole pieces of (doc_id, pos, cost) in order on pages of ``room`` lines; a taller one stands alone."""

    def __init__(self):
        self.page, self.used = 0, 0

    @staticmethod
    def analyze(pieces: AnalyzeArgument, room: AnalyzeArgument) -> AnalyzeResult:
        if not room.isConstantExpression or not isinstance(room.value, int) or room.value < 1:
            raise ValueError("room must be a whole number of lines")
        return _result(pieces, "doc_id", [("page", T.IntegerType())], "cost")

    def eval(self, piece: Row, room: int) -> Iterator[tuple]:
        cost = max(1, piece["cost"])
        if self.used and self.used + cost > room:
            self.page, self.used = self.page + 1, 0
        self.used += cost
        yield (*piece, self.page)


@F.udtf
class ListNumbers:
    """Adds ``number``: the count of an item of (list_id, pos, depth) at its depth since the last shallower one.

    A row may also be a run of a list's items: ``depth`` is then an array, and so is ``number``. A call a run
    costs little more than a call an item; a run is all that a call holds.
    """

    def __init__(self):
        self.counts: list[list[int]] = []  # [depth, count], deeper ones behind

    @staticmethod
    def analyze(items: AnalyzeArgument) -> AnalyzeResult:
        kind = T.IntegerType()
        runs = items.isTable and any(f.name == "depth" and isinstance(f.dataType, T.ArrayType) for f in items.dataType.fields)
        return _result(items, "list_id", [("number", T.ArrayType(kind) if runs else kind)], "depth")

    def number(self, depth: int) -> int:
        while self.counts and self.counts[-1][0] > depth:
            self.counts.pop()
        if not self.counts or self.counts[-1][0] < depth:
            self.counts.append([depth, 0])
        self.counts[-1][1] += 1
        return self.counts[-1][1]

    def eval(self, item: Row) -> Iterator[tuple]:
        depth = item["depth"]
        yield (*item, [self.number(d) for d in depth] if isinstance(depth, list) else self.number(depth))


@F.udtf
class RowBudget:
    """Adds ``used``, and ends at the first row of (doc_id, pos, line) that a budget of UTF-16 units does not hold."""

    def __init__(self):
        self.used, self.over = 0, False

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        return _result(rows, "doc_id", [("used", T.LongType())], "line")

    def eval(self, row: Row, budget: int) -> Iterator[tuple]:
        self.used += len(row["line"].encode("utf-16-le")) // 2 + 1
        self.over = self.over or self.used > budget
        if not self.over:
            yield (*row, self.used)


FUNCTIONS = {"pack_pages": PackPages, "list_numbers": ListNumbers, "row_budget": RowBudget}


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to a session's SQL."""
    ship(spark)
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
    return spark
