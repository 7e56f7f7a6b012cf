"""One call by name: ``run(operation, df, **options)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.documents import base64_source
from docframe.kernels.errors import Refused
from docframe.limits import INSPECTED_CELLS
from docframe.operators import kernels

MODES = ("values", "formulas", "both")


def inspect_spreadsheets(df: DataFrame, mode: str = "both", hidden: bool = False, cap: int = INSPECTED_CELLS) -> DataFrame:
    """(doc_id, content) -> addressed cells, at most ``cap`` a workbook over all its sheets."""
    if mode not in MODES:
        raise Refused("INVALID_ARGUMENT", f"mode must be one of {', '.join(MODES)}", "mode")
    cells = kernels.workbook_cells(df, hidden, cap).where(F.col("error").isNull())
    if mode == "values":
        return cells.drop("formula")
    return cells.where(F.col("formula").isNotNull()).drop("value") if mode == "formulas" else cells


def read_documents(df: DataFrame, **options) -> DataFrame:
    """As ``kernels.read_documents``; a ``content`` of text is taken as base64, and what is not becomes a row that says why."""
    if dict(df.dtypes)["content"] != "string":
        return kernels.read_documents(df, **options)
    sent = df.select("doc_id", "filename", base64_source(F.col("content")).alias("s")).select("doc_id", "filename", F.col("s.bytes").alias("content"), F.col("s.error").alias("why"))
    good = kernels.read_documents(sent.where("why is null"), **options)
    code = F.when(F.col("why") == "content is too large", "INPUT_TOO_LARGE").otherwise("INVALID_INPUT")
    error = F.struct(code.alias("code"), F.col("why").alias("message"), F.lit("content").alias("field"))
    bad = sent.where("why is not null").select("doc_id", "filename", error.alias("error"), F.concat(F.lit("Error: could not read the document — "), "why").alias("answer"))
    return good.unionByName(bad, allowMissingColumns=True)


OPERATIONS = {"read_document": read_documents, "inspect_spreadsheet": inspect_spreadsheets, "render_spreadsheet": kernels.render_spreadsheets, "render_document": kernels.render_documents}


def run(operation: str, df: DataFrame, **options) -> DataFrame:
    if operation not in OPERATIONS:
        raise Refused("UNKNOWN_TOOL", f"{operation!r} is not an operation", "operation")
    return OPERATIONS[operation](df, **options)
