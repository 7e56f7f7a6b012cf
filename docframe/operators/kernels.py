"""Kernels as DataFrame operators: one row per document in, one row per document out, refusals as rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.documents import detect, safe_filename, untrusted
from docframe.kernels import markdown, reading, sheets
from docframe.kernels.detecting import zip_format
from docframe.kernels.errors import Refused
from docframe.kernels.package import Package, build
from docframe.kernels.xmlscan import attribute
from docframe.limits import ASSET_BYTES, ASSETS, INSPECTED_CELLS, MARKDOWN_CHARS, OUTPUT_BYTES, TEXT_CHARS
from docframe.plans.deck import plan
from docframe.plans.recognise import recognise
from docframe.ship import ship
from docframe.writers import xlsx as xlsx_writer
from docframe.writers.common import PROFILES
from docframe.writers.documents import WRITERS, wrap

_ERROR = "struct<code:string,message:string,field:string>"
DEFAULT_PROFILE = "executive"


def _rows(df: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """``columns`` of df through f(row values) -> rows (dicts), batch by batch."""
    ship(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                found = [r for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in f(*values)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def _columns(df: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """``columns`` of df through f(Arrow columns of a few rows) -> (values of each output column, one list a column; None: all null) -> rows."""
    ship(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                for n, found in f(*b.slice(a, 64).columns):
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, arrow.types, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def _safely(f, *args) -> dict:
    """{ok, error} or f's result; a kernel never fails the job."""
    try:
        return {"error": None, **f(*args)}
    except Refused as e:
        return {"error": {"code": e.code, "message": e.message, "field": e.field}}
    except Exception as e:  # noqa: BLE001 - a malformed document is data
        return {"error": {"code": "INTERNAL_ERROR", "message": type(e).__name__, "field": None}}


def read_documents(df: DataFrame, budget: int = TEXT_CHARS) -> DataFrame:
    """(doc_id, filename, content) -> (doc_id, filename, format, text, note, complete, omissions, counts, error, answer).

    ``answer`` is the text after a line that says where it is from, or the reason why there is none.
    """
    known = df.select("doc_id", "filename", "content", detect(F.col("content"), F.col("filename")).alias("d")).select("doc_id", "filename", "content", F.col("d.format").alias("format"), F.col("d.reason").alias("reason"))

    def one(doc_id, filename, content, form, reason):
        if form == "zip":
            form, reason = zip_format(bytes(content))
        if form == "unsupported":
            got = {"error": {"code": "UNSUPPORTED_FORMAT", "message": reason, "field": "content"}}
        else:
            got = _safely(reading.read, bytes(content), form, budget)
        got["counts"] = list((got.get("counts") or {}).items())
        yield {"doc_id": doc_id, "filename": filename, "format": form, **got}

    out = _rows(known, ["doc_id", "filename", "content", "format", "reason"], one, f"doc_id long, filename string, format string, text string, note string, complete boolean, omissions array<string>, counts map<string,bigint>, error {_ERROR}")
    return out.withColumn("answer", _answer("read the document", F.col("note")))


def _answer(what: str, note: Column) -> Column:
    """What a caller is told of (text, filename, error)."""
    return F.when(F.col("error").isNull(), untrusted(F.col("text"), F.col("filename"), note)).otherwise(F.concat(F.lit(f"Error: could not {what} — "), F.col("error.message")))


def inspect_workbooks(df: DataFrame, mode: str = "both", hidden: bool = False, cap: int = INSPECTED_CELLS, budget: int = TEXT_CHARS) -> DataFrame:
    """(doc_id, filename, content) -> one row per workbook: its cells as lines, what was left out, and what else there is to know."""
    def one(doc_id, filename, content):
        yield {"doc_id": doc_id, "filename": filename, **_safely(sheets.inspection, bytes(content or b""), mode, hidden, cap, budget)}

    out = _rows(df, ["doc_id", "filename", "content"], one, f"doc_id long, filename string, text string, complete boolean, warnings array<string>, total_sheets int, hidden_sheets int, external_links int, macros boolean, error {_ERROR}")
    extent = F.when(F.col("complete"), "all inspected cells").otherwise("a bounded prefix of cells")
    return out.withColumn("answer", _answer("inspect the workbook", F.concat(extent, F.lit("; "), F.array_join("warnings", " "))))


def _blank(x: str | None) -> str:
    return (x or "").strip()


def workbook_cells(df: DataFrame, hidden: bool = False, cap: int | None = None) -> DataFrame:
    """(doc_id, content) -> one row per cell, in workbook order; refused workbooks give one row with an error.

    With a cap only so many of a workbook's first cells, over all its sheets, and ``n`` and ``complete`` beside each.
    """
    def cells_of(doc_ids: pa.Array, contents: pa.Array):
        totals, completes, ids, indexes, names, states, places, orders, addresses, numbers, columns, values, formulas, wrong = ([] for _ in range(14))
        errors: list[tuple] = []
        for doc_id, content in zip(doc_ids.to_pylist(), contents.to_pylist(), strict=True):
            got = _safely(lambda c=content: {"sheets": sheets.read_workbook(bytes(c), hidden)[0]})
            if got["error"]:
                errors.append((doc_id, got["error"]))
                continue
            found = got["sheets"]
            size = sum([len(row) for s in found for row in s.rows])
            kept = size if cap is None else min(size, cap)
            total = 0
            for k, s in enumerate(found):
                n = 0
                for r, row in enumerate(s.rows):
                    if total + len(row) > kept:
                        row = row[: kept - total]
                    for c in row:
                        n += 1
                        orders.append(n)
                        addresses.append(c.address)
                        numbers.append(c.row)
                        columns.append(c.column)
                        values.append(c.value)
                        formulas.append(c.formula)
                        wrong.append(c.error)
                    places += [r] * len(row)
                    total += len(row)
                indexes += [k] * n
                names += [s.name] * n
                states += [s.state] * n
            totals += range(1, kept + 1)
            completes += [cap is None or size <= cap] * kept
            ids += [doc_id] * kept
        none = lambda x: x if any(v is not None for v in x) else None
        yield len(ids), [totals, completes, ids, indexes, names, states, places, orders, addresses, numbers, columns, values, none(formulas), none(wrong), None]
        yield len(errors), [None, None, [i for i, _ in errors], *[None] * 11, [e for _, e in errors]]

    out = _columns(df, ["doc_id", "content"], cells_of, f"n long, complete boolean, doc_id long, sheet_idx int, sheet_name string, sheet_state string, row_ord int, cell_ord long, address string, row_no int, col_no int, value string, formula string, cell_error string, error {_ERROR}")
    return out.drop("n", "complete") if cap is None else out.select(*out.columns[2:], "n", "complete")


def _cell_value(c):
    if c is None or c["kind"] == "null":
        return None
    if c["kind"] == "formula":
        return {"formula": c["formula"] or "", "cached": c["s"] if c["s"] is not None else c["n"] if c["n"] is not None else c["b"]}
    return {"string": c["s"], "number": c["n"], "boolean": c["b"]}[c["kind"]]


def _flat(lists: pa.Array) -> tuple[list[int], pa.Array]:
    """(lengths, all values) of an array of lists; one that is null holds none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_pylist(), lists.flatten()


def _dealt(values: list, lengths: list[int]) -> list[list]:
    ends = [*accumulate(lengths)]
    return [values[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def _tabs(books: pa.Array) -> list[list[dict]] | None:
    """Workbooks' sheets {name, rows of values}, read column by column; None if they hold what a workbook may not."""
    tabs_of, tabs = _flat(books)
    if not {"name", "rows"} <= {f.name for f in tabs.type} or tabs.null_count:
        return None
    rows_of, rows = _flat(pc.struct_field(tabs, "rows"))
    cells_of, cells = _flat(rows)
    if not {"kind", "s", "n", "b", "formula"} <= {f.name for f in cells.type} or pc.struct_field(tabs, "rows").null_count or rows.null_count:
        return None
    kinds = pc.struct_field(cells, "kind")
    if kinds.null_count > cells.null_count or not {*pc.unique(kinds).to_pylist()} <= {None, "null", "string", "number", "boolean", "formula"}:
        return None
    parts = [pc.struct_field(cells, k) for k in ("s", "n", "b", "formula")]
    columns = [[None] * len(x) if x.null_count == len(x) else x.to_pylist() for x in parts]
    value = lambda k, s, n, b, f: _cell_value(None if k is None else {"kind": k, "s": s, "n": n, "b": b, "formula": f})
    values = [n if k == "number" else s if k == "string" else value(k, s, n, b, f) for k, s, n, b, f in zip(kinds.to_pylist(), *columns, strict=True)]
    named = [{"name": n, "rows": r} for n, r in zip(pc.struct_field(tabs, "name").to_pylist(), _dealt(_dealt(values, cells_of), rows_of), strict=True)]
    return _dealt(named, tabs_of)


def render_spreadsheets(df: DataFrame) -> DataFrame:
    """(doc_id, sheets array<struct<name, rows array<array<cell>>>>[, title, filename]) -> (doc_id, filename, content, counts, error)."""
    named = [c for c in ("title", "filename") if c in df.columns]

    def make(made, title):
        data = xlsx_writer.render(made, title)
        if len(data) > OUTPUT_BYTES:
            raise Refused("OUTPUT_TOO_LARGE", f"the workbook is {len(data):,} bytes; the limit is {OUTPUT_BYTES:,}")
        cells = [c for s in made for r in s["rows"] for c in r]
        return {"content": data, "counts": [("sheets", len(made)), ("rows", sum([len(s["rows"]) for s in made])), ("cells", len(cells)), ("formulas", sum([isinstance(c, dict) for c in cells]))]}

    def books_of(doc_ids: pa.Array, tabs: pa.Array, *names: pa.Array):
        books = _tabs(tabs)
        one = make if books is not None else lambda given, title: make([{"name": s["name"], "rows": [[_cell_value(c) for c in r] for r in s["rows"]]} for s in given or []], title)
        called, found = [], []
        for given, *own in zip(tabs.to_pylist() if books is None else books, *(x.to_pylist() for x in names), strict=True):
            title, filename = (_blank(dict(zip(named, own, strict=True)).get(k)) for k in ("title", "filename"))
            title = title or filename or "workbook"
            called.append(unicodedata.normalize("NFC", filename or title))
            found.append(_safely(one, given, title))
        yield len(found), [doc_ids, called, *([x.get(k) for x in found] for k in ("content", "counts")), [x["error"] for x in found]]

    out = _columns(df, ["doc_id", "sheets", *named], books_of, f"doc_id long, filename string, content binary, counts map<string,bigint>, error {_ERROR}")
    return out.withColumn("filename", safe_filename(F.col("filename"), "xlsx"))


def render_documents(df: DataFrame) -> DataFrame:
    """(doc_id, format, profile, markdown[, title, filename, assets map<name, struct<mime, bytes>>]) -> (doc_id, filename, title, summary, content, error).

    The title is the one given, or the first heading of level 1, or the file's name.
    """
    named = [c for c in ("title", "filename", "assets") if c in df.columns]

    def one(doc_id, form, profile, source, *more):
        extra = dict(zip(named, more, strict=True))
        given, filename = extra.get("assets"), _blank(extra.get("filename"))
        profile = profile or DEFAULT_PROFILE

        def make():
            assets = {k: bytes(v["bytes"]) for k, v in (given or [])}
            if why := refused_assets({k: (v["mime"], len(v["bytes"])) for k, v in (given or [])}, form):
                raise Refused("INVALID_ARGUMENT", why, "assets")
            if form not in WRITERS:
                raise Refused("INVALID_ARGUMENT", f"format must be one of {', '.join(WRITERS)}", "format")
            if profile not in PROFILES:
                raise Refused("INVALID_ARGUMENT", f"profile must be one of {', '.join(PROFILES)}", "profile")
            if not (source or "").strip():
                raise Refused("INVALID_ARGUMENT", "content is empty", "content")
            if len(source) > MARKDOWN_CHARS:
                raise Refused("INPUT_TOO_LARGE", f"content is over {MARKDOWN_CHARS:,} characters", "content")
            blocks = markdown.parse(source)
            title = _blank(extra.get("title")) or markdown.title(blocks) or filename or "document"
            data = WRITERS[form](blocks, title, profile, assets)
            if len(data) > OUTPUT_BYTES:
                raise Refused("OUTPUT_TOO_LARGE", f"the document is {len(data):,} bytes; the limit is {OUTPUT_BYTES:,}")
            return {"filename": unicodedata.normalize("NFC", filename or title), "format": form, "title": title, "summary": markdown.summary(blocks), "content": data}

        yield {"doc_id": doc_id, **_safely(make)}

    out = _rows(df, ["doc_id", "format", "profile", "markdown", *named], one, f"doc_id long, filename string, format string, title string, summary string, content binary, error {_ERROR}")
    safe = F.lit(None).cast("string")
    for form in WRITERS:
        safe = F.when(F.col("format") == form, safe_filename(F.col("filename"), form)).otherwise(safe)
    return out.withColumn("filename", safe).drop("format")


def refused_assets(assets: dict[str, tuple[str, int]], form: str) -> str | None:
    """Why a document's assets (name: mime, bytes) are refused, or None."""
    if assets and form not in ("pptx", "docx", "pdf"):
        return f"{form} takes no assets"
    if len(assets) > ASSETS:
        return f"more than {ASSETS} assets"
    if any(not re.fullmatch(r"[A-Za-z0-9가-힣][A-Za-z0-9가-힣._-]{0,63}", n) for n in assets):
        return "an asset's name holds other characters than letters, digits, dot, dash and underscore"
    if any(m not in ("image/png", "image/jpeg") for m, _ in assets.values()):
        return "an asset is not a PNG or JPEG"
    return "the assets are too large" if sum(n for _, n in assets.values()) > ASSET_BYTES else None


# Parts that a package of each format must hold.
REQUIRED = {
    "docx": ("[Content_Types].xml", "_rels/.rels", "docProps/core.xml", "docProps/app.xml", "word/document.xml", "word/styles.xml"),
    "pptx": ("[Content_Types].xml", "_rels/.rels", "docProps/core.xml", "docProps/app.xml", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "ppt/slideMasters/slideMaster1.xml"),
    "hwpx": ("mimetype", "META-INF/manifest.xml", "Contents/content.hpf", "Contents/header.xml", "Contents/section0.xml"),
    "xlsx": ("[Content_Types].xml", "_rels/.rels", "docProps/core.xml", "docProps/app.xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/worksheets/sheet1.xml"),
}


def validate_outputs(df: DataFrame) -> DataFrame:
    """(doc_id, format, content) of written documents, opened again -> (doc_id, structure, content_ok, external, warnings)."""
    def one(doc_id, form, content):
        data = bytes(content or b"")
        if form == "pdf":
            ok = data.startswith(b"%PDF-") and data.rstrip().endswith(b"%%EOF") and bool(re.search(rb"/Type */Page\b(?!s)", data))
            yield {"doc_id": doc_id, "structure": ok, "content_ok": ok, "external": 0, "warnings": []}
            return

        def look():
            p = Package(data)
            warnings = [f"missing part {n}" for n in REQUIRED.get(form, ()) if n not in p.names]
            links = list(_relationships(p))
            warnings += [f"{s} leads to missing part {t}" for s, t, out in links if not out and t not in p.names]
            text = _safely(reading.read, data, form)
            return {"structure": not warnings, "content_ok": text["error"] is None, "external": sum(out for *_, out in links), "warnings": warnings}

        got = _safely(look)
        yield {"doc_id": doc_id, **({"structure": False, "content_ok": False, "external": 0, "warnings": [got["error"]["message"]]} if got["error"] else got)}

    return _rows(df, ["doc_id", "format", "content"], one, "doc_id long, structure boolean, content_ok boolean, external long, warnings array<string>")


_RUN = "struct<text:string,bold:boolean,italic:boolean,code:boolean,href:string>"
BLOCK = f"doc_id long, pos int, depth int, parent_pos int, kind string, level int, ordered boolean, language string, name string, text string, runs array<{_RUN}>, items array<struct<depth:int,runs:array<{_RUN}>>>, align array<string>, header array<array<{_RUN}>>, rows array<array<array<{_RUN}>>>"


def parse_markdown(df: DataFrame) -> DataFrame:
    """(doc_id, markdown) -> blocks, flat in pre-order."""
    return _rows(df, ["doc_id", "markdown"], lambda i, m: ({"doc_id": i, **b, "text": markdown.text_of(b)} for b in markdown.parse(m or "")), BLOCK)


def plan_slides(df: DataFrame) -> DataFrame:
    """(doc_id, markdown) -> (doc_id, slide_no, type, title, pieces)."""
    def one(doc_id, source):
        blocks = markdown.parse(source or "")
        for n, s in enumerate(plan(blocks, markdown.title(blocks) or ""), 1):
            yield {"doc_id": doc_id, "slide_no": n, "type": s["type"], "title": s["title"], "pieces": [p.get("text") or " | ".join(p.get("header", [])) for p in s.get("pieces", [])] + [" / ".join(i) for i in s.get("items", [])]}

    return _rows(df, ["doc_id", "markdown"], one, "doc_id long, slide_no int, type string, title string, pieces array<string>")


def recognise_sections(df: DataFrame) -> DataFrame:
    """(doc_id, title, markdown of a section's body) -> (doc_id, shape, items)."""
    def one(doc_id, title, source):
        got = recognise(markdown.parse(source or ""), title or "") or {"kind": None, "items": []}
        yield {"doc_id": doc_id, "shape": got["kind"], "items": [" / ".join(i) for i in got["items"]]}

    return _rows(df, ["doc_id", "title", "markdown"], one, "doc_id long, shape string, items array<string>")


def package_parts(df: DataFrame) -> DataFrame:
    """(doc_id, content) -> (doc_id, ord, name, compressed_size, original_size), nothing inflated."""
    from docframe.kernels.package import entries

    return _rows(df, ["doc_id", "content"], lambda i, c: ({"doc_id": i, "ord": k, "name": n, "compressed_size": p, "original_size": o} for k, (n, p, o) in enumerate(_safely(lambda: {"e": entries(bytes(c))}).get("e", []))), "doc_id long, ord int, name string, compressed_size long, original_size long")


def build_packages(df: DataFrame) -> DataFrame:
    """(doc_id, parts array<struct<name, body>>) -> (doc_id, content): parts in order; ``mimetype`` is stored, not packed."""
    def one(doc_id, parts):
        yield {"doc_id": doc_id, "content": build({p["name"]: p["body"] for p in parts or []}, stored=("mimetype",))}

    return _rows(df, ["doc_id", "parts"], one, "doc_id long, content binary")


def wrapped_lines(df: DataFrame, room: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, line_no, line): greedy lines of at most ``room`` characters; longer words are cut."""
    return _rows(df, ["doc_id", "text"], lambda i, t: ({"doc_id": i, "line_no": n, "line": x} for n, x in enumerate(wrap(t or "", room), 1)), "doc_id long, line_no int, line string")


def _relationships(p: Package) -> Iterator[tuple[str, str, bool]]:
    """(part of the relationship, target as a path in the package, external)."""
    for n in p.names:
        if n.endswith(".rels"):
            base = re.sub(r"_rels/[^/]*\Z", "", n)
            for m in re.finditer(r"<Relationship\b([^>]*)>", p.text(n) or ""):
                to, out = attribute(m[1], "Target") or "", attribute(m[1], "TargetMode") == "External"
                steps: list[str] = []
                for s in ([] if to.startswith("/") else base.split("/")) + to.split("/"):
                    steps = steps[:-1] if s == ".." else steps + ([s] if s not in ("", ".") else [])
                yield n, to if out else "/".join(steps), out


def package_relationships(df: DataFrame) -> DataFrame:
    """(doc_id, content) -> (doc_id, source, target, external): targets as paths in the package."""
    def one(doc_id, content):
        for source, target, out in _safely(lambda: {"r": list(_relationships(Package(bytes(content))))}).get("r", []):
            yield {"doc_id": doc_id, "source": source, "target": target, "external": out}

    return _rows(df, ["doc_id", "content"], one, "doc_id long, source string, target string, external boolean")
