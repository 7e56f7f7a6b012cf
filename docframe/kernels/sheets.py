"""Workbooks: sheets, shared strings and cells."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from docframe.kernels.errors import Refused
from docframe.kernels.lines import trim, units
from docframe.kernels.package import Package
from docframe.kernels.xmlscan import attribute, decode, events, local
from docframe.limits import SHEET_CELLS, SHEET_ROWS, XML_DEPTH

MOST_COLUMNS = 16_384


def column_of(address: str) -> int:
    """Zero-based column of an address: A is 0, AA is 26."""
    n = 0
    for c in re.match("[A-Za-z]*", address)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(column: int) -> str:
    name, n = "", column + 1
    while n > 0:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


@dataclass(slots=True)
class Cell:
    address: str
    row: int
    column: int
    value: str
    formula: str | None = None
    error: str | None = None


@dataclass
class Sheet:
    name: str
    state: str
    rows: list[list[Cell]] = field(default_factory=list)


def shared_strings(xml: str | None) -> list[str]:
    """Each item is the text of all its runs."""
    out: list[str] = []
    item, inside = False, 0
    text = ""
    for kind, name, _, alone in events(xml or ""):
        tag = local(name) if kind != "text" else ""
        if kind == "text":
            text += name if inside else ""
        elif kind == "open":
            if tag == "si":
                item, text = True, ""
            elif tag == "t" and item and not alone:
                inside += 1
        elif tag == "t":
            inside = max(0, inside - 1)
        elif tag == "si":
            out.append(text)
            item, text = False, ""
    return out


def _value(kind: str, raw: str | None, shared: list[str]) -> str:
    if raw is None:
        return ""
    if kind != "s":
        return raw
    index = trim(raw) or "0"  # an empty index is taken for 0
    return shared[int(index)] if re.fullmatch(r"\+?[0-9]+(\.0*)?", index) and int(float(index)) < len(shared) else ""


_COLUMN = lru_cache(1024)(column_of)
#: Rows and cells as most programs write them: addresses first, attributes in double quotes, no blanks between tags.
_ROW_TAG = r'<row r="([0-9]{1,9})"(?: [A-Za-z]+="[^"<>]*")*>'
_CELL_TAG = r'<c r="([A-Z]{1,3})([0-9]{1,9})"(?: s="[0-9]+")?(?: t="([A-Za-z]+)")?(?:(/)>|>(?:<f>([^<]*)</f>)?(?:<v>([^<]*)</v>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)'
_PLAIN_TOKEN = re.compile(rf"{_ROW_TAG}|({_CELL_TAG})")
_PLAIN_ROWS = re.compile(re.sub(r"\((?!\?)", "(?:", rf"(?:{_ROW_TAG}(?:{_CELL_TAG})*</row>)*"))
#: Sheets of more characters are left to the scanner, which counts rows, cells and tags; so are those with more around their rows.
PLAIN_SHEET, SMALL_HEAD = 1_000_000, 4096


@lru_cache(256)
def _plain_around(head: str, tail: str) -> bool:
    """Whether ``head`` ends with the tag that opens the rows, and neither it nor ``tail`` holds any row, cell or content of one."""
    try:
        before, after = list(events(head)), list(events(tail))
    except Refused:
        return False
    tags = [(kind, local(name)) for kind, name, *_ in before + after if kind != "text"]
    return bool(before) and before[-1] == ("open", "sheetData", "", False) and len(tags) < XML_DEPTH - 8 and not {t for _, t in tags} & {"row", "c", "v", "t", "f"}


def _plain_sheet(xml: str, shared: list[str]) -> list[list[Cell]] | None:
    """What ``parse_sheet`` finds, if rows and cells are written plainly; else None."""
    at, end = xml.find("<sheetData>") + 11, xml.rfind("</sheetData>")
    if len(xml) > PLAIN_SHEET or not 11 <= at <= end or at > SMALL_HEAD or len(xml) - end > SMALL_HEAD or not _PLAIN_ROWS.fullmatch(xml, at, end) or not _plain_around(xml[:at], xml[end:]):
        return None
    rows: list[list[Cell]] = []
    row: list[Cell] = []
    number = 0
    for r, whole, letters, digits, kind, alone, formula, v, t in _PLAIN_TOKEN.findall(xml, at, end):
        if r:
            row, number = [], int(r) or len(rows) + 1
            rows.append(row)
            continue
        raw = None if alone or not (v or t or "<v>" in whole or "<t" in whole) else decode(v or t)
        value = raw or "" if kind != "s" else _value(kind, raw, shared)
        row.append(Cell(letters + digits, number, min(_COLUMN(letters), MOST_COLUMNS - 1), value, decode(formula) or None, value if kind == "e" else None))
    return rows


def parse_sheet(xml: str, shared: list[str]) -> list[list[Cell]]:
    plain = _plain_sheet(xml, shared)
    return _scanned_sheet(xml, shared) if plain is None else plain


def _scanned_sheet(xml: str, shared: list[str]) -> list[list[Cell]]:
    rows: list[list[Cell]] = []
    row: list[Cell] = []
    number = count = 0
    cell: dict | None = None
    into: str | None = None

    def finish(c: dict) -> None:
        value = _value(c["kind"], c["v"], shared)
        row.append(Cell(c["address"], number, c["column"], value, c["f"] or None, value if c["kind"] == "e" else None))

    for kind, name, attrs, alone in events(xml):
        if kind == "text":
            if cell is not None and into:
                cell[into] = (cell[into] or "") + name
            continue
        tag = local(name)
        if kind == "open":
            if tag == "row":
                r = attribute(attrs, "r") or ""
                row, number = [], (int(r) if r.isdigit() and int(r) else len(rows) + 1)
            elif tag == "c":
                count += 1
                if count > SHEET_CELLS:
                    raise Refused("INVALID_WORKBOOK", f"a worksheet has more than {SHEET_CELLS:,} cells")
                ref = attribute(attrs, "r")
                column = column_of(ref) if ref else (row[-1].column + 1 if row else 0)
                cell = {"kind": attribute(attrs, "t") or "", "address": ref or f"{column_name(column)}{number}", "column": min(max(column, 0), MOST_COLUMNS - 1), "v": None, "f": ""}
                into = None
                if alone:
                    finish(cell)
                    cell = None
            elif tag in ("v", "t") and not alone and cell is not None:
                cell["v"], into = cell["v"] or "", "v"
            elif tag == "f":
                into = None if alone else "f"
        elif tag in ("v", "t", "f"):
            into = None
        elif tag == "c" and cell is not None:
            finish(cell)
            cell = None
        elif tag == "row":
            rows.append(row)
            if len(rows) > SHEET_ROWS:
                raise Refused("INVALID_WORKBOOK", f"a worksheet has more than {SHEET_ROWS:,} rows")
            row = []
    return rows


def sheet_list(workbook: str | None, rels: str | None) -> list[tuple[str, str, str]]:
    """(name, part, state) in order; a part comes from the relationship, or else from the sheet's position."""
    targets = {}
    for m in re.finditer(r"<Relationship\b([^>]*)>", rels or ""):
        key, to = attribute(m[1], "Id"), attribute(m[1], "Target")
        if key and to:
            targets[key] = "xl/" + re.sub(r"\A/?(?:xl/)?", "", to)
    out: list[tuple[str, str, str]] = []
    for m in re.finditer(r"<(?:\w+:)?sheet\b([^>]*)/?>", workbook or ""):
        if name := attribute(m[1], "name"):
            state = attribute(m[1], "state")
            part = targets.get(attribute(m[1], "r:id") or attribute(m[1], "id") or "")
            out.append((name, part or f"xl/worksheets/sheet{len(out) + 1}.xml", state if state in ("hidden", "veryHidden") else "visible"))
    return out


def _sheet_list(workbook: str | None, rels: str | None) -> list[tuple[str, str, str]]:
    return (_small_sheet_list if len(workbook or "") + len(rels or "") <= SMALL_HEAD else sheet_list)(workbook, rels)


_small_sheet_list = lru_cache(64)(sheet_list)


def read_workbook(data: bytes, hidden: bool = False, some: bool = True) -> tuple[list[Sheet], dict]:
    """Sheets that are asked for, and what there is to know of the workbook; only their parts are inflated. some: refused if none can be read."""
    p = Package(data)
    listed = _sheet_list(p.text("xl/workbook.xml"), p.text("xl/_rels/workbook.xml.rels"))
    wanted = [s for s in listed if (hidden or s[2] == "visible") and s[1] in p.names]
    if not (wanted if some else listed):
        raise Refused("INVALID_WORKBOOK", "this workbook has no worksheet that can be read")
    shared = shared_strings(p.text("xl/sharedStrings.xml"))
    sheets = [Sheet(n, state, parse_sheet(p.text(part) or "", shared)) for n, part, state in wanted]
    facts = {"total_sheets": len(listed), "hidden_sheets": sum([s != "visible" for *_, s in listed]), "external_links": sum([n.startswith("xl/externalLinks/") and bool(re.match(r"xl/externalLinks/[^/]+\.xml\Z", n)) for n in p.names]), "macros": "xl/vbaProject.bin" in p.names}
    return sheets, facts


def row_text(row: list[Cell]) -> str:
    """A row's values by column, gaps kept, empty cells at the end dropped."""
    width = max((c.column for c in row), default=-1) + 1
    grid = [""] * width
    for c in row:
        grid[c.column] = c.value
    return re.sub(r"(?:\s*\|)+\Z", "", trim(" | ".join(grid)))


def workbook_text(data: bytes, budget: int) -> dict:
    """Whole rows as far as the budget goes."""
    sheets, facts = read_workbook(data)
    out: list[str] = []
    kept = total = used = 0
    full = False
    for s in sheets:
        if not full:
            out += [*([""] if out else []), f"## {s.name}"]
            used += units(s.name) + 4
        for row in s.rows:
            total += 1
            line = row_text(row)
            if full or used + units(line) + 1 > budget:
                full = True
                continue
            out.append(line)
            used += units(line) + 1
            kept += 1
    return {"text": "\n".join(out).strip(), "sheets": len(sheets), "rows": kept, "total_rows": total, **facts}


def inspection_line(cell: Cell, mode: str) -> str | None:
    """What an inspection says of a cell, or None if the mode leaves it out."""
    if cell.formula and mode != "values":
        return f"{cell.address}: ={cell.formula}" + ("" if mode == "formulas" else f" → {cell.value}" + (f" ({cell.error})" if cell.error else ""))
    return None if mode == "formulas" else f"{cell.address}: {cell.value}"


def inspection(data: bytes, mode: str, hidden: bool, cells: int, budget: int) -> dict:
    """{text, complete, warnings, facts...}: addressed cells under one bound of cells and one of UTF-16 units, both over all sheets."""
    sheets, facts = read_workbook(data, hidden, some=False)
    out: list[str] = []
    left, used, complete = cells, 0, True
    for s in sheets:
        heading = f"## {s.name}" + ("" if s.state == "visible" else f" [{s.state}]")
        if not left or used + units(heading) + 1 > budget:
            complete = False
            break
        out.append(heading)
        used += units(heading) + 1
        own = [c for row in s.rows for c in row]
        complete = len(own) <= left
        for c in own[:left]:
            if line := inspection_line(c, mode):
                used += units(line) + 1
                if used > budget:
                    complete = False
                    break
                out.append(line)
        left = max(0, left - len(own))
        out.append("")
        used += 1
        if not complete:
            break
    warnings = []
    if facts["hidden_sheets"] and not hidden:
        warnings.append(f"{facts['hidden_sheets']} hidden sheet(s) were omitted.")
    if facts["external_links"]:
        warnings.append(f"{facts['external_links']} external workbook link part(s) were detected but not followed.")
    if facts["macros"]:
        warnings.append("A VBA project was detected but not executed.")
    warnings.append("Formulas were read as text and were not recalculated.")
    return {"text": "\n".join(out).strip(), "complete": complete, "warnings": warnings, **facts}
