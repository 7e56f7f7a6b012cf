"""Typed rows to a workbook."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from docframe.kernels.errors import Refused
from docframe.kernels.package import build
from docframe.kernels.sheets import column_name
from docframe.limits import SHEET_CELLS, SHEET_ROWS, SHEETS
from docframe.writers.common import HEAD, PROPERTY_LINKS, PROPERTY_TYPES, REL, content_types, properties, relationships, xml

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def number(x: float) -> str:
    """The shortest decimal that reads back as x, written as spreadsheets and scripts do."""
    if float(x).is_integer() and abs(x) < 1e21:
        return str(int(x))
    m, _, e = repr(float(x)).partition("e")
    if e:
        k = int(e)
        if -7 < k < 0:
            digits = m.replace(".", "").replace("-", "")
            return ("-" if x < 0 else "") + "0." + "0" * (-k - 1) + digits
        return f"{m.removesuffix('.0')}e{k:+d}"
    return m


def check(sheets: list[dict]) -> None:
    bad = lambda why: Refused("INVALID_WORKBOOK", why, "sheets")
    if not 1 <= len(sheets) <= SHEETS:
        raise bad(f"a workbook has 1 to {SHEETS} sheets")
    names, total = set(), 0
    for s in sheets:
        n = s["name"] or ""
        if not 1 <= len(n) <= 31 or re.search(r"[\\/:?*\[\]]", n) or n.startswith("'") or n.endswith("'"):
            raise bad(f"{n!r} can't name a sheet")
        if n.lower() in names:
            raise bad(f"two sheets are named {n!r}")
        names.add(n.lower())
        if len(s["rows"]) > SHEET_ROWS:
            raise bad(f"a sheet has more than {SHEET_ROWS:,} rows")
        total += sum(map(len, s["rows"]))
    if total > SHEET_CELLS:
        raise bad(f"the workbook has more than {SHEET_CELLS:,} cells")


def _scalar(v) -> tuple[str, str]:
    """(attributes, content) of a value."""
    if isinstance(v, bool):
        return ' t="b"', f"<v>{int(v)}</v>"
    if isinstance(v, (int, float)):
        if not math.isfinite(v):
            raise Refused("INVALID_WORKBOOK", "numbers must be finite", "sheets")
        return "", f"<v>{number(v)}</v>"
    return ' t="inlineStr"', f'<is><t xml:space="preserve">{xml(str(v))}</t></is>'


def _cell(v, at: str, style: str) -> str:
    if type(v) is str:
        return f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{xml(v)}</t></is></c>'
    if v is None:
        return f'<c r="{at}"{style}/>'
    if isinstance(v, dict):
        formula = f"<f>{xml(v['formula'].removeprefix('='))}</f>"
        cached = v.get("cached")
        if cached is None:
            return f'<c r="{at}"{style}>{formula}</c>'
        if isinstance(cached, str):
            return f'<c r="{at}"{style} t="str">{formula}<v>{xml(cached)}</v></c>'
        attrs, body = _scalar(cached)
        return f'<c r="{at}"{style}{attrs}>{formula}{body}</c>'
    attrs, body = _scalar(v)
    return f'<c r="{at}"{style}{attrs}>{body}</c>'


def _shown(v) -> str:
    if isinstance(v, dict):
        v = v.get("cached")
    return "" if v is None else str(v)


_column_name = lru_cache(1024)(column_name)


def _sheet(rows: list[list]) -> str:
    sizes = [10] * max(map(len, rows), default=0)
    for r in rows:
        for k, v in enumerate(r):
            if (n := len(v if type(v) is str else _shown(v)) + 2) > sizes[k]:
                sizes[k] = min(60, n)
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(sizes, 1))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if len(rows) > 1 else ""
    body = "".join(f'<row r="{i}">' + "".join([_cell(v, f"{_column_name(k)}{i}", ' s="1"' if i == 1 else "") for k, v in enumerate(r)]) + "</row>" for i, r in enumerate(rows, 1))
    return f'{HEAD}<worksheet xmlns="{MAIN}">{pane}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{body}</sheetData></worksheet>'


@lru_cache(SHEETS)
def _frame(n: int) -> dict[str, str]:
    """The parts that depend on the number of sheets alone, and the workbook's place among them."""
    kind, ns = "officedocument.spreadsheetml.", range(1, n + 1)
    styles = f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
    return {
        "[Content_Types].xml": content_types({"xl/workbook.xml": f"{kind}sheet.main+xml", "xl/styles.xml": f"{kind}styles+xml"} | PROPERTY_TYPES | {f"xl/worksheets/sheet{i}.xml": f"{kind}worksheet+xml" for i in ns}),
        "_rels/.rels": relationships([("rId1", f"{REL}/officeDocument", "xl/workbook.xml", False), *PROPERTY_LINKS]),
        "xl/workbook.xml": "",
        "xl/_rels/workbook.xml.rels": relationships([*[(f"rId{i}", f"{REL}/worksheet", f"worksheets/sheet{i}.xml", False) for i in ns], (f"rId{n + 1}", f"{REL}/styles", "styles.xml", False)]),
        "xl/styles.xml": styles,
    }


def render(sheets: list[dict], title: str = "workbook") -> bytes:
    """sheets: {name, rows}; a cell is None, text, number, truth value or {formula, cached}."""
    check(sheets)
    frame = _frame(len(sheets))
    listed = "".join(f'<sheet name="{xml(s["name"])}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
    book = f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets><calcPr fullCalcOnLoad="1"/></workbook>'
    return build(frame | {"xl/workbook.xml": book} | properties(title) | {f"xl/worksheets/sheet{i}.xml": _sheet(s["rows"]) for i, s in enumerate(sheets, 1)})
