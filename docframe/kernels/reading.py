"""Bytes of a known format to a read result."""

from __future__ import annotations

from docframe.kernels import hwp, rtf, sheets
from docframe.kernels.errors import Refused
from docframe.kernels.flow import DOCX, HWPX, ODF, PPTX, lines_of
from docframe.kernels.lines import cut, normalize, units
from docframe.kernels.package import Package
from docframe.limits import TEXT_CHARS

# What each reader leaves out.
OMITS = {
    "docx": ("headers", "footers", "footnotes", "comments", "tracked deletions", "formatting"),
    "hwpx": ("formatting",),
    "hwp": ("formatting",),
    "xlsx": ("formulas", "cell formatting", "comments", "macros"),
    "pptx": ("speaker notes", "comments", "animations", "formatting"),
    "odf": ("formatting", "headers", "footers"),
    "rtf": ("headers", "footers", "formatting"),
}
_ODF_KINDS = {"text": None, "spreadsheet": ("table", "Sheet", "table:name", "sheet"), "presentation": ("page", "Slide", None, "slide")}


def read(data: bytes, form: str, budget: int = TEXT_CHARS) -> dict:
    """{text, note, complete, omissions, counts}; raises Refused."""
    counts: dict[str, int] = {}
    omits = list(OMITS.get(form, ()))
    if form == "xlsx":
        got = sheets.workbook_text(data, budget)
        if not got["rows"]:  # every sheet empty, or the first row alone beyond the budget
            raise Refused("INVALID_DOCUMENT", "it has no readable cells")
        counts = {"sheets": got["sheets"], "totalSheets": got["total_sheets"], "hiddenSheets": got["hidden_sheets"], "rows": got["rows"], "totalRows": got["total_rows"]}
        if got["hidden_sheets"]:
            omits.append("hidden sheets")
        whole = got["rows"] == got["total_rows"]
        note = f"all {got['sheets']} visible sheet(s), {got['rows']} row(s)" if whole else f"{got['rows']} of {got['total_rows']} row(s) across {got['sheets']} visible sheet(s)"
        return {"text": got["text"], "note": note, "complete": whole and got["sheets"] == got["total_sheets"] - got["hidden_sheets"], "omissions": omits, "counts": counts}
    if form == "rtf":
        body = rtf.text_of(data)
        if body is None:
            raise Refused("INVALID_DOCUMENT", "it does not begin with an RTF header")
        text, note = normalize(body.split("\n")), "the document body, without headers or footers"
    elif form == "hwp":
        got, n, version = hwp.lines(data)
        text, counts, note = normalize(got), {"sections": n}, f"all {n} section(s) of an HWP {version} document"
    else:
        p = Package(data)
        if form == "docx":
            xml = p.text("word/document.xml")
            if xml is None:
                raise Refused("INVALID_DOCUMENT", "this .docx has no body")
            text, note = normalize(lines_of(xml, DOCX)[0]), "the document body, without headers, footers or footnotes"
        elif form == "hwpx":
            names = p.numbered(r"Contents/section(\d+)\.xml")
            if not names:
                raise Refused("INVALID_DOCUMENT", "this .hwpx has no body")
            text = normalize([x for n in names for x in normalize(lines_of(p.text(n) or "", HWPX)[0]).split("\n")])
            counts, note = {"sections": len(names)}, f"all {len(names)} section(s)"
        elif form == "pptx":
            names = p.numbered(r"ppt/slides/slide(\d+)\.xml")
            if not names:
                raise Refused("INVALID_DOCUMENT", "this deck has no slides")
            text = normalize([x for k, n in enumerate(names, 1) for x in (f"## Slide {k}", *lines_of(p.text(n) or "", PPTX)[0], "")])
            counts, note = {"slides": len(names)}, f"all {len(names)} slide(s), without speaker notes"
        elif form == "odf":
            kind = (p.text("mimetype") or "").strip().removeprefix("application/vnd.oasis.opendocument.")
            if kind not in _ODF_KINDS or p.text("content.xml") is None:
                raise Refused("INVALID_DOCUMENT", "the package does not say which kind of OpenDocument file it is")
            mark = _ODF_KINDS[kind]
            got, n = lines_of(p.text("content.xml") or "", ODF, {mark[0]: mark[1:3]} if mark else None)
            text = normalize(got)
            counts = {f"{mark[3]}s": n} if mark else {}
            note = f"all {n} {mark[3]}(s)" if mark else "the document body, without headers or footers"
        else:
            raise Refused("UNSUPPORTED_FORMAT", f"{form} is not read")
    if not text and form != "pptx":
        raise Refused("INVALID_DOCUMENT", "it has no readable text")
    if (n := units(text)) > budget:
        kept = cut(text, budget)
        return {"text": kept, "note": f"the first {budget:,} of {n:,} characters", "complete": False, "omissions": omits, "counts": counts}
    return {"text": text, "note": note, "complete": True, "omissions": omits, "counts": counts}
