"""Marked-up body text to lines: one machine, and a table of what each dialect's elements mean."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from docframe.kernels.xmlscan import attribute, events, local


@dataclass(frozen=True)
class Dialect:
    inside: frozenset[str] = frozenset()  # text counts only in these; everywhere if none
    skipped: frozenset[str] = frozenset()  # nothing in these counts
    insert: dict[str, str] = field(default_factory=dict)  # element -> characters
    paragraph: frozenset[str] = frozenset()
    wrap: str = ""  # what a paragraph's end leaves within a cell
    cell: str = "tc"
    row: str = "tr"
    prefixed: bool = False  # names are compared with their prefix
    split: bool = True  # line breaks within a paragraph end lines
    empty_cell: bool = True  # a cell without content opens (and never closes)


DOCX = Dialect(frozenset({"w:t"}), insert={"w:tab": "\t", "w:br": "\n", "w:cr": "\n"}, paragraph=frozenset({"w:p"}), wrap=" ", cell="w:tc", row="w:tr", prefixed=True)
PPTX = Dialect(frozenset({"t"}), frozenset({"fld"}), {"br": "\n"}, frozenset({"p"}), split=False)
HWPX = Dialect(frozenset({"t"}), insert={"tab": "\t", "lineBreak": "\n"}, paragraph=frozenset({"p"}), wrap=" ")
ODF = Dialect(insert={"tab": "\t", "line-break": "\n"}, paragraph=frozenset({"p", "h"}), cell="table-cell", row="table-row", split=False, empty_cell=False)
SEPARATOR = " | "


def lines_of(xml: str, d: Dialect, headings: dict[str, tuple[str, str | None]] | None = None) -> tuple[list[str], int]:
    """Lines, and how many elements of ``headings`` ({element: (word, attribute that names it)}) began."""
    lines: list[str] = []
    text, lead = "", ""
    open_text = open_skip = open_cell = parts = 0

    def end() -> None:
        nonlocal text, lead
        whole, text, lead = lead + text, "", ""
        lines.extend(whole.split("\n") if d.split else [whole])

    for kind, name, attrs, alone in events(xml):
        if kind == "text":
            if not open_skip and (open_text or not d.inside):
                text += name
            continue
        if not d.prefixed:
            name = local(name)
        if kind == "open":
            if name in d.inside:
                open_text += not alone
            elif name in d.skipped:
                open_skip += not alone
            elif name in d.insert:
                text += d.insert[name]
            elif name == d.cell:
                open_cell += d.empty_cell or not alone
            elif d is ODF and name == "s":
                n = attribute(attrs, "text:c") or "1"
                text += " " * (min(int(n), 80) if n.isdigit() and int(n) else 1)
            elif headings and name in headings:
                word, label = headings[name]
                parts += 1
                end()
                lines.append("## " + ((label and attribute(attrs, label)) or f"{word} {parts}"))
            elif d is DOCX and name == "w:p":
                lead = ""
            elif d is DOCX and name == "w:numPr":
                lead = "- "
            elif d is DOCX and name == "w:pStyle" and (m := re.fullmatch(r"[Hh]eading\s*([1-6])", attribute(attrs, "w:val") or "")):
                lead = "#" * int(m[1]) + " "
        elif name in d.inside:
            open_text = max(0, open_text - 1)
        elif name in d.skipped:
            open_skip = max(0, open_skip - 1)
        elif name == d.cell:
            open_cell = max(0, open_cell - 1)
            text += SEPARATOR
        elif name == d.row:
            end()
        elif name in d.paragraph:
            if open_cell:
                text += d.wrap
            else:
                end()
    end()
    return lines, parts
