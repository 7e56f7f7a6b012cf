"""Shared by the writers of packages."""

from __future__ import annotations

import math
import re

from docframe.kernels.xmlscan import escape

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f" + chr(0xFFFE) + chr(0xFFFF) + "]")

# Body and first heading size (points), brand and ink colour of each design profile.
PROFILES = {"executive": (11, 20, "17324D", "18222B"), "consulting": (11, 20, "0B2D4D", "17232D"), "formal": (11, 20, "334E68", "20252A"), "technical": (11, 20, "0F4C5C", "162629"), "standard": (11, 20, "1F4E79", "212529")}
# Length of the cover's rule (points) by profile.
COVER_RULES = {"executive": 48, "consulting": 72, "formal": 36, "technical": 42, "standard": 60}


def xml(text: str) -> str:
    """Escaped, without characters that XML can't hold."""
    return text if text.isalnum() else escape(_CONTROL.sub("", text))


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def relationships(items: list[tuple[str, str, str, bool]]) -> str:
    """(id, type, target, external)."""
    rows = "".join(f'<Relationship Id="{i}" Type="{t}" Target="{xml(to)}"{" TargetMode=\"External\"" if out else ""}/>' for i, t, to, out in items)
    return f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def content_types(parts: dict[str, str], extra: tuple[str, ...] = ()) -> str:
    base = "application/vnd.openxmlformats-"
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    defaults += "".join(f'<Default Extension="{e}" ContentType="image/{"jpeg" if e == "jpg" else e}"/>' for e in extra)
    rows = "".join(f'<Override PartName="/{n}" ContentType="{base}{t}"/>' for n, t in parts.items())
    return f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{defaults}{rows}</Types>'


PACKAGE = "http://schemas.openxmlformats.org/package/2006"
# Content types and root relationships of the two property parts.
PROPERTY_TYPES = {"docProps/core.xml": "package.core-properties+xml", "docProps/app.xml": "officedocument.extended-properties+xml"}
PROPERTY_LINKS = [("rIdCore", f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml", False), ("rIdApp", f"{REL}/extended-properties", "docProps/app.xml", False)]


def properties(title: str) -> dict[str, str]:
    """The parts with a document's title and the program's name."""
    return {
        "docProps/core.xml": f'{HEAD}<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{xml(title)}</dc:title></cp:coreProperties>',
        "docProps/app.xml": f'{HEAD}<Properties xmlns="{REL.rsplit("/", 1)[0]}/extended-properties"><Application>docframe</Application></Properties>',
    }


def column_shares(rows: list[list[str]]) -> list[float]:
    """Share of the width for each column: by its longest text, within bounds."""
    n = max(map(len, rows), default=1)
    need = [max(4, *(len(r[k]) if k < len(r) else 0 for r in rows)) for k in range(n)]
    bounded = [min(0.6, max(0.1, x / sum(need))) for x in need]
    return [x / sum(bounded) for x in bounded]
