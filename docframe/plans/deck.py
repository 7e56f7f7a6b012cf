"""Sections to slides: costed pieces, packed in order."""

from __future__ import annotations

import math
import re

from docframe.kernels.images import figure
from docframe.kernels.markdown import plain
from docframe.plans.recognise import force, recognise

# A body slide's lines, a line's columns, an indent's columns, a table row's lines.
BODY_LINES, COLUMNS, INDENT, ROW_LINES, CLOSING_LINES = 14, 45, 2, 1.5, 4
FIGURE_LINES = 10
WIDE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6))) + "]")
CLOSING = re.compile(r"(감사합니다|thank you|thanks|q\s*&\s*a|질문)", re.I)


def width(text: str) -> float:
    """Columns: a wide character takes one, any other a half."""
    return (len(text) + len(WIDE.findall(text))) / 2


def lines(text: str, indent: int = 0, before: bool = False) -> int:
    return max(1, math.ceil(width(text) / max(1, COLUMNS - INDENT * indent))) + before


def table_cost(rows: int) -> int:
    return math.ceil(ROW_LINES * (rows + 1))


def pieces(blocks: list[dict]) -> list[dict]:
    """A section's blocks as costed pieces; list numbers restart below each shallower item."""
    out: list[dict] = []
    for b in blocks:
        if b["kind"] == "list":
            counters: list[int] = []
            for k, i in enumerate(b["items"]):
                counters = (counters + [0] * 5)[: i["depth"] + 1]
                counters[i["depth"]] += 1
                mark = f"{counters[i['depth']]}. " if b["ordered"] else "• "
                out.append({"kind": "item", "text": mark + plain(i["runs"]), "indent": i["depth"], "cost": lines(plain(i["runs"]), i["depth"], k == 0)})
        elif b["kind"] == "table":
            rows = [[plain(c) for c in r] for r in b["rows"]]
            out.append({"kind": "table", "header": [plain(c) for c in b["header"]], "rows": rows, "cost": table_cost(len(rows))})
        elif b["kind"] == "code":
            out += [{"kind": "code", "text": x, "indent": 0, "cost": lines(x)} for x in b["text"].split("\n")]
        elif b["kind"] != "rule" and b.get("runs"):
            out.append({"kind": "heading" if b["kind"] == "heading" else b["kind"], "text": plain(b["runs"]), "indent": 0, "cost": FIGURE_LINES if figure(b) else lines(plain(b["runs"]), 0, True), "pos": b["pos"]})
    return out


def pack(todo: list[dict], room: int = BODY_LINES) -> list[list[dict]]:
    """Slides of at most ``room`` lines, as full as order allows. A sub-heading is not left behind; a table may be cut."""
    todo = list(todo)
    slides: list[list[dict]] = []
    now: list[dict] = []
    while todo:
        p = todo[0]
        left = room - sum(x["cost"] for x in now)
        if p["cost"] <= left:
            now.append(todo.pop(0))
            continue
        if p["kind"] == "table" and left > 0:
            take = max(1, math.floor(left / ROW_LINES) - 1)
            if take < len(p["rows"]) and table_cost(take) <= left:
                head, rest = ({**p, "rows": r, "cost": table_cost(len(r))} for r in (p["rows"][:take], p["rows"][take:]))
                slides.append([*now, head])
                now, todo[0] = [], rest
                continue
        if not now:
            slides.append([todo.pop(0)])
            continue
        last = max((k for k, x in enumerate(now) if x["kind"] == "heading"), default=0)
        keep, carried = (now[:last], now[last:]) if last > 0 else (now, [])
        slides.append(keep)
        now, todo = [], carried + todo
    return slides + ([now] if now else [])


def plan(blocks: list[dict], title: str = "") -> list[dict]:
    """Slides: {type, title, pieces or semantic}."""
    top = [b for b in blocks if b["depth"] == 0]
    slides: list[dict] = []
    sections: list[tuple[dict | None, list[dict]]] = []
    for b in top:
        if b["kind"] == "heading" and b["level"] <= 2:
            sections.append((b, []))
        else:
            if not sections:
                sections.append((None, []))
            sections[-1][1].append(b)
    chapter = 0
    for k, (head, body) in enumerate(sections):
        name = plain(head["runs"]) if head else title
        if head and head["level"] == 1:
            if k == 0:
                slides.append({"type": "cover", "title": name, "subtitle": plain(body[0]["runs"]) if body and body[0]["kind"] == "paragraph" else ""})
                body = body[1:] if body and body[0]["kind"] == "paragraph" else body
            else:
                chapter += 1
                slides.append({"type": "section", "title": name, "number": chapter})
        if not body:
            if head and head["level"] == 2:
                slides.append({"type": "content", "title": name, "pieces": []})
            continue
        if k == len(sections) - 1 and k and CLOSING.search(name) and sum(p["cost"] for p in pieces(body)) <= CLOSING_LINES:
            slides.append({"type": "closing", "title": name, "pieces": pieces(body)})
            continue
        named = body[0] if len(body) == 1 and body[0]["kind"] == "directive" else None
        inner = [b for b in blocks if named and b["parent_pos"] == named["pos"]]
        shape = force(named["name"], inner) if named else recognise(body, name)
        if shape:
            slides.append({"type": shape["kind"], "title": name, "items": shape["items"]})
            continue
        for n, part in enumerate(pack(pieces([x for b in body for x in ([y for y in blocks if y["parent_pos"] == b["pos"]] if b["kind"] == "directive" else [b])]))):
            first = part[0] if part and part[0]["kind"] == "heading" and n else None
            slides.append({"type": "content", "title": name if not n else f"{name} — {first['text']}" if first else f"{name} (계속)", "pieces": part[1:] if first else part})
    return slides
