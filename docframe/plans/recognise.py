"""What a section's blocks say by their shape: cards, metrics, quote, comparison, process, timeline."""

from __future__ import annotations

import re

from docframe.kernels.markdown import plain

# Limits and patterns of the shapes.
CARD_BODY, METRIC, METRIC_VALUE, METRIC_WORDS = 160, 44, 12, 4
ATTRIBUTION, COMPARE_LINES, STEP, MILESTONE = 80, 6, 48, 40
VERSUS = re.compile(r"(^|\s)vs\.?(\s|$)|비교", re.I)
WHEN = re.compile(r"(20[0-9]{2}년?|q[1-4]|[0-9]{1,2}월|[0-9]{1,2}분기|[0-9]{1,2}주차?)\Z", re.I)


def _sole(blocks: list[dict], kind: str) -> dict | None:
    return blocks[0] if len(blocks) == 1 and blocks[0]["kind"] == kind else None


def _flat(blocks: list[dict], ordered: bool, least: int, most: int) -> list[str] | None:
    b = _sole(blocks, "list")
    if b and b["ordered"] == ordered and least <= len(b["items"]) <= most and not any(i["depth"] for i in b["items"]):
        return [plain(i["runs"]) for i in b["items"]]
    return None


def cards(blocks: list[dict], title: str = "") -> dict | None:
    found: list[list[str]] = []
    for b in blocks:
        if b["kind"] == "heading" and b["level"] >= 3:
            found.append([plain(b["runs"])])
        elif b["kind"] == "paragraph" and found and len(found[-1]) == 1 and len(plain(b["runs"])) <= CARD_BODY:
            found[-1].append(plain(b["runs"]))
        else:
            return None
    return {"kind": "cards", "items": found} if 2 <= len(found) <= 4 else None


def metrics(blocks: list[dict], title: str = "") -> dict | None:
    items = _flat(blocks, False, 2, 4)
    out = []
    for text in items or []:
        words = text.split()
        if len(text) > METRIC or not 2 <= len(words) <= METRIC_WORDS + 1:
            return None
        figure = lambda w: len(w) <= METRIC_VALUE and any(c.isdigit() for c in w)
        if figure(words[0]):
            out.append([words[0], " ".join(words[1:])])
        elif figure(words[-1]):
            out.append([words[-1], " ".join(words[:-1])])
        else:
            return None
    return {"kind": "metrics", "items": out} if out else None


def quote(blocks: list[dict], title: str = "") -> dict | None:
    if not 1 <= len(blocks) <= 2 or blocks[0]["kind"] != "quote":
        return None
    by = plain(blocks[1]["runs"]) if len(blocks) == 2 and blocks[1]["kind"] == "paragraph" else None
    if len(blocks) == 2 and (by is None or len(by) > ATTRIBUTION or by[:1] not in ("—", "–", "-")):
        return None
    return {"kind": "quote", "items": [[plain(blocks[0]["runs"]), *([by] if by else [])]]}


def comparison(blocks: list[dict], title: str = "", forced: bool = False) -> dict | None:
    if not forced and not VERSUS.search(title):
        return None
    columns: list[list[str]] = []
    for b in blocks:
        if b["kind"] == "heading" and b["level"] >= 3:
            columns.append([plain(b["runs"])])
        elif b["kind"] in ("paragraph", "list") and columns:
            columns[-1] += [plain(i["runs"]) for i in b["items"]] if b["kind"] == "list" else [plain(b["runs"])]
        else:
            return None
    ok = len(columns) == 2 and all(1 <= len(c) - 1 <= COMPARE_LINES for c in columns)
    return {"kind": "comparison", "items": columns} if ok else None


def timeline(blocks: list[dict], title: str = "") -> dict | None:
    out = []
    for text in _flat(blocks, True, 3, 6) or []:
        when, _, what = text.strip().partition(" ")
        if not WHEN.match(when) or not what.strip() or len(what.strip()) > MILESTONE:
            return None
        out.append([when, what.strip()])
    return {"kind": "timeline", "items": out} if out else None


def process(blocks: list[dict], title: str = "") -> dict | None:
    items = _flat(blocks, True, 3, 5)
    return {"kind": "process", "items": [[x] for x in items]} if items and all(len(x) <= STEP for x in items) else None


SHAPES = (comparison, cards, metrics, timeline, process, quote)


def recognise(blocks: list[dict], title: str = "") -> dict | None:
    """The first shape that fits."""
    return next((got for f in SHAPES if (got := f(blocks, title))), None)


def force(name: str, blocks: list[dict]) -> dict | None:
    """The shape a directive names; only the title is not asked for."""
    f = {x.__name__: x for x in SHAPES}.get(name)
    return (comparison(blocks, forced=True) if name == "comparison" else f(blocks)) if f else None
