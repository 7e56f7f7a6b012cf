"""Markdown to a flat list of blocks in pre-order (pos, depth, parent_pos)."""

from __future__ import annotations

import re

from docframe.kernels.lines import SPACE, trim

MOST_DEPTH = 4
_S = f"[{SPACE}]"
# What a line has to look like to begin a block.
HEADING = re.compile(rf"(#{{1,6}}){_S}+(.*)\Z")
RULE = re.compile(rf"{_S}{{0,3}}(?:-{{3,}}|\*{{3,}}|_{{3,}}){_S}*\Z")
FENCE = re.compile(rf"{_S}{{0,3}}(`{{3,}}|~{{3,}}){_S}*([^`{SPACE}]*)")
DIRECTIVE = re.compile(rf":::{_S}*([a-z][a-z-]*)?{_S}*\Z")
QUOTE = re.compile(rf"{_S}{{0,3}}>{_S}?(.*)\Z")
ITEM = re.compile(rf"({_S}*)(?:[-*+]|([0-9]{{1,9}})[.)]){_S}+(.*)\Z")
DIVIDER = re.compile(rf"{_S}*\|?(?:{_S}*:?-+:?{_S}*\|)+{_S}*:?-+:?{_S}*\|?{_S}*\Z")
_LINK = rf"\[([^\]]*)\]\({_S}*(<[^>]*>|[^){SPACE}]*)(?:{_S}+\"[^\"]*\")?{_S}*\)"
_INLINE = re.compile(rf"\\(?P<literal>[\\`*_{{}}\[\]()#+\-.!|>~])|(?P<ticks>`+)(?P<code>[\s\S]*?)(?P=ticks)|!(?P<image>{_LINK})|(?P<link>{_LINK})|(?P<mark>\*\*|__|\*|_)(?=[^{SPACE}])(?P<inner>[\s\S]+?)(?<=[^{SPACE}])(?P=mark)")
STYLE = {"bold": False, "italic": False, "code": False, "href": None}


def _word(c: str) -> bool:
    return c == "_" or c.isalpha() or c.isnumeric()


def inline(text: str, style: dict | None = None, depth: int = 0) -> list[dict]:
    """Runs of equal style: {text, bold, italic, code, href}."""
    style = style or STYLE
    runs: list[dict] = []

    def add(piece: str, **more) -> None:
        own = {**style, **more}
        if piece and runs and all(runs[-1][k] == own[k] for k in STYLE):
            runs[-1]["text"] += piece
        elif piece:
            runs.append({"text": piece, **own})

    def nest(piece: str, **more) -> None:
        for r in inline(piece, {**style, **more}, depth + 1):
            add(r["text"], **{k: r[k] for k in STYLE})

    at = 0
    while at < len(text):
        m = _INLINE.match(text, at)
        if m and m["mark"] and (depth >= MOST_DEPTH or m["mark"][0] == "_" and at and _word(text[at - 1])):
            m = None
        if not m:
            nxt = re.compile(r"[\\`!\[*_]").search(text, at + 1)
            stop = nxt.start() if nxt else len(text)
            add(text[at:stop])
            at = stop
            continue
        at = m.end()
        if m["literal"]:
            add(m["literal"])
        elif m["ticks"]:
            add(trim(m["code"]), code=True)
        elif m["image"] or m["link"]:
            label, href = re.fullmatch(_LINK, m["image"] or m["link"]).groups()
            href = href.removeprefix("<").removesuffix(">")
            if m["image"]:
                add(label or "image", href=href)
            else:
                nest(label or href, href=href)
        else:
            nest(m["inner"], **{"bold" if len(m["mark"]) == 2 else "italic": True})
    return runs


def plain(runs: list[dict]) -> str:
    return "".join(r["text"] for r in runs)


def cells(line: str) -> list[str]:
    return [trim(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", trim(line).removeprefix("|").removesuffix("|"))]


def _align(cell: str) -> str:
    return {(True, True): "center", (False, True): "right"}.get((cell.startswith(":"), cell.endswith(":")), "left")


def parse(source: str) -> list[dict]:
    out: list[dict] = []
    _blocks(re.sub(r"\r\n?", "\n", source).split("\n"), 0, -1, out)
    return out


def _kind(line: str, depth: int) -> tuple[str, re.Match | None]:
    """The block that a line would begin, tables aside."""
    if not trim(line):
        return "blank", None
    for name, pattern in (("code", FENCE), ("directive", DIRECTIVE), ("heading", HEADING), ("rule", RULE), ("quote", QUOTE), ("list", ITEM)):
        m = pattern.match(line)
        if m and not (name == "directive" and (depth >= MOST_DEPTH or not m[1])):
            return name, m
    return "paragraph", None


def _blocks(lines: list[str], depth: int, parent: int, out: list[dict]) -> None:
    at = 0

    def put(kind: str, **more) -> None:
        out.append({"pos": len(out), "depth": depth, "parent_pos": parent, "kind": kind, **more})

    while at < len(lines):
        kind, m = _kind(lines[at], depth)
        start, at = at, at + 1
        if kind == "code":
            while at < len(lines) and not lines[at].lstrip().startswith(m[1]):
                at += 1
            put("code", text="\n".join(lines[start + 1 : at]), language=m[2] or None)
            at += 1
        elif kind == "directive":
            while at < len(lines) and not ((c := DIRECTIVE.match(lines[at])) and not c[1]):
                at += 1
            put("directive", name=m[1])
            _blocks(lines[start + 1 : at], depth + 1, out[-1]["pos"], out)
            at += 1
        elif kind == "heading":
            put("heading", level=len(m[1]), runs=inline(m[2]))
        elif kind == "rule":
            put("rule")
        elif kind == "quote":
            while at < len(lines) and QUOTE.match(lines[at]):
                at += 1
            put("quote", runs=inline(trim(" ".join(QUOTE.match(x)[1] for x in lines[start:at]))))
        elif kind == "list":
            items = []
            at = start
            while at < len(lines) and (i := ITEM.match(lines[at])) and (i[2] is None) == (m[2] is None):
                items.append({"depth": min(len(i[1]) // 2, MOST_DEPTH), "runs": inline(i[3])})
                at += 1
            put("list", ordered=m[2] is not None, items=items)
        elif kind == "paragraph" and "|" in lines[start] and at < len(lines) and DIVIDER.match(lines[at]):
            at += 1
            while at < len(lines) and "|" in lines[at] and trim(lines[at]):
                at += 1
            put("table", align=[_align(c) for c in cells(lines[start + 1])], header=[inline(c) for c in cells(lines[start])], rows=[[inline(c) for c in cells(x)] for x in lines[start + 2 : at]])
        elif kind == "paragraph":
            while at < len(lines) and _kind(lines[at], depth)[0] == "paragraph":
                at += 1
            put("paragraph", runs=inline(" ".join(map(trim, lines[start:at]))))


def title(blocks: list[dict]) -> str | None:
    return next((plain(b["runs"]) for b in blocks if b["kind"] == "heading" and b["level"] == 1 and b["depth"] == 0), None) or None


def text_of(b: dict) -> str:
    """A block's plain text."""
    if b["kind"] == "list":
        return "\n".join(plain(i["runs"]) for i in b["items"])
    if b["kind"] == "table":
        return "\n".join(" | ".join(map(plain, r)) for r in [b["header"], *b["rows"]])
    return b.get("text") or plain(b.get("runs") or [])


def summary(blocks: list[dict]) -> str:
    """Blocks by kind (those within directives aside), as in ``1 heading, 2 paragraphs``."""
    words = (("heading", "heading"), ("paragraph", "paragraph"), ("table", "table"), ("list", "list"), ("code", "code block"))
    counted = [(w, sum(b["kind"] == k and b["depth"] == 0 for b in blocks)) for k, w in words]
    return ", ".join(f"{n} {w}{'' if n == 1 else 's'}" for w, n in counted if n) or "nothing"
