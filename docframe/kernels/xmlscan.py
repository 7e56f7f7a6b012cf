"""A forgiving XML scanner: events in order, no tree, bounded work."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from docframe.kernels.errors import Refused
from docframe.limits import XML_DEPTH, XML_EVENTS

# The named entities that are decoded; any other name stays as it is.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_MARKUP = re.compile(r"""<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|(?P<dtd><!(?:DOCTYPE|ENTITY))|<[?!](?:[^"'>]|"[^"]*"|'[^']*')*>|<(?P<close>/)?(?P<tag>(?:[^"'>]|"[^"]*"|'[^']*')*)>|(?P<cut><)""", re.S)

_BLANK = re.compile(r"\s")


def _point(n: int) -> str:
    return "" if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)


def decode(text: str) -> str:
    """Numeric and named references; ``&amp;`` last, so what it hides is not decoded twice."""
    if "&" not in text:
        return text
    text = re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: _point(int(m[1], 16)), text)
    text = re.sub(r"&#([0-9]+);", lambda m: _point(int(m[1])), text)
    text = re.sub(r"&([a-zA-Z]+);", lambda m: ENTITIES.get(m[1].lower(), m[0]), text)
    return re.sub("&amp;", "&", text, flags=re.I)


def escape(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = text.replace(a, b)
    return text


@lru_cache(256)
def _attribute(name: str) -> re.Pattern:
    return re.compile(rf'(?:^|\s){re.escape(name)}\s*=\s*"([^"]*)"')


def attribute(attrs: str, name: str) -> str | None:
    m = _attribute(name).search(attrs)
    return m[1] if m else None


def local(name: str) -> str:
    return name.partition(":")[2] or name


def events(xml: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, name or text, attributes, self-closing) with kind ``text``, ``open`` or ``close``."""
    at = depth = seen = 0
    for m in _MARKUP.finditer(xml):
        if m.start() > at:
            yield "text", decode(xml[at : m.start()]), "", False
        at = m.end()
        cdata, dtd, close, tag, broken = m.groups()
        if broken:  # a tag that never ends
            return
        if dtd:
            raise Refused("INVALID_DOCUMENT", "document XML may not declare a DTD or entity")
        if cdata is not None:
            yield "text", cdata, "", False
        if tag is None:
            continue
        seen += 1
        if seen > XML_EVENTS:
            raise Refused("INVALID_DOCUMENT", f"document XML has more than {XML_EVENTS:,} elements")
        if close:
            depth = max(0, depth - 1)
            yield "close", tag.strip(), "", False
            continue
        alone = tag.endswith("/")
        name, _, attrs = _BLANK.sub(" ", tag.removesuffix("/"), count=1).partition(" ")
        if not alone:
            depth += 1
            if depth > XML_DEPTH:
                raise Refused("INVALID_DOCUMENT", f"document XML is nested more than {XML_DEPTH} elements deep")
        yield "open", name, attrs.strip(), alone
    if at < len(xml):
        yield "text", decode(xml[at:]), "", False
