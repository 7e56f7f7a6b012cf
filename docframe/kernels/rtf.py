"""RTF to lines, by one pass over its tokens."""

from __future__ import annotations

import re

# Groups that hold no body text.
DESTINATIONS = frozenset("fonttbl colortbl stylesheet listtable listoverridetable info pict object themedata colorschememapping latentstyles datastore generator xmlnstbl revtbl header footer headerl headerr footerl footerr footnote annotation comment".split())
# Control words that stand for characters.
CHARACTERS = {"par": "\n", "line": "\n", "tab": "\t", "page": "\n", "sect": "\n", "cell": " | ", "row": "\n", "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "qmspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_TOKEN = re.compile(r"\\(?:(?P<word>[a-zA-Z]+)(?P<arg>-?[0-9]+)? ?|'(?P<hex>.{0,2})|(?P<sign>.))|(?P<brace>[{}])|(?P<plain>[^\\{}\r\n]+)|[\r\n]", re.S)


def text_of(data: bytes) -> str | None:
    """The text with line breaks, or None if this is not RTF."""
    source = data.decode("latin-1")
    if not source.lstrip().startswith("{\\rtf"):
        return None
    out: list[str] = []
    depth, quiet, owed = 0, None, 0

    def say(x: str) -> None:
        nonlocal owed
        if quiet is None:
            kept = x[owed:]  # what is owed stands in for a character already said
            owed = max(0, owed - len(x))
            out.append(kept)

    for m in _TOKEN.finditer(source):
        if m["plain"]:
            say(m["plain"])
        elif m["brace"] == "{":
            depth += 1
        elif m["brace"]:
            if quiet is not None and depth <= quiet:
                quiet = None
            depth -= 1
        elif m["hex"] is not None:
            say(bytes([int(m["hex"], 16)]).decode("latin-1") if re.fullmatch("[0-9a-fA-F]{2}", m["hex"]) else "")
        elif m["sign"]:
            if m["sign"] == "*":
                quiet = depth if quiet is None else quiet
            elif m["sign"] in "\\{}":
                say(m["sign"])
        elif m["word"] and quiet is None:
            if m["word"] in DESTINATIONS:
                quiet = depth
            elif m["word"] == "u" and m["arg"]:
                say(chr(int(m["arg"]) % 65536 if int(m["arg"]) < 65536 else 0xFFFD))
                owed = 1
            elif m["word"] in CHARACTERS:
                say(CHARACTERS[m["word"]])
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
