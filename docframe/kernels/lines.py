"""Lines of extracted text in their canonical form."""

from __future__ import annotations

import re

#: White space as the engine means it, whatever the language's regular expressions say.
SPACE = "\t\n\x0b\x0c\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: Runs of white space but for a single blank, which stays as it is.
_RUN = re.compile(f" [{SPACE}]+|[{SPACE.replace(' ', '')}][{SPACE}]*")


def trim(text: str) -> str:
    return text.strip(SPACE)


def tidy(line: str) -> str:
    """One blank (or tab, if there was one) for each run of white space; no empty cells at the end."""
    line = trim(_RUN.sub(lambda m: "\t" if "\t" in m[0] else " ", line))
    return line.rstrip(SPACE + "|") if line.endswith("|") else line


def normalize(lines: list[str]) -> str:
    """Tidy lines, at most one empty line in a row, none at either end."""
    out: list[str] = []
    for line in map(tidy, lines):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).rstrip("\n")


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def cut(text: str, most: int) -> str:
    """The longest prefix of at most ``most`` UTF-16 units that splits no character."""
    if units(text) <= most:
        return text
    n = 0
    for i, c in enumerate(text):
        n += 1 + (c > "\uffff")
        if n > most:
            return text[:i]
    return text
