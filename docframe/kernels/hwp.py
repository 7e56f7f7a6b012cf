"""HWP 5 documents: a compound file, deflated sections, bit-packed records."""

from __future__ import annotations

import re
import struct
import zlib

from docframe.kernels.errors import Refused
from docframe.limits import ZIP_TOTAL

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE = 0xFFFFFFF0


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path."""
    if data[:8] != MAGIC or len(data) < 512:
        raise Refused("INVALID_DOCUMENT", "not a compound file")
    big, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    _, first_dir, _, cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<8I", data, 44)
    sector = lambda n: data[(n + 1) * big : (n + 2) * big]
    fat_at = list(struct.unpack_from("<109I", data, 76))
    seen: set[int] = set()
    while first_difat < _FREE and first_difat not in seen:
        seen.add(first_difat)
        more = struct.unpack(f"<{big // 4}I", sector(first_difat).ljust(big, b"\xff"))
        fat_at += more[:-1]
        first_difat = more[-1]
    fat = [x for n in fat_at if n < _FREE for x in struct.unpack(f"<{big // 4}I", sector(n).ljust(big, b"\xff"))]

    def chain(n: int, table: list[int], get) -> bytes:
        out, been = [], set()
        while n < _FREE and n < len(table) and n not in been:
            been.add(n)
            out.append(get(n))
            n = table[n]
        return b"".join(out)

    raw = chain(first_dir, fat, sector)
    listed = chain(first_mini, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(listed) // 4}I", listed[: len(listed) // 4 * 4]))
    nodes = []
    for at in range(0, len(raw) - 127, 128):
        size, kind = struct.unpack_from("<HB", raw, at + 64)
        left, right, child = struct.unpack_from("<3I", raw, at + 68)
        start, length = struct.unpack_from("<II", raw, at + 116)
        nodes.append((raw[at : at + max(0, min(size, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, length))
    if not nodes:
        return {}
    pool = chain(nodes[0][5], fat, sector)
    out: dict[str, bytes] = {}
    todo, been = [(nodes[0][4], "")], set()
    while todo:
        n, path = todo.pop()
        if n >= len(nodes) or n in been:
            continue
        been.add(n)
        name, kind, left, right, child, start, length = nodes[n]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            whole = chain(start, mini_fat, lambda k: pool[k * small : (k + 1) * small]) if length < cutoff else chain(start, fat, sector)
            out[path + name] = whole[:length]
    return out


# Control characters of one unit (others take eight), and those that stand for text.
ONE_UNIT = frozenset((0, 10, 13, *range(24, 32)))
SAYS = {9: "\t", 10: "\n", 13: "\n", 24: "-", 30: " ", 31: " "}
PARAGRAPH_TEXT = 67


def paragraph(payload: bytes) -> str:
    codes = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    out, at = [], 0
    while at < len(codes):
        c = codes[at]
        out.append(struct.pack("<H", c) if c > 31 else SAYS.get(c, "").encode("utf-16-le"))
        at += 1 if c > 31 or c in ONE_UNIT else 8
    return b"".join(out).decode("utf-16-le", "replace")


def paragraphs(section: bytes) -> list[str]:
    out, at = [], 0
    while at + 4 <= len(section):
        (head,) = struct.unpack_from("<I", section, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(section):
                break
            (size,) = struct.unpack_from("<I", section, at)
            at += 4
        if at + size > len(section):  # claims more than there is
            break
        if head & 0x3FF == PARAGRAPH_TEXT:
            out.append(paragraph(section[at : at + size]))
        at += size
    return out


def lines(data: bytes) -> tuple[list[str], int, str]:
    """Lines, sections and version."""
    s = streams(data)
    head = s.get("FileHeader", b"")
    if len(head) < 40 or not head.startswith(b"HWP Document File"):
        raise Refused("INVALID_DOCUMENT", "this compound file is not an HWP document")
    version = ".".join(str(b) for b in head[35:31:-1])
    if head[35] != 5:
        raise Refused("INVALID_DOCUMENT", f"this is an HWP {version} document; only 5.x is read")
    (flags,) = struct.unpack_from("<I", head, 36)
    if flags & 2:
        raise Refused("INVALID_DOCUMENT", "this document is protected by a password")
    if flags & 4:
        raise Refused("INVALID_DOCUMENT", "this is a distribution document; its body is encrypted")
    matched = [(re.fullmatch(r"BodyText/Section([0-9]+)", n), n) for n in s]
    found = sorted((int(m[1]), n) for m, n in matched if m)
    if not found:
        raise Refused("INVALID_DOCUMENT", "this document has no body")
    out: list[str] = []
    for _, n in found:
        body = s[n]
        if flags & 1:
            try:
                pump = zlib.decompressobj(-15)
                body = pump.decompress(body, ZIP_TOTAL)
                if pump.unconsumed_tail:
                    raise Refused("INVALID_DOCUMENT", f"{n} expands too far")
            except zlib.error as e:
                raise Refused("INVALID_DOCUMENT", f"{n} could not be decompressed") from e
        out += [line for p in paragraphs(body) for line in p.split("\n")]
    return out, len(found), version
