"""Pictures: their size from their headers, and those that a document refers to."""

from __future__ import annotations

import struct

from docframe.kernels.errors import Refused

SCHEME = "asset://"
PNG = b"\x89PNG\r\n\x1a\n"


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG or JPEG, or None."""
    if data[:8] == PNG and len(data) >= 24 and data[12:16] == b"IHDR":
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD9:  # padding and marks without a body
            at += 1 if mark == 0xFF else 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame header
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def fit(natural: tuple[int, int], box: tuple[float, float]) -> tuple[float, float]:
    """The largest size of the same shape in a box, not above its own."""
    k = min(1.0, box[0] / natural[0], box[1] / natural[1])
    return natural[0] * k, natural[1] * k


def figure(block: dict) -> tuple[str, str] | None:
    """(asset name, caption) of a paragraph that is one asset link and nothing else."""
    runs = block.get("runs") or []
    if block["kind"] == "paragraph" and len(runs) == 1 and (runs[0]["href"] or "").startswith(SCHEME):
        return runs[0]["href"].removeprefix(SCHEME), runs[0]["text"]
    return None


def figures(blocks: list[dict], assets: dict[str, bytes]) -> dict[int, tuple[str, str, bytes, tuple[int, int]]]:
    """By block position: (name, caption, bytes, size); a name without an asset is refused."""
    out = {}
    for b in blocks:
        if found := figure(b):
            name, caption = found
            data = assets.get(name)
            if data is None:
                raise Refused("INVALID_ARGUMENT", f"no asset is named {name!r}", "assets")
            natural = size(data)
            if not natural or not all(natural):
                raise Refused("INVALID_ARGUMENT", f"asset {name!r} is not a PNG or JPEG", "assets")
            out[b["pos"]] = (name, caption, data, natural)
    return out


def extension(data: bytes) -> str:
    return "png" if data[:8] == PNG else "jpg"
