"""Zip packages: listed before anything is inflated, refused on declared sizes, parts read by name."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from functools import lru_cache

from docframe.kernels.errors import Refused
from docframe.limits import ZIP_ENTRIES, ZIP_ENTRY, ZIP_RATIO, ZIP_TOTAL


#: Parts of at most so many bytes are kept packed, as many packages hold the same ones.
SMALL_PART = 4096


def _opened(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError) as e:
        raise Refused("INVALID_DOCUMENT", "the archive could not be read") from e


def _listed(z: zipfile.ZipFile) -> list[tuple[str, int, int]]:
    return [(i.filename, i.compress_size, i.file_size) for i in z.infolist()]


_END, _ENTRY, _HEAD = struct.Struct("<4s4H2LH"), struct.Struct("<4s4B4HL2L5H2L"), struct.Struct("<4s2B4HL2L2H")


def _plainly_listed(data: bytes) -> list[tuple[str, int, int, int, int, int, int]] | None:
    """(name, compressed size, original size, CRC, method, begin, where the next part begins); None unless the directory holds no more than that.

    Not so plain are notes, extra fields, encryption, names that are not ASCII, zip64 and parts in
    another order or not side by side with the directory: those are left to ``zipfile``.
    """
    end = len(data) - _END.size
    if end < 0:
        return None
    sign, disk, first, here, count, size, at, note = _END.unpack_from(data, end)
    if sign != b"PK\x05\x06" or disk or first or here != count or note or at + size != end or data[max(0, end - 20) : max(0, end - 16)] == b"PK\x06\x07":
        return None
    out, begins = [], []
    while at + _ENTRY.size <= end:
        sign, _, _, needs, _, flags, method, _, _, crc, packed, original, n, extra, note, disk, _, _, begin = _ENTRY.unpack_from(data, at)
        name = data[at + _ENTRY.size : at + _ENTRY.size + n]
        if sign != b"PK\x01\x02" or needs > 20 or flags & ~0x800 or method not in (0, 8) or extra or note or disk or not name.isascii() or b"\0" in name or max(packed, original, begin) >= 0xFFFFFFFF or (begins and begin <= begins[-1]):
            return None
        out.append((name.decode("ascii"), packed, original, crc, method, begin))
        begins.append(begin)
        at += _ENTRY.size + n
    if at != end or len(out) != count or (begins and begins[-1] >= end - size):
        return None
    return [(*e, after) for e, after in zip(out, [*begins[1:], end - size], strict=True)]


def _plainly_read(data: bytes, part: tuple[str, int, int, int, int, int, int]) -> bytes | None:
    """A part of a plain listing, or None if anything in it is unlike its entry."""
    name, packed, original, crc, method, at, after = part
    if at + _HEAD.size > after:
        return None
    sign, *_, n, extra = _HEAD.unpack_from(data, at)
    begin = at + _HEAD.size + n + extra
    if sign != b"PK\x03\x04" or begin + packed > after or data[at + _HEAD.size : at + _HEAD.size + n] != name.encode():
        return None
    body = data[begin : begin + packed]
    if method:
        try:
            body = zlib.decompressobj(-15).decompress(body, original + 1)
        except zlib.error:
            return None
    return body if len(body) == original and zlib.crc32(body) == crc else None


def entries(data: bytes) -> list[tuple[str, int, int]]:
    """(name, compressed size, original size) as declared."""
    with _opened(data) as z:
        return _listed(z)


def over_budget(listed: list[tuple[str, int, int]]) -> str | None:
    """Why an archive is refused, or None; the first reason that holds."""
    if not listed:
        return "the archive is empty"
    if len(listed) > ZIP_ENTRIES:
        return f"the archive holds {len(listed):,} entries; the limit is {ZIP_ENTRIES:,}"
    sizes = [size for *_, size in listed]
    if max(sizes) > ZIP_ENTRY:
        return "an entry is too large"
    if any([size / max(1, packed) > ZIP_RATIO for _, packed, size in listed]):
        return "an entry expands too far"
    if sum(sizes) > ZIP_TOTAL:
        return "the archive expands too far"
    if any([n.startswith("/") or (".." in n and ".." in n.split("/")) for n, *_ in listed]):
        return "an entry leaves the archive"
    return None


class Package:
    def __init__(self, data: bytes):
        self._data, plain = data, _plainly_listed(data)
        self._zip = _opened(data) if plain is None else None
        self.listed = _listed(self._zip) if plain is None else [p[:3] for p in plain]
        if why := over_budget(self.listed):
            raise Refused("INVALID_DOCUMENT", why)
        self.names = [n for n, *_ in self.listed]
        self._plain = {p[0]: p for p in plain or ()}

    def text(self, name: str) -> str | None:
        if name not in self.names:
            return None
        body = _plainly_read(self._data, self._plain[name]) if name in self._plain else None
        if body is None:
            try:
                self._zip = self._zip or _opened(self._data)
                body = self._zip.read(name)
            except Exception as e:
                raise Refused("INVALID_DOCUMENT", f"part {name} could not be read") from e
        return body.decode("utf-8", "replace").removeprefix("\ufeff")

    def numbered(self, pattern: str) -> list[str]:
        """Parts whose name fits, by the number in it (not by spelling)."""
        found = [(re.fullmatch(pattern, n), n) for n in self.names]
        return [n for _, n in sorted((int(m[1]), n) for m, n in found if m)]


def _packed(body: bytes) -> tuple[int, bytes]:
    """(CRC, deflated bytes)."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return zlib.crc32(body), z.compress(body) + z.flush()


_packed_once = lru_cache(64)(_packed)


def _zip64(*sizes: int) -> bool:
    return any(x >= zipfile.ZIP64_LIMIT for x in sizes)


def _part(name: str, body: bytes | str, kept: bool) -> tuple[bytes, bytes, bytes]:
    """(header and packed bytes, directory entry up to the part's place, name)."""
    body, label = body.encode() if isinstance(body, str) else body, name.encode()
    crc, data = (zlib.crc32(body), body) if kept else (_packed_once if len(body) <= SMALL_PART else _packed)(body)
    # version 2.0, flag of UTF-8 names, method, 1 January 1980, CRC, sizes, length of the name
    head = struct.pack("<HHHHHIIIHH", 20, 0 if label.isascii() else 0x800, 0 if kept else 8, 0, 33, crc, len(data), len(body), len(label), 0)
    entry = struct.pack("<4sBB", b"PK\x01\x02", 20, 3) + head + struct.pack("<HHHI", 0, 0, 0, 0o600 << 16)
    return b"".join([b"PK\x03\x04", head, label, data]), entry, label


_part_once = lru_cache(64)(_part)


def build(parts: dict[str, bytes | str], stored: tuple[str, ...] = ()) -> bytes:
    """A package with its parts in order, the same bytes for the same parts."""
    bodies = {name: body if isinstance(body, str) else bytes(body) for name, body in parts.items()}
    # four bytes a character at most
    if _zip64(4 * sum(map(len, bodies.values()))) or len(bodies) > zipfile.ZIP_FILECOUNT_LIMIT:
        return _build_large({name: body.encode() if isinstance(body, str) else body for name, body in bodies.items()}, stored)
    out, directory, at = [], [], 0
    for name, body in bodies.items():
        whole, entry, label = (_part_once if len(body) <= SMALL_PART else _part)(name, body, name in stored)
        out.append(whole)
        directory += [entry, at.to_bytes(4, "little"), label]
        at += len(whole)
    index = b"".join(directory)
    return b"".join([*out, index, struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, len(bodies), len(bodies), len(index), at, 0)])


def _build_large(bodies: dict[str, bytes], stored: tuple[str, ...]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for name, body in bodies.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return out.getvalue()
