"""Paths of any store that Arrow knows, opened from Python workers: local disks, object stores, HDFS where its library is there."""

from __future__ import annotations

import io
import posixpath
from fnmatch import fnmatchcase

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; relative paths are refused, as workers have folders of their own."""
    if "://" not in path and not path.startswith(("/", "file:")):
        raise ValueError(f"{path!r} must be absolute or a URI")
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def uri(path: str, inner: str) -> str:
    """A path of ``path``'s store as a whole one again."""
    scheme, sep, _ = path.partition("://")
    return f"{scheme}://{inner}" if sep and scheme != "file" else inner


def listed(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, size) of the files at or below a path, sorted; those with a part that begins with ``_`` or ``.`` below it are left out."""
    where, inner = store(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    base = inner.rstrip("/")
    found = [(f.path, f.size) for f in where.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    shown = lambda p: not any(s[:1] in "_." for s in p[len(base) :].strip("/").split("/"))
    return sorted((p, n) for p, n in found if shown(p) and fnmatchcase(posixpath.basename(p), pattern))


class Ranged(io.RawIOBase):
    """A file of a store as Python knows files; nothing but the asked ranges is read."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.file = where.open_input_file(path)
        self.length = self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.length)[whence]
        if at < 0:
            raise OSError("before the beginning")
        return self.file.seek(at)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()
