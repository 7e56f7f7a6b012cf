"""The members of zip packages as rows: ``spark.read.format("packages")``.

A planned reader. The driver lists files and sizes and cuts them to partitions:
small packages together, a large one into ranges of bytes, each of which gives
the members that begin in it. A task reads the end of a package (its directory)
and nothing else unless contents are asked for; then it reads the byte ranges of
the members that pass the filters, one member at a time.

Filters are part of the read: ``where`` is a list of (column, operator, value)
over file, name, ord and the sizes, all of which must hold. They choose files
before partitions are planned, and members before anything is inflated. They are
not taken from the plan: with Spark 4.1's pushdown for Python sources all scans
of one DataFrame share the filters that were pushed last, so a plan that reads it
twice, under two filters, returns wrong rows. Filters of the plan are applied by
Spark after the scan, as to any source.

Options: ``path``; ``pattern`` of file names; ``contents`` (false: no column
``content``, nothing is inflated); ``where`` (JSON); ``partitionbytes`` (64 MB).

Defined results: a file that is no package, or a package whose directory is
beyond the limits, is one row with an error and no member; a member that can't
be inflated, or is longer than it said, is a row with an error and no content;
folders in a package are not members; an empty folder of files gives no rows;
hidden files (``_`` or ``.`` in front) are not read; rows with an error have null
sizes or names only where these are unknown, and filters treat nulls as SQL does.
"""

from __future__ import annotations

import json
import operator
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from docframe.kernels.package import over_budget
from docframe.limits import ZIP_ENTRY
from docframe.ship import ship
from docframe.sources.stores import Ranged, listed, store, uri

COLUMNS = "file string, ord int, name string, compressed_size bigint, original_size bigint, crc bigint"
_ARROW = [("file", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("compressed_size", pa.int64()), ("original_size", pa.int64()), ("crc", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
FILTERED = ("file", "ord", "name", "compressed_size", "original_size")
PARTITION_BYTES = 64 << 20
#: What opening a package costs besides its bytes.
OPEN_BYTES = 1 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096

TESTS: dict[str, Callable[[Any, Any], bool]] = {
    "=": operator.eq,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": lambda x, v: x in v,
    "startswith": lambda x, v: x.startswith(v),
    "endswith": lambda x, v: x.endswith(v),
    "contains": lambda x, v: v in x,
    "like": fnmatchcase,
}


@dataclass
class Test:
    """A filter of the read; as in SQL a null fails it."""

    column: str
    kind: str
    value: Any

    def __post_init__(self):
        if self.column not in FILTERED or self.kind not in TESTS:
            raise ValueError(f"no filter {self.kind!r} on {self.column!r}")

    def holds(self, row: dict) -> bool:
        x = row[self.column]
        return x is not None and self.value is not None and TESTS[self.kind](x, self.value)


@dataclass
class Slice(ds.InputPartition):
    """(file, first byte, byte after the last): members whose header begins there are read."""

    files: list[tuple[str, int, int]]


def planned(files: list[tuple[str, int]], contents: bool, most: int) -> list[Slice]:
    """Partitions of some ``most`` bytes each; without contents only directories are read, so a package counts as one opening."""
    out, held, cost = [], [], 0
    for path, size in files:
        cuts = range(0, max(size, 1), most) if contents and size > most else [0]
        for begin in cuts:
            end = size if begin + most >= size or len(cuts) == 1 else begin + most
            need = OPEN_BYTES + (end - begin if contents else 0)
            if held and cost + need > most:
                out.append(Slice(held))
                held, cost = [], 0
            held.append((path, begin, end))
            cost += need
    return out + [Slice(held)] if held else out


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, pattern: str, contents: bool, most: int, where: list = ()):
        self.path, self.pattern, self.contents, self.most = path, pattern, contents, most
        self.tests = [Test(*w) for w in where]

    def partitions(self) -> list[Slice]:
        of_file = [t for t in self.tests if t.column == "file"]
        files = [(p, n) for p, n in listed(self.path, self.pattern) if all(t.holds({"file": uri(self.path, p)}) for t in of_file)]
        return planned(files, self.contents, self.most) or [Slice([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        held: list[dict] = []
        size = 0
        for path, begin, end in partition.files:
            with Ranged(where, path) as f:
                for row in self.rows(f, uri(self.path, path), begin, end):
                    held.append(row)
                    size += len(row["content"] or b"")
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield self.batch(held)
                        held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([c for c in _ARROW if c[0] != "content" or self.contents]))

    def rows(self, f, path: str, begin: int, end: int) -> Iterator[dict]:
        row = dict.fromkeys(name for name, _ in _ARROW) | {"file": path}
        try:
            package = zipfile.ZipFile(f)
            why = over_budget([(i.filename, i.compress_size, i.file_size) for i in package.infolist()])
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, EOFError):
            why = "the archive could not be read"
        if why:
            row["error"] = why
            if not begin and all(t.holds(row) for t in self.tests):  # the first range tells it
                yield row
            return
        for k, i in enumerate(package.infolist()):
            if i.is_dir() or not begin <= i.header_offset < end:
                continue
            member = row | {"ord": k, "name": i.filename, "compressed_size": i.compress_size, "original_size": i.file_size, "crc": i.CRC}
            if all(t.holds(member) for t in self.tests):
                yield member | self.inflated(package, i) if self.contents else member

    @staticmethod
    def inflated(package: zipfile.ZipFile, i: zipfile.ZipInfo) -> dict:
        try:
            with package.open(i) as f:
                content = f.read(ZIP_ENTRY + 1)
            if len(content) != i.file_size:
                raise zipfile.BadZipFile("its length is not what it said")
            return {"content": content}
        except Exception:  # noqa: BLE001 - a malformed member is data
            return {"error": f"part {i.filename} could not be read"}


class Packages(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def _contents(self) -> bool:
        return self.options.get("contents", "false").lower() == "true"

    def schema(self) -> str:
        return COLUMNS + (", content binary" if self._contents() else "") + ", error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("pattern", "*"), self._contents(), int(self.options.get("partitionbytes", PARTITION_BYTES)), json.loads(self.options.get("where", "[]")))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(Packages)
    return spark


def members(spark: SparkSession, path: str, contents: bool = False, where: list[tuple[str, str, Any]] = (), pattern: str = "*", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(file, ord, name, compressed_size, original_size, crc, [content,] error) of the packages at or below a path, of members for which all of ``where`` holds."""
    asked = [Test(*w) for w in where]  # wrong ones are told before anything is read
    options = {"pattern": pattern, "contents": str(contents).lower(), "partitionbytes": str(partition_bytes), "where": json.dumps([(t.column, t.kind, t.value) for t in asked])}
    return register(spark).read.format("packages").options(**options).load(path)
