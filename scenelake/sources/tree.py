"""A directory tree as a table, listed by executors: the data source "tree".

The driver looks at the upper directories only, level by level, until there are PREFIXES of them or no more; a partition is
one directory with all that lies below, or the files that lie directly in an upper directory. Names never come to the
driver, and hidden ones (_x, .x) are listed like any other. Local and shared file systems and those that Arrow opens by
their URI are listed; every executor must see them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, dir string, name string"
#: Directories at which the driver stops to look further down.
PREFIXES = 256
#: Rows of a batch.
ROWS = 8192
_ARROW = pa.schema([("path", pa.string()), ("dir", pa.string()), ("name", pa.string())])


def opened(path: str) -> tuple[pa.fs.FileSystem, str, str]:
    """(file system, its path, what stands before its paths): nothing for local files, else scheme and store."""
    import pyarrow.fs as fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/") or "/", ""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path).rstrip("/") or "/", ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/"), path[: path.rindex(inner.rstrip("/"))] if inner.rstrip("/") in path else ""


def entries(system, directory: str) -> Iterator:
    """What lies directly in a directory; nothing if there is no such directory."""
    import pyarrow.fs as fs

    yield from system.get_file_info(fs.FileSelector(directory, allow_not_found=True, recursive=False))


@dataclass
class Prefix(InputPartition):
    """A directory, with or without what lies below its own files."""

    directory: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.deep = str(options.get("recursive", "true")).lower() == "true"
        self.prefixes = int(options.get("prefixes", PREFIXES))

    def partitions(self) -> list[Prefix]:
        import pyarrow.fs as fs

        system, top, _ = opened(self.root)
        if not self.deep:
            return [Prefix(top, False)]
        shallow, level = [], [top]
        while level and len(level) < self.prefixes:
            below = [e.path for d in level for e in entries(system, d) if e.type == fs.FileType.Directory]
            shallow += level
            level = below
        return [*(Prefix(d, False) for d in shallow), *(Prefix(d, True) for d in level)]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        system, _, before = opened(self.root)
        rows, todo = [], [partition.directory]
        while todo:
            here = todo.pop()
            for e in entries(system, here):
                if e.type == fs.FileType.Directory:
                    todo += [e.path] if partition.deep else []
                elif fnmatchcase(e.base_name, self.pattern):
                    rows.append((f"{before}{e.path}", f"{before}{here}", e.base_name))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_ARROW)


class Tree(DataSource):
    """spark.read.format("tree"): options pattern (of names, as in a shell), recursive, prefixes."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
