"""Files written from many tasks: small ones replaced where they lie, and one large one put together.

For local and shared POSIX file systems, where a rename within a directory is atomic and a file can be written at any
place. A task can be tried again or run twice (a lost executor, speculation): whatever it does first goes to names of its
own, and what others see changes by renames that can be repeated.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dropped, written

#: Bytes copied at a time.
CHUNK = 1 << 22


def _staged(target: str, run: str) -> str:
    folder, name = os.path.split(target)
    return os.path.join(folder, f".{name}.{run}")


def stage(target: str, run: str, data: bytes) -> None:
    """Write what will replace target beside it; complete or not there at all, whatever attempts run at a time."""
    own = f"{_staged(target, run)}.{uuid.uuid4().hex}"
    try:
        with open(own, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, _staged(target, run))
    except BaseException:
        if os.path.exists(own):
            os.remove(own)
        raise


def commit(target: str, run: str) -> int:
    """Put what is staged in place; 0 if an attempt before has done so."""
    try:
        os.replace(_staged(target, run), target)
    except FileNotFoundError:
        return 0
    return 1


def abort(target: str, run: str) -> int:
    try:
        os.remove(_staged(target, run))
    except FileNotFoundError:
        return 0
    return 1


def _each(table: DataFrame, do) -> int:
    """do(path, value bytes) over a table's rows, in its tasks; the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for path, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                do(path, value.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return table.select("path", "value").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def replace_files(texts: DataFrame, staged=stage) -> int:
    """Replace the file at each path by its value, all or none; the number of files. texts: (path, value), paths distinct.

    The values are written to a table first, since they may come from the very files. Then all are staged beside their
    targets; if a task fails for good, what is staged is removed and no target has changed. Only when all are staged are
    they renamed into place, by a job that can be repeated. ``staged(path, run, bytes)`` stages a file.
    """
    run, table = uuid.uuid4().hex, written(texts.select("path", "value"), "replace-files")
    try:
        try:
            n = _each(table, lambda path, value: staged(path, run, value))
        except BaseException:
            _each(table, lambda path, value: abort(path, run))
            raise
        _each(table, lambda path, value: commit(path, run))
        return n
    finally:
        dropped(table)


def join_parts(spark: SparkSession, parts: list[str], path: str) -> None:
    """One file at path of the parts' bytes in the given order, copied by a task for each part.

    Every part's place follows from the sizes of those before it, so a task that runs again writes the same bytes to the
    same place. The file gets its name when all are there.
    """
    size = [os.path.getsize(p) for p in parts]
    at = [0, *accumulate(size)]
    tmp = f"{_staged(path, uuid.uuid4().hex)}.tmp"
    with open(tmp, "wb") as f:
        f.truncate(at[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, to, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(part, "rb") as source, open(tmp, "r+b") as out:
                    out.seek(to)
                    left = n
                    while data := source.read(min(CHUNK, left)):
                        out.write(data)
                        left -= len(data)
                    out.flush()
                    os.fsync(out.fileno())
                if left:
                    raise OSError(f"{part} has become shorter")
            yield b.select(["n"])

    try:
        if parts:
            todo = spark.createDataFrame(list(zip(parts, at, size, strict=False)), "part string, at long, n long")
            copied = todo.repartition(min(len(parts), 512)).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
            if copied != at[-1]:
                raise OSError(f"{copied} of {at[-1]} bytes were copied")
        os.replace(tmp, path)
    except BaseException:
        os.path.exists(tmp) and os.remove(tmp)
        raise
