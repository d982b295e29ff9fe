"""One huge JSON document, read by many tasks.

A document is an object whose values of interest are arrays of objects, as "images", "annotations" and "categories" of a
dataset. It is cut in ranges of bytes. Where a range begins, nothing tells whether that is within a string or how deep,
so three passes are made:

1. Every range says how many unescaped quotes it holds and, for both cases of its beginning (within a string or not), how
   much deeper it ends. A few bytes before a range tell whether its first byte is escaped.
2. The driver adds these up, a row for each range; now each range knows its beginning and finds the keys of the document
   itself (depth 1) and their places.
3. Every range returns the objects that begin in it at depth 2, with the key of their array; the last one is read to its
   end beyond the range.

Nothing is parsed by Python: objects come as JSON strings to Spark's own parser. Local and shared file systems and those
that Arrow opens by URI can be read. A document that does not end at depth 0 outside a string raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tree import opened

#: Bytes of a range, unless there would be more than MOST_RANGES: then ranges are longer, as the driver keeps a row for each.
RANGE, MOST_RANGES = 32 << 20, 1000
#: Bytes of a range that are held at a time.
PIECE = 1 << 20
#: Rows and bytes of a batch.
ROWS, BYTES = 4096, 8 << 20
#: More top-level keys than these are no document of arrays.
MOST_KEYS = 10_000
_QUOTE, _BACK = ord('"'), ord("\\")


def escaped(data: np.ndarray, first: bool) -> np.ndarray:
    """Which bytes a backslash before them escapes; first: whether the first one is."""
    back = data == _BACK
    at = np.arange(len(data))
    # length of the run of backslashes that ends before a byte
    start = np.maximum.accumulate(np.where(back, -1, at))  # last byte up to here that is none
    run = np.zeros(len(data), np.int64)
    run[1:] = at[:-1] - start[:-1]
    from_start = np.zeros(len(data), bool)
    from_start[1:] = start[:-1] < 0
    run += from_start & first  # a run from the very beginning, whose first one is itself escaped or not
    out = run % 2 == 1
    if len(out):
        out[0] = first
    return out


def lexed(data: np.ndarray, first_escaped: bool, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """(for each byte whether a string is open after it, depth after it relative to the beginning)."""
    quote = (data == _QUOTE) & ~escaped(data, first_escaped)
    within = (np.cumsum(quote) + in_string) % 2 == 1
    outside = ~within & ~quote
    step = np.zeros(len(data), np.int8)
    step[outside & ((data == ord("{")) | (data == ord("[")))] = 1
    step[outside & ((data == ord("}")) | (data == ord("]")))] = -1
    return within, np.cumsum(step, dtype=np.int64)


def _read(path: str, lo: int, hi: int) -> np.ndarray:
    system, inner, _ = opened(path)
    with system.open_input_file(inner) as f:
        f.seek(lo)
        return np.frombuffer(f.read(hi - lo), np.uint8)


def _first_escaped(path: str, lo: int) -> bool:
    """Whether an odd number of backslashes stands before a byte."""
    n, step = 0, 64
    while lo > 0:
        before = _read(path, max(0, lo - step), lo)
        other = np.flatnonzero(before != _BACK)
        if len(other):
            return (n + len(before) - 1 - other[-1]) % 2 == 1
        n, lo = n + len(before), lo - len(before)
    return n % 2 == 1


def _pieces(path: str, lo: int, hi: int, string: bool) -> Iterator[tuple[int, np.ndarray, bool, bool]]:
    """(place, bytes, whether the first byte is escaped, whether a string is open before it): a range piece by piece."""
    first = _first_escaped(path, lo)
    system, inner, _ = opened(path)
    with system.open_input_file(inner) as f:
        f.seek(lo)
        while lo < hi:
            data = np.frombuffer(f.read(min(PIECE, hi - lo)), np.uint8)
            if not len(data):
                raise ValueError(f"{path} has become shorter")
            yield lo, data, first, string
            escapes = escaped(data, first)
            string ^= bool(np.count_nonzero((data == _QUOTE) & ~escapes) % 2)
            first, lo = bool(data[-1] == _BACK and not escapes[-1]), lo + len(data)


def _lexed_pieces(path: str, lo: int, hi: int, string: bool, depth: int) -> Iterator[tuple[int, np.ndarray, bool, np.ndarray, np.ndarray]]:
    """(place, bytes, string open before them, string open after each, depth after each)."""
    for at, data, first, before in _pieces(path, lo, hi, string):
        within, deep = lexed(data, first, before)
        deep += depth
        yield at, data, before, within, deep
        depth = int(deep[-1])


def size_of(path: str) -> int:
    system, inner, _ = opened(path)
    return int(system.get_file_info(inner).size or 0)


def _ranges(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The ranges dealt to tasks, without a shuffle: Spark would take the size of these few rows, which it then knows, for
    that of the objects read from them, and gather a table of objects on the driver to broadcast it.
    """
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, min(len(rows), 4096))), schema)


def begins(spark: SparkSession, path: str, size: int, range_: int = RANGE) -> list[tuple[int, int, bool, int]]:
    """(lo, hi, within a string, depth) at the beginning of every range."""
    range_ = max(range_, -(-size // MOST_RANGES))
    cuts = [(lo, min(size, lo + range_)) for lo in range(0, size, range_)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flips, plain, quoted = False, 0, 0
                for _, data, first, string in _pieces(path, lo, hi, False):
                    (w0, d0), (_, d1) = lexed(data, first, string), lexed(data, first, not string)
                    flips, plain, quoted = bool(w0[-1]), plain + int(d0[-1]), quoted + int(d1[-1])
                out.append((lo, flips, plain, quoted))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lo", "flips", "plain", "quoted"])

    found = _ranges(spark, cuts, "lo long, hi long").mapInArrow(run, "lo long, flips boolean, plain long, quoted long").collect()  # a row for each range
    out, within, depth = [], False, 0
    for (lo, hi), r in zip(cuts, sorted(found, key=lambda r: r["lo"]), strict=True):
        out.append((lo, hi, within, depth))
        depth += r["quoted"] if within else r["plain"]
        within ^= r["flips"]
    if within or depth:
        raise ValueError(f"{path} is no complete JSON document")
    return out


def keys(spark: SparkSession, path: str, size: int, ranges: list[tuple[int, int, bool, int]]) -> list[tuple[int, str]]:
    """(place, name) of the document's own keys, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, string, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                opens, out = [], []
                for at, _, before, within, deep in _lexed_pieces(path, lo, hi, string, depth):
                    opens += (at + np.flatnonzero(within & ~np.append(before, within[:-1]) & (deep == 1))).tolist()
                    if len(opens) > MOST_KEYS:
                        raise ValueError(f"more than {MOST_KEYS} strings at the top of {path}")
                for at in opens:
                    name, end = _string(path, at, size)
                    if _next(path, end, size) == b":":
                        out.append((at, name))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["at", "name"])

    found = _ranges(spark, ranges, "lo long, hi long, string boolean, depth long").mapInArrow(run, "at long, name string")
    rows = found.limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys at the top of {path}")
    return sorted((r["at"], r["name"]) for r in rows)


def _string(path: str, at: int, size: int) -> tuple[str, int]:
    """(content, end) of the string that opens at a place."""
    import json

    step = 256
    while True:
        data = _read(path, at, min(size, at + step))
        shut = np.flatnonzero((data == _QUOTE) & ~escaped(data, False))
        if len(shut) > 1:
            end = int(shut[1]) + 1
            return json.loads(data[:end].tobytes()), at + end
        step *= 4


def _next(path: str, at: int, size: int) -> bytes:
    """The first byte from a place on that is no white space."""
    while at < size:
        rest = _read(path, at, min(size, at + 64)).tobytes()
        if found := rest.lstrip(b" \t\r\n"):
            return found[:1]
        at += len(rest)
    return b""


def elements(spark: SparkSession, path: str, range_: int = RANGE) -> DataFrame:
    """(key, at, value): the objects of the document's own arrays as JSON, with the key of their array and their place."""
    size = size_of(path)
    ranges = begins(spark, path, size, range_)
    return _elements(spark, path, size, ranges, keys(spark, path, size, ranges))


def _elements(spark: SparkSession, path: str, size: int, ranges: list[tuple[int, int, bool, int]], named: list[tuple[int, str]]) -> DataFrame:
    """The objects that begin in some ranges."""
    at_keys, names = np.array([k[0] for k in named], np.int64), [k[1] for k in named]

    def objects(lo: int, hi: int, string: bool, depth: int) -> Iterator[tuple[str, int, str]]:
        row = lambda at, value: (names[int(np.searchsorted(at_keys, at)) - 1], at, value.decode())
        begun, head = None, []  # place of the object that is open, if it began in this range, and its bytes so far
        for at, data, _, within, deep in _lexed_pieces(path, lo, hi, string, depth):
            outside = ~within
            start = np.flatnonzero((data == ord("{")) & outside & (deep == 3)).tolist()
            stop = (np.flatnonzero((data == ord("}")) & outside & (deep == 2)) + 1).tolist()
            if start and not names:
                raise ValueError(f"{path} is no object")
            raw = data.tobytes()
            if stop and (not start or stop[0] <= start[0]):
                end = stop.pop(0)
                if begun is not None:
                    yield row(begun, b"".join([*head, raw[:end]]))
                begun, head = None, []
            elif begun is not None:
                head.append(raw)
            for s, e in zip(start, stop, strict=False):
                yield row(at + s, raw[s:e])
            if len(start) > len(stop):
                begun, head = at + start[-1], [raw[start[-1] :]]
        if begun is not None:
            yield row(begun, b"".join([*head, _rest(path, hi, size, bool(within[-1]), int(deep[-1]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for each in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                for r in objects(*each):
                    rows.append(r)
                    held += len(r[2])
                    if len(rows) >= ROWS or held >= BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return _ranges(spark, ranges, "lo long, hi long, string boolean, depth long").mapInArrow(run, "key string, at long, value string")


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "at", "value"])


def _rest(path: str, at: int, size: int, string: bool, depth: int) -> bytes:
    """The bytes from a place within an object at depth 2 to its end."""
    out, step = [], 1 << 16
    while at < size:
        data = _read(path, at, min(size, at + step))
        within, deep = lexed(data, _first_escaped(path, at), string)
        deep += depth
        end = np.flatnonzero((deep == 2) & ~within & (data == ord("}")))
        if len(end):
            return b"".join([*out, data[: int(end[0]) + 1].tobytes()])
        out.append(data.tobytes())
        at, string, depth, step = at + len(data), bool(within[-1]), int(deep[-1]), step * 4
    raise ValueError(f"{path} ends within an object")


def arrays(spark: SparkSession, path: str, kinds: dict[str, str], range_: int = RANGE) -> dict[str, DataFrame]:
    """A table for each array: its objects as columns. kinds: key -> struct type. A malformed object raises.

    A table reads the ranges that its array lies in, not the others.
    """
    size = size_of(path)
    ranges = begins(spark, path, size, range_)
    named = keys(spark, path, size, ranges)
    ends = [*(k[0] for k in named), size][1:]

    def of(key: str) -> DataFrame:
        spans = [(at, end) for (at, name), end in zip(named, ends, strict=True) if name == key]
        own = [r for r in ranges if any(r[0] < end and at < r[1] for at, end in spans)] if named else ranges
        return _elements(spark, path, size, own, named).where(F.col("key") == key)

    return {key: of(key).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*") for key, kind in kinds.items()}
