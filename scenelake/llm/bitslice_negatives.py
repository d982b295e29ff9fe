"""Hard-negative mining with bit-sliced integer products.

Rows with a label and a vector (see vectors.py) take part. Anchors are the rows whose id is divisible by EVERY; an anchor's
positives are the POSITIVES best other rows of its label, and for each positive the NEGATIVES best rows of another label
whose score lies between LOW and HIGH percent of the positive's are returned. A score is the inner product of whole
components; ties go to the smaller id.

Bit-sliced products: a row's components are taken apart into the bits of their two's complement. The planes of a tile
(TILE rows) are multiplied with the anchors one by one, the most significant first. After the planes down to bit k the
rest of each component lies in 0 .. 2^k - 1, so the score lies between the sum so far plus (2^k - 1) times the anchor's
negative part and the same with its positive part. A pair is dropped as soon as this interval cannot qualify: its upper
end is below the anchor's worst score that still counts, or it lies outside all ranges asked for. While most pairs of a
tile are open a plane is one product of matrices; once few are, the planes that are left are taken pair by pair. At bit 0
the interval is the score itself.

At scale: the anchors are a stated query set against all rows, in blocks. Anchors are dealt by hash into blocks of about
BLOCK; rows are dealt into as many buckets as keep all tasks busy, of LEAST rows or more; a cell (anchor block, bucket) holds its anchors once and
streams its rows past them, keeping a few best scores per anchor, so a task's memory is a block of anchors and one tile.
Cells come to their tasks by one shuffle; the best of the cells meet in a ranked window over a few rows per anchor and
cell. Rows are sent once for each anchor block. Nothing is collected; nothing but the counts is known
to the driver. A label that holds a third of all rows, or a vector that a third of all rows share,
changes no cell's size.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; a null id is no anchor and
comes last among ties; rows that repeat an id are rows of their own (ties among them go by row), so an anchor's twin is
one of its other rows; where an id is divisible by SHIFT_EVERY its label moves on by one, modulo LABELS; vectors of
different length are compared as if the shorter ended in zeros; an empty vector scores 0; a positive score of 0 asks for
negatives of 0, a negative one for none; an id of 2^63 - 1 is given back as null; an empty table gives an empty result; further columns are ignored; components
beyond vectors.LIMIT raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions
from .vectors import column, matrix, whole

EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: Percent of a positive's score.
LOW, HIGH = 50, 95
SHIFT_EVERY, LABELS = 7, 10
#: Anchors in a block, on the average, and those multiplied at a time; rows in a tile.
BLOCK, TILE_ANCHORS, TILE = 4096, 512, 2048
#: Rows in a bucket, at least, on the average.
LEAST = 512
#: Share of a tile's pairs that are open, from which on planes are taken pair by pair.
SPARSE = 0.05
_NO_ID = np.iinfo(np.int64).max
#: Below all scores; its negative is a number too.
_NONE = -_NO_ID


def shifted(label: F.Column, vec_id: F.Column) -> F.Column:
    return F.when(vec_id % SHIFT_EVERY == 0, (label + 1) % LABELS).otherwise(label)


def prepare(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part; row is unique."""
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    slim = slim.withColumn("label", F.coalesce(shifted(F.col("label"), F.col("vec_id")), F.col("label"))).where("label is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, x = whole(column(b, "v"))
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(at), pa.array(x))
            own = pa.array(kept)
            yield pa.RecordBatch.from_arrays([column(b, "vec_id").take(own), column(b, "label").take(own), v], ["vec_id", "label", "v"])

    return slim.mapInArrow(run, "vec_id long, label long, v array<int>").withColumn("row", F.monotonically_increasing_id())


class Planes:
    """Rows as bit-planes of their components' two's complement, the most significant first."""

    def __init__(self, v: np.ndarray) -> None:
        most = int(np.abs(v).max()) if v.size else 0
        self.bits = most.bit_length() + 1
        self.v = v
        self.most = most

    def weight(self, k: int) -> int:
        return -(1 << k) if k == self.bits - 1 else 1 << k

    def plane(self, k: int, dtype: type = np.float32) -> np.ndarray:
        return ((self.v >> k) & 1).astype(dtype)


def scores(anchors: np.ndarray, rows: np.ndarray, open_: np.ndarray, qualifies) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor index, row index, score) of the pairs that may qualify, and the number of single products done.

    open_: the pairs to look at; qualifies(anchor index or slice, least, most) -> which intervals can still qualify.
    """
    planes = Planes(rows)
    bound = int(np.abs(anchors).sum(axis=1, dtype=np.int64).max(initial=0)) << (planes.bits + 1)
    dtype = np.float32 if bound < 1 << 24 else np.float64  # whole numbers are exact in it
    a = anchors.astype(dtype)
    plus = np.maximum(anchors, 0).sum(axis=1, dtype=np.int64)
    minus = np.minimum(anchors, 0).sum(axis=1, dtype=np.int64)
    so_far = np.zeros(open_.shape, dtype)
    open_ = open_.copy()
    done = 0
    k = planes.bits
    while k > 0 and (left := np.count_nonzero(open_)) > SPARSE * open_.size:
        k -= 1
        so_far += dtype(planes.weight(k)) * (a @ planes.plane(k, dtype).T)
        done += open_.size
        rest = (1 << k) - 1
        open_ &= qualifies(slice(None), so_far + (rest * minus).astype(dtype)[:, None], so_far + (rest * plus).astype(dtype)[:, None])
    i, j = np.nonzero(open_)
    s = so_far[i, j].astype(np.int64)
    del so_far
    while k > 0 and len(i):
        k -= 1
        bits = planes.plane(k, dtype)
        part = np.empty(len(i), dtype)
        for lo in range(0, len(i), 32768):
            part[lo : lo + 32768] = np.einsum("ij,ij->i", a[i[lo : lo + 32768]], bits[j[lo : lo + 32768]])
        s += planes.weight(k) * part.astype(np.int64)
        done += len(i)
        rest = (1 << k) - 1
        keep = qualifies(i, s + rest * minus[i], s + rest * plus[i])
        i, j, s = i[keep], j[keep], s[keep]
    return i, j, s, done


class Best:
    """The best few (score, then smaller id, then smaller row) of each of n lists, with room for ``most``."""

    def __init__(self, n: int, most: int) -> None:
        self.most = most
        self.score = np.full((n, most), _NONE)
        self.id = np.full((n, most), _NO_ID)
        self.row = np.full((n, most), _NO_ID)

    def worst(self) -> np.ndarray:
        """A score below which nothing enters a list."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        keep = score >= self.worst()[at]
        at, score, id_, row = at[keep], score[keep], id_[keep], row[keep]
        if not len(at):
            return
        lists_ = np.unique(at)
        full = np.repeat(lists_, self.most)
        at, score = np.concatenate([full, at]), np.concatenate([self.score[lists_].ravel(), score])
        id_, row = np.concatenate([self.id[lists_].ravel(), id_]), np.concatenate([self.row[lists_].ravel(), row])
        order = np.lexsort((row, id_, -score, at))
        at, score, id_, row = at[order], score[order], id_[order], row[order]
        start = np.searchsorted(at, lists_)
        take = start[:, None] + np.arange(self.most)
        self.score[lists_], self.id[lists_], self.row[lists_] = score[take], id_[take], row[take]

    def filled(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.score > _NONE)


class Positives:
    """The best other rows of each anchor's label."""

    OUT = "anchor long, anchor_id long, row long, vec_id long, score long"

    def __init__(self, head: dict[str, np.ndarray]) -> None:
        self.head = head
        self.best = Best(len(head["row"]), POSITIVES)

    def look(self, lo: int, hi: int, rows: dict[str, np.ndarray], v: np.ndarray, a: np.ndarray) -> None:
        h, worst = self.head, self.best.worst()[lo:hi]
        for label in np.unique(h["label"][lo:hi]):
            mine, theirs = np.flatnonzero(h["label"][lo:hi] == label), np.flatnonzero(rows["label"] == label)
            if len(theirs):
                least = worst[mine]
                open_ = h["row"][lo:hi][mine][:, None] != rows["row"][theirs]
                i, j, s, _ = scores(a[mine], v[theirs], open_, lambda x, low, high, least=least: high >= (least[x][:, None].astype(high.dtype) if isinstance(x, slice) else least[x]))
                self.best.add(lo + mine[i], s, rows["id"][theirs[j]], rows["row"][theirs[j]])

    def out(self) -> pa.RecordBatch:
        i, k = self.best.filled()
        id_ = self.best.id[i, k]
        cols = [self.head["row"][i], self.head["id"][i], self.best.row[i, k], pa.array(id_, mask=id_ == _NO_ID), self.best.score[i, k]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], ["anchor", "anchor_id", "row", "vec_id", "score"])


class Negatives:
    """The best rows of another label within the range of each positive."""

    OUT = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, row long, vec_id long, score long"

    def __init__(self, head: dict[str, np.ndarray]) -> None:
        self.head = head
        p = head["positive_score"]  # (anchors, POSITIVES), absent ones masked
        self.there = head["there"]
        self.low = -((-LOW * p) // 100)
        self.high = (HIGH * p) // 100
        self.there = self.there & (self.low <= self.high)
        self.low[~self.there], self.high[~self.there] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        self.best = Best(p.size, NEGATIVES)

    def look(self, lo: int, hi: int, rows: dict[str, np.ndarray], v: np.ndarray, a: np.ndarray) -> None:
        h = self.head
        least = np.maximum(self.low[lo:hi], self.best.worst().reshape(self.low.shape)[lo:hi])
        high = self.high[lo:hi]
        one_least, one_high = least.min(axis=1), high.max(axis=1)

        def qualifies(x, low, most):
            if isinstance(x, slice):
                return (most >= one_least[:, None].astype(most.dtype)) & (low <= one_high[:, None].astype(low.dtype))
            return ((most[:, None] >= least[x]) & (low[:, None] <= high[x])).any(axis=1)

        open_ = (h["label"][lo:hi][:, None] != rows["label"]) & self.there[lo:hi].any(axis=1)[:, None]
        i, j, s, _ = scores(a, v, open_, qualifies)
        for k in range(high.shape[1]):
            fits = (s >= least[i, k]) & (s <= high[i, k])
            self.best.add((lo + i[fits]) * high.shape[1] + k, s[fits], rows["id"][j[fits]], rows["row"][j[fits]])

    def out(self) -> pa.RecordBatch:
        at, k = self.best.filled()
        i, p = at // self.low.shape[1], at % self.low.shape[1]
        h, id_, of = self.head, self.best.id[at, k], self.head["positive_id"][i, p]
        cols = [h["row"][i], h["id"][i], h["positive"][i, p], pa.array(of, mask=of == _NO_ID), h["positive_score"][i, p], self.best.row[at, k], pa.array(id_, mask=id_ == _NO_ID), self.best.score[at, k]]
        names = [c.split()[0] for c in self.OUT.split(", ")]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names)


def _cells(rows: DataFrame, anchors: DataFrame, task: type) -> DataFrame:
    """The task's output over all cells; anchors hold the rows' columns and what the task needs besides."""
    n = partitions(rows.sparkSession)
    blocks = max(1, -(-anchors.count() // BLOCK))
    buckets = max(1, min(-(-2 * n // blocks), -(-rows.count() // LEAST)))
    by = ["block", "bucket"]
    more = [c for c in anchors.columns if c not in rows.columns]
    nothing = [F.lit(None).cast(dict(anchors.dtypes)[c]).alias(c) for c in more]
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    heads = anchors.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), every(buckets).alias("bucket"), F.lit(0).alias("kind"), *rows.columns, *more)
    tails = rows.select(every(blocks).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"), *rows.columns, *nothing)

    def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        ids = column(b, "vec_id")
        return {"row": column(b, "row").to_numpy(), "id": ids.fill_null(_NO_ID).to_numpy(), "label": column(b, "label").to_numpy()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, work, head, wide = None, None, [], 0

        def begin() -> None:
            nonlocal work, wide
            table = pa.Table.from_batches(head).combine_chunks().to_batches()[0]
            h = columns(table)
            h["v"] = matrix(column(table, "v"))
            for c in more:
                x = column(table, c)
                m = np.full((len(x), POSITIVES), _NO_ID)
                size = np.diff(x.offsets.to_numpy())
                m[np.repeat(np.arange(len(x)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = x.flatten().fill_null(_NO_ID).to_numpy()
                h[c] = m
                h["there"] = np.arange(POSITIVES) < size[:, None]
            head.clear()
            work = task(h)

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([column(b, c).to_numpy() for c in (*by, "kind")])
            cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for lo, hi in zip(cut, np.append(cut[1:], b.num_rows), strict=True):
                part, mine = b.slice(lo, hi - lo), tuple(key[:2, lo])
                if mine != at:
                    if work:
                        yield work.out()
                    at, work = mine, None
                    head.clear()
                if key[2, lo] == 0:
                    head.append(part)
                    continue
                if head:
                    begin()
                if not work:
                    continue  # a block without anchors
                for t in range(0, part.num_rows, TILE):
                    tile = part.slice(t, TILE)
                    rows_, v = columns(tile), matrix(column(tile, "v"))
                    dims = max(v.shape[1], work.head["v"].shape[1])
                    v = np.pad(v, ((0, 0), (0, dims - v.shape[1])))
                    for s in range(0, len(work.head["row"]), TILE_ANCHORS):
                        a = work.head["v"][s : s + TILE_ANCHORS]
                        work.look(s, min(s + TILE_ANCHORS, len(work.head["row"])), rows_, v, np.pad(a, ((0, 0), (0, dims - a.shape[1]))))
        if work:
            yield work.out()

    cells = heads.unionByName(tails).repartition(n, *by).sortWithinPartitions(*by, "kind")
    return cells.mapInArrow(run, task.OUT)


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor, anchor_id, positive, positive_id, positive_score, rank, row, vec_id, score): anchor, positive and row are row
    numbers, rank runs from 1 among the negatives of an anchor and positive."""
    taken = materialize(prepare(rows, id_col, vector, label), "negatives-rows")
    anchors = taken.where(F.col("vec_id") % EVERY == 0)
    positives = _ranked(_cells(taken, anchors, Positives), ["anchor"], POSITIVES)
    each = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "vec_id", "score"))).alias("p"))  # POSITIVES at most
    each = each.select("anchor", F.col("p.row").alias("positive"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    asked = materialize(anchors.join(each, F.col("row") == F.col("anchor")).drop("anchor"), "negatives-anchors")
    out = materialize(_ranked(_cells(taken, asked, Negatives), ["anchor", "positive"], NEGATIVES), "negatives-found")
    discard(taken)
    discard(asked)
    return out
