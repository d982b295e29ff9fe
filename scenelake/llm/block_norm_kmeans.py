"""Centroid clustering of whole-number vectors with block-norm screening.

Vectors of exactly DIMS components (see vectors.py) are clustered by Lloyd's rounds in whole numbers: first centroids are
the K vectors with the least sha256 of "2:<vec_id>"; each round gives every vector its nearest centroid (squared Euclidean
distance, ties to the smaller number) and sets each centroid that has vectors to the floor of their exact mean.

Screening: a vector is cut in SEGMENTS equal segments. Its compressed form, made once and stored beside it, holds for each
segment s the part along the segment's diagonal, a_s = sum / sqrt(length), and the norm of what is left, b_s. With
Cauchy-Schwarz on what is left,

    |v - c|^2  =  sum_s (a_s(v) - a_s(c))^2 + |left_s(v) - left_s(c)|^2  >=  sum_s (a_s(v) - a_s(c))^2 + (b_s(v) - b_s(c))^2,

so one product of the compressed forms bounds the distances of a vector to all centroids from below. The centroid of the
least bound is measured exactly; of the others only those whose bound, less a margin for rounding, does not exceed that
distance. Distances are sums of whole numbers of at most 53 bits, so they are exact.

At scale: the vectors are written once and each round reads them where they lie; a task hands on one sum for each
centroid that its vectors took, which Spark sums before and after the shuffle. K centroids (a parameter) travel with the
tasks, nothing else; no vector is shuffled, and a cluster that holds a third of all vectors is as many partial sums as it
has tasks. Rounds follow from tables and K sums alone, so a lost executor costs its own tasks.

Edge cases: vectors of another length, null vectors, and such with null or non-finite components take no part; null ids
take part, and come last among the first centroids; rows that repeat an id are vectors of their own, ordered by their
components there; with fewer vectors than K there are as many centroids; an empty table gives an empty result; further
columns are ignored; components beyond vectors.LIMIT raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import column, lists, matrix, whole

K = 40
ROUNDS = 5
DIMS = 64
SEGMENTS = 16
SALT = "2"
#: Share of a bound, and of the norms it is made of, that rounding can take.
MARGIN = 1e-9
#: Vectors screened together, and pairs measured together.
TILE, PAIRS = 4096, 16384


def compressed(v: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """(rows, 2 * segments): each segment's part along its diagonal, then the norm of what is left."""
    s = v.reshape(len(v), segments, v.shape[1] // segments).astype(np.float64)
    along = s.sum(axis=2) / np.sqrt(s.shape[2])
    left = np.sqrt(np.maximum((s * s).sum(axis=2) - along * along, 0.0))
    return np.concatenate([along, left], axis=1)


def nearest(v: np.ndarray, code: np.ndarray, centroids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, exact distances that were computed) of vectors with their compressed forms."""
    size, c_size = (code * code).sum(axis=1), (codes * codes).sum(axis=1)
    bound = size[:, None] + c_size - 2 * (code @ codes.T)
    bound -= MARGIN * (size[:, None] + c_size) + 1e-6
    wide = v.astype(np.int64)

    def exact(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for lo in range(0, len(rows), PAIRS):
            d = wide[rows[lo : lo + PAIRS]] - centroids[cols[lo : lo + PAIRS]]
            out[lo : lo + PAIRS] = np.einsum("ij,ij->i", d, d)
        return out

    every = np.arange(len(v))
    best = bound.argmin(axis=1)
    distance = exact(every, best)
    bound[every, best] = np.inf
    rows, cols = np.nonzero(bound <= distance[:, None])
    done = len(v) + len(rows)
    if len(rows):
        found = exact(rows, cols)
        # the least (distance, number) of each row; its pairs stand together
        order = np.lexsort((cols, found, rows))
        first = order[np.append(True, rows[order][1:] != rows[order][:-1])]
        r = rows[first]
        better = (found[first] < distance[r]) | ((found[first] == distance[r]) & (cols[first] < best[r]))
        best[r[better]], distance[r[better]] = cols[first][better], found[first][better]
    return best, distance, done


def prepare(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, v, code): the vectors that take part, as whole numbers and compressed."""
    if dims % segments:
        raise ValueError(f"{dims} components are not cut in {segments} equal segments")
    slim = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, x = whole(column(b, "v"))
            fit = size == dims
            v = x[np.repeat(fit, size)].reshape(-1, dims)
            ids = column(b, "vec_id").take(pa.array(kept[fit]))
            yield pa.RecordBatch.from_arrays([ids, lists(v), lists(compressed(v, segments))], ["vec_id", "v", "code"])

    return slim.mapInArrow(run, "vec_id long, v array<int>, code array<double>")


def first_centroids(vectors: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    """The k vectors of the least hash of their id, in that order; ids that repeat go by their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    top = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in top], dtype=np.int64)


def _assigned(vectors: DataFrame, centroids: np.ndarray, segments: int) -> DataFrame:
    codes, (k, dims) = compressed(centroids, segments), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TILE):
                part = b.slice(lo, TILE)
                best, distance, _ = nearest(matrix(column(part, "v"), dims), _codes(part, segments), centroids, codes)
                yield pa.RecordBatch.from_arrays([column(part, "vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _codes(batch: pa.RecordBatch, segments: int) -> np.ndarray:
    c = column(batch, "code")
    return c.flatten().to_numpy().reshape(len(c), 2 * segments)


def step(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The centroids after one round."""
    codes, (k, dims) = compressed(centroids, segments), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)  # the sums and, last, the number of vectors
        for b in batches:
            for lo in range(0, b.num_rows, TILE):
                part = b.slice(lo, TILE)
                v = matrix(column(part, "v"), dims)
                best, _, _ = nearest(v, _codes(part, segments), centroids, codes)
                order = np.argsort(best, kind="stable")
                cut = np.flatnonzero(np.append(True, best[order][1:] != best[order][:-1]))
                total[best[order][cut], :dims] += np.add.reduceat(v[order].astype(np.int64), cut, axis=0)
                total[:, dims] += np.bincount(best, minlength=k)
        own = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), lists(total[own])], ["cluster", "total"])

    sums = vectors.select("v", "code").mapInArrow(run, "cluster int, total array<long>").select("cluster", F.posexplode("total").alias("i", "t"))
    # exact sums beyond 64 bits for any number of vectors; k * (dims + 1) numbers come back
    found = {(r["cluster"], r["i"]): int(r["t"]) for r in sums.groupBy("cluster", "i").agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect()}
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, dims] for i in range(dims)]
    return out


def centroid_hash(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def cluster(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, segments: int = SEGMENTS, salt: str = SALT,
) -> tuple[DataFrame, DataFrame]:
    """(assignment, centroids): (vec_id, cluster, distance) of every vector, and (cluster, centroid, n, cluster_inertia)."""
    spark: SparkSession = rows.sparkSession
    vectors = materialize(prepare(rows, id_col, vector, dims, segments), "kmeans-vectors")
    centroids = first_centroids(vectors, k, salt).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = step(vectors, centroids, segments)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 as cluster", "0L as distance"), spark.createDataFrame([], "cluster int, centroid array<long>, n long, cluster_inertia decimal(38,0)")
    found = materialize(_assigned(vectors, centroids, segments), "kmeans-assigned")
    own = found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    table = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
    return found, table.join(own, "cluster", "left")


def digest(assignment: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector."""
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = centroids.select("cluster", "cluster_inertia", F.sum("cluster_inertia").over(every).alias("inertia"), F.sha2(text, 256).alias("centroid_sha256"))
    out = assignment.join(F.broadcast(c), "cluster")  # one row for each centroid: K at most
    return out.select("vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"), F.col("inertia").cast("long").alias("inertia"), "centroid_sha256")
