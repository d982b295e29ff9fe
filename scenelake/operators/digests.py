"""Digests of whole ordered columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values joined to one string by the tasks before.
RUN = 128


def ordered_md5(values: DataFrame, place: Column, value: Column, separator: str = ",", run: int = RUN) -> DataFrame:
    """One row (n, md5): the number of values, and the MD5 of all of them joined in the order of their places (dense, from 0).

    An MD5 is one chain over its bytes, so one task has to see them all, in order. It gets them as strings of ``run``
    values that other tasks have joined, sorted by Spark, and holds a batch of these at a time: the joined text, as long
    as all values, is never a value itself. Without values the MD5 is null.
    """
    one = values.select(place.alias("place"), value.cast("string").alias("value"))
    runs = one.groupBy(F.floor(F.col("place") / run).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("r"))
    runs = runs.select("run", F.size("r").cast("long").alias("n"), F.array_join(F.col("r.value"), separator).alias("text"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, between = hashlib.md5(), 0, separator.encode()
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                digest.update((between if n else b"") + text.as_buffer().to_pybytes())
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["n", "md5"])

    found = runs.repartition(1).sortWithinPartitions("run").select("n", "text").mapInArrow(chained, "n long, md5 string")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("md5").alias("md5"))
