"""Size estimates from replies: parse, validate, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sizing, text


def wants_size(manifests: DataFrame, redo: bool = False) -> Column:
    """Whether a sidecar is to be sized: it has a title and a shape, and no size key yet (even null) unless redo."""
    missing = text.truthy(F.col("title")).isNull() | text.truthy(F.col("shape")).isNull()
    already = F.coalesce(F.array_contains(F.json_object_keys("raw"), "target_size_m_estimated"), F.lit(False))
    return ~missing & (F.lit(redo) | ~already)


def size_status(df: DataFrame, reply: Column, wanted: Column | None = None) -> DataFrame:
    """df with cm, size_m (3 places, rounded as Python does) and status: skip, fail or done. The order matters: skip comes before any reading."""
    wanted = F.lit(True) if wanted is None else wanted
    out = df.withColumn("cm", F.when(wanted, text.parse_cm(reply)))
    ok = sizing.writable(F.col("cm") / 100)
    status = F.when(~wanted, "skip").when(F.col("cm").isNull(), "fail").when(~ok, "fail").otherwise("done")
    return out.withColumn("status", status).withColumn("size_m", F.when(F.col("status") == "done", sizing.python_round3(F.col("cm") / 100)))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))
