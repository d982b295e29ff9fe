"""Streams. The flows of this library are batch; replies to size questions may also arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import size_status

SCHEMA = "path string, reply string"


def sized_replies(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """A stateless stream: JSON lines (path, reply) with cm, size_m and status, as they arrive in a folder."""
    return size_status(spark.readStream.schema(schema).json(folder), F.col("reply"))
