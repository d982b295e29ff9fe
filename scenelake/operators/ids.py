"""Dense ids without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: monotonically_increasing_id: the partition's number above these bits, the row's place in it below.
_PLACE_BITS = 33


def dense_ids(df: DataFrame, major: str | Column, minor: list[str | Column], name: str = "id", start: int = 0) -> DataFrame:
    """df with ids in the order (major, minor), from start on.

    df is planned once: its rows are sorted by range and written with their partition and place in it. An id is the
    place plus the rows of all partitions before, a running sum over one count per partition, which is broadcast. Ranges
    are cut between rows, so a major key that holds a third of all rows is many partitions. Rows that tie in the order
    get ids in the order in which they were written, which no later read changes.
    """
    ordered = df.repartitionByRange(major, *minor).sortWithinPartitions(major, *minor)
    table = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "dense-ids")
    part = F.shiftright("__at", _PLACE_BITS)
    counts = table.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = table.join(F.broadcast(offsets), part == F.col("__part"))  # a row for each partition
    place = F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return numbered.withColumn(name, F.col("__offset") + place + F.lit(start).cast("long")).drop("__at", "__part", "__offset")


def category_ids(names: DataFrame, column: str) -> DataFrame:
    """(name, id, supercategory): ids from 1 over the sorted distinct names. Names are products, a table driven by hand."""
    one = names.select(F.col(column).alias("name")).where("name is not null").distinct()
    return one.select(F.row_number().over(Window.orderBy("name")).alias("id"), "name", F.lit("product").alias("supercategory"))


def pass_index(df: DataFrame, scene: list[str], is_stack: Column, ordinal: str) -> DataFrame:
    """Object numbers from 1 within a scene: stack members first."""
    w = Window.partitionBy(*scene).orderBy((~is_stack).cast("int"), ordinal)
    return df.withColumn("pass_index", F.row_number().over(w))
