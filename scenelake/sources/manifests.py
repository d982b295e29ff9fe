"""Sidecar files: one JSON object per asset directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .files import walk, with_text

NAME = "manifest_entry.json"
SIZE = "$.target_size_m_estimated"
SCHEMA = "sku string, title string, shape string, target_size_m_estimated string"


def parse(raw: DataFrame) -> DataFrame:
    """(dir, raw, m_sku, title, m_shape, m_size) of rows (path, raw). A file that is no JSON object raises.

    m_size is the object's own size key as a number (keys of objects within it do not count): a JSON true counts as 1
    and false as 0, strings do not count.
    """
    ok = F.json_object_keys("raw").isNotNull()
    checked = raw.withColumn("raw", F.when(ok, F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("path")))))
    e = F.from_json("raw", SCHEMA)
    whole = F.try_parse_json("raw")
    kind = F.schema_of_variant(F.try_variant_get(whole, SIZE, "variant"))
    size = F.when(kind == "BOOLEAN", F.try_variant_get(whole, SIZE, "boolean").cast("double")).when(kind != "STRING", F.try_variant_get(whole, SIZE, "double"))
    return checked.select(
        text.parent_path(F.col("path")).alias("dir"), "path", "raw", e["sku"].alias("m_sku"), e["title"].alias("title"),
        e["shape"].alias("m_shape"), size.alias("m_size"),
    )


def read(spark: SparkSession, root: str) -> DataFrame:
    """All sidecars under root, each file read once, where its name is listed. Raises if there is none."""
    found = walk(spark, root, NAME).select("path")
    if found.isEmpty():
        raise FileNotFoundError(f"no {NAME} in {root}")
    return parse(with_text(found, "raw"))
