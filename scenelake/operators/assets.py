"""Assets, their sidecars, and what follows from both: product, shape, size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng, sizing, text


def with_sidecars(assets: DataFrame, manifests: DataFrame) -> DataFrame:
    """assets (path, dir, stem) with their directory's sidecar, if any; assets of one directory share it.

    An ordinary outer join: Spark broadcasts the sidecars while they are below its threshold.
    """
    return assets.join(manifests.drop("path"), "dir", "left")


def resolve(df: DataFrame) -> DataFrame:
    """sku and shape: of a sidecar with any key, its sku or else the file's stem, and its shape; without one the directory's name."""
    has = F.coalesce(F.size(F.json_object_keys("raw")) > 0, F.lit(False))
    name = F.element_at(F.split("dir", "/"), -1)
    return df.withColumns({
        "sku": F.when(has, F.coalesce(text.truthy(F.col("m_sku")), F.col("stem"))).otherwise(name),
        "shape": F.when(has, F.col("m_shape")),
        "has_sidecar": F.col("raw").isNotNull(),
    })


def with_size(df: DataFrame, seed: int, *keys: Column) -> DataFrame:
    """target_size: the sidecar's estimate, varied, or a random size of the shape."""
    size = sizing.product_size(F.col("m_size"), F.col("shape"), rng.draw(seed, *keys, "jitter"), rng.draw(seed, *keys, "size"))
    return df.withColumn("target_size", size)


def pool_counts(assets: DataFrame) -> DataFrame:
    """One row: assets, assets with a sidecar, stackable assets, products."""
    return assets.agg(
        F.count("*").alias("n_assets"), F.count_if("has_sidecar").alias("n_sidecars"),
        F.count_if(sizing.is_stackable(F.col("shape"))).alias("n_stackable"), F.count_distinct("sku").alias("n_products"),
    )
