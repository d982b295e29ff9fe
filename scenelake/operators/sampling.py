"""Seeded samples of products for scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from .ids import dense_ids


def with_ordinals(pool: DataFrame, key: str) -> DataFrame:
    """pool with ordinals 0 .. n - 1 in the order of a whole-number key."""
    return dense_ids(pool, key, [], "ordinal")


def sample_products(scenes: DataFrame, scene: str, pool: DataFrame, key: str, k: Column | int, most: int, seed: int, label: str = "product") -> DataFrame:
    """k products for each scene: (scene columns, slot, pool columns).

    Without replacement where the pool holds k or more, else with. The draws are indices, so a scene costs k rows and the
    pool is met in one join on its ordinal; scenes are never crossed with the pool.
    """
    numbered = with_ordinals(pool, key)
    size = pool.agg(F.count("*").alias("__n"))  # one row
    drawn = scenes.join(F.broadcast(size)).select(
        *scenes.columns, F.posexplode(rng.sample_indices(F.col("__n"), k, most, seed, F.col(scene), label)).alias("slot", "ordinal")
    )
    return drawn.join(numbered, "ordinal").drop("ordinal")


def sample_stacking(scenes: DataFrame, scene: str, pool: DataFrame, key: str, stackable: Column, k: int, seed: int) -> DataFrame:
    """Two or three stackable products and others up to k in all (so a small k is exceeded), stackable ones first."""
    boxes, others = pool.where(stackable), pool.where(~stackable)
    count = boxes.agg(F.count("*").alias("n_boxes")).join(others.agg(F.count("*").alias("n_others")))
    wants = scenes.join(F.broadcast(count))  # one row
    n_box = F.least(F.col("n_boxes"), rng.randint(2, 3, rng.draw(seed, F.col(scene), "n_box")))
    n_other = F.least(F.greatest(F.lit(0), F.lit(k) - n_box), F.col("n_others"))
    wants = wants.withColumns({"want_box": n_box, "want_other": n_other})
    a = sample_products(wants, scene, boxes, key, F.col("want_box"), 3, seed, "box")
    b = sample_products(wants, scene, others, key, F.col("want_other"), max(k, 1), seed, "other")
    out = a.withColumn("stackable", F.lit(True)).unionByName(b.withColumn("stackable", F.lit(False)))
    out = out.withColumn("slot", F.col("slot") + F.when(F.col("stackable"), 0).otherwise(F.col("want_box")))
    return out.drop("n_boxes", "n_others", "want_box", "want_other")


def top_k_by_hash(df: DataFrame, by: list[str], key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group in a random order: a window limit, which Spark applies before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(rng.order_key(seed, F.col(key)), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def pick_one(scenes: DataFrame, scene: str, files: DataFrame, order: list[str | Column], seed: int, name: str) -> DataFrame:
    """One of a short list of files for each scene; null where there is none. files: a directory listing."""
    listed = files.select(F.row_number().over(Window.orderBy(*order)).alias("__at"), F.col(name).alias(name))
    n = files.agg(F.count("*").alias("__n"))
    drawn = scenes.join(F.broadcast(n)).withColumn("__at", rng.choice_index(F.col("__n"), rng.draw(seed, F.col(scene), name)) + 1)
    return drawn.join(listed, "__at", "left").drop("__at", "__n")


def first_then_existing(images: DataFrame, n: int, files: DataFrame, file_name: str = "file_name", order: str = "id") -> DataFrame:
    """The first n images, and of those the ones whose file exists: the limit comes first."""
    return images.orderBy(order).limit(n).join(files.select(file_name).distinct(), file_name, "left_semi")
