"""Assets to datasets: sample, place, simulate, reject, view, render, annotate.

Everything between the adapters is DataFrame code keyed by scene; scenes are independent, so they spread over the
cluster, and a lost executor costs its own scenes only. The adapters stand between the stages, and each stage's rows
should be written as a table there: that cuts the plan where the tools run anyway.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, rng, sizing
from ..operators import annotations as ann
from ..operators import assets as ast
from ..operators import masks, overlap, placement, sampling, views
from ..operators.ids import pass_index
from ..sources.config import SceneConfig


def choose(spark: SparkSession, pool: DataFrame, config: SceneConfig) -> DataFrame:
    """(scene_idx, slot, pool columns): the products of every scene."""
    scenes = spark.range(config.scenes).select(F.col("id").alias("scene_idx"))
    if config.placement == "stacking":
        if pool.where(sizing.is_stackable(F.col("shape"))).limit(2).count() < 2:
            raise ValueError("stacking needs two stackable products or more")
        return sampling.sample_stacking(scenes, "scene_idx", pool, "ordinal_key", sizing.is_stackable(F.col("shape")), config.products_per_scene, config.seed)
    return sampling.sample_products(scenes, "scene_idx", pool, "ordinal_key", config.products_per_scene, config.products_per_scene, config.seed)


def place(chosen: DataFrame, config: SceneConfig, bounds: list[float] | None) -> DataFrame:
    """One row per scene, attempt and object: position, yaw, layer, mode, target size, pass index."""
    scene = ["scene_idx", "attempt"]
    d = placement.attempts(chosen, config.attempts)
    keys = [F.col("scene_idx"), F.col("attempt")]
    zone = sizing.zone(None if bounds is None else F.array(*map(F.lit, bounds)), F.lit(config.placement))
    d = ast.with_size(d, config.seed, *keys, F.col("slot"))
    none = F.lit(None)
    if config.placement == "stacking":
        d = placement.stack_roles(d, scene, "slot", sizing.is_stackable(F.col("shape")), config.seed)
        d = d.withColumn("target_size", F.when(F.col("stack_layer").isNotNull(), sizing.random_size(F.col("shape"), rng.draw(config.seed, *keys, F.col("slot"), "box"))).otherwise(F.col("target_size")))
        side = placement.stack_sides(d, keys, "side_rank", "n_side", config.seed)
        free = placement.scatter(d, keys, "slot", zone, config.seed)
        base = placement.zone_xy(zone, config.seed, [*keys, "base"], 0.4)
        joined = side.join(free.select(*scene, "slot", F.struct("x", "y", "z", "yaw").alias("free")), [*scene, "slot"])
        in_stack, scattered = F.col("stack_layer").isNotNull(), F.col("actual_mode") == "scatter"
        jitter = lambda n: rng.uniform(-0.01, 0.01, rng.draw(config.seed, *keys, F.col("slot"), n))
        pick = lambda c, stacked: F.when(scattered, F.col("free")[c]).when(in_stack, stacked).otherwise(F.col(c))
        d = joined.withColumns({
            "x": pick("x", base[0] + jitter("jx")), "y": pick("y", base[1] + jitter("jy")), "z": pick("z", F.lit(0.0)), "yaw": pick("yaw", rng.uniform(-0.1396263401595464, 0.1396263401595464, rng.draw(config.seed, *keys, F.col("slot"), "yaw"))),
        }).drop("free", "angle", "side_rank", "n_side")
    else:
        if config.placement == "close_far":
            d = placement.close_far(d, keys, "slot", zone, config.n_close, config.seed)
        else:
            d = placement.scatter(d, keys, "slot", zone, config.seed)
        d = d.withColumns({"actual_mode": F.lit(config.placement), "stack_layer": none.cast("int")})
    return pass_index(d, scene, F.col("stack_layer").isNotNull(), "slot")


def settle(placed: DataFrame) -> DataFrame:
    """Heights of stacked boxes, once their extents are known: rows (dx, dy, dz) are scaled sizes of the asset."""
    up = F.greatest("dx", "dy", "dz")
    d = placed.withColumn("height", F.when(F.col("stack_layer").isNotNull(), up))
    below = Window.partitionBy("scene_idx", "attempt").orderBy(F.col("stack_layer").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    floor = F.coalesce(F.sum(F.col("height") + 0.001).over(below), F.lit(0.0))
    return d.withColumn("z", F.when(F.col("height").isNotNull(), floor + F.col("height") / 2).otherwise(F.col("z"))).withColumn(
        "target_size", F.coalesce("height", "target_size")
    )


def accept(simulated: DataFrame) -> DataFrame:
    """Objects of the first attempt of each scene in which no two boxes overlap. rows: (scene_idx, attempt, pass_index, lo, hi, stack_layer, ...)."""
    scene = ["scene_idx", "attempt"]
    d = simulated.withColumn("__stack", F.col("stack_layer").isNotNull())
    tried = overlap.scenes_with_overlap(d, scene, "pass_index", "lo", "hi", stack="__stack")
    good = overlap.first_passing(tried, ["scene_idx"]).where("attempt is not null")
    return d.join(good, scene).drop("__stack")


def dataset(
    accepted: DataFrame, cameras: DataFrame, render: Callable[[DataFrame], DataFrame], categories: DataFrame, config: SceneConfig, default_fov: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(images, annotations). accepted objects carry location, corners (world), matrix, sku, shape, ...

    render(views) returns (scene_idx, cam_idx, pass_index, kind, x, y, height, width) pixels, kind modal or amodal; v is the
    pass index.
    """
    place_ = views.center_radius(accepted, ["scene_idx"], "location", "corners")
    v = views.scene_views(place_, cameras)
    v = views.carry_fov(v, ["scene_idx"], "cam_idx", default=default_fov)
    v = views.pose(v, F.col("center"), F.col("radius"), config.seed, F.col("scene_idx"), F.col("cam_idx"))
    images = ann.images(v, "scene_idx", "cam_idx", config.resolution)
    pixels = render(v)
    keys = ["scene_idx", "cam_idx"]
    modal, amodal = (pixels.where(F.col("kind") == k).withColumn("v", F.col("pass_index")) for k in ("modal", "amodal"))
    seg = lambda p, name: masks.mask_runs(p, keys, "height", "width").select(*keys, F.col("v").alias("pass_index"), F.col("counts").alias(name))
    seen = masks.boxes_and_areas(modal, keys).withColumnRenamed("v", "pass_index")
    seen = seen.join(seg(modal, "counts"), [*keys, "pass_index"]).join(seg(amodal, "amodal_counts"), [*keys, "pass_index"], "left")
    objects = accepted.select("scene_idx", "pass_index", "sku", "shape", "target_size", "actual_mode", "stack_layer", "matrix")
    seen = seen.join(objects, ["scene_idx", "pass_index"]).join(v.select(*keys, "camera_distance_m"), keys)
    size = F.array(F.lit(config.resolution), F.lit(config.resolution))
    rle = lambda c: F.when(F.col(c).isNotNull(), F.struct(size.alias("size"), masks.packed(F.col(c)).alias("counts")))
    meta = ann.metadata(F.col("shape"), F.col("target_size"), F.col("actual_mode"), F.col("stack_layer"), F.col("camera_distance_m"), geometry.world_normals(F.col("matrix")))
    out = ann.annotations(seen, images, categories, keys, "pass_index")
    out = out.withColumns({"segmentation": rle("counts"), "amodal_segmentation": rle("amodal_counts"), "metadata": meta})
    return images.drop(*keys), out.select("id", "image_id", "category_id", "bbox", "area", "segmentation", "iscrowd", "amodal_segmentation", "metadata")
