"""Views: scenes by cameras, poses, fields of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, rng


def scene_views(scenes: DataFrame, cameras: DataFrame, most_cameras: int = 10_000) -> DataFrame:
    """Every scene with every camera. The camera list is configuration; its size is checked before it is broadcast."""
    n = cameras.limit(most_cameras + 1).count()
    if n == 0 or n > most_cameras:
        raise ValueError(f"{n} cameras; 1 to {most_cameras} are needed")
    return scenes.crossJoin(F.broadcast(cameras))


def carry_fov(views: DataFrame, scene: list[str], order: str, fov: str = "fov_deg", default: float | None = None) -> DataFrame:
    """A camera without a field of view keeps the one before it in its scene."""
    w = Window.partitionBy(*scene).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(fov, ignorenulls=True).over(w)
    return views.withColumn(fov, last if default is None else F.coalesce(last, F.lit(default)))


def pose(views: DataFrame, center: Column, radius: Column, seed: int, *keys: Column) -> DataFrame:
    """location, basis and rotation_euler (radians, about x, then y, then z) of each view: look_at wins over
    rotation_euler_deg; no location at all is a random orbit; a location with neither raises."""
    draw = lambda n: rng.draw(seed, *keys, n)
    free = F.col("location").isNull()
    location = F.when(free, geometry.orbit(center, radius, draw("theta"), draw("phi"), draw("r"))).otherwise(F.col("location"))
    out = views.withColumns({"location": location, "__free": free})
    target = F.when(F.col("__free"), center).otherwise(F.col("look_at"))
    bad = F.raise_error(F.lit("a camera needs look_at or rotation_euler_deg")).cast("array<double>")
    given = F.transform("rotation_euler_deg", F.radians)
    basis = F.when(target.isNotNull(), geometry.look_at_basis(F.col("location"), target)).otherwise(F.coalesce(geometry.euler_basis(given), bad))
    out = out.withColumns({"basis": basis, "camera_distance_m": geometry.distance(F.col("location"), center)})
    return out.withColumn("rotation_euler", F.when(target.isNotNull(), geometry.basis_euler(F.col("basis"))).otherwise(given)).drop("__free")


def center_radius(objects: DataFrame, scene: list[str], location: str, corners: str, least: float = 0.05) -> DataFrame:
    """(scene, center, radius): mean location, and the farthest corner's distance from it."""
    mean = F.array(*[F.avg(F.col(location)[i]) for i in range(3)])
    # a scene's corners, eight for each of a handful of objects, are kept with the sums: one grouping
    one = objects.groupBy(*scene).agg(mean.alias("center"), F.flatten(F.collect_list(corners)).alias("__corners"))
    far = F.array_max(F.transform("__corners", lambda c: geometry.distance(c, F.col("center"))))
    return one.select(*scene, "center", F.greatest(F.lit(least), far).alias("radius"))
