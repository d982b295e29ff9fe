"""Placement of products as data: one row per object and attempt."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, rng, sizing
from ..scratch import dropped, written


def attempts(scenes: DataFrame, most: int = 3) -> DataFrame:
    """Each scene once for every attempt; attempts draw afresh because their number is part of the key."""
    return scenes.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))


def retried(objects: DataFrame, scene: list[str], judge: Callable[[DataFrame], DataFrame], most: int = 3, attempt: str = "attempt") -> DataFrame:
    """(scene, attempt): each scene's first good attempt, null where none of ``most`` was good.

    judge(objects with their attempt) gives (scene, attempt, has_overlap). Only the scenes whose last attempt failed are
    placed again, and the loop ends when there is none: the work falls with the share of good attempts. What is carried from
    one attempt to the next is a table of scene keys; draws are named by the attempt, so the result is the same as if all
    attempts of all scenes had been placed.
    """
    objects = written(objects, "retried-objects")
    done, left = [], objects
    for k in range(most):
        tried = written(judge(left.withColumn(attempt, F.lit(k))).select(*scene, F.col("has_overlap").alias("__bad")), "retried")
        failed = tried.where("__bad").select(*scene)
        if k == most - 1 or failed.isEmpty():
            done.append(tried.select(*scene, F.when(~F.col("__bad"), k).alias(attempt)))
            break
        done.append(tried.where(~F.col("__bad")).select(*scene, F.lit(k).alias(attempt)))
        left = objects.join(failed, scene, "left_semi")
    dropped(objects)
    return reduce(DataFrame.unionByName, done)


def zone_xy(zone: Column, seed: int, keys: list, scale: float = 1.0) -> tuple[Column, Column]:
    x = rng.uniform(zone[0] * scale, zone[1] * scale, rng.draw(seed, *keys, "x"))
    y = rng.uniform(zone[2] * scale, zone[3] * scale, rng.draw(seed, *keys, "y"))
    return x, y


def _yaw(seed: int, keys: list) -> Column:
    return rng.uniform(0.0, 2 * math.pi, rng.draw(seed, *keys, "yaw"))


def scatter(df: DataFrame, keys: list, ordinal: str, zone: Column, seed: int) -> DataFrame:
    """Anywhere in the zone, each object 0.15 m above the one before."""
    k = [*keys, F.col(ordinal)]
    x, y = zone_xy(zone, seed, k)
    return df.withColumns({"x": x, "y": y, "z": 0.25 + F.col(ordinal) * 0.15, "yaw": _yaw(seed, k)})


def close_far(df: DataFrame, keys: list, ordinal: str, zone: Column, n_close: int, seed: int) -> DataFrame:
    """The first n_close in the zone, the others on a ring of 0.30 to 0.50 m. An extra mode."""
    k = [*keys, F.col(ordinal)]
    x, y = zone_xy(zone, seed, k)
    r = rng.uniform(0.30, 0.50, rng.draw(seed, *k, "r"))
    fx, fy = geometry.polar(r, rng.uniform(0.0, 2 * math.pi, rng.draw(seed, *k, "angle")))
    near = F.col(ordinal) < n_close
    return df.withColumns({
        "x": F.when(near, x).otherwise(fx), "y": F.when(near, y).otherwise(fy), "z": 0.25 + F.col(ordinal) * 0.12, "yaw": _yaw(seed, k),
    })


def stack_roles(df: DataFrame, scene: list[str], ordinal: str, stackable: Column, seed: int) -> DataFrame:
    """Who stands in the stack: stack_layer of the first two or three stackable products of a scene, side_rank of the rest.

    With fewer than two stackable products nothing is stacked and actual_mode is scatter.
    """
    w = Window.partitionBy(*scene)
    n_box = F.sum(stackable.cast("int")).over(w)
    n_stack = F.least(n_box, rng.randint(2, 3, rng.draw(seed, *[F.col(c) for c in scene], "n_stack")))
    box_rank = F.row_number().over(w.orderBy((~stackable).cast("int"), ordinal)) - 1
    out = df.withColumns({"__n_box": n_box, "__rank": box_rank, "__n_stack": n_stack, "__n": F.count("*").over(w)})
    stacked = F.col("__n_box") >= 2
    return out.withColumns({
        "actual_mode": F.when(stacked, "stacking").otherwise("scatter"),
        "stack_layer": F.when(stacked & (F.col("__rank") < F.col("__n_stack")), F.col("__rank").cast("int")),
        "side_rank": F.when(stacked & (F.col("__rank") >= F.col("__n_stack")), F.col("__rank") - F.col("__n_stack")),
        "n_side": F.when(stacked, F.col("__n") - F.col("__n_stack")),
    }).drop("__n_box", "__rank", "__n_stack", "__n")


def ring_angles(rank: Column, n: Column, offset: Column, jitter: Column) -> Column:
    """Even angles with a jitter of a quarter step either way."""
    step = 2 * math.pi / F.greatest(n, F.lit(1))
    return offset + rank * step + rng.uniform(-0.25 * step, 0.25 * step, jitter)


def stack_sides(df: DataFrame, scene: list, rank: str, n: str, seed: int) -> DataFrame:
    """Side products around a stack: 0.25 to 0.45 m out, staggered by 0.20 m."""
    k = [*scene, F.col(rank)]
    offset = rng.uniform(0.0, 2 * math.pi, rng.draw(seed, *scene, "offset"))
    angle = ring_angles(F.col(rank), F.col(n), offset, rng.draw(seed, *k, "jitter"))
    x, y = geometry.polar(rng.uniform(0.25, 0.45, rng.draw(seed, *k, "r")), angle)
    return df.withColumns({"x": x, "y": y, "z": 0.30 + F.col(rank) * 0.20, "yaw": _yaw(seed, k), "angle": angle})


def stack_floor(df: DataFrame, scene: list[str], layer: str, height: str, gap: float = 0.001) -> DataFrame:
    """z of each box's centre: it sits on all boxes below, with a gap above each."""
    below = Window.partitionBy(*scene).orderBy(layer).rowsBetween(Window.unboundedPreceding, -1)
    floor = F.coalesce(F.sum(F.col(height) + gap).over(below), F.lit(0.0))
    return df.withColumns({"z_floor": floor, "z": floor + F.col(height) / 2})


def stack_boxes(df: DataFrame, scene: list, layer: str, zone: Column, seed: int) -> DataFrame:
    """Base of a stack in the inner zone (scale 0.4) and each box's own offset of up to 0.01 m; upright rotation."""
    x, y = zone_xy(zone, seed, [*scene, "base"], 0.4)
    k = [*scene, F.col(layer), "box"]
    jx, jy = (rng.uniform(-0.01, 0.01, rng.draw(seed, *k, n)) for n in ("jx", "jy"))
    return df.withColumns({"x": x + jx, "y": y + jy, "rotation": geometry.upright(F.col("dx"), F.col("dy"), F.col("dz"), rng.draw(seed, *k, "yaw"))})
