"""Camera configuration: a list of cameras, or an object with cameras and a drop zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAMERA = "struct<location: array<double>, look_at: array<double>, rotation_euler_deg: array<double>, fov_deg: double>"
DEFAULT_ZONE = (0.12, 0.12)


def parse(spark: SparkSession, text: str) -> tuple[DataFrame, list[float] | None]:
    """(cameras, drop bounds): (cam_idx, location, look_at, rotation_euler_deg, fov_deg). Only the object form sets bounds."""
    raw = spark.range(1).select(F.lit(text).alias("raw"))
    is_list = text.lstrip().startswith("[")
    if is_list:
        cams = raw.select(F.from_json("raw", f"array<{CAMERA}>", {"mode": "FAILFAST"}).alias("c"))
        bounds = None
    else:
        doc = raw.select(F.from_json("raw", f"cameras array<{CAMERA}>, drop_zone array<double>", {"mode": "FAILFAST"}).alias("d"))
        cams = doc.select(F.col("d.cameras").alias("c"))
        one = doc.select("d.drop_zone", F.col("d.cameras").isNull().alias("missing")).first()
        if one["missing"]:
            raise KeyError("cameras")
        x, y = one["drop_zone"] or DEFAULT_ZONE
        bounds = [-x, x, -y, y]
    return cams.select(F.posexplode("c").alias("cam_idx", "cam")).select("cam_idx", "cam.*"), bounds


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list[float] | None]:
    return parse(spark, spark.read.text(path, wholetext=True).first()["value"])


def random_views(spark: SparkSession, n: int) -> DataFrame:
    """n cameras without a pose: each view draws its own."""
    none = [F.lit(None).cast("array<double>").alias(c) for c in ("location", "look_at", "rotation_euler_deg")]
    return spark.range(n).select(F.col("id").cast("int").alias("cam_idx"), *none, F.lit(None).cast("double").alias("fov_deg"))
