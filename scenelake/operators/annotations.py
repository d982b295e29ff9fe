"""Image, annotation and category tables, and the nested document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import written
from .ids import dense_ids


def images(views: DataFrame, scene: str, camera: str, resolution: int) -> DataFrame:
    """(id, file_name, width, height, scene, camera): ids from 0 over the scenes that succeeded; names keep the scene number."""
    d = dense_ids(views.select(scene, camera), scene, [camera], "id")
    return d.select("id", text.image_name(F.col(scene), F.col(camera)).alias("file_name"), F.lit(resolution).alias("width"), F.lit(resolution).alias("height"), scene, camera)


def metadata(shape: Column, target_size: Column, mode: Column, layer: Column, camera_distance: Column, normals: Column) -> Column:
    return F.struct(
        text.truthy(shape).alias("shape"), target_size.cast("double").alias("target_size_m"), mode.alias("placement_mode"),
        layer.cast("int").alias("stack_layer"), camera_distance.alias("camera_distance_m"),
        *[normals[n].alias(n) for n in ("front_world_normal", "back_world_normal", "top_world_normal")],
    )


def annotations(objects: DataFrame, image_table: DataFrame, categories: DataFrame, keys: list[str], obj: str, sku: str = "sku") -> DataFrame:
    """objects (keys, obj, sku, bbox, area, counts, ...) that are seen, with image, category and own ids from 0.

    A product that has no category raises.
    """
    seen = objects.where(F.col("area") > 0)
    d = seen.join(image_table.select(*keys, F.col("id").alias("image_id")), keys)
    d = d.join(categories.select(F.col("name").alias(sku), F.col("id").alias("category_id")), sku, "left")
    unknown = F.raise_error(F.concat(F.lit("product without a category: "), F.coalesce(F.col(sku).cast("string"), F.lit("null"))))
    d = d.withColumn("category_id", F.coalesce("category_id", unknown.cast("int")))
    return dense_ids(d, "image_id", [obj], "id").withColumn("iscrowd", F.lit(0))


def flat(image_table: DataFrame, annotation_table: DataFrame, categories: DataFrame) -> DataFrame:
    """(file_name, annotation_id, category, bbox): images without annotations stay, with nulls."""
    a = annotation_table.select(F.col("id").alias("annotation_id"), "image_id", "category_id", "bbox")
    a = a.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id")
    return image_table.join(a, image_table["id"] == a["image_id"], "left").select("file_name", "annotation_id", "category", "bbox")


def label_anchor(bbox: Column) -> tuple[Column, Column]:
    """Where a label stands: above the box's upper left corner."""
    return bbox[0], bbox[1] - 5


#: Keys of an annotation that are left out where they are null; nulls within them are written.
OPTIONAL = ("amodal_segmentation", "metadata")


def json_object(df: DataFrame) -> Column:
    """A row as a JSON object, without those optional keys that are null."""
    full = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(*[c for c in df.columns if c not in OPTIONAL]), full)
    more = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{c}":'), F.to_json(c, full))).otherwise("") for c in OPTIONAL if c in df.columns]
    return F.concat(F.left(head, F.length(head) - 1), *more, F.lit("}"))


def document_lines(image_table: DataFrame, annotation_table: DataFrame, categories: DataFrame) -> DataFrame:
    """(section, rank, id, value): the lines of one JSON document in that order, one for each object; ids are distinct.

    The line breaks are white space to a JSON reader. Which object is its section's first, and so has no comma before it,
    is one number for each section.
    """
    head = image_table.sparkSession.createDataFrame(
        [(0, 0, None, '{"images":['), (1, 0, None, '],"annotations":['), (2, 0, None, '],"categories":['), (3, 0, None, "]}")], "section int, rank int, id long, value string",
    )
    each = [df.select(F.lit(k).alias("section"), F.lit(1).alias("rank"), F.col("id").cast("long").alias("id"), json_object(df).alias("value")) for k, df in enumerate((image_table, annotation_table, categories))]
    rows = written(reduce(DataFrame.unionByName, each), "document-rows")
    first = rows.groupBy(F.col("section").alias("__s")).agg(F.min("id").alias("__first"))  # three rows
    rows = rows.join(F.broadcast(first), F.col("section") == F.col("__s"))
    comma = F.when(F.col("id") > F.col("__first"), ",").otherwise("")
    return head.unionByName(rows.select("section", "rank", "id", F.concat(comma, "value").alias("value")))


def line_objects(lines: DataFrame, section: int, kind: str) -> DataFrame:
    """The objects of one section of document_lines as columns, parsed from their JSON. A malformed one raises."""
    value = F.ltrim(F.col("value"), F.lit(","))
    each = lines.where((F.col("section") == section) & (F.col("rank") == 1))
    return each.select(F.from_json(value, kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def document(image_table: DataFrame, annotation_table: DataFrame, categories: DataFrame) -> DataFrame:
    """One row, one JSON string: images, annotations, categories by id. For datasets that fit one row; see document_lines."""
    whole = None
    for name, df in (("images", image_table), ("annotations", annotation_table), ("categories", categories)):
        rows = df.select("id", json_object(df).alias("r")).agg(F.sort_array(F.collect_list(F.struct("id", "r"))).alias(name))
        text_ = rows.select(F.concat(F.lit(f'"{name}":['), F.array_join(F.col(f"{name}.r"), ","), F.lit("]")).alias(name))
        whole = text_ if whole is None else whole.crossJoin(text_)  # one row each
    return whole.select(F.concat(F.lit("{"), F.concat_ws(",", "images", "annotations", "categories"), F.lit("}")).alias("value"))


__all__ = ["annotations", "document", "document_lines", "flat", "images", "label_anchor", "line_objects", "metadata"]
