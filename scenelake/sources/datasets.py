"""Datasets and index buffers that exist already."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import documents

IMAGE = "struct<id: bigint, file_name: string, width: int, height: int>"
SEGMENT = "struct<counts: string, size: array<int>>"
META = (
    "struct<shape: string, target_size_m: double, placement_mode: string, stack_layer: int, camera_distance_m: double, "
    "front_world_normal: array<double>, back_world_normal: array<double>, top_world_normal: array<double>>"
)
ANNOTATION = (
    f"struct<id: bigint, image_id: bigint, category_id: int, bbox: array<int>, area: bigint, segmentation: {SEGMENT}, iscrowd: int, "
    f"amodal_segmentation: {SEGMENT}, metadata: {META}>"
)
CATEGORY = "struct<id: int, name: string, supercategory: string>"


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a dataset document, which many tasks read in ranges of bytes."""
    return tuple(documents.arrays(spark, path, {"images": IMAGE, "annotations": ANNOTATION, "categories": CATEGORY}).values())


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of image files, lazily."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


def index_pixels(buffers: DataFrame, decode: Callable[[bytes], np.ndarray], keys: list[str], content: str = "content") -> DataFrame:
    """(keys, x, y, v, height, width) of the pixels above 0. decode: file content -> 2-D whole numbers.

    An 8-bit file tells at most 255 objects apart; decode decides.
    """
    kinds = dict(buffers.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["x int", "y int", "v int", "height int", "width int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data, *key in zip(b[content], *(b[k] for k in keys), strict=True):
                a = decode(data)
                ys, xs = np.nonzero(a)
                out = pd.DataFrame({k: [x] * len(xs) for k, x in zip(keys, key, strict=True)})
                yield out.assign(x=xs.astype("int32"), y=ys.astype("int32"), v=a[ys, xs].astype("int32"), height=a.shape[0], width=a.shape[1])

    return buffers.select(*keys, content).mapInPandas(run, schema)
