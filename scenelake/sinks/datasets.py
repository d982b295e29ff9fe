"""Writers of datasets."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame

from ..operators.annotations import document_lines
from ..scratch import dropped, written
from .inplace import join_parts


def write_tables(root: str, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """The main form: three Parquet tables."""
    for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_document(path: str, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """One JSON document, a file with a line for each object, in the order of the sections and ids.

    Its lines are sorted by range, written as parts by as many tasks, and the parts are copied into place by tasks: no
    list is gathered, and the bytes do not depend on the partitioning. path lies in a file system that all executors
    share; the parts lie beside it until it is complete.
    """
    spark = images.sparkSession
    path = re.sub("^file:/+", "/", path)
    lines = written(document_lines(images, annotations, categories), "document-lines")
    parts = f"{path}.parts"
    lines.repartitionByRange("section", "rank", "id").sortWithinPartitions("section", "rank", "id").select("value").write.mode("overwrite").text(f"file://{parts}")
    dropped(lines)
    names = sorted(n for n in os.listdir(parts) if n.startswith("part-"))
    join_parts(spark, [f"{parts}/{n}" for n in names], path)
    for n in os.listdir(parts):
        os.remove(f"{parts}/{n}")
    os.rmdir(parts)
