"""File listings as DataFrames.

Executors list the tree (see tree.py); the order is that of the path's components and its numbers are dense. Hidden
directories (_x, .x) are listed too, which recursive file sources skip.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ids import dense_ids
from .tree import Tree, opened

#: Files whose text is held at a time.
FILES = 256


def walk(spark: SparkSession, root: str, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, dir, name) of the files under root whose name matches, listed by executors; paths with scheme and store, but
    for local files."""
    spark.dataSource.register(Tree)
    return spark.read.format("tree").option("pattern", pattern).option("recursive", str(recursive).lower()).load(root)


def plain_path(uri: Column) -> Column:
    """A reader's file URI as walk() writes paths: percent signs decoded (a plus stays one), no scheme for local files."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def with_text(found: DataFrame, name: str) -> DataFrame:
    """found with the text of each path's file, which is small; read by the task that holds the row."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, FILES):
                part = b.slice(k, FILES)
                texts = []
                for path in part.column(part.schema.get_field_index("path")).to_pylist():
                    system, inner, _ = opened(path)
                    with system.open_input_stream(inner) as f:
                        texts.append(f.read().decode())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])

    return found.mapInArrow(run, f"{kinds}, `{name}` string")


def listing(found: DataFrame, *first: Column) -> DataFrame:
    """(path, dir, stem, ordinal) of (path, dir), ordinals in the order of ``first`` and then of the path's components."""
    df = found.select("path", "dir", text.file_stem(F.col("path")).alias("stem"), text.component_order(F.col("path")).alias("__by"), *[c.alias(f"__{k}") for k, c in enumerate(first)])
    order = [*[f"__{k}" for k in range(len(first))], "__by"]
    return dense_ids(df, order[0], order[1:], "ordinal").drop(*order)


def assets(spark: SparkSession, root: str) -> DataFrame:
    """All *.glb files under root, by path components. Raises if there is none."""
    out = listing(walk(spark, root, "*.glb"))
    if out.isEmpty():
        raise FileNotFoundError(f"no .glb files in {root}")
    return out


def backgrounds(spark: SparkSession, root: str) -> DataFrame:
    """Images directly in root: jpg, png, jpeg, each sorted. May be empty."""
    kind = F.regexp_extract("path", r"\.(jpg|png|jpeg)$", 1)
    found = walk(spark, root, "*", recursive=False).where(kind != "")
    return listing(found, F.array_position(F.array(*map(F.lit, ("jpg", "png", "jpeg"))), kind))


def environments(scenes: DataFrame, path: str, seed: int, scene: str) -> DataFrame:
    """Scenes with an environment image and its strength, 0.7 to 1.3."""
    from ..functions.rng import draw, uniform

    return scenes.withColumns({"hdri_path": F.lit(path), "hdri_strength": uniform(0.7, 1.3, draw(seed, F.col(scene), "hdri"))})
