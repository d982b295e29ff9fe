"""Sidecars with a size set, other keys and their order kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inplace import replace_files


def rewritten(manifests: DataFrame, size: str = "size_m") -> DataFrame:
    """(path, value): each sidecar's text with its size, indented by 2. Rows without a size are left out.

    Keys keep their order; of a key that repeats, the last counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            value = []
            for raw, s in zip(b["raw"], b[size], strict=True):
                entry = json.loads(raw)
                entry["target_size_m_estimated"] = round(float(s), 3)
                value.append(json.dumps(entry, indent=2))
            yield pd.DataFrame({"path": b["path"], "value": value})

    return manifests.where(F.col(size).isNotNull()).select("path", "raw", size).mapInPandas(run, "path string, value string")


def write(texts: DataFrame, root: str) -> None:
    """As Parquet (path, value), beside the files."""
    texts.write.mode("overwrite").parquet(root)


def write_in_place(texts: DataFrame) -> int:
    """Each sidecar replaced where it lies, all or none; the number of files. See inplace.replace_files."""
    return replace_files(texts)
