"""Sidecars to size estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import ask
from ..functions import text
from ..operators.sizing import size_status, wants_size


def estimate_sizes(manifests: DataFrame, model: Callable[[str], str], redo: bool = False) -> DataFrame:
    """manifests (path, raw, title, m_shape, ...) with reply, error, cm, size_m and status.

    Only sidecars that want a size are asked about, each once; an error of the service fails its row and no other.
    """
    d = manifests.withColumn("shape", F.col("m_shape"))
    d = d.withColumn("wanted", wants_size(d, redo))
    prompts = d.where("wanted").select("path", text.size_prompt(F.col("title"), F.col("shape")).alias("prompt"))
    d = d.join(ask(prompts, model, ["path"]), "path", "left")
    return size_status(d, F.col("reply"), F.col("wanted"))
