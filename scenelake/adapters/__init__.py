"""Boundaries to what Spark does not do: simulation, rendering, text models.

A simulator takes placements and returns them with a world matrix; a renderer takes views and returns index buffers; a
text source takes prompts and returns replies. Each is a function over pandas frames that runs in mapInPandas, so it
sees one batch at a time on an executor. The fakes stand in for the tools in tests; none of them is an approximation of
the real thing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Batch = Callable[[pd.DataFrame], pd.DataFrame]

WAITS = (5, 10, 20)
TRANSIENT = ("503", "429", "unavailable", "exhausted")


def apply(df: DataFrame, tool: Batch, schema: str) -> DataFrame:
    """df through a tool, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield tool(b)

    return df.mapInPandas(run, schema)


def ask(prompts: DataFrame, model: Callable[[str], str], keys: list[str], prompt: str = "prompt", waits: tuple = WAITS, sleep=time.sleep) -> DataFrame:
    """(keys, reply, error): the model's stripped reply. Transient errors are tried again after the waits; others are kept."""
    kinds = dict(prompts.dtypes)

    def one(text: str) -> tuple[str | None, str | None]:
        for attempt in range(len(waits) + 1):
            try:
                return (model(text) or "").strip(), None
            except Exception as e:  # noqa: BLE001  any failure of the service is an answer here
                message = str(e).lower()
                if attempt == len(waits) or not any(t in message for t in TRANSIENT):
                    return None, f"{type(e).__name__}: {e}"
                sleep(waits[attempt])
        return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(p) for p in b[prompt]]
            yield b[keys].assign(reply=[g[0] for g in got], error=[g[1] for g in got])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["reply string", "error string"])
    return prompts.mapInPandas(run, schema)
