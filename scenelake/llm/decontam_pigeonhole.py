"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and runs of Unicode white space become one space. An item of m characters is looked for with at
most k = floor(m * ERROR_RATE) edits (insertions, deletions, substitutions) anywhere in a document. It is split into
k + 1 pieces of nearly equal length; k edits leave one of them whole, so every occurrence holds an exact piece hit
(found by an Aho-Corasick automaton over all pieces). Hits of one item on neighbouring diagonals are verified together
with Myers' bit-parallel distance over the stretch of text that an occurrence around them could cover.

An item with a budget of 0 (shorter than 1 / ERROR_RATE characters) is looked for as whole words: a space or an end of
the text stands on either side of it.

Items come in blocks of at most BLOCK_CHARS characters (an item longer than that is a block of its own); each block is
broadcast and met by every document where it is read: no shuffle. One row per document and item at most.

Edge cases: null or empty texts match nothing, nor do items that are null, blank or without an id; items that repeat are matched each by its own id; repeated rows give
repeated pairs; an empty table of either kind gives an empty result; decontaminate() keeps the columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 (offset, piece) that cover the item; lengths differ by one at most."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any substring of a text (Myers 1999, with integers as bit vectors)."""

    def __init__(self, pattern: str) -> None:
        self.m, self.eq = len(pattern), {}
        for k, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << k

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the first best occurrence."""
        m, get = self.m, self.eq.get
        mask, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = mask, 0, m
        best, at = m, 0
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best, at = score, j + 1
            ph, mh = ph << 1 & mask, mh << 1 & mask
            pv, mv = mh | ~(xv | ph) & mask, ph & xv
        return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE) -> None:
        import ahocorasick

        # texts are searched between two spaces, and so are items without a budget
        self.items = [(i, t if (k := budget(t, rate)) else f" {t} ", k) for i, t in items]
        self.myers: dict[int, Myers] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def match(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, distance) of all items within their budget."""
        t = f" {normal(text)} "
        if not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(t):
            for n, offset in where:
                starts.setdefault(n, set()).add(end + 1 - length - offset)
        out = []
        for n, diagonals in starts.items():
            item, pattern, k = self.items[n]
            verify = self.myers.get(n) or self.myers.setdefault(n, Myers(pattern))
            best, lo, hi = k + 1, None, None
            for d in [*sorted(diagonals), None]:
                if lo is not None and (d is None or d - k > hi):
                    best = min(best, verify.best(t[max(lo, 0) : hi])[0])
                    lo = None
                if d is not None:
                    lo, hi = (d - k if lo is None else lo), d + len(pattern) + k
            if best <= k:
                out.append((item, best))
        return sorted(out)


def _blocks(benchmark: DataFrame, item_col: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of a bounded number of characters; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text).alias("t")).toLocalIterator():
        t = normal(row["t"])
        if row["i"] is None or not t:
            continue
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append((row["i"], t))
        size += len(t)
    if block:
        yield block


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance): items that occur in a document within their budget of edits."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(slim.dtypes)['doc_id']}, item_id long, distance int"
    out = None
    for block in _blocks(benchmark, item_col, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                rows = [(d, i, e) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, e in matcher.match(t)]
                yield pd.DataFrame({
                    "doc_id": pd.Series([r[0] for r in rows], dtype=b["doc_id"].dtype),
                    "item_id": pd.Series([r[1] for r in rows], dtype="int64"),
                    "distance": pd.Series([r[2] for r in rows], dtype="int32"),
                })

        part = slim.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the documents in which an item occurs. Rows with a null id are kept only if they match nothing."""
    spark = docs.sparkSession
    rate = options.get("rate", ERROR_RATE)
    out = docs
    for block in _blocks(benchmark, options.get("item_col", "item_id"), options.get("item_text", "text"), options.get("block_chars", BLOCK_CHARS)):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pd.Series], shared=shared) -> Iterator[pd.Series]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                yield pd.Series([not matcher.match(t) for t in b], dtype=bool)

        out = out.where(F.pandas_udf(clean, "boolean", F.PandasUDFType.SCALAR_ITER)(F.col(f"`{text}`")))
    return out
