"""SimHash near-duplicates with BK-trees, and their connected components.

Fingerprints: 64 bits, a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's 3-word shingles.
Two fingerprints link at RADIUS or fewer differing bits. Cut in RADIUS + WHOLE blocks, linked fingerprints agree in at
least WHOLE of them, so each distinct fingerprint goes to one shard for each choice of WHOLE blocks (10 shards with keys
of 25 bits or more). A shard's fingerprints are dealt into chunks of about CHUNK; each chunk is a BK-tree (children
keyed by their integer distance to the parent), which is handed to all later chunks of the shard and searched along the
edges within the radius only. So a tree's size is bounded, nothing passes through the driver, and a shard that holds a
third of all fingerprints is many cells of two chunks each, in tasks of their own.

A cell returns a star for each local component (fingerprint -> least representative), never the pairs; an iterative
min-label contraction over these stars (Parquet in the shared folder between rounds) gives the components. Joins whose
keys can be hot (equal texts' fingerprint, a large component's label) read both sides from such tables, so that Spark's
skew join can split them.

Edge cases: null or empty texts, or without words, have fingerprint 0 and link like any other; fewer than 3 words make
one shingle; equal texts share a fingerprint and a component; rows that repeat a doc_id are one document, so all their
fingerprints are one component; rows with a null doc_id link like any other, and a component of such rows alone has a
null component_id; repeated rows are returned as often as they come; an empty table gives an empty result; further
columns are ignored by fingerprints() and kept by dedup().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

RADIUS = 3
SEED = 42
#: Fingerprints in one BK-tree.
CHUNK = 4096
#: Blocks that a shard's key holds.
WHOLE = 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    grams = map(" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [" ".join(words)]
    h = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    # over half: twice the count beats the number; counts are taken in slices, so memory stays small for long texts
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        count += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInPandas(run, f"doc_id {dict(slim.dtypes)['doc_id']}, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched for many values at once.

    ``child[v, d]`` is the node below v at distance d, or -1.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        n = len(values)
        self.child = np.full((n, 65), -1, dtype=np.int32)
        # all values walk down together; of those that reach a free place, the first stays there
        at, todo = np.zeros(max(n - 1, 0), dtype=np.int64), np.arange(1, n)
        while len(todo):
            d = np.bitwise_count(values[todo] ^ values[at])
            free = self.child[at, d] < 0
            if free.any():
                _, first = np.unique(at[free] * 65 + d[free], return_index=True)
                rows = np.flatnonzero(free)[first]
                self.child[at[rows], d[rows]] = todo[rows]
            at = self.child[at, d].astype(np.int64)
            stay = at != todo
            todo, at = todo[stay], at[stay]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node) of all within the radius, following only edges d - radius .. d + radius."""
        q, v, found = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), []
        if not len(self.values):
            return q[:0], v[:0]
        offsets = np.arange(-radius, radius + 1)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[v]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], v[hit]))
            edge = d[:, None] + offsets
            below = np.where((edge >= 0) & (edge <= 64), self.child[v[:, None], np.clip(edge, 0, 64)], -1)
            rows, cols = np.nonzero(below >= 0)
            q, v = q[rows], below[rows, cols].astype(np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Union:
    """Disjoint sets over 0..n-1; the least member is the root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = a.copy(), b.copy()
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            up = self.up[r]
            if (up == r).all():
                return r
            r = up


def stars(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, index of its representative) of the values that have a partner within the radius.

    Indices run over ``tree`` and then ``queries``; without queries the tree's values are asked against themselves.
    """
    n = len(tree)
    asked, shift = (tree, 0) if queries is None else (queries, n)
    sets, index = Union(n + (0 if queries is None else len(queries))), BKTree(tree)
    for lo in range(0, len(asked), 1024):
        q, v = index.within(asked[lo : lo + 1024], radius)
        sets.join_all(q + lo + shift, v)
    at = np.arange(len(sets.up))
    root = sets.roots(at)
    return at[root != at], root[root != at]


def _keys(blocks: int, whole: int) -> list[tuple[int, int]]:
    """(mask, number) of each choice of ``whole`` out of ``blocks`` runs of the 64 bits, the masks as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    runs = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(runs, whole)]
    return [(m - (1 << 64) if m >> 63 else m, k) for k, m in enumerate(masks)]


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, whole: int = WHOLE) -> DataFrame:
    """(a, b) star edges between node ids, of rows (node, fp) with distinct fp."""
    keys = F.array(*[
        F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for m, k in _keys(radius + whole, whole)
    ])
    placed = nodes.select("node", "fp", F.explode(keys).alias("key")).select("node", "fp", "key.block", "key.part")
    # shards of more than a chunk: c chunks, of which each pair is a cell of its own
    big = placed.groupBy("block", "part").count().where(F.col("count") > chunk)
    big = materialize(big.select("block", "part", F.ceil(F.col("count") / chunk).cast("int").alias("c")), "simhash-big")
    cells = placed.join(big, ["block", "part"], "left").withColumn("c", F.coalesce("c", F.lit(1)))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    cells = cells.select(
        "block", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp"
    )
    by = ["block", "part", "i", "j"]

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _groups(batches, by):
            if len(cell) < 2:
                continue
            cell = cell.sort_values("node")
            node, fp = cell["node"].to_numpy(), cell["fp"].to_numpy().view(np.uint64)
            if cell["i"].iat[0] == cell["j"].iat[0]:
                a, b = stars(fp, None, radius)
            else:
                first = (cell["own"] == cell["i"]).to_numpy()
                node = np.concatenate([node[first], node[~first]])
                a, b = stars(fp[first], fp[~first], radius)
            if len(a):
                yield pd.DataFrame({"a": node[a], "b": node[b]})

    n = partitions(nodes.sparkSession)
    return cells.repartition(n, *by).sortWithinPartitions(*by).mapInPandas(shard, "a long, b long")


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of two or more rows of a partition sorted by the columns; only a group that is still open is kept."""
    open_: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        keys = [b[c].to_numpy() for c in by]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        lo, hi = np.concatenate([[0], new]), np.concatenate([new, [len(b)]])
        if open_ and any(open_[-1][c].iat[-1] != b[c].iat[0] for c in by):
            yield pd.concat(open_, ignore_index=True)
            open_ = []
        if len(lo) == 1:
            open_.append(b)
            continue
        yield pd.concat([*open_, b.iloc[: hi[0]]], ignore_index=True)
        for k in np.flatnonzero(hi - lo > 1):
            if 0 < k < len(lo) - 1:
                yield b.iloc[lo[k] : hi[k]]
        open_ = [b.iloc[lo[-1] :]]
    if open_:
        yield pd.concat(open_, ignore_index=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of an edge can reach. edges: (a, b), any direction.

    Each round gives every node the least label around it and then the label of that label; rounds needed grow with the
    logarithm of a component's diameter for stars and trees, and the loop ends when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "cc-edges")
    # labels from the first look at the neighbours
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "cc-labels")
    while True:
        # hooking: what a label's holders see around them lowers the label itself
        seen = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        seen = materialize(labels.join(seen, "a").select("a", "l", F.least("l", "m").alias("m")), "cc-seen")
        hook = seen.groupBy(F.col("l").alias("a")).agg(F.min("m").alias("h"))
        stepped = seen.join(hook, "a", "left").select("a", F.col("l").alias("old"), F.least("m", F.coalesce("h", "m")).alias("m"))
        stepped = materialize(stepped, "cc-stepped")
        # jumping: the label's own label; a label may have very many holders, and both sides are read from tables
        up = stepped.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        new = materialize(stepped.join(up, "m", "left").select("a", "old", F.least("m", F.coalesce("mm", "m")).alias("l")), "cc-labels")
        for done in (labels, seen, stepped):
            discard(done)
        changed = new.where("l <> old").limit(1).count()
        labels = new.select("a", "l")
        labels._scratch_path = new._scratch_path
        if not changed:
            discard(both)
            out = labels.select(F.col("a").alias("node"), F.col("l").alias("component"))
            out._scratch_path = labels._scratch_path
            return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links. doc_id must be an integer."""
    fps = materialize(fingerprints(docs, id_col, text), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")), "simhash-nodes")
    # rows that repeat a doc_id with different fingerprints: each is tied to the doc_id's least
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b < c")
    several = materialize(several.select("doc_id", "b"), "simhash-several")
    tied = fps.join(several, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b")
    comp = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius).unionByName(tied))
    # components are named by their least fingerprint so far
    named = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = materialize(named, "simhash-named")
    least = materialize(named.groupBy("c").agg(F.min("least").alias("component_id")), "simhash-least")
    of_fp = materialize(named.join(least, "c").select("fp", "component_id"), "simhash-of-fp")
    for done in (nodes, several, named, least, comp):
        discard(done)
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a unique row number, written to the shared folder so that the number stays with its row."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "dedup-rows")


def survivors(rows: DataFrame, comp: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of numbered() with one of each component; comp: (__row, component_id) with every row once.

    Of a component the least id stays, a null id only where there is no other; ties go by the text's hash, then by row.
    """
    key = rows.select("__row", F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    order = F.struct(F.col("i").isNull().alias("none"), "i", "h", "__row")
    best = comp.join(key, "__row").groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.__row").alias("__row"))
    return rows.join(best, "__row", "left_semi").drop("__row")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with exactly one row of each component, that of the least id.

    Rows are told apart by a row number, not by their id: a null id takes part like any other (its row stays if it
    duplicates nothing, else only where its whole component has null ids), repeated rows leave one, and of rows that
    share an id each component decides for itself.
    """
    rows = numbered(docs)
    comp = near_duplicates(rows, "__row", text, radius).select(F.col("doc_id").alias("__row"), "component_id")
    return survivors(rows, comp, id_col, text)
