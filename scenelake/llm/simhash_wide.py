"""SimHash near-dedup with BK-trees for a similarity of whole texts: five-word shingles, a wide radius, an exact check.

Two texts link if the sets of their WORDS-word shingles (ASCII lower case; words as in simhash_bktree) have a Jaccard
similarity of SIMILARITY or more. Fingerprints are SimHashes of the distinct shingles' hashes. At a similarity of 0.8 the
bits of two fingerprints differ with probability 0.15, so links lie some 10 bits apart, up to the radius of 26 (5.5
standard deviations). No choice of whole bit blocks holds such pairs (a key of 24 bits agrees in 2 % of them), so the
shards of the search are made from the texts' shingles: the minima of 128 hashes, cut in BANDS bands; texts that agree in
a band are of one shard. A pair of similarity s is in no shard together with probability (1 - s^4)^32: 5e-8 at 0.8, less
above; this, the radius and the signatures' bound are the only chance in it, and all are seeded.

Texts with equal sets are one node from the start. Overlapping shards are joined to candidate groups. Each node is
compared with its group's least node first; only what is not near it (far nodes) goes on to the search, in cells of at
most two chunks. So a large group of copies costs one comparison a node, no pairs of its nodes are made, and components
stay whole.

Shards of unlike texts can chain into one large group whose nodes are nearly all far. So a cell first holds fingerprints
and signatures only (8 + 128 bytes a node): far nodes are searched in one BK-tree along the edges within the radius, and a
hit is live if as many of the 128 minima agree as at the similarity, less 5.5 standard deviations. Texts are fetched for
live nodes alone, to the cells where they are live; there the search is made again and each hit between nodes that are
not joined yet is checked by its sets.

Edge cases: fewer than WORDS words make one shingle; null or empty texts, or without words, have an empty set and equal
each other only. Rows are told apart by row number (see simhash_bktree.dedup): null ids and repeated rows take part like
any other. An empty table gives an empty result; further columns are kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions
from .simhash_bktree import _LOWER, _WORD, BKTree, Union, _groups, components, numbered, survivors

WORDS = 5
SIMILARITY = 0.8
BANDS, PER_BAND = 32, 4
#: Nodes of each kind in one cell; pairs whose signatures are compared at a time.
CHUNK, PAIRS = 512, 1 << 16
SEED = 42
_MUL = np.random.default_rng(SEED).integers(0, 2**63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Texts to sorted distinct 64-bit hashes of their shingles; words' hashes are remembered."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = _WORD.findall((text or "").translate(_LOWER))
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 500_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxh64_intdigest(w, SEED)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * _STEP + h[j : j + n]
        return np.unique(_mix(out))


def minima(s: np.ndarray) -> np.ndarray:
    """The least of a set's values under each hash; the largest number for the empty set."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 512):
        low = np.minimum(low, (s[k : k + 512, None] * _MUL).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a set's minima."""
    key = np.arange(BANDS, dtype=np.uint64)
    for col in low.reshape(BANDS, PER_BAND).T:
        key = _mix(key * _STEP + col)
    return key


def signature(low: np.ndarray) -> bytes:
    """A byte of each minimum."""
    return _mix(low).astype(np.uint8).tobytes()


def least_agreement(similarity: float) -> float:
    """Share of the signatures' bytes that agree, at least, at this similarity: 5.5 deviations below it."""
    return similarity - 5.5 * float(np.sqrt(similarity * (1 - similarity) / (BANDS * PER_BAND)))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes, row by row."""
    return (a == b).mean(axis=1)


def signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def live_nodes(fps: np.ndarray, sigs: np.ndarray, far: np.ndarray, similarity: float) -> np.ndarray:
    """Which nodes of a cell have a partner that may be near; one of the two is far."""
    tree, least, out = BKTree(fps), least_agreement(similarity), np.zeros(len(fps), bool)
    asked, step = np.flatnonzero(far), max(1, PAIRS // max(len(fps), 1))
    for lo in range(0, len(asked), step):
        q, v = tree.within(fps[asked[lo : lo + step]], radius_for(similarity))
        q = asked[lo + q]
        q, v = q[q != v], v[q != v]
        for at in range(0, len(q), PAIRS):
            i, j = q[at : at + PAIRS], v[at : at + PAIRS]
            hit = agreement(sigs[i], sigs[j]) >= least
            out[i[hit]] = out[j[hit]] = True
    return out


def near(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``similarity``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return not len(b)
    if len(a) < similarity * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both >= similarity * (len(a) + len(b) - both)


def fingerprint_of(s: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes: a bit is 1 if it is set in over half of them; 0 for the empty set."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(s), 65536):
        count += np.unpackbits(s[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(s), bitorder="little").view("<u8")[0])


def radius_for(similarity: float) -> int:
    """Bits that fingerprints of two sets of like size and this Jaccard similarity differ in at most, up to 5.5 deviations."""
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return min(64, int(np.ceil(64 * p + 5.5 * np.sqrt(64 * p * (1 - p)))))


def cell_links(sets: list[np.ndarray], joined: np.ndarray, similarity: float) -> np.ndarray:
    """For each set the index of its component's first member; those marked ``joined`` are one component already.

    The others are searched in a BK-tree over all; a hit counts if the sets are near.
    """
    parts, radius = Union(len(sets)), radius_for(similarity)
    one = np.flatnonzero(joined)
    parts.join_all(one[1:], np.full(max(len(one) - 1, 0), one[0] if len(one) else 0))
    fps = np.array([fingerprint_of(s) for s in sets], np.uint64)
    tree = BKTree(fps)
    for k in np.flatnonzero(~joined):
        _, hits = tree.within(fps[k : k + 1], radius)
        hits = np.sort(hits)
        while len(hits):
            mine = parts.roots(np.array([k]))
            hits = hits[parts.roots(hits) != mine]
            found = next((i for i, j in enumerate(hits) if near(sets[k], sets[j], similarity)), None)
            if found is None:
                break
            parts.join_all(np.array([k]), hits[found : found + 1])
            hits = hits[found + 1 :]
    return parts.roots(np.arange(len(sets)))


def near_duplicates(rows: DataFrame, text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(__row, component_id) of rows with distinct __row (long): component_id is the least __row reachable over links."""
    spark = rows.sparkSession

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        cut = Shingles(words)
        for b in batches:
            rows_ = []
            for row, t in zip(b["row"], b["text"], strict=True):
                s = cut(t)
                low = minima(s)
                keys = band_keys(low).view(np.int64) if len(s) else np.zeros(0, np.int64)
                rows_.append((row, xxh64_intdigest(s.tobytes(), SEED), keys, fingerprint_of(s), signature(low)))
            out = pd.DataFrame(rows_, columns=["row", "same", "keys", "fp", "sig"])
            yield out.assign(same=out["same"].to_numpy(np.uint64).view(np.int64), fp=out["fp"].to_numpy(np.uint64).view(np.int64))

    slim = rows.select(F.col("__row").alias("row"), F.col(f"`{text}`").alias("text"))
    signed = materialize(slim.mapInPandas(sign, "row long, same long, keys array<long>, fp long, sig binary"), "wide-keys")
    nodes = materialize(signed.groupBy("same").agg(F.min("row").alias("node")), "wide-nodes")
    placed = signed.join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    least = materialize(placed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b"), "wide-least")
    stars = placed.join(least, "key").where("node <> b").select(F.col("node").alias("a"), "b")
    # the same components by fewer edges: a node and its firsts all lead to the least of these
    stars = stars.distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))
    stars = materialize(stars, "wide-stars")
    grouped = components(stars.select("a", F.col("m").alias("b")).unionByName(stars.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
    cand = materialize(grouped.join(signed, grouped.node == signed.row).select("node", F.col("component").alias("first"), "fp", "sig"), "wide-candidates")

    # a node against its group's first: by their signatures, and by their sets where these leave it open
    def may_be(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            may = agreement(signatures(b["sig"]), signatures(b["first_sig"])) >= least_agreement(similarity) if len(b) else []
            yield b[["node", "first"]].assign(may=may)

    heads = cand.where("node = first").select("first", F.col("sig").alias("first_sig"))
    may = materialize(cand.where("node <> first").join(heads, "first").mapInPandas(may_be, "node long, first long, may boolean"), "wide-may")

    def to_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, at, s = Shingles(words), None, None
        for b in batches:
            hit = []
            for first, t, u in zip(b["first"], b["text"], b["first_text"], strict=True):
                if first != at:
                    at, s = first, cut(u)
                hit.append(near(cut(t), s, similarity))
            yield pd.DataFrame({"node": b["node"], "close": hit})

    asked = may.where("may").select("node", "first")
    texts = materialize(asked.join(slim, F.col("node") == F.col("row")).select("node", "first", "text"), "wide-texts")
    firsts = asked.select("first").distinct().join(slim, F.col("first") == F.col("row")).select("first", F.col("text").alias("first_text"))
    firsts = materialize(firsts, "wide-firsts")
    close = materialize(texts.join(firsts, "first").mapInPandas(to_first, "node long, close boolean"), "wide-close")
    judged = may.join(close, "node", "left").select("node", "first", F.coalesce("close", F.lit(False)).alias("close"))
    judged = materialize(judged, "wide-judged")
    for done in (may, texts, firsts, close):
        discard(done)
    # cells: each chunk of far nodes with each chunk of close ones and with each other chunk of far ones
    far = judged.where("not close").groupBy("first").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n_far"))
    n_close = judged.where("close").groupBy("first").agg(F.count("*").alias("n"))
    far = far.join(n_close, "first", "left").select("first", "n_far", F.ceil((F.coalesce("n", F.lit(0)) + 1) / chunk).cast("int").alias("n_close"))
    far = materialize(far, "wide-far")  # a group may hold very many nodes: the join below reads two tables, so it can be split
    side = judged.select("node", "close").unionByName(cand.where("node = first").select("node", F.lit(True).alias("close")))
    some = cand.join(far, "first").join(side, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    some = some.withColumn("own", F.when(F.col("close"), deal("n_close")).otherwise(deal("n_far")))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("far_only"))
    own = F.col("own")
    of_far = F.concat(
        F.transform(count("n_close"), lambda j: cell(own, j, False)),
        F.transform(F.filter(count("n_far"), lambda j: j != own), lambda j: cell(F.least(own, j), F.greatest(own, j), True)),
    )
    of_close = F.transform(count("n_far"), lambda i: cell(i, own, False))
    cells = some.select("node", "first", "close", "fp", "sig", F.explode(F.when(F.col("close"), of_close).otherwise(of_far)).alias("cell"))
    by = ["first", "far_only", "i", "j"]
    cells = cells.select("node", "first", "close", "fp", "sig", "cell.far_only", "cell.i", "cell.j")

    def alive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _groups(batches, by):
            live = live_nodes(c["fp"].to_numpy(np.int64).view(np.uint64), signatures(c["sig"]), ~c["close"].to_numpy(bool), similarity)
            if live.any():
                yield c.loc[live, ["node", "close", *by]]

    found = cells.repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInPandas(alive, "node long, close boolean, first long, far_only boolean, i int, j int")
    live = materialize(found, "wide-live")
    lit = materialize(live.select("node").distinct().join(slim, F.col("node") == F.col("row")).select("node", "text"), "wide-live-texts")
    cells = live.join(lit, "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingles(words)
        for c in _groups(batches, by):
            node = c["node"].to_numpy()
            root = node[cell_links([cut(t) for t in c["text"]], c["close"].to_numpy(bool), similarity)]
            if (linked := root != node).any():
                yield pd.DataFrame({"a": node[linked], "b": root[linked]})

    found = cells.repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInPandas(compare, "a long, b long")
    edges = found.unionByName(judged.where("close").select(F.col("node").alias("a"), F.col("first").alias("b")))
    comp = components(edges)
    of_set = nodes.join(comp, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    of_set = materialize(of_set, "wide-of-set")  # equal texts are many rows: the join reads two tables, so it can be split
    out = materialize(signed.select(F.col("row").alias("__row"), "same").join(of_set, "same").select("__row", "component_id"), "wide-rows")
    for done in (signed, nodes, least, stars, grouped, cand, judged, far, live, lit, comp, of_set):
        discard(done)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with exactly one row of each component, that of the least id; null and repeated ids as in simhash_bktree.dedup."""
    rows = numbered(docs)
    return survivors(rows, near_duplicates(rows, text, words, similarity), id_col, text)
