"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut by the pre-tokenizer's pattern. The distinct pieces of a batch of documents that are not known yet are
encoded together: an inverted index leads from a pair of tokens to all places, in all pieces, where it stands; the merges
are applied to the whole corpus of pieces in rank order, lowest first, and a merge touches the places of its pair and
their neighbours only (each piece is a linked list of its tokens). A piece is then looked up for each of its occurrences.

Where a merge makes a pair of a lower rank than its own, the piece's further places of the running merge wait until that
pair is merged: so every piece sees its merges in just the order in which it would be encoded alone (lowest rank, leftmost
first), for any vocabulary. A piece that is itself a token is that token.

Documents are encoded where they are read, with no shuffle; the ranks are broadcast, their size is that of the vocabulary
file. What a task remembers is bounded by MOST_BYTES, counting bytes; when it is full it is emptied.

Edge cases: null text counts as empty (0 tokens, empty ids); a piece of any length takes n log n steps; repeated rows are
encoded each for itself; an id that the vocabulary lacks cannot be decoded and raises, as does a byte without a rank; an
empty table gives an empty result; of further columns encode() keeps none, decode() all.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import SPACE
from .vectors import column

#: Bytes of pieces and their tokens that a task remembers, and of text whose new pieces are encoded together.
MOST_BYTES, CORPUS_BYTES = 32_000_000, 4_000_000
#: What one remembered piece takes besides its bytes, about.
_ENTRY = 200
#: No rank is as high; a rank takes fewer bits.
_NEVER, _BITS = 1 << 40, 24


def load(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, f.read().splitlines()))}


def spelled(pattern: str) -> str:
    r"""pattern with \s and \S as Unicode's white space, which the regular expressions of Python take more widely."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            if two == r"\S" and in_class:
                raise ValueError(r"\S within brackets")
            out.append(SPACE if in_class else f"[{'^' if two == chr(92) + 'S' else ''}{SPACE}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        in_class = two[0] == "[" or (in_class and two[0] != "]")
        out.append(two[0])
        i += 1
    return "".join(out)


class Vocabulary:
    """Tokens by rank, and all pairs of tokens that merge with the rank of what they merge to, sorted by pair."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        pairs: dict[int, int] = {}
        for t, r in ranks.items():
            self.token[r] = t
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pairs[a << _BITS | b] = r
        self.pair = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.into = np.array([pairs[k] for k in self.pair.tolist()] + [_NEVER], np.int64)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of a and b as one token, _NEVER where they do not merge."""
        key = a << _BITS | b
        at = np.searchsorted(self.pair, key)
        if not len(self.pair):
            return np.full(len(key), _NEVER)
        found = self.pair[np.minimum(at, len(self.pair) - 1)] == key
        return np.where(found, self.into[at], _NEVER)


def replay(pieces: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all pieces, number of each piece's): every merge that occurs, applied to all pieces in rank order."""
    size = np.array([len(p) for p in pieces], np.int64)
    n = int(size.sum())
    sym = words.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    if n and sym.min() < 0:
        raise ValueError("a byte has no rank")
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(pieces)), size)
    # one slot more, which stands for "no neighbour"
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends[size > 0] - 1], before[(ends - size)[size > 0]] = n, n
    sym = np.append(sym, -1)
    # pieces that are tokens themselves
    known = [words.rank.get(p, -1) for p in pieces]
    whole = np.array(known, np.int64) if pieces else np.zeros(0, np.int64)
    at = (ends - size)[whole >= 0]
    sym[:n][(whole >= 0)[of]] = -1
    sym[at], after[at] = whole[whole >= 0], n
    # pair[i]: the rank of the pair that begins at i, as it now is
    pair = np.full(n + 1, _NEVER)
    first = np.flatnonzero((sym[:n] >= 0) & (after[:n] < n))
    pair[first] = words.merged(sym[first], sym[after[first]])
    first = first[pair[first] < _NEVER]
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def place(at: np.ndarray) -> None:
        """Enter places under the rank of the pair that begins there."""
        rank = pair[at]
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
        else:
            cut = [0, len(at)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            r = int(rank[lo])
            if (have := index.get(r)) is None:
                index[r] = [at[lo:hi]]
                heappush(heap, r)
            else:
                have.append(at[lo:hi])

    if len(first):
        place(first)
    while heap:
        rank = heappop(heap)
        found = index.pop(rank)
        i = found[0] if len(found) == 1 else np.concatenate(found)
        every = i = i[pair[i] == rank]
        if len(i) > 1:
            every = i = np.unique(i)
            # of places that share a token with the one before, every second
            if (tied := after[i[:-1]] == i[1:]).any():
                number = np.arange(len(i))
                head = np.maximum.accumulate(np.where(np.append(True, ~tied), number, 0))
                i = i[(number - head) % 2 == 0]
        if not len(i):
            continue
        j = after[i]
        k, h = after[j], before[i]
        left = sym[h]
        if len(i) > 1:
            left[1:][k[:-1] == i[1:]] = rank  # the neighbour is merged just before
        right = np.where(k < n, words.merged(np.full(len(i), rank), np.maximum(sym[k], 0)), _NEVER)
        left = np.where(h < n, words.merged(np.maximum(left, 0), np.full(len(i), rank)), _NEVER)
        lower = (right < rank) | (left < rank)
        if waits := lower.any():
            # in such pieces, only the places up to the first that makes a lower pair; the others wait for that pair
            w = of[i]
            start = np.maximum.accumulate(np.where(np.append(True, w[1:] != w[:-1]), np.arange(len(i)), 0))
            count = np.cumsum(lower) - lower
            go = count == count[start]
            i, j, k = i[go], j[go], k[go]
        sym[i], sym[j], pair[j] = rank, -1, _NEVER
        after[i], before[k] = k, i
        before[n] = n
        h, k = before[i], after[i]
        pair[i] = np.where(k < n, words.merged(sym[i], np.maximum(sym[k], 0)), _NEVER)
        inner = h[h < n]
        pair[inner] = words.merged(sym[inner], np.full(len(inner), rank))
        new = np.concatenate([i, inner])
        new = new[pair[new] < _NEVER]
        if waits:
            new = np.unique(np.concatenate([new, every[pair[every] == rank]]))
        if len(new):
            place(new)
    alive = sym[:n] >= 0
    return sym[:n][alive], np.bincount(of[alive], minlength=len(pieces))


class Encoder:
    """Texts to their ids. A piece has a number; the ids of all pieces stand one after the other, by number."""

    def __init__(self, words: Vocabulary, pattern: str, most: int = MOST_BYTES) -> None:
        import regex

        self.words, self.find, self.most = words, regex.compile(spelled(pattern)).findall, most
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.ends, self.held = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def learn(self) -> None:
        """Encode the pieces that have a number but no ids yet: one corpus."""
        new = [p.encode("utf-8", "replace") for p in islice(self.number, len(self.ends) - 1, None)]
        if new:
            ids, n = replay(new, self.words)
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.held += sum(map(len, new)) + 4 * len(ids) + _ENTRY * len(new)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, the number of each text's); what is new in the texts is encoded together."""
        if self.held > self.most:
            self.forget()
        number = self.number.__getitem__
        pieces = [np.fromiter(map(number, cut), np.int32, len(cut)) for cut in map(self.find, texts)]
        self.learn()
        n_pieces = np.array([len(p) for p in pieces], np.int64)
        at = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        size = (self.ends[at + 1] - self.ends[at]).astype(np.int32)
        ends = np.cumsum(size, dtype=np.int64)
        index = np.repeat(self.ends[at] - (ends - size), size)
        index += np.arange(len(index))
        total = np.append(0, ends)[np.cumsum(n_pieces)] if len(texts) else np.zeros(0, np.int64)
        return self.ids[index], np.diff(total, prepend=0)


def _parts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``most`` bytes; a longer row is a part of its own."""
    ends, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", corpus: int = CORPUS_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids), one row per row of docs; ids: little-endian unsigned 32-bit numbers one after the other.

    path: a file of base64 tokens and ranks; pattern: what cuts a text into pieces.
    """
    words = docs.sparkSession.sparkContext.broadcast(Vocabulary(load(path)))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words.value, pattern)
        for b in batches:
            size = pc.binary_length(column(b, "text")).to_numpy()
            for lo, hi in _parts(size, corpus):
                ids, n = encoder(column(b, "text").slice(lo, hi - lo).to_pylist())
                at = pa.py_buffer(np.append(0, 4 * np.cumsum(n)).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, at, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([column(b, "doc_id").slice(lo, hi - lo), pa.array(n), packed], ["doc_id", "n_tokens", "ids"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with the bytes that its ids stand for as ``decoded``; null ids are none."""
    tokens = encoded.sparkSession.sparkContext.broadcast(Vocabulary(load(path)).token)
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens.value
        for b in batches:
            size = pc.binary_length(column(b, ids)).fill_null(0).to_numpy()
            for lo, hi in _parts(size, CORPUS_BYTES):
                part = b.slice(lo, hi - lo)
                out = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in column(part, ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in encoded.columns) + ", decoded binary")
