"""Exact substring dedup with suffix arrays.

A byte goes if it is covered by a LENGTH-byte string that also starts in a document with a smaller doc_id.

1. Windows. Every LENGTH-byte window names the least of its GRAM-byte hashes (leftmost of equals) as its anchor, a choice
   that depends on the window's bytes alone, so equal windows have equal anchors. A run of windows with one anchor and
   the bytes they cover are a context (about 70 bytes for every 18 of text). Of equal contexts in one chunk of
   documents only those of the least document travel; the others are removed there and then.
2. Partitions and shards. Contexts go, packed and compressed by partition and range, to the partition of their anchor's
   hash. There they are sorted by SUBS ranges of that hash and streamed: a task holds the contexts of one range at a time,
   and every block is unpacked once. Contexts whose
   anchor occurs in one document only are put aside; of equal ones (hashes agree and then the bytes are compared), the least
   document's and all later documents' stay as one string each, so thousands of copies cost two. A shard is PIECE bytes
   of these strings: they are suffix-sorted by their first 8 bytes, then by Larsson and Sadakane's refinement (groups
   that are not yet single are sorted by the ranks of the suffixes h and 2h further on, h trebling) until the order is fixed.
   Kasai's inequality gives the common prefixes of neighbours in text order; a run of prefixes of LENGTH or more is one
   set of equal windows.
3. Merging. Shards are cut in the order (anchor, document), so windows can be equal across shards only for the anchor at
   a cut; those are looked up by binary search in the sorted windows that earlier shards left for that anchor.
4. Removal. The ranges found meet their documents once more in a join on doc_id.

Edge cases: null or empty texts, and texts shorter than LENGTH bytes, lose nothing; rows that repeat a doc_id are parts
of one document (a string they share is not removed), and each row is cut by what was found for it alone; a null doc_id
counts as larger than all others; an empty table gives an empty result; further columns are ignored. LENGTH may be any
number from GRAM to MOST_LENGTH, others are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

LENGTH = 50
GRAM = 16
#: Bytes of text whose windows are taken together, at most 2**22; a longer document is a chunk of its own, in strips.
CHUNK = 2_000_000
#: Bytes that are suffix-sorted together.
PIECE = 250_000
#: Ranges of anchors that a partition is worked off in.
SUBS = 4
MOST_LENGTH = 1_000_000
_POS = 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers of the hash


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one little-endian number; data ends with 8 spare bytes."""
    return np.lib.stride_tricks.as_strided(data, shape=(len(data) - 7, 8), strides=(1, 1)).copy().view("<u8").ravel()


def _gram_hash_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of 16 bytes from their two words."""
    h = a * _M1
    h ^= h >> np.uint64(29)
    h = h + b
    h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h ^ (h >> np.uint64(29))


def _gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 16 bytes from each position on."""
    return _gram_hash_of(words[: len(words) - 8], words[8:])


def contexts(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document index, first window, last window, anchor, anchor hash) of every context.

    data: the chunk's bytes; starts: where its documents start, and the end. Positions are within data, which holds at
    most 2**22 bytes.
    """
    n = int(starts[-1])
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    h = _gram_hash(_words(np.concatenate([data[:n], np.zeros(24, dtype=np.uint8)])))[:n]
    low = (h << np.uint64(_POS)) | np.arange(n, dtype=np.uint64)
    # least of `span` in a row, by doubling
    span, wide = length - GRAM + 1, 1
    while 2 * wide <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if span > wide:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    anchor = (low[: n - length + 1] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= starts[1:][doc]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    new &= valid
    first = np.flatnonzero(new)
    # a run ends before the next run or before the first window that leaves its document
    last = np.minimum(np.append(first[1:], len(anchor)) - 1, starts[1:][doc[first]] - length)
    return doc[first], first, last, anchor[first], h[anchor[first]]


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[at : at + size] of all rows, one after the other."""
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)
    return data[index]


def _content_hash(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes data[at : at + size], 8 of them or more: whole words, then the last 8 bytes."""
    words = np.lib.stride_tricks.as_strided(data, shape=(max(len(data) - 7, 0), 8), strides=(1, 1)).view("<u8")
    h = size.astype(np.uint64) * _M2
    todo = np.arange(len(at))
    for k in range(0, int(size.max()) if len(size) else 0, 8):
        todo = todo[size[todo] >= k + 8]
        x = h[todo] ^ (words[at[todo] + k, 0] * _M1)
        h[todo] = ((x << np.uint64(31)) | (x >> np.uint64(33))) * _M2
    if len(at):
        h = (h ^ words[at + size - 8, 0]) * _M1
    return h ^ (h >> np.uint64(29))


def _equal_runs(data: np.ndarray, at: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """new, which marks the first rows of runs with one hash, and further rows whose bytes are not those of their run's first."""
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        todo = np.flatnonzero(~new)
        same = size[todo] == size[head[todo]]
        for lo, hi in _bounds(size[todo], 4_000_000):
            k = todo[lo:hi][same[lo:hi]]
            if len(k):
                equal = _gather(data, at[k], size[k]) == _gather(data, at[head[k]], size[k])
                same[lo:hi][same[lo:hi]] = np.logical_and.reduceat(equal, np.cumsum(size[k]) - size[k])
        if same.all():
            return new
        new[todo[~same]] = True


def pack(ids: np.ndarray, keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, lens: np.ndarray, offs: np.ndarray, text: np.ndarray) -> bytes:
    """Contexts as one compressed block: id, key, first window in the document, length, anchor's offset, bytes."""
    import zstandard

    used, which = np.unique(docs, return_inverse=True)
    wide = "<u1" if not len(lens) or lens.max() < 256 else "<u4"
    head = np.array([len(docs), len(used), np.dtype(wide).itemsize], dtype="<i4").tobytes()
    small = which.astype("<u2" if len(used) < 65536 else "<u4")
    body = ids[used].astype("<i8").tobytes() + keys[used].astype("<i8").tobytes() + small.tobytes() + starts.astype("<u4").tobytes() + lens.astype(wide).tobytes() + offs.astype(wide).tobytes()
    return head + zstandard.ZstdCompressor(level=3).compress(body + text.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(id, key, start, length, anchor's offset, bytes) of a block's contexts."""
    import zstandard

    n, m, width = map(int, np.frombuffer(blob, dtype="<i4", count=3))
    body = zstandard.ZstdDecompressor().decompress(memoryview(blob)[12:])
    wide, at = f"<u{width}", 0
    out = []
    for kind, count in (("<i8", m), ("<i8", m), ("<u2" if m < 65536 else "<u4", n), ("<u4", n), (wide, n), (wide, n)):
        out.append(np.frombuffer(body, dtype=kind, count=count, offset=at))
        at += out[-1].nbytes
    ids, keys, which, starts, lens, offs = out
    text = np.frombuffer(body, dtype=np.uint8, offset=at)
    return ids[which], keys[which], starts.astype(np.int64), lens.astype(np.int64), offs.astype(np.int64), text


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson and Sadakane's refinement, the first step on 8 bytes.

    Groups that are not yet single are sorted by the ranks of the suffixes h and 2h further on, so h trebles; suffixes
    of single groups are not looked at again.
    """
    n = len(data)
    key = _words(np.concatenate([data, np.zeros(8, dtype=np.uint8)]))[:n].byteswap()
    sa = np.argsort(key).astype(np.int32)
    rank = np.empty(n + 1, dtype=np.int32)
    rank[n] = -1  # the empty suffix comes first
    ordered = key[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    # suffixes that the end cuts off within the 8 bytes: zeros beyond the end may not equal zeros of the text
    for tail in range(max(n - 8, 0), n):
        lo, hi = np.searchsorted(ordered, key[tail], "left"), np.searchsorted(ordered, key[tail], "right")
        if hi - lo > 1:
            short = np.minimum(n - sa[lo:hi], 8)
            by = np.argsort(short, kind="stable")
            sa[lo:hi], short = sa[lo:hi][by], short[by]
            new[lo + 1 : hi] |= short[1:] != short[:-1]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    h, many = 8, 3 if n < 2_000_000 else 2  # as many ranks as one number holds
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots):
        suffix = sa[slots].astype(np.int64)
        key = rank[suffix].astype(np.int64)
        for k in range(1, many):
            key = key * (n + 1) + (rank[np.minimum(suffix + k * h, n)] + 1)
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[slots] = suffix
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        h *= many
    return sa, rank[:n]


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, prefixes): those suffixes of the array that begin at starts .. starts + counts - 1, in its order, and
    the length, at most ``most``, of the common prefix of each and the one before it.

    Kasai: if i - 1 follows j - 1 with a common prefix of l, i and j share l - 1, j comes before i, and so what i follows
    shares as much, provided that j is among the suffixes asked for. All stretches are walked side by side; each step
    compares 8 bytes at once.
    """
    n = len(data)
    asked = np.zeros(n + 1, dtype=np.int8)
    asked[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] = 1
    mine = sa[asked[sa] == 1]
    words = _words(np.concatenate([data, np.zeros(most + 16, dtype=np.uint8)]))
    before = np.full(n + 1, n, dtype=np.int64)
    before[mine[1:]] = mine[:-1]
    out = np.zeros(n, dtype=np.int8 if most < 128 else np.int32)
    order = np.argsort(-counts, kind="stable")  # the longest first, so that lanes end from the back
    lane, left = starts[order], counts[order]
    have = np.zeros(len(lane), dtype=np.int64)
    j = np.full(len(lane), n, dtype=np.int64)
    for step in range(int(left[0]) if len(left) else 0):
        go = int(np.searchsorted(-left, -step, side="left"))
        i = lane[:go] + step
        # what stood before i - 1 moves on too; where that is not asked for, the count starts anew
        have = np.where(asked[np.minimum(j[:go] + 1, n)] == 1, np.maximum(have[:go] - 1, 0), 0)
        j = before[i]
        open_ = np.arange(go)
        while len(open_):
            reach = have[open_]
            x = words[i[open_] + reach] ^ words[j[open_] + reach]
            reach += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3
            have[open_] = reach
            open_ = open_[(x == 0) & (reach < most)]
        have = np.minimum(have, np.minimum(most, n - np.maximum(i, j)))
        out[i] = have
    return mine, out[mine]


def _bounds(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive rows whose sizes add up to about ``most``."""
    ends = np.cumsum(sizes)
    out, lo = [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def _window_bytes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The windows as byte strings that sort by their bytes; a last 1 keeps trailing zeros."""
    rows = np.ones((len(at), length + 1), dtype=np.uint8)
    rows[:, :length] = data[at[:, None] + np.arange(length)]
    return rows.view(f"S{length + 1}").ravel()


def repeated(h: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray, length: int = LENGTH, piece: int = PIECE):
    """(row, first, last) of the runs of windows of a context that also start in a context of a smaller doc.

    Contexts are rows data[at : at + size], in the order (h, doc); equal windows are only found within one h.
    """
    left_h, left_windows, left_docs = None, None, None
    for lo, hi in _bounds(size, piece):
        text = _gather(data, at[lo:hi], size[lo:hi])
        n = len(text)
        row = np.repeat(np.arange(lo, hi), size[lo:hi])
        ends = np.cumsum(size[lo:hi])
        valid = np.arange(n) + length <= np.repeat(ends, size[lo:hi])
        sa, _ = suffix_array(text)
        suffix, same = common_prefixes(text, sa, ends - size[lo:hi], size[lo:hi] - length + 1, length)
        d = doc[row[suffix]]
        starts = np.flatnonzero(np.append(True, same[1:] < length))
        least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(d))))
        flagged = np.zeros(n, dtype=bool)
        flagged[suffix[d > least]] = True
        # windows of the anchor at the cut, against what earlier pieces hold of it
        if left_h is not None and h[lo] == left_h:
            mine = np.flatnonzero(valid & (h[row] == left_h))
            windows = _window_bytes(text, mine, length)
            k = np.minimum(np.searchsorted(left_windows, windows), len(left_windows) - 1)
            flagged[mine[(left_windows[k] == windows) & (left_docs[k] < doc[row[mine]])]] = True
        if hi < len(h) and h[hi] == h[hi - 1]:
            last = np.flatnonzero(valid & (h[row] == h[hi - 1]))
            windows, docs = _window_bytes(text, last, length), doc[row[last]]
            if left_h is not None and left_h == h[hi - 1]:
                windows, docs = np.concatenate([left_windows, windows]), np.concatenate([left_docs, docs])
            order = np.lexsort((docs, windows))
            windows, docs = windows[order], docs[order]
            once = np.append(True, windows[1:] != windows[:-1])
            left_h, left_windows, left_docs = h[hi - 1], windows[once], docs[once]
        else:
            left_h = None
        p = np.flatnonzero(flagged)
        if len(p):
            cut = np.flatnonzero(np.append(True, (np.diff(p) > 1) | (row[p][1:] != row[p][:-1])))
            first, last = p[cut], p[np.append(cut[1:], len(p)) - 1]
            base = np.cumsum(size[lo:hi]) - size[lo:hi]
            r = row[first]
            yield r, first - base[r - lo], last - base[r - lo]


def _chunks(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], length: int, most: int):
    """(ids, keys, bases, byte strings) of about ``most`` bytes; longer texts come in strips that overlap by length - 1."""
    out, size = [], 0
    for i in np.argsort(ids, kind="stable"):
        t = texts[i]
        for base in range(0, max(len(t) - length + 1, 0), most):
            part = t[base : base + most + length - 1]
            if out and size + len(part) > most:
                yield out
                out, size = [], 0
            out.append((ids[i], keys[i], base, part))
            size += len(part)
    if out:
        yield out


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents with those that overlap or touch made one."""
    wide = int(hi.max()) + 2
    order = np.lexsort((lo, doc))
    a, b = (doc * wide + lo)[order], (doc * wide + hi)[order]
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    last = np.append(first[1:], len(a)) - 1
    return doc[order[first]], a[first] % wide, reach[last] % wide


def _ship(chunk: list, shards: int, length: int):
    """(shard, sub, block) rows of a chunk's contexts, and (doc, key, lo, hi) ranges that the chunk itself decides."""
    ids, keys, bases = (np.array([c[k] for c in chunk], dtype=np.int64) for k in range(3))
    data = np.frombuffer(b"".join(c[3] for c in chunk), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(c[3]) for c in chunk])])
    doc, first, last, anchor, h = contexts(data, starts, length)
    size = last - first + length
    if not len(doc):
        return [], None
    # equal contexts, which have equal anchors too: those of the least document travel
    content = _content_hash(data, first, size)
    order = np.argsort(content)
    content = content[order]
    new = _equal_runs(data, first[order], size[order], np.append(True, content[1:] != content[:-1]))
    least = np.empty(len(doc), dtype=np.int64)
    runs = np.flatnonzero(new)
    least[order] = np.repeat(np.minimum.reduceat(ids[doc[order]], runs), np.diff(np.append(runs, len(order))))
    late = ids[doc] > least
    offset = bases[doc] + first - starts[doc]
    known = None
    if late.any():
        of, lo, hi = _runs(doc[late], offset[late], offset[late] + size[late])
        known = (ids[of], keys[of], lo, hi)
    go = np.flatnonzero(~late)
    shard, sub = (h[go] >> np.uint64(7)) % np.uint64(shards), (h[go] >> np.uint64(40)) % np.uint64(SUBS)
    # by shard, range and anchor as one number, the anchor's last bits left out
    wide = np.uint64((shards * SUBS - 1).bit_length())
    by = np.argsort(((shard * np.uint64(SUBS) + sub) << (np.uint64(64) - wide)) | (h[go] >> wide))
    go, shard, sub = go[by], shard[by], sub[by]
    cut = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (sub[1:] != sub[:-1])))
    blocks = []
    for lo, hi in zip(cut, np.append(cut[1:], len(go)), strict=True):
        r = go[lo:hi]
        blocks.append((int(shard[lo]), int(sub[lo]), pack(ids, keys, doc[r], offset[r], size[r], anchor[r] - first[r], _gather(data, first[r], size[r]))))
    return blocks, known


def _part(blob: bytes) -> tuple[np.ndarray, ...]:
    """(doc, key, start, size, anchor hash, bytes) of a block's contexts."""
    doc, key, start, size, off, text = unpack(blob)
    at = np.cumsum(size) - size + off
    words = np.lib.stride_tricks.as_strided(text, shape=(len(text) - 7, 8), strides=(1, 1)).view("<u8")
    return doc, key, start, size, _gram_hash_of(words[at, 0], words[at + 8, 0]), text


def _matches(parts: list[tuple[np.ndarray, ...]], length: int) -> Iterator[pd.DataFrame]:
    """Ranges to remove among the contexts of a range of anchors."""
    doc, key, start, size, h, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    if not len(h):
        return
    at = np.cumsum(size) - size
    # anchors of one document only are put aside
    order = np.argsort(h)
    cut = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    by_anchor = doc[order]
    shared = np.repeat(np.minimum.reduceat(by_anchor, cut) != np.maximum.reduceat(by_anchor, cut), np.diff(np.append(cut, len(h))))
    order = order[shared]
    if not len(order):
        return
    # of equal contexts, those of the least document and those of all others are one string each
    content = _content_hash(text, at[order], size[order])
    by_content = np.lexsort((doc[order], content))
    order, content = order[by_content], content[by_content]
    new = _equal_runs(text, at[order], size[order], np.append(True, content[1:] != content[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = doc[order] > doc[order[head]]
    new |= np.append(False, later[1:] & ~later[:-1])
    one = order[new]
    by_doc = np.lexsort((doc[one], h[one]))
    reps = one[by_doc]
    members = np.append(np.flatnonzero(new), len(order))
    for r, first, last in repeated(h[reps], doc[reps], at[reps], size[reps], text, length):
        g = by_doc[r]
        n_of = members[g + 1] - members[g]
        m = order[np.repeat(members[g] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())]
        yield pd.DataFrame({"id": doc[m], "key": key[m], "lo": start[m] + np.repeat(first, n_of), "hi": start[m] + np.repeat(last, n_of) + length})


def ranges(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """(id, key, lo, hi): byte ranges to remove, of rows (id long, key long, text)."""
    if not GRAM <= length <= MOST_LENGTH:
        raise ValueError(f"length must be from {GRAM} to {MOST_LENGTH}")
    n = partitions(docs.sparkSession)

    def travel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode("utf-8", "replace") for t in b["text"]]
            for part in _chunks(b["id"].to_numpy(), b["key"].to_numpy(), texts, length, chunk):
                blocks, known = _ship(part, n, length)
                if known is not None:
                    blocks.append((int(part[0][0]) % n, -1, np.stack(known).astype("<i8").tobytes()))
                if blocks:
                    yield pd.DataFrame(blocks, columns=["shard", "sub", "block"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts = -1, []
        for b in batches:
            for sub, block in zip(b["sub"], b["block"], strict=True):
                if sub < 0:  # ranges that a chunk has decided
                    i, k, lo, hi = np.frombuffer(block, dtype="<i8").reshape(4, -1)
                    yield pd.DataFrame({"id": i, "key": k, "lo": lo, "hi": hi})
                    continue
                if sub != at and parts:
                    yield from _matches(parts, length)
                at = sub
                parts.append(_part(block))
        if parts:
            yield from _matches(parts, length)

    sent = docs.select("id", "key", "text").mapInPandas(travel, "shard int, sub int, block binary")
    return sent.repartitionById(n, "shard").sortWithinPartitions("sub").mapInPandas(meet, "id long, key long, lo long, hi long")


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if not len(lo):
        return text, 0, 0
    step = np.bincount(lo, minlength=len(text) + 1) - np.bincount(hi, minlength=len(text) + 1)
    gone = np.cumsum(step)[: len(text)] > 0
    left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return left, int(gone.sum()), runs


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), one row per row of docs.

    doc_id must be an integer; a null one counts as larger than all others.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("key", F.xxhash64("doc_id", "text"))
    found = materialize(ranges(d, length), "suffix-ranges")
    # rows that repeat bring the same ranges: one of each; a table, so that the join can split rows that repeat often
    each = found.groupBy("id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    by_row = materialize(each.select("id", "key", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")), "suffix-rows")
    discard(found)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, lo, hi in zip(b["text"], b["lo"], b["hi"], strict=True):
                t = t.encode("utf-8", "replace")
                left, removed, runs = (t, 0, 0) if lo is None else cut(t, np.asarray(lo), np.asarray(hi))
                rows.append((len(t), removed, runs, left))
            yield pd.concat([b[["doc_id"]], pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])], axis=1)

    joined = d.join(by_row, ["id", "key"], "left").select("doc_id", "text", "lo", "hi")
    return joined.mapInPandas(apply, f"doc_id {dict(d.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")
