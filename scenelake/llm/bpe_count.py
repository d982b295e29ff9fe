"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at added special tokens (one token each) and then by the pre-tokenizer's pattern. The bytes of a piece are
a doubly linked list of symbols; a heap holds the adjacent pairs by merge rank and the lowest is popped again and again.
The count is the number of initial symbols less the merges: no token identifiers are made. Counts of pieces are kept
in a table of about MOST_BYTES per task, which is emptied when full.

Each document is counted by itself where it is read: no shuffle. The merge table is broadcast; its size is that of the
vocabulary file.

Edge cases: null text counts as empty (0 bytes, 0 tokens); a piece of any length takes n log n steps; repeated rows are
counted each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Bytes of pieces that a task remembers, and what one takes besides its own, about.
MOST_BYTES, ENTRY = 64_000_000, 150
#: The byte-level pre-tokenizer's pattern and the code points Unicode calls white space: fixed values.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+"
)


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins of the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def load(path: str) -> dict:
    """What counting needs of a byte-level BPE tokenizer file: merges in rank order and special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return {"merges": merges, "special": [t["content"] for t in spec["added_tokens"]]}


class Counter:
    def __init__(self, spec: dict) -> None:
        import regex

        ids: dict[str, int] = {s: b for b, s in _byte_symbols().items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            new = ids.setdefault(a + b, len(ids))
            self.merge[ids[a], ids[b]] = (rank, new)
        self.find = regex.compile(PATTERN).findall
        special = sorted(spec["special"], key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, special))).split if special else lambda t: [t]
        self.known: dict[str, int] = {}
        self.held = 0

    def piece(self, text: str) -> int:
        """Tokens of one pre-token."""
        sym = list(text.encode("utf-8", "replace"))
        n = len(sym)
        if n < 2:
            return n
        merge, nxt, prv = self.merge, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(n - 1) if (m := merge.get((sym[i], sym[i + 1])))]
        heapify(heap)
        left = n
        while heap:
            _, i, new, a, b = heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one side has been merged since
            sym[i], sym[j] = new, -1
            nxt[i] = k = nxt[j]
            left -= 1
            if k < n:
                prv[k] = i
                if m := merge.get((new, sym[k])):
                    heappush(heap, (m[0], i, m[1], new, sym[k]))
            if (h := prv[i]) >= 0 and (m := merge.get((sym[h], new))):
                heappush(heap, (m[0], h, m[1], sym[h], new))
        return left

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        parts = self.cut(text)
        for part in parts:
            pieces = self.find(part)
            try:
                total += sum(map(known.__getitem__, pieces))
            except KeyError:
                for p in pieces:
                    if (c := known.get(p)) is None:
                        c = self.piece(p)
                        if self.held > MOST_BYTES:
                            known.clear()
                            self.held = 0
                        known[p] = c
                        self.held += ENTRY + len(p)
                    total += c
        return total + len(parts) - 1


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs; path: a byte-level BPE tokenizer .json."""
    spec = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(spec.value)
        for b in batches:
            n = [counter.text(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": pd.array(n, dtype="int64")})

    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("text")
    )
    out = slim.mapInPandas(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
