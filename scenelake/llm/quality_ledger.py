"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. A failed rule sets its bit in ``failed``; the measurements stay beside it.
A policy is a version and a mask: ``kept`` is ``failed & mask == 0``, so a new policy or an ablation reads the ledger
and never the text again. No shuffle happens before the ablation's bit counts.

Edge cases: a null text counts as empty (no words: fails FEW_WORDS, so it is not kept); repeated rows are judged each
for itself; an empty table gives an empty ledger; extra columns, whatever their names, are carried through by
``apply_policy`` and ignored by ``ledger``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"

#: Rule name -> (bit, condition over the measurements under which it fails).
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "100 * n_dup_lines > 50 * n_lines"),
    "short_words": (4, "2 * n_words > word_chars"),
    "long_words": (5, "word_chars > 30 * n_words"),
}
BASE = ("few_words", "repeated_words")
#: Policy version -> rules it applies. Versions are never edited, only added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
    "v1-no-symbols": (*BASE, "duplicate_lines", "short_words", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def mask_of(policy: str) -> int:
    return sum(1 << RULES[name][0] for name in POLICIES[policy])


def _hashed(words: Column) -> Column:
    """The 3-word windows as sorted (hash, index)."""
    n = F.size(words)
    each = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(F.slice(each, F.lit(1), F.greatest(n - 2, F.lit(0))))


def _plain(words: Column) -> Column:
    """The same with the words themselves in place of the hash, for texts in which two windows share a hash by chance."""
    n = F.size(words)
    each = F.transform(words, lambda w, i: F.struct(F.struct(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(F.slice(each, F.lit(1), F.greatest(n - 2, F.lit(0))))


def _collides(words: Column, hashed: Column) -> Column:
    """Whether neighbours in the order of hashes agree in the hash and not in the words."""

    def other(x: Column, j: Column) -> Column:
        y = F.get(hashed, j - 1)
        differ = F.lit(False)
        for k in range(3):
            differ = differ | (F.get(words, x["i"] + k) != F.get(words, y["i"] + k))
        return F.coalesce((x["h"] == y["h"]) & differ, F.lit(False))

    return F.exists(F.filter(hashed, other), lambda x: F.lit(True))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: those that equal a neighbour, their cover summed."""
    like = lambda x, k: F.coalesce(x["h"] == F.get(windows, k)["h"], F.lit(False))
    again = F.filter(windows, lambda x, j: like(x, j - 1) | like(x, j + 1))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        at, start, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end"))
    )["n"].cast("long")


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measurements as columns, their names after prefix; and n_lines."""
    p = prefix
    t = text_or_empty(text)
    out = docs.withColumns({
        f"{p}words": words_of(t),
        f"{p}lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0),
        f"{p}word_chars": F.length(F.translate(t, WS_CHARS, "")).cast("long"),
        f"{p}n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    })
    out = out.withColumns({
        f"{p}n_words": F.size(f"{p}words").cast("long"),
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        f"{p}windows": _hashed(F.col(f"{p}words")),
    })
    words, windows = F.col(f"{p}words"), F.col(f"{p}windows")
    n = F.when(_collides(words, windows), _covered(_plain(words))).otherwise(_covered(windows))
    return out.withColumn(f"{p}n_repeat_words", n).drop(f"{p}words", f"{p}lines", f"{p}windows")


def failed_bits(prefix: str = "") -> Column:
    import re

    names = {*MEASURES, "n_lines"}
    bits = F.lit(0)
    for bit, rule in RULES.values():
        cond = re.sub(r"[a-z_]+", lambda m: f"`{prefix}{m[0]}`" if m[0] in names else m[0], rule)
        bits = bits.bitwiseOR(F.when(F.expr(cond), F.lit(1 << bit)).otherwise(0))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, the measurements, and the failure bits."""
    out = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    return out.select("doc_id", *MEASURES, "n_lines", failed_bits().alias("failed"))


def with_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return book.withColumns({
        "base_failed": book.failed.bitwiseAND(mask_of("base")) != 0,
        "kept": book.failed.bitwiseAND(mask_of("base") | mask_of(policy)) == 0,
    })


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, those that fail it alone and so would be kept without it, and the
    union of the other bits that its failures show.

    The ledger is first counted by its bits (2 ** len(RULES) groups at most, summed before they are shuffled); rules
    then meet these groups bit by bit.
    """
    mask = mask_of(policy)
    groups = book.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << RULES[name][0]).alias("bit")) for name in POLICIES[policy]])
    each = groups.select("failed", "n", F.inline(rules))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed").bitwiseAND(mask) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(hit, F.col("failed").bitwiseXOR(F.col("bit")))), F.lit(0)).alias("also"),
    )


def apply_policy(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Only the rows of docs that the policy keeps, with the columns docs has."""
    p = "__ledger_"
    book = measured(docs, text, p).withColumn(f"{p}failed", failed_bits(p))
    # a filter would be pushed below the measurements, each of them copied into it once for every use; a column that is
    # not deterministic keeps it above them
    book = book.withColumn(f"{p}row", F.monotonically_increasing_id())
    kept = (F.col(f"{p}failed").bitwiseAND(mask_of("base") | mask_of(policy)) == 0) & (F.col(f"{p}row") >= 0)
    return book.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
