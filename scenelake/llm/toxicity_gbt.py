"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Learning uses at most MOST_ROWS labelled rows with crc32(doc_id) mod 5 <> 0, those of the least md5(doc_id), in three
folds: one gives a lexicon of words and word beginnings that toxic texts use more often, one fits the trees, one fits
the isotonic curve. The sampled texts are found in one scan and written; the folds read that table. An entry of the
lexicon stands in 3 sampled toxic texts and in one of 200, so there are at most 200 times as many as a text has of its own;
none is cut off. Labels,
language, source and identifiers are never features. Scoring reads every text once where it lies: no shuffle; what is
broadcast is the sample's keys and the model, both bounded by the sample.

Edge cases: null text counts as empty and is scored like any text; without usable labels of both classes every score is
the base rate; repeated rows are scored each for itself; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import discard, materialize

#: Labelled rows that are learned from at most.
MOST_ROWS = 20_000
#: Width within which equal calibrated scores are ordered by the trees' own.
TIE = 1e-6
#: Lengths of the word beginnings that the lexicon may hold besides whole words.
HEADS = (4, 5, 6, 7)
#: General insults and second-person words in four languages.
INSULTS = frozenset(
    "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting ugly fool jerk idiota imbécil estúpido basura "
    "asqueroso inútil payaso idiote imbécile stupide débile ordure dégoûtant minable nul dumm dummkopf trottel abschaum müll "
    "ekelhaft wertlos versager".split()
)
YOU = frozenset("you your yours ur u tu te ti tus vous votre vos toi ton ta du dich dir dein deine ihr euch usted ustedes".split())
FEATURES = (
    "insults", "insult_rate", "learned_sum", "learned_mean", "hits", "hit_rate", "strong", "strong_rate", "window", "near_you",
    "capitals", "exclamations", "punctuation", "obfuscated", "repeats", "log_words",
)
_TOKEN = re.compile(r"\w+", re.UNICODE)
_MASKED = re.compile(r"[^\W\d_]+[0-9@$*!]+[^\W\d_]+", re.UNICODE)
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_PUNCT = re.compile(r"[^\w\s]", re.UNICODE)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def tokens(text: str | None) -> list[str]:
    """Lower-case words, with masking characters inside words undone."""
    t = (text or "").lower()
    if _MASKED.search(t):
        t = _MASKED.sub(lambda m: m[0].translate(_PLAIN).replace("*", ""), t)
    return _TOKEN.findall(t)


def heads(word: str) -> list[str]:
    return [f"{word[:k]}-" for k in HEADS if len(word) > k] + [word]


class Scores(dict):
    """word -> its best lexicon score, 0 if it has none; filled as words come, emptied when large."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        get = self.lexicon.get
        self[word] = s = max([get(h, 0.0) for h in heads(word)])
        return s


def features(text: str | None, scores: Scores, strong: float = 2.0) -> list[float]:
    text = text or ""
    words = tokens(text)
    n = max(len(words), 1)
    s = np.fromiter(map(scores.__getitem__, words), dtype=float, count=len(words))
    at = np.flatnonzero(s > 0)
    insults = sum(w in INSULTS for w in words)
    hard = int((s >= strong).sum())
    window = int((np.searchsorted(at, at + 40) - np.arange(len(at))).max()) if len(at) else 0
    near = 0
    if len(at) or insults:
        you = np.array([k for k, w in enumerate(words) if w in YOU])
        bad = at if len(at) else np.array([k for k, w in enumerate(words) if w in INSULTS])
        if len(you):
            k = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(bad - you[np.minimum(k, len(you) - 1)]), np.abs(bad - you[np.maximum(k - 1, 0)]))
            near = int((gap <= 5).sum())
    chars = max(len(text), 1)
    return [
        insults, insults / n, float(s.sum()), float(s.sum()) / n, len(at), len(at) / n, hard, hard / n, window, near,
        len(_UPPER.findall(text)) / chars, text.count("!") / n, len(_PUNCT.findall(text)) / chars, len(_MASKED.findall(text)) / n,
        1 - len(set(words)) / n, float(np.log1p(len(words))),
    ]


def _sample(labels: DataFrame, id_col: str, label: str, most: int) -> DataFrame:
    """(s_id, y, fold, h) of at most ``most`` labelled rows to learn from; h orders them."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = labels.where(F.col(label).isin(0, 1) & (F.crc32(key) % 5 != 0)).select(
        F.col(id_col).alias("s_id"), F.col(label).cast("int").alias("y"), F.md5(key).alias("h")
    )
    return rows.orderBy("h", "s_id", "y").limit(most).select("s_id", "y", "h", (F.conv(F.substring("h", -4, 4), 16, 10).cast("int") % 10).alias("fold"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> dict:
    """The lexicon, the trees and the calibration curve."""
    sample = F.broadcast(_sample(labels, id_col, label, most_rows))  # most_rows small rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(sample, F.col("doc_id") == F.col("s_id")).select("text", "y", "fold", "h")
    rows = materialize(rows, "toxic-rows")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs_, times = [Counter(), Counter()], [Counter(), Counter()]
            for t, y in zip(b["text"], b["y"], strict=True):
                c: Counter[str] = Counter()
                for w, k in Counter(tokens(t)).items():
                    for h in heads(w):
                        c[h] += k
                times[y].update(c)
                docs_[y].update(c.keys())
            for y in (0, 1):
                yield pd.DataFrame({"h": list(times[y]), "y": y, "d": [docs_[y][h] for h in times[y]], "n": list(times[y].values())})

    counts = rows.where("fold < 5").mapInPandas(count, "h string, y int, d long, n long")
    table = counts.groupBy("h").agg(*[
        F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for c in ("d", "n") for y in (0, 1)
    ])
    # over-use by toxic texts: their occurrences against the others', both as shares; z guards against chance
    totals = rows.where("fold < 5").groupBy("y").count().collect()  # two rows
    of = {r["y"]: r["count"] for r in totals}
    n1, n0 = of.get(1, 0), of.get(0, 0)
    lexicon: dict[str, float] = {}
    if n1 and n0:
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
        z = (F.col("d1") - (F.col("d0") + F.col("d1")) * (n1 / (n0 + n1))) / F.sqrt((F.col("d0") + F.col("d1")) * (n1 * n0 / (n0 + n1) ** 2))
        best = table.withColumn("odds", odds).withColumn("z", z).where((F.col("d1") >= max(3, n1 // 200)) & (F.col("odds") > 1.0) & (F.col("z") > 4))
        lexicon = {r["h"]: r["odds"] for r in best.select("h", "odds").collect()}
    lexicon |= {w: max(lexicon.get(w, 0.0), 2.0) for w in INSULTS}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(lexicon)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "fold": b["fold"], "h": b["h"], "x": [features(t, scores) for t in b["text"]]})

    measured = rows.where("fold >= 5").mapInPandas(measure, "y int, fold int, h string, x array<double>")
    # ids that repeat among the documents multiply the sample's rows: the bound holds for what reaches the driver
    data = measured.orderBy("h", "y", "x").limit(most_rows).toPandas()
    discard(rows)
    x = np.array(data["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y, fold = data["y"].to_numpy(), data["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the fit does not depend on the order in which rows arrive
    x, y, fold = x[order], y[order], fold[order]
    model = boosting.fit(x[fold < 8], y[fold < 8], rounds=40, depth=3, rate=0.2)
    held = fold >= 8
    kx, kp = boosting.isotonic(model.raw(x[held]), y[held]) if held.sum() >= 50 and 0 < y[held].sum() < held.sum() else (None, None)
    return {"lexicon": lexicon, "trees": model, "x": kx, "p": kp}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    raw = model["trees"].raw(x)
    if model["x"] is None:
        return 1 / (1 + np.exp(-raw))
    # the calibrated value; within a flat step of the curve the raw score orders by less than a millionth
    return np.clip(np.interp(raw, model["x"], model["p"]) + TIE * (1 / (1 + np.exp(-raw)) - 0.5), 0, 1)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""
    model = learn(docs, labels, id_col, text, label, most_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(model["lexicon"])
        for b in batches:
            x = np.array([features(t, scores) for t in b["text"]], dtype=float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": probability(model, x)})

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    out = slim.mapInPandas(run, f"doc_id {dict(slim.dtypes)['doc_id']}, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
