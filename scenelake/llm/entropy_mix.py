"""Mixing sources to target token weights by entropy balancing (DataFrame functions only).

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
CAP times its source's size and the excess is shared again by weight until none is above (water filling).

Rates: every document i has a rate r_i in 0 .. CAP. Of all rates that meet the token constraint sum size_i r_i = T_s of
every source, those of the least relative entropy  sum (r_i log r_i - r_i + 1)  over documents are taken. They are
exponentially tilted,  r_i = min(CAP, exp(lambda_s x_i)),  x_i the document's size by the mean size of its source: long
documents bear more of a source's change than short ones. lambda maximises the concave dual; its gradient
T_s - sum size_i r_i  and its curvature  sum size_i x_i r_i  (over rates below the cap) are sums over documents. Newton's
iteration runs on all sources at once: each round is one partially aggregated pass over the counts of documents by
(source, size), which is all that the sums need, and a new row per source (Parquet in the shared folder). A step that
leaves the interval known to hold the solution is replaced by bisection. Rounds go on until no lambda moves.

Copies: lambda is rounded to 9 decimals and the rate to RATE_UNITS, so that the order in which sums are made cannot show. Every
document gives floor(r) copies; one more goes to documents in the order of (u - rest of r), u a hash draw, so that about
a share r - floor(r) of equal documents gets it, until the source's target is reached to within half a document. The cut in
that order is found by a histogram, then by one of the bin where the cut lies, and so on (LEVELS x DIGIT bits): no
source is sorted, nor gathered in one task. Draws are the first 52 bits of a hash of id and text, scaled; documents that
tie at the cut go by the whole hash and then the id, so which of them is taken depends on the documents alone. Only rows
equal in all of that are told apart by where they lie, and they give equal rows.

Edge cases: null or empty texts have size 0 and are never taken; a null source is a source of its own, the last; rows
that repeat are documents of their own; if all sizes are 0 the targets are 0; an empty table gives an empty result;
further columns are ignored. The windows over sources hold one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, n_words_of, text_or_empty

CAP = 3
WEIGHTS = (1, 2, 3)
#: A rate is a whole number of these; so are the draws.
RATE_UNITS = 1_000_000_000
#: Newton ends when no lambda moves by more, or where a source's words are within this share of its target.
TOLERANCE, GRADIENT = 1e-11, 1e-13
#: The order of copies has LEVELS digits of DIGIT bits.
LEVELS, DIGIT = 3, 11


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of (source, source_size); one row per source.

    A source is capped iff its cap-to-weight ratio is at most the water level reached when all sources of a smaller
    ratio are capped; with the sources in the order of that ratio this is a running sum.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    k = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), k + 1)
    s = sizes.withColumn("w", w.cast("double")).withColumn("stop", (F.lit(cap) * F.col("source_size")).cast("double"))
    order = [F.col("stop") / F.col("w"), F.col("source").isNull(), F.col("source")]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "left": F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("stop").over(upto), F.lit(0.0)),
        "w_left": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)),
    })
    s = s.withColumn("capped", F.col("stop") * F.col("w_left") <= F.col("left") * F.col("w"))
    # the water level: what is left at the first source that is not capped, by the weight left there
    s = s.withColumns({
        "level_left": F.max(F.when(~F.col("capped"), F.struct(F.col("w_left"), F.col("left")))).over(whole),
    })
    return s.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("stop")).otherwise(F.col("level_left.left") * F.col("w") / F.col("level_left.w_left")).alias("target"),
    )


def newton(counts: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """targets with mean_size and lambda; counts: (source, size, n), targets: (source, source_size, target).

    A source whose target is cap times its size has lambda null: all its documents have the rate cap. So has a source
    of size 0, whose documents have no words to take. A target of 0 among positive ones cannot come up.
    """
    n_docs = counts.where("size > 0").groupBy("source").agg(F.sum("n").alias("n_docs"))
    n_docs = n_docs.select(F.col("source").alias("n_source"), "n_docs")
    state = targets.join(n_docs, F.col("source").eqNullSafe(F.col("n_source")), "left").select(
        "source", "source_size", "target", (F.col("source_size") / F.coalesce("n_docs", F.lit(1))).alias("mean_size"),
        F.lit(0.0).alias("lambda"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0.0).alias("moved"),
    )
    solvable = (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size"))
    state = materialize(state.withColumn("lambda", F.when(solvable, F.col("lambda"))), "mix-dual")
    counts = counts.where("size > 0").select(F.col("source").alias("c_source"), "size", "n")
    while True:
        x = F.col("size") / F.col("mean_size")
        tilt = F.exp(F.least(F.col("lambda") * x, F.lit(float(cap))))
        words = F.col("n") * F.col("size")
        sums = counts.join(state.where("lambda is not null"), F.col("c_source").eqNullSafe(F.col("source"))).groupBy("source").agg(
            F.sum(words * F.least(tilt, F.lit(float(cap)))).alias("got"), F.sum(F.when(tilt < cap, words * x * tilt).otherwise(0.0)).alias("bend")
        ).select(F.col("source").alias("g_source"), "got", "bend")
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lambda")), F.when(over, F.col("lambda")).otherwise(F.col("hi"))
        step = F.col("lambda") + (F.col("target") - F.col("got")) / F.col("bend")
        # beyond the interval, or where all documents are at the cap: its middle, or twice as far where one end is open
        middle = F.coalesce((F.col("lo1") + F.col("hi1")) / 2, F.col("hi1") * 2 - 1, F.col("lo1") * 2 + 1)
        good = (F.col("bend") > 0) & F.coalesce(F.col("step") >= F.col("lo1"), F.lit(True)) & F.coalesce(F.col("step") <= F.col("hi1"), F.lit(True))
        new = state.join(sums, F.col("source").eqNullSafe(F.col("g_source")), "left").withColumns({"lo1": lo, "hi1": hi, "step": step})
        new = new.withColumn("next", F.when(F.coalesce(good, F.lit(False)), F.col("step")).otherwise(middle))
        new = new.select(
            "source", "source_size", "target", "mean_size", F.when(F.col("lambda").isNotNull(), F.col("next")).alias("lambda"),
            F.col("lo1").alias("lo"), F.col("hi1").alias("hi"),
            F.when(F.abs(F.col("target") - F.col("got")) > GRADIENT * F.col("target"), F.abs(F.col("next") - F.col("lambda")) / F.greatest(F.abs("next"), F.lit(1.0)))
            .otherwise(0.0).alias("moved"),
        )
        new, old = materialize(new, "mix-dual"), state
        discard(old)
        state = new
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return state.select("source", "source_size", "target", "mean_size", "lambda")


def rate_of(cap: int = CAP) -> F.Column:
    """The tilted rate in RATE_UNITS, from size, mean_size and lambda."""
    raw = F.exp(F.least(F.round("lambda", 9) * (F.col("size") / F.col("mean_size")), F.lit(float(cap))))
    return F.coalesce(F.round(F.least(raw, F.lit(float(cap))) * RATE_UNITS).cast("long"), F.lit(cap * RATE_UNITS))


def _sized(docs: DataFrame, id_col: str, text: str, source: str, *more: F.Column) -> DataFrame:
    """(doc_id, source, size, key, u, more): key is the hash that draws are made of, u the draw."""
    t = text_or_empty(f"`{text}`")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(t)))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words_of(t).alias("size"), key.alias("key"), *more)
    draw = F.floor(F.conv(F.substring("key", 1, 13), 16, 10).cast("double") * float(RATE_UNITS) / 2.0**52)
    return d.withColumn("u", draw.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row per row of docs."""
    sizes = materialize(_sized(docs, id_col, text, source), "mix-sizes")
    return _decided(sizes, *_solved(sizes)).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken; columns of these names are replaced.

    The rates and cuts come from the sizes alone; every document is then decided where it is read, so no text is shuffled.
    """
    sizes = materialize(_sized(docs, id_col, text, source).select("source", "size", "u"), "mix-sizes")
    dual, cuts = _solved(sizes)
    discard(sizes)
    new = ("size", "source_size", "target", "rate", "copies", "taken")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("__doc")
    return _decided(_sized(docs, id_col, text, source, whole), dual, cuts).select("__doc.*", *new)


def _rated(d: DataFrame, dual: DataFrame) -> DataFrame:
    """d with its source's numbers, the rate in units, the copies that are sure and the place in the order of one more."""
    d = d.join(dual.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source"))).withColumn("units", rate_of())
    return d.withColumns({"base": F.expr(f"units div {RATE_UNITS}"), "order": F.col("u") - F.col("units") % RATE_UNITS + RATE_UNITS}).drop("s_source", "mean_size", "lambda")


def _solved(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with their lambda, sources with the place of their cut), of a table (source, size, u)."""
    counts = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    dual = newton(counts, source_targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    discard(counts)
    return dual, _cuts(_rated(sizes, dual))


def _decided(d: DataFrame, dual: DataFrame, cuts: DataFrame) -> DataFrame:
    """d with rate, copies and taken."""
    out = _rated(d, dual).join(cuts, F.col("source").eqNullSafe(F.col("x_source")), "left")
    open_ = (F.col("size") > 0) & (F.col("base") < CAP)
    tie = F.coalesce(open_ & (F.col("order") == F.col("x_order")), F.lit(False))
    # rows at the cut are written with a part and a place in it, which tell equal rows apart
    at_cut = materialize(out.where(tie).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "mix-ties")
    sure = F.coalesce(open_ & (F.col("order") < F.col("x_order")), F.lit(False))
    out = out.where(~tie).withColumn("more", sure).drop("x_source", "x_order", "x_left")
    out = out.unionByName(_tied(at_cut).select(out.columns))
    out = out.withColumns({"copies": F.col("base") + F.col("more").cast("long"), "rate": F.col("units") / RATE_UNITS})
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _cuts(d: DataFrame) -> DataFrame:
    """(x_source, x_order, x_left): documents before x_order get one more copy, those at it share the x_left words left."""
    rest = d.groupBy("source").agg((F.max("target") - F.sum(F.col("base") * F.col("size"))).alias("x_left"))
    # only sources with words to share; where the last documents would not reach the rest, all of them get one more
    cuts = materialize(rest.where("x_left > 0").select(F.col("source").alias("x_source"), F.lit(0).cast("long").alias("x_order"), "x_left"), "mix-cuts")
    for level in range(LEVELS):
        width = 1 << (DIGIT * (LEVELS - 1 - level))
        here = (F.col("size") > 0) & (F.col("base") < CAP) & (F.col("order") >= F.col("x_order")) & (F.col("order") < F.col("x_order") + (width << DIGIT))
        bins = d.join(cuts, F.col("source").eqNullSafe(F.col("x_source"))).where(here).groupBy(
            "x_source", "x_order", "x_left", F.expr(f"(order - x_order) div {width}").alias("bin")
        ).agg(F.sum("size").alias("words"))
        # a source has at most 2 ** DIGIT bins
        upto = Window.partitionBy("x_source").orderBy("bin")
        bins = bins.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        # the last bin that begins within the rest
        at = bins.where("before < x_left").groupBy("x_source").agg(F.max(F.struct("bin", "before", "x_order", "x_left")).alias("c"))
        old, cuts = cuts, materialize(at.select(
            "x_source", (F.col("c.x_order") + F.col("c.bin") * width).alias("x_order"), (F.col("c.x_left") - F.col("c.before")).alias("x_left")
        ), "mix-cuts")
        discard(old)
    return cuts


def _tied(at_cut: DataFrame) -> DataFrame:
    """The rows at their source's cut with ``more``: one more copy until the rest is reached to within half a document.

    They go by their hash and id. The different ones of a source meet in a window, a row for each: as many documents as tie
    in a draw. Equal rows are counted first, and numbered within their parts, whose counts alone meet.
    """
    same = ["source", "key", "doc_id"]
    parts = at_cut.groupBy(*same, "part").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("x_left").alias("x_left"))
    groups = parts.groupBy(*same).agg(F.sum("n").alias("g_n"), F.first("size").alias("size"), F.first("x_left").alias("x_left"))
    upto = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("g_n") * F.col("size")).over(upto), F.lit(0))
    # the j-th of equal rows is taken if 2 (before + j size) + size <= 2 x_left
    take = F.floor((2 * F.col("x_left") - 2 * F.col("before") - F.col("size")) / (2 * F.col("size"))) + 1
    groups = groups.withColumn("before", before).select(*same, F.greatest(F.lit(0).cast("long"), F.least("g_n", take)).alias("take"))
    by_part = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*same, "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("p_before"))
    equal = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    known = parts.alias("p").join(groups.alias("g"), equal("p", "g")).select("p.*", "g.take")
    rows = at_cut.alias("r").join(known.alias("k"), equal("r", "k") & (F.col("r.part") == F.col("k.part"))).select("r.*", "k.p_before", "k.take")
    number = F.col("p_before") + F.row_number().over(Window.partitionBy(*same, "part").orderBy("row")) - 1
    return rows.withColumn("more", number < F.col("take"))
