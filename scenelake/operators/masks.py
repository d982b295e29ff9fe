"""Masks as runs: column-major run lengths, boxes, areas, and COCO's packed strings.

An index buffer is long-form (image, x, y, v): v is an object's pass index, 0 the background. All objects of an image are
taken in one grouping by value instead of one comparison of the buffer per object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import let


def boxes_and_areas(pixels: DataFrame, image: list[str], x: str = "x", y: str = "y", value: str = "v") -> DataFrame:
    """(image, value, bbox [x, y, w, h], area) of every value above 0."""
    g = pixels.where(F.col(value) > 0).groupBy(*image, value)
    out = g.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count("*").alias("area"))
    bbox = F.array(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1)
    return out.select(*image, value, bbox.alias("bbox"), "area")


def mask_runs(pixels: DataFrame, image: list[str], height: str, width: str, x: str = "x", y: str = "y", value: str = "v") -> DataFrame:
    """(image, value, counts): run lengths of each value's mask in column-major order, the zero run first.

    Gaps and islands over the mask's own pixels only: positions that follow one another form a run, the gaps between
    are the zero runs, so the background is never materialised.
    """
    at = F.col(x) * F.col(height) + F.col(y)
    d = pixels.where(F.col(value) > 0).select(*image, value, at.cast("long").alias("at"), (F.col(height) * F.col(width)).cast("long").alias("total"))
    w = Window.partitionBy(*image, value).orderBy("at")
    d = d.withColumn("island", F.col("at") - F.row_number().over(w))
    runs = d.groupBy(*image, value, "total", "island").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    one = runs.groupBy(*image, value, "total").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))
    none = F.expr("cast(array() as array<bigint>)")
    start = F.struct(F.lit(0).cast("long").alias("pos"), none.alias("out"))
    step = lambda a, r: F.struct((r["start"] + r["n"]).alias("pos"), F.concat(a["out"], F.array(r["start"] - a["pos"], r["n"])).alias("out"))
    done = F.aggregate("runs", start, step)
    tail = F.col("total") - F.col("__acc")["pos"]
    counts = F.when(tail > 0, F.concat(F.col("__acc")["out"], F.array(tail))).otherwise(F.col("__acc")["out"])
    return one.withColumn("__acc", done).select(*image, value, counts.alias("counts"))


def run_lengths(df: DataFrame, by: list[str], order: str, bit: Column) -> DataFrame:
    """(by, run, bit, n): runs of equal bits of each group in order."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.select(*by, order, bit.cast("int").alias("bit"))
    d = d.withColumn("__new", F.when(F.col("bit") == F.lag("bit").over(w), 0).otherwise(1))
    d = d.withColumn("run", F.sum("__new").over(w))
    return d.groupBy(*by, "run", "bit").agg(F.count("*").alias("n"))


def area_of(counts: Column) -> Column:
    """Pixels of a mask: the runs at odd places."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, c: a + c)


def nonempty(annotations: DataFrame, area: str = "area") -> DataFrame:
    return annotations.where(F.col(area) > 0)


def packed(counts: Column) -> Column:
    """COCO's compressed counts: from the third run on the difference to the run two before, in 5-bit groups, each a
    character from code 48 on, bit 6 set where more follow."""
    delta = F.transform(counts, lambda c, i: F.when(i > 2, c - F.get(counts, i - 2)).otherwise(c))

    def code(x: Column) -> Column:
        # groups until only copies of the sign bit are left; 13 groups hold 64 bits
        group = lambda k: F.shiftright(x, 5 * k).bitwiseAND(31)
        last = F.lit(12)
        for k in range(11, -1, -1):
            rest = F.shiftright(x, 5 * (k + 1))
            sign = group(k).bitwiseAND(16) != 0
            last = F.when(F.when(sign, rest == -1).otherwise(rest == 0), k).otherwise(last)
        char = lambda k, n: F.when(F.lit(k) <= n, F.char(group(k) + F.when(F.lit(k) < n, 32).otherwise(0) + 48)).otherwise("")
        return let(last, lambda n: F.concat(*[char(k, n) for k in range(13)]))

    return F.array_join(F.transform(delta, code), "")


#: A count of a packed mask: characters with the bit that more follow, and a last one without. Fixed values.
_WORD = "([P-o]*[0-O])"


def packed_counts(text: Column) -> Column:
    """The signed differences of a packed string, in order (inverse of packed, but for the differences). A string that
    holds anything else raises."""

    def value(word: Column) -> Column:
        groups = F.transform(F.split(word, ""), lambda c: F.ascii(c) - 48)
        bits = F.aggregate(
            groups, F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("shift")),
            lambda a, g: F.struct((a["x"] + F.call_function("shiftleft", g.bitwiseAND(31).cast("long"), a["shift"])).alias("x"), (a["shift"] + 5).alias("shift")),
        )
        negative = F.element_at(groups, -1).bitwiseAND(16) != 0
        return let(bits, lambda b: b["x"] - F.when(negative & (b["shift"] < 64), F.call_function("shiftleft", F.lit(1).cast("long"), b["shift"])).otherwise(0))

    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))
    bad = F.raise_error(F.concat(F.lit("not packed counts: "), text)).cast("array<string>")
    return F.transform(F.when(F.length(F.array_join(words, "")) == F.length(text), words).otherwise(F.when(text.isNotNull(), bad)), value)


def unpacked_runs(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, run, start, n): the runs of packed masks, numbered from 0, with the places they begin at; by tells masks apart.

    From the fourth run on a count is a difference to the run two before: a running sum over the runs of one parity, the
    first of all left out. A run of an odd number is one of the mask.
    """
    d = df.select(*by, F.posexplode(packed_counts(F.col(text))).alias("run", "d"))
    chain = Window.partitionBy(*by, "__chain").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__chain", F.when(F.col("run") == 0, 2).otherwise(F.col("run") % 2)).withColumn("n", F.sum("d").over(chain))
    before = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return d.select(*by, "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")


def run_pixels(runs: DataFrame, by: list[str], height: Column) -> DataFrame:
    """(by, x, y): the pixels of masks given as column-major runs; the inverse of mask_runs."""
    inside = runs.where("run % 2 = 1 and n > 0").select(*by, height.alias("__h"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("__at"))
    return inside.select(*by, F.expr("cast(__at div __h as int)").alias("x"), F.expr("cast(__at % __h as int)").alias("y"))


def unpacked(text: str) -> list[int]:
    """The counts of a packed string; for readers and tests."""
    out: list[int] = []
    at = 0
    while at < len(text):
        value = shift = 0
        while True:
            c = ord(text[at]) - 48
            at += 1
            value |= (c & 31) << shift
            shift += 5
            if not c & 32:
                break
        if c & 16:
            value -= 1 << shift
        out.append(value + (out[-2] if len(out) > 2 else 0))
    return out
