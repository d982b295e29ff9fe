"""Boxes of one scene that overlap, and the first attempt without any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..scratch import written

TOLERANCE_M3 = 0.05


def overlapping_pairs(objects: DataFrame, scene: list[str], index: str, lo: str, hi: str, tolerance: float = TOLERANCE_M3, stack: str | None = None) -> DataFrame:
    """(scene, i, j, volume) of pairs i < j that share more than the tolerance; pairs within a stack are exempt.

    An equi-join on the scene with the pair condition as residue: objects of a scene are few, scenes are many.
    """
    cols = [F.col(c) for c in scene]
    flag = F.col(stack) if stack else F.lit(False)
    a = objects.select(*cols, F.col(index).alias("i"), F.col(lo).alias("a_lo"), F.col(hi).alias("a_hi"), flag.alias("a_stack"))
    b = objects.select(*cols, F.col(index).alias("j"), F.col(lo).alias("b_lo"), F.col(hi).alias("b_hi"), flag.alias("b_stack"))
    volume = geometry.overlap_volume((F.col("a_lo"), F.col("a_hi")), (F.col("b_lo"), F.col("b_hi")))
    pairs = a.join(b, scene).where((F.col("i") < F.col("j")) & ~(F.col("a_stack") & F.col("b_stack")))
    return pairs.withColumn("volume", volume).where(F.col("volume") > tolerance).select(*scene, "i", "j", "volume")


#: Cells may be up to 2 ** WIDER times as wide as their level, while a box meets some PARTNERS others in its cell at most.
WIDER, PARTNERS = 3, 32
#: One of so many cells is looked at to find that out; results do not depend on it.
CELLS_SEEN = 16


def crowded_pairs(objects: DataFrame, scene: list[str], index: str, lo: str, hi: str, tolerance: float = TOLERANCE_M3, stack: str | None = None) -> DataFrame:
    """As overlapping_pairs, for scenes of very many objects: boxes meet in the cells of a grid, not in their scene.

    A box whose volume is not above the tolerance has no such pair. Any other has the level of its longest side, a power
    of two. It is sent to the cells it lies in, cubes as wide as its level or wider, and to those of each higher level of
    its scene. A pair meets in the cells of the larger box's level; the one cell that holds the lower corner of what they
    share returns it. Cells as wide as a box hold it eight times, those four times as wide twice (in the mean), so cells
    of a level are widened as long as few boxes share one. The boxes are dealt once: both sides of the join read the same
    shuffle.
    """
    cols = [F.col(c) for c in scene]
    flag = F.coalesce(F.col(stack), F.lit(False)) if stack else F.lit(False)
    side = F.zip_with(F.col(hi), F.col(lo), lambda h, l: h - l)  # noqa: E741
    boxes = objects.select(*cols, F.col(index).alias("i"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), flag.alias("stack"), side.alias("side"))
    boxes = boxes.where((F.array_min("side") > 0) & (F.col("side")[0] * F.col("side")[1] * F.col("side")[2] > tolerance))
    # a side that is a power of two but for rounding is of that level: it may lie in a cell more, which loses nothing
    boxes = boxes.withColumn("level", F.ceil(F.log2(F.array_max("side")) - 1e-6).cast("int"))
    corners = [F.col(c)[k].alias(f"{c}{k}") for c in ("lo", "hi") for k in range(3)]
    boxes = written(boxes.select(*scene, "i", *corners, "stack", "level"), "crowded-boxes")
    levels = written(boxes.groupBy(*scene).agg(F.sort_array(F.collect_set("level")).alias("levels")), "crowded-levels")  # a few for each scene
    wider = _wider(boxes, scene)
    width = F.pow(F.lit(2.0), F.col("of") + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in wider.items() for x in kv]), F.col("of")), F.lit(0)) if wider else F.col("of"))
    d = boxes.join(levels, scene).select("*", F.explode(F.filter("levels", lambda x: x >= F.col("level"))).alias("of")).drop("levels")
    for k, name in enumerate("xyz"):
        d = d.withColumn(name, F.explode(F.sequence(F.floor(F.col(f"lo{k}") / width).cast("long"), F.floor(F.col(f"hi{k}") / width).cast("long"))))
    cell, rest = [*scene, "of", "x", "y", "z"], ["i", *(f"{c}{k}" for c in ("lo", "hi") for k in range(3)), "stack", "level"]
    a, b = (d.select(*cell, *[F.col(c).alias(f"{at}_{c}") for c in rest]) for at in "ab")
    corner_of = lambda at, c: F.array(*[F.col(f"{at}_{c}{k}") for k in range(3)])
    volume = geometry.overlap_volume((corner_of("a", "lo"), corner_of("a", "hi")), (corner_of("b", "lo"), corner_of("b", "hi")))
    pairs = a.join(b, cell).where((F.col("a_i") < F.col("b_i")) & ~(F.col("a_stack") & F.col("b_stack")) & (F.greatest("a_level", "b_level") == F.col("of")))
    pairs = pairs.withColumn("volume", volume).where(F.col("volume") > tolerance)
    for k, name in enumerate("xyz"):
        pairs = pairs.where(F.floor(F.greatest(f"a_lo{k}", f"b_lo{k}") / width).cast("long") == F.col(name))
    return pairs.select(*scene, F.col("a_i").alias("i"), F.col("b_i").alias("j"), "volume")


def _wider(boxes: DataFrame, scene: list[str]) -> dict[int, int]:
    """level -> by how many powers of two its cells are widened, from the numbers of lower corners in some cells."""
    at = F.explode(F.array(*[F.lit(k) for k in range(1, WIDER + 1)])).alias("wider")
    width = F.pow(F.lit(2.0), F.col("level") + F.col("wider"))
    d = boxes.select(*scene, "level", "lo0", "lo1", "lo2", at)
    d = d.select(*scene, "level", "wider", *[F.floor(F.col(f"lo{k}") / width).cast("long").alias(n) for k, n in enumerate("xyz")])
    d = d.where(F.pmod(F.xxhash64(*scene, "level", "wider", "x", "y", "z"), F.lit(CELLS_SEEN)) == 0)
    cells = d.groupBy(*scene, "level", "wider", "x", "y", "z").agg(F.count("*").cast("double").alias("n"))
    found = cells.groupBy("level", "wider").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("partners"))  # a few rows for each level
    out: dict[int, int] = {}
    for r in found.where(F.col("partners") <= PARTNERS).collect():
        out[r["level"]] = max(r["wider"], out.get(r["level"], 0))
    return out


def without_pairs(pairs: DataFrame, ignored: DataFrame, scene: list[str]) -> DataFrame:
    """pairs less those listed in either order."""
    sides = ignored.select(*scene, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    return pairs.withColumns({"__a": F.least("i", "j"), "__b": F.greatest("i", "j")}).join(
        sides.withColumnsRenamed({"i": "__a", "j": "__b"}), [*scene, "__a", "__b"], "left_anti"
    ).drop("__a", "__b")


def any_overlap(scenes: DataFrame, pairs: DataFrame, scene: list[str]) -> DataFrame:
    """Each scene with has_overlap."""
    bad = pairs.select(*scene).distinct().withColumn("has_overlap", F.lit(True))
    return scenes.join(bad, scene, "left").withColumn("has_overlap", F.coalesce("has_overlap", F.lit(False)))


def scenes_with_overlap(objects: DataFrame, scene: list[str], index: str, lo: str, hi: str, tolerance: float = TOLERANCE_M3, stack: str | None = None) -> DataFrame:
    """Each scene with has_overlap, as any_overlap over overlapping_pairs: one grouping, no join.

    A scene's boxes, a handful by its configuration, meet in one array whose pairs are asked until one overlaps.
    """
    flag = F.col(stack) if stack else F.lit(False)
    box = F.struct(F.col(index).alias("i"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), flag.alias("stack"))

    def clash(a: Column, b: Column) -> Column:
        return (a["i"] < b["i"]) & ~(a["stack"] & b["stack"]) & (geometry.overlap_volume((a["lo"], a["hi"]), (b["lo"], b["hi"])) > tolerance)

    boxes = objects.groupBy(*scene).agg(F.collect_list(box).alias("__boxes"))
    found = F.exists("__boxes", lambda a: F.exists("__boxes", lambda b: clash(a, b)))
    return boxes.select(*scene, F.coalesce(found, F.lit(False)).alias("has_overlap"))


def success_counts(first: DataFrame, attempt: str = "attempt") -> DataFrame:
    """One row: scenes that had an attempt that did not fail, and all scenes; of first_passing's result."""
    return first.agg(F.count(attempt).alias("n_success"), F.count("*").alias("n_total"))


def first_passing(tried: DataFrame, scene: list[str], attempt: str = "attempt", failed: Column | str = "has_overlap") -> DataFrame:
    """(scene, attempt): the first attempt that did not fail; null where all did."""
    bad = F.col(failed) if isinstance(failed, str) else failed
    return tried.groupBy(*scene).agg(F.min(F.when(~bad, F.col(attempt))).alias(attempt))


def others_hidden(objects: DataFrame, scene: list[str], index: str) -> DataFrame:
    """(scene, index, hidden): for each object all others of its scene, as hidden while it is drawn alone."""
    a, b = objects.select(*scene, F.col(index).alias("i")), objects.select(*scene, F.col(index).alias("hidden"))
    return a.join(b, scene).where("i <> hidden").withColumnRenamed("i", index)
