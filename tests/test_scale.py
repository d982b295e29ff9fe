"""Operators on what they are made for: hot keys, crowded scenes, exact rounding, packed masks, given cameras."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry, rng, sizing
from scenelake.operators import ids, masks, overlap, placement


def test_dense_ids_plan_their_input_once(spark):
    d = spark.range(9000).select(F.expr("id % 3").alias("s"), (F.col("id") * 7919 % 9001).alias("c")).repartition(5)
    out = ids.dense_ids(d, "s", [F.desc("c")], "n", start=10)
    got = [(r["s"], r["c"], r["n"]) for r in out.orderBy("n").collect()]
    want = sorted(((k % 3, k * 7919 % 9001) for k in range(9000)), key=lambda x: (x[0], -x[1]))
    assert got == [(*w, k + 10) for k, w in enumerate(want)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan
    # one key for all rows
    one = ids.dense_ids(spark.range(20000).select(F.lit(1).alias("s"), "id"), "s", ["id"], "n")
    assert one.where("n <> id").count() == 0
    assert ids.dense_ids(spark.range(0).withColumn("s", F.lit(1)), "s", ["id"]).count() == 0


def test_retries_place_failed_scenes_only(spark):
    objects = spark.range(400).select((F.col("id") % 100).alias("s"), "id")
    seen = []

    def judge(d):
        seen.append(d.select("s").distinct().count())
        return d.groupBy("s", "attempt").agg((F.col("s") % 4 > F.col("attempt")).alias("has_overlap"))

    got = {r["s"]: r["attempt"] for r in placement.retried(objects, ["s"], judge, most=3).collect()}
    assert got == {s: (s % 4 if s % 4 < 3 else None) for s in range(100)}
    assert seen == [100, 75, 50]
    seen.clear()
    assert placement.retried(objects.where("s % 4 = 0"), ["s"], judge).where("attempt = 0").count() == 25
    assert seen == [25]
    assert placement.retried(objects.where("false"), ["s"], judge).count() == 0


def boxes(spark, rows):
    return spark.createDataFrame(rows, "s int, i int, lo array<double>, hi array<double>, st boolean")


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_the_grid_are_those_of_the_scene(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(3):
        for i in range(60):
            lo = r.uniform(-3, 3, 3)
            size = r.choice([0.05, 0.5, 1.0, 2.0, 8.0]) * r.uniform(0.5, 1.0, 3)
            if i % 11 == 0:
                lo, size = np.round(lo), np.ones(3)  # borders on the cells' borders
            rows.append((s, i, lo.tolist(), (lo + size).tolist(), bool(i % 5 == 0)))
    d = boxes(spark, rows)
    for tolerance in (0.0, 0.05):
        want = overlap.overlapping_pairs(d, ["s"], "i", "lo", "hi", tolerance, "st").collect()
        got = overlap.crowded_pairs(d, ["s"], "i", "lo", "hi", tolerance, "st").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        assert len(want) > 20


def test_scene_of_20000_boxes(spark):
    """One scene, a floor of boxes and one that covers them all: pairs in proportion, by a sweep in numpy."""
    r = np.random.default_rng(1)
    n = 20_000
    lo = np.column_stack([r.uniform(0, 120, n), r.uniform(0, 120, n), np.zeros(n)])
    hi = lo + r.uniform(0.4, 1.0, (n, 3))
    lo[0], hi[0] = (-1, -1, 0.3), (200, 200, 0.4)
    d = boxes(spark, [(0, i, a, b, False) for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]).repartition(8)
    got = {(x["i"], x["j"]) for x in overlap.crowded_pairs(d, ["s"], "i", "lo", "hi").select("i", "j").collect()}
    order, want = np.argsort(lo[:, 0]), set()
    x0 = lo[order, 0]
    for k in range(n):
        a = order[k]
        near = order[k + 1 : np.searchsorted(x0, hi[a, 0])]
        side = np.maximum(0, np.minimum(hi[near], hi[a]) - np.maximum(lo[near], lo[a]))
        want |= {(min(a, b), max(a, b)) for b in near[side[:, 0] * side[:, 1] * side[:, 2] > overlap.TOLERANCE_M3].tolist()}
    assert got == want
    assert len(want) > 10_000


def test_boxes_too_small_to_clash_and_broken_ones(spark):
    rows = [(0, 1, [0.0] * 3, [0.1] * 3, None), (0, 2, [0.0] * 3, [0.1] * 3, None), (0, 3, [1.0] * 3, [0.0] * 3, None), (0, 4, None, None, None)]
    assert overlap.crowded_pairs(boxes(spark, rows), ["s"], "i", "lo", "hi", stack="st").count() == 0
    assert overlap.crowded_pairs(boxes(spark, rows), ["s"], "i", "lo", "hi", 0.0005, "st").count() == 1


def test_rounding_to_three_places(spark):
    """All sizes that can be written to four places, exact ties in binary, and numbers at random."""
    r = random.Random(3)
    x = [k / 10000 for k in range(300, 12001)] + [k / 16 for k in range(-4000, 4000)] + [r.uniform(-2, 2) for _ in range(20000)] + [r.uniform(-1e9, 1e9) for _ in range(5000)]
    x += [0.0, -0.0, 5e-324, -5e-324, 1e300, 0.0005, 0.0015, 0.0025, -0.0005, 2.0**42 - 2**-10, 2.0**42, math.inf, -math.inf]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", sizing.python_round3(F.col("x")).alias("r")).collect()
    bad = [(a["x"], a["r"], round(a["x"], 3)) for a in rows if math.copysign(1, a["r"]) != math.copysign(1, round(a["x"], 3)) or a["r"] != round(a["x"], 3)]
    assert bad == []
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(sizing.python_round3(F.col("x"))).collect()
    assert math.isnan(odd[0][0])
    assert odd[1][0] is None


def spelled(counts):
    """Packed counts by the letter of the public format."""
    out = []
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            bits, x = x & 31, x >> 5
            more = x != (-1 if bits & 16 else 0)
            out.append(chr(48 + bits + 32 * more))
            if not more:
                break
    return "".join(out)


def test_packed_masks_both_ways(spark):
    r = random.Random(5)
    lists = [[0], [4], [0, 4], [0, 1, 3], [15, 16, 17, 31], [511, 512, 1023, 1, 2**31, 7, 2**40, 9], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]]
    lists += [[r.choice([0, 1, 15, 16, 1000, 10**6]) for _ in range(r.randrange(1, 60))] for _ in range(60)]
    d = spark.createDataFrame([(k, c, spelled(c)) for k, c in enumerate(lists)], "k int, counts array<bigint>, text string")
    assert d.where(masks.packed(F.col("counts")) != F.col("text")).count() == 0
    runs = masks.unpacked_runs(d, ["k"], "text").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("run", "start", "n"))).alias("r")).collect()
    got = {x["k"]: x["r"] for x in runs}
    for k, c in enumerate(lists):
        assert [y["n"] for y in got[k]] == c
        assert [y["start"] for y in got[k]] == [sum(c[:i]) for i in range(len(c))]
    # strings of small masks, spelled out by hand from the format
    known = {"4": [4], "04": [0, 4], "013": [0, 1, 3], "P`0": [512], "o0": [31], "`0": [16], "1111": [1, 1, 1, 2]}
    e = spark.createDataFrame(list(known.items()), "text string, counts array<bigint>")
    assert e.where(masks.packed(F.col("counts")) != F.col("text")).count() == 0
    back = masks.unpacked_runs(e, ["text"], "text").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("run", "n"))).alias("r")).collect()
    assert {x["text"]: [y["n"] for y in x["r"]] for x in back} == known
    with pytest.raises(Exception, match="not packed counts"):
        masks.unpacked_runs(spark.createDataFrame([("k", "0P")], "k string, text string"), ["k"], "text").collect()
    assert masks.unpacked_runs(spark.createDataFrame([("a", ""), ("b", None)], "k string, text string"), ["k"], "text").count() == 0


def test_pixels_of_packed_masks(spark):
    a = np.random.default_rng(2).integers(0, 2, (7, 9))
    flat, counts, bit = a.flatten(order="F"), [0], 0
    for v in flat:
        if v != bit:
            counts.append(0)
            bit = v
        counts[-1] += 1
    d = spark.createDataFrame([(1, spelled(counts))], "k int, text string")
    p = masks.run_pixels(masks.unpacked_runs(d, ["k"], "text"), ["k"], F.lit(7)).collect()
    assert {(r["x"], r["y"]) for r in p} == {(int(x), int(y)) for y, x in zip(*np.nonzero(a), strict=True)}
    assert len(p) == a.sum()


def test_angles_and_bases(spark):
    r = np.random.default_rng(4)
    rows = [(r.uniform(-math.pi, math.pi), r.uniform(-1.5, 1.5), r.uniform(-math.pi, math.pi)) for _ in range(200)] + [(0.3, math.pi / 2, 0.0), (-0.4, -math.pi / 2, 0.0), (0.0, 0.0, 0.0)]
    d = spark.createDataFrame([(list(x),) for x in rows], "e array<double>").withColumn("b", geometry.euler_basis(F.col("e"))).withColumn("back", geometry.basis_euler(F.col("b")))
    for x in d.collect():
        a, b, c = x["e"]
        turn = lambda k, t: np.array([[1, 0, 0], [0, math.cos(t), -math.sin(t)], [0, math.sin(t), math.cos(t)]]) if k == 0 else (
            np.array([[math.cos(t), 0, math.sin(t)], [0, 1, 0], [-math.sin(t), 0, math.cos(t)]]) if k == 1 else np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]]))
        whole = turn(2, c) @ turn(1, b) @ turn(0, a)
        assert np.allclose(np.array(x["b"]).reshape(3, 3), whole.T)
        assert x["back"] == pytest.approx([a, b, c], abs=1e-6)
    # the angles of a view that looks at a point give the same axes again
    look = spark.range(1).select(geometry.look_at_basis(geometry.vec(2, -1, 3), geometry.vec(0.5, 0.25, 0)).alias("b"))
    both = look.select("b", geometry.euler_basis(geometry.basis_euler(F.col("b"))).alias("c")).first()
    assert both["b"] == pytest.approx(both["c"])


def test_null_keys_draw_for_themselves(spark):
    d = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), (None, None)], "x string, y string")
    got = [r[0] for r in d.select(rng.draw(1, F.col("x"), F.col("y"))).collect()]
    one = spark.createDataFrame([("a",)], "x string").select(rng.draw(1, F.col("x"))).first()[0]
    assert len({*got, one}) == 5
