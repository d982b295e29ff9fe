import math

import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry, rng, sizing, text
from scenelake.operators.masks import unpacked

REPLIES = [
    ("13.5", 13.5), ("~13", 13.0), ("≈ 13.5", 13.5), ("13.5cm", 13.5), ("13.", 13.0), ("Approximately 13.5 cm", 13.5), ("", None), ("  ", None),
    (None, None), ("nan", math.nan), ("1,200", 1.0), ("12-15", 12.0), ("about -5", 5.0), ("-5", -5.0), ("1_0", 10.0), ("1e2", 100.0), ("none", None),
    ("0x1p3", 0.0), ("13d", 13.0), ("-5d", 5.0), ("1e2d", 1.0), ("12 cm", 12.0), ("inf", math.inf), ("  7.;  x", 7.0),
]


@pytest.mark.parametrize(("raw", "want"), REPLIES)
def test_parse_cm(spark, raw, want):
    got = spark.range(1).select(text.parse_cm(F.lit(raw).cast("string")).alias("v")).first()["v"]
    assert got == want or (want is not None and math.isnan(want) and math.isnan(got))


def test_size_bounds(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0299, 0.03, 1.2, 1.21, float("nan"), None)], "x double")
    assert [r[0] for r in rows.select(sizing.writable(F.col("x"))).collect()] == [False, True, True, False, False, False]


def test_product_size_reads_wider_than_it_writes(spark):
    rows = spark.createDataFrame([(0.03,), (1.3,), (1.5,), (1.51,), (None,)], "x double")
    u = F.lit(0.5)
    got = [r[0] for r in rows.select(sizing.product_size(F.col("x"), F.lit("can"), u, u)).collect()]
    assert got == pytest.approx([0.03, 1.3, 1.5, 0.13, 0.13])


def test_shape_ranges_fall_back(spark):
    rows = spark.createDataFrame([("box",), ("unknown",), ("",), (None,)], "s string")
    assert [tuple(r) for r in rows.select(*sizing.size_range(F.col("s"))).collect()] == [(0.10, 0.35)] + [(0.08, 0.35)] * 3


def test_rounding_as_python_does(spark):
    values = [k / 10000 for k in range(300, 12001, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rows.select(sizing.python_round3(F.col("x"))).collect()] == [round(v, 3) for v in values]


def test_zone_scales_only_given_bounds(spark):
    got = spark.range(1).select(
        sizing.zone(None, F.lit("scatter")).alias("a"), sizing.zone(F.array(*map(F.lit, (-0.5, 0.5, -1.0, 1.0))), F.lit("cluster_tight")).alias("b")
    ).first()
    assert got["a"] == [-0.12, 0.12, -0.12, 0.12]
    assert got["b"] == pytest.approx([-0.3, 0.3, -0.6, 0.6])


def test_paths_sort_by_components(spark):
    rows = spark.createDataFrame([("a-b/x.glb",), ("a/x.y.glb",), ("/r/.hid",)], "p string")
    assert [r[0] for r in rows.orderBy(text.component_order(F.col("p"))).collect()] == ["/r/.hid", "a/x.y.glb", "a-b/x.glb"]
    assert [r[0] for r in rows.select(text.file_stem(F.col("p"))).collect()] == ["x", "x.y", ".hid"]


def test_overlap_volume(spark):
    v = geometry.vec
    box = lambda x: (v(x, 0, 0), v(x + 1, 1, 1))
    got = spark.range(1).select(*[geometry.overlap_volume(box(0), box(x)).alias(f"c{i}") for i, x in enumerate((0, 0.5, 1, 2))]).first()
    assert list(got) == [1.0, 0.5, 0.0, 0.0]


def test_look_at_basis_is_orthonormal(spark):
    b = spark.range(1).select(geometry.look_at_basis(geometry.vec(1, 2, 3), geometry.vec(0, 0, 0.5)).alias("b"), geometry.look_at_basis(geometry.vec(0, 0, 2), geometry.vec(0, 0, 0)).alias("down")).first()
    for axes in (b["b"], b["down"]):
        rows = [axes[0:3], axes[3:6], axes[6:9]]
        for i in range(3):
            for j in range(3):
                assert sum(x * y for x, y in zip(rows[i], rows[j], strict=True)) == pytest.approx(float(i == j), abs=1e-12)


def test_draws_do_not_depend_on_partitions(spark):
    one = spark.range(100, numPartitions=1).select("id", rng.draw(3, F.col("id"), "x").alias("u")).collect()
    many = spark.range(100).repartition(7).select("id", rng.draw(3, F.col("id"), "x").alias("u")).collect()
    assert sorted(one) == sorted(many)
    assert all(0 <= r["u"] < 1 for r in one)


@pytest.mark.parametrize(("n", "k"), [(10, 4), (4, 4), (3, 5), (1, 2), (0, 3), (5, 0)])
def test_sample_indices(spark, n, k):
    rows = spark.range(200).select(rng.sample_indices(F.lit(n), k, max(k, 1), 5, F.col("id")).alias("c")).collect()
    for (c,) in rows:
        assert len(c) == (k if n else 0)
        assert all(0 <= i < n for i in c)
        if n >= k:
            assert len(set(c)) == k
    if n >= k > 0:
        assert {i for (c,) in rows for i in c} == set(range(n))


def test_unpacked_reads_what_packed_writes(spark):
    from scenelake.operators.masks import packed

    cases = [[0, 6], [1, 4, 1], [5], [0, 1, 100000, 3, 99990, 1000000], [3, 2, 1, 1, 2, 3, 700, 5]]
    rows = spark.createDataFrame([(c,) for c in cases], "c array<bigint>").select(packed(F.col("c")).alias("p")).collect()
    assert [unpacked(r["p"]) for r in rows] == cases
