"""Documents, digests and grids on inputs that no row, task or driver should hold whole."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scenelake import queries
from scenelake.operators import annotations, digests

SF = "/root/testdata/sf0.001"


def test_coco_document_is_no_single_row(spark, monkeypatch):
    """The query reads lines of one object each; the operator for datasets that fit one row is not part of it."""
    seen = []
    whole = annotations.document_lines
    monkeypatch.setattr(annotations, "document", lambda *_: pytest.fail("the whole document in one row"))
    monkeypatch.setattr(annotations, "document_lines", lambda *a: seen.append(whole(*a)) or seen[0])
    assert queries.coco_document(spark, SF).count() > 1000
    assert seen[0].agg(F.max(F.length("value"))).first()[0] < 200
    text = "\n".join(r["value"] for r in seen[0].orderBy("section", "rank", "id").collect())
    assert set(json.loads(text)) == {"images", "annotations", "categories"}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_digest_of_an_ordered_column(spark, n):
    """Runs are joined by the separator too, whatever the order in which rows come; odd texts count by their bytes."""
    d = spark.range(n, numPartitions=3).select("id", F.concat(F.lit('é,"'), F.col("id"), F.when(F.col("id") % 7 == 0, "").otherwise("\u0001x")).alias("v")).orderBy(F.desc("id"))
    want = ",".join(f'é,"{k}' + ("" if k % 7 == 0 else "\u0001x") for k in range(n))
    got = digests.ordered_md5(d, F.col("id"), F.col("v")).collect()
    assert [tuple(r) for r in got] == [(n, hashlib.md5(want.encode()).hexdigest() if n else None)]


def test_lines_are_parsed_or_raise(spark):
    lines = spark.createDataFrame([(0, 1, 1, '{"id":1}'), (0, 1, 2, ',{"id":2}'), (0, 0, None, '{"images":['), (1, 1, 1, '{"id":')], "section int, rank int, id long, value string")
    assert [r["id"] for r in annotations.line_objects(lines, 0, "id long").orderBy("id").collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        annotations.line_objects(lines, 1, "id long").collect()


def sparse(spark, n, edge, side=0.5):
    """Boxes of one size in one scene; lo + side - lo is not always side."""
    at = [(F.rand(k) * edge).alias(c) for k, c in enumerate("xyz")]
    d = spark.range(n, numPartitions=4).select(F.lit(0).alias("s"), F.col("id").alias("i"), *at)
    return d.select("s", "i", F.array("x", "y", "z").alias("lo"), F.array(F.col("x") + side, F.col("y") + side, F.col("z") + side).alias("hi"))


def test_boxes_of_a_grid_are_dealt_once(spark, monkeypatch):
    """Both sides of the join read one shuffle, to which a box of a sparse scene goes twice or so, not sixteen times."""
    from scenelake.operators import overlap

    n = 20_000
    d = sparse(spark, n, 40.0).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = overlap.crowded_pairs(d, ["s"], "i", "lo", "hi")
        got = out.count()
        plan = out._jdf.queryExecution()
        out.collect()
        final = plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in final
    assert got > 100
    boxes = d.selectExpr("s", "cast(-1 as int) as level", "lo[0] as lo0", "lo[1] as lo1", "lo[2] as lo2")
    assert overlap._wider(boxes, ["s"]) == {-1: 3}
    want = sorted(map(tuple, overlap.overlapping_pairs(d.where("i < 3000"), ["s"], "i", "lo", "hi").collect()))
    for wider in (0, 1, 3):
        monkeypatch.setattr(overlap, "_wider", lambda *_, w=wider: {-1: w} if w else {})
        assert sorted(map(tuple, overlap.crowded_pairs(d.where("i < 3000"), ["s"], "i", "lo", "hi").collect())) == want


def test_cells_of_a_dense_scene_stay_narrow(spark):
    from scenelake.operators import overlap

    boxes = sparse(spark, 20_000, 4.0).selectExpr("s", "cast(-1 as int) as level", "lo[0] as lo0", "lo[1] as lo1", "lo[2] as lo2")
    assert overlap._wider(boxes, ["s"]) == {}


def test_arrays_of_a_document_are_not_broadcast_for_the_size_of_their_ranges(spark, tmp_path):
    """A join of two arrays, each far above the threshold, is no broadcast join; objects lie across pieces and ranges."""
    from scenelake.sources import documents

    n = 20_000
    doc = {"images": [{"id": k, "name": "x}{\\\"" * (k % 9)} for k in range(n)], "annotations": [{"id": k, "at": k % 7} for k in range(n)]}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    kept, documents.PIECE = documents.PIECE, 997
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        t = documents.arrays(spark, str(path), {"images": "struct<id: long, name: string>", "annotations": "struct<id: long, at: int>"}, range_=1 << 16)
        out = t["images"].join(t["annotations"], "id")
        rows = out.collect()
        final = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        documents.PIECE = kept
    assert sorted(map(tuple, rows)) == [(k, doc["images"][k]["name"], k % 7) for k in range(n)]
    assert "BroadcastHashJoin" not in final.split("Initial Plan")[0]


def test_number_of_ranges_is_bounded(spark, tmp_path, monkeypatch):
    from scenelake.sources import documents

    path = tmp_path / "doc.json"
    path.write_text(json.dumps({"a": [{"k": k} for k in range(500)]}))
    monkeypatch.setattr(documents, "MOST_RANGES", 7)
    assert len(documents.begins(spark, str(path), documents.size_of(str(path)), 16)) <= 7
    assert documents.elements(spark, str(path), 16).count() == 500
