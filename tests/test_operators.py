import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.adapters import ask
from scenelake.operators import annotations, assets, ids, masks, overlap, placement, views
from scenelake.operators.sizing import status_counts
from scenelake.plans import scenes as plan
from scenelake.plans.sizing import estimate_sizes
from scenelake.sinks import sidecars
from scenelake.sources import cameras, datasets, files, manifests
from scenelake.sources.config import SceneConfig


def pixels(spark, a, image=0):
    ys, xs = np.nonzero(a)
    rows = [(image, int(x), int(y), int(a[y, x]), *a.shape) for x, y in zip(xs, ys, strict=True)]
    return spark.createDataFrame(rows, "image int, x int, y int, v int, height int, width int")


def runs_by_hand(mask):
    flat, out, bit, n = mask.flatten(order="F"), [], 0, 0
    for v in flat:
        if v != bit:
            out.append(n)
            bit, n = v, 0
        n += 1
    return [*out, n]


@pytest.mark.parametrize("mask", [[[0, 1, 1], [1, 1, 0]], [[1, 1, 1], [1, 1, 1]], [[0, 0], [0, 1]], [[1, 0], [0, 0]]])
def test_runs_boxes_areas(spark, mask):
    a = np.array(mask)
    d = pixels(spark, a)
    r = masks.mask_runs(d, ["image"], "height", "width").withColumn("area", masks.area_of(F.col("counts"))).first()
    b = masks.boxes_and_areas(d, ["image"]).first()
    assert r["counts"] == runs_by_hand(a)
    assert sum(r["counts"]) == a.size
    ys, xs = np.nonzero(a)
    assert b["bbox"] == [xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1]
    assert r["area"] == b["area"] == a.sum()


def test_random_masks_of_many_objects(spark):
    a = np.random.default_rng(0).integers(0, 4, (9, 13))
    got = {r["v"]: r["counts"] for r in masks.mask_runs(pixels(spark, a), ["image"], "height", "width").collect()}
    assert got == {v: runs_by_hand((a == v).astype(int)) for v in (1, 2, 3)}


def test_empty_buffer(spark):
    assert masks.mask_runs(pixels(spark, np.zeros((2, 2), int)), ["image"], "height", "width").count() == 0


def test_dense_ids_over_blocks(spark):
    d = spark.createDataFrame([(s, c) for s in (0, 5, 4096, 9000, 9001) for c in range(3)], "s long, c int").repartition(5)
    got = ids.dense_ids(d, "s", ["c"]).orderBy("s", "c").collect()
    assert [r["id"] for r in got] == list(range(15))


def test_pair_overlap_exempts_stack_and_keeps_strict_tolerance(spark):
    rows = [(0, i, [x, 0.0, 0.0], [x + 1, 1.0, 1.0], s) for i, x, s in ((1, 0.0, True), (2, 0.1, True), (3, 0.5, False), (4, 1.46, False))]
    d = spark.createDataFrame(rows, "s int, i int, lo array<double>, hi array<double>, st boolean")
    got = {(r["i"], r["j"]) for r in overlap.overlapping_pairs(d, ["s"], "i", "lo", "hi", stack="st").collect()}
    assert got == {(1, 3), (2, 3)}


def test_first_passing_attempt(spark):
    d = spark.createDataFrame([(0, 0, True), (0, 1, False), (0, 2, False), (1, 0, True)], "s int, attempt int, has_overlap boolean")
    assert {tuple(r) for r in overlap.first_passing(d, ["s"]).collect()} == {(0, 1), (1, None)}


def test_stack_floor(spark):
    d = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.3), (0, 2, 0.1)], "s int, layer int, h double")
    got = placement.stack_floor(d, ["s"], "layer", "h").orderBy("layer").collect()
    assert [r["z"] for r in got] == pytest.approx([0.1, 0.351, 0.552])


def test_stack_roles_need_two_boxes(spark):
    d = spark.createDataFrame([(0, 0, "box"), (0, 1, None), (1, 0, None), (1, 1, "box"), (1, 2, "box")], "s int, o int, shape string")
    got = {(r["s"], r["o"]): (r["actual_mode"], r["stack_layer"], r["side_rank"]) for r in placement.stack_roles(d, ["s"], "o", F.coalesce(F.col("shape") == "box", F.lit(False)), 1).collect()}
    assert got[0, 0] == ("scatter", None, None)
    assert [got[1, k] for k in range(3)] == [("stacking", None, 0), ("stacking", 0, None), ("stacking", 1, None)]


def test_fov_is_carried_within_a_scene(spark):
    d = spark.createDataFrame([(0, 0, None), (0, 1, 40.0), (0, 2, None), (1, 0, None)], "s int, c int, fov double")
    got = views.carry_fov(d, ["s"], "c", "fov").orderBy("s", "c").collect()
    assert [r["fov"] for r in got] == [None, 40.0, 40.0, None]


def test_camera_forms(spark):
    cams, bounds = cameras.parse(spark, '[{"location": [1, 2, 3], "look_at": [0, 0, 0], "fov_deg": 45}, {"location": [1, 2, 3], "rotation_euler_deg": [0, 0, 0]}]')
    assert bounds is None
    assert [r["cam_idx"] for r in cams.collect()] == [0, 1]
    assert cameras.parse(spark, '{"cameras": [{"location": [1, 2, 3]}]}')[1] == [-0.12, 0.12, -0.12, 0.12]
    with pytest.raises(KeyError):
        cameras.parse(spark, '{"drop_zone": [1, 1]}')
    bad = views.pose(cameras.parse(spark, '[{"location": [1, 2, 3]}]')[0], F.array(*map(F.lit, (0.0, 0.0, 0.0))), F.lit(1.0), 1, F.col("cam_idx"))
    with pytest.raises(Exception, match="look_at or rotation"):
        bad.collect()


@pytest.fixture
def bundle(tmp_path):
    texts = {
        "a/manifest_entry.json": '{"sku": "A", "title": "Tea 50 g", "shape": "box", "z": 1, "b": [1, 2]}',
        "a-b/manifest_entry.json": '{"title": "Jar", "shape": "can_jar", "target_size_m_estimated": null}',
        "_x/manifest_entry.json": "{}",
        ".y/manifest_entry.json": '{"sku": "", "title": "Bag", "shape": "bag", "target_size_m_estimated": 0.4}',
        "d e/manifest_entry.json": '{"sku": "E", "title": "Big", "shape": "box"}',
    }
    for name, t in texts.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(t)
    for name in ("a/1.glb", "a/2.glb", "a-b/x.glb", "_x/u.glb", ".y/v.glb", "d e/w.glb", "none/n.glb"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    return tmp_path


def test_assets_and_sidecars(spark, bundle):
    a = files.assets(spark, str(bundle))
    names = [r["path"].removeprefix(f"{bundle}/") for r in a.orderBy("ordinal").collect()]
    assert names == [".y/v.glb", "_x/u.glb", "a/1.glb", "a/2.glb", "a-b/x.glb", "d e/w.glb", "none/n.glb"]
    r = assets.resolve(assets.with_sidecars(a, manifests.read(spark, str(bundle))))
    got = {x["stem"]: (x["sku"], x["shape"], x["has_sidecar"], x["m_size"]) for x in r.collect()}
    assert got == {
        "v": ("v", "bag", True, 0.4), "u": ("_x", None, True, None), "1": ("A", "box", True, None), "2": ("A", "box", True, None),
        "x": ("x", "can_jar", True, None), "w": ("E", "box", True, None), "n": ("none", None, False, None),
    }
    assert tuple(assets.pool_counts(r).first()) == (7, 6, 3, 6)
    with pytest.raises(FileNotFoundError):
        files.assets(spark, str(bundle / "a" / "nothing"))


def test_sizing_flow(spark, bundle):
    replies = {"Tea 50 g": "~12.34 cm", "Jar": "9", "Bag": "9", "Big": "500"}

    def model(prompt):
        return next(v for k, v in replies.items() if k in prompt)

    out = estimate_sizes(manifests.read(spark, str(bundle)), model).cache()
    assert {r["status"]: r["n"] for r in status_counts(out).collect()} == {"done": 1, "skip": 3, "fail": 1}
    row = sidecars.rewritten(out).first()
    assert list(json.loads(row["value"]).items()) == [("sku", "A"), ("title", "Tea 50 g"), ("shape", "box"), ("z", 1), ("b", [1, 2]), ("target_size_m_estimated", 0.123)]
    assert {r["status"]: r["n"] for r in status_counts(estimate_sizes(manifests.read(spark, str(bundle)), model, redo=True)).collect()} == {"done": 3, "skip": 1, "fail": 1}


def test_malformed_sidecar_raises(spark):
    d = spark.createDataFrame([("/a/manifest_entry.json", "{oops")], "path string, raw string")
    with pytest.raises(Exception, match="not a JSON object"):
        manifests.parse(d).collect()


def test_text_source_tries_again(spark):
    tries = []

    def model(prompt):
        tries.append(prompt)
        if prompt == "bad":
            raise ValueError("no")
        if len(tries) < 3:
            raise RuntimeError("503 busy")
        return " 7 "

    d = spark.createDataFrame([(1, "ok")], "k int, prompt string")
    assert tuple(ask(d, model, ["k"], sleep=lambda s: None).first()) == (1, "7", None)
    assert ask(spark.createDataFrame([(1, "bad")], "k int, prompt string"), model, ["k"]).first()["error"] == "ValueError: no"


@pytest.mark.parametrize("mode", ["scatter", "stacking"])
def test_scene_flow_to_document(spark, mode, tmp_path):
    """Boxes stand in for simulation, filled rectangles for rendering."""
    config = SceneConfig("g", "o", scenes=4, products_per_scene=4, resolution=8, placement=mode, seed=3)
    pool = spark.createDataFrame([(k, f"sku{k % 5}", "box" if k % 2 else None, None) for k in range(9)], "ordinal_key long, sku string, shape string, m_size double")
    written = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  stages meet in tables
    chosen = written(plan.choose(spark, pool, config))
    assert chosen.groupBy("scene_idx").count().where("count < 4").count() == 0
    placed = plan.place(chosen, config, [-0.2, 0.2, -0.2, 0.2])
    placed = written(plan.settle(placed.withColumns({c: F.lit(0.1) for c in ("dx", "dy", "dz")})))
    half = F.lit(0.05)
    sim = placed.withColumns({
        "location": F.array("x", "y", "z"), "lo": F.array(F.col("x") - half, F.col("y") - half, F.col("z") - half), "hi": F.array(F.col("x") + half, F.col("y") + half, F.col("z") + half),
        "matrix": F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)]),
    }).withColumn("corners", F.array("lo", "hi"))
    good = written(plan.accept(sim))
    assert good.select("scene_idx", "attempt").distinct().count() == good.select("scene_idx").distinct().count() == 4
    cats = ids.category_ids(pool, "sku")
    cams, _ = cameras.parse(spark, '[{"location": [1, 0, 1], "look_at": [0, 0, 0], "fov_deg": 40}, {"location": [0, 1, 1], "look_at": [0, 0, 0]}]')

    def render(v):
        o = good.select("scene_idx", "pass_index").join(v.select("scene_idx", "cam_idx"), "scene_idx")
        px = o.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("y")).withColumn("x", F.col("pass_index") - 1)
        both = px.where("not (pass_index = 2 and cam_idx = 1)").withColumn("kind", F.lit("modal")).unionByName(px.withColumn("kind", F.lit("amodal")))
        return both.withColumns({"height": F.lit(8), "width": F.lit(8)})

    images, ann = plan.dataset(good, cams, render, cats, config)
    images, ann = written(images), written(ann)
    n = good.count()
    assert images.count() == 8
    assert ann.count() == 2 * n - 4
    assert sorted(r["id"] for r in ann.collect()) == list(range(2 * n - 4))
    doc = json.loads(annotations.document(images, ann, cats).first()["value"])
    assert [len(doc[k]) for k in ("images", "annotations", "categories")] == [8, 2 * n - 4, 5]
    assert doc["annotations"][0]["metadata"].keys() >= {"shape", "stack_layer", "target_size_m"}
    assert masks.unpacked(doc["annotations"][0]["segmentation"]["counts"]) == [0, 2, 62]
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    back = datasets.read_document(spark, str(path))
    assert [x.count() for x in back] == [8, 2 * n - 4, 5]
    assert annotations.flat(*back).count() == 2 * n - 4


def test_index_buffers(spark):
    a = np.array([[0, 1], [2, 1]], dtype=np.int32)
    d = spark.createDataFrame([(7, bytearray(a.tobytes()))], "image int, content binary")
    got = datasets.index_pixels(d, lambda b: np.frombuffer(b, np.int32).reshape(2, 2), ["image"]).collect()
    assert {(r["x"], r["y"], r["v"]) for r in got} == {(1, 0, 1), (0, 1, 2), (1, 1, 1)}


def test_config():
    c = SceneConfig.from_args(["tool", "--x", "--", "--glbs", "g", "--out", "o", "--products-per-scene", "3"])
    assert (c.glbs, c.products_per_scene, c.resolution) == ("g", 3, 640)
    with pytest.raises(ValueError, match="products"):
        SceneConfig("g", "o", products_per_scene=0)


def test_sized_stream(spark, tmp_path):
    from scenelake.streaming import sized_replies

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"path": "p", "reply": "12 cm"}\n{"path": "q", "reply": "none"}\n')
    q = sized_replies(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("sized").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["path"], r["status"], r["size_m"]) for r in spark.table("sized").collect()} == {("p", "done", 0.12), ("q", "fail", None)}


def test_sidecar_paths_and_sizes(spark, tmp_path):
    """Directories with a plus, a space and a percent sign; a size key inside another object does not count."""
    names = ["a+b", "a b", "100%", "_hidden"]
    for k, n in enumerate(names):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.glb").write_bytes(b"")
        own = ["", ', "target_size_m_estimated": 0.25', ', "target_size_m_estimated": true', ', "target_size_m_estimated": "0.5"'][k]
        (tmp_path / n / manifests.NAME).write_text('{"sku": "s%d", "extra": {"target_size_m_estimated": 0.9}%s}' % (k, own))
    side = manifests.read(spark, str(tmp_path))
    assert sorted(r["dir"].split("/")[-1] for r in side.collect()) == sorted(names)
    both = assets.with_sidecars(files.assets(spark, str(tmp_path)), side)
    got = {r["dir"].split("/")[-1]: (r["m_sku"], r["m_size"], r["path"][-5:]) for r in both.collect()}
    assert got == {"a+b": ("s0", None, "x.glb"), "a b": ("s1", 0.25, "x.glb"), "100%": ("s2", 1.0, "x.glb"), "_hidden": ("s3", None, "x.glb")}
    assert both.select("path").count() == 4
    uri = spark.range(1).select(files.plain_path(F.lit("hdfs://nn:8020/data/a+b%20c/x")).alias("a"), files.plain_path(F.lit("s3a://box/a%25")).alias("b"), files.plain_path(F.lit("file:///r/x")).alias("c")).first()
    assert tuple(uri) == ("hdfs://nn:8020/data/a+b c/x", "s3a://box/a%", "/r/x")


def test_backgrounds_environments_and_images(spark, tmp_path):
    for n in ("b.jpg", "a.jpg", "c.png", "d.jpeg", "e.gif"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "f.jpg").write_bytes(b"f")
    found = files.backgrounds(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["stem"] for r in found] == ["a", "b", "c", "d"]
    assert files.backgrounds(spark, str(tmp_path / "none")).count() == 0
    env = files.environments(spark.range(50).withColumnRenamed("id", "scene"), "/h.hdr", 3, "scene").collect()
    assert {r["hdri_path"] for r in env} == {"/h.hdr"}
    assert all(0.7 <= r["hdri_strength"] <= 1.3 for r in env)
    assert len({r["hdri_strength"] for r in env}) > 40
    images = {r["path"].split("/")[-1]: bytes(r["content"]) for r in datasets.read_images(spark, str(tmp_path)).collect()}
    assert images["a.jpg"] == b"a.jpg"
    assert images["f.jpg"] == b"f"


def test_product_without_category_raises(spark):
    image = spark.createDataFrame([(0, 1)], "id long, scene long")
    seen = spark.createDataFrame([(1, 1, "known", 5), (1, 2, "new", 5), (1, 3, "new", 0)], "scene long, obj int, sku string, area int")
    cats = spark.createDataFrame([(1, "known")], "id int, name string")
    assert annotations.annotations(seen.where("obj <> 2"), image, cats, ["scene"], "obj").count() == 1
    with pytest.raises(Exception, match="product without a category: new"):
        annotations.annotations(seen, image, cats, ["scene"], "obj").collect()


def test_document_leaves_absent_keys_out(spark):
    schema = "id long, amodal_segmentation struct<size:array<int>,counts:string>, metadata struct<shape:string,layer:int>"
    an = spark.createDataFrame([(1, None, None), (0, ([2, 3], "12"), (None, 4))], schema)
    one = spark.createDataFrame([(1, "x")], "id int, name string")
    doc = json.loads(annotations.document(one, an, one.where("false")).first()["value"])
    assert doc == {
        "images": [{"id": 1, "name": "x"}],
        "annotations": [{"id": 0, "amodal_segmentation": {"size": [2, 3], "counts": "12"}, "metadata": {"shape": None, "layer": 4}}, {"id": 1}],
        "categories": [],
    }


def test_scenes_with_overlap_is_as_by_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(int(s), i, *[[float(x) for x in lo], [float(x) for x in lo + 0.5]], bool(i % 3 == 0)) for s in range(60) for i, lo in enumerate(r.uniform(-0.9, 0.9, (4, 3)))]
    d = spark.createDataFrame(rows, "s long, i int, lo array<double>, hi array<double>, st boolean")
    for tolerance in (0.0, 0.05):
        pairs = overlap.overlapping_pairs(d, ["s"], "i", "lo", "hi", tolerance, "st")
        want = overlap.any_overlap(d.select("s").distinct(), pairs, ["s"]).collect()
        got = overlap.scenes_with_overlap(d, ["s"], "i", "lo", "hi", tolerance, "st").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        assert len({x[1] for x in got}) == 2
    first = overlap.first_passing(spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, True)], "s int, attempt int, has_overlap boolean"), ["s"])
    assert tuple(overlap.success_counts(first).first()) == (1, 2)
