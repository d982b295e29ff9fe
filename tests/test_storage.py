"""Trees listed by executors, documents read and written by many tasks, files replaced in place."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scenelake.operators import annotations
from scenelake.scratch import written
from scenelake.sinks import inplace, sidecars
from scenelake.sinks.datasets import write_document
from scenelake.sources import datasets, documents, files
from scenelake.sources.tree import Tree, TreeReader

# -- listings ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """50,000 files, many in one directory, some hidden, some deep, names that sort differently as strings."""
    root = tmp_path_factory.mktemp("tree")
    dirs = ["a", "a-b", "a/sub", "_x", ".y", "big", *(f"d{k % 7}/{k}" for k in range(120)), "deep/" + "/".join("q" * 12)]
    for d in dirs:
        (root / d).mkdir(parents=True, exist_ok=True)
    want = []
    for k in range(50_000):
        d = "big" if k % 3 == 0 else dirs[k % len(dirs)]
        name = f"{k}.glb" if k % 10 else f"{k}.txt"
        open(root / d / name, "w").close()
        if k % 10:
            want.append(f"{root}/{d}/{name}")
    return root, want


def test_listing_of_many_files(spark, tree):
    root, want = tree
    found = files.assets(spark, str(root))
    assert [r["path"] for r in found.orderBy("ordinal").select("path").collect()] == sorted(want, key=lambda p: p.split("/"))
    n, least, most = found.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first()
    assert (n, least, most) == (len(want), 0, len(want) - 1)


def test_driver_sees_directories_only(spark, tree):
    """The partitions name directories, no file, and stop at the number of prefixes asked for."""
    root, want = tree
    parts = TreeReader({"path": str(root), "pattern": "*.glb", "prefixes": "10"}).partitions()
    assert all(os.path.isdir(p.directory) for p in parts)
    assert len(parts) < 60
    assert sum(p.deep for p in parts) >= 10
    spark.dataSource.register(Tree)
    one = spark.read.format("tree").option("pattern", "*.glb").option("prefixes", "1").load(str(root))
    assert one.count() == len(want)
    assert one.rdd.getNumPartitions() == 1


def test_listing_of_nothing(spark, tmp_path):
    assert files.walk(spark, str(tmp_path / "none"), "*").count() == 0
    assert files.walk(spark, str(tmp_path), "*").count() == 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(b"")
    assert files.walk(spark, str(tmp_path), "*.png", recursive=False).count() == 0
    assert [r["path"] for r in files.walk(spark, f"file://{tmp_path}", "*.png").collect()] == [f"{tmp_path}/sub/a.png"]


# -- documents ---------------------------------------------------------------------------------------------------------

ODD = ['plain', 'quote " inside', "back\\slash", "\\\\", '\\"', "}{][", ',"annotations":[', "é漢🎉", "", "\\" * 9, '"' * 5, "line\nbreak"]


def odd_document(seed, n=40):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(ODD) for _ in range(r.randrange(4)))
    image = lambda k: {"id": k, "file_name": text(), "width": 1, "height": 2}
    ann = lambda k: {"id": k, "image_id": r.randrange(n), "category_id": 1, "bbox": [1, 2, 3, 4], "area": k, "segmentation": {"counts": text(), "size": [3, 4]}, "iscrowd": 0}
    doc = {"info": {"version": text(), "images": text(), "deep": {"a": [{"b": 1}]}}, "note": text(), "images": [image(k) for k in range(n)], "none": None, "annotations": [ann(k) for k in range(2 * n)], "flat": [1, "}", [2]], "categories": [{"id": 1, "name": text(), "supercategory": "product"}], "empty": []}
    return doc


@pytest.mark.parametrize(("seed", "range_", "indent"), [(1, 7, None), (2, 64, None), (3, 333, 1), (4, 1 << 20, None), (5, 50, None)])
def test_ranges_give_what_a_whole_parse_gives(spark, tmp_path, seed, range_, indent):
    doc = odd_document(seed, 6 if range_ < 10 else 40)
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=seed % 2 == 0))
    found = documents.elements(spark, str(path), range_).collect()
    for key in ("images", "annotations", "categories"):
        assert [json.loads(r["value"]) for r in sorted(found, key=lambda r: r["at"]) if r["key"] == key] == doc[key]
    kinds = {"images": datasets.IMAGE, "annotations": datasets.ANNOTATION, "categories": datasets.CATEGORY}
    schema = ", ".join(f"{k} array<{t}>" for k, t in kinds.items())
    whole = spark.read.schema(schema).json(str(path), multiLine=True, mode="FAILFAST")
    for key, df in documents.arrays(spark, str(path), kinds, range_).items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, whole.select(F.inline(key)).collect()))


def test_escapes_at_a_range_border():
    """Every cut of a text full of backslashes and quotes reads it as the whole does."""
    import numpy as np

    text = json.dumps([{"a": x} for x in ODD]).encode()
    data = np.frombuffer(text, np.uint8)
    within, depth = documents.lexed(data, False, False)
    for cut in range(1, len(data)):
        head = data[:cut]
        n = len(head) - len(text[:cut].rstrip(b"\\"))
        w, d = documents.lexed(data[cut:], n % 2 == 1, bool(within[cut - 1]))
        assert (w == within[cut:]).all()
        assert (d + depth[cut - 1] == depth[cut:]).all()


def test_broken_documents_raise(spark, tmp_path):
    for k, text in enumerate(['{"images": [{"id": 1}', '{"images": [{"id": "1}]}']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        with pytest.raises(ValueError, match="no complete JSON"):
            documents.elements(spark, str(path))
    path.write_text('{"images": [{"id": oops}]}')
    with pytest.raises(Exception, match="(?i)malformed"):
        datasets.read_document(spark, str(path))[0].collect()
    path.write_text("{}")
    assert datasets.read_document(spark, str(path))[1].count() == 0


def test_large_document_is_many_tasks(spark, tmp_path):
    """As many tasks as ranges, and no more than a range and an object in one of them."""
    path = tmp_path / "doc.json"
    n = 60_000
    with open(path, "w") as f:
        f.write('{"images":[')
        f.write(",".join(f'{{"id":{k},"file_name":"images/{k:09d}.png","width":640,"height":640}}' for k in range(n)))
        f.write("]}")
    found = documents.elements(spark, str(path), 1 << 18)
    assert found.rdd.getNumPartitions() == -(-path.stat().st_size // (1 << 18))
    assert found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).map(lambda c: c < n / 8).reduce(lambda a, b: a and b)
    images = datasets.read_document(spark, str(path))[0]
    assert images.agg(F.count("*"), F.sum("id")).first()[:] == (n, n * (n - 1) // 2)


def test_document_bytes_do_not_depend_on_partitions(spark, tmp_path):
    img = spark.range(500).select("id", F.format_string("images/%04d.png", "id").alias("file_name"))
    an = spark.range(3, 2003).select("id", (F.col("id") % 500).alias("image_id"), F.array("id", "id").alias("bbox"), F.when(F.col("id") % 3 == 0, F.struct(F.lit("box").alias("shape"))).alias("metadata"))
    cats = spark.createDataFrame([], "id int, name string")
    got = []
    for k in (1, 7):
        path = f"{tmp_path}/doc{k}.json"
        write_document(path, img.repartition(k), an.repartition(k + 1, "image_id"), cats)
        got.append(open(path, "rb").read())
        assert not [n for n in os.listdir(tmp_path) if n.startswith(".") or n.endswith(".parts")]
    assert got[0] == got[1]
    doc = json.loads(got[0])
    assert doc == json.loads(annotations.document(img, an, cats).first()["value"])
    assert [a["id"] for a in doc["annotations"]] == list(range(3, 2003))
    write_document(f"{tmp_path}/doc1.json", img.where("false"), an.where("false"), cats)
    assert json.loads(open(f"{tmp_path}/doc1.json").read()) == {"images": [], "annotations": [], "categories": []}


# -- files replaced in place -------------------------------------------------------------------------------------------


@pytest.fixture
def bundle(spark, tmp_path):
    for k in range(40):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "m.json").write_text(json.dumps({"k": k, "é": [k]}))
    texts = spark.createDataFrame([(f"{tmp_path}/{k}/m.json",) for k in range(40)], "path string").repartition(4)
    return tmp_path, files.with_text(texts, "raw").withColumn("size_m", F.lit(0.0345))


def values(root):
    return [json.loads((root / str(k) / "m.json").read_text()).get("target_size_m_estimated") for k in range(40)]


def left_over(root):
    return [n for _, _, names in os.walk(root) for n in names if n != "m.json"]


def test_sidecars_in_place(bundle):
    """The rows to be written are read from the very files they replace."""
    root, d = bundle
    assert sidecars.write_in_place(sidecars.rewritten(d)) == 40
    assert values(root) == [round(0.0345, 3)] * 40
    assert json.loads((root / "7" / "m.json").read_text()) == {"k": 7, "é": [7], "target_size_m_estimated": round(0.0345, 3)}
    assert not left_over(root)


def test_task_that_dies_once(spark, bundle):
    """A task whose process ends in the middle is tried again elsewhere, and the result is whole."""
    root, d = bundle
    flag = f"{root}/../died-{os.path.basename(root)}"

    def dying(path, run, data):
        inplace.stage(path, run, data[: len(data) // 2])  # an attempt's partial work under the staged name
        if path.endswith("/13/m.json") and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        inplace.stage(path, run, data)

    table = written(sidecars.rewritten(d), "test")
    try:
        inplace.replace_files(table, dying)
    except Exception:  # a local master does not try again: the call is made again
        assert values(root) == [None] * 40
        assert not left_over(root)
        inplace.replace_files(table, dying)
    assert os.path.exists(flag)
    assert values(root) == [round(0.0345, 3)] * 40
    assert not left_over(root)


def test_failed_replacement_changes_nothing(bundle):
    root, d = bundle
    before = [(root / str(k) / "m.json").read_bytes() for k in range(40)]

    def failing(path, run, data):
        inplace.stage(path, run, data)
        if path.endswith("/39/m.json"):
            raise RuntimeError("no room")

    with pytest.raises(Exception, match="no room"):
        inplace.replace_files(sidecars.rewritten(d), failing)
    assert [(root / str(k) / "m.json").read_bytes() for k in range(40)] == before
    assert not left_over(root)


def test_commit_can_be_repeated(tmp_path):
    target = str(tmp_path / "a")
    inplace.stage(target, "r", b"new")
    assert [inplace.commit(target, "r") for _ in range(2)] == [1, 0]
    assert open(target, "rb").read() == b"new"
    inplace.stage(target, "s", b"other")
    assert [inplace.abort(target, "s") for _ in range(2)] == [1, 0]
    assert os.listdir(tmp_path) == ["a"]


def test_parts_are_joined_in_order(spark, tmp_path):
    r = random.Random(1)
    parts = []
    for k in range(9):
        (tmp_path / f"p{k}").write_bytes(r.randbytes(r.choice([0, 1, 5_000_000, 77])))
        parts.append(str(tmp_path / f"p{k}"))
    inplace.join_parts(spark, parts, str(tmp_path / "whole"))
    assert (tmp_path / "whole").read_bytes() == b"".join(open(p, "rb").read() for p in parts)
    inplace.join_parts(spark, [], str(tmp_path / "none"))
    assert (tmp_path / "none").read_bytes() == b""
