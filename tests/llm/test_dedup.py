import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import simhash_bktree as sim
from scenelake.llm import suffix_dedup as suf

SCHEMA = "doc_id long, text string, fp string, `words` int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(texts)], SCHEMA)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


# -- SimHash -----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É b\x0bc d e a b c", "x " * 500])
def test_fingerprint(text):
    assert sim.fingerprint(text) == slow_fingerprint(text)


def brute_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_components_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for g in range(12):
        base = words(r, r.choice([3, 12, 60])).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = words(r, 1)
            texts.append(" ".join(w))
    texts += [None, "", "same text here", "Same TEXT here"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x["component_id"] for x in sim.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_components({i: slow_fingerprint(t) for i, t in rows})


def test_links_in_chunks_keep_every_component(spark):
    """A shard of many chunks: all values share most bits."""
    r = np.random.default_rng(1)
    fps = {int(sum(1 << int(b) for b in r.choice(20, r.integers(0, 6), replace=False))) for _ in range(300)}
    rows = [(k, fp) for k, fp in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    got = {x["node"]: x["component"] for x in sim.components(sim.links(nodes, chunk=16)).collect()}
    want = brute_components(dict(rows))
    assert {k: got.get(k, k) for k in want} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {x["node"]: x["component"] for x in sim.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_dedup_keeps_one_and_its_columns(spark):
    d = docs(spark, [(5, "a b c d"), (3, "A b c d"), (9, "totally different words here now"), (4, None), (6, "")])
    out = sim.dedup(d)
    assert out.columns == d.columns
    assert sorted(x["doc_id"] for x in out.collect()) == [3, 4, 9]
    assert sim.near_duplicates(d.where("doc_id < 0")).count() == 0


def test_dedup_null_and_repeated_ids(spark):
    other, third = "totally different words here now", "yet more words that nothing else holds"
    d = docs(spark, [(None, other), (None, "a b c d"), (3, "A b c d"), (3, "a b c d"), (3, "a b c d"), (3, third), (None, "no id twice over"), (None, "No id twice over")])
    got = sorted(repr((x["doc_id"], x["text"].lower())) for x in sim.dedup(d).collect())
    assert got == sorted(map(repr, [(None, other), (3, "a b c d"), (3, third), (None, "no id twice over")]))


def test_components_of_null_and_repeated_ids(spark):
    """A doc_id that repeats ties its rows' fingerprints; rows without an id link, and name no component."""
    A, B, C, D = "a b c d", "totally different words here now", "yet more words that nothing else holds", "the last text stands alone here too"
    rows = [(5, A), (5, B), (7, A), (8, B), (3, B), (None, C), (9, C), (None, D), (None, D)]
    got = sorted(repr((x["doc_id"], x["component_id"])) for x in sim.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted(map(repr, [(5, 3), (5, 3), (7, 3), (8, 3), (3, 3), (None, 9), (9, 9), (None, None), (None, None)]))


# -- suffix arrays -----------------------------------------------------------------------------------------------------


def brute_cut(rows, length=50):
    own = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for p in range(len(t) - length + 1):
            own[t[p : p + length]] = min(own.get(t[p : p + length], i), i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if own[t[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_suffix_array_and_prefixes(letters):
    r = random.Random(2)
    for n in (1, 7, 64, 65, 400):
        data = "".join(r.choice(letters) for _ in range(n)).encode()
        if n == 400:
            data = data[:100] * 3 + data[300:]
        a = np.frombuffer(data, np.uint8)
        sa, rank = suf.suffix_array(a)
        assert list(sa) == sorted(range(len(data)), key=lambda i: data[i:])
        # all suffixes, and those of two stretches
        for starts, counts in ((np.array([0]), np.array([n])), (np.array([0, n // 2]), np.array([n // 3, n // 4]))):
            some, lcp = suf.common_prefixes(a, sa, starts, counts)
            want = {i for s, c in zip(starts, counts, strict=True) for i in range(s, s + c)}
            assert list(some) == [i for i in sa if i in want]
            for k in range(1, len(some)):
                x, y = data[some[k - 1] :], data[some[k] :]
                m = next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                assert lcp[k] == min(m, 50)


def test_dedup_against_brute_force(spark):
    r = random.Random(5)
    shared = [words(r, 30) for _ in range(5)] + ["é漢" * 40, "z" * 400]
    rows = []
    for i in range(40):
        parts = [words(r, r.randint(0, 30)) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            k = r.randint(0, 20)
            parts.insert(r.randint(0, 3), s[k:])
        rows.append((i * 3 % 41, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 49), (104, rows[0][1]), (105, rows[0][1]), (106, "\0" * 120), (107, "\0" * 60)]
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suf.dedup(docs(spark, rows)).collect())
    assert got == brute_cut(rows)


def test_small_chunks_and_pieces_change_nothing(spark):
    """Strips of long texts, many pieces, anchors cut in two."""
    r = random.Random(6)
    hot = words(r, 12)[:60]
    rows = [(i, words(r, 40) + hot + words(r, 5)) for i in range(30)]
    rows.append((50, " ".join(t for _, t in rows[:10])))
    want = {i: (removed, runs) for i, _, removed, runs, _ in brute_cut(rows)}
    d = docs(spark, rows).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("key"), "text")
    for chunk in (300, 5000):
        found = suf.ranges(d, chunk=chunk).collect()
        for i, t in rows:
            mine = [(x["lo"], x["hi"]) for x in found if x["id"] == i]
            _, removed, runs = suf.cut(t.encode(), np.array([m[0] for m in mine], int), np.array([m[1] for m in mine], int))
            assert (removed, runs) == want[i]


def test_pieces_cut_within_an_anchor():
    r = random.Random(7)
    texts = [words(r, 4)[:10].ljust(10, "x") + "k" * 5 + "The same fifty bytes stand in every context, here it is now" + words(r, 4)[:10].ljust(10, "y") for _ in range(20)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    at = np.cumsum(size) - size
    h, doc = np.full(20, 7, np.uint64), np.arange(20)
    whole = {(r, k) for r, a, b in _flat(suf.repeated(h, doc, at, size, data)) for k in range(a, b + 1)}
    pieces = {(r, k) for r, a, b in _flat(suf.repeated(h, doc, at, size, data, piece=200)) for k in range(a, b + 1)}
    assert whole == pieces
    assert {r for r, _ in whole} == set(range(1, 20))


def _flat(runs):
    return [(int(r), int(a), int(b)) for rows, first, last in runs for r, a, b in zip(rows, first, last, strict=True)]


@pytest.mark.parametrize("length", [16, 49, 130, 200, 300, 900])
def test_lengths_against_brute_force(spark, length):
    """Contexts longer than a byte can count, and a passage as long as the string looked for."""
    r = random.Random(11)
    passage = words(r, 260)[:900]
    rows = [(i, words(r, 8) + (passage if i % 3 else passage[i : i + 350]) + words(r, 20)) for i in range(9)]
    d = docs(spark, rows).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("key"), "text")
    found = suf.ranges(d, length).collect()
    want = {i: (removed, runs) for i, _, removed, runs, _ in brute_cut(rows, length)}
    for i, t in rows:
        mine = [(x["lo"], x["hi"]) for x in found if x["id"] == i]
        assert suf.cut(t.encode(), np.array([m[0] for m in mine], int), np.array([m[1] for m in mine], int))[1:] == want[i]
    assert any(n for n, _ in want.values())


def test_equal_hashes_are_compared_by_bytes():
    data = np.frombuffer(b"aaaabbbbaaaaccccbbbb", np.uint8)
    at, size = np.arange(0, 20, 4), np.full(5, 4)
    new = suf._equal_runs(data, at, size, np.array([True, False, False, False, False]))
    assert list(new) == [True, True, True, True, True] or list(new) == [True, True, False, True, True]
    assert list(suf._equal_runs(data, at[[0, 2]], size[:2], np.array([True, False]))) == [True, False]
    with pytest.raises(ValueError, match="length"):
        suf.ranges(None, 8)


def test_repeated_ids_and_empty_table(spark):
    t = hashlib.sha256(b"x").hexdigest()
    rows = [(1, t), (1, t), (2, "  " + t)]
    got = sorted((x["doc_id"], x["n_removed"]) for x in suf.dedup(docs(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (2, 64)]
    many = [(4, "  " + t)] * 300 + [(1, t), (None, t), (None, "")]
    got = sorted(repr((x["doc_id"], x["n_removed"])) for x in suf.dedup(docs(spark, many)).collect())
    assert got == sorted(map(repr, [(4, 64)] * 300 + [(1, 0), (None, 64), (None, 0)]))
    assert suf.dedup(docs(spark, rows).where("doc_id > 5")).count() == 0
