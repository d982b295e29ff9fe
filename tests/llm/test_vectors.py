"""Hard negatives, centroid clusters, and byte-level BPE there and back."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import bitslice_negatives as neg
from scenelake.llm import block_norm_kmeans as km
from scenelake.llm import bpe_replay as bpe
from scenelake.llm import queries

P = pytest.importorskip("public_tokenizers")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
EMBED = "vec_id long, embedding array<float>, label int, row long, v int, score string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], EMBED).repartition(parts)


# -- hard negatives ----------------------------------------------------------------------------------------------------


def mined_by_hand(rows):
    took = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        took.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a, (aid, av, al) in enumerate(took):
        if aid is None or aid % 50:
            continue
        scored = [(vid, sum(x * y for x, y in zip(av, v, strict=False)), lab) for k, (vid, v, lab) in enumerate(took) if k != a]
        for pid, ps, _ in sorted([r for r in scored if r[2] == al], key=order)[:5]:
            fit = [r for r in scored if r[2] != al and 50 * ps <= 100 * r[1] <= 95 * ps]
            out += [(aid, pid, k + 1, nid, ps, ns) for k, (nid, ns, _) in enumerate(sorted(fit, key=order)[:3])]
    return sorted(map(repr, out))


def random_rows(seed, n=260, dims=16, spread=0.25):
    r = np.random.default_rng(seed)
    v = r.normal(0, spread, (n, dims)).astype(np.float32)
    return [(k, v[k].tolist(), int(r.integers(0, 4))) for k in range(n)]


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("anchor_id", "positive_id", "rank", F.col("vec_id"), "positive_score", "score").collect())


@pytest.mark.parametrize("seed", range(3))
def test_negatives_as_by_hand(spark, seed):
    rows = random_rows(seed, spread=(0.25, 0.02, 3.0)[seed])
    got = found(neg.mine(table(spark, rows)))
    assert got == mined_by_hand(rows)
    assert len(got) > 20


def test_negatives_of_odd_rows(spark):
    """Ties of copies, ids that are null, vectors of other lengths, empty, null and not finite; every row repeated ids aside."""
    rows = random_rows(5, 160, 6)
    same = rows[3][1]
    rows += [(k, same, k % 3) for k in range(1000, 1150)]
    rows += [(None, same, 1), (None, rows[9][1], None), (2000, None, 1), (2050, [None, 1.0], 1), (2100, [float("nan")] * 6, 1), (2150, [float("inf")], 2), (2200, [], 1), (2250, [0.5, 0.25], 1), (2300, [0.1] * 9, 0), (2350, [0.0] * 6, 2)]
    got = found(neg.mine(table(spark, rows)))
    assert got == mined_by_hand(rows)
    assert any("2250" in x for x in got)
    assert neg.mine(table(spark, rows).where("false")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        neg.mine(table(spark, [(0, [1e9], 1)])).collect()


def test_repeated_anchor_rows_are_each_others_positives(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [0.8, 0.0], 2)]
    got = neg.mine(table(spark, rows)).select("anchor_id", "positive_id", "vec_id", "positive_score", "score").collect()
    assert [tuple(r) for r in got] == [(50, 50, 51, 65536, 52224)] * 2


def test_negatives_do_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(neg, "BLOCK", 2)
    monkeypatch.setattr(neg, "LEAST", 5)
    rows = random_rows(8, 160, 8)
    assert found(neg.mine(table(spark, rows, 5))) == mined_by_hand(rows)


@pytest.mark.parametrize("sparse", [0.0, 0.05, 1.0])
def test_intervals_drop_most_pairs(monkeypatch, sparse):
    """Planes are left out where the interval cannot qualify, and what is returned is exact, in matrices or pair by pair."""
    monkeypatch.setattr(neg, "SPARSE", sparse)
    r = np.random.default_rng(0)
    v = np.floor(256 * r.normal(0, 0.125, (3000, 64))).astype(np.int32)
    a = v[:40]
    exact = a.astype(np.int64) @ v.T.astype(np.int64)
    least = np.sort(exact, axis=1)[:, -10]
    qualifies = lambda x, low, high: high >= (least[:, None] if isinstance(x, slice) else least[x])
    i, j, s, done = neg.scores(a, v, np.ones(exact.shape, bool), qualifies)
    assert (s == exact[i, j]).all()
    assert len(i) == (exact >= least[:, None]).sum()
    assert done < (1.01 if sparse == 0 else 0.9) * exact.size * neg.Planes(v).bits
    whole = neg.scores(a, v, np.ones(exact.shape, bool), lambda x, low, high: high >= low)
    assert (whole[2].reshape(exact.shape) == exact).all()


# -- centroid clusters -------------------------------------------------------------------------------------------------


def clustered_by_hand(rows, k=40, rounds=5, dims=64):
    kept = [(vid, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for vid, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    for step in range(rounds + 1):
        dist = [[sum((x - y) ** 2 for x, y in zip(v, m, strict=True)) for m in c] for _, v in kept]
        own = [min(range(len(c)), key=lambda n, d=d: (d[n], n)) for d in dist]
        if step < rounds:
            for n in set(own):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
                c[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    of = [sum(d[o] for d, o in zip(dist, own, strict=True) if o == n) for n in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(repr((vid, o, d[o], of[o], sum(of), sha[o])) for (vid, _), o, d in zip(kept, own, dist, strict=True))


def clusters(df, **more):
    return sorted(repr(tuple(r)) for r in km.digest(*km.cluster(df, **more)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_as_by_hand(spark):
    r = np.random.default_rng(1)
    rows = [(k, r.normal(0, 0.2, 64).astype(np.float32).tolist(), 1) for k in range(150)]
    assert clusters(table(spark, rows)) == clustered_by_hand(rows)


def test_clusters_of_odd_rows(spark):
    """Copies, ties between centroids, fewer vectors than centroids, null ids, other lengths, nothing at all."""
    r = np.random.default_rng(2)
    one = r.normal(0, 0.2, 64).astype(np.float32).tolist()
    rows = [(k, one, 1) for k in range(60)] + [(None, [0.5] * 64, None), (7, [0.25] * 64, 1), (7, [0.75] * 64, 1), (8, None, 1), (9, [None] * 64, 1), (10, [float("nan")] * 64, 1), (11, [1.0] * 63, 1), (12, [1.0] * 65, 1), (13, [], 1), (14, [float("-inf")] + [1.0] * 63, 1)]
    assert clusters(table(spark, rows)) == clustered_by_hand(rows)
    assert clusters(table(spark, rows[58:])) == clustered_by_hand(rows[58:])
    assert clusters(table(spark, rows[-7:])) == []
    assert clusters(table(spark, rows).where("false")) == []
    assert clusters(table(spark, rows), k=3, rounds=0) == clustered_by_hand(rows, 3, 0)
    with pytest.raises(Exception, match="beyond"):
        clusters(table(spark, [(0, [1e9] * 64, 1)]))


@pytest.mark.parametrize("segments", [1, 4, 16, 64])
def test_screening_is_exact_and_prunes_where_clusters_are_apart(segments):
    r = np.random.default_rng(3)
    centres = np.floor(256 * r.normal(0, 0.3, (40, 64))).astype(np.int64)
    apart = (np.repeat(centres, 50, axis=0) + r.integers(-12, 13, (2000, 64))).astype(np.int32)
    noise = np.floor(256 * r.normal(0, 0.125, (2000, 64))).astype(np.int32)
    ties = np.repeat(centres[:5], 3, axis=0).astype(np.int32)
    for v in (apart, noise, ties, np.zeros((3, 64), np.int32)):
        c = np.concatenate([centres[:20], centres[:20]]) if v is ties else centres
        best, distance, done = km.nearest(v, km.compressed(v, segments), c, km.compressed(c, segments))
        every = ((v[:, None].astype(np.int64) - c) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all()
        assert (distance == every.min(axis=1)).all()
        if v is apart and segments == km.SEGMENTS:
            assert done < 0.1 * every.size


# -- byte-level BPE ----------------------------------------------------------------------------------------------------


def library(ranks, pattern=P.PATTERN):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", " ", "\n\n  x", "a", "don't  we'll\t\r\n", "   \x1c\x85x", "é 漢字 🎉🎉 ١٢٣ ½", "<|endoftext|>", "x" * 3000, "ab" * 4000, " " * 5000, "1234567890" * 99, "\x00\x01", "aaa aaaa aaaaa"]


def test_ids_are_the_librarys(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD * 2)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, MULTI, P.PATTERN), MULTI)
    lib = library(bpe.load(MULTI))
    rows = out.collect()
    assert len(rows) == len(ODD) * 2
    for r in rows:
        t = (ODD * 2)[r["doc_id"]] or ""
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == lib.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == t.encode()
    assert bpe.encode(docs.where("false"), MULTI, P.PATTERN).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    lib = library(bpe.load(MULTI))
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, text = lib.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert {tuple(r) for r in queries.QUERIES["op11_bpe_round_trip"](spark, sf).collect()} == want


@pytest.mark.parametrize("seed", range(60))
def test_replay_of_any_vocabulary(seed):
    """Ranks at random, so that merges make pairs of lower ranks than their own."""
    r = random.Random(seed)
    tokens = set()
    while len(tokens) < 25:
        tokens.add(bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))))
    tokens = r.sample(sorted(tokens), 25)
    ranks = {t: k for k, t in enumerate([bytes([b]) for b in range(256)] + tokens)}
    lib = library(ranks, "[a-c]+")
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 130))) for _ in range(40)]
    ids, count = bpe.replay([w.encode() for w in words], bpe.Vocabulary(ranks))
    ends = np.cumsum(count)
    assert [ids[a:b].tolist() for a, b in zip(ends - count, ends, strict=True)] == [lib.encode_ordinary(w) for w in words]


def test_what_a_task_remembers_is_bounded():
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.load(MULTI)), P.PATTERN, most=20_000)
    lib, r, held = library(bpe.load(MULTI)), random.Random(1), []
    for _ in range(12):
        texts = [" ".join(str(r.random()) for _ in range(20)) for _ in range(5)]
        ids, n = encoder(texts)
        ends = np.cumsum(n)
        assert [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)] == [lib.encode_ordinary(t) for t in texts]
        held.append(encoder.held)
    assert max(held) < 150_000
    assert min(held[1:]) < held[0] * 2


def test_replay_refuses_what_it_cannot_spell():
    with pytest.raises(ValueError, match="no rank"):
        bpe.replay([b"ab"], bpe.Vocabulary({b"a": 0}))
    assert [x.tolist() for x in bpe.replay([], bpe.Vocabulary({b"a": 0}))] == [[], []]
    with pytest.raises(ValueError, match="brackets"):
        bpe.spelled(r"[\S]")
