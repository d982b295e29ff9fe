import random

import numpy as np
import pytest

import corpus_pipeline as p
from scenelake.llm import simhash_wide as wide

from .test_dedup import docs, words


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    up = {i: i for i, _ in rows}
    sets = {i: grams(t) for i, t in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in up:
        for b in up:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def made_up(seed=8):
    """Groups of edited copies, one a long chain whose ends are far apart."""
    r, texts = random.Random(seed), [None, "", "one two", "One two"]
    for _ in range(10):
        base = words(r, r.choice([60, 120, 300])).split()
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 25)):
                w[r.randrange(len(w))] = words(r, 1)
            texts.append(" ".join(w))
    w = words(r, 120).split()
    for k in range(30):
        texts.append(" ".join(w))
        w = w[3:] + words(r, 3).split()
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [2, 256])
def test_components_against_brute_force(spark, chunk):
    rows = made_up()
    d = docs(spark, rows).withColumnRenamed("doc_id", "__row")
    got = {x["__row"]: x["component_id"] for x in wide.near_duplicates(d, chunk=chunk).collect()}
    assert got == brute(rows)


def test_radius_and_cells():
    """Links at the bound lie within the radius; a cell's components are those of all its pairs."""
    assert wide.radius_for(0.8) == 26
    r, cut = random.Random(1), wide.Shingles()
    for _ in range(300):
        a = words(r, 200).split()
        b = list(a)
        for at in r.sample(range(200), 4):
            b[at] = "zz"
        x, y = cut(" ".join(a)), cut(" ".join(b))
        if wide.near(x, y, 0.8):
            assert (wide.fingerprint_of(x) ^ wide.fingerprint_of(y)).bit_count() <= 26
    rows = [(i, t) for i, t in made_up(5) if t]
    want = brute(rows)
    for joined in (set(), {i for i in want if want[i] == want[rows[3][0]]}):
        flags = np.array([i in joined for i, _ in rows])
        root = wide.cell_links([cut(t) for _, t in rows], flags, 0.8)
        assert {(want[i], rows[k][0]) for (i, _), k in zip(rows, root, strict=True)} == {(want[i], want[i]) for i, _ in rows}


def test_live_nodes_are_all_that_may_link():
    """No node with a link in its cell is left out; of unlike texts hardly any is live."""
    cut = wide.Shingles()
    rows = [t for _, t in made_up(6) if t] + [words(random.Random(k), 150) for k in range(60)]
    sets = [cut(t) for t in rows]
    low = [wide.minima(s) for s in sets]
    fps = np.array([wide.fingerprint_of(s) for s in sets], np.uint64)
    sigs = np.array([np.frombuffer(wide.signature(x), np.uint8) for x in low])
    live = wide.live_nodes(fps, sigs, np.ones(len(rows), bool), 0.8)
    for i, a in enumerate(sets):
        if any(j != i and wide.near(a, b, 0.8) for j, b in enumerate(sets)):
            assert live[i]
    assert live[-60:].sum() <= 1
    assert not wide.live_nodes(fps, sigs, np.zeros(len(rows), bool), 0.8).any()
    assert wide.least_agreement(0.8) < 0.61


def test_the_pipelines_stage_takes_similar_texts(spark):
    rows = made_up(9)
    stage = dict(p.STAGES)["near_dedup"]
    got = sorted(x["doc_id"] for x in stage(spark, docs(spark, rows), "").collect())
    assert got == sorted(set(brute(rows).values()))


def test_dedup_null_and_repeated_ids(spark):
    d = docs(spark, [(None, "words that stand alone here"), (None, "a b c d e"), (3, "A b c d e"), (3, "a b c d e"), (3, "another text of the same id")])
    got = sorted(repr((x["doc_id"], x["text"].lower())) for x in wide.dedup(d).collect())
    assert got == sorted(map(repr, [(None, "words that stand alone here"), (3, "a b c d e"), (3, "another text of the same id")]))
    assert wide.dedup(d.where("false")).count() == 0
