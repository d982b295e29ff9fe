import corpus_pipeline as p
from scenelake.llm import decontam_pigeonhole as dec
from scenelake.llm.common import table

from .test_rules import base_by_hand, by_hand
from .test_wide import brute

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    d = p.quality_rules(spark, docs, SF).cache()
    assert d.columns == docs.columns

    def good(t):
        n, chars, symbols, dup, rep = by_hand(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return n >= 50 and 100 * rep <= 50 * n and 10 * symbols <= n and 100 * dup <= 50 * len(lines) and chars >= 2 * n and chars <= 30 * n

    kept = {i: t for i, t in rows.items() if good(t)}
    assert {r["doc_id"]: r["text"] for r in d.collect()} == kept
    d = p.near_dedup(spark, d, SF).cache()
    comp = brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    assert {r["doc_id"]: r["text"] for r in d.collect()} == kept
    d = p.decontaminate(spark, d, SF).cache()
    items = [t for t in (dec.normal(r["text"]) for r in table(spark, SF, "benchmark").collect()) if t]
    plain = {i: t for i, t in kept.items() if not any(x in dec.normal(t) for x in items)}
    got = {r["doc_id"]: r["text"] for r in d.collect()}
    assert set(got) <= set(plain)
    assert len(plain) - len(got) <= 1  # matches with edits
    d = p.personal_data(spark, d, SF).cache()
    clean = {r["doc_id"]: r["text"] for r in d.collect()}
    assert set(clean) == set(got)
    assert all(r["n_chars"] == len(r["text"]) for r in d.collect())
    assert all(not base_by_hand(t) for t in clean.values())
    out = p.mix_sources(spark, d, SF)
    assert out.columns[: len(docs.columns)] == docs.columns
    mix = out.collect()
    assert {r["doc_id"]: r["text"] for r in mix} == clean
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in mix)


def test_run_gives_the_last_stage(spark):
    a = sorted(map(repr, p.run(spark, SF).collect()))
    d = table(spark, SF, "documents")
    for _, stage in p.STAGES:
        d = stage(spark, d, SF)
    assert a == sorted(map(repr, d.collect()))
