"""The queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice_negatives, block_norm_kmeans, bpe_count, bpe_replay, decontam_pigeonhole, entropy_mix, html_lstm, pii_boost, quality_ledger, simhash_bktree, suffix_dedup, toxicity_gbt, url_pagerank
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_bktree.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_bktree.as_hex(out.fp).alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.find(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_ledger.with_policy(quality_ledger.ledger(table(spark, sf_dir, "documents")), "v1")
    return book.select("doc_id", *quality_ledger.MEASURES, "base_failed", "kept", "failed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gbt.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entropy_mix.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_pigeonhole.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_pagerank.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe_replay.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = bpe_replay.decode(ids, path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bitslice_negatives.mine(table(spark, sf_dir, "embeddings"))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_norm_kmeans.digest(*block_norm_kmeans.cluster(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_mix_sources": op7_mix_sources,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_extraction": op9_html_extraction,
    "op10_url_filter": op10_url_filter,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroid_clusters": op13_centroid_clusters,
}

_QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
m AS (
  SELECT row_id, doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines
  FROM d),
g AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (
  SELECT row_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
  FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE c >= 2 GROUP BY row_id),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
          + CASE WHEN 100 * coalesce(n_repeat_words, 0) > 50 * n_words THEN 2 ELSE 0 END
          + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
          + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
          + CASE WHEN 2 * n_words > word_chars THEN 16 ELSE 0 END
          + CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END)::INTEGER AS failed
  FROM m LEFT JOIN r USING (row_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""

#: The same mix with the tilt of every source found by bisection.
_MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key,
         floor((('0x' || left(key, 13))::BIGINT)::DOUBLE * 1000000000::DOUBLE / 4503599627370496::DOUBLE)::BIGINT AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS stop,
         1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(stop) OVER pre, 0) AS left_size,
         sum(w) OVER () - coalesce(sum(w) OVER pre, 0) AS w_left
  FROM s
  WINDOW pre AS (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, stop * w_left <= left_size * w AS capped FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN stop ELSE
           (SELECT left_size FROM c WHERE NOT capped ORDER BY w_left DESC LIMIT 1) * w
           / (SELECT w_left FROM c WHERE NOT capped ORDER BY w_left DESC LIMIT 1) END AS target
  FROM c),
z AS (
  SELECT t.source, t.source_size, t.target, t.source_size / greatest(count(*) FILTER (size > 0), 1) AS mean_size,
         list(size) FILTER (size > 0) AS sizes
  FROM t JOIN d ON d.source IS NOT DISTINCT FROM t.source GROUP BY t.source, t.source_size, t.target),
b AS (
  SELECT *, -1e5::DOUBLE AS lo, 1e5::DOUBLE AS hi, 0 AS k FROM z WHERE source_size > 0 AND target < 3 * source_size
  UNION ALL
  SELECT source, source_size, target, mean_size, sizes,
         CASE WHEN list_sum(list_transform(sizes, lambda x: x * least(exp(least((lo + hi) / 2 * (x / mean_size), 3.0::DOUBLE)), 3.0::DOUBLE))) > target
              THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN list_sum(list_transform(sizes, lambda x: x * least(exp(least((lo + hi) / 2 * (x / mean_size), 3.0::DOUBLE)), 3.0::DOUBLE))) > target
              THEN (lo + hi) / 2 ELSE hi END,
         k + 1
  FROM b WHERE k < 90),
r AS (
  SELECT d.row_id, d.doc_id, d.source, d.size, d.u, d.key, z.source_size, z.target,
         coalesce(round(least(exp(least(round((b.lo + b.hi) / 2, 9) * (d.size / z.mean_size), 3.0::DOUBLE)), 3.0::DOUBLE) * 1000000000)::BIGINT, 3000000000) AS units
  FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
  LEFT JOIN b ON b.k = 90 AND d.source IS NOT DISTINCT FROM b.source),
e AS (
  SELECT *, units // 1000000000 AS base, u - units % 1000000000 AS place,
         target - sum((units // 1000000000) * size) OVER (PARTITION BY source) AS rest
  FROM r),
f AS (
  SELECT row_id, rest, size, place,
         sum(size) OVER (PARTITION BY source ORDER BY place, key, doc_id, row_id ROWS UNBOUNDED PRECEDING) - size AS cum,
         sum(size) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) - sum(size) OVER (PARTITION BY source, place) AS begins, source
  FROM e WHERE size > 0 AND base < 3 AND rest > 0),
g AS (
  SELECT row_id, CASE WHEN place < last_place THEN true ELSE place = last_place AND 2 * cum + size <= 2 * rest END AS more
  FROM (SELECT *, max(place) FILTER (begins < rest) OVER (PARTITION BY source) AS last_place FROM f))
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e LEFT JOIN g USING (row_id)
"""

_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
_GIVEN = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEGATIVES_SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS v
  FROM embeddings WHERE label IS NOT NULL AND {_GIVEN}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after the other."""
    squares = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = 64 AND {_GIVEN})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS c, v FROM e QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT e.row_id, e.vec_id, e.v, min({{'d': {squares}, 'c': c.c}}) AS n FROM e, c{r} c GROUP BY 1, 2, 3)")
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT n.c AS c, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),"
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(w.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{r} GROUP BY 1) w USING (c))"
            )
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, n.c::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.n.c"""


ORACLE_SQL = {
    "op12_hard_negatives": _NEGATIVES_SQL,
    "op13_centroid_clusters": _clusters_sql(),
    "op5_quality_rules": _QUALITY_SQL,
    "op7_mix_sources": _MIX_SQL,
}
