"""Queries over the driver's tables, one or more for each operator, with the same in SQL.

The tables hold no assets, sidecars or masks; the queries run each operator on columns of a like kind, which shows the
operator and not a vision dataset. Doubles are quantised before they are compared across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, rng, sizing, text
from .operators import annotations as ann
from .operators import assets, digests, ids, masks, overlap, placement, sampling, views
from .operators import sizing as sized
from .scratch import written
from .sources import cameras

SEED = 7
CAMERAS = (
    '{"drop_zone": [0.2, 0.1], "cameras": [{"location": [1.5, 0, 1.25], "look_at": [0, 0, 0], "fov_deg": 40}, '
    '{"location": [-1.5, 1.25, 1.25], "look_at": [0, 0, 0.1]}, {"location": [0, 1.25, 1.25], "rotation_euler_deg": [45, 0, 90]}, '
    '{"location": [0, -1.25, 1.5], "look_at": [0, 0, 0], "fov_deg": 55.5}]}'
)
#: Part types stand for shapes; ECONOMY is the one that stacks.
TYPE_RANGES = {"ECONOMY": (0.10, 0.35), "LARGE": (0.12, 0.30), "SMALL": (0.06, 0.20), "PROMO": (0.08, 0.25)}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _u(*keys) -> str:
    """SQL of rng.draw: strings in quotes are labels, others columns."""
    return f"(('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(map(str, keys))})), 1, 13))::BIGINT / 4503599627370496e0)"


def _q(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


def _floyd(n: str, k: str, most: int, *keys) -> str:
    """SQL list of rng.sample_indices: a list grown step by step."""
    out = "[]::BIGINT[]"
    for i in range(most):
        u = _u(*keys, "'pick'", f"'{i}'")
        j = f"({n} - {k} + {i})"
        t = f"floor(({j} + 1) * {u})::BIGINT"
        again = f"floor({n} * {u})::BIGINT"
        step = f"CASE WHEN {i} >= {k} OR {n} = 0 THEN c WHEN {n} >= {k} THEN list_append(c, CASE WHEN list_contains(c, {t}) THEN {j} ELSE {t} END) ELSE list_append(c, {again}) END"
        out = f"list_transform([{out}], lambda c: {step})[1]"
    return out


# -- samples -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT p_brand, p_partkey, rn FROM (
  SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws('|', '{SEED}', p_partkey)), p_partkey)::INTEGER AS rn
  FROM part) WHERE rn <= 3""")
def seeded_sample_k(spark, d):
    return sampling.top_k_by_hash(_t(spark, d, "part"), ["p_brand"], "p_partkey", 3, SEED).select("p_brand", "p_partkey", "rn")


@query(f"""WITH s AS (SELECT n_nationkey, unnest(range(8)) AS slot FROM nation), r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS ord FROM region)
SELECT n_nationkey, slot::INTEGER AS slot, r_name FROM s JOIN r ON r.ord = floor((SELECT count(*) FROM region) * {_u("n_nationkey", "'product'", "'pick'", "slot")})""")
def sample_with_replacement(spark, d):
    s = sampling.sample_products(_t(spark, d, "nation").select("n_nationkey"), "n_nationkey", _t(spark, d, "region"), "r_regionkey", 8, 8, SEED)
    return s.select("n_nationkey", "slot", "r_name")


@query(f"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part), k AS (SELECT count(*) AS n FROM part),
s AS (SELECT n_nationkey, {_floyd("n", "6", 6, "n_nationkey", "'product'")} AS c FROM nation, k),
x AS (SELECT n_nationkey, unnest(c) AS ord, unnest(range(len(c))) AS slot FROM s)
SELECT n_nationkey, slot::INTEGER AS slot, p_partkey FROM x JOIN p USING (ord)""")
def sample_without_replacement(spark, d):
    s = sampling.sample_products(_t(spark, d, "nation").select("n_nationkey"), "n_nationkey", _t(spark, d, "part"), "p_partkey", 6, 6, SEED)
    return s.select("n_nationkey", "slot", "p_partkey")


@query(f"""WITH b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part WHERE p_type = 'ECONOMY'),
o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part WHERE p_type <> 'ECONOMY'),
w AS (SELECT n_nationkey, nb, no, least(nb, 2 + floor({_u("n_nationkey", "'n_box'")} * 2)::BIGINT) AS kb FROM nation, (SELECT count(*) AS nb FROM b), (SELECT count(*) AS no FROM o)),
w2 AS (SELECT *, least(greatest(0, 5 - kb), no) AS ko FROM w),
xb AS (SELECT n_nationkey, unnest(c) AS ord, unnest(range(len(c))) AS slot FROM (SELECT n_nationkey, {_floyd("nb", "kb", 3, "n_nationkey", "'box'")} AS c FROM w2)),
xo AS (SELECT n_nationkey, kb, unnest(c) AS ord, unnest(range(len(c))) AS slot FROM (SELECT n_nationkey, kb, {_floyd("no", "ko", 5, "n_nationkey", "'other'")} AS c FROM w2))
SELECT n_nationkey, slot::BIGINT AS slot, p_partkey, TRUE AS stackable FROM xb JOIN b USING (ord)
UNION ALL SELECT n_nationkey, (slot + kb)::BIGINT, p_partkey, FALSE FROM xo JOIN o USING (ord)""")
def stratified_stack_sample(spark, d):
    s = sampling.sample_stacking(_t(spark, d, "nation").select("n_nationkey"), "n_nationkey", _t(spark, d, "part"), "p_partkey", F.col("p_type") == "ECONOMY", 5, SEED)
    return s.select("n_nationkey", F.col("slot").cast("long").alias("slot"), "p_partkey", "stackable")


@query(f"""WITH f AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS at FROM region)
SELECT n_nationkey, r_name FROM nation LEFT JOIN f ON f.at = floor((SELECT count(*) FROM region) * {_u("n_nationkey", "'r_name'")}) + 1""")
def pick_background(spark, d):
    return sampling.pick_one(_t(spark, d, "nation").select("n_nationkey"), "n_nationkey", _t(spark, d, "region").select("r_name"), ["r_name"], SEED, "r_name")


@query("""SELECT o_orderkey, printf('images/%04d_%02d.png', o_orderkey, 3) AS file_name
FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40) WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def first_n_then_exists(spark, d):
    o = _t(spark, d, "orders").withColumn("file_name", text.image_name(F.col("o_orderkey"), F.lit(3)))
    out = sampling.first_then_existing(o.select("o_orderkey", "file_name"), 40, o.where("o_orderstatus <> 'P'"), "file_name", "o_orderkey")
    return out.select("o_orderkey", "file_name")


# -- sizes -------------------------------------------------------------------------------------------------------------

_LO = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v[0]}e0" for k, v in TYPE_RANGES.items()) + " ELSE 0.08e0 END"
_HI = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v[1]}e0" for k, v in TYPE_RANGES.items()) + " ELSE 0.35e0 END"


@query(f"""SELECT p_partkey, {_LO} AS lo, {_HI} AS hi, {_q(f"{_LO} + ({_HI} - {_LO}) * {_u('p_partkey', chr(39) + 'size' + chr(39))}")} AS size FROM part""")
def shape_size_range(spark, d):
    lo, hi = sizing.size_range(F.col("p_type"), TYPE_RANGES)
    size = sizing.random_size(F.col("p_type"), rng.draw(SEED, F.col("p_partkey"), "size"), TYPE_RANGES)
    return _t(spark, d, "part").select("p_partkey", lo.alias("lo"), hi.alias("hi"), geometry.quantise(size).alias("size"))


@query(f"""SELECT p_partkey, {_q(f'''CASE WHEN p_size / 25e0 BETWEEN 0.03e0 AND 1.5e0 THEN p_size / 25e0 * (0.95e0 + (1.05e0 - 0.95e0) * {_u("p_partkey", "'jitter'")})
 ELSE {_LO} + ({_HI} - {_LO}) * {_u("p_partkey", "'size'")} END''')} AS size FROM part""")
def size_or_fallback(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_type").alias("shape"), (F.col("p_size") / 25).alias("m_size"))
    k = F.col("p_partkey")
    size = sizing.product_size(F.col("m_size"), F.col("shape"), rng.draw(SEED, k, "jitter"), rng.draw(SEED, k, "size"), TYPE_RANGES)
    return p.select("p_partkey", geometry.quantise(size).alias("size"))


_TRIM = r"regexp_replace(t, '^\s+|\s+$', '', 'g')"
_TOKEN = rf"regexp_replace(regexp_replace(string_split_regex({_TRIM}, '\s+')[1], '[.,;:]+$', ''), '^[~≈]+', '')"
_CM = rf"""CASE WHEN {_TRIM} = '' THEN NULL ELSE coalesce(
  CASE WHEN regexp_full_match({_TOKEN}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({_TOKEN} AS DOUBLE) END,
  try_cast(nullif(regexp_extract(t, '([0-9]+\.?[0-9]*)', 1), '') AS DOUBLE)) END"""


@query(f"""SELECT doc_id, {_CM} AS cm FROM (SELECT doc_id, text AS t FROM documents)""")
def parse_first_number(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.parse_cm(F.col("text")).alias("cm"))


@query(f"""SELECT o_orderkey, {_CM} AS cm FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '~' || o_totalprice::DECIMAL(12,2)::VARCHAR || ' cm'
 WHEN 1 THEN 'about -' || o_custkey::VARCHAR WHEN 2 THEN o_custkey::VARCHAR || 'cm' WHEN 3 THEN '  ' || o_custkey::VARCHAR || '.;' WHEN 4 THEN 'none' ELSE '-' || o_custkey::VARCHAR END AS t FROM orders)""")
def parse_replies(spark, d):
    k, price = F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    m = F.col("o_orderkey") % 6
    reply = F.when(m == 0, F.concat(F.lit("~"), price, F.lit(" cm"))).when(m == 1, F.concat(F.lit("about -"), k)).when(m == 2, F.concat(k, F.lit("cm"))).when(
        m == 3, F.concat(F.lit("  "), k, F.lit(".;"))).when(m == 4, "none").otherwise(F.concat(F.lit("-"), k))
    return _t(spark, d, "orders").select("o_orderkey", text.parse_cm(reply).alias("cm"))


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN lang = 'de' THEN 'skip' WHEN cm IS NULL THEN 'fail' WHEN NOT (cm / 100 BETWEEN 0.03e0 AND 1.2e0) THEN 'fail' ELSE 'done' END AS status
 FROM (SELECT lang, {_CM} AS cm FROM (SELECT lang, text AS t FROM documents))) GROUP BY 1""")
def size_status_counts(spark, d):
    docs = _t(spark, d, "documents")
    return sized.status_counts(sized.size_status(docs, F.col("text"), F.col("lang") != "de"))


@query("""SELECT o_orderkey, printf('%.3f', o_custkey / 100e0)::DOUBLE AS size_m FROM orders WHERE o_custkey / 100e0 BETWEEN 0.03e0 AND 1.2e0""")
def rounded_sizes(spark, d):
    o = sized.size_status(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("reply")), F.col("reply"))
    return o.where("status = 'done'").select("o_orderkey", "size_m")


@query("""SELECT l_orderkey, l_linenumber, printf('%.3f', x)::DOUBLE AS three, printf('%.3f', -x / 7)::DOUBLE + 0e0 AS below
 FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 8 + l_linenumber) / 2e3 + l_extendedprice * 1e-9 * (l_linenumber % 2) AS x FROM lineitem)""")
def places_as_printed(spark, d):
    """Rounding to three places: exact ties in binary, decimal near-ties and others."""
    li = _t(spark, d, "lineitem")
    x = (F.col("l_partkey") * 8 + F.col("l_linenumber")) / 2e3 + F.col("l_extendedprice") * 1e-9 * (F.col("l_linenumber") % 2)
    return li.select("l_orderkey", "l_linenumber", sizing.python_round3(x).alias("three"), (sizing.python_round3(-x / 7) + 0.0).alias("below"))


_SKIPS = """SELECT s_suppkey, title IS NOT NULL AND shape <> '' AND NOT has_key AS first_time, title IS NOT NULL AND shape <> '' AS again FROM
 (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS title, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE 'box' END AS shape, s_suppkey % 4 IN (0, 1) AS has_key FROM supplier)"""


@query(_SKIPS)
def sizes_wanted(spark, d):
    """Which sidecars are asked about: a title, a shape, and no size key yet (a null one counts) unless all are done again."""
    from .sources import manifests

    k = F.col("s_suppkey")
    title = F.when(k % 5 != 0, F.concat(F.lit('"title": "'), F.col("s_name"), F.lit('", '))).otherwise("")
    size = F.when(k % 4 == 0, ', "target_size_m_estimated": null').when(k % 4 == 1, ', "target_size_m_estimated": 0.2').otherwise(', "more": {"target_size_m_estimated": 1}')
    raw = F.concat(F.lit("{"), title, F.lit('"shape": "'), F.when(k % 3 == 0, "").otherwise("box"), F.lit('"'), size, F.lit("}"))
    side = manifests.parse(_t(spark, d, "supplier").select(k, F.concat(F.lit("/r/"), k, F.lit("/m.json")).alias("path"), raw.alias("raw")))
    side = side.select(F.regexp_extract("dir", "([0-9]+)$", 1).cast("long").alias("s_suppkey"), F.col("m_shape").alias("shape"), "title", "raw")
    return side.select("s_suppkey", sized.wants_size(side).alias("first_time"), sized.wants_size(side, redo=True).alias("again"))


@query("""SELECT page_id, regexp_matches(lower(html), '503|429|unavailable|exhausted') AS transient, (5 * 2 ** (page_id % 3))::BIGINT AS wait FROM pages""")
def transient_error_class(spark, d):
    return _t(spark, d, "pages").select("page_id", text.is_transient(F.col("html")).alias("transient"), text.backoff_seconds(F.col("page_id") % 3).alias("wait"))


@query("""SELECT s_suppkey, 'Product title: "' || s_name || '"' || chr(10) || 'Shape category: box' || chr(10) || chr(10) ||
 'How long is the longest side of this retail product in centimetres? Use amounts in the title to scale. Answer with one number only.' AS prompt, substr(s_name, 1, 50) AS short FROM supplier""")
def prompt_text(spark, d):
    s = _t(spark, d, "supplier")
    return s.select("s_suppkey", text.size_prompt(F.col("s_name"), F.lit("box")).alias("prompt"), text.log_title(F.col("s_name")).alias("short"))


# -- assets ------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT p_partkey, 'd' || (p_partkey // 16)::VARCHAR AS dir, 'p' || p_partkey::VARCHAR AS stem FROM part),
m AS (SELECT 'd' || s_suppkey::VARCHAR AS dir, s_suppkey FROM supplier)
SELECT p_partkey, CASE WHEN s_suppkey IS NULL OR s_suppkey % 4 = 0 THEN a.dir WHEN s_suppkey % 4 = 1 THEN 'sku' || s_suppkey::VARCHAR ELSE stem END AS sku,
 CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'box' END AS shape, s_suppkey IS NOT NULL AS has_sidecar FROM a LEFT JOIN m USING (dir)""")
def sidecar_resolution(spark, d):
    a = _asset_rows(spark, d)
    return a.select("p_partkey", "sku", "shape", "has_sidecar")


def _asset_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as assets, suppliers as sidecars: empty objects, complete ones, ones without sku, ones without shape."""
    from .sources import manifests

    part = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("/r/d"), F.expr("p_partkey div 16"), F.lit("/p"), F.col("p_partkey"), F.lit(".glb")).alias("path"))
    part = part.select("p_partkey", text.parent_path(F.col("path")).alias("dir"), text.file_stem(F.col("path")).alias("stem"))
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, "{}").when(k % 4 == 1, F.format_string('{"sku": "sku%d", "shape": "box", "target_size_m_estimated": 0.25}', k)).when(
        k % 4 == 2, '{"sku": "", "shape": "box"}').otherwise('{"title": "t"}')
    side = manifests.parse(_t(spark, d, "supplier").select(F.concat(F.lit("/r/d"), k, F.lit("/manifest_entry.json")).alias("path"), raw.alias("raw")))
    return assets.resolve(assets.with_sidecars(part, side))


@query("""WITH a AS (SELECT p_partkey, 'd' || (p_partkey // 16)::VARCHAR AS dir, 'p' || p_partkey::VARCHAR AS stem FROM part),
m AS (SELECT 'd' || s_suppkey::VARCHAR AS dir, s_suppkey FROM supplier),
r AS (SELECT CASE WHEN s_suppkey IS NULL OR s_suppkey % 4 = 0 THEN a.dir WHEN s_suppkey % 4 = 1 THEN 'sku' || s_suppkey::VARCHAR ELSE stem END AS sku,
 CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'box' END AS shape, s_suppkey FROM a LEFT JOIN m USING (dir))
SELECT count(*) AS n_assets, count(s_suppkey) AS n_sidecars, count(*) FILTER (shape = 'box') AS n_stackable, count(DISTINCT sku) AS n_products FROM r""")
def pool_counts(spark, d):
    return assets.pool_counts(_asset_rows(spark, d))


@query("""SELECT url, row_number() OVER (ORDER BY string_split(url, '/'), page_id)::INTEGER AS rn, page_id FROM pages""")
def path_component_order(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy(text.component_order(F.col("url")), "page_id")
    return _t(spark, d, "pages").select("url", F.row_number().over(w).alias("rn"), "page_id")


@query("""SELECT row_number() OVER (ORDER BY p_brand)::INTEGER AS id, p_brand AS name, 'product' AS supercategory FROM (SELECT DISTINCT p_brand FROM part)""")
def category_ids(spark, d):
    return ids.category_ids(_t(spark, d, "part"), "p_brand")


@query("""SELECT d.doc_id, coalesce(nullif(CASE WHEN l.quality = 1 THEN d.source ELSE '' END, ''), d.lang) AS name, coalesce(l.toxic, -1)::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_default(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    name = F.coalesce(text.truthy(F.when(F.col("quality") == 1, F.col("source")).otherwise("")), F.col("lang"))
    return j.select("doc_id", name.alias("name"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


# -- placement ---------------------------------------------------------------------------------------------------------

#: All parts in scenes of six: the scene's name takes the brand's column.
_TOP = "(SELECT (p_partkey // 6)::VARCHAR AS p_brand, p_partkey, p_size, p_retailprice, p_type, p_partkey % 6 AS o FROM part)"


def _top(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").withColumns({"p_brand": F.expr("cast(p_partkey div 6 as string)"), "o": F.col("p_partkey") % 6})


def _xyz(df: DataFrame, *more: str) -> DataFrame:
    return df.select("p_brand", "o", *[geometry.quantise(F.col(c)).alias(c) for c in ("x", "y", "z", "yaw")], *more)


def _between(lo: str, hi: str, *keys) -> str:
    return f"({lo} + ({hi} - ({lo})) * {_u(*keys)})"


@query(f"""SELECT p_brand, o::INTEGER AS o, {_q(_between("-1.2e0", "1.2e0", "p_brand", "o", "'x'"))} AS x, {_q(_between("-0.6e0", "0.6e0", "p_brand", "o", "'y'"))} AS y,
 {_q("0.25e0 + o * 0.15e0")} AS z, {_q(_between("0e0", "2 * pi()", "p_brand", "o", "'yaw'"))} AS yaw FROM {_TOP}""")
def scatter_placement(spark, d):
    _, bounds = cameras.parse(spark, CAMERAS)
    zone = sizing.zone(F.array(*map(F.lit, bounds)), F.lit("scatter"))
    return _xyz(placement.scatter(_top(spark, d), [F.col("p_brand")], "o", zone, SEED))


@query(f"""SELECT p_brand, o::INTEGER AS o, {_q(f'CASE WHEN o < 3 THEN {_between("-0.12e0", "0.12e0", "p_brand", "o", "'x'")} ELSE {_between("0.3e0", "0.5e0", "p_brand", "o", "'r'")} * cos({_between("0e0", "2 * pi()", "p_brand", "o", "'angle'")}) END')} AS x,
 {_q(f'CASE WHEN o < 3 THEN {_between("-0.12e0", "0.12e0", "p_brand", "o", "'y'")} ELSE {_between("0.3e0", "0.5e0", "p_brand", "o", "'r'")} * sin({_between("0e0", "2 * pi()", "p_brand", "o", "'angle'")}) END')} AS y,
 {_q("0.25e0 + o * 0.12e0")} AS z, {_q(_between("0e0", "2 * pi()", "p_brand", "o", "'yaw'"))} AS yaw FROM {_TOP}""")
def close_far_placement(spark, d):
    return _xyz(placement.close_far(_top(spark, d), [F.col("p_brand")], "o", sizing.zone(None, F.lit("close_far")), 3, SEED))


_ROLES = f"""(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_type <> 'ECONOMY')::INTEGER, o) - 1 AS rank,
 least(nb, 2 + floor({_u("p_brand", "'n_stack'")} * 2)::BIGINT) AS ns FROM (SELECT *, sum((p_type = 'ECONOMY')::INTEGER) OVER (PARTITION BY p_brand) AS nb, count(*) OVER (PARTITION BY p_brand) AS n FROM {_TOP}))"""


@query(f"""SELECT p_brand, p_partkey, CASE WHEN nb >= 2 THEN 'stacking' ELSE 'scatter' END AS actual_mode, CASE WHEN nb >= 2 AND rank < ns THEN rank ELSE -1 END::INTEGER AS stack_layer,
 CASE WHEN nb >= 2 AND rank >= ns THEN rank - ns ELSE -1 END::BIGINT AS side_rank FROM {_ROLES}""")
def stack_roles(spark, d):
    r = placement.stack_roles(_top(spark, d), ["p_brand"], "o", F.col("p_type") == "ECONOMY", SEED)
    return r.select("p_brand", "p_partkey", "actual_mode", F.coalesce("stack_layer", F.lit(-1)).alias("stack_layer"), F.coalesce(F.col("side_rank").cast("long"), F.lit(-1)).alias("side_rank"))


_ANGLE = f"""({_between("0e0", "2 * pi()", "p_brand", "'offset'")} + o * (2 * pi() / greatest(n, 1)) + (-0.25e0 * (2 * pi() / greatest(n, 1)) + (0.25e0 * (2 * pi() / greatest(n, 1)) - (-0.25e0 * (2 * pi() / greatest(n, 1)))) * {_u("p_brand", "o", "'jitter'")}))"""


@query(f"""SELECT p_brand, o::INTEGER AS o, {_q(_between("0.25e0", "0.45e0", "p_brand", "o", "'r'") + f" * cos({_ANGLE})")} AS x, {_q(_between("0.25e0", "0.45e0", "p_brand", "o", "'r'") + f" * sin({_ANGLE})")} AS y,
 {_q("0.3e0 + o * 0.2e0")} AS z, {_q(_between("0e0", "2 * pi()", "p_brand", "o", "'yaw'"))} AS yaw, {_q(_ANGLE)} AS angle FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM {_TOP})""")
def ring_angles(spark, d):
    from pyspark.sql import Window

    t = _top(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("p_brand")))
    s = placement.stack_sides(t, [F.col("p_brand")], "o", "n", SEED)
    return _xyz(s.withColumn("angle", geometry.quantise(F.col("angle"))), "angle")


@query(f"""SELECT p_brand, o::INTEGER AS o, {_q("f")} AS z_floor, {_q("f + h / 2")} AS z FROM (SELECT *, coalesce(sum(h + 0.001e0) OVER (PARTITION BY p_brand ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS f
 FROM (SELECT *, p_size / 100e0 AS h FROM {_TOP}))""")
def stack_floor(spark, d):
    t = placement.stack_floor(_top(spark, d).withColumn("h", F.col("p_size") / 100), ["p_brand"], "o", "h")
    return t.select("p_brand", "o", geometry.quantise(F.col("z_floor")).alias("z_floor"), geometry.quantise(F.col("z")).alias("z"))


@query(f"""SELECT p_brand, o::INTEGER AS o, CASE WHEN a = 'y' THEN floor(radians(90) * 1e6 + 0.5e0) / 1e6 ELSE 0e0 END AS rx, CASE WHEN a = 'x' THEN floor(radians(90) * 1e6 + 0.5e0) / 1e6 ELSE 0e0 END AS ry,
 {_q(_between("-radians(8)", "radians(8)", "p_brand", "o", "'box'", "'yaw'"))} AS rz,
 {_q(_between("-0.12e0 * 0.4e0", "0.12e0 * 0.4e0", "p_brand", "'base'", "'x'") + " + " + _between("-0.01e0", "0.01e0", "p_brand", "o", "'box'", "'jx'"))} AS x
 FROM (SELECT *, CASE WHEN dx >= dy AND dx >= dz THEN 'x' WHEN dy >= dz THEN 'y' ELSE 'z' END AS a FROM (SELECT *, p_size / 100e0 AS dx, p_retailprice / 5000e0 AS dy, 0.2e0 AS dz FROM {_TOP}))""")
def stacked_boxes(spark, d):
    t = _top(spark, d).withColumns({"dx": F.col("p_size") / 100, "dy": F.col("p_retailprice") / 5000, "dz": F.lit(0.2)})
    b = placement.stack_boxes(t, [F.col("p_brand")], "o", sizing.zone(None, F.lit("stacking")), SEED)
    q = lambda c: geometry.quantise(c)
    return b.select("p_brand", "o", q(F.col("rotation")[0]).alias("rx"), q(F.col("rotation")[1]).alias("ry"), q(F.col("rotation")[2]).alias("rz"), q(F.col("x")).alias("x"))


@query(f"""SELECT p_partkey, CASE WHEN dx >= dy AND dx >= dz THEN 'x' WHEN dy >= dz THEN 'y' ELSE 'z' END AS axis, {_q("CASE WHEN greatest(dx, dy, dz) > 0 THEN 0.3e0 / greatest(dx, dy, dz) ELSE 1 END")} AS scale
 FROM (SELECT p_partkey, (p_size % 5)::DOUBLE AS dx, (p_partkey % 5)::DOUBLE AS dy, (length(p_name) % 5)::DOUBLE AS dz FROM part)""")
def longest_axis(spark, d):
    dims = [(F.col("p_size") % 5).cast("double"), (F.col("p_partkey") % 5).cast("double"), (F.length("p_name") % 5).cast("double")]
    return _t(spark, d, "part").select("p_partkey", geometry.longest_axis(*dims).alias("axis"), geometry.quantise(geometry.rescale(*dims, F.lit(0.3))).alias("scale"))


# -- overlap -----------------------------------------------------------------------------------------------------------

_BOX = """(SELECT l_orderkey AS s, l_linenumber AS i, max(l_quantity) / 50 AS x, max(l_discount) * 10 AS y, max(l_tax) * 10 AS z FROM lineitem GROUP BY 1, 2)"""
_VOL = """greatest(0e0, least(a.x + 0.5e0, b.x + 0.5e0) - greatest(a.x, b.x)) * greatest(0e0, least(a.y + 0.5e0, b.y + 0.5e0) - greatest(a.y, b.y)) * greatest(0e0, least(a.z + 0.5e0, b.z + 0.5e0) - greatest(a.z, b.z))"""
_PAIRS = f"(SELECT a.s, a.i, b.i AS j, {_VOL} AS volume FROM {_BOX} a JOIN {_BOX} b ON a.s = b.s AND a.i < b.i WHERE NOT (a.i <= 2 AND b.i <= 2) AND {_VOL} > 0.05e0)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    g = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("i")).agg(
        (F.max("l_quantity") / 50).alias("x"), (F.max("l_discount") * 10).alias("y"), (F.max("l_tax") * 10).alias("z"))
    return g.select("s", "i", F.array("x", "y", "z").alias("lo"), F.array(F.col("x") + 0.5, F.col("y") + 0.5, F.col("z") + 0.5).alias("hi"), (F.col("i") <= 2).alias("stack"))


@query(f"""SELECT s, i, j, {_q("volume")} AS volume FROM {_PAIRS}""")
def pair_overlap(spark, d):
    p = overlap.overlapping_pairs(_boxes(spark, d), ["s"], "i", "lo", "hi", stack="stack")
    return p.select("s", "i", "j", geometry.quantise(F.col("volume")).alias("volume"))


@query(f"""SELECT s, i, j FROM {_PAIRS} p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = p.s AND l.l_linenumber = p.i AND l.l_linenumber + 1 = p.j)""")
def pairs_not_ignored(spark, d):
    p = overlap.overlapping_pairs(_boxes(spark, d), ["s"], "i", "lo", "hi", stack="stack")
    listed = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_linenumber") + 1).alias("i"), F.col("l_linenumber").alias("j"))
    return overlap.without_pairs(p, listed, ["s"]).select("s", "i", "j")


@query(f"""SELECT o_orderkey AS s, o_orderkey IN (SELECT s FROM {_PAIRS}) AS has_overlap FROM orders""")
def scene_has_overlap(spark, d):
    p = overlap.overlapping_pairs(_boxes(spark, d), ["s"], "i", "lo", "hi", stack="stack")
    return overlap.any_overlap(_t(spark, d, "orders").select(F.col("o_orderkey").alias("s")), p, ["s"])


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS i FROM lineitem) SELECT a.s, a.i, b.i AS hidden FROM b a JOIN b ON a.s = b.s AND a.i <> b.i""")
def others_hidden(spark, d):
    return overlap.others_hidden(_boxes(spark, d), ["s"], "i")


_TRY = f"""(SELECT s, i, attempt, {_between("-0.6e0", "0.6e0", "s", "attempt", "i", "'x'")} AS x, {_between("-0.6e0", "0.6e0", "s", "attempt", "i", "'y'")} AS y FROM (SELECT DISTINCT l_orderkey AS s, l_linenumber AS i FROM lineitem), (VALUES (0), (1), (2)) t(attempt))"""
_HIT = f"""(SELECT DISTINCT a.s, a.attempt FROM {_TRY} a JOIN {_TRY} b ON a.s = b.s AND a.attempt = b.attempt AND a.i < b.i
 WHERE greatest(0e0, least(a.x + 0.5e0, b.x + 0.5e0) - greatest(a.x, b.x)) * greatest(0e0, least(a.y + 0.5e0, b.y + 0.5e0) - greatest(a.y, b.y)) * greatest(0e0, least(0.5e0, 0.5e0) - greatest(0e0, 0e0)) > 0.05e0)"""


def _retried(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as objects, placed in up to three attempts: (s, attempt)."""
    o = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("i")).distinct()

    def judge(objects: DataFrame) -> DataFrame:
        zone = F.array(*map(F.lit, (-0.6, 0.6, -0.6, 0.6)))
        x, y = placement.zone_xy(zone, SEED, [F.col("s"), F.col("attempt"), F.col("i")])
        p = objects.withColumns({"x": x, "y": y})
        p = p.select("s", "i", "attempt", geometry.vec(F.col("x"), F.col("y"), F.lit(0.0)).alias("lo"), geometry.vec(F.col("x") + 0.5, F.col("y") + 0.5, F.lit(0.5)).alias("hi"))
        return overlap.scenes_with_overlap(p, ["s", "attempt"], "i", "lo", "hi")

    return placement.retried(o, ["s"], judge)


@query(f"""SELECT t.s, coalesce(min(CASE WHEN h.s IS NULL THEN t.attempt END), -1)::INTEGER AS attempt FROM (SELECT DISTINCT s, attempt FROM {_TRY}) t LEFT JOIN {_HIT} h ON t.s = h.s AND t.attempt = h.attempt GROUP BY 1""")
def first_passing_attempt(spark, d):
    return _retried(spark, d).select("s", F.coalesce("attempt", F.lit(-1)).alias("attempt"))


@query(f"""SELECT count(attempt) AS n_success, count(*) AS n_total FROM (SELECT t.s, min(CASE WHEN h.s IS NULL THEN t.attempt END) AS attempt FROM (SELECT DISTINCT s, attempt FROM {_TRY}) t LEFT JOIN {_HIT} h ON t.s = h.s AND t.attempt = h.attempt GROUP BY 1)""")
def scene_success_counts(spark, d):
    return overlap.success_counts(_retried(spark, d))


@query(f"""WITH f AS (SELECT t.s, min(CASE WHEN h.s IS NULL THEN t.attempt END)::INTEGER AS attempt FROM (SELECT DISTINCT s, attempt FROM {_TRY}) t LEFT JOIN {_HIT} h ON t.s = h.s AND t.attempt = h.attempt GROUP BY 1),
v AS (SELECT s, attempt, cam, row_number() OVER (ORDER BY s, cam) - 1 AS id FROM f, (VALUES (0), (1)) c(cam) WHERE attempt IS NOT NULL)
SELECT id, s, attempt, printf('images/%04d_%02d.png', s, cam) AS file_name FROM v""")
def accepted_scenes(spark, d):
    """The flagship: placements in up to three attempts, overlap, the first good attempt, views, dense image ids."""
    good = _retried(spark, d).where("attempt is not null")
    v = good.withColumn("cam", F.explode(F.array(F.lit(0), F.lit(1))))
    v = ids.dense_ids(v, "s", ["cam"], "id")
    return v.select("id", "s", "attempt", text.image_name(F.col("s"), F.col("cam")).alias("file_name"))


# -- views -------------------------------------------------------------------------------------------------------------


@query("""SELECT r_name, cam_idx::INTEGER AS cam_idx, x, f AS fov_deg, l AS has_target FROM region, (VALUES (0, 1.5e0, 40e0, TRUE), (1, -1.5e0, 40e0, TRUE), (2, 0e0, 40e0, FALSE), (3, 0e0, 55.5e0, TRUE)) c(cam_idx, x, f, l)""")
def cross_cameras(spark, d):
    cams, _ = cameras.parse(spark, CAMERAS)
    v = views.carry_fov(views.scene_views(_t(spark, d, "region"), cams), ["r_regionkey"], "cam_idx")
    return v.select("r_name", "cam_idx", F.col("location")[0].alias("x"), "fov_deg", F.col("look_at").isNotNull().alias("has_target"))


@query("""SELECT event_id, last_value(CASE WHEN event_type IN ('view', 'click') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fov FROM events""")
def fov_carry_forward(spark, d):
    e = _t(spark, d, "events").withColumn("fov", F.when(F.col("event_type").isin("view", "click"), F.col("value")))
    return views.carry_fov(e, ["user_id"], "event_id", "fov").select("event_id", "fov")


@query("""WITH p AS (SELECT l_orderkey AS s, l_quantity AS x, round(l_discount * 100)::DOUBLE AS y, round(l_tax * 100)::DOUBLE AS z FROM lineitem),
c AS (SELECT s, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy, sum(z) / count(*) AS cz FROM p GROUP BY 1)
SELECT s, floor(cx * 1e6 + 0.5e0) / 1e6 AS cx, floor(cy * 1e6 + 0.5e0) / 1e6 AS cy, floor(cz * 1e6 + 0.5e0) / 1e6 AS cz,
 floor(greatest(0.05e0, max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)))) * 1e6 + 0.5e0) / 1e6 AS radius FROM p JOIN c USING (s) GROUP BY s, cx, cy, cz""")
def scene_center_radius(spark, d):
    p = geometry.vec(F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100))
    o = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), p.alias("location")).withColumn("corners", F.array("location"))
    r = views.center_radius(o, ["s"], "location", "corners")
    return r.select("s", *[geometry.quantise(F.col("center")[i]).alias(n) for i, n in enumerate(("cx", "cy", "cz"))], geometry.quantise(F.col("radius")).alias("radius"))


_TH, _PH, _R = _between("0e0", "2 * pi()", "o_orderkey", "'theta'"), _between("radians(10)", "radians(35)", "o_orderkey", "'phi'"), f"(0.5e0 * {_between('1.2e0', '1.8e0', 'o_orderkey', chr(39) + 'r' + chr(39))})"


@query(f"""SELECT o_orderkey, {_q("x")} AS x, {_q("y")} AS y, {_q("z")} AS z, {_q("sqrt(x * x + y * y + (z - 0.1e0) * (z - 0.1e0))")} AS distance,
 {_q("-(y / n) / (sqrt(x * x + y * y) / n)")} AS right_x, {_q("sqrt(x * x + y * y) / n")} AS up_z FROM (SELECT *, sqrt(x * x + y * y + (z - 0.1e0) * (z - 0.1e0)) AS n FROM
 (SELECT o_orderkey, {_R} * cos({_TH}) * cos({_PH}) AS x, {_R} * sin({_TH}) * cos({_PH}) AS y, 0.1e0 + {_R} * sin({_PH}) AS z FROM orders))""")
def camera_pose(spark, d):
    none = [F.lit(None).cast("array<double>").alias(c) for c in ("location", "look_at", "rotation_euler_deg")]
    v = views.pose(_t(spark, d, "orders").select("o_orderkey", *none), geometry.vec(0, 0, 0.1), F.lit(0.5), SEED, F.col("o_orderkey"))
    q = geometry.quantise
    return v.select("o_orderkey", *[q(F.col("location")[i]).alias(n) for i, n in enumerate("xyz")], q(F.col("camera_distance_m")).alias("distance"), q(F.col("basis")[0]).alias("right_x"), q(F.col("basis")[5]).alias("up_z"))


_GIVEN = """(SELECT o_orderkey, o_orderkey % 2 = 0 AS looks, 1.5e0 + o_custkey % 7 AS lx, 0.25e0 * (o_custkey % 5) - 0.5e0 AS ly, 1.25e0 AS lz,
 radians(((o_custkey * 7) % 170 - 85)::DOUBLE) AS ax, radians(((o_custkey * 13) % 170 - 85)::DOUBLE) AS ay, radians(((o_custkey * 29) % 350 - 175)::DOUBLE) AS az FROM orders)"""


@query(f"""SELECT o_orderkey, {_q("CASE WHEN looks THEN -ly / flat ELSE cos(ay) * cos(az) END")} AS right_x, {_q("CASE WHEN looks THEN lx / flat ELSE cos(ay) * sin(az) END")} AS right_y,
 {_q("CASE WHEN looks THEN 0e0 ELSE -sin(ay) END")} AS right_z, {_q("CASE WHEN looks THEN flat / n ELSE sin(ax) * cos(ay) END")} AS up_z, {_q("CASE WHEN looks THEN lx / n ELSE cos(ax) * sin(ay) * cos(az) + sin(ax) * sin(az) END")} AS back_x,
 {_q("CASE WHEN looks THEN lz / n ELSE cos(ax) * cos(ay) END")} AS back_z, {_q("CASE WHEN looks THEN acos(lz / n) ELSE ax END")} AS euler_x, {_q("CASE WHEN looks THEN 0e0 ELSE ay END")} AS euler_y,
 {_q("CASE WHEN looks THEN atan2(lx, -ly) ELSE az END")} AS euler_z, {_q("n")} AS distance FROM (SELECT *, sqrt(lx * lx + ly * ly) AS flat, sqrt(lx * lx + ly * ly + lz * lz) AS n FROM {_GIVEN})""")
def given_camera_pose(spark, d):
    """Cameras with a place: half of them look at the origin, the others have angles; both give a basis and angles."""
    deg = lambda m, w, h: ((F.col("o_custkey") * m) % w - h).cast("double")
    looks = F.col("o_orderkey") % 2 == 0
    c = _t(spark, d, "orders").select(
        "o_orderkey", geometry.vec(F.lit(1.5) + F.col("o_custkey") % 7, F.col("o_custkey") % 5 * 0.25 - 0.5, F.lit(1.25)).alias("location"),
        F.when(looks, geometry.vec(0, 0, 0)).alias("look_at"), F.when(~looks, F.array(deg(7, 170, 85), deg(13, 170, 85), deg(29, 350, 175))).alias("rotation_euler_deg"))
    v = views.pose(c, geometry.vec(0, 0, 0), F.lit(1.0), SEED, F.col("o_orderkey"))
    # angles go to a basis and back
    v = v.withColumn("euler", geometry.basis_euler(F.col("basis")))
    b, e, q = F.col("basis"), F.col("euler"), geometry.quantise
    return v.select(
        "o_orderkey", *[q(b[k]).alias(n) for k, n in ((0, "right_x"), (1, "right_y"), (2, "right_z"), (5, "up_z"), (6, "back_x"), (8, "back_z"))],
        *[q(e[k]).alias(n) for k, n in enumerate(("euler_x", "euler_y", "euler_z"))], q(F.col("camera_distance_m")).alias("distance"))


@query(f"""SELECT o_orderkey, {_q("least(-c * 1e0 - s * 2e0, c * 1e0 - s * 2e0, -c * 1e0 + s * 2e0, c * 1e0 + s * 2e0) + 3")} AS x0, {_q("greatest(-c * 1e0 - s * 2e0, c * 1e0 - s * 2e0, -c * 1e0 + s * 2e0, c * 1e0 + s * 2e0) + 3")} AS x1,
 1e0 AS dz, 1e0 AS front_z, {_q("-s")} AS top_x FROM (SELECT o_orderkey, cos(a) AS c, sin(a) AS s FROM (SELECT o_orderkey, {_between("0e0", "2 * pi()", "o_orderkey", "'yaw'")} AS a FROM orders))""")
def world_boxes(spark, d):
    a = rng.uniform(0.0, 6.283185307179586, rng.draw(SEED, F.col("o_orderkey"), "yaw"))
    o = _t(spark, d, "orders").select("o_orderkey", F.cos(a).alias("c"), F.sin(a).alias("s"))
    z = F.lit(0.0)
    o = o.withColumn("m", F.array(F.col("c"), -F.col("s"), z, F.lit(3.0), F.col("s"), F.col("c"), z, z, z, z, F.lit(1.0), z, z, z, z, F.lit(1.0)))
    corners = F.array(*[geometry.vec(x, y, k) for x in (-1, 1) for y in (-2, 2) for k in (0, 1)])
    lo, hi = geometry.aabb(F.col("m"), corners)
    n = geometry.world_normals(F.col("m"))
    q = geometry.quantise
    return o.select("o_orderkey", q(lo[0]).alias("x0"), q(hi[0]).alias("x1"), q(geometry.z_extent(F.col("m"), corners)).alias("dz"), n["front_world_normal"][2].alias("front_z"), q(n["top_world_normal"][0]).alias("top_x"))


# -- masks and ids -----------------------------------------------------------------------------------------------------

_PIX = "(SELECT DISTINCT l_suppkey AS image, (l_partkey % 24)::INTEGER AS x, (l_orderkey % 16)::INTEGER AS y, l_linenumber AS v FROM lineitem)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 24).cast("int").alias("x"), (F.col("l_orderkey") % 16).cast("int").alias("y"), F.col("l_linenumber").alias("v"))
    return p.distinct().withColumns({"height": F.lit(16), "width": F.lit(24)})


@query(f"""SELECT image, v, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM {_PIX} GROUP BY 1, 2""")
def bbox_area(spark, d):
    b = masks.boxes_and_areas(_pixels(spark, d), ["image"])
    return b.select("image", "v", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "w", "h"))], "area")


@query(f"""WITH r AS (SELECT image, v, min(p) AS a, count(*) AS n FROM (SELECT image, v, x * 16 + y AS p, x * 16 + y - row_number() OVER (PARTITION BY image, v ORDER BY x * 16 + y) AS g FROM {_PIX}) GROUP BY image, v, g),
z AS (SELECT *, a - coalesce(lag(a + n) OVER (PARTITION BY image, v ORDER BY a), 0) AS zero FROM r)
SELECT image, v, string_agg(zero::VARCHAR || ',' || n::VARCHAR, ',' ORDER BY a) || CASE WHEN max(a + n) < 384 THEN ',' || (384 - max(a + n))::VARCHAR ELSE '' END AS counts, sum(n)::BIGINT AS area FROM z GROUP BY 1, 2""")
def mask_runs(spark, d):
    m = masks.mask_runs(_pixels(spark, d), ["image"], "height", "width")
    return m.select("image", "v", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"), masks.area_of(F.col("counts")).alias("area"))


_DIFF = """SELECT image, v, list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > 3 THEN c[i] - c[i - 2] ELSE c[i] END) AS d FROM r"""
_CHARS = """list_transform(range(0, 13), lambda k: chr((48 + (floor(x / 32 ** k)::BIGINT % 32 + 32) % 32 + CASE WHEN k < n THEN 32 ELSE 0 END)::INTEGER))"""


@query(f"""WITH z AS (SELECT image, v, min(p) AS a, count(*) AS n FROM (SELECT image, v, x * 16 + y AS p, x * 16 + y - row_number() OVER (PARTITION BY image, v ORDER BY x * 16 + y) AS g FROM {_PIX}) GROUP BY image, v, g),
y AS (SELECT *, a - coalesce(lag(a + n) OVER (PARTITION BY image, v ORDER BY a), 0) AS zero FROM z),
r AS (SELECT image, v, flatten(list([zero, n] ORDER BY a)) || CASE WHEN max(a + n) < 384 THEN [384 - max(a + n)] ELSE [] END AS c FROM y GROUP BY 1, 2),
w AS (SELECT image, v, unnest(d) AS x, unnest(range(len(d))) AS i FROM ({_DIFF})),
t AS (SELECT *, CASE WHEN x BETWEEN -16 AND 15 THEN 0 WHEN x BETWEEN -512 AND 511 THEN 1 ELSE 2 END AS n FROM w)
SELECT image, v, string_agg(array_to_string(list_slice({_CHARS}, 1, n + 1), ''), '' ORDER BY i) AS packed FROM t GROUP BY 1, 2""")
def packed_masks(spark, d):
    m = masks.mask_runs(_pixels(spark, d), ["image"], "height", "width")
    return m.select("image", "v", masks.packed(F.col("counts")).alias("packed"))


@query(f"""SELECT image, v, x, y, count(*) OVER (PARTITION BY image, v) AS area FROM {_PIX}""")
def mask_pixels(spark, d):
    """Pixels to packed masks and back to pixels."""
    from pyspark.sql import Window

    packed = packed_masks(spark, d)
    p = masks.run_pixels(masks.unpacked_runs(packed, ["image", "v"], "packed"), ["image", "v"], F.lit(16))
    return p.withColumn("area", F.count("*").over(Window.partitionBy("image", "v")))


@query("""WITH e AS (SELECT user_id, event_id, (event_type = 'error')::INTEGER AS bit FROM events), n AS (SELECT *, CASE WHEN bit = lag(bit) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n) SELECT user_id, run::BIGINT AS run, bit, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def run_lengths(spark, d):
    return masks.run_lengths(_t(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error")


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, printf('images/%04d_%02d.png', o_orderkey, 0) AS file_name, o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def dense_image_ids(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'").withColumn("cam", F.lit(0))
    return ann.images(o, "o_orderkey", "cam", 640).select("id", "file_name", "o_orderkey")


@query("""SELECT o_orderkey, printf('images/%04d_%02d.png', o_orderkey, o_custkey % 12) AS file_name,
 printf('vis_images_%04d_%02d.png', o_orderkey, o_custkey % 12) AS overlay FROM orders""")
def file_name_format(spark, d):
    name = text.image_name(F.col("o_orderkey"), F.col("o_custkey") % 12)
    return _t(spark, d, "orders").select("o_orderkey", name.alias("file_name"), text.overlay_name(name).alias("overlay"))


@query("""SELECT s, i, row_number() OVER (PARTITION BY s ORDER BY (NOT st)::INTEGER, i)::INTEGER AS pass_index FROM (SELECT DISTINCT l_orderkey AS s, l_linenumber AS i, l_linenumber % 3 = 0 AS st FROM lineitem)""")
def pass_indices(spark, d):
    o = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("i")).distinct()
    return ids.pass_index(o, ["s"], F.col("i") % 3 == 0, "i").select("s", "i", "pass_index")


def _coco(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as images, their lines as objects of a brand; every seventh line is hidden."""
    o = _t(spark, d, "orders").where("o_orderstatus <> 'P'").withColumn("cam", F.lit(0))
    img = ann.images(o, "o_orderkey", "cam", 640)
    obj = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("obj")).agg(
        F.max("l_partkey").alias("p_partkey"), F.max("l_quantity").cast("int").alias("qty"))
    obj = obj.join(_t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("sku")), "p_partkey")
    obj = obj.withColumns({"cam": F.lit(0), "area": F.when(F.col("obj") == 7, 0).otherwise(F.col("qty")), "bbox": F.array("obj", "qty", F.lit(3), F.lit(4))})
    cats = ids.category_ids(_t(spark, d, "part"), "p_brand")
    return img, ann.annotations(obj, img, cats, ["o_orderkey", "cam"], "obj"), cats


_COCO = """WITH img AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id, printf('images/%04d_%02d.png', o_orderkey, 0) AS file_name FROM orders WHERE o_orderstatus <> 'P'),
cat AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand)::INTEGER AS cid FROM (SELECT DISTINCT p_brand FROM part)),
obj AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS obj, max(l_partkey) AS p_partkey, max(l_quantity)::INTEGER AS qty FROM lineitem GROUP BY 1, 2),
an AS (SELECT row_number() OVER (ORDER BY img.id, obj) - 1 AS id, img.id AS image_id, cid AS category_id, p_brand AS category, obj, qty FROM obj JOIN img USING (o_orderkey) JOIN part USING (p_partkey) JOIN cat ON cat.name = p_brand WHERE obj <> 7 AND qty > 0)
"""


@query(_COCO + "SELECT id, image_id, category_id, qty AS area, 0 AS iscrowd FROM an")
def annotation_ids(spark, d):
    return _coco(spark, d)[1].select("id", "image_id", "category_id", "area", "iscrowd")


@query(_COCO + "SELECT file_name, coalesce(an.id, -1) AS annotation_id, category, coalesce(obj, -1) AS x, coalesce(qty - 5, -1) AS label_y FROM img LEFT JOIN an ON an.image_id = img.id")
def coco_tables(spark, d):
    f = ann.flat(*_coco(spark, d))
    x, y = ann.label_anchor(F.col("bbox"))
    none = F.lit(-1)
    return f.select("file_name", F.coalesce("annotation_id", none).alias("annotation_id"), "category", F.coalesce(x, none).alias("x"), F.coalesce(y, none).alias("label_y"))


@query(_COCO + """SELECT an.id, image_id, category_id, qty AS area, obj AS x, (SELECT count(*) FROM img) AS n_images, (SELECT count(*) FROM cat) AS n_categories,
 (SELECT string_agg(name, ',' ORDER BY cid) FROM cat) AS names, (SELECT md5(string_agg(id::VARCHAR || ':' || file_name, ',' ORDER BY id)) FROM img) AS images_md5 FROM an""")
def coco_document(spark, d):
    """The document of all images and annotations as lines of JSON, read again from them; no row holds more than an object."""
    img, an, cats = _coco(spark, d)
    an = an.select("id", "image_id", "category_id", "bbox", "area").withColumn("metadata", F.lit(None).cast("struct<shape:string>"))
    lines = ann.document_lines(img.drop("o_orderkey", "cam"), an, cats)
    kinds = ("id long, file_name string", "id long, image_id long, category_id int, bbox array<int>, area int", "id int, name string")
    images, objects, categories = (ann.line_objects(lines, k, kind) for k, kind in enumerate(kinds))
    listed = digests.ordered_md5(images, F.col("id"), F.concat(F.col("id").cast("string"), F.lit(":"), F.col("file_name")))
    named = categories.agg(F.count("*").alias("n_categories"), F.array_join(F.array_sort(F.collect_list(F.struct("id", "name")))["name"], ",").alias("names"))
    totals = written(listed.crossJoin(F.broadcast(named)), "document-totals")  # one row, complete before it is broadcast
    r = objects.crossJoin(F.broadcast(totals))
    return r.select("id", "image_id", "category_id", "area", F.col("bbox")[0].alias("x"), F.col("n").alias("n_images"), "n_categories", "names", F.col("md5").alias("images_md5"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN printf('{"id":%d}', o_orderkey) ELSE printf('{"id":%d,"metadata":{"shape":%s,"target_size_m":%s,"placement_mode":"scatter","stack_layer":%s,"camera_distance_m":%s,"front_world_normal":[0.0,0.0,1.0],"back_world_normal":[0.0,0.0,-1.0],"top_world_normal":[0.0,1.0,0.0]}}',
 o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN '"box"' ELSE 'null' END, ((o_custkey % 8 + 1) / 8e0)::VARCHAR, CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 4)::VARCHAR ELSE 'null' END, ((o_custkey % 16) / 4e0)::VARCHAR) END AS value FROM orders""")
def annotation_json(spark, d):
    """Annotations as JSON: an absent metadata is left out, nulls within it are written, an empty shape is null."""
    k, one = F.col("o_custkey"), [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    meta = ann.metadata(
        F.when(k % 3 == 0, "").when(k % 3 == 1, "box"), (k % 8 + 1) / 8, F.lit("scatter"), F.when(k % 2 == 0, k % 4), (k % 16) / 4, geometry.world_normals(F.array(*map(F.lit, one))),
    )
    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", meta).alias("metadata"))
    return a.select("id", ann.json_object(a).alias("value"))


@query(_COCO + "SELECT an.id, file_name, category, qty AS area, obj AS x FROM an JOIN img ON img.id = image_id")
def coco_document_file(spark, d):
    """The document as one file, written by many tasks, and read again by many tasks in ranges of bytes."""
    import os
    import uuid

    from .scratch import shared_dir
    from .sinks.datasets import write_document
    from .sources import documents

    img, an, cats = _coco(spark, d)
    folder = shared_dir(spark).removeprefix("file:")
    path = f"{folder}/document-{uuid.uuid4().hex}.json"
    os.makedirs(folder, exist_ok=True)
    write_document(path, img.drop("o_orderkey", "cam"), an.select("id", "image_id", "category_id", "bbox", "area"), cats)
    kinds = {"images": "struct<id: long, file_name: string>", "annotations": "struct<id: long, image_id: long, category_id: int, bbox: array<int>, area: int>", "categories": "struct<id: int, name: string>"}
    t = documents.arrays(spark, path, kinds, range_=1 << 20)
    cats = F.broadcast(t["categories"].withColumnRenamed("id", "category_id"))  # products, a table driven by hand
    out = t["annotations"].join(cats, "category_id").join(t["images"].withColumnRenamed("id", "image_id"), "image_id")
    return out.select("id", "file_name", F.col("name").alias("category"), "area", F.col("bbox")[0].alias("x"))


@query(f"""SELECT s, i, j, {_q("volume")} AS volume FROM (SELECT a.s, a.i, b.i AS j, {_VOL} AS volume FROM (SELECT (s // 5000) AS s, s * 10 + i AS i, x * 20 AS x, (s % 97) / 2e0 AS y, (s % 89) / 2e0 AS z FROM {_BOX}) a
 JOIN (SELECT (s // 5000) AS s, s * 10 + i AS i, x * 20 AS x, (s % 97) / 2e0 AS y, (s % 89) / 2e0 AS z FROM {_BOX}) b ON a.s = b.s AND a.i < b.i AND a.y - b.y < 0.5e0 AND b.y - a.y < 0.5e0) WHERE volume > 0.05e0""")
def crowded_pair_overlap(spark, d):
    """All lines of a few thousand orders are one scene: pairs by cells of a grid."""
    b = _boxes(spark, d).select(F.expr("s div 5000").alias("s"), (F.col("s") * 10 + F.col("i")).alias("i"), (F.col("lo")[0] * 20).alias("x"), (F.col("s") % 97 / 2).alias("y"), (F.col("s") % 89 / 2).alias("z"))
    b = b.select("s", "i", geometry.vec(F.col("x"), F.col("y"), F.col("z")).alias("lo"), geometry.vec(F.col("x") + 0.5, F.col("y") + 0.5, F.col("z") + 0.5).alias("hi"))
    p = overlap.crowded_pairs(b, ["s"], "i", "lo", "hi")
    return p.select("s", "i", "j", geometry.quantise(F.col("volume")).alias("volume"))


@query("SELECT l_linenumber AS v, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def nonempty_areas(spark, d):
    li = _t(spark, d, "lineitem").withColumn("area", F.when(F.col("l_quantity") > 10, 1).otherwise(0))
    return masks.nonempty(li).groupBy(F.col("l_linenumber").alias("v")).agg(F.count("*").alias("n"))

