"""URL filter: rules first, then link-graph propagation over hosts (DataFrame functions only).

Rules (host, path prefix, verdict) fit a host and its subdomains; the longest rule wins. Hosts whose pages no rule
decides are judged by two personalised PageRanks over host edges: trust flows from hosts with allowed pages along the
links, distrust from hosts with blocked pages against them. Edges are the absolute links of the pages' anchors (not
those in scripts, styles and comments) and, always, with a smaller weight, host <-> parent domain. A host is blocked if its distrust is at least ``floor`` over the number of
hosts and at least ``share`` of its trust and distrust together.

All state is one row per host and one per edge; both are pre-aggregated before they are shuffled. A hub's edges are dealt
over SALTS keys and its rank is copied to them. The scores are written to the shared folder every few rounds and before
they are compared with those of the next round, so no round is planned twice. Rounds go on until no host's rank can still move by more than 1/100 of
the mean rank, a fiftieth of the floor (see host_scores). Pages meet the scores in an outer join on host, whose hot keys Spark's
skew join splits.

Edge cases: a null URL or one without "://" has empty host and path, fits no rule and is allowed; null html has no
links; an empty table gives an empty result; pages that repeat are judged each for itself; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (host, path prefix, verdict): fixed values of the query's contract.
RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""
#: Parts of a page whose links do not count.
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)"
#: A host of more edges is a hub; keys that its edges are dealt over.
HUB, SALTS = 10_000, 16
#: Rounds in one plan.
TOGETHER = 3


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits; longer rules are asked first, then in text order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _parents(host: Column) -> Column:
    """The host's parent domain, null at two labels or fewer."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 2, F.regexp_replace(host, r"^[^.]*\.", ""))


def host_scores(
    judged: DataFrame, rounds: int | None = 8, damping: float = 0.85, parent_weight: float = 0.2, tolerance: float = 1e-2
) -> DataFrame:
    """(host, trust, distrust, n_hosts) of rows (host, verdict, links).

    With rounds None the ranks converge: the largest change of any host in the last round, carried on at the damping
    rate for ever (times damping / (1 - damping)), is at most ``tolerance`` over the number of hosts. Both numbers scale
    with a host's mean rank, so the rounds needed do not grow with the graph.
    """
    seen = judged.groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")
    ).where("host <> ''")
    linked = judged.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    linked = linked.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    up = seen.select(F.col("host").alias("src"), _parents(F.col("host")).alias("dst")).where("dst is not null")
    ends = linked.select(F.col("dst").alias("src")).distinct()
    up = up.unionByName(ends.select("src", _parents(F.col("src")).alias("dst")).where("dst is not null")).distinct()
    up = up.withColumn("w", F.lit(parent_weight))
    edges = linked.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    edges = materialize(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), "host-edges")
    hosts = seen.select("host", "good", "bad").unionByName(
        edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
    ).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    # one seed mass per host, shared between trust and distrust by its ruled pages
    ruled = F.greatest(F.col("good") + F.col("bad"), F.lit(1))
    seeds = hosts.select("host", (F.col("good") / ruled).alias("s_t"), (F.col("bad") / ruled).alias("s_d"))
    total = seeds.agg(F.sum("s_t").alias("all_t"), F.sum("s_d").alias("all_d"), F.count("*").alias("n_hosts"))
    seeds = seeds.join(F.broadcast(total)).select(  # one row
        "host", "n_hosts",
        F.when(F.col("all_t") > 0, F.col("s_t") / F.col("all_t")).otherwise(0.0).alias("s_t"),
        F.when(F.col("all_d") > 0, F.col("s_d") / F.col("all_d")).otherwise(0.0).alias("s_d"),
    )
    seeds = materialize(seeds, "host-seeds")
    out_w = edges.groupBy(F.col("src").alias("host")).agg(F.sum("w").alias("out_w"))
    in_w = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("w").alias("in_w"))
    # flow: from a host to a neighbour, the shares of its trust (links) and of its distrust (links reversed)
    flow = edges.join(out_w, edges.src == out_w.host).select(
        F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") / F.col("out_w")).alias("p_t"), F.lit(0.0).alias("p_d")
    ).unionByName(edges.join(in_w, edges.dst == in_w.host).select(
        F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("p_t"), (F.col("w") / F.col("in_w")).alias("p_d")
    )).groupBy("a", "b").agg(F.sum("p_t").alias("p_t"), F.sum("p_d").alias("p_d"))
    flow = materialize(flow, "host-flow-all")
    # only hosts of very many edges are dealt over SALTS keys, and only their ranks are copied
    hubs = materialize(flow.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select(F.col("a").alias("hub")), "host-hubs")
    salt = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0)
    flow, all_flow = materialize(flow.join(hubs, flow.a == hubs.hub, "left").select("a", "b", "p_t", "p_d", salt.alias("salt")), "host-flow"), flow
    discard(all_flow)
    salts = F.when(F.col("hub").isNotNull(), SALTS).otherwise(1).alias("salts")
    seeds, all_seeds = materialize(seeds.join(hubs, seeds.host == hubs.hub, "left").select("host", "n_hosts", "s_t", "s_d", salts), "host-seeds"), seeds
    discard(all_seeds)
    discard(hubs)

    def round_(ranks: DataFrame) -> DataFrame:
        dealt = ranks.select("host", "t", "d", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("r_salt"))
        come = dealt.join(flow, (dealt.host == flow.a) & (dealt.r_salt == flow.salt)).groupBy(F.col("b").alias("dst_host")).agg(
            F.sum(F.col("t") * F.col("p_t")).alias("in_t"), F.sum(F.col("d") * F.col("p_d")).alias("in_d")
        )
        return seeds.join(come, seeds.host == come.dst_host, "left").select(
            "host", "n_hosts", "salts",
            ((1 - damping) * F.col("s_t") + damping * F.coalesce("in_t", F.lit(0.0))).alias("t"),
            ((1 - damping) * F.col("s_d") + damping * F.coalesce("in_d", F.lit(0.0))).alias("d"),
        )

    ranks = seeds.select("host", "n_hosts", "salts", F.col("s_t").alias("t"), F.col("s_d").alias("d"))
    k, kept = 0, None
    while k != rounds:
        # a few rounds in one plan, written; where ranks are to converge, one more, which is compared with them
        for _ in range(TOGETHER if rounds is None else min(TOGETHER, rounds - k)):
            ranks = round_(ranks)
            k += 1
        ranks, old = materialize(ranks, "host-ranks"), kept
        if old is not None:
            discard(old)
        kept = ranks
        if rounds is None:
            was = ranks.select(F.col("host").alias("was"), F.col("t").alias("t0"), F.col("d").alias("d0"))
            new = round_(ranks)
            new = materialize(new.join(was, new.host == was.was).drop("was"), "host-ranks")
            moved = F.greatest(F.max(F.abs(F.col("t") - F.col("t0"))), F.max(F.abs(F.col("d") - F.col("d0"))))
            left = new.agg((moved * F.max("n_hosts") * (damping / (1 - damping))).alias("left")).first()["left"]
            discard(kept)
            ranks, kept, k = new.drop("t0", "d0"), new, k + 1
            if left is None or left <= tolerance:
                break
    discard(edges)
    discard(flow)
    if kept is not None:
        discard(seeds)
    return ranks.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"), "n_hosts")


def filter_urls(
    pages: DataFrame, rules=RULES, share: float = 0.95, floor: float = 0.5, rounds: int | None = None,
    id_col: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of pages; rounds None: ranks that have converged."""
    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "verdict": verdict})
    links = F.transform(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), UNSEEN, ""), F.lit(HREF), 1)), lambda x: F.translate(x, UPPER, LOWER))
    scores = host_scores(p.select("host", "verdict", links.alias("links")), rounds)
    scores = scores.select(F.col("host").alias("s_host"), "trust", "distrust", "n_hosts")
    p = p.drop("html").join(scores, F.col("host") == F.col("s_host"), "left")
    spam = (F.col("distrust") * F.col("n_hosts") >= floor) & (F.col("distrust") >= share * (F.col("trust") + F.col("distrust")))
    return p.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.coalesce(spam, F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
