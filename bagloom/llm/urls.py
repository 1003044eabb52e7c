"""URL filters: host and path rules, and link-graph propagation for the rest.

Rules decide the urls that they fit.  Hosts with allowed pages are trusted seeds of a personalised PageRank
along host links; hosts with blocked pages are seeds of the same walk on reversed links, so distrust reaches
those that link to them.  A url that no rule fits is blocked if its host's distrust exceeds its trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_spread

#: Fixed values: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: Share of the walk that may be left when propagation ends.
TOLERANCE = 1e-9
#: Rounds that always suffice, as each leaves at most DAMPING of what was left.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: Most rules that are broadcast.
BROADCAST_RULES = 100_000


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without ://."""
    whole = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = _ascii_lower(F.regexp_extract(whole, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(whole, r"(?s)^[^/?#]*([^?#]*)", 1)


def edges(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """(src, dst, n) of links between different hosts."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\shref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    raw = pages.select(host.alias("src"), F.explode(links).alias("to"))
    dst, _ = host_and_path(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to")))
    return raw.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind of seeds; links: (kind, src, dst, n).

    seeds: (kind, host, weight).  Rank leaves a host along its links by their counts; what a host without
    links holds goes nowhere.  Every round moves the mass of the round before one link on, sums by host with
    partial sums and is checkpointed, until at most `tolerance` of each kind's mass still moves; that bounds
    what any host's rank lacks.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = cut(seeds.groupBy("kind", "host").agg(F.sum("weight").alias("weight")).join(total, "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("start")))
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    flow = cut(links.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("share")))
    state = start.select("kind", "host", ((1 - damping) * F.col("start")).alias("rank"), F.col("start").alias("mass"))
    while True:
        mass = damping * F.col("share") * F.col("mass")
        moved = flow.join(state.where("mass > 0"), ["kind", "host"]).select("kind", F.col("dst").alias("host"), ((1 - damping) * mass).alias("rank"), mass.alias("mass"))
        state = cut(state.withColumn("mass", F.lit(0.0)).unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("mass").alias("mass")))
        left = state.groupBy("kind").agg(F.sum("mass").alias("mass")).agg(F.max("mass")).first()[0]  # one number
        if not left or left <= tolerance:
            return state.select("kind", "host", "rank")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust): one row per row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally
    long ones the blocking one.  Hosts that no seed reaches are allowed, an empty host too.  Null html has no
    links; repeated rows repeat and weigh twice as seeds; an empty table gives no row.  Very long html is read
    whole; a host of very many pages is joined in parts.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = cut(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")))
    hot = hot_keys(rows, "host")
    parsed = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    table = spark.createDataFrame(parsed, "verdict string, rule string, rule_host string, rule_path string")
    if len(parsed) <= BROADCAST_RULES:
        table = F.broadcast(table)
    # a host meets rules by equality with each of its suffixes; rules of one host: few
    names = rows.select("host").distinct()
    labels = F.split("host", r"\.")
    suffix = names.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("rule_host"))
    fits = cut(suffix.join(table, "rule_host").groupBy("host").agg(F.collect_set(F.struct("rule", "rule_path", "verdict")).alias("rules")))
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "block").alias("block"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    ruled = cut(join_spread(rows, fits, "host", hot).select("id", "host", "path", best.alias("best")))
    seeds = ruled.where("best is not null").groupBy(F.col("best.verdict").alias("kind"), "host").agg(F.count(F.lit(1)).alias("weight"))
    e = cut(edges(pages, host, html_col))
    links = e.select(F.lit("allow").alias("kind"), "src", "dst", "n").unionByName(e.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    rank = propagate(links, seeds, damping, tolerance)
    both = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("rank"))).alias("distrust"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = join_spread(ruled, both, "host", hot).select("id", "host", "path", "best", zero("trust"), zero("distrust"))
    verdict = F.coalesce("best.verdict", F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
