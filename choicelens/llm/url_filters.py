"""URL filters: host rules, and trust and distrust propagated over the link graph for hosts without a rule.

Hosts are nodes and their links to other hosts are edges. Personalised PageRank from trusted hosts follows links: whom the
trusted link to is trusted. From blocked hosts it goes against them: who links to the blocked is distrusted. A host whose
distrust outweighs its trust is blocked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Fixed values: (verdict, host, path prefix).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, ROUNDS, MARGIN = 0.85, 20, 1.0
LINK = r"""(?i)<(?:a|area)\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end. Both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null: rules come longest first, so the first hit wins."""
    name = lambda h, p: h + p
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    longest = sorted(rules, key=lambda r: (-len(name(*r[1:])), name(*r[1:])))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda e, r: F.when(fits(*r[1:]), F.struct(F.lit(name(*r[1:])).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(e), reversed(longest), none)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute and scheme-relative hrefs. Relative links stay on their host."""
    src, _ = host_and_path(F.col("url"))
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.select(src.alias("src"), F.explode(F.array_distinct(hrefs)).alias("href"))
    dst, _ = host_and_path(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href")))
    return links.select("src", dst.alias("dst")).where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust). seeds: (host, kind, mass) with masses of each kind adding to 1; trust follows edges, distrust goes against them.

    Both walks run in one pass a round over edges keyed by (kind, node). Hosts without edges out return nothing; a walk
    of r rounds holds all but damping^r of its mass.
    """
    out = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("node"), F.col("dst").alias("to"), "n")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("node"), F.col("src").alias("to"), "n")
    both = out.union(back)
    share = both.join(both.groupBy("kind", "node").agg(F.sum("n").alias("all")).hint("merge"), ["kind", "node"])
    share = written(share.select("kind", "node", "to", (F.col("n") / F.col("all")).alias("w")), "shares")
    first = seeds.select("kind", F.col("host").alias("node"), (F.col("mass") * (1 - damping)).alias("m"))
    rank = moving = written(first, "rank")
    if share.isEmpty():  # nothing to walk along
        rounds = 0
    for i in range(1, rounds + 1):
        moving = share.join(moving.hint("merge"), ["kind", "node"]).groupBy("kind", F.col("to").alias("node")).agg(F.sum(F.col("m") * F.col("w") * damping).alias("m"))
        moving = written(moving, "moving")
        rank = rank.union(moving)
        if i % 5 == 0 or i == rounds:
            rank = written(rank.groupBy("kind", "node").agg(F.sum("m").alias("m")), "rank")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("m"))), F.lit(0.0)).alias(kind)
    return rank.groupBy(F.col("node").alias("host")).agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list = RULES, margin: float = MARGIN) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per row of pages.

    A url under a rule gets the rule's verdict. Hosts with pages under allow rules are trusted seeds, those with pages
    under block rules blocked ones, each weighted with its share of such pages. Any other url is judged by its host:
    block when distrust > margin * trust, else allow. Null urls and urls without a host have no rule and no links: allow.
    Null html has no links. Repeated rows and columns of any other name are allowed.
    """
    host, path = host_and_path(F.col("url"))
    at = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("r.verdict") == "allow", "trust").otherwise("distrust")
    ruled = at.where("r IS NOT NULL").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    whole = ruled.groupBy("kind").agg(F.sum("n").alias("all"))  # two rows
    seeds = ruled.join(F.broadcast(whole), "kind").select("host", "kind", (F.col("n") / F.col("all")).alias("mass"))
    rank = written(propagate(written(host_edges(pages), "edges"), written(seeds, "seeds")).where("trust > 0 OR distrust > 0"), "hosts")
    got = at.join(rank.hint("merge"), "host", "left")
    none = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > margin * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return got.select("page_id", "host", "path", "r.rule", F.coalesce("r.verdict", by_host).alias("verdict"), none("trust"), none("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
