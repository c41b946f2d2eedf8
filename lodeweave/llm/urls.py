"""URL verdicts: rules first, link-graph propagation for the rest.

Trust is a personalised PageRank from the hosts that rules allow, distrust one
over reversed edges from the hosts that rules block. Edges are links between
hosts and steps between a host and the domain above it. Both run in one state
table ``(kind, host, rank)`` and one edge table, so a round is one equi join
and one aggregation with map-side combine. A host without a rule is blocked
where its distrust exceeds its trust by the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_cut, fresh, scratch, without

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ROUNDS, CUT_EVERY, THRESHOLD = 0.85, 12, 4, 1.0


def split_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` plus ``host`` (A-Z lower-cased) and ``path``; columns of these names are replaced."""
    (name,) = fresh(pages, "rest")
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(url))).otherwise("")
    out = pages.withColumn(name, F.coalesce(rest, F.lit("")))
    host, path = F.regexp_extract(name, r"^[^/?#]*", 0), F.regexp_extract(name, r"^[^/?#]*([^?#]*)", 1)
    return out.select(*without(pages, "host", "path"), ascii_lower(host).alias("host"), path.alias("path"))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(length, verdict, rule)`` of the longest rule that fits, else null; block wins a tie.

    ``rules`` is a short list of the caller's (it becomes a literal of the plan).
    """
    fits = []
    for rule, verdict in rules:
        domain, _, rest = rule.partition("/")
        fit = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,verdict:string,rule:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` between different hosts: absolute links, and both ways to the domain above.

    ``pages`` has host and html; relative links stay on their host and give no edge.
    """
    links = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))).alias("url"))
    to = split_urls(links.withColumn("url", F.regexp_replace("url", "^//", "http://")))
    direct = to.where("host <> ''").select("src", F.col("host").alias("dst"))
    hosts = pages.where("host <> ''").select("host").union(to.where("host <> ''").select("host")).distinct()
    up = hosts.where("host like '%.%.%'").select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst"))
    return direct.union(up).union(up.select("dst", "src")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(kind, host, rank)`` from ``edges(src, dst, n)`` and ``seeds(kind, host, weight)``.

    Kinds are ``trust`` (along the edges) and ``distrust`` (against them); each
    kind's seed weights are scaled to one.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    step = cut(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out") * damping).alias("share")))
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = cut(seeds.join(F.broadcast(sums), "kind").groupBy("kind", "host").agg(F.sum(F.col("weight") / F.col("all")).alias("rank")))
    rest = start.withColumn("rank", F.col("rank") * (1 - damping))
    state, kept = start, None
    for k in range(rounds):
        moved = state.withColumnRenamed("host", "src").join(step, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        state = moved.union(rest).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (k + 1) % CUT_EVERY == 0 or k + 1 == rounds:
            state = cut(state)
            if kept is not None:
                drop_cut(kept)
            kept = state
    return state


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages(page_id, url, html)`` plus host, path, rule, verdict, trust and distrust.

    Every row stays, repeated or not; a page without a host is allowed unless a
    rule fits; without any seeds all ranks are zero and the verdict is allow.
    """
    keep = without(pages, "host", "path", "rule", "verdict", "trust", "distrust")
    match, key = fresh(pages, "match", "ranked_host")
    found, kind = F.col(match), lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    split = split_urls(pages.select(*keep)).withColumn(match, matched_rule(F.col("host"), F.col("path"), rules))
    links = pages.select(F.col("url"), F.col("html"))  # whatever else the caller's columns are called
    hosts = split_urls(links).withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    seeds = hosts.where("found is not null and host <> ''").groupBy(F.when(F.col("found.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    with scratch() as kept:
        ranks = propagate(host_edges(hosts), seeds)
        kept.append(ranks)
    ranked = ranks.groupBy(F.col("host").alias(key)).agg(kind("trust"), kind("distrust"))
    out = split.join(ranked, F.col("host") == F.col(key), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce(found["verdict"], F.when((F.col("host") != "") & (distrust > threshold * trust), "block").otherwise("allow"))
    return out.select(*keep, "host", "path", found["rule"].alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
