"""URL filters: rules by host and path, and link-graph propagation of trust and
distrust over host edges for what no rule covers. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfold.llm.common import dropped, set_aside, stored

OWN = ["host", "path", "rule", "verdict", "trust", "distrust"]
#: (rule as host + path, verdict); a path starts with "/"
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes of the largest table that is broadcast, by its counted rows and longest strings
BROADCAST_BYTES = 32 << 20
#: summed change of all scores, of 1 in sum, at which propagation ends
TOLERANCE = 1e-6


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def small(df: DataFrame, width: Column) -> DataFrame:
    """Broadcast ``df`` where its counted size allows, else leave the join to the planner."""
    n, w = df.agg(F.count("*"), F.max(width)).first()
    return F.broadcast(df) if n * (200 + 4 * (w or 0)) <= BROADCAST_BYTES else df


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host, the rules of the host itself and of its parent domains as an
    array of (path, rule, verdict), longest rule first."""
    rules = rules.select(F.regexp_extract("rule", r"^[^/]*", 0).alias("suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("start"), "rule", "verdict")
    labels = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    found = suffixes.join(small(rules, F.length("rule")), "suffix")
    one = F.struct((-F.length("rule")).alias("by"), "start", "rule", "verdict")
    return found.groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def link_edges(pages: DataFrame) -> DataFrame:
    """Host edges (src, dst, n) from the ``href`` values of whole pages: absolute
    and ``//host`` links lead to that host, other links stay on the page's host."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    links = pages.select("host", F.explode(F.array_distinct(F.transform(hrefs, lambda h: F.when(
        h.rlike(r"^(?i)([a-z][a-z0-9+.-]*:)?//"), F.translate(F.regexp_extract(h, r"^[^/]*//([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.col("host"))))).alias("dst"))
    return links.where("host <> '' and dst <> ''").groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None, damping: float) -> DataFrame:
    """Personalised PageRank: (host, score) by steps of
    ``score = (1 - damping) * seed + damping * (incoming + seed * lost)``, where
    ``lost`` is the score of hosts without outgoing edges, until the scores change by
    ``TOLERANCE`` in sum at most, or for ``rounds`` steps if given. ``seeds`` (host, seed)
    lists every host; the seeds sum to 1, or are all 0. A step shrinks the change by
    ``damping`` at least, so the steps end."""
    ranks = seeds.select("host", "seed", F.col("seed").alias("score"))
    sources = edges.select("src").distinct()
    written, n = None, 0
    while rounds is None or n < rounds:
        come = ranks.join(edges, ranks.host == edges.src).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("come"))
        lost = ranks.join(sources, ranks.host == F.col("src"), "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        score = (1 - damping) * F.col("seed") + damping * (F.coalesce("come", F.lit(0.0)) + F.col("seed") * F.col("lost"))
        ranks = (ranks.join(come, ranks.host == come.dst, "left").crossJoin(F.broadcast(lost))  # one row
                 .select("host", "seed", score.alias("score"), F.abs(score - F.col("score")).alias("change")))
        ranks = stored(ranks, "ranks")  # a short plan and lineage each round
        if written is not None:
            dropped(written)
        written = ranks
        n += 1
        if rounds is None and (ranks.agg(F.sum("change")).first()[0] or 0.0) <= TOLERANCE:
            break
    return ranks.select("host", "score")


def judge_urls(pages: DataFrame, rules: DataFrame, rounds: int | None = None, damping: float = 0.85, ratio: float = 1.0) -> DataFrame:
    """Every page with host, path, the longest rule that fits, verdict, trust and distrust.

    ``rules`` (rule, verdict): rule is host + path, as ``com/fr/``; it fits its
    host and all subdomains where the path starts with the rule's. Pages that no
    rule fits are judged by host: trust is personalised PageRank over host edges
    from the pages that ``allow`` rules fit (a host's share of them is its seed),
    distrust the same over reversed edges from the pages that ``block`` rules
    fit, so linking to blocked pages costs a host; both are iterated until they
    settle (``TOLERANCE``), or for ``rounds`` steps if given. A host with
    ``distrust > ratio * trust`` is blocked, any other allowed. Host edges are
    pre-aggregated, so a host with a third of all pages is a handful of edges.

    Defined cases: a null url, or one without ``://``, has an empty host and path,
    fits no rule and is allowed; null or empty html has no links; repeated pages
    are judged alike and each kept; no pages, no rules or no links are fine; input
    columns named like the result's come back as ``<name>_in``.
    """
    pages = set_aside(pages, OWN).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # one pass over the html; links and pages per (host, path start) are host-sized afterwards
    edges = stored(link_edges(pages), "edges")
    by_host = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    fitting = rules_by_host(by_host.select("host"), rules)
    hosts = stored(by_host.join(fitting, "host", "left").select("host", F.coalesce("rules", F.expr("cast(array() as array<struct<by:int,start:string,rule:string,verdict:string>>)")).alias("rules")), "hosts")
    rules_width = F.length(F.to_json("rules")) + F.length("host")
    fits = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    marked = pages.join(small(hosts, rules_width), "host").withColumn("_fit", fits)
    seeds = (marked.groupBy("host").agg(F.count_if(F.col("_fit.verdict") == "allow").alias("a"), F.count_if(F.col("_fit.verdict") == "block").alias("b")))
    linked = edges.select(F.col("dst").alias("host")).union(edges.select(F.col("src"))).distinct()
    seeds = linked.join(seeds, "host", "full").select("host", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    seeds = stored(seeds, "seeds")
    totals = seeds.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    seeds = seeds.crossJoin(F.broadcast(totals)).select("host", F.when(F.col("ta") > 0, F.col("a") / F.col("ta")).otherwise(0.0).alias("sa"), F.when(F.col("tb") > 0, F.col("b") / F.col("tb")).otherwise(0.0).alias("sb"))
    forward = edges.join(edges.groupBy("src").agg(F.sum("n").alias("t")), "src").select("src", "dst", (F.col("n") / F.col("t")).alias("share"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    back = back.join(back.groupBy("src").agg(F.sum("n").alias("t")), "src").select("src", "dst", (F.col("n") / F.col("t")).alias("share"))
    trust = propagate(stored(forward, "forward"), seeds.select("host", F.col("sa").alias("seed")), rounds, damping)
    distrust = propagate(stored(back, "back"), seeds.select("host", F.col("sb").alias("seed")), rounds, damping)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host")
    judged = stored(hosts.join(scores, "host", "left").select("host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "judged")
    by_graph = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return (pages.join(small(judged, rules_width), "host").withColumn("_fit", fits)
            .withColumns({"rule": F.col("_fit.rule"), "verdict": F.coalesce(F.col("_fit.verdict"), by_graph)}).drop("rules", "_fit"))
