"""URL filters: rules of hosts and paths, and trust and distrust spread over the link graph of hosts for what no rule fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a score that stays with the seeds, and the distrust from which a host is blocked.
RESTART, THRESHOLD = 0.15, 0.075
#: Rounds go on until no score changes by TOLERANCE; each leaves at most 1 - RESTART of the changes before, so MOST_ROUNDS are never needed.
TOLERANCE, MOST_ROUNDS = 1e-6, 200


def host_of(url) -> F.Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url) -> F.Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``?`` or ``#``; both empty without ``://``."""
    own = pages.withColumn("__url", F.col("url").cast("string"))
    return own.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))}).drop("__url")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host and of its parent domains, by an equi-join on the suffixes of the host."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    found = hosts.select("host", suffix.alias("rule_host")).join(rules.withColumnRenamed("host", "rule_host"), "rule_host")
    entry = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("size"), F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "action")
    return found.groupBy("host").agg(F.collect_set(entry).alias("rules"))


#: The address in a link, up to the end of its tag. What stands before it holds no angle bracket, and nothing is tried twice,
#: so a page takes time in proportion to its length, whatever is left open in it.
LINK = r"""(?i)<a\s[^<>]*?\bhref\s*+=\s*+["']?+\s*+((?:[a-z][a-z0-9+.-]*+:)?//[^\s"'<>]++)"""


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links of pages to other hosts, counted for each pair of hosts. A tag with an angle bracket before its address is none."""
    target = F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), 1))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), target.alias("target"))
    links = links.select("src", F.regexp_replace("target", r"^//", "http://").alias("url"))
    ends = with_host_and_path(links).select("src", F.col("host").alias("dst"))
    return ends.filter("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, restart: float = RESTART) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    ``seeds`` is (host, trust, distrust). Trust goes along links and distrust against them, each divided
    by the sender's links in that direction. Seeds are taken as they are, so scores are no probabilities: they add up to
    the sum of the seeds at most. Both kinds share the rounds; every round aggregates before it
    shuffles and ends in a shared table, which also holds what each score was before. They end when no score changes by TOLERANCE, or after ``rounds`` if that is given.
    """
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "links")
    both = forward.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("u"), F.col("src").alias("v"), "links"))
    totals = both.groupBy("kind", "u").agg(F.sum("links").alias("total"))
    share = written(both.join(totals, ["kind", "u"]).select("kind", "u", "v", (F.col("links") / F.col("total")).alias("share")), "shares")
    start = seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "seed"))
    start = written(start.filter("seed > 0"), "seeds")
    zero = F.lit(0.0)
    scores = start.select("kind", F.col("host").alias("u"), (F.col("seed") * restart).alias("score"))
    held = None
    for _ in range(0 if share.isEmpty() else rounds or MOST_ROUNDS):
        sent = scores.join(share, ["kind", "u"]).groupBy("kind", "v").agg(F.sum(F.col("score") * F.col("share") * (1 - restart)).alias("got"))
        seeded = start.select("kind", F.col("host").alias("v"), (F.col("seed") * restart).alias("got"))
        added = seeded.unionByName(sent).withColumn("was", zero).unionByName(scores.select("kind", F.col("u").alias("v"), zero.alias("got"), F.col("score").alias("was")))
        new = written(added.groupBy("kind", F.col("v").alias("u")).agg(F.sum("got").alias("score"), F.sum("was").alias("was")), "scores")
        change = new.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        new = new.drop("was")
        if held is not None:
            dropped(held)
        scores = held = new
        if change is None or change < TOLERANCE:
            break
    else:
        if rounds is None and not share.isEmpty():
            raise RuntimeError("scores did not settle")
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return scores.groupBy(F.col("u").alias("host")).agg(score("trust"), score("distrust"))


def judged(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each row of ``pages`` (page_id, url, html).

    The longest rule that fits decides: its host is the url's or a parent domain, and the url's path starts with its path. For the
    rest, a host is seeded with the shares of its pages that rules allow and block; trust and
    distrust spread over links between hosts; a page is blocked if its host's distrust reaches ``threshold``, which is
    what a host gets of which half the pages are blocked, and exceeds its trust. Urls without host have no rule and are
    allowed. A null html has no links; repeated rows give repeated rows and count as pages of their own; of rules of equal length
    that fit the larger in order of code points counts; further columns are ignored. Hot hosts are pre-aggregated for the graph; only the join back to pages is by host, with
    a table of one row for each host.
    """
    spark = pages.sparkSession
    placed = with_host_and_path(pages.select("page_id", "url", "html"))
    table = spark.createDataFrame([(a, h, p) for a, h, p in rules], "action string, host string, rule_path string")
    paths = placed.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    fitting = written(paths.join(host_rules(paths, table), "host", "left"), "hosts")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    ruled = placed.join(fitting.select("host", "rules"), "host", "left").withColumn("__best", best)
    seeds = ruled.filter("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("__best.action") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("__best.action") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    scores = propagated(seeds, written(link_edges(placed), "links"))
    hosts = written(fitting.join(scores, "host", "left"), "hosts")
    out = placed.join(hosts.select("host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "host", "left").withColumn("__best", best)
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.action", method).alias("verdict"), "trust", "distrust")
