"""URL filtering: explicit rules, then trust and distrust propagated over the links between hosts.

A rule (host, path) fits its host and all subdomains when the url's path starts with the rule's; the longest wins. Pages that
no rule judges take the verdict of their host: every host starts with the share of its pages that rules allow (trust) and
block (distrust). Trust flows along links, divided by a host's links; distrust flows against them, from a host to those that
link to it, divided by its incoming links. This is personalised PageRank, scaled so that a seed without links keeps its share.
A host is blocked when its distrust exceeds its trust by more than ``margin``. Links are the targets of ``a`` elements; user
names, ports and a final dot of a host count neither there nor in the hosts of pages.

All of it is DataFrame operations. Links are counted by host pair with partial aggregates. Each step moves on what arrived in
the step before, by one join and one aggregate over hosts and links, written to the shared folder, until all that still moves
is at most ``close``; as each step leaves at most ``damping`` of it, the steps end at any graph, some 14 later for ten times
the hosts. Pages never move: the blocked
hosts meet them by a join whose page side is first reduced by a bitmap of bounded size, and which AQE can split.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no
links; repeated rows are judged alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, marked_by

#: Rules as (verdict, rule), a rule being a host and the start of a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s(?:[^<>]*?\s)??href\s*+=\s*+["']?\s*+(?:https?:)?//([^/?#"'\s<>]+)"""


def graph_host(host: Column) -> Column:
    """The host without user name, port and final dot, by which pages and links meet."""
    return F.regexp_replace(F.regexp_replace(F.translate(host, UPPER, LOWER), r"^.*@|:[0-9]*$", ""), r"\.$", "")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"(?s)^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judged(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds host, path, rule and the rule's verdict to pages."""
    host, path = host_and_path(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, start = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("by_rule", verdict)


def host_scores(pages: DataFrame, work: Workspace, damping: float = 0.85, close: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) of the hosts of judged pages, and of those they link to, by propagation."""
    share = lambda what: F.avg(F.when(F.col("by_rule") == what, 1.0).otherwise(0.0))
    pages = pages.select(graph_host(F.col("host")).alias("host"), "by_rule", "html").where("host != ''")
    seeds = pages.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "score")).where("score > 0")
    seeds = work.write(seeds.select("kind", "host", "score"), "seeds")
    links = pages.where("html is not null").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select("host", graph_host(F.col("to")).alias("to")).where("host != to and to != ''").groupBy("host", "to").agg(F.count(F.lit(1)).alias("n"))
    links = work.write(links, "links")
    arcs = links.select(F.lit("trust").alias("kind"), F.col("host").alias("source"), F.col("to").alias("target"), "n").union(links.select(F.lit("distrust").alias("kind"), F.col("to").alias("source"), F.col("host").alias("target"), "n"))
    total = arcs.groupBy("kind", "source").agg(F.sum("n").alias("total"))
    arcs = work.write(arcs.join(total, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("total")).alias("weight")), "arcs")
    arrived, scores = [seeds], seeds
    while (arrived[-1].agg(F.sum("score")).first()[0] or 0.0) > close:
        moved = arrived[-1].join(arcs, ["kind", "host"]).groupBy("kind", F.col("target").alias("host")).agg(F.sum(damping * F.col("score") * F.col("weight")).alias("score"))
        arrived.append(work.write(moved, "arrived"))
        if len(arrived) > 8:  # what has arrived so far becomes one table, so that the plan stays small
            scores = work.write(reduce(DataFrame.union, [scores, *arrived[1:]]).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
            arrived = arrived[-1:]
    scores = reduce(DataFrame.union, [scores, *arrived[1:]])
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return scores.groupBy("host").agg(score("trust"), score("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, margin: float = 0.5) -> DataFrame:
    """Every row's page_id, host, path, rule and verdict (allow or block)."""
    rules = RULES if rules is None else rules
    work = Workspace(pages.sparkSession, "url-filter")
    scores = host_scores(judged(pages.select("url", "html"), rules), work)
    bad = work.write(scores.where(F.col("distrust") - F.col("trust") > margin).select(F.col("host").alias("bad"), F.xxhash64("host").alias("key")), "blocked")
    rows = work.write(judged(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "by_rule"), "judged")
    open_rows = rows.where("by_rule is null").withColumn("graph", graph_host(F.col("host")))
    marked = marked_by(open_rows, F.xxhash64("graph"), bad, "key", "maybe")
    verdict = lambda v: ["page_id", "host", "path", "rule", v.alias("verdict")]
    maybe = marked.where("maybe").join(bad, F.col("graph") == F.col("bad"), "left")
    return rows.where("by_rule is not null").select(*verdict(F.col("by_rule"))).union(marked.where("not maybe").select(*verdict(F.lit("allow")))).union(maybe.select(*verdict(F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))))
