"""URL filter: host and path rules first, then trust and distrust propagated over the links between hosts.

Built-in functions only. Personalised PageRank runs from trusted seeds along the links, and from blocked seeds
against them (who links to a blocked host is suspect), for a fixed number of steps; a host is blocked where its distrust
is more than a set part of both. Seeds are hosts by the share of their pages that an allow or a block rule decides. Links
are those of the pages' absolute hrefs to other hosts, and those between a host and the domains above it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Rules are a list in the plan; longer ones are refused.
MOST_RULES = 10_000
DAMPING, STEPS, THRESHOLD, LEAST = 0.85, 8, 0.5, 0.05
#: Java and RE2 read them alike: the host of an absolute or scheme-relative href; a user and a port beside a host; an address
#: that is no name (numbers, or in brackets).
LINK = r"""[Hh][Rr][Ee][Ff]\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


USER, PORT, ADDRESS = r"^.*@", r":[0-9]*$", r"^([0-9.]*|\[.*)$"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; then up to '?', '#' or the end."""
    at = F.locate("://", url)
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (n, rule, verdict) of the longest rule that fits host and path, or null. No shuffle: rules are in the plan."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def site(host: Column) -> Column:
    """The host that the graph knows: without user and port, which the pages' hosts keep."""
    return F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, "")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, w: links between different hosts by number of hrefs, and 1 each way between a host and the domain above
    it, and between that and the one above it in turn, up to two labels. Relative hrefs stay on their host, so
    they are no links; a base element's href is one like any other. Addresses have no domain above them."""
    host, _ = host_and_path(F.col("url"))
    linked = (
        pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("dst"))
        .select(site(F.col("src")).alias("src"), site(_lower(F.col("dst"))).alias("dst"))
        .filter("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    linked = written(linked)  # the pages' html is read once
    hosts = pages.select(site(host).alias("host")).filter("host != ''").distinct().union(linked.select("dst")).distinct()
    names = hosts.filter(~F.col("host").rlike(ADDRESS)).select(F.split("host", r"\.").alias("n"))
    level = names.filter("size(n) > 2").select("n", F.explode(F.sequence(F.lit(1), F.size("n") - 2)).alias("i"))
    join = lambda at: F.array_join(F.slice("n", at, F.size("n")), ".")
    up = level.select(join(F.col("i")).alias("src"), join(F.col("i") + 1).alias("dst")).distinct()
    return linked.union(up.select("src", "dst", F.lit(1.0))).union(up.select("dst", "src", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagated(links: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust. ``seeds`` has host, trust and distrust; mass at hosts without links out is dropped."""
    forward = links.groupBy("src").agg(F.sum("w").alias("s"))
    backward = links.groupBy("dst").agg(F.sum("w").alias("s"))
    edges = written(
        links.join(forward, "src").select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("w") / F.col("s")).alias("w"))
        .union(links.join(backward, "dst").select(F.lit("d"), F.col("dst"), F.col("src"), F.col("w") / F.col("s")))
    )
    start = written(seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").alias("r")), F.struct(F.lit("d").alias("kind"), F.col("distrust").alias("r")))).alias("x")).select("x.kind", "host", "x.r").filter("r > 0"))
    rank = start
    for step in range(steps):
        moved = rank.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.lit(damping) * F.col("r") * F.col("w")).alias("r"))
        rank = moved.union(start.select("kind", "host", F.lit(1 - damping) * F.col("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if step % 4 == 3:
            rank = written(rank)
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.col("r")).otherwise(0.0)).alias("distrust"))


def url_filter(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, least: float = LEAST) -> DataFrame:
    """One row per page: page_id, host, path, rule (null: none fits), verdict, and its host's trust and distrust.

    Null urls and urls without '://' have empty host and path; no rule fits them and the graph does not hold them: they
    are allowed. So are hosts that no seed reaches. In the graph hosts stand without user and port. Null html has no links. Of rules that fit the longest wins; equal
    lengths go to the greater text. Repeated pages each count. An empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), site(host).alias("site"), path.alias("path")).withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.count_if(F.col("m.verdict") == v) / F.count(F.lit(1))
    seeds = judged.filter("site != ''").groupBy(F.col("site").alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = written(propagated(written(host_links(pages)), seeds))  # its join with the pages can be split at a hot host
    bad = (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") >= least)
    verdict = F.coalesce(F.col("m.verdict"), F.when(bad, "block").otherwise("allow"))
    return judged.join(scores.withColumnRenamed("host", "site"), "site", "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
