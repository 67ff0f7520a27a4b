"""URL filters: rules for hosts and paths, and for all else trust that spreads over links.

A host is a seed of trust by the share of its pages that rules allow; trust follows links
(personalised PageRank, not scaled down, so that a seed keeps its share). It is a seed of
distrust by the share that rules block; distrust goes against links, as who links to a bad host
is suspect. A host whose distrust exceeds its trust by more than LIMIT is blocked: without any
links, one with more than half of its pages blocked on balance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import settled

DAMPING = 0.85
CUT_EVERY = 4
# Rounds go on until CUT_EVERY of them add less than this to all hosts together. What further
# rounds would add to any host is then less than 1.1 times this.
TOLERANCE = 1e-6
LIMIT = 0.5
# Scores are compared after rounding, so that the order of a sum does not show.
DIGITS = 12

# Links to hosts, with a scheme or that of the page: quoted, and without quotes.
_TO_HOST = "((?:[a-z][a-z0-9+.-]*:)?//"
QUOTED = f"(?i)href[ \\t\\r\\n]*=[ \\t\\r\\n]*[\"'][ \\t\\r\\n]*{_TO_HOST}[^\"']*)[\"']"
BARE = f"(?i)href[ \\t\\r\\n]*=[ \\t\\r\\n]*{_TO_HOST}[^ \\t\\r\\n>]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path prefix, allow or block


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(rules: Sequence[Rule], pick) -> Column:
    """pick(rule) of the longest rule that fits `host` and `path`; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        host, path, _ = rule
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(pick(rule))).otherwise(out)
    return out


def _judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    placed = pages.select(
        F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    return placed.select(
        "*",
        _by_rule(rules, lambda r: r[0] + r[1]).alias("rule"),
        _by_rule(rules, lambda r: r[2]).alias("said"),
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links): links between different hosts, counted."""
    found = F.concat(*(F.regexp_extract_all(F.col("html"), F.lit(x), F.lit(1)) for x in (QUOTED, BARE)))
    named = pages.select(host_of(F.col("url")).alias("source"), F.explode(found).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("same:"), "link")).otherwise(F.col("link"))
    ends = named.select("source", host_of(whole).alias("target"))
    return ends.where("source <> target AND source <> '' AND target <> ''").groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("links")
    )


def _spread(seeds: DataFrame, links: DataFrame, tolerance: float) -> DataFrame:
    """(host, mass) of PageRank from `seeds` (host, mass) along (source, target, part), to a tolerance.

    A host without links out passes nothing on. Mass is summed before it is joined, so a host
    that everyone links to is one row. Every round only adds mass, so the sum of all shows what
    changed.
    """
    mass = settled(seeds)
    total = mass.agg(F.sum("mass")).first()[0] or 0.0
    while True:
        before = total
        for _ in range(CUT_EVERY):
            moved = mass.join(links, mass["host"] == links["source"]).select(
                F.col("target").alias("host"), (F.col("mass") * F.col("part") * DAMPING).alias("mass")
            )
            mass = seeds.unionByName(moved).groupBy("host").agg(F.sum("mass").alias("mass"))
        mass = settled(mass)
        total = mass.agg(F.sum("mass")).first()[0] or 0.0
        if total - before < tolerance:
            return mass


def host_scores(judged: DataFrame, links: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches."""
    seeds = settled(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("said") == "allow").alias("allowed"),
            F.count_if(F.col("said") == "block").alias("blocked"),
        )
    )

    def seeded(column: str) -> DataFrame:
        return seeds.where(F.col(column) > 0).select("host", (F.col(column) / F.col("pages")).alias("mass"))

    links = settled(links)

    def along(source: str, target: str) -> DataFrame:
        out = links.groupBy(source).agg(F.sum("links").alias("all"))
        return links.join(out, source).select(
            F.col(source).alias("source"), F.col(target).alias("target"), (F.col("links") / F.col("all")).alias("part")
        )

    trust = _spread(seeded("allowed"), along("source", "target"), tolerance).select("host", F.col("mass").alias("trust"))
    distrust = _spread(seeded("blocked"), along("target", "source"), tolerance).select(
        "host", F.col("mass").alias("distrust")
    )
    return trust.join(distrust, "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def judge_pages(pages: DataFrame, rules: Sequence[Rule], tolerance: float = TOLERANCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The verdict is that of the longest rule that fits, else the host's: block where its
    distrust exceeds its trust by more than LIMIT, allow otherwise. A null url and one without
    :// have an empty host and path, which no rule and no link reaches. A null html has no
    links. Repeated pages count as often as they are there; other columns are not read.
    """
    judged = settled(_judged(pages, rules))
    scores = host_scores(judged, host_links(pages), tolerance)
    bad = F.round(F.col("distrust") - F.col("trust"), DIGITS) > LIMIT
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
