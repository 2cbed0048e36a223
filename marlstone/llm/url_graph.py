"""URL filters: path rules, and trust and distrust carried over the links between hosts.

Links are absolute hrefs of the pages' HTML, counted per pair of hosts. Trust starts at hosts with a page
that an allow rule fits and follows the links; distrust starts at hosts with a page that a block rule fits
and follows them backwards. Both are personalised PageRanks, computed together as joins and sums over host
rows. A page without a rule is blocked where its host's distrust is at least ``threshold`` and above its
trust.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null
HTML has no links. Urls and HTML of any length are matched by expressions that do not backtrack over them. Repeated rows are judged alike. Empty tables give empty results. Columns of the input
are kept unless named like a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PathRule:
    """``spec`` is a host, then the path that it covers; the rule holds for subdomains too."""

    spec: str
    allow: bool

    @property
    def host(self) -> str:
        return self.spec.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.spec.partition("/")[2]


RULES = (
    PathRule("org/", True),
    PathRule("example.org/es/", False),
    PathRule("example.org/en/1", False),
    PathRule("com/fr/", True),
    PathRule("com/de/", False),
)
DAMPING = 0.85
#: Rounds of the SQL.
ROUNDS = 8
#: The largest change of a score after which the rounds end.
TOLERANCE = 1e-5
THRESHOLD = 0.01
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` to ``/ ? #``, and from there to ``? #``."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: tuple[PathRule, ...] = RULES) -> Column:
    """The longest rule that fits, as text; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.spec), r.spec)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.spec)).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: tuple[PathRule, ...] = RULES) -> DataFrame:
    host, path = split_url(F.col("url"))
    df = pages.drop("host", "path", "rule", "rule_allows", "verdict").withColumns({"host": host, "path": path})
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = [r.spec for r in rules if r.allow]
    return df.withColumn("rule_allows", F.when(F.col("rule").isNotNull(), F.col("rule").isin(*allowed)))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. A page's links are combined before the shuffle."""
    found = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1)).alias("to"))
    links = found.select(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(side, host, score) from ``seeds`` (side 1 trust, 0 distrust; host).

    Rounds go on until no score changes by more than ``TOLERANCE``, which the damping brings about, or for ``rounds``.

    Both directions are one set of weighted arcs, so a round is one join and one sum, combined before the
    shuffle. A round is written out, which bounds the plan and what a lost executor costs.
    """
    arcs = edges.select(F.lit(1).alias("side"), "src", "dst", "n").unionByName(
        edges.select(F.lit(0).alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = arcs.groupBy("side", "src").agg(F.sum("n").alias("total"))
    arcs = scratch.save(arcs.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "arcs")
    start = scratch.save(seeds.distinct().withColumn("score", F.lit(1.0 - damping)), "seeds")
    score = start
    if arcs.isEmpty():
        return score
    for i in count() if rounds is None else range(rounds):
        before = score
        moved = score.join(arcs, (score["side"] == arcs["side"]) & (score["host"] == arcs["src"])).select(score["side"], F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        score = scratch.save(moved.unionByName(start).groupBy("side", "host").agg(F.sum("score").alias("score")), f"round{i}")
        if rounds is None:
            old = before.select("side", "host", F.col("score").alias("_old"))
            change = score.join(old, ["side", "host"], "left").agg(F.max(F.abs(F.col("score") - F.coalesce("_old", F.lit(0.0))))).first()[0]
            if change is None or change <= TOLERANCE:
                break
    return score


def judge(pages: DataFrame, scratch: Scratch, rules: tuple[PathRule, ...] = RULES, threshold: float = THRESHOLD, rounds: int | None = None) -> DataFrame:
    """Every page with host, path, rule and verdict."""
    ruled = with_rules(pages, rules)
    edges = scratch.save(host_edges(ruled), "edges")
    seeds = ruled.where("rule_allows is not null and host <> ''").select(F.col("rule_allows").cast("int").alias("side"), "host").distinct()
    scores = propagate(edges, seeds, scratch, rounds=rounds)
    hosts = scores.groupBy("host").agg(
        F.round(F.sum(F.when(F.col("side") == 1, F.col("score")).otherwise(0.0)), 9).alias("trust"),
        F.round(F.sum(F.when(F.col("side") == 0, F.col("score")).otherwise(0.0)), 9).alias("distrust"),
    )
    bad = hosts.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("_bad"))
    narrow = ruled.drop("html") if "html" in ruled.columns else ruled
    # only pages without a rule ask the graph, and only hosts found bad answer
    joined = narrow.join(bad, (narrow["host"] == bad["_bad"]) & narrow["rule"].isNull(), "left")
    allow = F.coalesce(F.col("rule_allows"), F.col("_bad").isNull())
    return joined.withColumn("verdict", F.when(allow, "allow").otherwise("block")).drop("_bad", "rule_allows")
