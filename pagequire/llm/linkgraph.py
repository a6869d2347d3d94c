"""Verdicts on urls: rules first, and for what no rule fits, trust and distrust that spread over the links between hosts.

Trust is a personalised PageRank from hosts with allowed pages along links; distrust starts at hosts with blocked pages
and goes against the links, from a page to those that point at it. A host is blocked where distrust outweighs trust.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict), both null where none fits; the longest rule that fits wins, of equally long ones the first."""
    rule = by = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, by = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(by)
    return rule, by


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, summed up, from `pages(host, html)`; a page's relative links stay on its host."""
    target = F.regexp_extract_all("html", F.lit(r"(?is)\b(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'<>\s]+)"), 1)
    links = pages.filter("host <> '' AND html IS NOT NULL").select(F.col("host").alias("src"), F.explode(target).alias("dst"))
    return links.select("src", _lower(F.col("dst")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, mass): personalised PageRank over `links(src, dst, n)` from `seeds(host, seed)`, whose seeds add up to 1.

    The mass of a host without links returns to the seeds. Each round joins the masses to the links and sums up what
    arrives by host before the shuffle; lineage is cut each time. Rounds go on until all masses together are within
    `tolerance` of where they would end, which takes log(tolerance / 2) / log(damping) rounds at most.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    share = cut(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")))
    if share.isEmpty():
        return seeds.select("host", F.col("seed").alias("mass"))
    mass = seeds.select("host", F.col("seed").alias("mass"))
    for _ in range(math.ceil(math.log(tolerance / 2) / math.log(damping))):
        sent = mass.join(share, mass.host == share.src).select(F.col("dst").alias("host"), (damping * F.col("mass") * F.col("w")).alias("mass"))
        back = mass.join(share.select(F.col("src").alias("host")).distinct(), "host", "left_anti").agg((damping * F.coalesce(F.sum("mass"), F.lit(0.0))).alias("lost"))
        lost = back.first()["lost"]
        reset = seeds.select("host", (F.col("seed") * (1 - damping + lost)).alias("mass"))
        old = mass.select("host", (-F.col("mass")).alias("mass"))
        mass = cut(sent.unionByName(reset).groupBy("host").agg(F.sum("mass").alias("mass")))
        change = mass.unionByName(old).groupBy("host").agg(F.sum("mass").alias("d")).agg(F.sum(F.abs("d"))).first()[0] or 0.0
        if change * damping / (1 - damping) < tolerance:
            break
    return mass


def verdicts(pages: DataFrame, rules: Sequence[Rule], damping: float = 0.85, tolerance: float = 1e-6, ratio: float = 1.0, few: int = 1_000_000) -> DataFrame:
    """`pages(url, html)` with host, path, rule, verdict, trust and distrust; columns of these names are replaced, all others stay.

    Seeds are the hosts with pages that a rule allows or blocks, by the number of such pages. Where no rule fits, a host
    is blocked if distrust > ratio * trust, both by mass, scaled by how many pages seeded it; unreached hosts and urls
    without a host are allowed. Null urls have an empty host and path. Every row is kept, repeated ones too; an empty
    table gives an empty one. few: up to so many hosts with trust or distrust (some 50 MB) are broadcast to the pages.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    at, where = host(F.col("url")), path(F.col("url"))
    rule, by = ruled(at, where, rules)
    found = pages.select(at.alias("host"), by.alias("by"), "html")
    seeds = cut(found.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("by") == "allow").alias("good"), F.count_if(F.col("by") == "block").alias("bad")))
    sums = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    links = cut(edges(found))
    masses = []
    for name, col, way in (("trust", "good", links), ("distrust", "bad", links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        total = float(sums[col] or 0)
        from_ = seeds.filter(F.col(col) > 0).select("host", (F.col(col) / F.lit(max(total, 1.0))).alias("seed"))
        masses.append(spread(way, from_, damping, tolerance).select("host", (F.col("mass") * total).alias(name)))
    reached = masses[0].join(masses[1], "host", "full").select(F.col("host").alias("host_"), F.coalesce("trust", F.lit(0.0)).alias("trust_"), F.coalesce("distrust", F.lit(0.0)).alias("distrust_"))
    reached = cut(reached)
    if reached.count() <= few:
        reached = F.broadcast(reached)
    # the url's own columns are worked out in a struct, so that no column of the pages can clash with them
    rows = pages.select(F.struct(*[F.col(c) for c in pages.columns if c.lower() not in new]).alias("page_"), F.struct(at.alias("host"), where.alias("path"), rule.alias("rule"), by.alias("by")).alias("url_"))
    full = rows.join(reached, F.col("url_.host") == F.col("host_"), "left").na.fill(0.0, ["trust_", "distrust_"])
    method = F.when(F.col("distrust_") > ratio * F.col("trust_"), "block").otherwise("allow")
    return full.select("page_.*", "url_.host", "url_.path", "url_.rule", F.coalesce("url_.by", method).alias("verdict"), F.col("trust_").alias("trust"), F.col("distrust_").alias("distrust"))
