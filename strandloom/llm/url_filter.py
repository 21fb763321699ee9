"""URL filters: rules first, link-graph propagation for what no rule decides.

Rules fit a host with its subdomains and a path's beginning; the longest that fits decides. Pages
that rules allow make their host a trusted seed, pages that rules block a blocked seed. Trust flows
along links between hosts by personalised PageRank from the trusted seeds; distrust flows against
them, from the blocked seeds to the hosts that link to them. Besides links, each host is tied to the
host one label up, whether that has pages or not, so the subdomains of one site reach one another.

The same flows from all pages tell how much of what reaches a host, its own pages included, comes
from seeds. A host whose share of distrust exceeds its share of trust by a threshold has its undecided
pages blocked. Everything is DataFrame operations on one row per host or per pair of linked hosts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, scratch, settle, small

#: (host, beginning of the path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Share of the mass that links hand on, and of a seed's mass that may not have settled at the end.
DAMPING, RESIDUAL = 0.85, 0.01
#: Rounds until no more than the residual is on its way, and rounds between two written tables.
ROUNDS, SETTLE_EVERY = math.ceil(math.log(RESIDUAL) / math.log(DAMPING)), 8
#: Share of distrust less share of trust above which a host's undecided pages are blocked.
THRESHOLD = 0.3
#: Urls in links: what follows "//", with a scheme before it or without.
LINKED = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Hosts are broadcast up to this number; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for of, start, verdict in rules:
        by_host.setdefault(of, []).append((start, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entry = lambda of, start, verdict: F.struct(F.lit(len(of + start)).alias("size"), F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(start).alias("start"))
    known = F.create_map(*[x for of, own in by_host.items() for x in (F.lit(of), F.array(*[entry(of, s, v) for s, v in own]))])
    labels = F.split(host, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    held = F.flatten(F.filter(F.transform(endings, lambda e: F.try_element_at(known, e)), lambda x: x.isNotNull()))
    fits = F.filter(held, lambda r: path.startswith(r["start"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(F.size(fits) > 0, best)


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight): links from a host's pages to other hosts, with a scheme or without, and a
    host's tie to the host one label up, in either direction, if that has more than one label."""
    own = pages.filter("host <> ''")
    linked = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINKED), F.lit(1))
    links = own.select(F.col("host").alias("src"), F.explode(linked).alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("src <> dst")
    ties = own.select("host").distinct().select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.([^.]+\..+)$", 1).alias("dst")).filter("dst <> ''")
    ties = ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.unionByName(ties).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(hosts: DataFrame, links: DataFrame, forward: list[str], backward: list[str], rounds: int = ROUNDS) -> DataFrame:
    """hosts with their seeds replaced by masses: personalised PageRank from the seeds of the columns
    ``forward`` along links and of ``backward`` against them, all in the same rounds.

    A host without links to follow keeps what it has, so the mass of all hosts stays that of the seeds.
    """
    shares = lambda df, by, name: df.join(df.groupBy(by).agg(F.sum("weight").alias("__sum")), by).withColumn(name, F.col("weight") / F.col("__sum")).drop("__sum")
    both = shares(shares(links, "src", "along"), "dst", "against")
    edges = both.select("src", "dst", "along", F.lit(0.0).alias("against")).unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("along"), "against"))
    edges = edges.groupBy("src", "dst").agg(F.sum("along").alias("along"), F.sum("against").alias("against"))
    ways = {c: way for way, own in (("along", forward), ("against", backward)) for c in own}
    # a host that leads nowhere hands its mass to itself, so one join and one sum make a round
    leads = edges.groupBy(F.col("src").alias("host")).agg(F.max("along").alias("along"), F.max("against").alias("against"))
    stays = lambda way: F.when(F.coalesce(F.col(way), F.lit(0.0)) > 0, 0.0).otherwise(1.0)
    loops = hosts.join(leads, "host", "left").select(F.col("host").alias("src"), F.col("host").alias("dst"), stays("along").alias("along"), stays("against").alias("against"))
    edges = settle(edges.unionByName(loops.filter("along > 0 OR against > 0")), "shares")
    seeds = settle(hosts.select("host", *[F.col(c).cast("double").alias(f"{c}_seed") for c in ways]), "seeds")
    state = seeds.select("host", *[F.col(f"{c}_seed").alias(c) for c in ways])
    for turn in range(1, rounds + 1):
        flow = edges.join(state.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(*[F.sum(F.col(c) * F.col(way)).alias(c) for c, way in ways.items()])
        state = seeds.join(flow, "host", "left").select("host", *[((1 - DAMPING) * F.col(f"{c}_seed") + DAMPING * F.coalesce(c, F.lit(0.0))).alias(c) for c in ways])
        if turn % SETTLE_EVERY == 0:
            state = settle(state, "mass")
    return state.select("host", *ways)


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages.

    Null urls and urls without "://" have an empty host and path and are allowed, as are hosts that
    nothing is known of. Of rules of one length the one with the later text decides. Rows may repeat and
    are judged each; other columns play no part. An empty table gives an empty one.
    """
    with scratch() as own:
        parsed = pages.select(F.col(id_column).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
        judged = parsed.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
        # verdicts by rule are settled, links come from one more pass over the same columns
        decided = own.keep(judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("decided")), "pages")
        links = settle(host_links(parsed, "html"), "links")
        count = lambda verdict: F.count(F.when(F.col("decided") == verdict, 1))
        seeds = decided.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), count("allow").alias("trust"), count("block").alias("distrust"))
        others = links.select(F.col("dst").alias("host")).distinct().join(seeds, "host", "left_anti").select("host", *[F.lit(0).cast("long").alias(c) for c in ("pages", "trust", "distrust")])
        hosts = seeds.unionByName(others).withColumn("pages_back", F.col("pages"))
        masses = propagate(settle(hosts, "hosts"), links, ["trust", "pages"], ["distrust", "pages_back"])
        share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
        shares = masses.select("host", share("trust", "pages").alias("trust"), share("distrust", "pages_back").alias("distrust"))
        shares = own.keep(shares.join(decided.select("host").distinct(), "host", "left_semi"), "host_scores")
    found = decided.join(small(shares, MOST_BROADCAST), "host", "left")
    trust, distrust = F.round(F.coalesce("trust", F.lit(0.0)), 6), F.round(F.coalesce("distrust", F.lit(0.0)), 6)
    verdict = F.coalesce("decided", F.when(distrust - trust > threshold, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
