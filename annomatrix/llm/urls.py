"""URL verdicts: rules on host and path first, and trust carried over links for the rest.

A host that no rule decides gets two scores over the graph of links between hosts: personalised PageRank from the hosts
of pages that a rule allows along the links, and from those of pages that a rule blocks against them, each host seeding
with its number of such pages. What a walk has at a host without links goes back to the seeds, and rounds go on until a
step moves less than TOLERANCE of the whole. A host is blocked where distrust is above RATIO times trust, and allowed
otherwise. A host of which rules decide half of the pages or fewer one way passes its seed on, but is judged itself by
what links bring it only; a host that nothing reaches is allowed.

Links are the href of the a and area elements of a page as its tree has them, outside comments and scripts: absolute
ones, those that begin with // and, under a base element of another host, relative ones. Other relative links stay on
their host and make no edge. Everything else is DataFrame joins and sums; a host's many links are summed before they are
shuffled.

A null URL or one without '://' has an empty host and path and is allowed. Pages of a null page_id and repeated pages
get a row each; repeated pages count again as seeds and links. A null html has no links, one of any length is read
whole. An empty table gives none. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import Node, parse
from .shared import materialize, scratch
from .skew import join_counted

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
TOLERANCE = 1e-4
PER_TABLE = 6
RATIO = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ABSOLUTE = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\]*)")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
LOWERED = str.maketrans(UPPER, LOWER)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), both null where none fits. A rule fits its host and all subdomains if the path starts with
    its own; the longest wins, and of equal ones the first."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last to be added is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(kind)).otherwise(verdict)
    return which, verdict


def linked_hosts(page: str | None) -> list[str]:
    """The host of every link of a page that names one, itself or by the page's base."""
    if not page or "href" not in page and "HREF" not in page and "href" not in page.lower():
        return []
    hrefs, base, todo = [], None, [parse(page)]
    while todo:
        node = todo.pop()
        href = node.attributes.get("href")
        if href is not None and node.tag in ("a", "area", "base"):
            href = re.sub(r"[\t\r\n]", "", href).strip()
            if node.tag == "base":
                base = href if base is None else base
            else:
                hrefs.append(href)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    host = lambda href: m[1].translate(LOWERED) if (m := ABSOLUTE.match(href)) else None
    relative = host(base or "")
    found = [relative if (h := host(x)) is None and not SCHEME.match(x) else h for x in hrefs]
    return [h for h in found if h]


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): numbers of links from the pages of one host to another."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([linked_hosts(p) for p in batch], dtype=object)

    found = pages.select(host_of(F.col("url")).alias("src"), F.col("html").cast("string").alias("html")).where("src <> ''")
    links = found.select("src", F.explode(run("html")).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def page_rank(links: DataFrame, seeds: DataFrame, name: str, rounds: int | None = None, damping: float = DAMPING, back: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score) from links (src, dst, n) and seeds (host, mass), after so many rounds or, without a number, once
    a round moves less than tolerance in all. What hosts without links have leaves the walk, or goes back to the seeds.
    Scores are written out every few rounds, which keeps the plan short and survives lost executors."""
    total = seeds.agg(F.sum("mass").alias("total"))
    start = seeds.join(F.broadcast(total)).select("host", (F.col("mass") / F.col("total")).alias("score"))  # one row
    if links.isEmpty() or seeds.isEmpty():
        return start
    with scratch(links.sparkSession) as kept:
        out = links.groupBy("src").agg(F.sum("n").alias("all"))
        share = materialize(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), f"{name}-links")
        start = materialize(start, f"{name}-seeds")
        score, done, moved_by = start, 0, 1.0
        while done < rounds if rounds is not None else moved_by >= tolerance:
            before = score
            for _ in range(min(PER_TABLE, rounds - done) if rounds is not None else PER_TABLE):
                before = score
                moved = share.join(score.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
                restart = start.select("host", (F.col("score") * (1 - damping)).alias("score"))
                score = moved.unionByName(restart).groupBy("host").agg(F.sum("score").alias("score"))
                done += 1
            both = before.withColumnRenamed("score", "before").join(score, "host", "full").select("host", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("score", F.lit(0.0)).alias("score"))
            both = materialize(both, f"{name}-score")
            moved_by = both.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] if rounds is None else 0.0
            score = both.select("host", "score")
        kept.append(both if done else start)
    if not back:
        return score
    # A walk that sends this mass back has the same scores but for a common factor, which makes them sum to 1.
    return score.join(F.broadcast(score.agg(F.sum("score").alias("all")))).select("host", (F.col("score") / F.col("all")).alias("score"))


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    which, verdict = rule_columns(host, path, rules)
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), which.alias("rule"), verdict.alias("by_rule"))
    links = materialize(host_links(pages), "host-links")
    counted = {k: F.count(F.when(F.col("by_rule") == k, 1)).alias(k) for k in ("allow", "block")}
    counts = materialize(judged.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), *counted.values()), "url-seeds")
    seeds = lambda kind: counts.where((F.col(kind) > 0) & (F.col("host") != "")).select("host", F.col(kind).alias("mass"))
    trust = page_rank(links, seeds("allow"), "trust", rounds, back=True)
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = page_rank(against, seeds("block"), "distrust", rounds, back=True)
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    both = both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    # Of a host with half of its pages decided or fewer, only what comes over links counts: its score less its own seed.
    sums = counts.agg(*[F.sum(k).alias(f"all_{k}") for k in ("allow", "block")])  # one row
    own = counts.join(F.broadcast(sums))
    part = lambda kind: F.when(2 * F.col(kind) > F.col("pages"), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(kind, f"all_{kind}"), F.lit(0.0)))
    own = own.select("host", part("allow").alias("own_trust"), part("block").alias("own_distrust"))
    both = both.join(own, "host", "left").join(F.broadcast(_restarts(trust, distrust, links)))
    net = lambda kind: F.greatest(F.col(kind) - F.coalesce(f"own_{kind}", F.lit(0.0)) * F.col(f"{kind}_restart"), F.lit(0.0))
    both = both.select("host", net("trust").alias("trust"), net("distrust").alias("distrust"))
    # One row per host with its number of pages; those of many pages are not shuffled.
    hosts = counts.select("host", F.col("pages").alias("n")).join(both, "host", "left")
    out = join_counted(judged, hosts, ["host"], "url-hosts")
    found = F.when(F.coalesce(F.col("distrust") > F.lit(ratio) * F.col("trust") + 1e-12, F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", found).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def _restarts(trust: DataFrame, distrust: DataFrame, links: DataFrame) -> DataFrame:
    """One row: which share of all goes to the seeds in a round, of either walk: all that links do not carry on."""
    from_of = lambda end: links.select(F.col(end).alias("host")).distinct()
    share = lambda score, end, name: score.join(from_of(end), "host", "left_semi").agg((1 - DAMPING * F.coalesce(F.sum("score"), F.lit(0.0))).alias(name))
    return share(trust, "src", "trust_restart").join(F.broadcast(share(distrust, "dst", "distrust_restart")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
