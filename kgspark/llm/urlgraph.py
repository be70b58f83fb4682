"""URL filters: rules first, then trust and distrust carried over the host link graph.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's path; the longest fitting rule decides. Other pages get their host's verdict: personalised PageRank runs from
the hosts of allowed pages along links, and from the hosts of blocked pages against links; a host is blocked where its
distrust reaches ``BLOCK_AT`` of the two scores' sum, and allowed where neither score reaches it.

The scores are sums over walks: each round carries what the last one brought to the next hosts. Rounds go on until all
that later rounds could still bring is under ``TOLERANCE`` of the whole and the last round reached no new host, so a
chain of any length is followed to its end. Where links run in circles, scores are exact to that tolerance.

Column functions and joins only. Links are counted by (from, to) host before anything else, so a hub is one row a
partner; scores are joined on hosts and summed with partial aggregates. Hosts' verdicts meet pages by host and a part
of the page's id, so the pages of one host are spread. Null urls or urls without ``://`` have an empty host and path,
fit no rule and are allowed; null html has no links; repeated pages are judged alike and count as often as they occur,
as seeds and as links. Very long urls and pages are read whole. An empty table gives an empty result; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import cut

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
#: What later rounds may still bring, as a share of all trust or distrust.
TOLERANCE = 1e-6
#: Parts over which the pages of a host are spread when they meet its verdict.
SPREAD = 32
BLOCK_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruling (null where no rule fits)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = ruling = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruling = F.when(fits, F.lit(verdict)).otherwise(ruling)
    return rows.withColumns({"rule": rule, "ruling": ruling})


def links(pages: DataFrame) -> DataFrame:
    """Counted links between different hosts: a, b, n."""
    found = pages.where(F.contains("html", F.lit("//"))).select(
        host_of(F.col("url")).alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b")
    )
    return (
        found.select("a", F.translate("b", UPPER, LOWER).alias("b"))
        .where("a <> b and a <> ''")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )


def host_scores(judged: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust after propagation from the ruled pages' hosts."""
    seeds = cut(judged.where("ruling is not null and host <> ''").groupBy("ruling", "host").agg(F.count("*").alias("n")))
    total = seeds.groupBy("ruling").agg(F.sum("n").alias("all"))
    # Two rows: one a verdict.
    term = seeds.join(F.broadcast(total), "ruling").select("ruling", "host", (F.col("n") / F.col("all") * (1 - DAMPING)).alias("score"))
    scores = cut(term)
    edges = cut(edges)
    if not edges.isEmpty():
        out = edges.groupBy("a").agg(F.sum("n").alias("all"))
        into = edges.groupBy("b").agg(F.sum("n").alias("all"))
        along = edges.join(out, "a").select(F.lit("allow").alias("ruling"), F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("all") * DAMPING).alias("w"))
        against = edges.join(into, "b").select(F.lit("block"), "b", "a", F.col("n") / F.col("all") * DAMPING)
        moves = cut(along.union(against))
        term, reached = scores, scores.count()
        while True:
            sent = moves.join(term, ["ruling", "host"]).select("ruling", F.col("to").alias("host"), (F.col("w") * F.col("score")).alias("score"))
            term = cut(sent.groupBy("ruling", "host").agg(F.sum("score").alias("score")))
            left = max((r["left"] for r in term.groupBy("ruling").agg(F.sum("score").alias("left")).collect()), default=0.0)
            if not left:
                break
            scores = cut(scores.union(term).groupBy("ruling", "host").agg(F.sum("score").alias("score")))
            before, reached = reached, scores.count()
            if left * DAMPING / (1 - DAMPING) < tolerance and reached == before:
                break
    side = lambda r: F.sum(F.when(F.col("ruling") == r, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(side("allow").alias("trust"), side("block").alias("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    judged = ruled(pages, rules)
    scores = host_scores(judged, links(pages))
    blocked = scores.where((F.col("distrust") >= BLOCK_AT * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") > 0))
    blocked = blocked.select("host", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), F.lit("block").alias("spread"))
    part = F.pmod(F.xxhash64("page_id", "path"), F.lit(SPREAD)).cast("int")
    columns = ["page_id", "host", "path", "rule"]
    other = judged.where("ruling is null").withColumn("part", part).join(blocked, ["host", "part"], "left")
    return judged.where("ruling is not null").select(*columns, F.col("ruling").alias("verdict")).unionByName(
        other.select(*columns, F.coalesce("spread", F.lit("allow")).alias("verdict"))
    )


def sql(rules=RULES, rounds: int = 90) -> str:
    """The same as SQL, with a number of rounds that brings the rest under the tolerance (0.85 to that power)."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {rows}),
u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
j AS (SELECT u.*, (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM u),
jj AS (SELECT j.*, r.v AS ruling FROM j LEFT JOIN rules r ON r.h || r.p = j.rule),
c AS (SELECT ruling, host, count(*) AS n FROM jj WHERE ruling IS NOT NULL AND host <> '' GROUP BY ALL),
seeds AS (SELECT ruling, host, n / sum(n) OVER (PARTITION BY ruling) AS seed FROM c),
e AS (SELECT a, b, count(*) AS n FROM (
  SELECT host AS a, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS b FROM u)
  WHERE a <> b AND a <> '' GROUP BY ALL),
moves AS (SELECT 'allow' AS ruling, a AS host, b AS dst, n / sum(n) OVER (PARTITION BY a) AS w FROM e
  UNION ALL SELECT 'block', b, a, n / sum(n) OVER (PARTITION BY b) FROM e),
walk(k, ruling, host, score) AS (SELECT 0, ruling, host, seed * {1 - DAMPING} FROM seeds
  UNION ALL SELECT any_value(k) + 1, w.ruling, m.dst, sum(m.w * w.score * {DAMPING}) FROM walk w JOIN moves m USING (ruling, host) WHERE k < {rounds} GROUP BY w.ruling, m.dst),
f AS (SELECT host, coalesce(sum(score) FILTER (ruling = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (ruling = 'block'), 0) AS distrust FROM walk GROUP BY host)
SELECT page_id, jj.host, path, rule, coalesce(ruling, CASE WHEN distrust > 0 AND distrust >= {BLOCK_AT} * (trust + distrust) THEN 'block' END, 'allow') AS verdict
FROM jj LEFT JOIN f ON f.host = jj.host
"""
