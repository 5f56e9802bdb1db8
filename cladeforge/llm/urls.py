"""URL filters by link-graph propagation, with DataFrame functions only.

A page's host is judged by rules on host and path, and where no rule fits, by the link graph between hosts:
personalised PageRank flows from trusted hosts along links, and distrust flows from blocked hosts against them (who
links to a blocked host is suspect). Both run in one loop over pre-aggregated host edges; each round is a join and an
aggregation with map-side combine, and is written to the shared folder every few rounds. Rounds go on until no new host is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import discard, materialize, table

#: Rules, as verdict and host with path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DAMPING, ROUNDS, WRITE_EVERY = 0.85, 12, 4
#: A host is blocked if its distrust is above this share of trust and distrust together.
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str]]) -> F.Column:
    """The longest rule (as verdict and rule) whose host is `host` or a parent of it and whose path begins `path`; null if none."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts, counted."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    out = pages.select(host_of(F.col(url)).alias("src"), F.explode(hrefs).alias("to"))
    dst = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))
    return out.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): `seeds` (kind, host, weight) propagated over `edges` (src, dst, links).

    kind 'trust' flows along links, 'distrust' against them; each kind's seed weights are scaled to sum 1. The score of
    a host without links out of it is not passed on. There are `rounds` rounds, and more as long as they reach hosts that had no score."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("host"), "links")
    both = both.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("host"), "links"))
    out = both.groupBy("kind", "at").agg(F.sum("links").alias("all"))
    flow = materialize(both.join(out, ["kind", "at"]).select("kind", "at", "host", (F.col("links") / F.col("all")).alias("share")), "flow")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    base = materialize(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("base")), "seeds")
    score, written = base.withColumnRenamed("base", "score"), None
    if flow.isEmpty():
        rounds = 0
    i, reached = 0, -1
    while i < rounds or (rounds and reached >= 0):
        moved = flow.join(score.select("kind", F.col("host").alias("at"), "score"), ["kind", "at"])
        moved = moved.select("kind", "host", (F.col("share") * F.col("score") * damping).alias("score"))
        score = moved.unionByName(base.select("kind", "host", ((1 - damping) * F.col("base")).alias("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        i += 1
        if i % WRITE_EVERY == 0 or i == rounds:
            score = materialize(score, "scores")
            if written is not None:
                discard(written)
            written = score
            if i >= rounds - WRITE_EVERY:  # who has a score keeps it, so an equal count means equal hosts
                n = score.count()
                reached = -1 if n == reached else n
    return score


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, ident: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """`ident`, host, path, rule, verdict, trust and distrust, one row for each row of `pages`.

    Seeds are the hosts of pages that a rule judges, weighted by such pages (allow: trust, block: distrust). Without a rule, a
    page is blocked if its host's distrust exceeds `threshold` of distrust and trust together, else allowed; a host that
    nothing reaches, an empty host and a null url are allowed. The share is rounded to 9 places, so that the order of a sum
    can't turn a verdict; it does not depend on the table's size. Scores are given to 12 places. Repeated rows are judged alike; an empty table gives an empty result."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(F.col(ident), host.alias("host"), path.alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    seeds = judged.where("fit IS NOT NULL AND host <> ''").groupBy(F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("weight"))
    score = propagate(host_edges(pages, url, html), seeds)
    by_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    of_host = materialize(score.groupBy("host").agg(by_kind("trust"), by_kind("distrust")), "hosts")
    out = judged.join(of_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.round(F.try_divide("distrust", F.col("trust") + F.col("distrust")), 9) > threshold)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(bad & (F.col("host") != ""), "block").otherwise("allow"))
    return out.select(ident, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    cases = lambda out: " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{out(v, r)}'" for v, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
    steps, last = [], "base"
    for i in range(ROUNDS):
        steps.append(f"""s{i} AS (SELECT kind, host, sum(score) AS score FROM (
  SELECT flow.kind, flow.host, share * score * {DAMPING} AS score FROM flow JOIN {last} p ON flow.kind = p.kind AND flow.via = p.host
  UNION ALL SELECT kind, host, {1 - DAMPING} * score FROM base) GROUP BY kind, host)""")
        last = f"s{i}"
    return rf"""
WITH p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT *, CASE {cases(lambda v, r: r)} END AS rule, CASE {cases(lambda v, r: v)} END AS by_rule FROM p),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) AS t FROM p),
links AS (SELECT src, translate(regexp_extract(CASE WHEN starts_with(t, '//') THEN 'http:' || t ELSE t END, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst FROM hrefs),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
ways AS (SELECT 'trust' AS kind, src AS via, dst AS host, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
flow AS (SELECT kind, via, host, n / sum(n) OVER (PARTITION BY kind, via) AS share FROM ways),
seeds AS (SELECT CASE WHEN by_rule = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE by_rule IS NOT NULL AND host <> '' GROUP BY 1, 2),
base AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS score FROM seeds),
{", ".join(steps)},
final AS (SELECT * FROM {last} WHERE (SELECT count(*) FROM flow) > 0 UNION ALL SELECT * FROM base WHERE (SELECT count(*) FROM flow) = 0),
hosts AS (SELECT host, round(coalesce(sum(score) FILTER (kind = 'trust'), 0.0), 12) AS trust, round(coalesce(sum(score) FILTER (kind = 'distrust'), 0.0), 12) AS distrust FROM final GROUP BY host)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host <> '' AND coalesce(distrust, 0) > {THRESHOLD} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM judged LEFT JOIN hosts USING (host)
"""


ORACLE_OP1 = _oracle()
