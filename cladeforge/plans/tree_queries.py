"""Split, tree, resampling, test and diversity queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.operators import splits as S
from cladeforge.operators import trees as T
from cladeforge.operators import treetests as P
from cladeforge.plans.adapters import CTE, clade_members, pattern_likelihoods, presence, sample_weights, taxonomy
from cladeforge.sources.storage import written

REPLICATES, REFERENCE = 99, "click"


def r(c: str, digits: int = 6) -> F.Column:
    return F.round(c, digits).alias(c)


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The splits, written: a row each, whose members are read more than once; and the number of taxa."""
    c = clade_members(spark, sf_dir)
    return written(S.canonical(c), "splits"), c.select("taxon").distinct().count()


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pattern_likelihoods(spark, sf_dir)
    return P.rell(p, P.samples(p, REPLICATES, sample_weights("rep", "ptn")))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence(spark, sf_dir).select(F.col("part").alias("area"), F.concat(F.lit("s"), F.col("taxon").cast("string")).alias("leaf"))


def q_splits(spark, sf_dir):
    s, _ = _splits(spark, sf_dir)
    return s.select("tree", S.key().alias("members"), "size", "weight")


def q_split_system(spark, sf_dir):
    s, _ = _splits(spark, sf_dir)
    return S.split_system(s).select(S.key().alias("members"), "count", r("total"), r("mean_all"), r("mean_having"), r("support"))


def q_consensus(spark, sf_dir):
    s, _ = _splits(spark, sf_dir)
    return S.split_system(s, 0.2).select(S.key().alias("members"), "count")


def q_rf(spark, sf_dir):
    return S.robinson_foulds(_splits(spark, sf_dir)[0])


def q_branch_score(spark, sf_dir):
    return S.branch_score(_splits(spark, sf_dir)[0], REFERENCE)


def q_support(spark, sf_dir):
    return S.support(_splits(spark, sf_dir)[0], REFERENCE).select(S.key().alias("members"), r("support"))


def q_topologies(spark, sf_dir):
    return S.topologies(_splits(spark, sf_dir)[0])


def q_incompatible(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    return S.incompatible_pairs(s, n)


def q_tbe(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    return S.transfer_support(s, REFERENCE, n).select(S.key().alias("members"), r("tbe"))


def q_correlation(spark, sf_dir):
    return P.support_correlation(_splits(spark, sf_dir)[0], F.col("tree") < "purchase").select(r("r"))


def q_metrics(spark, sf_dir):
    return T.metrics(taxonomy(spark, sf_dir)).select("nodes", "leaves", r("length"), r("farthest"), "depth")


def q_clades(spark, sf_dir):
    return T.clade_sizes(taxonomy(spark, sf_dir)).select("node", "leaves", r("length"))


def q_patristic(spark, sf_dir):
    return T.patristic(taxonomy(spark, sf_dir)).select("a", "b", r("d"))


def q_collapse(spark, sf_dir):
    return T.collapse(taxonomy(spark, sf_dir), 0.1)


def q_pd(spark, sf_dir):
    return T.diversity(taxonomy(spark, sf_dir), _areas(spark, sf_dir)).select("area", r("pd"))


def q_endemism(spark, sf_dir):
    return T.endemism(taxonomy(spark, sf_dir), _areas(spark, sf_dir)).select("area", r("endemism"), r("exclusive"))


def q_complementarity(spark, sf_dir):
    return T.complementarity(taxonomy(spark, sf_dir), _areas(spark, sf_dir), "Brand#11").select("area", r("gain"))


def q_greedy_pd(spark, sf_dir):
    return T.greedy_diversity(taxonomy(spark, sf_dir), 5).select("step", "leaf", r("gain"))


def q_presence(spark, sf_dir):
    p = presence(spark, sf_dir)
    n = p.agg(F.countDistinct("taxon").alias("taxa"), F.countDistinct("part").alias("parts"), F.count("*").alias("cells"))
    return n.select("taxa", "parts", "cells", F.round(100 * (1 - F.col("cells") / (F.col("taxa") * F.col("parts"))), 6).alias("missing_percent"))


def q_overlap(spark, sf_dir):
    by = presence(spark, sf_dir).groupBy("taxon").agg(F.array_sort(F.collect_set("part")).alias("p"))
    pair = F.expr("flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> struct(a AS p1, b AS p2))))")
    return by.select(F.explode(pair).alias("x")).groupBy("x.p1", "x.p2").agg(F.count("*").alias("shared"))


def q_rell(spark, sf_dir):
    return _scores(spark, sf_dir).select("tree", "rep", r("lnl", 4))


def q_best(spark, sf_dir):
    return P.best_trees(_scores(spark, sf_dir)).select("rep", "tree", r("lnl", 4))


def q_tests(spark, sf_dir):
    return P.tests(_scores(spark, sf_dir)).select("tree", r("lnl", 4), r("delta", 4), r("bp"), r("kh"), r("sh"), r("elw"))


def q_confidence(spark, sf_dir):
    return P.confidence_set(P.tests(_scores(spark, sf_dir)), "elw").select("tree", "confident")


def q_variance(spark, sf_dir):
    return P.difference_variance(pattern_likelihoods(spark, sf_dir)).select("t1", "t2", r("delta", 4), r("var", 4))


def q_branch_tests(spark, sf_dir):
    return P.branch_tests(_scores(spark, sf_dir), (1, 2, 3)).select(r("abayes"), r("local_bp"), r("sh_alrt"))


def q_criteria(spark, sf_dir):
    p = pattern_likelihoods(spark, sf_dir)
    fits = p.groupBy("tree").agg(F.sum(F.col("freq") * F.col("lnl")).alias("lnl"), F.sum("freq").alias("n")).withColumn("k", (F.col("tree") * 2).cast("long"))
    out = P.information_criteria(fits)
    return out.select("tree", *(r(c, 4) for c in ("aic", "aicc", "bic")), *(r(f"{c}_weight") for c in ("aic", "aicc", "bic")), *(f"{c}_confident" for c in ("aic", "aicc", "bic")))


def q_jackknife(spark, sf_dir):
    p = pattern_likelihoods(spark, sf_dir)
    return P.rell(p, P.jackknife(p, 20, "(rep * 31 + ptn * 17) % 2 = 0")).select("tree", "rep", r("lnl", 4))


def q_weighted(spark, sf_dir):
    return P.weighted_tests(_scores(spark, sf_dir), P.difference_variance(pattern_likelihoods(spark, sf_dir))).select("tree", r("wkh"), r("wsh"))


def q_au(spark, sf_dir):
    return P.approximately_unbiased(pattern_likelihoods(spark, sf_dir))


def q_network(spark, sf_dir):
    c = clade_members(spark, sf_dir)
    s, _ = _splits(spark, sf_dir)
    return S.network_diversity(s, c.select((F.col("taxon") % 5).alias("area"), "taxon"))


QUERIES = {
    "test_weighted": q_weighted, "test_au": q_au, "pd_network": q_network,
    "tree_splits": q_splits, "split_system": q_split_system, "split_consensus": q_consensus, "tree_rf_distance": q_rf, "tree_branch_score": q_branch_score, "tree_support": q_support, "tree_topologies": q_topologies,
    "split_incompatible_pairs": q_incompatible, "tree_transfer_support": q_tbe, "boot_support_correlation": q_correlation, "tree_metrics": q_metrics, "tree_clade_sizes": q_clades, "tree_patristic": q_patristic, "tree_collapse": q_collapse,
    "pd_area": q_pd, "pd_endemism": q_endemism, "pd_complementarity": q_complementarity, "pd_greedy": q_greedy_pd, "presence_summary": q_presence, "presence_overlap": q_overlap, "boot_rell": q_rell, "boot_best_tree": q_best,
    "test_topologies": q_tests, "test_confidence_set": q_confidence, "test_difference_variance": q_variance, "test_branch": q_branch_tests, "model_criteria": q_criteria, "boot_jackknife": q_jackknife,
}

_SP = f"""WITH {CTE["clades"]}, taxa AS (SELECT list(DISTINCT taxon ORDER BY taxon) AS every FROM clades),
raw AS (SELECT tree, clade, list_sort(list(DISTINCT taxon)) AS m, sum(n) AS weight FROM clades GROUP BY tree, clade),
folded AS (SELECT tree, CASE WHEN m[1] = every[1] THEN m ELSE list_filter(every, lambda x: NOT list_contains(m, x)) END AS m, weight, len(every) AS ntaxa FROM raw, taxa),
sp AS (SELECT tree, m, CAST(max(weight) AS BIGINT) AS weight, len(m) AS size, any_value(ntaxa) AS ntaxa FROM folded WHERE len(m) < ntaxa GROUP BY tree, m)"""
_KEY = "array_to_string(m, ',') AS members"
_SYS = f"{_SP}, nt AS (SELECT count(DISTINCT tree) AS k FROM sp), sys AS (SELECT m, count(*) AS c, sum(weight) AS total, avg(weight) AS mh FROM sp GROUP BY m)"
_COMP = "len(list_intersect(a.m, b.m)) = len(a.m) OR len(list_intersect(a.m, b.m)) = len(b.m) OR len(a.m) + len(b.m) - len(list_intersect(a.m, b.m)) = a.ntaxa"
_UP = f"""WITH RECURSIVE {CTE["tree"]}, up AS (SELECT node, node AS above, parent AS nxt, 0 AS lvl FROM tree UNION ALL SELECT up.node, t.node, t.parent, lvl + 1 FROM up JOIN tree t ON t.node = up.nxt),
leaf AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree)), path AS (SELECT up.node AS leaf, up.above AS node, t.brlen FROM up JOIN tree t ON t.node = up.above WHERE up.node IN (SELECT node FROM leaf))"""
_AREA = f"{_UP}, {CTE['pres']}, area AS (SELECT part AS area, 's' || taxon AS leaf FROM pres), held AS (SELECT DISTINCT area, node, brlen FROM area JOIN path USING (leaf))"
_RELL = f"""WITH {CTE["ptnlh"]}, boot AS (SELECT rep, ptn, CASE WHEN rep = 0 THEN freq ELSE {sample_weights("rep", "ptn")} END AS w FROM (SELECT DISTINCT ptn, freq FROM ptnlh), range({REPLICATES + 1}) t(rep)),
sc AS (SELECT tree, CAST(rep AS INTEGER) AS rep, sum(w * lnl) AS lnl FROM ptnlh JOIN boot USING (ptn) GROUP BY tree, rep)"""
_TEST = f"""{_RELL}, a AS (SELECT *, lnl - avg(lnl) OVER (PARTITION BY tree) AS c, max(lnl) FILTER (rep = 0) OVER (PARTITION BY tree) AS own FROM sc),
b AS (SELECT *, max(c) OVER (PARTITION BY rep) AS maxc, max(lnl) OVER (PARTITION BY rep) AS top, max(own) OVER (PARTITION BY rep) AS best_own, row_number() OVER (PARTITION BY rep ORDER BY own DESC, tree) AS place, row_number() OVER (PARTITION BY rep ORDER BY lnl DESC, tree) AS win FROM a),
d AS (SELECT *, max(c) FILTER (place = 1) OVER (PARTITION BY rep) AS c1, max(c) FILTER (place = 2) OVER (PARTITION BY rep) AS c2, max(own) FILTER (place = 2) OVER (PARTITION BY rep) AS own2, exp(lnl - top) / sum(exp(lnl - top)) OVER (PARTITION BY rep) AS ew FROM b),
tests AS (SELECT tree, max(own) AS lnl, max(best_own - own) AS delta, avg(CASE WHEN win = 1 THEN 1.0 ELSE 0.0 END) AS bp, avg(CASE WHEN CASE WHEN place = 1 THEN c2 ELSE c1 END - c > CASE WHEN place = 1 THEN own2 ELSE best_own END - own THEN 1.0 ELSE 0.0 END) AS kh,
  avg(CASE WHEN maxc - c > best_own - own THEN 1.0 ELSE 0.0 END) AS sh, avg(ew) AS elw FROM d GROUP BY tree)"""


def _greedy_sql(k: int) -> str:
    steps = []
    for i in range(1, k + 1):
        steps.append(f"g{i} AS (SELECT leaf, round(sum(brlen), 9) AS gain FROM path WHERE node NOT IN (SELECT node FROM t{i - 1}) GROUP BY leaf), b{i} AS (SELECT {i} AS step, leaf, gain FROM g{i} ORDER BY gain DESC, leaf LIMIT 1)")
        steps.append(f"t{i} AS (SELECT node FROM t{i - 1} UNION ALL SELECT node FROM path WHERE leaf = (SELECT leaf FROM b{i}))")
    union = " UNION ALL ".join(f"SELECT CAST(step AS INTEGER) AS step, leaf, round(gain, 6) AS gain FROM b{i}" for i in range(1, k + 1))
    return f"{_UP}, t0 AS (SELECT node FROM path WHERE false), {', '.join(steps)} {union}"


ORACLES = {
    "test_weighted": f"""{_RELL}, dif AS (SELECT a.tree AS t, b.tree AS u, a.freq AS f, a.lnl - b.lnl AS x FROM ptnlh a JOIN ptnlh b ON a.ptn = b.ptn AND a.tree <> b.tree),
v AS (SELECT t, u, 1 / sqrt(sum(f) / (sum(f) - 1) * (sum(f * x * x) - sum(f * x) * sum(f * x) / sum(f))) AS w FROM dif GROUP BY t, u), s AS (SELECT *, lnl - avg(lnl) OVER (PARTITION BY tree) AS c, max(lnl) FILTER (rep = 0) OVER (PARTITION BY tree) AS own FROM sc),
x AS (SELECT s.tree, s.rep, o.tree AS u, o.c - s.c AS d, o.own - s.own AS d0, o.own AS ow, w FROM s JOIN s o ON s.rep = o.rep AND s.tree <> o.tree JOIN v ON v.t = s.tree AND v.u = o.tree),
y AS (SELECT tree, rep, max(d * w) AS m, max(d0 * w) AS m0, first(w ORDER BY ow DESC, u) AS wt, first(d ORDER BY ow DESC, u) AS dd, max(d0) AS dd0 FROM x GROUP BY tree, rep)
SELECT tree, round(avg(CASE WHEN dd * wt > dd0 * wt THEN 1.0 ELSE 0.0 END), 6) AS wkh, round(avg(CASE WHEN m > m0 THEN 1.0 ELSE 0.0 END), 6) AS wsh FROM y GROUP BY tree""",
    "pd_network": f"""{_SP}, w AS (SELECT m, max(weight) AS weight FROM sp GROUP BY m), area AS (SELECT CAST(taxon % 5 AS BIGINT) AS area, list(DISTINCT taxon) AS taxa FROM clades GROUP BY 1)
SELECT area, CAST(coalesce(sum(weight) FILTER (len(list_intersect(m, taxa)) BETWEEN 1 AND len(taxa) - 1), 0) AS BIGINT) AS pd FROM area, w GROUP BY area""",
    "tree_splits": f"{_SP} SELECT tree, {_KEY}, size, weight FROM sp",
    "split_system": f"{_SYS} SELECT {_KEY}, c AS count, CAST(total AS BIGINT) AS total, round(total / k, 6) AS mean_all, round(mh, 6) AS mean_having, round(100 * c / k, 6) AS support FROM sys, nt",
    "split_consensus": f"{_SYS} SELECT {_KEY}, c AS count FROM sys, nt WHERE c > 0.2 * k",
    "tree_rf_distance": f"""{_SP}, n AS (SELECT tree, count(*) AS n FROM sp GROUP BY tree), s AS (SELECT a.tree AS t1, b.tree AS t2, count(*) AS shared FROM sp a JOIN sp b ON a.m = b.m AND a.tree < b.tree GROUP BY ALL)
SELECT x.tree AS t1, y.tree AS t2, x.n + y.n - 2 * coalesce(shared, 0) AS rf, coalesce(shared, 0) AS shared FROM n x JOIN n y ON x.tree < y.tree LEFT JOIN s ON t1 = x.tree AND t2 = y.tree""",
    "tree_branch_score": f"""{_SP}, ref AS (SELECT m, weight FROM sp WHERE tree = '{REFERENCE}'), o AS (SELECT DISTINCT tree FROM sp WHERE tree <> '{REFERENCE}'), k AS (SELECT tree, m FROM sp WHERE tree <> '{REFERENCE}' UNION SELECT tree, m FROM o, ref)
SELECT k.tree, CAST(sum((coalesce(sp.weight, 0) - coalesce(ref.weight, 0)) ** 2) AS BIGINT) AS score FROM k LEFT JOIN sp ON sp.tree = k.tree AND sp.m = k.m LEFT JOIN ref ON ref.m = k.m GROUP BY k.tree""",
    "tree_support": f"{_SP}, o AS (SELECT * FROM sp WHERE tree <> '{REFERENCE}') SELECT {_KEY}, round(100.0 * (SELECT count(*) FROM o WHERE o.m = sp.m) / (SELECT count(DISTINCT tree) FROM o), 6) AS support FROM sp WHERE tree = '{REFERENCE}'",
    "tree_topologies": f"{_SP}, h AS (SELECT tree, list(m ORDER BY m) AS h FROM sp GROUP BY tree) SELECT tree, min(tree) OVER (PARTITION BY h) AS first_tree FROM h",
    "split_incompatible_pairs": f"{_SP} SELECT a.tree, count(*) FILTER (a.m < b.m AND NOT ({_COMP})) AS pairs FROM sp a JOIN sp b ON a.tree = b.tree GROUP BY a.tree",
    "tree_transfer_support": f"""{_SP}, d AS (SELECT a.m, least(a.size, a.ntaxa - a.size) AS depth, b.tree, min(least(a.size + b.size - 2 * len(list_intersect(a.m, b.m)), a.ntaxa - (a.size + b.size - 2 * len(list_intersect(a.m, b.m))))) AS d
FROM sp a JOIN sp b ON a.tree = '{REFERENCE}' AND b.tree <> '{REFERENCE}' WHERE least(a.size, a.ntaxa - a.size) >= 2 GROUP BY ALL) SELECT {_KEY}, round(1 - avg(least(d, depth - 1)) / (depth - 1), 6) AS tbe FROM d GROUP BY m, depth""",
    "boot_support_correlation": f"""{_SP}, c AS (SELECT m, count(DISTINCT tree) AS x, count(DISTINCT tree) FILTER (tree < 'purchase') AS y FROM sp GROUP BY m), v AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM c)
SELECT round(coalesce((n * sxy - sx * sy) / sqrt(CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 THEN CAST(n * sxx - sx * sx AS DOUBLE) * (n * syy - sy * sy) END), 1.0), 6) AS r FROM v""",
    "tree_metrics": f"{_UP}, p AS (SELECT leaf, sum(brlen) AS l, count(*) AS d FROM path GROUP BY leaf) SELECT (SELECT count(*) FROM tree) AS nodes, (SELECT count(*) FROM p) AS leaves, round((SELECT sum(brlen) FROM tree), 6) AS length, round((SELECT max(l) FROM p), 6) AS farthest, (SELECT max(d) FROM p) AS depth",
    "tree_clade_sizes": f"{_UP}, n AS (SELECT node, count(*) AS leaves FROM path GROUP BY node), l AS (SELECT above AS node, sum(brlen) AS length FROM up JOIN tree USING (node) GROUP BY above) SELECT node, leaves, round(length, 6) AS length FROM n JOIN l USING (node)",
    "tree_patristic": f"""{_UP}, dep AS (SELECT leaf, sum(brlen) AS d FROM path GROUP BY leaf), nd AS (SELECT up.node, sum(t.brlen) AS d FROM up JOIN tree t ON t.node = up.above GROUP BY up.node), i AS (SELECT leaf, node, d FROM path JOIN nd USING (node) WHERE leaf <> node),
m AS (SELECT x.leaf AS a, y.leaf AS b, max(x.d) AS d FROM i x JOIN i y ON x.node = y.node AND x.leaf < y.leaf GROUP BY ALL)
SELECT p.leaf AS a, q.leaf AS b, round(p.d + q.d - 2 * coalesce(m.d, 0), 6) AS d FROM dep p JOIN dep q ON p.leaf < q.leaf LEFT JOIN m ON m.a = p.leaf AND m.b = q.leaf""",
    "pd_greedy": _greedy_sql(5),
    "tree_collapse": f"""WITH RECURSIVE {CTE["tree"]}, leaf AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree)), gone AS (SELECT node, parent FROM tree WHERE brlen <= 0.1 AND node NOT IN (SELECT node FROM leaf)),
w AS (SELECT node, parent, brlen FROM tree WHERE node NOT IN (SELECT node FROM gone) UNION ALL SELECT w.node, gone.parent, w.brlen FROM w JOIN gone ON gone.node = w.parent) SELECT node, parent, brlen FROM w WHERE parent NOT IN (SELECT node FROM gone)""",
    "pd_area": f"{_AREA} SELECT area, round(sum(brlen), 6) AS pd FROM held GROUP BY area",
    "pd_endemism": f"""{_AREA}, one AS (SELECT node, any_value(brlen) AS brlen, min(area) AS area FROM held GROUP BY node HAVING count(*) = 1), lv AS (SELECT node, count(*) AS n FROM path GROUP BY node), mine AS (SELECT node, count(DISTINCT leaf) AS n FROM area JOIN path USING (leaf) GROUP BY node)
SELECT a.area, round(coalesce(sum(brlen), 0.0), 6) AS endemism, round(coalesce(sum(brlen) FILTER (lv.n = mine.n), 0.0), 6) AS exclusive FROM (SELECT DISTINCT area FROM area) a LEFT JOIN one USING (area) LEFT JOIN lv USING (node) LEFT JOIN mine USING (node) GROUP BY a.area""",
    "pd_complementarity": f"{_AREA} SELECT area, round(sum(brlen), 6) AS gain FROM held WHERE node NOT IN (SELECT node FROM held WHERE area = 'Brand#11') GROUP BY area",
    "presence_summary": f"WITH {CTE['pres']} SELECT count(DISTINCT taxon) AS taxa, count(DISTINCT part) AS parts, count(*) AS cells, round(100 * (1 - count(*) / (count(DISTINCT taxon) * count(DISTINCT part))), 6) AS missing_percent FROM pres",
    "presence_overlap": f"WITH {CTE['pres']} SELECT a.part AS p1, b.part AS p2, count(*) AS shared FROM pres a JOIN pres b ON a.taxon = b.taxon AND a.part < b.part GROUP BY ALL",
    "boot_rell": f"{_RELL} SELECT tree, rep, round(lnl, 4) AS lnl FROM sc",
    "boot_best_tree": f"{_RELL}, k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY lnl DESC, tree) AS p FROM sc) SELECT rep, tree, round(lnl, 4) AS lnl FROM k WHERE p = 1",
    "test_topologies": f"{_TEST} SELECT tree, round(lnl, 4) AS lnl, round(delta, 4) AS delta, round(bp, 6) AS bp, round(kh, 6) AS kh, round(sh, 6) AS sh, round(elw, 6) AS elw FROM tests",
    "test_confidence_set": f"{_TEST} SELECT tree, coalesce(sum(elw) OVER (ORDER BY elw DESC, tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.95 AS confident FROM tests",
    "test_difference_variance": f"WITH {CTE['ptnlh']}, d AS (SELECT a.tree AS t1, b.tree AS t2, a.freq AS f, a.lnl - b.lnl AS x FROM ptnlh a JOIN ptnlh b ON a.ptn = b.ptn AND a.tree < b.tree) SELECT t1, t2, round(sum(f * x), 4) AS delta, round(sum(f) / (sum(f) - 1) * (sum(f * x * x) - sum(f * x) * sum(f * x) / sum(f)), 4) AS var FROM d GROUP BY t1, t2",
    "test_branch": f"""{_RELL}, p AS (SELECT rep, max(lnl) FILTER (tree = 1) AS a, max(lnl) FILTER (tree = 2) AS b, max(lnl) FILTER (tree = 3) AS c FROM sc GROUP BY rep), o AS (SELECT a AS a0, b AS b0, c AS c0 FROM p WHERE rep = 0),
v AS (SELECT *, greatest(a - a0, b - b0, c - c0) AS top, (a - a0) + (b - b0) + (c - c0) - greatest(a - a0, b - b0, c - c0) - least(a - a0, b - b0, c - c0) AS second FROM p, o WHERE rep > 0)
SELECT round(1 / (1 + exp(max(b0) - max(a0)) + exp(max(c0) - max(a0))), 6) AS abayes, round(avg(CASE WHEN a >= b AND a >= c THEN 1.0 ELSE 0.0 END), 6) AS local_bp, round(avg(CASE WHEN a0 - greatest(b0, c0) > top - second + 0.05 THEN 1.0 ELSE 0.0 END), 6) AS sh_alrt FROM v""",
    "model_criteria": f"""WITH {CTE["ptnlh"]}, f AS (SELECT tree, sum(freq * lnl) AS lnl, sum(freq) AS n, tree * 2 AS k FROM ptnlh GROUP BY tree), c AS (SELECT tree, -2 * lnl + 2 * k AS aic, -2 * lnl + 2 * k + 2.0 * k * (k + 1) / greatest(n - k - 1, 1) AS aicc, -2 * lnl + k * ln(n) AS bic FROM f),
e AS (SELECT *, {", ".join(f"exp(-({x} - min({x}) OVER ()) / 2) AS e_{x}" for x in ("aic", "aicc", "bic"))} FROM c), w AS (SELECT *, {", ".join(f"e_{x} / sum(e_{x}) OVER () AS w_{x}" for x in ("aic", "aicc", "bic"))} FROM e)
SELECT tree, {", ".join(f"round({x}, 4) AS {x}, round(w_{x}, 6) AS {x}_weight, w_{x} > 0.05 AS {x}_confident" for x in ("aic", "aicc", "bic"))} FROM w""",
    "boot_jackknife": f"WITH {CTE['ptnlh']} SELECT tree, CAST(rep AS INTEGER) AS rep, round(sum(CASE WHEN rep = 0 OR (rep * 31 + ptn * 17) % 2 = 0 THEN freq ELSE 0 END * lnl), 4) AS lnl FROM ptnlh, range(21) t(rep) GROUP BY tree, rep",
}
