"""Alignment, distance and symmetry queries over `lineitem`, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.operators import alignment as A
from cladeforge.plans.adapters import CTE, alignment, site_columns

ROUND = 6
#: Of the places of taxa: the clades whose sequences are compared.
CLADES = [[0, 1], [2, 3], [5, 6], [4, 5, 6], [0, 1, 2, 3]]


def r(c: str) -> F.Column:
    return F.round(c, ROUND).alias(c)


def q_partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.partition_summary(site_columns(spark, sf_dir))


def q_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.numbered(A.patterns(site_columns(spark, sf_dir)))
    return p.select("part", "ptn", F.concat_ws(",", F.transform("states", lambda x: x.cast("string"))).alias("states"), "freq", "first_site", "is_const", "informative", "num_chars")


def q_site_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = A.columns(site_columns(spark, sf_dir))
    ptn = A.numbered(A.patterns(site_columns(spark, sf_dir))).select("part", "states", "ptn")
    return cols.join(ptn, ["part", "states"]).select("part", "site", "ptn")


def q_site_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.site_gaps(alignment(spark, sf_dir))


def q_sequence_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sequence_frequencies(alignment(spark, sf_dir)).select("taxon", "state", "n", r("share"))


def q_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.composition_test(alignment(spark, sf_dir)).select("taxon", r("chi2"), "df", r("gap_percent"))


def q_empirical_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.empirical_frequencies(alignment(spark, sf_dir)).select(*(r(f"f{s}") for s in A.STATES))


def q_unconstrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unconstrained_lnl(A.patterns(site_columns(spark, sf_dir))).select("part", r("lnl"))


def q_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pair_counts(site_columns(spark, sf_dir))


def q_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.symmetry_test(A.pair_counts(site_columns(spark, sf_dir))).select("t1", "t2", r("symmetry"), "df")


def q_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.divergence(A.pair_counts(site_columns(spark, sf_dir))).select("s1", "s2", r("share"))


def q_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missing_fraction(alignment(spark, sf_dir)).select(r("missing"))


def q_drop_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drop_sites(alignment(spark, sf_dir), gappy=True)


def q_drop_uninformative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drop_sites(alignment(spark, sf_dir), constant=True, uninformative=True)


def q_select_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.select_sites(alignment(spark, sf_dir), [(1, 10**9, 3), (500, 900, 1)])


def q_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.residues(alignment(spark, sf_dir)).select("taxon", "site", "residue")


def q_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.identical_sequences(alignment(spark, sf_dir))


def q_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.concatenate(alignment(spark, sf_dir)).select("taxon", "position", "mask")


def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.consensus(site_columns(spark, sf_dir))


def q_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.translate(alignment(spark, sf_dir))


def q_absent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = alignment(spark, sf_dir)
    has = aln.groupBy("part", "taxon").agg(*(F.max((F.col("mask") == s).cast("int")).alias(f"s{s}") for s in A.STATES))
    return has.select("part", "taxon", F.expr("4 - s1 - s2 - s4 - s8").cast("long").alias("absent"), (sum(F.col(f"s{s}") for s in A.STATES) == 0).alias("gap_only"))


def q_observed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.observed_distance(site_columns(spark, sf_dir)).select("t1", "t2", r("d"))


def q_jc_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distance_variance(A.jc_distance(A.observed_distance(site_columns(spark, sf_dir))), "jc").select("t1", "t2", r("jc"), r("ols"), r("wls1"), r("fm"))


def q_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marginal_symmetry(A.pair_counts(site_columns(spark, sf_dir))).select("t1", "t2", F.round("stuart", 4).alias("stuart"), "df")


def q_codon_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.codon_position_frequencies(alignment(spark, sf_dir)).select("position", "state", r("share"))


def q_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clade_identity(A.patterns(site_columns(spark, sf_dir)), CLADES)


_COLS = f"""WITH {CTE["aln"]},
cols AS (SELECT part, site, list(mask ORDER BY taxon) AS states, bit_and(mask) AS shared, {", ".join(f"count(*) FILTER (mask = {s}) AS n{s}" for s in A.STATES)} FROM aln GROUP BY part, site),
pats AS (SELECT part, states, count(*) AS freq, min(site) AS first_site, any_value(shared) <> 0 AS is_const,
  {" + ".join(f"CAST(any_value(n{s}) >= 2 AS INT)" for s in A.STATES)} >= 2 AS informative, CAST({" + ".join(f"CAST(any_value(n{s}) >= 1 AS INT)" for s in A.STATES)} AS BIGINT) AS num_chars FROM cols GROUP BY part, states),
num AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY first_site) - 1 AS ptn FROM pats)"""
_SUM = "CAST(sum(freq) AS BIGINT) AS sites, count(*) AS patterns, CAST(coalesce(sum(freq) FILTER (is_const), 0) AS BIGINT) AS constant, CAST(coalesce(sum(freq) FILTER (informative), 0) AS BIGINT) AS informative, CAST(coalesce(sum(freq) FILTER (NOT is_const), 0) AS BIGINT) AS variable"
_ALN = f"WITH {CTE['aln']}"
_PAIRS = f"""{_ALN}, ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY taxon) - 1 AS INTEGER) AS t FROM aln),
pairs AS (SELECT a.t AS t1, b.t AS t2, a.mask AS s1, b.mask AS s2, count(*) AS n FROM ranked a JOIN ranked b ON a.site = b.site AND a.t < b.t WHERE bit_count(a.mask) = 1 AND bit_count(b.mask) = 1 GROUP BY ALL)"""
_FREQ = [f"e0 AS (SELECT {', '.join(f'CAST(count(*) FILTER (mask = {m}) AS DOUBLE) AS c{m}' for m in range(1, 16))}, 0.25::DOUBLE AS f1, 0.25::DOUBLE AS f2, 0.25::DOUBLE AS f4, 0.25::DOUBLE AS f8 FROM aln)"]
for _i in range(8):
    _g = {s: " + ".join(f"c{m} * (f{s} / ({' + '.join(f'f{t}' for t in A.STATES if m & t)}))" for m in range(1, 16) if m & s) for s in A.STATES}
    _FREQ.append(f"g{_i} AS (SELECT {', '.join(f'c{m}' for m in range(1, 16))}, {', '.join(f'{_g[s]} AS g{s}' for s in A.STATES)} FROM e{_i})")
    _FREQ.append(f"e{_i + 1} AS (SELECT {', '.join(f'c{m}' for m in range(1, 16))}, {', '.join(f'g{s} / (g1 + g2 + g4 + g8) AS f{s}' for s in A.STATES)} FROM g{_i})")
_DIST = f"""{_PAIRS.split(', ranked')[0]}, cols AS (SELECT site, bit_and(mask) <> 0 AS k FROM aln GROUP BY site), ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY taxon) - 1 AS INTEGER) AS t FROM aln),
d0 AS (SELECT a.t AS t1, b.t AS t2, count(*) FILTER (NOT k AND bit_count(a.mask) = 1 AND bit_count(b.mask) = 1 AND a.mask <> b.mask) AS diff, count(*) FILTER (k OR (bit_count(a.mask) = 1 AND bit_count(b.mask) = 1)) AS total
  FROM ranked a JOIN ranked b ON a.site = b.site AND a.t < b.t JOIN cols ON cols.site = a.site GROUP BY ALL),
dist AS (SELECT t1, t2, CASE WHEN total > 0 THEN diff / total ELSE 9.0 END AS d FROM d0)"""

QUERIES = {
    "aln_marginal_symmetry": q_marginal, "aln_codon_positions": q_codon_positions, "aln_clade_identity": q_identity,
    "aln_partition_summary": q_partition_summary, "aln_patterns": q_patterns, "aln_site_pattern": q_site_pattern, "aln_site_gaps": q_site_gaps, "aln_sequence_frequencies": q_sequence_frequencies, "aln_composition_test": q_composition,
    "aln_empirical_frequencies": q_empirical_frequencies, "aln_unconstrained_lnl": q_unconstrained, "aln_pair_counts": q_pair_counts, "aln_symmetry_test": q_symmetry, "aln_divergence": q_divergence, "aln_missing_fraction": q_missing,
    "aln_drop_gappy_sites": q_drop_gappy, "aln_drop_uninformative": q_drop_uninformative, "aln_select_ranges": q_select_ranges, "aln_residues": q_residues, "aln_identical_sequences": q_identical, "aln_concatenate": q_concatenate,
    "aln_consensus": q_consensus, "aln_translate": q_translate, "aln_absent_states": q_absent_states, "dist_observed": q_observed_distance, "dist_jc": q_jc_distance,
}

_SINGLE = "bit_count(mask) = 1"
_AGREE = [" + ".join(f"CAST(list_contains([{', '.join(f'states[{i + 1}]' for i in c)}], {s}) AS INT)" for s in A.STATES) for c in CLADES]
ORACLES = {
    "aln_codon_positions": f"""{_ALN}, k AS (SELECT mask AS state, CAST((row_number() OVER (PARTITION BY taxon, part ORDER BY site) - 1) % 3 AS INTEGER) AS position, mask FROM aln), n AS (SELECT position, state, count(*) AS n FROM k WHERE {_SINGLE} GROUP BY ALL),
b AS (SELECT * FROM n UNION ALL SELECT NULL, state, sum(n) FROM n GROUP BY state) SELECT position, state, round(n / sum(n) OVER (PARTITION BY position), 6) AS share FROM b""",
    "aln_clade_identity": f"{_COLS}, t AS (SELECT {', '.join(f'sum(freq) FILTER (({a}) <= 1) AS c{i}' for i, a in enumerate(_AGREE))}, sum(freq) AS n FROM pats) " + " UNION ALL ".join(f"SELECT {i} AS clade, CAST(floor(100 * coalesce(c{i}, 0) / n) AS BIGINT) AS identity FROM t" for i in range(len(CLADES))),
    "aln_partition_summary": f"{_COLS} SELECT part, {_SUM} FROM pats GROUP BY ROLLUP (part)",
    "aln_patterns": f"{_COLS} SELECT part, ptn, array_to_string(states, ',') AS states, freq, first_site, is_const, informative, num_chars FROM num",
    "aln_site_pattern": f"{_COLS} SELECT part, site, ptn FROM cols JOIN num USING (part, states)",
    "aln_site_gaps": f"{_ALN} SELECT part, site, count(*) FILTER (mask = 15) AS gaps, count(*) FILTER (mask <> 15 AND bit_count(mask) > 1) AS ambiguous FROM aln GROUP BY part, site",
    "aln_sequence_frequencies": f"{_ALN}, n AS (SELECT taxon, mask AS state, count(*) AS n FROM aln WHERE {_SINGLE} GROUP BY ALL) SELECT taxon, state, n, round(n / sum(n) OVER (PARTITION BY taxon), 6) AS share FROM n",
    "aln_composition_test": f"""{_ALN}, n AS (SELECT taxon, {", ".join(f"count(*) FILTER (mask = {s}) AS n{s}" for s in A.STATES)}, count(*) AS cells FROM aln GROUP BY taxon), o AS (SELECT *, n1 + n2 + n4 + n8 AS own FROM n),
a AS (SELECT {", ".join(f"sum(n{s}) AS a{s}" for s in A.STATES)}, sum(own) AS a FROM o)
SELECT taxon, round({" + ".join(f"CASE WHEN a{s} > 0 THEN own * (a{s} / a - n{s} / own) * (a{s} / a - n{s} / own) / (a{s} / a) ELSE 0 END" for s in A.STATES)}, 6) AS chi2,
CAST({" + ".join(f"CAST(a{s} > 0 AS INT)" for s in A.STATES)} - 1 AS BIGINT) AS df, round(100 * (cells - own) / cells, 6) AS gap_percent FROM o, a WHERE own > 0""",
    "aln_empirical_frequencies": f"{_ALN}, {', '.join(_FREQ)} SELECT {', '.join(f'round(f{s}, 6) AS f{s}' for s in A.STATES)} FROM e8",
    "aln_unconstrained_lnl": f"{_COLS}, w AS (SELECT part, freq, sum(freq) OVER (PARTITION BY part) AS n FROM pats) SELECT part, round(sum(freq * ln(freq / n)), 6) AS lnl FROM w GROUP BY part",
    "aln_pair_counts": f"{_PAIRS} SELECT * FROM pairs",
    "aln_symmetry_test": f"""{_PAIRS}, cell AS (SELECT t1, t2, least(s1, s2) AS lo, greatest(s1, s2) AS hi, sum(CASE WHEN s1 < s2 THEN n ELSE -n END) AS d, sum(n) AS n FROM pairs WHERE s1 <> s2 GROUP BY ALL)
SELECT t1, t2, round(sum(d * d / n), 6) AS symmetry, count(*) AS df FROM cell GROUP BY t1, t2""",
    "aln_divergence": f"{_PAIRS}, b AS (SELECT s1, s2, sum(n) AS n FROM (SELECT s1, s2, n FROM pairs UNION ALL SELECT s2, s1, n FROM pairs) GROUP BY s1, s2) SELECT s1, s2, round(n / sum(n) OVER (PARTITION BY s1), 6) AS share FROM b",
    "aln_missing_fraction": f"""{_ALN}, p AS (SELECT part, taxon, max(CASE WHEN mask <> 15 THEN 1 ELSE 0 END) AS has, count(*) AS sites FROM aln GROUP BY part, taxon), g AS (SELECT part, sum(has) AS nseq, max(sites) AS nsite, count(*) AS taxa FROM p GROUP BY part)
SELECT round(1 - sum(nseq * nsite) / (max(taxa) * sum(nsite)), 6) AS missing FROM g""",
    "aln_drop_gappy_sites": f"{_ALN} SELECT * FROM aln WHERE site IN (SELECT site FROM aln GROUP BY site HAVING bool_and({_SINGLE}))",
    "aln_drop_uninformative": f"{_COLS} SELECT aln.* FROM aln JOIN cols USING (part, site) JOIN pats USING (part, states) WHERE informative AND NOT is_const",
    "aln_select_ranges": f"{_ALN} SELECT * FROM aln WHERE (site BETWEEN 1 AND 1000000000 AND (site - 1) % 3 = 0) OR site BETWEEN 500 AND 900",
    "aln_residues": f"{_ALN} SELECT taxon, site, CASE WHEN mask <> 15 THEN CAST(sum(CASE WHEN mask <> 15 THEN 1 ELSE 0 END) OVER (PARTITION BY taxon, part ORDER BY site) AS BIGINT) END AS residue FROM aln",
    "aln_identical_sequences": f"{_ALN}, s AS (SELECT taxon, list(mask ORDER BY part, site) AS q FROM aln GROUP BY taxon) SELECT taxon, min(taxon) OVER (PARTITION BY q) AS kept_as FROM s",
    "aln_concatenate": f"{_ALN} SELECT taxon, CAST(dense_rank() OVER (ORDER BY part, site) AS BIGINT) AS position, mask FROM aln",
    "aln_consensus": f"{_ALN}, n AS (SELECT part, site, CASE WHEN {_SINGLE} THEN mask END AS s, count(*) AS n FROM aln GROUP BY ALL) SELECT part, site, arg_max(s, n * 16 - s) AS state FROM n GROUP BY part, site",
    "aln_translate": f"""{_ALN}, k AS (SELECT *, row_number() OVER (PARTITION BY taxon, part ORDER BY site) - 1 AS k FROM aln), d AS (SELECT taxon, part, k // 3 AS codon, k % 3 AS p, CASE mask WHEN 8 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 END AS d FROM k)
SELECT taxon, part, codon, CASE WHEN count(d) = 3 THEN substring('{A.CODE}', CAST(sum(d * CASE p WHEN 0 THEN 16 WHEN 1 THEN 4 ELSE 1 END) AS INT) + 1, 1) ELSE 'X' END AS aa FROM d GROUP BY ALL HAVING count(*) = 3""",
    "aln_absent_states": f"{_ALN} SELECT part, taxon, 4 - count(DISTINCT mask) FILTER ({_SINGLE}) AS absent, count(*) FILTER ({_SINGLE}) = 0 AS gap_only FROM aln GROUP BY part, taxon",
    "dist_observed": f"{_DIST} SELECT t1, t2, round(d, 6) AS d FROM dist",
    "dist_jc": f"{_DIST}, j AS (SELECT t1, t2, CASE WHEN 1 - d * 4 / 3.0 > 0 THEN -ln(1 - d * 4.0 / 3) * 0.75 ELSE 9.0 END AS jc FROM dist) SELECT t1, t2, round(jc, 6) AS jc, 1.0::DOUBLE AS ols, round(jc, 6) AS wls1, round(jc * jc, 6) AS fm FROM j",
}
