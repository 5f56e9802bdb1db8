"""Parsimony, likelihood, search, simulation, concordance and streaming queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.functions.models import parse as model_of
from cladeforge.operators import alignment as A
from cladeforge.operators import likelihood as L
from cladeforge.operators import newick as N
from cladeforge.operators import search as S
from cladeforge.plans.adapters import alignment, site_columns, taxa_of
from cladeforge.plans.alignment_queries import _COLS, ORACLES as _ALN_ORACLES
from cladeforge.plans.tree_queries import _RELL, _scores
from cladeforge.sources.storage import scratch_path

TREE = "((1:0.1,2:0.2):0.05,(3:0.1,4:0.15):0.1,(5:0.2,(6:0.1,7:0.12):0.05):0.1);"
GAMMA = "JC+I{0.1}+G4{0.7}"


def _patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    return A.patterns(site_columns(spark, sf_dir)), [str(t) for t in taxa_of(spark, sf_dir)]


def _total(scored: DataFrame, c: str) -> DataFrame:
    return scored.groupBy("part").agg(F.round(F.sum(F.col("freq") * F.col(c)), 4).alias(c))


def q_fitch(spark, sf_dir):
    p, taxa = _patterns(spark, sf_dir)
    return L.fitch(p, TREE, taxa).groupBy("part").agg(F.sum(F.col("freq") * F.col("score")).alias("score"))


def q_likelihood(spark, sf_dir):
    p, taxa = _patterns(spark, sf_dir)
    return _total(L.pattern_likelihood(p, TREE, taxa, model_of("JC")), "lnl")


def q_likelihood_gamma(spark, sf_dir):
    p, taxa = _patterns(spark, sf_dir)
    return _total(L.score_patterns(p, TREE, taxa, model_of(GAMMA)), "lnl")


def q_site_rates(spark, sf_dir):
    p, taxa = _patterns(spark, sf_dir)
    m = model_of(GAMMA)
    return L.site_rates(L.score_patterns(p, TREE, taxa, m), m).select("part", "first_site", F.round("rate", 6).alias("rate"), "category")


def q_ml_distance(spark, sf_dir):
    """Likeliest JC distances, one optimisation for each pair over its counts."""
    n = A.pair_counts(site_columns(spark, sf_dir))

    def fit(frame):
        import pandas as pd

        counts = np.zeros((4, 4))
        for a, b, k in zip(frame["s1"], frame["s2"], frame["n"], strict=True):
            counts[int(a).bit_length() - 1, int(b).bit_length() - 1] += k
        return pd.DataFrame({"t1": frame["t1"].iloc[:1], "t2": frame["t2"].iloc[:1], "d": [round(L.ml_distance(counts, model_of("JC"))[0], 4)]})

    return n.groupBy("t1", "t2").applyInPandas(fit, "t1 int, t2 int, d double")


def q_nj(spark, sf_dir):
    d = A.jc_distance(A.observed_distance(site_columns(spark, sf_dir))).withColumn("aln", F.lit(0))
    return S.distance_trees(d, "aln", d="jc").unionByName(S.distance_trees(d.withColumn("aln", F.lit(1)), "aln", d="jc", method="BIONJ")).unionByName(S.distance_trees(d.withColumn("aln", F.lit(2)), "aln", d="jc", method="UPGMA"))


def q_parsimony_search(spark, sf_dir):
    p, taxa = _patterns(spark, sf_dir)
    one = p.groupBy("states").agg(F.sum("freq").alias("freq"), F.max("informative").alias("informative"))
    return S.parsimony_search(spark, one, taxa, 4)


def q_scf(spark, sf_dir):
    p, taxa = _patterns(spark, sf_dir)
    return S.site_concordance(p, TREE, taxa)


def q_gcf(spark, sf_dir):
    trees = S.random_trees(spark, 200, 7, "yule", 3).withColumn("newick", F.regexp_replace("newick", r"\bT(\d+)", "$1"))
    return S.gene_concordance(trees, TREE)


def q_random_trees(spark, sf_dir):
    return N.distinct(S.random_trees(spark, 50, 6, "uniform", 1))


def q_simulate(spark, sf_dir):
    aln = S.simulate(spark, TREE, model_of(GAMMA), 5000).withColumn("part", F.lit(0))
    return A.observed_distance(aln)


def q_stream(spark, sf_dir):
    """The best tree of each sample, kept up while scores stream in."""
    from cladeforge.streaming.pools import best_per_sample

    base = scratch_path(spark, "stream")
    scores = _scores(spark, sf_dir).select("rep", F.col("tree").cast("long").alias("tree"), "lnl")
    scores.repartition(4).write.parquet(f"{base}/in")
    out = best_per_sample(spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"), 0.0)
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(f"{base}/out").groupBy("rep").agg(F.max_by("tree", "batch").cast("int").alias("tree"), F.max("lnl").alias("lnl"))
    return done.select("rep", "tree", F.round("lnl", 4).alias("lnl"))


def q_model_selection(spark, sf_dir):
    from cladeforge.operators.selection import select

    aln = alignment(spark, sf_dir)
    f = A.empirical_frequencies(aln).first()
    p = A.patterns(site_columns(spark, sf_dir)).groupBy("states").agg(F.sum("freq").alias("freq"))
    taxa = [str(t) for t in taxa_of(spark, sf_dir)]
    return select(spark, p, TREE, taxa, ["JC", "K80", "HKY+F", "JC+G4"], list(f)).select("model", F.round("lnl", 3).alias("lnl"), "k", "n", F.round("bic", 3).alias("bic"), "rank")


QUERIES = {
    "model_selection": q_model_selection,
    "parsimony_fitch": q_fitch, "lik_jc": q_likelihood, "lik_gamma_invariant": q_likelihood_gamma, "lik_site_rates": q_site_rates, "dist_ml": q_ml_distance, "tree_from_distances": q_nj, "search_parsimony": q_parsimony_search,
    "concordance_site": q_scf, "concordance_gene": q_gcf, "sim_random_trees": q_random_trees, "sim_alignment": q_simulate, "stream_best_tree": q_stream,
}


def _fitch_sql() -> str:
    root, steps, cost, where, n, last = N.parse(TREE), [], [], {}, 0, "pats"
    for x in root.walk():
        if not x.children:
            where[x] = f"states[{x.name}]"
            continue
        own = where[x.children[0]]
        for c in x.children[1:]:
            n += 1
            steps.append(f"n{n} AS (SELECT *, CASE WHEN ({own} & {where[c]}) <> 0 THEN {own} & {where[c]} ELSE {own} | {where[c]} END AS s{n}, CASE WHEN ({own} & {where[c]}) = 0 THEN 1 ELSE 0 END AS c{n} FROM {last})")
            cost.append(f"c{n}")
            own, last = f"s{n}", f"n{n}"
        where[x] = own
    return f"{_COLS}, {', '.join(steps)} SELECT part, CAST(sum(freq * ({' + '.join(cost)})) AS BIGINT) AS score FROM {last} GROUP BY part"


def _likelihood_sql(name: str) -> str:
    root, model = N.parse(TREE), model_of(name)
    steps, last, parts = [], "pats", []
    for c, (rate, share) in enumerate(zip(model.rates, model.shares, strict=True)):
        where = {}
        for k, x in enumerate(root.walk()):
            if not x.children:
                where[x] = [f"(CASE WHEN (states[{x.name}] & {1 << s}) <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for s in range(4)]
                continue
            rows = []
            for s in range(4):
                rows.append(" * ".join("(" + " + ".join(f"{model.p(rate * ch.length)[s, t]:.17g}::DOUBLE * {where[ch][t]}" for t in range(4)) + ")" for ch in x.children))
            steps.append(f"l{c}_{k} AS (SELECT *, {', '.join(f'{r} AS v{c}_{k}_{s}' for s, r in enumerate(rows))} FROM {last})")
            last, where[x] = f"l{c}_{k}", [f"v{c}_{k}_{s}" for s in range(4)]
        parts.append(f"{share:.17g}::DOUBLE * ({' + '.join(f'0.25::DOUBLE * {v}' for v in where[root])})")
    if model.invariant:
        shared = " & ".join(f"states[{i}]" for i in range(1, 8))
        parts.append(f"{model.invariant:.17g}::DOUBLE * 0.25::DOUBLE * bit_count({shared})")
    return f"{_COLS}, {', '.join(steps)} SELECT part, round(sum(freq * ln({' + '.join(parts)})), 4) AS lnl FROM {last} GROUP BY part"


def _scf_sql() -> str:
    import itertools

    rows = [(b, i, j, k, m) for b, (p, q, r, s) in enumerate(S.quartet_branches(N.parse(TREE))) for i, j, k, m in itertools.product(p, q, r, s)]
    values = ", ".join(f"({b}, {i}, {j}, {k}, {m})" for b, i, j, k, m in rows)
    return f"""{_COLS}, q(b, i, j, k, m) AS (VALUES {values}), x AS (SELECT q.*, freq, states[i] AS a, states[j] AS c, states[k] AS d, states[m] AS e FROM pats, q WHERE informative),
y AS (SELECT *, CASE WHEN a = c AND d = e AND a <> d THEN 1 WHEN a = d AND c = e AND a <> c THEN 2 WHEN a = e AND c = d AND a <> c THEN 3 END AS kind FROM x WHERE bit_count(a) = 1 AND bit_count(c) = 1 AND bit_count(d) = 1 AND bit_count(e) = 1),
z AS (SELECT b, i, j, k, m, {", ".join(f"coalesce(sum(freq) FILTER (kind = {n}), 0) / sum(freq) AS f{n}" for n in (1, 2, 3))} FROM y WHERE kind IS NOT NULL GROUP BY b, i, j, k, m),
w AS (SELECT b, {", ".join(f"sum(f{n}) AS f{n}" for n in (1, 2, 3))} FROM z GROUP BY b), n AS (SELECT b, count(*) AS quartets FROM q GROUP BY b)
SELECT CAST(b AS INTEGER) AS branch, round(100 * coalesce(f1, 0) / quartets, 2) AS scf, round(100 * coalesce(f2, 0) / quartets, 2) AS sdf1, round(100 * coalesce(f3, 0) / quartets, 2) AS sdf2, quartets FROM n LEFT JOIN w USING (b)"""


def _ml_sql() -> str:
    """Under JC the likeliest distance has a closed form."""
    pairs = _ALN_ORACLES["aln_pair_counts"].rsplit(" SELECT", 1)[0]
    return f"{pairs}, p AS (SELECT t1, t2, sum(n) FILTER (s1 <> s2) / sum(n) AS p FROM pairs GROUP BY t1, t2) SELECT t1, t2, round(CASE WHEN 1 - p * 4 / 3.0 > 0 THEN least(-0.75 * ln(1 - p * 4 / 3.0), 9.0) ELSE 9.0 END, 4) AS d FROM p"


ORACLES = {
    "parsimony_fitch": _fitch_sql(), "lik_jc": _likelihood_sql("JC"), "lik_gamma_invariant": _likelihood_sql(GAMMA), "concordance_site": _scf_sql(), "dist_ml": _ml_sql(),
    "stream_best_tree": f"{_RELL}, k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY lnl DESC, tree) AS p FROM sc) SELECT rep, tree, round(lnl, 4) AS lnl FROM k WHERE p = 1",
}
