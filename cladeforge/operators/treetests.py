"""Resampling of pattern likelihoods and the tests built on it; patterns are (tree, ptn, lnl, freq), samples (rep, ptn, w).

Replicate 0 is the original data. A sample's score is one join and one sum; everything after works on (tree, rep) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def samples(patterns: DataFrame, replicates: int, weight: str) -> DataFrame:
    """(rep, ptn, w): replicate 0 has each pattern's frequency, the others `weight`, an SQL expression of rep and ptn."""
    ptn = patterns.select("ptn", "freq").distinct()
    return ptn.select("ptn", "freq", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("rep")).select("rep", "ptn", F.when(F.col("rep") == 0, F.col("freq")).otherwise(F.expr(weight)).cast("long").alias("w"))


def jackknife(patterns: DataFrame, replicates: int, keep: str) -> DataFrame:
    """(rep, ptn, w): patterns for which `keep`, an SQL condition on rep and ptn, holds."""
    return samples(patterns, replicates, f"CASE WHEN {keep} THEN freq ELSE 0 END")


def rell(patterns: DataFrame, boot: DataFrame) -> DataFrame:
    """(tree, rep, lnl): each tree's log-likelihood on each sample."""
    return patterns.select("tree", "ptn", "lnl").join(boot, "ptn").groupBy("tree", "rep").agg(F.sum(F.col("w") * F.col("lnl")).alias("lnl"))


def best_trees(scores: DataFrame) -> DataFrame:
    """(rep, tree, lnl): the best tree of each sample, the smaller of several."""
    return scores.groupBy("rep").agg(F.max_by("tree", F.struct("lnl", -F.col("tree"))).alias("tree"), F.max("lnl").alias("lnl"))


def tests(scores: DataFrame) -> DataFrame:
    """Per tree lnl (of replicate 0), delta to the best, bp (share of samples where it is best, ties to the smaller tree), kh, sh and elw."""
    by_rep, by_tree = W.partitionBy("rep"), W.partitionBy("tree")
    s = scores.withColumn("avg", F.avg("lnl").over(by_tree)).withColumn("own", F.max(F.when(F.col("rep") == 0, F.col("lnl"))).over(by_tree))
    s = s.withColumn("c", F.col("lnl") - F.col("avg"))
    s = s.withColumn("maxc", F.max("c").over(by_rep)).withColumn("top", F.max("lnl").over(by_rep)).withColumn("best_own", F.max("own").over(by_rep))
    order = F.row_number().over(by_rep.orderBy(F.col("own").desc(), "tree"))
    s = s.withColumn("place", order)
    s = s.withColumn("c1", F.max(F.when(F.col("place") == 1, F.col("c"))).over(by_rep)).withColumn("c2", F.max(F.when(F.col("place") == 2, F.col("c"))).over(by_rep))
    s = s.withColumn("own2", F.max(F.when(F.col("place") == 2, F.col("own"))).over(by_rep))
    rival, rival_own = F.when(F.col("place") == 1, F.col("c2")).otherwise(F.col("c1")), F.when(F.col("place") == 1, F.col("own2")).otherwise(F.col("best_own"))
    win = F.row_number().over(by_rep.orderBy(F.col("lnl").desc(), "tree")) == 1
    s = s.withColumn("win", win.cast("double")).withColumn("e", F.exp(F.col("lnl") - F.col("top")))
    s = s.withColumn("ew", F.col("e") / F.sum("e").over(by_rep))
    sh = (F.col("maxc") - F.col("c") > F.col("best_own") - F.col("own")).cast("double")
    kh = (rival - F.col("c") > rival_own - F.col("own")).cast("double")
    return s.groupBy("tree").agg(F.max("own").alias("lnl"), F.max(F.col("best_own") - F.col("own")).alias("delta"), F.avg("win").alias("bp"), F.avg(kh).alias("kh"), F.avg(sh).alias("sh"), F.avg("ew").alias("elw"))


def confidence_set(table: DataFrame, weight: str, level: float = 0.95) -> DataFrame:
    """Adds confident: the largest weights until their sum exceeds `level`. Over all trees of a test, so few."""
    before = F.coalesce(F.sum(weight).over(W.orderBy(F.col(weight).desc(), "tree").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return table.withColumn("confident", before <= level)


def difference_variance(patterns: DataFrame) -> DataFrame:
    """(t1, t2, delta, var): lnL difference of two trees and its variance n / (n - 1) sum freq (x - mean)^2."""
    by = patterns.groupBy("ptn", "freq").agg(F.array_sort(F.collect_list(F.struct("tree", "lnl"))).alias("s"))
    pair = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a.tree AS t1, b.tree AS t2, a.lnl - b.lnl AS x))))")
    d = by.select("freq", F.explode(pair).alias("p")).select("freq", "p.*")
    m = d.groupBy("t1", "t2").agg(F.sum("freq").alias("n"), F.sum(F.col("freq") * F.col("x")).alias("sx"), F.sum(F.col("freq") * F.col("x") * F.col("x")).alias("sxx"))
    return m.select("t1", "t2", F.col("sx").alias("delta"), (F.col("n") / (F.col("n") - 1) * (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))).alias("var"))


def branch_tests(scores: DataFrame, trees: tuple[int, int, int]) -> DataFrame:
    """One row for three alternative trees around a branch, the first being the one tested: abayes, local bootstrap and SH-aLRT shares."""
    t = scores.where(F.col("tree").isin(*trees)).groupBy("rep").pivot("tree", list(trees)).agg(F.first("lnl"))
    a, b, c = (F.col(str(x)) for x in trees)
    first = [F.max(F.when(F.col("rep") == 0, x)).over(W.partitionBy()) for x in (a, b, c)]
    t = t.withColumns({"a0": first[0], "b0": first[1], "c0": first[2]})
    x, y, z = a - F.col("a0"), b - F.col("b0"), c - F.col("c0")
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    second = x + y + z - top - low
    alrt = F.col("a0") - F.greatest("b0", "c0") > top - second + 0.05
    boot = t.where("rep > 0")
    return boot.agg((1 / (1 + F.exp(F.max("b0") - F.max("a0")) + F.exp(F.max("c0") - F.max("a0")))).alias("abayes"), F.avg(((a >= b) & (a >= c)).cast("double")).alias("local_bp"), F.avg(alrt.cast("double")).alias("sh_alrt"))


def information_criteria(fits: DataFrame) -> DataFrame:
    """Of (tree or model, lnl, k, n): AIC, AICc, BIC, each one's weight and whether it is above 0.05. Over all fits of a comparison, so few."""
    aic = -2 * F.col("lnl") + 2 * F.col("k")
    f = fits.withColumn("aic", aic).withColumn("aicc", aic + 2 * F.col("k") * (F.col("k") + 1) / F.greatest(F.col("n") - F.col("k") - 1, F.lit(1))).withColumn("bic", -2 * F.col("lnl") + F.col("k") * F.log("n"))
    every = W.partitionBy()
    for c in ("aic", "aicc", "bic"):
        w = F.exp(-(F.col(c) - F.min(c).over(every)) / 2)
        f = f.withColumn(f"{c}_e", w).withColumn(f"{c}_weight", F.col(f"{c}_e") / F.sum(f"{c}_e").over(every)).drop(f"{c}_e")
        f = f.withColumn(f"{c}_confident", F.col(f"{c}_weight") > 0.05)
    return f


def support_correlation(splits: DataFrame, half: F.Column) -> DataFrame:
    """One row: the correlation of split supports in the trees where `half` holds and in all trees (absent: 0); 1 if either has no variance."""
    n = splits.groupBy("members").agg(F.countDistinct("tree").alias("x"), F.countDistinct(F.when(half, F.col("tree"))).alias("y"))
    m = n.agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(vx * vy > 0, vx.cast("double") * vy))
    return m.select(F.coalesce(r, F.lit(1.0)).alias("r"))


def weighted_tests(scores: DataFrame, variance: DataFrame) -> DataFrame:
    """(tree, wkh, wsh): KH and SH with each difference divided by its standard error; `variance` is (t1, t2, var) with t1 < t2."""
    s = scores.withColumn("c", F.col("lnl") - F.avg("lnl").over(W.partitionBy("tree"))).withColumn("own", F.max(F.when(F.col("rep") == 0, F.col("lnl"))).over(W.partitionBy("tree")))
    v = variance.select("t1", "t2", "var").unionByName(variance.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "var")).where("var > 0").select(F.col("t1").alias("tree"), F.col("t2").alias("u"), (1 / F.sqrt("var")).alias("w"))
    other = s.select(F.col("tree").alias("u"), "rep", F.col("c").alias("cu"), F.col("own").alias("ownu"))
    x = s.select("tree", "rep", "c", "own").join(v, "tree").join(other, ["u", "rep"])
    x = x.groupBy("tree", "rep").agg(
        F.max((F.col("cu") - F.col("c")) * F.col("w")).alias("m"), F.max((F.col("ownu") - F.col("own")) * F.col("w")).alias("m0"),
        F.max_by("w", F.struct("ownu", -F.col("u"))).alias("wt"), F.max_by(F.col("cu") - F.col("c"), F.struct("ownu", -F.col("u"))).alias("d"), F.max(F.col("ownu") - F.col("own")).alias("d0"),
    )
    return x.groupBy("tree").agg(F.avg((F.col("d") * F.col("wt") > F.col("d0") * F.col("wt")).cast("double")).alias("wkh"), F.avg((F.col("m") > F.col("m0")).cast("double")).alias("wsh"))


#: The scale factors of the multiscale bootstrap.
SCALES = tuple(i / 10 for i in range(5, 15))


def approximately_unbiased(patterns: DataFrame, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """(tree, au): the multiscale bootstrap test. At each scale the share of samples in which a tree is best, then a weighted fit of
    d sqrt(r) + c / sqrt(r) to its normal quantile, over the scales at which it is best neither always nor never; p = 1 - Phi(d - c), and with less than two such scales
    1 or 0.

    A scale is one task, which has the trees' pattern likelihoods; its samples are multinomial over the patterns, drawn with the scale's own seed, a bounded number at a time."""
    import numpy as np

    kind = patterns.schema["tree"].dataType.simpleString()

    def run(frame):
        import pandas as pd

        wide = frame.pivot(index=["ptn", "freq"], columns="tree", values="lnl").sort_index()
        trees, values = list(wide.columns), np.nan_to_num(wide.to_numpy(float))
        freq, scale = wide.index.get_level_values("freq").to_numpy(float), float(frame["scale"].iloc[0])
        g, wins, left = np.random.Generator(np.random.PCG64([seed, round(10 * scale)])), np.zeros(len(trees)), replicates
        while left:
            k = min(left, max(1, (1 << 22) // len(freq)))
            w = g.multinomial(max(1, round(freq.sum() * scale)), freq / freq.sum(), k)
            wins += np.bincount((w @ values).argmax(1), minlength=len(trees))
            left -= k
        return pd.DataFrame({"scale": scale, "tree": trees, "bp": wins / replicates})

    each = patterns.select("tree", "ptn", "lnl", "freq", F.explode(F.array(*map(F.lit, SCALES))).alias("scale"))
    shares = each.groupBy("scale").applyInPandas(run, f"scale double, tree {kind}, bp double")

    def fit(frame):
        import pandas as pd

        from cladeforge.functions.numerics import norm_cdf, norm_ppf

        told = frame[(frame["bp"] > 0) & (frame["bp"] < 1)]  # a tree that always or never wins at a scale tells nothing about the slope
        if len(told) < 2:
            return pd.DataFrame({"tree": frame["tree"].iloc[:1], "au": [float(frame["bp"].mean() > 0.5)]})
        bp, r = told["bp"].to_numpy(), told["scale"].to_numpy()
        z = np.array([-norm_ppf(b) for b in bp])
        density = np.exp(-(z**2) / 2) / np.sqrt(2 * np.pi)
        weight = density**2 * replicates / (bp * (1 - bp))
        x = np.stack([np.sqrt(r), 1 / np.sqrt(r)], 1)
        d, c = np.linalg.lstsq(x * np.sqrt(weight)[:, None], z * np.sqrt(weight), rcond=None)[0]
        au = 1 - norm_cdf(d - c)
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "au": [float(au)]})

    return shares.groupBy("tree").applyInPandas(fit, f"tree {kind}, au double")


def gene_samples(patterns: DataFrame, replicates: int, by_gene: str, by_site: str | None = None) -> DataFrame:
    """(rep, ptn, w) of patterns with their partition (part): whole partitions drawn `by_gene` times (SQL of rep and part), their sites as they are or, with `by_site`
    (SQL of rep and ptn), drawn within."""
    own = patterns.select("ptn", "part", "freq").distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    return own.select("rep", "ptn", (F.expr(by_gene) * (F.expr(by_site) if by_site else F.col("freq"))).cast("long").alias("w"))
