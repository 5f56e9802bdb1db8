"""Model selection: candidate models as rows, each fitted by one task to the alignment's patterns on one tree."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.functions.models import DNA, parse as model_of
from cladeforge.functions.numerics import minimise
from cladeforge.operators.likelihood import log_likelihoods, sweep, tip_arrays
from cladeforge.operators.newick import parse
from cladeforge.operators.search import MAX_PATTERNS
from cladeforge.operators.treetests import information_criteria


def _filled(name: str, rates: list[float], shape: float, invariant: float) -> str:
    """A model's name with values for its free rates, gamma shape and invariant share."""
    base, *parts = name.split("+")
    if rates:
        base += "{" + ",".join(f"{r:.10g}" for r in rates) + "}"
    out = []
    for p in parts:
        if re.fullmatch(r"G\d*", p):
            p += f"{{{shape:.10g}}}"
        elif p == "I":
            p += f"{{{invariant:.10g}}}"
        out.append(p)
    return "+".join([base, *out])


def fit(name: str, tree: str, tips: dict[str, np.ndarray], weights: np.ndarray, freqs: np.ndarray, rounds: int = 4) -> tuple[float, int, float, str]:
    """Log-likelihood, free parameters, growth of the tree's length and filled name of a model, its parameters and all branch lengths at their best; the parameters coordinate by
    coordinate, then the lengths. With +ASC the lengths share one scale."""
    root = parse(tree)
    lengths = {x: x.length or 0.0 for x in root.walk() if x is not root}
    whole = sum(lengths.values()) or 1.0
    code = DNA.get(name.split("+")[0].upper(), ("000000", True))[0]
    rates, shape, invariant, best = [1.0] * (len(set(code)) - 1), 1.0, 0.1, np.inf
    model = lambda rates, shape, invariant: model_of(_filled(name, rates, shape, invariant), freqs)

    def loss(rates: list[float], shape: float, invariant: float, scale: float = 1.0) -> float:
        return -float(weights @ log_likelihoods(root, tips, model(rates, shape, invariant), {x: x.length * scale for x in lengths})[0])

    for _ in range(rounds):
        before = best
        if "+ASC" in name:
            scale, best = minimise(lambda v: loss(rates, shape, invariant, v), 0.01, 20, 1e-4)
            for x in lengths:
                x.length *= scale
        else:
            best = -sweep(root, tips, weights, model(rates, shape, invariant), rounds=2)
        for i in range(len(rates)):
            rates[i], best = minimise(lambda v, i=i: loss([*rates[:i], v, *rates[i + 1 :]], shape, invariant), 0.02, 50, 1e-3)
        if "+G" in name:
            shape, best = minimise(lambda v: loss(rates, v, invariant), 0.02, 20, 1e-3)
        if "+I" in name:
            invariant, best = minimise(lambda v: loss(rates, shape, v), 1e-6, 0.95, 1e-3)
        if before - best < 0.01:
            break
    filled = _filled(name, rates, shape, invariant)
    return -best, model_of(filled, freqs).df + len(lengths), sum(x.length for x in lengths) / whole, filled


def select(spark: SparkSession, patterns: DataFrame, tree: str, taxa: list[str], names: list[str], freqs: list[float]) -> DataFrame:
    """(model, lnl, k, n, scale, fitted) with AIC, AICc, BIC and their weights. Patterns (states, freq) are sent to each task whole: at most `MAX_PATTERNS`."""
    rows = patterns.select("states", "freq").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError("too many patterns for one task; select by partition")
    sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)))

    def run(frames):
        import pandas as pd

        states, weights = sent.value
        tips = tip_arrays(states, taxa)
        for f in frames:
            out = [(m, *fit(m, tree, tips, weights, np.array(freqs))) for m in f["model"]]
            yield pd.DataFrame(out, columns=["model", "lnl", "k", "scale", "fitted"]).assign(n=int(weights.sum()))[["model", "lnl", "k", "n", "scale", "fitted"]]

    grid = spark.createDataFrame([(m,) for m in names], "model string").repartition(len(names))
    fits = grid.mapInPandas(run, "model string, lnl double, k long, n long, scale double, fitted string")
    return information_criteria(fits).withColumn("rank", F.expr("row_number() OVER (ORDER BY bic, model)"))
