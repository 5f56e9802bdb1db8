"""Functions for SQL: register(spark) makes them callable by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """chi2_sf(x, df), newick_topology(text), newick_leaves(text), newick_splits(text), newick_length(text); null for null."""
    from cladeforge.functions import numerics
    from cladeforge.operators import newick

    @F.pandas_udf("double")
    def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), index=x.index, dtype="float64")
        for k in df.dropna().unique():  # a batch has few degrees of freedom, and the kernel takes many values at once
            own = (df == k) & x.notna()
            out[own] = numerics.chi2_sf(x[own].to_numpy(), float(k))
        return out.astype("Float64").mask(x.isna() | df.isna())

    def of_tree(kind, f):
        @F.pandas_udf(kind)
        def run(text: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else f(newick.parse(t)) for t in text])

        return run

    spark.udf.register("chi2_sf", chi2_sf)
    spark.udf.register("newick_topology", of_tree("string", newick.topology))
    spark.udf.register("newick_leaves", of_tree("array<string>", lambda n: sorted(n.leaves())))
    spark.udf.register("newick_splits", of_tree("array<string>", lambda n: sorted(",".join(sorted(s)) for s, _ in newick.splits(n))))
    spark.udf.register("newick_length", of_tree("double", lambda n: sum(x.length or 0.0 for x in n.walk())))
