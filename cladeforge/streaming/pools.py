"""Streams of visited trees: the pool of best topologies, and the best tree of each bootstrap sample, kept up as trees arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def best_per_sample(scores: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """Of a stream (rep, tree, lnl): each sample's best tree so far, in update mode. A tree replaces another only if it is better by more than
    `epsilon`, or as good within it and of a smaller number; state is one row for each sample."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tree, lnl, seen = state.get if state.exists else (None, float("-inf"), 0)
        for f in frames:
            for t, v in zip(f["tree"], f["lnl"], strict=True):
                seen += 1
                if tree is None or v > lnl + epsilon or (abs(v - lnl) <= epsilon and t < tree):
                    tree, lnl = int(t), float(v)
        state.update((tree, lnl, seen))
        yield pd.DataFrame({"rep": [key[0]], "tree": [tree], "lnl": [lnl], "seen": [seen]})

    return scores.groupBy("rep").applyInPandasWithState(update, "rep int, tree long, lnl double, seen long", "tree long, lnl double, seen long", "update", GroupStateTimeout.NoTimeout)


def candidate_pool(trees: DataFrame, size: int = 5, group: str = "run") -> DataFrame:
    """Of a stream (run, topology, score): the `size` best different topologies of each run so far; a topology met again keeps its better score."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = dict(zip(*state.get, strict=True)) if state.exists else {}
        for f in frames:
            for t, s in zip(f["topology"], f["score"], strict=True):
                if t not in pool or s > pool[t]:
                    pool[t] = float(s)
        best = sorted(pool.items(), key=lambda x: (-x[1], x[0]))[:size]
        state.update(([t for t, _ in best], [s for _, s in best]))
        yield pd.DataFrame({group: key[0], "topology": [t for t, _ in best], "score": [s for _, s in best]})

    kind = trees.schema[group].dataType.simpleString()
    return trees.groupBy(group).applyInPandasWithState(update, f"{group} {kind}, topology string, score double", "topologies array<string>, scores array<double>", "update", GroupStateTimeout.NoTimeout)
