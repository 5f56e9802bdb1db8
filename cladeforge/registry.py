"""Every query of the library, and its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeforge.plans import alignment_queries, kernel_queries, more_queries, tree_queries

_MODULES = [alignment_queries, tree_queries, kernel_queries, more_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
