"""Likelihood and parsimony of site patterns on a tree.

Small trees become column expressions: one projection over the patterns, inside Spark's generated code. Trees of any size go through an
Arrow kernel that treats a batch of patterns at once; both read patterns (states: masks in the order of taxa, freq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeforge.functions.models import Model
from cladeforge.functions.numerics import minimise
from cladeforge.operators.newick import Node, parse, write

N_STATES = 4


def fitch(patterns: DataFrame, tree: str, taxa: list[str]) -> DataFrame:
    """Adds score: the fewest changes of each pattern on a tree with nodes of two children (a root of three is taken in turn)."""
    root, cost, n, out = parse(tree), [], 0, patterns
    where: dict[Node, str] = {}
    for x in root.walk():
        if not x.children:
            where[x] = f"states[{taxa.index(x.name)}]"
            continue
        own = where[x.children[0]]
        for child in x.children[1:]:
            n += 1
            both = F.expr(f"{own} & {where[child]}")
            out = out.withColumn(f"__s{n}", F.when(both != 0, both).otherwise(F.expr(f"{own} | {where[child]}")))
            cost.append(F.expr(f"CAST(({own} & {where[child]}) = 0 AS BIGINT)"))
            own = f"__s{n}"
        where[x] = own
    return out.withColumn("score", sum(cost[1:], cost[0])).drop(*(f"__s{i}" for i in range(1, n + 1)))


def pattern_likelihood(patterns: DataFrame, tree: str, taxa: list[str], model: Model) -> DataFrame:
    """Adds lnl of each pattern as a column expression; for trees of a few dozen leaves (site-rate classes multiply the columns)."""
    root, out = parse(tree), patterns
    total = None
    for c, (rate, share) in enumerate(zip(model.rates, model.shares, strict=True)):
        where: dict[Node, list[Column]] = {}
        for k, x in enumerate(root.walk()):
            if not x.children:
                mask = F.element_at("states", taxa.index(x.name) + 1)
                where[x] = [F.when(mask.bitwiseAND(1 << s) != 0, 1.0).otherwise(0.0) for s in range(N_STATES)]
                continue
            product: list[Column | None] = [None] * N_STATES
            for child in x.children:
                p = model.p(rate * (child.length or 0.0))
                for s in range(N_STATES):
                    part = sum(F.lit(float(p[s, t])) * where[child][t] for t in range(N_STATES))
                    product[s] = part if product[s] is None else product[s] * part
            names = [f"__l{c}_{k}_{s}" for s in range(N_STATES)]
            out = out.withColumns(dict(zip(names, product, strict=True)))
            where[x] = [F.col(n) for n in names]
        own = F.lit(float(share)) * sum(F.lit(float(model.freqs[s])) * where[root][s] for s in range(N_STATES))
        total = own if total is None else total + own
    if model.invariant:
        shared = F.aggregate("states", F.lit((1 << N_STATES) - 1), lambda a, x: a.bitwiseAND(x))
        total = total + model.invariant * sum(F.when(shared.bitwiseAND(1 << s) != 0, float(model.freqs[s])).otherwise(0.0) for s in range(N_STATES))
    out = out.withColumn("lnl", F.log(total))
    return out.drop(*(c for c in out.columns if c.startswith("__l")))


# the kernel for trees of any size


def partials(root: Node, tips: dict[str, np.ndarray], model: Model, lengths: dict[Node, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the root: likelihoods (class, pattern, state) and the logarithm of what was scaled away (class, pattern). tips: 0/1 arrays (pattern, state)."""
    below: dict[Node, np.ndarray] = {}
    n = len(next(iter(tips.values())))
    scale = np.zeros((len(model.rates), n))
    for x in root.walk():
        if not x.children:
            below[x] = np.broadcast_to(tips[x.name], (len(model.rates), *tips[x.name].shape))
            continue
        own = None
        for c in x.children:
            length = (lengths or {}).get(c, c.length or 0.0)
            part = np.einsum("cst,cpt->cps", model.p(model.rates * length), below.pop(c))
            own = part if own is None else own * part
        top = own.max(2)
        small = (top < 1e-100) & (top > 0)
        if small.any():
            factor = np.where(small, top, 1.0)
            own, scale = own / factor[:, :, None], scale + np.log(factor)
        below[x] = own
    return below[root], scale


def log_likelihoods(root: Node, tips: dict[str, np.ndarray], model: Model, lengths: dict[Node, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per pattern the log-likelihood, and the posterior probability of each rate class (pattern, class; an invariant class last)."""
    if model.error:
        tips = {t: misread(x, model.error) for t, x in tips.items()}
    like, scale = partials(root, tips, model, lengths)
    by_class = (like @ model.freqs) * model.shares[:, None]
    if model.invariant:
        both = np.prod([t for t in tips.values()], axis=0)
        by_class = np.concatenate([by_class, model.invariant * (both @ model.freqs)[None]])
        scale = np.concatenate([scale, np.zeros((1, scale.shape[1]))])
    high = scale.max(0)
    each = by_class * np.exp(scale - high)
    total = each.sum(0)
    lnl = np.log(np.maximum(total, 1e-320)) + high
    if model.ascertainment:
        seen = {k: np.eye(len(model.freqs)) for k in tips}
        lnl = lnl - np.log1p(-np.exp(log_likelihoods(root, seen, Model(model.q, model.freqs, model.rates, model.shares, model.invariant), lengths)[0]).sum())
    return lnl, (each / np.maximum(total, 1e-320)).T


def misread(tip: np.ndarray, error: float) -> np.ndarray:
    """The chance of reading one of a tip's states (0/1) from each true state, each other state being read with the same chance."""
    k = tip.shape[1]
    return (1 - error) * tip + error / (k - 1) * (tip.sum(1, keepdims=True) - tip)


def tip_arrays(states: np.ndarray, taxa: list[str], n_states: int = N_STATES) -> dict[str, np.ndarray]:
    """0/1 arrays of masks (pattern, taxon)."""
    return {t: ((states[:, i, None] >> np.arange(n_states)) & 1).astype(float) for i, t in enumerate(taxa)}


def score_patterns(patterns: DataFrame, tree: str, taxa: list[str], model: Model) -> DataFrame:
    """Adds lnl and posterior (array: of each rate class) to patterns, batch by batch."""
    schema = T.StructType([*patterns.schema.fields, T.StructField("lnl", T.DoubleType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    at = patterns.columns.index("states")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse(tree)
        for b in batches:
            if b.num_rows:
                states = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
                lnl, post = log_likelihoods(root, tip_arrays(states, taxa, len(model.freqs)), model)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lnl), pa.array(post.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return patterns.mapInArrow(run, schema)


def site_rates(scored: DataFrame, model: Model) -> DataFrame:
    """Adds rate: the posterior mean of the site-rate classes, and category: the likeliest one (from 1), the first of those that agree to nine digits."""
    rates = [float(r) for r in model.rates] + ([0.0] if model.invariant else [])
    mean = sum(F.element_at("posterior", i + 1) * r for i, r in enumerate(rates))
    near = F.transform("posterior", lambda x: F.round(x, 9))
    return scored.withColumn("rate", mean).withColumn("category", F.array_position(near, F.array_max(near)))


def ancestral(root: Node, tips: dict[str, np.ndarray], model: Model, node: Node) -> np.ndarray:
    """Marginal posterior of a node's states (pattern, state), by pruning towards it."""
    joint = np.zeros((len(next(iter(tips.values()))), len(model.freqs)))
    for s in range(len(model.freqs)):
        mark = Node("\0", 0.0)
        node.children.append(mark)
        one = np.zeros_like(joint)
        one[:, s] = 1.0
        like, scale = partials(root, {**tips, "\0": one}, model)
        node.children.pop()
        joint[:, s] = ((like @ model.freqs) * model.shares[:, None] * np.exp(scale - scale.max())).sum(0)
    return joint / joint.sum(1, keepdims=True)


def optimise_lengths(root: Node, tips: dict[str, np.ndarray], weights: np.ndarray, model: Model, rounds: int = 5, tol: float = 1e-4) -> float:
    """Set each branch's length to its best, in turn, until the log-likelihood gains less than `tol`; returns it."""
    branches = [x for x in root.walk() if x is not root]
    last = -np.inf
    for _ in range(rounds):
        for x in branches:

            def loss(t: float, x: Node = x) -> float:
                return -float(weights @ log_likelihoods(root, tips, model, {x: t})[0])

            x.length, value = minimise(loss, 1e-6, 5.0, 1e-5)
        if -value - last < tol:
            break
        last = -value
    return -value


def sweep(root: Node, tips: dict[str, np.ndarray], weights: np.ndarray, model: Model, rounds: int = 3, tol: float = 1e-3) -> float:
    """Set all branch lengths to their best, `rounds` times from the root down, and return the log-likelihood.

    At each branch what lies on its two sides is at hand, so a length is tried for the price of one product of matrices. Reversible models only."""
    shares, rates, freqs = model.shares, model.rates, model.freqs
    both = model.invariant * (np.prod(list(tips.values()), axis=0) @ freqs) if model.invariant else 0.0
    down: dict[Node, np.ndarray] = {}

    def move(x: Node, t: float) -> np.ndarray:
        return np.einsum("cst,cpt->cps", model.p(rates * t), down[x])

    def below(x: Node) -> np.ndarray:
        if not x.children:
            return np.broadcast_to(tips[x.name], (len(rates), *tips[x.name].shape))
        out = move(x.children[0], x.children[0].length)
        for c in x.children[1:]:
            out = out * move(c, c.length)
        return out

    def value(outside: np.ndarray, x: Node, t: float) -> float:
        each = np.einsum("cps,cps->cp", outside, move(x, t))
        return float(weights @ np.log(np.maximum(shares @ each + both, 1e-300)))

    def visit(x: Node, outside: np.ndarray) -> None:
        """`outside`: the likelihood of all that is not below x, with the root's frequencies, at x."""
        for c in x.children:
            rest = outside
            for k in x.children:
                if k is not c:
                    rest = rest * move(k, k.length)
            c.length, _ = minimise(lambda t, rest=rest, c=c: -value(rest, c, t), 1e-6, 5.0, 1e-3)
            if c.children:
                visit(c, np.einsum("cps,cst->cpt", rest, model.p(rates * c.length)))
                down[c] = below(c)

    last = -np.inf
    for x in root.walk():
        if x is not root:
            x.length = 0.1 if x.length is None else max(x.length, 1e-6)
    for _ in range(rounds):
        for x in root.walk():
            down[x] = below(x)
        visit(root, np.broadcast_to(freqs, down[root].shape))
        c = root.children[0]
        rest = np.broadcast_to(freqs, down[root].shape)
        for k in root.children[1:]:
            rest = rest * move(k, k.length)
        now = value(rest, c, c.length)
        if now - last < tol:
            break
        last = now
    return max(now, last)


def scaled(tree: str, rate: float) -> str:
    """The tree with all lengths times `rate`."""
    root = parse(tree)
    for x in root.walk():
        if x.length is not None:
            x.length *= rate
    return write(root)


def partition_likelihood(patterns: DataFrame, tree: str, taxa: list[str], models: dict[int, tuple[Model, float]]) -> DataFrame:
    """(part, lnl): each partition under its own model, the tree's lengths times the partition's rate (proportional; rates 1: equal lengths)."""
    parts = []
    for part, (model, rate) in models.items():
        parts.append(pattern_likelihood(patterns.where(F.col("part") == part), scaled(tree, rate), taxa, model).select("part", "freq", "lnl"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("part").agg(F.sum(F.col("freq") * F.col("lnl")).alias("lnl"))


def mixture(patterns: DataFrame, tree: str, taxa: list[str], models: list[Model], weights: list[float]) -> DataFrame:
    """Adds lnl and class_posterior (array: of each model) of a mixture of models across sites."""
    schema = T.StructType([*patterns.schema.fields, T.StructField("lnl", T.DoubleType()), T.StructField("class_posterior", T.ArrayType(T.DoubleType()))])
    at = patterns.columns.index("states")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse(tree)
        for b in batches:
            if b.num_rows:
                states = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
                each = np.stack([np.log(w) + log_likelihoods(root, tip_arrays(states, taxa, len(m.freqs)), m)[0] for m, w in zip(models, weights, strict=True)], 1)
                top = each.max(1, keepdims=True)
                e = np.exp(each - top)
                lnl = top[:, 0] + np.log(e.sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lnl), pa.array((e / e.sum(1, keepdims=True)).tolist(), pa.list_(pa.float64()))], names=schema.names)

    return patterns.mapInArrow(run, schema)


def site_frequencies(scored: DataFrame, models: list[Model]) -> DataFrame:
    """Adds f: the posterior mean of the classes' frequencies at each pattern (array, by state)."""
    f = [sum(F.element_at("class_posterior", i + 1) * float(m.freqs[s]) for i, m in enumerate(models)) for s in range(len(models[0].freqs))]
    return scored.withColumn("f", F.array(*f))


def ml_distance(counts: np.ndarray, model: Model) -> tuple[float, float]:
    """The likeliest distance of two sequences with a matrix of state-pair counts, and the variance (of the curvature there)."""
    if counts.sum() == 0:
        return 9.0, 0.0

    def loss(t: float) -> float:
        p = sum(s * model.p(r * t) for r, s in zip(model.rates, model.shares, strict=True)) + model.invariant * np.eye(len(model.freqs))
        return -float((counts * np.log(np.maximum(p, 1e-300))).sum())

    t, at = minimise(loss, 1e-6, 9.0)
    h = max(1e-4, 1e-3 * t)
    second = (loss(t + h) - 2 * at + loss(max(t - h, 1e-9))) / h**2
    return t, 1 / second if second > 0 else float("inf")


def sankoff(root: Node, states: dict[str, int], cost: np.ndarray) -> float:
    """The least cost of one site's states (masks) under a cost matrix."""
    k, below = len(cost), {}
    for x in root.walk():
        if not x.children:
            below[x] = np.where((states[x.name] >> np.arange(k)) & 1, 0.0, np.inf)
        else:
            below[x] = sum((cost + below[c][None, :]).min(1) for c in x.children)
    return float(below[root].min())


def sankoff_patterns(patterns: DataFrame, tree: str, taxa: list[str], cost: list[list[float]]) -> DataFrame:
    """Adds score: the least cost of each pattern on a tree under a cost matrix, batch by batch."""
    schema = T.StructType([*patterns.schema.fields, T.StructField("score", T.DoubleType())])
    at, c = patterns.columns.index("states"), np.array(cost, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse(tree)
        for b in batches:
            if b.num_rows:
                states = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
                tips, below = tip_arrays(states, taxa, len(c)), {}
                for x in root.walk():
                    below[x] = sum((below[k][:, None, :] + c[None]).min(2) for k in x.children) if x.children else np.where(tips[x.name] > 0, 0.0, np.inf)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(below[root].min(1))], names=schema.names)

    return patterns.mapInArrow(run, schema)


def ancestral_states(patterns: DataFrame, tree: str, taxa: list[str], model: Model, node: int = 0) -> DataFrame:
    """Adds marginal: the posterior probability of each state at an inner node, counted from the root (0) down, and best: the likeliest state's mask."""
    schema = T.StructType([*patterns.schema.fields, T.StructField("marginal", T.ArrayType(T.DoubleType())), T.StructField("best", T.IntegerType())])
    at = patterns.columns.index("states")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse(tree)
        inner = [x for x in reversed(list(root.walk())) if x.children]
        for b in batches:
            if b.num_rows:
                states = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
                post = ancestral(root, tip_arrays(states, taxa, len(model.freqs)), model, inner[node])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(post.tolist(), pa.list_(pa.float64())), pa.array((1 << post.round(9).argmax(1)).astype(np.int32))], names=schema.names)

    return patterns.mapInArrow(run, schema)
