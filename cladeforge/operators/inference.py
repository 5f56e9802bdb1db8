"""Likelihood search, quartet mapping, rate fitting and least squares: dense work on the distinct columns of one alignment, spread over Spark by
start, quartet or model."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.functions.models import Model
from cladeforge.functions.numerics import minimise
from cladeforge.operators.likelihood import log_likelihoods, sweep, tip_arrays
from cladeforge.operators.newick import Node, parse, prune, reroot, topology, write
from cladeforge.operators.search import stepwise_addition


def interchanges(root: Node) -> Iterator[Node]:
    """All trees one nearest-neighbour interchange away, with the branch lengths of what stays."""
    text, seen = write(root, digits=17), {topology(root)}
    places = [(i, j) for i, x in enumerate(root.walk()) for j, c in enumerate(x.children) if c.children]
    for i, j in places:
        for a in range(8):
            tree = parse(text)
            x = list(tree.walk())[i]
            c = x.children[j]
            others = [k for k in range(len(x.children)) if k != j]
            if a >= len(others) * len(c.children):
                break
            k, m = others[a // len(c.children)], a % len(c.children)
            x.children[k], c.children[m] = c.children[m], x.children[k]
            if (t := topology(tree)) not in seen:
                seen.add(t)
                yield tree


def climb_likelihood(start: str, tips: dict[str, np.ndarray], weights: np.ndarray, model: Model, tol: float = 0.01) -> tuple[str, float]:
    """From a tree always to the best neighbour, until none is better by `tol`: neighbours are tried with one round over their lengths, the best one with several."""
    tree = parse(start)
    value = sweep(tree, tips, weights, model)
    while True:
        tried = [(sweep(t, tips, weights, model, rounds=1), n, t) for n, t in enumerate(interchanges(tree))]
        if not tried:
            break
        _, _, best = max(tried, key=lambda x: (x[0], -x[1]))
        now = sweep(best, tips, weights, model)
        if now <= value + tol:
            break
        tree, value = best, now
    return write(tree), value


def perturb(root: Node, moves: int, g: np.random.Generator) -> Node:
    """Random interchanges, `moves` of them."""
    for _ in range(moves):
        options = list(interchanges(root))
        if not options:
            break
        root = options[int(g.integers(len(options)))]
    return root


def likelihood_search(spark: SparkSession, patterns: DataFrame, taxa: list[str], model: Model, starts: int = 4, unsuccessful: int = 2) -> DataFrame:
    """(seed, newick, lnl): independent starts as rows. A start is a stepwise parsimony tree and its climb; then the best tree so far is perturbed (half as many
    interchanges as inner branches) and climbed again, until `unsuccessful` rounds in a row gave nothing better. The same seeds give the same trees.

    Distinct columns travel to each start's task; they grow with the alignment, whose memory a task must have (8 * states bytes a column and taxon)."""
    cols = patterns.groupBy("states").agg(F.sum("freq").alias("freq"))
    one = cols.agg(F.collect_list(F.struct("states", "freq")).alias("cols"))
    jobs = spark.range(starts).withColumnRenamed("id", "seed").join(F.broadcast(one)).repartition(starts, "seed")  # one row: the alignment, for every start

    def run(frame):
        import pandas as pd

        out = []
        for seed, own in zip(frame["seed"], frame["cols"], strict=True):
            own = sorted((tuple(c["states"]), c["freq"]) for c in own)
            m, w = np.array([c[0] for c in own], np.int64), np.array([c[1] for c in own], float)
            tips, masks = tip_arrays(m, taxa, len(model.freqs)), {t: m[:, i] for i, t in enumerate(taxa)}
            tree, value = climb_likelihood(stepwise_addition(masks, w.astype(np.int64), int(seed))[0], tips, w, model)
            g, lost = np.random.Generator(np.random.PCG64([int(seed), 7])), 0
            while lost < unsuccessful and len(taxa) > 4:
                other, now = climb_likelihood(write(perturb(parse(tree), max(1, (len(taxa) - 3) // 2), g)), tips, w, model)
                lost = 0 if now > value + 0.01 else lost + 1
                if now > value:
                    tree, value = other, now
            out.append((int(seed), tree, topology(parse(tree)), float(value)))
        return pd.DataFrame(out, columns=["seed", "newick", "topology", "lnl"])

    return jobs.groupBy("seed").applyInPandas(run, "seed long, newick string, topology string, lnl double")


# quartets


def quartet_patterns(patterns: DataFrame, n_taxa: int) -> DataFrame:
    """(q, a, b, c, d, states, freq): the patterns of each quartet of taxa (by place), distinct columns counted."""
    quartets = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip("abcd", q, strict=True)), F.lit(i).alias("q")) for i, q in enumerate(itertools.combinations(range(n_taxa), 4))))
    x = patterns.select("freq", "states", F.explode(quartets).alias("t"))
    x = x.select("t.*", F.expr("array(states[t.a], states[t.b], states[t.c], states[t.d])").alias("states"), "freq")
    return x.groupBy("q", "a", "b", "c", "d", "states").agg(F.sum("freq").alias("freq"))


def likelihood_mapping(patterns: DataFrame, n_taxa: int, model: Model) -> DataFrame:
    """(q, a, b, c, d, w1, w2, w3, area): of each quartet of taxa the posterior weights of its three trees, ab|cd, ac|bd and ad|bc, each at its best lengths, and the area of the
    triangle that they fall into: 1 to 3 a tree, 4 to 6 between trees 1 and 2, 2 and 3, 1 and 3, 7 the middle.

    A quartet is one small group (at most 15^4 distinct columns)."""

    def run(frame):
        import pandas as pd

        m = np.array(frame["states"].tolist(), np.int64)
        tips, w = tip_arrays(m, ["a", "b", "c", "d"], len(model.freqs)), frame["freq"].to_numpy(float)
        lnl = [sweep(parse(t), tips, w, model) for t in ("((a,b),c,d);", "((a,c),b,d);", "((a,d),b,c);")]
        p = np.exp(np.array(lnl) - max(lnl))
        p /= p.sum()
        return pd.DataFrame([[*frame.iloc[0][["q", "a", "b", "c", "d"]].astype(int), *p.tolist(), area(p)]], columns=["q", "a", "b", "c", "d", "w1", "w2", "w3", "area"])

    return quartet_patterns(patterns, n_taxa).groupBy("q").applyInPandas(run, "q int, a int, b int, c int, d int, w1 double, w2 double, w3 double, area int")


#: The corners, edges and middle of the triangle of quartet weights, in the order of areas.
ATTRACTORS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1 / 2, 1 / 2, 0), (0, 1 / 2, 1 / 2), (1 / 2, 0, 1 / 2), (1 / 3, 1 / 3, 1 / 3))


def area(p: np.ndarray) -> int:
    """The area of the nearest attractor, from 1."""
    return int(((np.array(ATTRACTORS) - p) ** 2).sum(1).argmin()) + 1


def mapping_summary(mapped: DataFrame, taxa: int) -> DataFrame:
    """(taxon, quartets, resolved, partly, unresolved): by taxon (its place; null for all quartets) how many of its quartets fall into the corners, the edges and the middle."""
    each = mapped.select("area", F.explode(F.array("a", "b", "c", "d")).alias("taxon")).unionByName(mapped.select("area", F.lit(None).cast("int").alias("taxon")))
    n = lambda c: F.sum(c.cast("long"))
    return each.groupBy("taxon").agg(F.count("*").alias("quartets"), n(F.col("area") <= 3).alias("resolved"), n(F.col("area").between(4, 6)).alias("partly"), n(F.col("area") == 7).alias("unresolved"))


# rates


def fit_free_rates(root: Node, tips: dict[str, np.ndarray], weights: np.ndarray, model: Model, k: int, rounds: int = 50, tol: float = 1e-3) -> tuple[Model, float]:
    """The likeliest k free rate classes and their shares for a tree, by expectation and maximisation, lengths fixed: posteriors of classes give new shares (1e-4 at least), then
    each class's rate is set to its best for its sites. The mean rate is 1 at the start and moves with the likelihood."""
    shares, rates = np.full(k, 1 / k), 2 * (np.arange(k) + 1) / (k + 1)
    make = lambda s, r: Model(model.q, model.freqs, r, s, 0.0, model.df + 2 * k - 2)
    last = -np.inf
    for _ in range(rounds):
        lnl, post = log_likelihoods(root, tips, make(shares, rates))
        now = float(weights @ lnl)
        if now - last < tol:
            break
        last = now
        shares = np.maximum(post.T @ weights / weights.sum(), 1e-4)
        shares = shares / shares.sum()
        for i in range(k):
            own = weights * post[:, i]
            rates[i], _ = minimise(lambda r, own=own: -float(own @ log_likelihoods(root, tips, make(np.ones(1), np.array([r])))[0]), 1e-4, 20.0, 1e-4)
    return make(shares, rates), max(last, now)


def fit_rates(root: Node, tips: dict[str, np.ndarray], weights: np.ndarray, build, bounds: dict[str, tuple[float, float]], rounds: int = 6, tol: float = 1e-3) -> tuple[dict[str, float], float]:
    """The best parameters of a model together with all branch lengths: `build` makes a model of named parameters, each of which is set to its best in turn, then the lengths."""
    at = {k: (lo * hi) ** 0.5 for k, (lo, hi) in bounds.items()}
    last = sweep(root, tips, weights, build(**at))
    for _ in range(rounds):
        for k, (lo, hi) in bounds.items():
            at[k], _ = minimise(lambda x, k=k: -float(weights @ log_likelihoods(root, tips, build(**{**at, k: x}))[0]), lo, hi, 1e-3)
        now = sweep(root, tips, weights, build(**at))
        if now - last < tol:
            break
        last = now
    return at, max(last, now)


# distances


def least_squares(tree: str, names: list[str], d: np.ndarray, weights: np.ndarray | None = None) -> tuple[str, float]:
    """The tree with the branch lengths whose path lengths come nearest to the distances (squares, weighted), none below 0; and the sum of squares."""
    root = parse(tree)
    branches = [x for x in root.walk() if x is not root]
    below = {x: set(x.leaves()) for x in branches}
    pairs = list(itertools.combinations(range(len(names)), 2))
    a = np.array([[float((names[i] in below[x]) != (names[j] in below[x])) for x in branches] for i, j in pairs])
    y = np.array([d[i, j] for i, j in pairs])
    w = np.ones(len(y)) if weights is None else np.array([weights[i, j] for i, j in pairs])
    free = np.ones(len(branches), bool)
    x = np.zeros(len(branches))
    while True:  # branches that come out negative are held at 0
        x[:] = 0.0
        x[free] = np.linalg.lstsq(a[:, free] * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if not (x[free] < -1e-12).any():
            break
        free &= ~(x < -1e-12)
    for b, v in zip(branches, x, strict=True):
        b.length = max(float(v), 0.0)
    return write(root), float((w * (a @ x - y) ** 2).sum())


def least_squares_trees(dist: DataFrame, tree: str, group: str, a: str = "t1", b: str = "t2", d: str = "d") -> DataFrame:
    """(group, newick, rss): the tree's least-squares lengths for each group's distances (a group is one alignment's taxa)."""
    kind = dist.schema[group].dataType.simpleString()

    def run(frame):
        import pandas as pd

        names = sorted(set(frame[a].astype(str)) | set(frame[b].astype(str)))
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for x, y, v in zip(frame[a].astype(str), frame[b].astype(str), frame[d], strict=True):
            m[at[x], at[y]] = m[at[y], at[x]] = v
        text, rss = least_squares(tree, names, m)
        return pd.DataFrame({group: frame[group].iloc[:1], "newick": [text], "rss": [rss]})

    return dist.groupBy(group).applyInPandas(run, f"{group} {kind}, newick string, rss double")


# when to stop


def weibull_stop(improvements: list[int], confidence: float = 0.95, latest: int = 10) -> float:
    """The round after which, with `confidence`, no improvement is to be expected, of the rounds that brought one: the endpoint of a Weibull fit to the last of them
    (Cooke's estimator with its upper bound); infinite for fewer than three."""
    t = np.array(sorted(improvements, reverse=True)[:latest], float)
    k = len(t)
    if k < 3 or t[0] == t[-1]:
        return float("inf")
    v = float(np.log((t[0] - t[-1]) / np.maximum(t[0] - t[1:-1], 1e-9)).sum() / (k - 1))
    v = min(max(v, 1e-3), 10.0)
    c = (-np.log(1 - confidence) / k) ** -v
    return float(t[0] + (t[0] - t[-1]) / max(c - 1, 1e-9)) if c > 1 else float("inf")


# regrafting


def unrooted(root: Node) -> str:
    """The one topology of an unrooted tree: its root is the node at the first leaf."""
    first = min(root.leaves())
    tree = reroot(parse(write(root, lengths=False)), first)
    rest = prune(tree, set(root.leaves()) - {first})  # nodes of one child are joined on the way
    return topology(Node("", None, "", [Node(first), *rest.children]))


def regrafts(root: Node) -> Iterator[str]:
    """The topologies one subtree pruning and regrafting away: every subtree, on every branch outside it, each topology once."""
    tree = parse(write(root, lengths=False))
    taxa = sorted(tree.leaves())
    seen = {unrooted(tree)}
    text = write(tree, lengths=False)
    sides = {frozenset(x.leaves()) for x in tree.walk() if x is not tree}
    every = frozenset(taxa)
    for part in sorted(sides | {every - s for s in sides}, key=lambda s: (len(s), sorted(s))):
        if len(every) - len(part) < 3:
            continue
        seen_from = reroot(parse(text), min(every - part))  # there the part is a clade, and its top is where it hangs
        rest, own = prune(seen_from, set(every - part)), prune(seen_from, set(part))
        for i, x in enumerate(list(rest.walk())):
            for j in range(len(x.children)):
                other = parse(write(rest, lengths=False))
                y = list(other.walk())[i]
                y.children[j] = Node("", None, "", [y.children[j], _rooted(own)])
                if (t := unrooted(other)) not in seen:
                    seen.add(t)
                    yield t


def _rooted(own: Node) -> Node:
    """A subtree to hang up; a lone leaf is itself."""
    kids = [c for c in own.children]
    return Node(own.name, None, "", kids) if kids else Node(own.name or own.leaves()[0])


# partitions


def merge_partitions(patterns: DataFrame, tree: str, taxa: list[str], models: list[str], freqs: list[float]) -> DataFrame:
    """(parts, model, lnl, k, n) of the partition scheme that greedy merging by BIC finds: every partition is fitted by itself, then as long as the whole scheme gets better the
    pair whose union helps most becomes one partition. `patterns` is (part, states, freq).

    A candidate set is one task with its own patterns; a round fits only sets it has not seen. The driver holds a row for each set (partitions are few)."""
    from cladeforge.operators.selection import fit

    spark = patterns.sparkSession
    known: dict[tuple, tuple] = {}

    def evaluate(sets: list[tuple]) -> None:
        jobs = spark.createDataFrame([(",".join(map(str, s)), p) for s in sets for p in s], "job string, part int")

        def run(frame):
            import pandas as pd

            cols: dict[tuple, float] = {}
            for st, f in zip(frame["states"], frame["freq"], strict=True):
                cols[tuple(st)] = cols.get(tuple(st), 0.0) + f
            m, w = np.array(sorted(cols), np.int64), np.array([cols[c] for c in sorted(cols)], float)
            tips, best = tip_arrays(m, taxa), None
            for name in models:
                lnl, k, _, filled = fit(name, tree, tips, w, np.array(freqs))
                bic = -2 * lnl + k * np.log(w.sum())
                if best is None or bic < best[0]:
                    best = (bic, filled, lnl, k)
            return pd.DataFrame([(frame["job"].iloc[0], best[1], float(best[2]), int(best[3]), int(w.sum()))], columns=["job", "model", "lnl", "k", "n"])

        rows = patterns.select("part", "states", "freq").join(F.broadcast(jobs), "part").groupBy("job").applyInPandas(run, "job string, model string, lnl double, k long, n long").collect()
        known.update({tuple(map(int, r.job.split(","))): (r.model, r.lnl, r.k, r.n) for r in rows})

    scheme = [(int(r[0]),) for r in patterns.select("part").distinct().orderBy("part").collect()]
    evaluate(scheme)
    total = sum(known[s][3] for s in scheme)
    score = lambda sets: sum(-2 * known[s][1] + known[s][2] * np.log(total) for s in sets)
    while len(scheme) > 1:
        unions = {tuple(sorted(a + b)): (a, b) for a, b in itertools.combinations(scheme, 2)}
        if new := [u for u in unions if u not in known]:
            evaluate(new)
        best = min(unions, key=lambda u: (score([u]) - score(unions[u]), u))
        if score([best]) >= score(unions[best]):
            break
        scheme = [s for s in scheme if s not in unions[best]] + [best]
    return spark.createDataFrame([(list(s), *known[s]) for s in sorted(scheme)], "parts array<int>, model string, lnl double, k long, n long")
