"""Trees from data: distance methods, stepwise addition, interchanges, random trees, simulation, stands, concordance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.functions.models import Model
from cladeforge.operators.newick import Node, neighbours, parse, prune, splits, topology, write


def neighbour_joining(names: list[str], d: np.ndarray, variances: bool = False) -> str:
    """The neighbour-joining tree of a distance matrix; with `variances` new distances weigh the two by BIONJ's rule."""
    nodes, d = [Node(n) for n in names], d.astype(float).copy()
    v = d.copy()
    while len(nodes) > 3:
        n = len(nodes)
        r = d.sum(1)
        q = d - (r[:, None] + r[None, :]) / (n - 2)
        q[np.tril_indices(n)] = np.inf
        i, j = divmod(int(q.argmin()), n)
        half = (r[i] - r[j]) / (2 * (n - 2))
        li, lj = d[i, j] / 2 + half, d[i, j] / 2 - half
        lam = 0.5
        if variances and v[i, j] > 0:
            lam = float(np.clip(0.5 + (np.delete(v[j], [i, j]) - np.delete(v[i], [i, j])).sum() / (2 * (n - 2) * v[i, j]), 0, 1))
        new = lam * (d[i] - li) + (1 - lam) * (d[j] - lj)
        new_v = lam * v[i] + (1 - lam) * v[j] - lam * (1 - lam) * v[i, j]
        nodes[i].length, nodes[j].length = float(li), float(lj)
        joined = Node("", None, "", [nodes[i], nodes[j]])
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep, None]], [new[None, keep], np.zeros((1, 1))]])
        v = np.block([[v[np.ix_(keep, keep)], new_v[keep, None]], [new_v[None, keep], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in keep] + [joined]
    if len(nodes) == 3:
        for i, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
            nodes[i].length = float((d[i, a] + d[i, b] - d[a, b]) / 2)
    return write(Node("", None, "", nodes))


def upgma(names: list[str], d: np.ndarray) -> str:
    nodes, size, height, d = [Node(n) for n in names], [1] * len(names), [0.0] * len(names), d.astype(float).copy()
    while len(nodes) > 1:
        n = len(nodes)
        q = d.copy()
        q[np.tril_indices(n)] = np.inf
        i, j = divmod(int(q.argmin()), n)
        h = d[i, j] / 2
        nodes[i].length, nodes[j].length = float(h - height[i]), float(h - height[j])
        keep = [k for k in range(n) if k not in (i, j)]
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d = np.block([[d[np.ix_(keep, keep)], new[keep, None]], [new[None, keep], np.zeros((1, 1))]])
        joined = Node("", None, "", [nodes[i], nodes[j]])
        nodes, size, height = [nodes[k] for k in keep] + [joined], [size[k] for k in keep] + [size[i] + size[j]], [height[k] for k in keep] + [float(h)]
    return write(nodes[0])


def metric_closure(d: np.ndarray) -> np.ndarray:
    """Shortest paths between all pairs."""
    d = d.copy()
    for k in range(len(d)):
        d = np.minimum(d, d[:, k, None] + d[None, k, :])
    return d


BUILDERS = {"NJ": neighbour_joining, "BIONJ": lambda n, d: neighbour_joining(n, d, True), "UPGMA": upgma}


def distance_trees(dist: DataFrame, group: str, a: str = "t1", b: str = "t2", d: str = "d", method: str = "NJ") -> DataFrame:
    """(group, newick): a tree for each group's distances; a group's matrix is one task's, so each has the taxa of one alignment."""
    kind = dist.schema[group].dataType.simpleString()

    def build(frame):
        import pandas as pd

        names = sorted(set(frame[a]) | set(frame[b]))
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for x, y, v in zip(frame[a], frame[b], frame[d], strict=True):
            m[at[x], at[y]] = m[at[y], at[x]] = v
        return pd.DataFrame({group: frame[group].iloc[:1], "newick": [BUILDERS[method]([str(n) for n in names], m)]})

    return dist.groupBy(group).applyInPandas(build, f"{group} {kind}, newick string")


# parsimony searches over patterns (masks by taxon name, weights)


def parsimony(root: Node, states: dict[str, np.ndarray], weights: np.ndarray) -> int:
    total, below = np.zeros(len(weights), np.int64), {}
    for x in root.walk():
        if not x.children:
            below[x] = states[x.name]
            continue
        own = below[x.children[0]]
        for c in x.children[1:]:
            both = own & below[c]
            total += both == 0
            own = np.where(both == 0, own | below[c], both)
        below[x] = own
    return int((total * weights).sum())


def _places(n: Node) -> Iterator[tuple[Node, int]]:
    for x in list(n.walk()):
        for i in range(len(x.children)):
            yield x, i


def stepwise_addition(states: dict[str, np.ndarray], weights: np.ndarray, seed: int = 1) -> tuple[str, int]:
    """A parsimony tree: taxa in a seeded order, each put on the branch that costs least (the first of several)."""
    order = [sorted(states)[i] for i in np.random.Generator(np.random.PCG64(seed)).permutation(len(states))]
    root = Node("", None, "", [Node(t) for t in order[:3]])
    for t in order[3:]:
        best = None
        for x, i in _places(root):
            old = x.children[i]
            x.children[i] = Node("", None, "", [old, Node(t)])
            score = parsimony(root, states, weights)
            x.children[i] = old
            if best is None or score < best[0]:
                best = (score, x, i)
        _, x, i = best
        x.children[i] = Node("", None, "", [x.children[i], Node(t)])
    return topology(root), parsimony(root, states, weights)


def climb(start: str, score, limit: int = 1000) -> tuple[str, float]:
    """Interchanges from a tree, always to the best neighbour (a smaller score), until none is better."""
    tree, value = start, score(parse(start))
    for _ in range(limit):
        found = min(((score(parse(t)), t) for t in neighbours(parse(tree))), default=(value, tree))
        if found[0] >= value:
            break
        value, tree = found
    return tree, value


def parsimony_search(spark: SparkSession, patterns: DataFrame, taxa: list[str], starts: int = 8) -> DataFrame:
    """(seed, newick, score): independent starts as rows, each a stepwise tree and its climb; patterns are broadcast, as distinct columns of one alignment
    are few (at most `MAX_PATTERNS`)."""
    rows = patterns.where("informative").select("states", "freq").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError("too many patterns for one task; search by partition")
    m, w = np.array([r[0] for r in rows], np.int64).reshape(len(rows), -1), np.array([r[1] for r in rows], np.int64)
    sent = spark.sparkContext.broadcast(({t: m[:, i] if len(rows) else np.zeros(0, np.int64) for i, t in enumerate(taxa)}, w))

    def run(frames):
        import pandas as pd

        states, weights = sent.value
        for f in frames:
            out = []
            for seed in f["seed"]:
                tree, _ = stepwise_addition(states, weights, int(seed))
                tree, value = climb(tree, lambda n: parsimony(n, states, weights))
                out.append((seed, topology(parse(tree)), int(value)))
            yield pd.DataFrame(out, columns=["seed", "newick", "score"])

    return spark.range(starts).withColumnRenamed("id", "seed").repartition(min(starts, spark.sparkContext.defaultParallelism)).mapInPandas(run, "seed long, newick string, score long")


MAX_PATTERNS = 200_000


# generators


def random_tree(n: int, kind: str, seed: int, mean: float = 0.1) -> str:
    """A tree of taxa T1..Tn: uniform, yule, caterpillar, balanced or star with exponential branch lengths, or birth-death (`death` half as often as birth) with times."""
    g = np.random.Generator(np.random.PCG64(seed))
    if kind == "birth-death":
        return write(_birth_death(n, g, mean))
    make = lambda i: Node(f"T{i + 1}")
    if kind == "star":
        root = Node("", None, "", [make(i) for i in range(n)])
    elif kind == "balanced":
        level = [make(i) for i in range(n)]
        while len(level) > 3:
            level = [Node("", None, "", level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        root = Node("", None, "", level)
    else:
        root = Node("", None, "", [make(i) for i in range(min(n, 3))])
        for i in range(3, n):
            places = list(_places(root))
            if kind == "yule":
                places = [(x, k) for x, k in places if not x.children[k].children]
            x, k = places[-1] if kind == "caterpillar" else places[int(g.integers(len(places)))]
            x.children[k] = Node("", None, "", [x.children[k], make(i)])
    for x in root.walk():
        if x is not root:
            x.length = float(g.exponential(mean))
    return write(root)


def _birth_death(n: int, g: np.random.Generator, mean: float, death: float = 0.5) -> Node:
    """Lineages split at rate 1 and end at rate `death` until n are alive; those that ended are left out, and the mean branch length is set to `mean`."""
    while True:
        root = Node("", 0.0)
        alive = [root]
        while 0 < len(alive) < n:
            step = float(g.exponential(1 / (len(alive) * (1 + death))))
            for x in alive:
                x.length += step
            x = alive.pop(int(g.integers(len(alive))))
            if g.random() < 1 / (1 + death):
                x.children = [Node("", 0.0), Node("", 0.0)]
                alive += x.children
            else:
                x.name = "gone"
        if len(alive) == n:
            break
    step = float(g.exponential(1 / (n * (1 + death))))
    for i, x in enumerate(alive):
        x.length, x.name = x.length + step, f"T{i + 1}"

    def trim(x: Node) -> Node | None:
        if not x.children:
            return None if x.name == "gone" else x
        kids = [k for c in x.children if (k := trim(c))]
        if len(kids) == 1:
            kids[0].length += x.length
            return kids[0]
        x.children = kids
        return x if kids else None

    out = trim(root)
    inner = [x for x in out.walk() if x is not out]
    factor = mean * len(inner) / max(sum(x.length for x in inner), 1e-300)
    for x in inner:
        x.length *= factor
    out.length = None
    return out


def random_trees(spark: SparkSession, count: int, n: int, kind: str = "yule", seed: int = 1) -> DataFrame:
    """(tree, newick): independent of partitions, as each tree has its own seed."""

    def run(frames):
        for f in frames:
            yield f.assign(newick=[random_tree(n, kind, seed * 1_000_003 + int(t)) for t in f["tree"]])

    return spark.range(count).withColumnRenamed("id", "tree").mapInPandas(run, "tree long, newick string")


def simulate(spark: SparkSession, tree: str, model: Model, sites: int, seed: int = 1, block: int = 1000) -> DataFrame:
    """(taxon, site, mask): sites evolve independently, block by block, each block with its own seed."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for b in f["id"]:
                root, n = parse(tree), min(block, sites - int(b) * block)
                g = np.random.Generator(np.random.PCG64([seed, int(b)]))
                p_class = np.append(model.shares, model.invariant)
                rate = np.append(model.rates, 0.0)[g.choice(len(p_class), n, p=p_class / p_class.sum())]
                state = {root: g.choice(len(model.freqs), n, p=model.freqs)}
                for x in reversed(list(root.walk())):
                    for c in x.children:
                        p = model.p(rate * (c.length or 0.0))[np.arange(n), state[x]]
                        state[c] = (p.cumsum(1) / p.sum(1, keepdims=True) < g.random((n, 1))).sum(1)
                for x, s in state.items():
                    if not x.children:
                        yield pd.DataFrame({"taxon": x.name, "site": int(b) * block + np.arange(1, n + 1), "mask": 1 << s})

    return spark.range(-(-sites // block)).mapInPandas(run, "taxon string, site long, mask int")


def displays(tree: Node, part: Node) -> bool:
    """Whether a tree, cut down to a partial tree's taxa, has all of its splits."""
    own = prune(tree, set(part.leaves()))
    return {s for s, _ in splits(part)} <= {s for s, _ in splits(own)}


def stand(parts: list[str], limit: int = 100_000) -> list[str]:
    """All trees that display every partial tree, taxon by taxon; raises if there are more than `limit` on the way."""
    trees = [parse(p) for p in parts]
    start = max(trees, key=lambda t: len(t.leaves()))
    level = [topology(start)]
    have = set(start.leaves())
    for t in sorted({x for p in trees for x in p.leaves()} - have):
        have.add(t)
        cut = [q for p in trees if t in p.leaves() and (q := prune(p, have)) and len(q.leaves()) > 3]
        new = set()
        for text in level:
            root = parse(text)
            for x, i in list(_places(root)):
                old = x.children[i]
                x.children[i] = Node("", None, "", [old, Node(t)])
                if all(displays(root, q) for q in cut):
                    new.add(topology(root))
                x.children[i] = old
        if len(new) > limit:
            raise ValueError("more trees than the limit")
        level = sorted(new)
    return [t for t in level if all(displays(parse(t), p) for p in trees)]


# concordance


def quartet_branches(root: Node) -> list[tuple[list[str], list[str], list[str], list[str]]]:
    """The four clades around each inner branch of a tree whose nodes have two children (its root three)."""
    taxa, out, below = set(root.leaves()), [], {}
    for x in root.walk():
        below[x] = set(x.leaves())
    for x in root.walk():
        for c in x.children:
            if c.children and len(c.children) == 2:
                others = [k for k in x.children if k is not c]
                rest = taxa - below[x]
                far = [sorted(below[k]) for k in others] + ([sorted(rest)] if rest else [])
                if len(far) == 2:
                    out.append((sorted(below[c.children[0]]), sorted(below[c.children[1]]), far[0], far[1]))
    return out


def site_concordance(patterns: DataFrame, tree: str, taxa: list[str]) -> DataFrame:
    """(branch, scf, sdf1, sdf2, quartets): over all quartets around each inner branch, the mean share of decisive sites (all four states unambiguous, two of
    each of two) that support each grouping, in percent."""
    at = {t: i for i, t in enumerate(taxa)}
    quartets = [(b, at[i], at[j], at[k], at[m]) for b, (p, q, r, s) in enumerate(quartet_branches(parse(tree))) for i, j, k, m in itertools.product(p, q, r, s)]
    array = F.expr("array(" + ", ".join(f"struct({b} AS b, {i} AS i, {j} AS j, {k} AS k, {m} AS m)" for b, i, j, k, m in quartets) + ")")
    x = patterns.where("informative").select("freq", "states", F.explode(array).alias("q"))
    s = {n: F.expr(f"states[q.{n}]") for n in "ijkm"}
    x = x.select("freq", "q", *(v.alias(n) for n, v in s.items())).where(" AND ".join(f"bit_count({n}) = 1" for n in "ijkm"))
    kind = F.expr("CASE WHEN i = j AND k = m AND i <> k THEN 1 WHEN i = k AND j = m AND i <> j THEN 2 WHEN i = m AND j = k AND i <> j THEN 3 END")
    n = x.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("q").agg(*(F.sum(F.when(F.col("kind") == c, F.col("freq")).otherwise(0)).alias(f"n{c}") for c in (1, 2, 3)))
    all_q = patterns.sparkSession.createDataFrame(quartets, "b int, i int, j int, k int, m int").groupBy("b").agg(F.count("*").alias("quartets"))
    total = F.col("n1") + F.col("n2") + F.col("n3")
    out = n.groupBy(F.col("q.b").alias("b")).agg(*(F.sum(F.col(f"n{c}") / total).alias(f"f{c}") for c in (1, 2, 3)))
    f = lambda c: F.round(100 * F.coalesce(F.col(f"f{c}"), F.lit(0.0)) / F.col("quartets"), 2)
    return all_q.join(out, "b", "left").select(F.col("b").alias("branch"), f(1).alias("scf"), f(2).alias("sdf1"), f(3).alias("sdf2"), "quartets")


def gene_concordance(trees: DataFrame, reference: str, tree_id: str = "tree", text: str = "newick") -> DataFrame:
    """(branch, gn, gcf, gdf1, gdf2, gdfp): per inner branch the gene trees that have taxa of all four clades, and the percentage that has each grouping's
    split (cut down to the gene tree's taxa) or none."""

    def run(frames):
        import pandas as pd

        branches = quartet_branches(parse(reference))
        for f in frames:
            rows = []
            for s in f[text]:
                gene = parse(s)
                own = set(gene.leaves())
                has = {x for x, _ in splits(gene)}
                for b, clades in enumerate(branches):
                    p, q, r, z = (own & set(c) for c in clades)
                    if p and q and r and z:
                        first, every = min(p | q | r | z), p | q | r | z
                        side = lambda x: frozenset(x if first in x else every - x)  # noqa: E731, B023
                        cut = {frozenset(y) if first in (y := h & every) else frozenset(every - y) for h in has}
                        rows.append((b, *(int(side(x) in cut) for x in (p | q, p | r, p | z))))
            yield pd.DataFrame(rows, columns=["branch", "a", "b", "c"]).astype("int64")

    n = trees.select(text).mapInPandas(run, "branch long, a long, b long, c long").groupBy("branch").agg(F.count("*").alias("gn"), *(F.sum(x).alias(x) for x in "abc"))
    p = lambda x: F.round(100 * x / F.col("gn"), 2)
    return n.select("branch", "gn", p(F.col("a")).alias("gcf"), p(F.col("b")).alias("gdf1"), p(F.col("c")).alias("gdf2"), p(F.col("gn") - F.col("a") - F.col("b") - F.col("c")).alias("gdfp"))
