import itertools

import numpy as np
import pytest

from cladeforge.functions.models import parse as model_of
from cladeforge.operators import inference as I
from cladeforge.operators import likelihood as L
from cladeforge.operators import newick as N
from cladeforge.operators import selection

TREE = "((a:0.1,b:0.2):0.15,c:0.3,(d:0.1,(e:0.2,f:0.1):0.12):0.2);"


def drawn(tree, model, sites, seed=1):
    """Masks (pattern, taxon) and weights of sites drawn along a tree."""
    g, root = np.random.default_rng(seed), N.parse(tree)
    rate = model.rates[g.choice(len(model.rates), sites, p=model.shares / model.shares.sum())]
    state = {root: g.choice(len(model.freqs), sites, p=model.freqs)}
    for x in reversed(list(root.walk())):
        for c in x.children:
            p = model.p(rate * c.length)[np.arange(sites), state[x]]
            state[c] = (p.cumsum(1) < g.random((sites, 1))).sum(1).clip(0, len(model.freqs) - 1)
    taxa = sorted(root.leaves())
    m = np.stack([1 << state[next(x for x in state if x.name == t)] for t in taxa], 1)
    cols, w = np.unique(m, axis=0, return_counts=True)
    return taxa, cols, w.astype(float)


@pytest.fixture(scope="module")
def data():
    return drawn(TREE, model_of("HKY{3}+FO{0.3,0.2,0.2,0.3}"), 400)


def all_topologies(taxa):
    level = [N.Node("", None, "", [N.Node(t) for t in taxa[:3]])]
    texts = [N.topology(level[0])]
    for t in taxa[3:]:
        new = []
        for text in texts:
            n = len(list(N.parse(text).walk()))
            for i in range(n):
                root = N.parse(text)
                x = list(root.walk())[i]
                for j in range(len(x.children)):
                    root = N.parse(text)
                    x = list(root.walk())[i]
                    x.children[j] = N.Node("", None, "", [x.children[j], N.Node(t)])
                    new.append(N.topology(root))
        texts = sorted(set(new))
    return texts


def test_sweep_is_as_good_as_one_branch_at_a_time(data):
    taxa, cols, w = data
    for name in ("JC", "HKY{3}+G4{0.5}", "K80{2}+I{0.2}"):
        m, tips = model_of(name), L.tip_arrays(cols, taxa)
        a, b = N.parse(TREE), N.parse(TREE)
        x, y = I.sweep(a, tips, w, m, rounds=8, tol=1e-5), L.optimise_lengths(b, tips, w, m, rounds=8)
        assert abs(x - y) < 0.02
        assert abs(x - float(w @ L.log_likelihoods(a, tips, m)[0])) < 1e-6


def test_search_finds_the_best_of_all_trees(spark, data):
    taxa, cols, w = data
    m, tips = model_of("JC"), L.tip_arrays(cols, taxa)
    every = all_topologies(taxa)
    assert len(every) == 105
    best = max((I.sweep(N.parse(t), tips, w, m), t) for t in every)
    df = spark.createDataFrame([(c, int(k)) for c, k in zip(cols.tolist(), w, strict=True)], "states array<int>, freq long")
    got = I.likelihood_search(spark, df, taxa, m, starts=2, unsuccessful=1).collect()
    assert all(abs(r.lnl - best[0]) < 0.05 and r.topology == best[1] for r in got)


def test_interchanges_are_all():
    root = N.parse(TREE)
    assert sorted(N.topology(t) for t in I.interchanges(root)) == N.neighbours(root)
    assert len(N.neighbours(root)) == 6


def test_quartets(spark, data):
    taxa, cols, w = data
    df = spark.createDataFrame([(c, int(k)) for c, k in zip(cols.tolist(), w, strict=True)], "states array<int>, freq long")
    got = I.likelihood_mapping(df, 6, model_of("JC")).cache()
    rows = got.collect()
    assert len(rows) == 15 and all(abs(r.w1 + r.w2 + r.w3 - 1) < 1e-9 for r in rows)
    true = {frozenset(s) for s, _ in N.splits(N.parse(TREE))}
    for r in rows:
        names = [taxa[i] for i in (r.a, r.b, r.c, r.d)]
        fits = [any(len(set(p) & s) in (0, 2) and len(set(q) & s) in (0, 2) and len(set(p) & s) != len(set(q) & s) for s in true) for p, q in (((names[0], names[1]), (names[2], names[3])), ((names[0], names[2]), (names[1], names[3])), ((names[0], names[3]), (names[1], names[2])))]
        assert sum(fits) == 1 and (r.w1, r.w2, r.w3)[fits.index(True)] > 0.5
    assert I.area(np.array([1.0, 0, 0])) == 1 and I.area(np.array([0.5, 0.5, 0])) == 4 and I.area(np.full(3, 1 / 3)) == 7
    total = {r.taxon: r for r in I.mapping_summary(got, 6).collect()}
    assert total[None].quartets == 15 and all(total[i].quartets == 10 for i in range(6))


def test_free_rates_and_joint_fit():
    m = model_of("JC+R2{0.6,0.2,0.4,2.2}")
    taxa, cols, w = drawn(TREE, m, 4000, 3)
    tips = L.tip_arrays(cols, taxa)
    root = N.parse(TREE)
    start = float(w @ L.log_likelihoods(root, tips, model_of("JC"))[0])
    fitted, value = I.fit_free_rates(root, tips, w, model_of("JC"), 2)
    assert value > start and value >= float(w @ L.log_likelihoods(root, tips, m)[0]) - 0.5
    assert abs(fitted.shares.sum() - 1) < 1e-9
    build = lambda alpha, kappa: model_of(f"K80{{{kappa}}}+G4{{{alpha}}}")
    at, lnl = I.fit_rates(N.parse(TREE), tips, w, build, {"alpha": (0.05, 20.0), "kappa": (0.2, 10.0)})
    assert 0.8 < at["kappa"] < 1.25 and lnl > start


def test_least_squares(spark):
    root = N.parse(TREE)
    names = sorted(root.leaves())
    branches = [x for x in root.walk() if x is not root]
    below = {x: set(x.leaves()) for x in branches}
    d = np.array([[sum(x.length for x in branches if (a in below[x]) != (b in below[x])) for b in names] for a in names])
    text, rss = I.least_squares(TREE, names, d)
    assert rss < 1e-18 and all(abs(x.length - y.length) < 1e-9 for x, y in zip(N.parse(text).walk(), root.walk(), strict=True) if y.length is not None)
    rows = [(0, a, b, float(d[i, j])) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)]
    assert I.least_squares_trees(spark.createDataFrame(rows, "g int, t1 string, t2 string, d double"), TREE, "g").first().rss < 1e-18


def test_fit_counts_lengths_and_beats_a_scale(data):
    taxa, cols, w = data
    tips = L.tip_arrays(cols, taxa)
    lnl, k, growth, name = selection.fit("HKY+F", TREE, tips, w, np.array([0.3, 0.2, 0.2, 0.3]))
    assert k == 9 + 1 + 3 and name.startswith("HKY{") and 0.5 < growth < 2
    assert lnl > float(w @ L.log_likelihoods(N.parse(TREE), tips, model_of("HKY{3}+FO{0.3,0.2,0.2,0.3}"))[0])


def test_irreversible_and_errors(data):
    taxa, cols, w = data
    tips = L.tip_arrays(cols, taxa)
    same = model_of("UNREST{1,1,1,1,1,1,1,1,1,1,1,1}")
    assert np.allclose(same.p(0.3), model_of("JC").p(0.3), atol=1e-10)
    m = model_of("UNREST{1,2,0.5,1.5,0.7,1.1,0.9,1.3,0.6,0.8,1.2,1}")
    assert np.allclose(m.freqs @ m.p(2.0), m.freqs) and np.allclose(m.p(0.4) @ m.p(0.6), m.p(1.0)) and np.allclose(m.p(1.0).sum(1), 1)
    assert np.allclose(L.log_likelihoods(N.parse(TREE), tips, model_of("JC+E{0}"))[0], L.log_likelihoods(N.parse(TREE), tips, model_of("JC"))[0])
    assert np.allclose(L.misread(np.eye(4), 0.03).sum(0), 1)


def test_weibull_stop():
    assert I.weibull_stop([3, 5]) == float("inf")
    early, late = I.weibull_stop([1, 2, 3, 4, 5, 6, 7]), I.weibull_stop([1, 2, 3, 4, 50, 60, 70])
    assert 7 < early < late


@pytest.mark.parametrize("n", [5, 6, 7])
def test_regrafts_are_all(n):
    """An unrooted tree of n leaves has 2 (n - 3) (2 n - 7) others one regrafting away."""
    root = N.parse("(a,b,c);")
    for t in "defg"[: n - 3]:
        root.children[0] = N.Node("", None, "", [root.children[0], N.Node(t)])
    got = list(I.regrafts(root))
    assert len(got) == len(set(got)) == 2 * (n - 3) * (2 * n - 7)
    key = lambda t: frozenset(s for s, _ in N.splits(N.parse(t)))
    assert {key(t) for t in N.neighbours(root)} <= {key(t) for t in got} and len({key(t) for t in got}) == len(got)


def test_birth_death_trees():
    from cladeforge.operators.search import random_tree

    for seed in range(5):
        root = N.parse(random_tree(8, "birth-death", seed))
        assert sorted(root.leaves()) == sorted(f"T{i}" for i in range(1, 9))
        depth = {root: 0.0}
        for x in reversed(list(root.walk())):
            for c in x.children:
                depth[c] = depth[x] + c.length
        tips = [d for x, d in depth.items() if not x.children]
        assert max(tips) - min(tips) < 1e-6 and all(len(x.children) in (0, 2) for x in root.walk())


def test_merging_partitions(spark):
    """Two partitions of one process and one of quite another: the two become one."""
    rows = []
    for part, (scale, seed) in enumerate(((0.3, 1), (0.3, 2), (6.0, 3))):
        taxa, cols, w = drawn(L.scaled(TREE, scale), model_of("JC"), 600, seed)
        rows += [(part, c, int(k)) for c, k in zip(cols.tolist(), w, strict=True)]
    df = spark.createDataFrame(rows, "part int, states array<int>, freq long")
    got = [r.parts for r in I.merge_partitions(df, TREE, taxa, ["JC"], [0.25] * 4).collect()]
    assert got == [[0, 1], [2]]
