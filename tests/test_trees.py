import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.functions import numerics as M
from cladeforge.functions.models import candidates, parse as model_of
from cladeforge.operators import likelihood as L
from cladeforge.operators import newick as N
from cladeforge.operators import search as S
from cladeforge.operators import trees as T

TREE = "((a:0.1,b:0.2):0.05,c:0.3,(d:0.1,'e e':0.4)90:0.2);"


def test_newick_round_trip():
    t = N.parse(TREE)
    assert t.leaves() == ["a", "b", "c", "d", "e e"] or sorted(t.leaves()) == ["a", "b", "c", "d", "e e"]
    assert N.write(N.parse(N.write(t))) == N.write(t)
    assert N.topology(N.parse("(c,(b,a),('e e',d));")) == N.topology(t)


@pytest.mark.parametrize("bad", ["((a,b);", "(a,b));", "(a,a);", "(a,'b);", "a,b;", "(a,b);c"])
def test_newick_errors(bad):
    with pytest.raises(ValueError):
        N.parse(bad)


def test_splits_prune_reroot():
    t = N.parse(TREE)
    s = dict(N.splits(t))
    assert {frozenset("ab"), frozenset("abc")} == set(s)
    assert dict(N.splits(N.reroot(t, "c"))).keys() == s.keys()
    assert N.topology(N.prune(t, {"a", "c", "d"})) == "(a,c,d);"
    assert len(N.neighbours(N.parse("((a,b),c,d);"))) == 2


def test_distances_recover_an_additive_tree():
    t = N.parse("((a:1,b:2):1.5,(c:1,d:3):0.5,(e:2,f:1):1);")
    below = {x: set(x.leaves()) for x in t.walk()}
    names = sorted(t.leaves())
    d = np.array([[sum(x.length for x in below if x is not t and (p in below[x]) != (q in below[x])) for q in names] for p in names])
    for method in ("NJ", "BIONJ"):
        assert {s for s, _ in N.splits(N.parse(S.BUILDERS[method](names, d)))} == {s for s, _ in N.splits(t)}
    assert S.metric_closure(np.array([[0, 1, 9.0], [1, 0, 1], [9, 1, 0]]))[0, 2] == 2


def brute_likelihood(t, tips, model):
    inner = [x for x in t.walk() if x.children]
    total = 0.0
    for rate, share in zip(model.rates, model.shares, strict=True):
        for states in itertools.product(range(4), repeat=len(inner)):
            at = dict(zip(inner, states, strict=True))
            value = model.freqs[at[t]]
            for x in inner:
                for c in x.children:
                    p = model.p(rate * c.length)[at[x]]
                    value *= p[at[c]] if c.children else (p * tips[c.name]).sum()
            total += share * value
    both = np.prod(list(tips.values()), axis=0)
    return total + model.invariant * (both * model.freqs).sum()


@pytest.mark.parametrize("name", ["JC", "HKY{2.5}+FO{0.1,0.2,0.3,0.4}", "GTR{2,1,1,3,1}+FO{0.3,0.2,0.2,0.3}+I{0.2}+G3{0.6}", "K80{3}+R2{0.4,0.5,0.6,1.5}"])
def test_likelihood_is_the_sum_over_inner_states(name):
    model, t = model_of(name), N.parse(TREE)
    states = np.array([[1, 1, 2, 4, 8], [1, 15, 1, 3, 1], [8, 8, 8, 8, 8]])
    tips = L.tip_arrays(states, ["a", "b", "c", "d", "e e"])
    lnl, post = L.log_likelihoods(t, tips, model)
    for i in range(3):
        assert lnl[i] == pytest.approx(np.log(brute_likelihood(t, {k: v[i] for k, v in tips.items()}, model)), abs=1e-9)
    assert post.sum(1) == pytest.approx(1.0)
    assert L.log_likelihoods(N.reroot(t, "c"), tips, model)[0] == pytest.approx(lnl, abs=1e-9)
    assert L.ancestral(t, tips, model, t).sum(1) == pytest.approx(1.0)


def test_branch_lengths_and_distance():
    model, t = model_of("JC"), N.parse("(a:0.5,b:0.5);")
    tips = L.tip_arrays(np.array([[1, 1], [1, 2]]), ["a", "b"])
    weights = np.array([90.0, 10.0])
    before = float(weights @ L.log_likelihoods(t, tips, model)[0])
    assert L.optimise_lengths(t, tips, weights, model) >= before
    want = -0.75 * np.log(1 - 0.1 * 4 / 3)
    assert sum(x.length for x in t.children) == pytest.approx(want, abs=1e-3)
    assert L.ml_distance(np.diag([30.0, 30, 30, 0]) + 10 * np.eye(4, k=1)[:, :] * np.array([0, 1, 0, 0]), model)[0] == pytest.approx(want, abs=1e-4)


def test_parsimony_finds_the_best_of_all_trees():
    g = np.random.default_rng(3)
    taxa = [f"t{i}" for i in range(6)]
    states = {t: 1 << g.integers(0, 4, 40) for t in taxa}
    w = np.ones(40, np.int64)
    every = S.stand([f"({','.join(taxa[:3])});", f"({','.join(taxa)});".replace("(t0,t1,t2,t3,t4,t5)", "(t3,t4,t5)")])
    assert len(every) == 105
    best = min(S.parsimony(N.parse(t), states, w) for t in every)
    found = min(S.climb(S.stepwise_addition(states, w, s)[0], lambda n: S.parsimony(n, states, w))[1] for s in range(6))
    assert found == best
    cost = 1 - np.eye(4)
    assert sum(L.sankoff(N.parse(every[0]), {t: int(states[t][i]) for t in taxa}, cost) for i in range(40)) == S.parsimony(N.parse(every[0]), states, w)


def test_stand_of_two_partial_trees():
    assert len(S.stand(["(a,(b,c),d);", "(a,(b,e),d);"])) == len([t for t in S.stand(["(a,b,c);", "(d,e,a);"]) if S.displays(N.parse(t), N.parse("(a,(b,c),d);")) and S.displays(N.parse(t), N.parse("(a,(b,e),d);"))])


def test_numerics():
    assert M.chi2_sf(3.841458820694124, 1)[0] == pytest.approx(0.05, abs=1e-9)
    assert M.chi2_sf(11.0705, 5)[0] == pytest.approx(0.05, abs=1e-5)
    assert M.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert M.binomial_sf(2, 3, 0.5) == pytest.approx(0.5)
    assert M.gamma_rates(0.5, 4) == pytest.approx([0.033388, 0.251916, 0.820268, 2.894428], abs=1e-5)
    assert M.gamma_rates(1.3, 6, median=True).mean() == pytest.approx(1)
    assert M.minimise(lambda x: (x - 2) ** 2, 0, 9)[0] == pytest.approx(2, abs=1e-6)


def test_models():
    for name in candidates(("", "+I+G4")):
        m = model_of(name, np.array([0.1, 0.2, 0.3, 0.4]))
        assert m.p(0.3).sum(1) == pytest.approx(1.0)
        assert m.freqs @ m.q == pytest.approx(0.0, abs=1e-12)
    assert (model_of("GTR").df, model_of("HKY").df, model_of("JC+I+G4").df, model_of("GTR+F+R3").df) == (8, 4, 2, 12)


def test_node_rows_and_distinct(spark):
    trees = spark.createDataFrame([(1, "((a,b),(c,d));"), (2, "((b,a),(d,c));"), (3, "((a,c),(b,d));")], "tree int, newick string")
    rows = N.nodes(trees.where("tree = 1")).collect()
    assert len(rows) == 7 and sum(r.leaf for r in rows) == 4 and max(r.post for r in rows) == 6
    assert {(r.tree, r.first_tree) for r in N.distinct(trees).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {(r.tree, r.members) for r in N.tree_splits(trees).collect()} == {(1, "a,b"), (2, "a,b"), (3, "a,c")}


def test_simulation_follows_the_model(spark):
    aln = S.simulate(spark, "(a:0.1,b:0.2);", model_of("JC"), 20_000, seed=4, block=3000)
    wide = aln.groupBy("site").pivot("taxon", ["a", "b"]).max("mask")
    share = wide.where("a <> b").count() / 20_000
    assert share == pytest.approx(0.75 * (1 - np.exp(-4 / 3 * 0.3)), abs=0.01)
    assert S.random_tree(8, "balanced", 1).count("T") == 8


def test_built_models():
    from cladeforge.functions import models

    m, codons = models.codon(2.0, 0.5)
    assert len(codons) == 61 and m.p(0.2).sum(1) == pytest.approx(1.0) and m.freqs @ m.q == pytest.approx(0.0, abs=1e-12)
    t = models.from_triangle([1, 2, 3], [1, 1, 2])
    assert t.freqs == pytest.approx([0.25, 0.25, 0.5]) and t.p(0.1).sum(1) == pytest.approx(1.0)
    f = np.array([0.1, 0.2, 0.3, 0.4])
    q, pi = models.polymorphic(models.dna("010010", [1.0, 3.0], f), f, 9, 0.1)
    assert q.sum(1) == pytest.approx(0.0, abs=1e-12) and pi @ q == pytest.approx(0.0, abs=1e-10) and pi[4:].sum() == pytest.approx(0.1)


def test_rootstrap(spark):
    trees = spark.createDataFrame([("((a,b),(c,d));",), ("((c,d),(b,a));",), ("(a,((b,c),d));",)], "newick string")
    got = {r.split: round(r.support, 1) for r in N.rootstrap(trees, "((a,b),(c,d));").collect()}
    assert got["a,b"] == 66.7 and got["a"] == 33.3 and got["a,c,d"] == 0


def test_sql_functions(spark):
    from cladeforge.functions.udfs import register

    register(spark)
    r = spark.sql("SELECT chi2_sf(3.841458820694124D, 1D) AS p, newick_topology('((b:1,a),c,d);') AS t, newick_leaves('(b,a);') AS l, newick_splits('((a,b),c,d);') AS s, newick_length('(a:1,b:2);') AS n, newick_length(CAST(NULL AS STRING)) AS z").first()
    assert r.p == pytest.approx(0.05) and r.t == "(a,b,(c,d));" and r.l == ["a", "b"] and r.s == ["a,b"] and r.n == 3 and r.z is None


def test_model_selection_prefers_the_true_model(spark):
    from cladeforge.operators import alignment as A
    from cladeforge.operators.selection import select

    tree = "((a:0.2,b:0.2):0.1,c:0.2,(d:0.2,e:0.3):0.1);"
    aln = S.simulate(spark, tree, model_of("K80{6}"), 3000, seed=2).selectExpr("taxon", "site", "0 AS part", "mask")
    rows = select(spark, A.patterns(aln), tree, list("abcde"), ["JC", "K80", "K80+G4"], [0.25] * 4).orderBy("rank").collect()
    assert rows[0].model == "K80" and float(rows[0].fitted[4:-1]) == pytest.approx(6, rel=0.2) and rows[0].scale == pytest.approx(1, rel=0.1)


def rows_of(spark, edges):
    return spark.createDataFrame(edges, "node string, parent string, brlen double")


def test_deep_trees_and_cycles(spark):
    """A caterpillar of 200 levels; a table of ancestors goes as deep as the tree."""
    edges = [("n0", "root", 1.0)] + [(f"n{i}", f"n{i - 1}", 1.0) for i in range(1, 200)] + [(f"l{i}", f"n{i}", 0.5) for i in range(200)]
    tree = rows_of(spark, edges)
    assert T.ancestors(tree).count() == 200 * 201 // 2 + sum(i + 2 for i in range(200))
    one = T.metrics(tree).first()
    assert (one.leaves, one.depth, one.farthest) == (200, 201, 200.5)
    d = {(r.a, r.b): r.d for r in T.patristic(tree).collect()}
    assert len(d) == 200 * 199 // 2 and d["l0", "l199"] == 200.0
    with pytest.raises(ValueError):
        T.ancestors(rows_of(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)]))


def test_pairs_that_meet_at_the_root(spark):
    tree = rows_of(spark, [("x", "root", 1.0), ("y", "root", 2.0), ("a", "x", 0.5), ("b", "x", 0.25), ("c", "y", 0.125)])
    assert {(r.a, r.b): r.d for r in T.patristic(tree).collect()} == {("a", "b"): 0.75, ("a", "c"): 3.625, ("b", "c"): 3.375}
    assert {r.node: r.d for r in T.distances_from(tree, "a").collect()} == {"a": 0.0, "b": 0.75, "c": 3.625, "x": 0.5, "y": 3.5}


def test_dropping_the_shortest(spark):
    edges = [("x", "root", 1.0), ("y", "x", 0.5), ("a", "y", 0.3), ("b", "y", 0.4), ("c", "x", 0.6), ("d", "root", 0.9), ("e", "root", 0.05)]
    parent, length = {n: p for n, p, _ in edges}, {n: v for n, _, v in edges}
    want = []
    for i in range(1, 5):
        leaf = min((n for n in parent if n not in parent.values()), key=lambda n: (length[n], n))
        want.append((i, leaf, round(length[leaf], 9)))
        p = parent.pop(leaf)
        kids = [n for n in parent if parent[n] == p]
        if len(kids) == 1 and p in parent:
            parent[kids[0]], length[kids[0]] = parent[p], length[kids[0]] + length[p]
            del parent[p]
    assert [(r.step, r.leaf, round(r.brlen, 9)) for r in T.prune_shortest(rows_of(spark, edges), 4).orderBy("step").collect()] == want


def test_worked_stand():
    """Five taxa and two genes, {0, 3, 4} and {0, 1, 2}: fifteen trees."""
    from cladeforge.operators.search import stand

    assert len(stand(["(0,3,4);", "(0,1,2);"])) == 15


def test_majority_tree(spark):
    from cladeforge.operators import newick as N
    from cladeforge.operators import splits as S

    trees = spark.createDataFrame([(0, "((a,b),(c,d),e);"), (1, "((a,b),(c,d),e);"), (2, "((a,b),(c,e),d);")], "tree int, newick string")
    taxa = list("abcde")
    clades = [(t, i, x) for t, text in ((r.tree, r.newick) for r in trees.collect()) for i, (s, _) in enumerate(N.splits(N.parse(text))) for x in s]
    s = S.canonical(spark.createDataFrame(clades, "tree int, clade int, taxon string").withColumn("n", F.lit(1)), taxa)
    text = S.majority_tree(s, taxa).first().newick
    got = {frozenset(x) for x, _ in N.splits(N.parse(text))}
    want = {frozenset(x) for x, _ in N.splits(N.parse("((a,b),(c,d),e);"))}
    assert got == want and "67" in text and "100" in text
