"""What the queries hold at once, and rows that sit on an edge."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from cladeforge.operators import alignment as A
from cladeforge.operators import splits as S
from cladeforge.operators import trees as T
from cladeforge.plans.adapters import clade_members, site_columns
from cladeforge.sources import readers as R
from cladeforge.sources import writers as O


def test_partitions_without_a_row_for_each_site(spark):
    """A range of 2**33 sites: more than a sequence of its sites may hold."""
    sets = spark.createDataFrame([(0, 1, 2**33, 3), (1, 2, 2**33, 3), (1, 5, 5, 1)], "part int, lower long, upper long, step long")
    aln = spark.createDataFrame([("x", s, 1) for s in (0, 1, 4, 5, 6, 4096, 4097, 2**33, 2**33 + 1)], "taxon string, site long, mask int")
    want = [(s, p) for s in (0, 1, 4, 5, 6, 4096, 4097, 2**33, 2**33 + 1) for p, lo, hi, step in ((0, 1, 2**33, 3), (1, 2, 2**33, 3), (1, 5, 5, 1)) if lo <= s <= hi and (s - lo) % step == 0]
    assert sorted((r.site, r.part) for r in R.assign_partitions(aln, sets).collect()) == sorted(want)
    assert "__span" not in R.assign_partitions(aln.withColumn("more", F.lit(1)), sets).columns


def splits_of(spark, clades):
    rows = [(tree, i, t) for tree, sides in clades.items() for i, side in enumerate(sides) for t in side]
    return S.canonical(spark.createDataFrame(rows, "tree string, clade int, taxon int").withColumn("n", F.col("clade") + 1))


def test_best_pair_against_all_pairs(spark):
    """Also a taxon (3) that is on no split's side of the first taxon."""
    clades = {"x": [[0, 1, 2, 4, 5], [3]], "y": [[0, 4], [1, 5, 2, 3]], "z": [[5], [0, 1, 2, 4, 3]]}
    taxa = spark.createDataFrame([(t,) for t in range(6)], "taxon int")
    for chosen in (clades, {"x": clades["x"]}, {"y": [[0, 1, 2, 3, 4, 5]]}):
        s = splits_of(spark, chosen)
        heavy = {tuple(r.members): max(q.weight for q in s.collect() if q.members == r.members) for r in s.collect()}
        pairs = [(-sum(w for m, w in heavy.items() if (a in m) != (b in m)), a, b) for a in range(6) for b in range(a + 1, 6)] if heavy else []
        assert [(-r.pd, r.a, r.b) for r in S.best_pair(s, taxa).collect()] == sorted(pairs)[:1]


def test_no_row_holds_all_pairs_of_taxa(spark):
    """4,000 taxa of two kinds: eight million pairs, none made; the plan names no taxon."""
    c = spark.range(8000).selectExpr("concat('t', id % 2) AS tree", "CAST(id % 3 AS INT) AS clade", "id div 2 AS taxon", "1L AS n")
    assert len(S.canonical(c)._jdf.queryExecution().analyzed().toString()) < 20_000
    got = S.best_pair(S.canonical(c), c.select("taxon")).first()
    assert got.pd > 0 and got.a == 0


def test_network_sends_no_member_lists_with_taxa(spark):
    """3,000 taxa: what is dealt out by taxon stays below a hundred bytes a row."""
    c = spark.range(6000).selectExpr("concat('t', id % 2) AS tree", "CAST(id % 3 AS INT) AS clade", "id div 2 AS taxon", "1L AS n")
    d = S.network_diversity(S.canonical(c), c.selectExpr("taxon % 5 AS area", "taxon"))
    assert "concat_ws" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, d.collect())) == [(a, 3000) for a in range(5)]


def drawn_tree(spark, seed, n=60):
    """A tree of random shape with lengths of a few values, so that many paths are equally long."""
    g = random.Random(seed)
    edges, inner = [("n0", "root", 1.0)], ["root", "n0"]
    for i in range(1, n):
        edges.append((f"n{i}", g.choice(inner if seed % 2 else inner[-3:]), g.choice([0.0, 0.1, 0.2, 0.3])))
        inner.append(f"n{i}")
    parent, length = {a: p for a, p, _ in edges}, {a: v for a, _, v in edges}
    tips = sorted(set(parent) - set(parent.values()))

    def path(x):
        return {x} | path(parent[x]) if x in parent else set()

    pairs = {(a, b): sum(length[x] for x in path(a) ^ path(b)) for a, b in itertools.combinations(tips, 2)}
    return spark.createDataFrame(edges, "node string, parent string, brlen double"), pairs


@pytest.mark.parametrize("seed", range(4))
def test_diameter_and_tiles_against_all_pairs(spark, seed):
    tree, pairs = drawn_tree(spark, seed)
    got = T.diameter(tree).first()
    d, a, b = min((-round(v, 9), *k) for k, v in pairs.items())
    assert (got.d, got.a, got.b) == (-d, a, b) and got.mean == pytest.approx(sum(pairs.values()) / len(pairs))
    for block in (3, 512):
        rows = T.patristic(tree, block).collect()
        assert len(rows) == len(pairs) and all(r.d == pytest.approx(pairs[r.a, r.b]) for r in rows)


def test_diameter_makes_no_pairs(spark):
    """A star of 30,000 equal leaves: 450 million pairs."""
    star = spark.range(30_000).selectExpr("concat('l', id) AS node", "'root' AS parent", "0.5D AS brlen")
    assert tuple(T.diameter(star).first()) == (1.0, "l0", "l1", 1.0)
    assert tuple(T.diameter(star.where("node = 'l0'")).first()) == (None, None, None, None)


def test_patristic_holds_one_tile(spark):
    """No row of what is exploded is longer than a block."""
    star = spark.range(3000).selectExpr("concat('l', id) AS node", "'root' AS parent", "0.5D AS brlen")
    d = T.patristic(star, 100)
    assert d.count() == 3000 * 2999 // 2
    blocks = [p for p in d.inputFiles() if "/blocks-" in p]
    assert blocks and max(r.n for r in spark.read.parquet(*blocks).selectExpr("size(l) AS n").collect()) < 200


def test_values_are_added_in_the_order_of_events(spark, tmp_path):
    """Each user's values come to 40, or by their order to a bit less; the table holds the last event first."""
    g, rows = random.Random(5), []
    for user in range(400):
        cents = [g.randrange(1, 900) for _ in range(6)]
        cents.append(4000 - sum(cents)) if sum(cents) < 4000 else None
        rows += [(len(rows) + i, user, "click", c / 100) for i, c in enumerate(cents)]
    spark.createDataFrame(rows[::-1], "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    total, back = {}, {}
    for i, user, _, v in rows:
        total[user] = total.get(user, 0.0) + v
    for i, user, _, v in rows[::-1]:
        back[user] = back.get(user, 0.0) + v
    want = {u: (u + (math.floor(v) % 40 == 0)) % 8 for u, v in total.items()}
    assert want != {u: (u + (math.floor(v) % 40 == 0)) % 8 for u, v in back.items()}
    got = clade_members(spark, str(tmp_path)).collect()
    assert {r.taxon: r.clade for r in got} == want and sum(r.n for r in got) == len(rows)


def test_tree_of_splits_names_clades_once(spark):
    """Nested clades against the written rule, the taxa a list or a table; with a table the plan names no taxon."""
    clades = {"x": [[5, 6], [5, 6, 7, 8], [2, 3], [5, 6, 7, 8, 2, 3], [9]]}
    s, taxa = splits_of(spark, {"x": [*clades["x"], [*range(10)]]}), spark.createDataFrame([(t,) for t in range(10)], "taxon int")
    parents = {",".join(map(str, sorted(c))): set(c) for c in clades["x"]} | {str(t): {t} for t in range(10)}
    want = sorted((k, min((",".join(map(str, sorted(u))) for u in parents.values() if u > v), key=lambda u: (len(parents[u]), u), default="root"), len(v)) for k, v in parents.items())
    for given in (taxa, list(range(10))):
        assert sorted(map(tuple, S.tree_nodes(s, given).collect())) == want
    c = spark.range(4000).selectExpr("'t' AS tree", "CAST(id % 3 AS INT) AS clade", "id AS taxon", "1L AS n")
    nodes = S.tree_nodes(S.canonical(c), c.select("taxon"))
    assert len(nodes._jdf.queryExecution().analyzed().toString()) < 20_000 and nodes.count() == 4003


def test_circular_orders_and_restriction_of_many_taxa(spark):
    """9,000 taxa: hashes are made of a split, not of a split for each of its taxa."""
    n = 9000
    c = spark.range(n).selectExpr("'t' AS tree", "CAST(id div 3000 AS INT) AS clade", "id AS taxon", "1L AS n").unionByName(spark.range(n).selectExpr("'u' AS tree", "CAST(id % 2 AS INT) AS clade", "id AS taxon", "1L AS n"))
    order = spark.range(n).selectExpr("id AS taxon", f"(id + 1500) % {n} + 1 AS place")
    got = S.circular(S.canonical(c), order)
    assert sorted((r.tree, r.circular) for r in got.select("tree", "circular").collect()) == [("t", True), ("t", True), ("t", True), ("u", False)]
    assert [r.circular for r in S.circular(S.canonical(c.where("taxon < 9")), list(range(9))).select("circular").collect()] == [False]


def test_interleaved_files_in_linear_time(spark):
    """A million sites in blocks of 50: pieces are joined once, and sequences cut in one pass."""
    n = 1_000_000
    seq = "ACGT-" * (n // 5)
    clustal = "CLUSTAL\n\n" + "\n".join(f"{t}   {seq[i : i + 5]}" + ("\n" if t == "t2" else "") for i in range(0, n, 5) for t in ("t1", "t2"))
    msf = "PileUp\n MSF: 1\n Name: t1 Len: 1\n Name: t2 Len: 1\n//\n" + "\n".join(f" {t} {seq[i : i + 5]}" for i in range(0, n, 5) for t in ("t1", "t2"))
    phylip = f"2 {n}\n" + "\n".join((f"{t} " if i == 0 else "") + seq[i : i + 5] for i in range(0, n, 5) for t in ("t1", "t2"))
    for parse, text in ((R.parse_clustal, clustal), (R.parse_msf, msf), (R.parse_phylip, phylip)):
        began = time.process_time()
        assert parse(text) == [("t1", seq), ("t2", seq)]
        assert time.process_time() - began < 8
    with pytest.raises(ValueError, match="twice"):
        R.parse_msf("PileUp\n Name: a Len: 1\n Name: a Len: 1\n//\n a A\n a A\n")
    assert R.parse_phylip("2 6\nt1 ACG\nTAC\nt2 AC-\nTAN\n") == [("t1", "ACGTAC"), ("t2", "AC-TAN")]


def test_sequences_beyond_a_stretch(spark):
    """Sites with holes, over two stretches; written in blocks and taken apart again."""
    sites = [3, 4090, 4095, 4096, 4097, 9000]
    aln = spark.createDataFrame([(t, s, 0, 1 << ((s + k) % 4)) for k, t in enumerate(("a", "b")) for s in sites], "taxon string, site long, part int, mask int")
    want = {t: "".join("ACGT"[(s + k) % 4] for s in sites) for k, t in enumerate(("a", "b"))}
    assert {r.taxon: r.seq for r in O.sequences(aln).collect()} == want
    assert sorted(map(tuple, O._blocks(aln, 4).collect())) == sorted((i, t, v[4 * i : 4 * i + 4]) for t, v in want.items() for i in (0, 1))
    long = "ACGTN-" * 2000
    cells = A.encode(spark.createDataFrame([("x", long), ("y", "")], "taxon string, seq string")).collect()
    assert sorted((r.taxon, r.site, r.mask) for r in cells) == [("x", i + 1, {"A": 1, "C": 2, "G": 4, "T": 8}.get(c, 15)) for i, c in enumerate(long)]
    plan = A.encode(spark.createDataFrame([("x", long)], "taxon string, seq string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan


def test_consensus_of_columns_and_cells(spark):
    g = random.Random(2)
    cells = [(t, s, 0, g.choice([1, 2, 4, 8, 3, 15])) for s in range(300) for t in range(5)]
    aln = spark.createDataFrame(cells, "taxon int, site long, part int, mask int")
    own = A.consensus(A.columns(aln))
    assert own.schema["state"].dataType == A.consensus(aln).schema["state"].dataType
    assert sorted(map(str, own.collect())) == sorted(map(str, A.consensus(aln).collect()))
    assert "Generate" not in own._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_table(spark, monkeypatch):
    """A file of many shares has as many tasks; flags of any text come in their order, null ones left out."""
    from cladeforge.plans import adapters
    from tests.conftest import DATA

    before = sorted(map(str, adapters.site_columns(spark, DATA).collect()))
    monkeypatch.setattr(adapters, "SHARE", 4000)
    cols = adapters.site_columns(spark, DATA)
    assert cols.rdd.getNumPartitions() > 10 and sorted(map(str, cols.collect())) == before


def test_states_by_the_first_flag(spark, tmp_path):
    flags = [["A", "N"], ["N", "R"], ["R"], [None, "N"], [None], ["", "A"], ["B", "N"], ["Nx"], ["a"], ["A", None]]
    rows = [(i, 1, float(q), f) for i, own in enumerate(flags) for q, f in enumerate(own)] + [(99, 1, 41.0, "A"), (98, 1, 41.0, "N"), (98, 1, 40.0, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    low = {i: min((f for f in own if f is not None), default=None) for i, own in enumerate(flags)}
    want = {i: {"A": 1, "N": 2}.get(f, 4) for i, f in low.items()} | {99: 8, 98: 2}
    assert {r.site: r.states for r in site_columns(spark, str(tmp_path)).collect()} == {k: [v] for k, v in want.items()}
