"""Queries and operators without SQL to compare, held against values worked out by hand or by plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.operators import alignment as A
from cladeforge.operators import newick as N
from cladeforge.operators import search as S
from cladeforge.operators import treetests as P
from cladeforge.sources.storage import scratch_path, shared_dir
from cladeforge.streaming.pools import candidate_pool


def test_multiscale_test(spark):
    """One tree far better than another: near 1 and 0. Two that differ by noise of mean 0: both near a half. The same in every run."""
    g = np.random.default_rng(4)
    base = -g.gamma(2.0, 2.0, 200)
    rows = [(t, i, float(v), 3) for t, shift in ((1, 0.0), (2, -0.2)) for i, v in enumerate(base + shift)]
    au = lambda rows: {r.tree: r.au for r in P.approximately_unbiased(spark.createDataFrame(rows, "tree int, ptn int, lnl double, freq int"), 400).collect()}
    got = au(rows)
    assert got[1] > 0.99 and got[2] < 0.01 and got == au(rows)
    noise = g.standard_normal(100)
    noise = np.concatenate([noise, -noise])
    near = au([(t, i, float(v), 3) for t, x in ((1, 0), (2, noise)) for i, v in enumerate(base + x)])
    assert all(0.3 < v < 0.7 for v in near.values())


def test_gene_concordance_counts(spark):
    reference = "((a,b),(c,d),e);"
    genes = ["((a,b),(c,d),e);", "((a,b),(c,e),d);", "((a,c),(b,d),e);", "((a,b),c,d);", "(c,d,e);"]
    got = {r.branch: r for r in S.gene_concordance(spark.createDataFrame(list(enumerate(genes)), "tree int, newick string"), reference).collect()}
    # around ab: the clades a, b, cd, e; the fourth tree has no e, the fifth neither a nor b
    ab = next(r for r in got.values() if r.gn == 3 and r.gcf > 50)
    assert (ab.gn, ab.gcf) == (3, 66.67)
    assert sum(r.gcf + r.gdf1 + r.gdf2 + r.gdfp for r in got.values()) == pytest.approx(100 * len(got), abs=0.1)


def test_bootstrap_of_clear_data(spark):
    """Sites that all tell one tree: every replicate has its split."""
    cols = [([1, 1, 2, 2], 60), ([1, 1, 1, 1], 80), ([1, 2, 1, 1], 9), ([1, 1, 2, 1], 8), ([1, 1, 1, 2], 7), ([2, 1, 1, 1], 6)]
    p = spark.createDataFrame([(s, f, i) for i, (s, f) in enumerate(cols)], "states array<int>, freq long, ptn long")
    d = A.part_distances(p.select("states", "ptn").join(P.samples(p, 10, "freq - 3 + (rep * 7 + ptn * 5) % 7"), "ptn"), "w", "rep")
    trees = S.distance_trees(d, "rep").collect()
    assert len(trees) == 11 and all(dict(N.splits(N.parse(r.newick))).keys() == {frozenset("01")} for r in trees)


def test_pool_of_candidates(spark):
    rows = [("x", "t1", 1.0), ("x", "t2", 3.0), ("y", "t1", 5.0), ("x", "t3", 2.0), ("x", "t1", 4.0), ("x", "t4", 0.5), ("y", "t2", 6.0), ("y", "t2", 5.5)]
    base = scratch_path(spark, "pool")
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], "run string, topology string, score double").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = candidate_pool(spark.readStream.schema("run string, topology string, score double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), 2)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.join(out.groupBy("run").agg(F.max("batch").alias("batch")), ["run", "batch"]).collect()
    assert {(r.run, r.topology, r.score) for r in last} == {("x", "t1", 4.0), ("x", "t2", 3.0), ("y", "t2", 6.0), ("y", "t1", 5.0)}


def test_proteins_and_other_kinds(spark):
    s = spark.createDataFrame([("x", "ARNB-"), ("y", "arnd?"), ("z", "AKNNV")], "taxon string, seq string")
    aln = A.encode(s, kind="AA").withColumn("part", F.lit(0))
    cell = {(r.taxon, r.site): r["mask"] for r in aln.collect()}
    n, d = 1 << A.AMINO.index("N"), 1 << A.AMINO.index("D")
    assert cell["x", 4] == n | d and cell["y", 4] == d and cell["x", 5] == A.gap_of(20) == cell["y", 5]
    one = A.partition_summary(aln, 20).where("part = 0").first()
    assert (one.sites, one.constant, one.informative, one.variable) == (5, 3, 0, 2)
    b = A.encode(spark.createDataFrame([("x", "01-")], "taxon string, seq string"), kind="BIN")
    assert [r["mask"] for r in b.orderBy("site").collect()] == [1, 2, 3]


def test_positions_in_buckets(spark):
    g = np.random.default_rng(1)
    keys = [(int(p), int(k)) for p, k in zip(g.integers(0, 3, 500), g.choice(10**6, 500, replace=False), strict=True)] + [(7, 5)]
    got = {(r.p, r.k): r.n for r in A.ranked(spark.createDataFrame(keys, "p int, k long"), ["p"], "k", "n", 16).collect()}
    for p in {p for p, _ in keys}:
        assert [got[p, k] for _, k in sorted(x for x in keys if x[0] == p)] == list(range(1, sum(x[0] == p for x in keys) + 1))
    assert A.ranked(spark.createDataFrame([], "p int, k long"), ["p"], "k", "n").count() == 0


def test_identical_sequences_by_hash(spark):
    rows = [(t, i, 0, m) for t, seq in enumerate(([1, 2, 4], [1, 2, 4], [1, 4, 2], [1, 2, 4], [1, 2, 15])) for i, m in enumerate(seq)]
    got = {r.taxon: r.kept_as for r in A.identical_sequences(spark.createDataFrame(rows, "taxon int, site long, part int, mask int")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere())


def test_scopes_delete_what_they_wrote(spark):
    import os

    from cladeforge.sources.storage import scope, written

    at = lambda df: df._cladeforge_path.removeprefix("file://").removeprefix("file:")
    before = written(spark.range(3), "a")
    with scope() as keep:
        inner = written(spark.range(4), "b")
        out = written(inner.where("id > 1"), "c")
        keep.append(out)
    assert os.path.exists(at(before)) and not os.path.exists(at(inner)) and out.count() == 2
