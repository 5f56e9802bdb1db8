import pytest
from pyspark.sql import functions as F

from cladeforge.operators import alignment as A
from cladeforge.sources import readers as R
from cladeforge.sources import writers as O


def test_formats_agree():
    want = [("t1", "ACGTAC"), ("t2", "AC-TAN")]
    assert R.parse_phylip("2 6\nt1 ACG\nt2 AC-\n\nTAC\nTAN\n") == want
    assert R.parse_phylip("2 6\nt1 ACG\nTAC\nt2 AC-\nTAN\n") == want
    assert R.parse_fasta(">t1 first\nACG\nTAC\n>t2\nac-tan\n") == want
    assert R.parse_nexus_data("#NEXUS\nbegin data;\nmatrix\n t1 ACG[x]\n t2 AC-\n\n t1 TAC\n t2 TAN\n;\nend;") == want
    assert R.parse_clustal("CLUSTAL W\n\nt1 ACG 3\nt2 AC- 2\n   ** \n\nt1 TAC\nt2 TAN\n") == want
    assert R.parse_msf("PileUp\n MSF: 6\n Name: t1 Len: 6\n Name: t2 Len: 6\n//\n t1 ACG\n t2 AC-\n\n t1 TAC\n t2 TAN\n") == want
    assert [R.detect(x) for x in (">a", "#NEXUS", "CLUSTAL", "(a,b);", " 4 5", "??")] == ["fasta", "nexus", "clustal", "newick", "phylip", "unknown"]
    with pytest.raises(ValueError):
        R.parse_phylip("2 6\nt1 ACGTAC\nt1 ACGTAC\n")


def test_read_encode_write(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\n>y\nA-RT\n>z\nACCT\n")
    seqs = R.read_alignment(spark, f"file://{tmp_path}/a.fa")
    assert R.sequence_type(seqs).first()["seq_type"] == "DNA"
    aln = A.encode(seqs).withColumn("part", F.lit(0))
    assert {r.taxon: r.seq for r in O.sequences(aln).collect()} == {"x": "ACGT", "y": "A-RT", "z": "ACCT"}
    assert A.partition_summary(aln).where("part = 0").first()["constant"] == 3
    table = {r.site: (r.stat, r.observed) for r in O.site_table(A.classified(A.columns(aln))).collect()}
    assert table[1] == ("C", "A") and table[2] == ("C", "C") and table[3] == ("-", "CGR")
    assert len(O.fasta(aln).collect()) == 3 and O.phylip(aln).orderBy("order").count() == 4


def test_partitions_trees_matrices(spark, tmp_path):
    (tmp_path / "p.nex").write_text("#nexus\nbegin sets;\ncharset p1 = 1-9\\3 2-9\\3;\ncharset p2 = 3-9\\3;\ncharpartition m = HKY:p1, GTR+G:p2;\nend;")
    parts = R.read_partitions(spark, f"file://{tmp_path}/p.nex", 9)
    assert [(r.name, r.lower, r.upper, r.step, r.model) for r in parts.orderBy("part", "lower").collect()] == [("p1", 1, 9, 3, "HKY"), ("p1", 2, 9, 3, "HKY"), ("p2", 3, 9, 3, "GTR+G")]
    aln = spark.range(1, 10).select(F.lit("x").alias("taxon"), F.col("id").alias("site"), F.lit(1).alias("mask"))
    assert {r.part: r["count"] for r in R.assign_partitions(aln, parts).groupBy("part").count().collect()} == {0: 6, 1: 3}
    (tmp_path / "t.nwk").write_text("(a,b,c);\n(a,(b,c));\n(b,(a,c));\n")
    assert [r.tree for r in R.read_trees(spark, f"file://{tmp_path}/t.nwk", burn_in=1).orderBy("tree").collect()] == [1, 2]
    assert list(R.parse_trees("#NEXUS\nbegin trees;\ntranslate 1 a, 2 b;\ntree x = [&R] (1:0.5,2);\nend;")) == [("(a:0.5,b);",)]
    assert R.parse_matrix("3\na 0 1 2\nb 1 0 3\nc 2 3 0\n") == [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 3.0)]
    assert A.site_ranges("1-9\\2, 12 15-.", 20) == [(1, 9, 2), (12, 12, 1), (15, 20, 1)]
    with pytest.raises(ValueError):
        A.site_ranges("5-30", 20)


def test_empty_alignment(spark):
    aln = spark.createDataFrame([], "taxon int, site long, part int, mask int")
    assert A.patterns(aln).count() == 0
    assert A.observed_distance(aln).count() == 0


def test_small_readers(spark, tmp_path):
    def at(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    c = R.read_counts(spark, at("c.cf", "COUNTSFILE NPOP 2 NSITES 3\nCHROM POS p1 p2\n1 7 10,0,0,0 0,3,0,1\n1 8 0,0,0,0 1,1,1,0\n1 9 0,0,9,1 0,0,0,2\n"))
    got = {(r.pos, r.population): r.state for r in R.population_states(c, 10).collect()}
    # pairs AC AG AT CG CT GT are 0 to 5, nine states each
    assert got == {(7, "p1"): 0, (7, "p2"): 4 + 4 * 9 + 7, (8, "p1"): None, (8, "p2"): None, (9, "p1"): 4 + 5 * 9 + 8, (9, "p2"): 3}
    assert [tuple(r) for r in R.read_site_values(spark, at("r.txt", "# rates\n1 0.5\n2-4 1.25\n")).orderBy("site").collect()] == [(1, [0.5]), (2, [1.25]), (3, [1.25]), (4, [1.25])]
    assert R.parse_costs("3\n0 1 5\n1 0 1\n5 1 0\n") == [[0, 1, 2], [1, 0, 1], [2, 1, 0]] and R.parse_costs("fitch 2") == [[0, 1], [1, 0]]
    assert R.read_costs(spark, at("m.txt", "2\n0 3\n1 0\n")).where("a = 0 AND b = 1").first().cost == 3
    assert [r.members for r in R.read_constraint(spark, at("k.nwk", "((b,c),a,d,e);")).collect()] == [["a", "d", "e"]]
    assert sorted(map(tuple, R.read_diversity_parameters(spark, at("p.txt", "2\na 1.5\nb 1 4\n")).collect())) == [("a", 3.0, 1.0), ("b", 2.0, 4.0)]
    assert sorted(map(tuple, R.read_food_web(spark, at("w.txt", "fox hare 0.5\nhare grass\n")).collect())) == [("fox", "hare", 0.5), ("hare", "grass", 1.0)]
    with pytest.raises(Exception, match="cycle"):
        R.read_food_web(spark, at("x.txt", "a b\nb c\nc a\n")).collect()
    assert sorted(map(tuple, R.read_clusters(spark, at("q.nex", "#nexus\nbegin sets;\ntaxset one = a b;\ntaxset ignored = z;\ntaxset two = c;\nend;")).collect())) == [(0, "z"), (1, "a"), (1, "b"), (2, "c")]
    assert sorted(map(tuple, R.read_clusters(spark, at("q.nwk", "(a,b);(c,d);")).collect())) == [(1, "a"), (1, "b"), (2, "c"), (2, "d")]
    assert [tuple(r) for r in R.read_mutations(spark, at("u.txt", "n1 A10G/c3t\nn2 G7-\n")).orderBy("node", "site").collect()] == [("n1", "C", 3, "T"), ("n1", "A", 10, "G"), ("n2", "G", 7, "-")]
    spark.range(3).write.parquet(f"file://{tmp_path}/state")
    assert R.read_table(spark, f"file://{tmp_path}/state").count() == 3


def test_small_writers(spark):
    text = O.tree_drawing("((a,b),c);")
    assert [x.split()[-1] for x in text.splitlines()] == ["a", "b", "c"]
    table = spark.createDataFrame([("x,y", 1), ('say "z"', None)], "name string, n int")
    assert [r.value for r in O.comma_lines(table).orderBy("order").collect()] == ["name,n", '"say ""z""",', '"x,y",1']
    nodes, rates = spark.createDataFrame([("a", "root", 0.5)], "node string, parent string, brlen double"), spark.createDataFrame([(0, 1.0), (1, 2.0)], "part int, rate double")
    assert sorted((r.part, r.length) for r in O.branch_table(nodes, rates).collect()) == [(0, 0.5), (1, 1.0)]
