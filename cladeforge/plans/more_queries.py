"""Further alignment, split, tree, likelihood and file-format queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladeforge.functions.models import Model, parse as model_of
from cladeforge.operators import alignment as A
from cladeforge.operators import inference as I
from cladeforge.operators import likelihood as L
from cladeforge.operators import newick as N
from cladeforge.operators import search as H
from cladeforge.operators import splits as S
from cladeforge.operators import trees as T
from cladeforge.operators import treetests as P
from cladeforge.plans.adapters import CTE, alignment, by_bytes, clade_members, presence, site_columns, table, taxa_of, taxonomy
from cladeforge.plans.alignment_queries import _ALN, _COLS, _PAIRS
from cladeforge.plans.kernel_queries import GAMMA, TREE
from cladeforge.plans.tree_queries import _SP, _UP, _areas, _splits, r
from cladeforge.sources import readers as R
from cladeforge.sources import writers as O
from cladeforge.sources.storage import scratch_path, written

#: What the queries ask for: constant sites to add by state, taxa to keep, rates of partitions, models of a mixture and their weights.
CONSTANT = {1: 5, 2: 7, 8: 3}
KEPT, MIN_TAXA, MIN_CHARS = [1, 2, 3, 5], 2, 3
PART_RATES = {0: ("JC", 0.5), 1: ("K80{2}", 1.0), 2: (GAMMA, 1.5), 3: ("JC", 2.0)}
CLASSES, CLASS_WEIGHTS = ["F81+FO{0.4,0.1,0.1,0.4}", "F81+FO{0.1,0.4,0.4,0.1}", "JC"], [0.3, 0.3, 0.4]
UNREST = "UNREST{1,2,0.5,1.5,0.7,1.1,0.9,1.3,0.6,0.8,1.2,1}"
ERROR = "JC+E{0.05}"
SHUFFLE = "(site * 7919 + 13) % 104729"


def text_of(states: str = "states") -> F.Column:
    return F.concat_ws(",", F.transform(states, lambda x: x.cast("string"))).alias("states")


def cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_columns(spark, sf_dir).select("part", "site", "states")


def pats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.patterns(cols(spark, sf_dir))


def names(spark: SparkSession, sf_dir: str) -> list[str]:
    return [str(t) for t in taxa_of(spark, sf_dir)]


# alignments


def q_add_constant(spark, sf_dir):
    return A.add_constant(pats(spark, sf_dir), CONSTANT, 1).select("part", text_of(), "freq", "is_const", "informative")


def q_keep_taxa(spark, sf_dir):
    taxa = spark.createDataFrame([(t,) for t in KEPT], "taxon int")
    return A.keep_taxa(alignment(spark, sf_dir), taxa, MIN_TAXA, MIN_CHARS)


def q_supermatrix(spark, sf_dir):
    return A.supermatrix(presence(spark, sf_dir))


def q_copy_gaps(spark, sf_dir):
    aln = alignment(spark, sf_dir)
    other, line = aln.withColumn("taxon", (F.col("taxon") % 7 + 1).cast("int")), table(spark, sf_dir, "lineitem")
    return A.copy_gaps(by_bytes(line, aln, "taxon", "site"), by_bytes(line, other, "taxon", "site")).select("taxon", "site", "part", "mask")


def q_shuffled(spark, sf_dir):
    return A.shuffled(cols(spark, sf_dir), SHUFFLE)


def q_multinomial(spark, sf_dir):
    p = pats(spark, sf_dir)
    return A.multinomial_lnl(p, p).select("part", F.round("lnl", 4).alias("lnl"))


def q_unseen(spark, sf_dir):
    return A.unseen_constant(pats(spark, sf_dir).where("freq > 1"))


def q_expected(spark, sf_dir):
    scored = L.pattern_likelihood(pats(spark, sf_dir), TREE, names(spark, sf_dir), model_of("JC"))
    return A.expected_frequencies(scored).select("part", "first_site", "freq", F.round("expected", 6).alias("expected"))


def q_rebuild(spark, sf_dir):
    p = pats(spark, sf_dir)
    counts = p.select("part", "first_site", F.explode(F.array(F.lit(1), F.lit(2))).alias("rep")).withColumn("w", F.expr("(rep * 31 + first_site * 17) % 3"))
    return A.rebuild(p, counts).select("rep", "part", "site", text_of())


def q_bounds(spark, sf_dir):
    return A.parsimony_bounds(pats(spark, sf_dir))


def q_part_distances(spark, sf_dir):
    return A.part_distances(pats(spark, sf_dir)).select("part", "t1", "t2", r("d"))


def q_part_trees(spark, sf_dir):
    """A tree for each partition by itself."""
    return H.distance_trees(A.part_distances(pats(spark, sf_dir)), "part")


def q_bootstrap_trees(spark, sf_dir):
    """The standard bootstrap: patterns resampled, distances, a tree for each replicate, and in how many trees each split stands."""
    p = pats(spark, sf_dir).groupBy("states").agg(F.sum("freq").alias("freq"), F.min("first_site").alias("ptn"))
    boot = P.samples(p, 20, "(rep * 7919 + ptn * 104729) % 5")
    d = A.part_distances(p.select("states", "ptn").join(boot, "ptn"), "w", "rep")
    trees = H.distance_trees(d, "rep")
    return N.tree_splits(trees, "rep").groupBy("members").agg(F.countDistinct("rep").alias("trees"))


def q_report(spark, sf_dir):
    """The sections of a report that need no model, as (section, item, value)."""
    s = A.partition_summary(cols(spark, sf_dir))
    rows = s.select(F.lit("partitions").alias("section"), F.coalesce(F.col("part").cast("string"), F.lit("all")).alias("part"), F.explode(F.create_map(*(x for c in ("sites", "patterns", "constant", "informative", "variable") for x in (F.lit(c), F.col(c).cast("double"))))).alias("item", "value"))
    gaps = A.site_gaps(alignment(spark, sf_dir)).agg(F.sum("gaps").cast("double").alias("gaps"), F.sum("ambiguous").cast("double").alias("ambiguous"))
    more = gaps.select(F.lit("cells").alias("section"), F.lit("all").alias("part"), F.explode(F.create_map(F.lit("gaps"), F.col("gaps"), F.lit("ambiguous"), F.col("ambiguous"))).alias("item", "value"))
    return rows.unionByName(more)


# splits and trees


def q_branch_statistics(spark, sf_dir):
    return S.branch_statistics(_splits(spark, sf_dir)[0]).select(S.key().alias("members"), "trees", r("mean"), r("sd"), "low", "high")


def _taxa(spark, sf_dir) -> DataFrame:
    return clade_members(spark, sf_dir).select("taxon").distinct()


def q_restrict(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    return S.restrict(s, _taxa(spark, sf_dir).where("taxon % 3 = 0")).select("tree", S.key().alias("members"), "weight")


def q_constraint(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    return S.constraint_conflicts(s, [F.expr("taxon % 8 IN (0, 1)"), F.expr("taxon % 2 = 0")], _taxa(spark, sf_dir).where("taxon % 3 = 0"))


def q_circular(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    own = A.ranked(_taxa(spark, sf_dir).withColumn("g", F.col("taxon") % 8), ["g"], "taxon", "k")
    size = own.groupBy("g").agg(F.count("*").alias("n"))
    start = size.select("g", (F.sum("n").over(W.orderBy("g")) - F.col("n")).alias("start"))  # eight rows
    return S.circular(s, own.join(start, "g").select("taxon", (F.col("start") + F.col("k")).alias("place"))).select("tree", S.key().alias("members"), "circular")


def q_tree_nodes(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    return S.tree_nodes(s.where("tree = 'click'"), _taxa(spark, sf_dir))


def q_majority(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    return S.tree_nodes(S.split_system(s, 0.5), _taxa(spark, sf_dir))


def q_distances_from(spark, sf_dir):
    return T.distances_from(taxonomy(spark, sf_dir), "s7").select("node", r("d"))


def q_random_sets(spark, sf_dir):
    leaf = T.leaves(taxonomy(spark, sf_dir)).select(F.col("node").alias("leaf"))
    return T.random_sets(leaf, 20, 4, ORDER)


def q_pd_distribution(spark, sf_dir):
    tree = taxonomy(spark, sf_dir)
    sets = T.random_sets(T.leaves(tree).select(F.col("node").alias("leaf")), 20, 4, ORDER)
    return T.diversity(tree, sets.withColumnRenamed("rep", "area")).select(F.col("area").alias("rep"), r("pd"))


def q_taxa_frequency(spark, sf_dir):
    """In how many areas each leaf is, and its rank by that."""
    n = _areas(spark, sf_dir).groupBy("leaf").agg(F.count("*").alias("areas"))
    return n.withColumn("rank", F.rank().over(W.orderBy(F.col("areas").desc())))


def q_prune(spark, sf_dir):
    return T.prune_shortest(taxonomy(spark, sf_dir), 4).select("step", "leaf", r("brlen"))


ORDER = "(CAST(substring(leaf, 2) AS BIGINT) * 7919 + rep * 104729) % 1299709"


# likelihood


def q_partition_likelihood(spark, sf_dir):
    models = {p: (model_of(m), rate) for p, (m, rate) in PART_RATES.items()}
    return L.partition_likelihood(pats(spark, sf_dir), TREE, names(spark, sf_dir), models).select("part", F.round("lnl", 4).alias("lnl"))


def _lnl(spark, sf_dir, name: str) -> DataFrame:
    scored = L.score_patterns(pats(spark, sf_dir), TREE, names(spark, sf_dir), model_of(name))
    return scored.groupBy("part").agg(F.round(F.sum(F.col("freq") * F.col("lnl")), 4).alias("lnl"))


def q_unrest(spark, sf_dir):
    return _lnl(spark, sf_dir, UNREST)


def q_error(spark, sf_dir):
    return _lnl(spark, sf_dir, ERROR)


def q_mixture(spark, sf_dir):
    m = [model_of(x) for x in CLASSES]
    scored = L.mixture(pats(spark, sf_dir), TREE, names(spark, sf_dir), m, CLASS_WEIGHTS)
    return scored.groupBy("part").agg(F.round(F.sum(F.col("freq") * F.col("lnl")), 4).alias("lnl"))


def q_site_frequencies(spark, sf_dir):
    m = [model_of(x) for x in CLASSES]
    scored = L.site_frequencies(L.mixture(pats(spark, sf_dir), TREE, names(spark, sf_dir), m, CLASS_WEIGHTS), m)
    return scored.select("part", "first_site", *(F.round(F.col("f")[i], 6).alias(f"f{s}") for i, s in enumerate(A.STATES)))


def q_site_lnl(spark, sf_dir):
    """Each site's log-likelihood, and each rate class's posterior there."""
    scored = L.score_patterns(pats(spark, sf_dir), TREE, names(spark, sf_dir), model_of(GAMMA))
    at = cols(spark, sf_dir).join(scored.select("part", "states", "lnl", "posterior"), ["part", "states"])
    return at.select("part", "site", F.round("lnl", 6).alias("lnl"), *(F.round(F.col("posterior")[i], 6).alias(f"p{i}") for i in range(5)))


COSTS = [[0, 2, 1, 2], [2, 0, 2, 1], [1, 2, 0, 2], [2, 1, 2, 0]]
BY_GENE, BY_SITE = "(rep * 7 + part * 13) % 3", "(rep * 31 + ptn * 17) % 4"


def q_by_characters(spark, sf_dir):
    return A.by_characters(pats(spark, sf_dir).withColumn("first_site", F.col("first_site"))).select("part", "first_site", "num_chars", "place")


def q_keep_frequent(spark, sf_dir):
    return A.keep_frequent(pats(spark, sf_dir), 2, 20).select("part", "first_site", "freq")


def q_keep_residues(spark, sf_dir):
    return A.keep_residues(alignment(spark, sf_dir), 3, 11, 40)


def q_drop_identical(spark, sf_dir):
    aln = alignment(spark, sf_dir)
    twins = aln.unionByName(aln.where("taxon <= 3").withColumn("taxon", F.col("taxon") + 10)).unionByName(aln.where("taxon <= 2").withColumn("taxon", F.col("taxon") + 20))
    return A.drop_identical(twins).groupBy("taxon").agg(F.count("*").alias("cells"))


def q_drop_empty(spark, sf_dir):
    aln = alignment(spark, sf_dir)
    more = aln.where("taxon = 1").withColumns({"taxon": F.lit(99), "mask": F.lit(15)})
    return A.drop_empty(aln.unionByName(more)).groupBy("taxon").agg(F.count("*").alias("cells"))


def q_keep_partitions(spark, sf_dir):
    aln = alignment(spark, sf_dir)
    return A.keep_partitions(aln, [0, 3]).select(F.lit("kept").alias("side"), "taxon", "site", "mask").unionByName(A.keep_partitions(aln, [0, 3], remove=True).select(F.lit("rest").alias("side"), "taxon", "site", "mask"))


def q_codon_frequencies(spark, sf_dir):
    aln = alignment(spark, sf_dir)
    f3, f1 = A.codon_frequencies(aln), A.codon_frequencies(aln, False).withColumnRenamed("share", "pooled")
    return f3.join(f1, "codon").select("codon", r("share"), r("pooled"))


def q_incompatible_between(spark, sf_dir):
    s, n = _splits(spark, sf_dir)
    return S.incompatible_between(s, n)


def q_branch_lengths(spark, sf_dir):
    return S.branch_lengths(_splits(spark, sf_dir)[0], "click").select(S.key().alias("members"), "tree", "own", "weight")


def q_best_pair(spark, sf_dir):
    return S.best_pair(_splits(spark, sf_dir)[0], clade_members(spark, sf_dir).select("taxon"))


def q_diameter(spark, sf_dir):
    """The farthest pair of leaves, the first of several, and the mean distance."""
    d = T.diameter(taxonomy(spark, sf_dir))
    return d.select(F.round("d", 6).alias("diameter"), F.concat("a", F.lit(","), "b").alias("pair"), r("mean"))


def q_rf_adjacent(spark, sf_dir):
    """Trees in the order of their names, each against the next, and every one against the first two."""
    rf = S.robinson_foulds(_splits(spark, sf_dir)[0])
    trees = rf.select(F.col("t1").alias("t")).unionByName(rf.select(F.col("t2").alias("t"))).distinct().agg(F.array_sort(F.collect_list("t")).alias("o"))
    at = rf.join(F.broadcast(trees)).select("t1", "t2", "rf", (F.array_position("o", F.col("t1")) + 1 == F.array_position("o", F.col("t2"))).alias("adjacent"), (F.array_position("o", F.col("t1")) <= 2).alias("with_first_two"))
    return at.where("adjacent OR with_first_two")


def q_sankoff(spark, sf_dir):
    scored = L.sankoff_patterns(pats(spark, sf_dir), TREE, names(spark, sf_dir), COSTS)
    return scored.groupBy("part").agg(F.sum(F.col("freq") * F.col("score")).cast("long").alias("score"))


def q_ancestral(spark, sf_dir):
    scored = L.ancestral_states(pats(spark, sf_dir), TREE, names(spark, sf_dir), model_of(GAMMA.replace("+I{0.1}", "")))
    return scored.select("part", "first_site", *(F.round(F.col("marginal")[i], 6).alias(f"p{s}") for i, s in enumerate(A.STATES)))


def q_gene_bootstrap(spark, sf_dir):
    from cladeforge.plans.adapters import pattern_likelihoods

    p = pattern_likelihoods(spark, sf_dir).withColumn("part", (F.col("ptn") % 5).cast("int"))
    whole = P.rell(p, P.gene_samples(p, 10, BY_GENE)).withColumnRenamed("lnl", "by_gene")
    inside = P.rell(p, P.gene_samples(p, 10, BY_GENE, BY_SITE)).withColumnRenamed("lnl", "by_site")
    return whole.join(inside, ["tree", "rep"]).select("tree", "rep", F.round("by_gene", 3).alias("by_gene"), F.round("by_site", 3).alias("by_site"))


def q_protein_summary(spark, sf_dir):
    return A.partition_summary(site_columns(spark, sf_dir, protein=True).select("part", "site", "states"), 20)


def q_protein_distance(spark, sf_dir):
    d = A.jc_distance(A.observed_distance(site_columns(spark, sf_dir, protein=True).select("part", "site", "states"), 20), 20)
    return d.select("t1", "t2", r("d"), r("jc"))


def q_protein_composition(spark, sf_dir):
    return A.composition_test(alignment(spark, sf_dir, protein=True), 20).select("taxon", r("chi2"), "df", r("gap_percent"))


def q_protein_likelihood(spark, sf_dir):
    p = A.patterns(site_columns(spark, sf_dir, protein=True).select("part", "site", "states"), n_states=20)
    scored = L.score_patterns(p, TREE, names(spark, sf_dir), model_of("POISSON", n_states=20))
    return scored.groupBy("part").agg(F.round(F.sum(F.col("freq") * F.col("lnl")), 3).alias("lnl"))


def q_likelihood_search(spark, sf_dir):
    one = pats(spark, sf_dir).groupBy("states").agg(F.sum("freq").alias("freq"))
    return I.likelihood_search(spark, one, names(spark, sf_dir), model_of("JC"), 2, 1).select("seed", "topology", F.round("lnl", 2).alias("lnl"))


def q_likelihood_mapping(spark, sf_dir):
    mapped = I.likelihood_mapping(pats(spark, sf_dir), len(names(spark, sf_dir)), model_of("JC"))
    return I.mapping_summary(mapped, len(names(spark, sf_dir)))


def q_merge_partitions(spark, sf_dir):
    p = pats(spark, sf_dir)
    out = I.merge_partitions(p, TREE, names(spark, sf_dir), ["JC"], [0.25] * 4)
    return out.select(text_of("parts").alias("parts"), "model", F.round("lnl", 2).alias("lnl"), "k", "n")


def q_least_squares(spark, sf_dir):
    """The fixed tree's least-squares lengths for each partition's distances."""
    d = A.part_distances(pats(spark, sf_dir)).withColumns({"t1": F.col("t1") + 1, "t2": F.col("t2") + 1})
    return I.least_squares_trees(d, TREE, "part").select("part", F.round("rss", 6).alias("rss"))


# files: written as text, read back


def _first(spark, sf_dir) -> DataFrame:
    """One partition as an alignment of its own, sites from 1."""
    one = A.concatenate(alignment(spark, sf_dir).where("part = 1"))
    return one.select(F.concat(F.lit("t"), F.col("taxon").cast("string")).alias("taxon"), F.col("position").alias("site"), F.lit(0).alias("part"), "mask")


def _through(spark, lines: DataFrame, what: str) -> str:
    """The path of a text file of these lines (order, value), in one part: a file is one alignment or matrix."""
    path = scratch_path(spark, what)
    lines.repartition(1).sortWithinPartitions("order").select("value").write.text(path)
    return f"{path}/part-*"


def _back(spark, sf_dir, lines, kind: str) -> DataFrame:
    seqs = R.read_alignment(spark, _through(spark, lines(_first(spark, sf_dir)), kind), kind)
    return A.encode(seqs).select("taxon", "site", "mask")


def q_io_phylip(spark, sf_dir):
    return _back(spark, sf_dir, O.phylip, "phylip")


def q_io_fasta(spark, sf_dir):
    return _back(spark, sf_dir, lambda a: O.fasta(a).select(F.xxhash64("value").alias("order"), "value"), "fasta")


def q_io_nexus(spark, sf_dir):
    return _back(spark, sf_dir, O.nexus, "nexus")


def q_io_clustal(spark, sf_dir):
    return _back(spark, sf_dir, O.clustal, "clustal")


def q_io_msf(spark, sf_dir):
    return _back(spark, sf_dir, O.msf, "msf")


def q_io_distances(spark, sf_dir):
    d = A.part_distances(pats(spark, sf_dir).where("part = 0")).select("t1", "t2", F.round("d", 6).alias("d"))
    rows = O.distance_lines(d).select(F.col("taxon").cast("long").alias("order"), "value")
    head = d.agg((F.max("t2") + 1).cast("string").alias("value")).select(F.lit(-1).cast("long").alias("order"), "value")
    return R.read_distances(spark, _through(spark, head.unionByName(rows), "distances")).select(F.col("t1").cast("int").alias("t1"), F.col("t2").cast("int").alias("t2"), r("d"))


def q_io_presence(spark, sf_dir):
    p = presence(spark, sf_dir)
    parts = p.agg(F.array_sort(F.collect_set("part"))).scalar()
    own = p.groupBy("taxon").agg(F.collect_set("part").alias("own")).withColumn("parts", parts)
    rows = own.select(F.col("taxon").alias("order"), F.concat_ws(" ", F.col("taxon").cast("string"), F.array_join(F.transform("parts", lambda x: F.array_contains("own", x).cast("int").cast("string")), " ")).alias("value"))
    head = own.agg(F.concat_ws(" ", F.count("*").cast("string"), F.max(F.size("parts")).cast("string")).alias("value")).select(F.lit(-1).cast("long").alias("order"), "value")
    return R.read_presence(spark, _through(spark, head.unionByName(rows), "presence")).select(F.col("taxon").cast("long").alias("taxon"), "part")


def q_io_newick(spark, sf_dir):
    """The taxonomy as a Newick tree, written, read back and taken apart."""
    t = taxonomy(spark, sf_dir)
    text = S.newick(t.select(F.lit(0).alias("tree"), "node", F.col("parent"), F.col("node").alias("label"), F.round("brlen", 6).alias("length")))
    back = R.read_trees(spark, _through(spark, text.select(F.col("tree").cast("long").alias("order"), F.col("newick").alias("value")), "newick"))
    n = N.nodes(back.select("tree", "newick"))
    up = n.select(F.col("node").alias("parent"), F.col("name").alias("above"))
    return n.where("parent IS NOT NULL").join(up, "parent").select(F.col("name").alias("node"), F.coalesce(F.nullif("above", F.lit("")), F.lit("root")).alias("parent"), r("brlen"))


def q_io_partitions(spark, sf_dir):
    """The four strided partitions as a NEXUS sets block, read back and joined to the sites."""
    n = int(table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0])
    last = spark.range(1).select(F.lit(n).cast("long").alias("n"))
    sets = last.select("n", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).select((F.col("k") - 1).alias("part"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("name"), F.col("k").cast("long").alias("lower"), F.col("n").alias("upper"), F.lit(4).cast("long").alias("step"))
    lines = O.partition_lines(sets).select(F.xxhash64("value").alias("order"), "value")
    ends = spark.createDataFrame([(-(2**63), "#nexus\nbegin sets;"), (2**63 - 1, "end;")], "order long, value string")
    back = R.read_partitions(spark, _through(spark, lines.unionByName(ends), "sets"), n)
    return R.assign_partitions(alignment(spark, sf_dir).select("taxon", "site", "mask"), back.withColumn("part", (F.substring("name", 2, 9).cast("int") % 4).cast("int"))).select("taxon", "site", "part", "mask")


def q_io_taxonomy(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ids = region.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(1).cast("long").alias("parent"), F.lit("region").alias("rank"), F.col("r_name").alias("name"))
    ids = ids.unionByName(nation.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.lit("nation").alias("rank"), F.col("n_name").alias("name")))
    bar = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|"))
    nodes = ids.select(F.col("id").alias("order"), bar(F.col("id").cast("string"), F.col("parent").cast("string"), "rank").alias("value"))
    label = ids.select(F.col("id").alias("order"), bar(F.col("id").cast("string"), "name", F.lit(""), F.lit("scientific name")).alias("value"))
    other = ids.select(F.col("id").alias("order"), bar(F.col("id").cast("string"), F.lower("name"), F.lit(""), F.lit("synonym")).alias("value"))
    return R.read_taxonomy(spark, _through(spark, nodes, "nodes"), _through(spark, label.unionByName(other), "names"))


def q_io_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    value = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(" "), F.when(F.col("o_custkey") % 3 == 0, day("a")).when(F.col("o_custkey") % 3 == 1, F.concat(day("a"), F.lit(":"), day("b"))).otherwise(F.concat(F.lit(":"), day("b"))))
    return R.read_dates(spark, _through(spark, o.select(F.col("o_custkey").alias("order"), value.alias("value")), "dates"))


def q_site_table(spark, sf_dir):
    return O.site_table(A.classified(cols(spark, sf_dir)))


QUERIES = {
    "aln_add_constant": q_add_constant, "aln_keep_taxa": q_keep_taxa, "aln_supermatrix": q_supermatrix, "aln_copy_gaps": q_copy_gaps, "aln_shuffled": q_shuffled, "aln_multinomial_lnl": q_multinomial, "aln_unseen_constant": q_unseen,
    "aln_expected_frequencies": q_expected, "boot_rebuild": q_rebuild, "parsimony_bounds": q_bounds, "dist_by_partition": q_part_distances, "tree_by_partition": q_part_trees, "boot_standard": q_bootstrap_trees, "report_alignment": q_report,
    "split_branch_statistics": q_branch_statistics, "split_restrict": q_restrict, "split_constraint": q_constraint, "split_circular": q_circular, "split_tree_nodes": q_tree_nodes, "split_majority_tree": q_majority,
    "tree_distances_from": q_distances_from, "pd_random_sets": q_random_sets, "pd_distribution": q_pd_distribution, "pd_taxa_frequency": q_taxa_frequency, "pd_prune": q_prune,
    "lik_partition": q_partition_likelihood, "lik_unrest": q_unrest, "lik_error": q_error, "lik_mixture": q_mixture, "lik_site_frequencies": q_site_frequencies, "lik_site_lnl": q_site_lnl,
    "aln_by_characters": q_by_characters, "aln_keep_frequent": q_keep_frequent, "aln_keep_residues": q_keep_residues, "aln_drop_identical": q_drop_identical, "aln_drop_empty": q_drop_empty, "aln_keep_partitions": q_keep_partitions,
    "aln_codon_frequencies": q_codon_frequencies, "split_incompatible_between": q_incompatible_between, "split_branch_lengths": q_branch_lengths, "pd_best_pair": q_best_pair, "tree_diameter": q_diameter, "tree_rf_adjacent": q_rf_adjacent,
    "parsimony_sankoff": q_sankoff, "lik_ancestral": q_ancestral, "boot_gene": q_gene_bootstrap,
    "prot_summary": q_protein_summary, "prot_distance": q_protein_distance, "prot_composition": q_protein_composition, "prot_likelihood": q_protein_likelihood,
    "search_likelihood": q_likelihood_search, "quartet_mapping": q_likelihood_mapping, "tree_least_squares": q_least_squares, "model_merge_partitions": q_merge_partitions,
    "io_phylip": q_io_phylip, "io_fasta": q_io_fasta, "io_nexus": q_io_nexus, "io_clustal": q_io_clustal, "io_msf": q_io_msf, "io_distances": q_io_distances, "io_presence": q_io_presence, "io_newick": q_io_newick,
    "io_partitions": q_io_partitions, "io_taxonomy": q_io_taxonomy, "io_dates": q_io_dates, "io_site_table": q_site_table,
}


def likelihood_sql(model: Model, tree: str, tag: str, last: str) -> tuple[list[str], str, list[str]]:
    """Steps over `last` (with states), the last step's name, and the terms of a pattern's likelihood, one for each rate class."""
    root, steps, parts = N.parse(tree), [], []
    for c, (rate, share) in enumerate(zip(model.rates, model.shares, strict=True)):
        where: dict[N.Node, list[str]] = {}
        for k, x in enumerate(root.walk()):
            if not x.children:
                hit = [f"(CASE WHEN (states[{x.name}] & {1 << s}) <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for s in range(4)]
                e = model.error
                where[x] = [f"({1 - e:.17g}::DOUBLE * {h} + {e / 3:.17g}::DOUBLE * (bit_count(states[{x.name}]) - {h}))" for h in hit] if e else hit
                continue
            rows = [" * ".join("(" + " + ".join(f"{model.p(rate * ch.length)[s, t]:.17g}::DOUBLE * {where[ch][t]}" for t in range(4)) + ")" for ch in x.children) for s in range(4)]
            steps.append(f"{tag}{c}_{k} AS (SELECT *, {', '.join(f'{v} AS {tag}v{c}_{k}_{s}' for s, v in enumerate(rows))} FROM {last})")
            last, where[x] = f"{tag}{c}_{k}", [f"{tag}v{c}_{k}_{s}" for s in range(4)]
        parts.append(f"{share:.17g}::DOUBLE * ({' + '.join(f'{f:.17g}::DOUBLE * {v}' for f, v in zip(model.freqs, where[root], strict=True))})")
    if model.invariant:
        shared = " & ".join(f"states[{i}]" for i in range(1, 8))
        parts.append(f"{model.invariant:.17g}::DOUBLE * 0.25::DOUBLE * bit_count({shared})")
    return steps, last, parts


def _lik(name: str) -> str:
    steps, last, parts = likelihood_sql(model_of(name), TREE, "l", "pats")
    return f"{_COLS}, {', '.join(steps)} SELECT part, round(sum(freq * ln({' + '.join(parts)})), 4) AS lnl FROM {last} GROUP BY part"


def _partition_sql() -> str:
    steps, ends = [], []
    for part, (name, rate) in PART_RATES.items():
        own, last, parts = likelihood_sql(model_of(name), L.scaled(TREE, rate), f"q{part}_", f"p{part}")
        steps += [f"p{part} AS (SELECT * FROM pats WHERE part = {part})", *own]
        ends.append(f"SELECT part, round(sum(freq * ln({' + '.join(parts)})), 4) AS lnl FROM {last} GROUP BY part")
    return f"{_COLS}, {', '.join(steps)} {' UNION ALL '.join(ends)}"


def _mixture_sql(frequencies: bool) -> str:
    steps, last, parts = [], "pats", []
    for i, name in enumerate(CLASSES):
        own, last, terms = likelihood_sql(model_of(name), TREE, f"m{i}_", last)
        steps += own
        parts.append(f"{CLASS_WEIGHTS[i]}::DOUBLE * ({' + '.join(terms)})")
    if not frequencies:
        return f"{_COLS}, {', '.join(steps)} SELECT part, round(sum(freq * ln({' + '.join(parts)})), 4) AS lnl FROM {last} GROUP BY part"
    f = [model_of(x).freqs for x in CLASSES]
    mean = [" + ".join(f"c{i} / (c0 + c1 + c2) * {f[i][s]:.17g}::DOUBLE" for i in range(3)) for s in range(4)]
    return f"{_COLS}, {', '.join(steps)}, cl AS (SELECT part, first_site, {', '.join(f'{p} AS c{i}' for i, p in enumerate(parts))} FROM {last}) SELECT part, first_site, {', '.join(f'round({m}, 6) AS f{s}' for m, s in zip(mean, A.STATES, strict=True))} FROM cl"


def _site_lnl_sql() -> str:
    steps, last, parts = likelihood_sql(model_of(GAMMA), TREE, "l", "pats")
    each = ", ".join(f"{p} AS c{i}" for i, p in enumerate(parts))
    total = " + ".join(f"c{i}" for i in range(len(parts)))
    return f"{_COLS}, {', '.join(steps)}, cl AS (SELECT part, states, {each} FROM {last}) SELECT part, site, round(ln({total}), 6) AS lnl, {', '.join(f'round(c{i} / ({total}), 6) AS p{i}' for i in range(len(parts)))} FROM cl JOIN cols USING (part, states)"


def _expected_sql() -> str:
    steps, last, parts = likelihood_sql(model_of("JC"), TREE, "l", "pats")
    return f"{_COLS}, {', '.join(steps)} SELECT part, first_site, freq, round(({' + '.join(parts)}) * sum(freq) OVER (PARTITION BY part), 6) AS expected FROM {last}"


_PROT = f"""WITH {CTE["protein"]}, cols AS (SELECT part, site, list(mask ORDER BY taxon) AS states, bit_and(mask) AS shared FROM aln GROUP BY part, site),
pats AS (SELECT part, states, count(*) AS freq, min(site) AS first_site, any_value(shared) <> 0 AS is_const, len(list_filter([1 << i FOR i IN range(20)], lambda s: len(list_filter(states, lambda x: x = s)) >= 2)) >= 2 AS informative FROM cols GROUP BY part, states)"""


def _poisson_sql(n: int = 20) -> str:
    """Under equal rates and frequencies a branch keeps a state with chance e and draws one anew else."""
    import math

    root, steps, last, where = N.parse(TREE), [], "pats", {}
    for k, x in enumerate(root.walk()):
        if not x.children:
            where[x] = ([f"(CASE WHEN (states[{x.name}] & {1 << s}) <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for s in range(n)], f"CAST(bit_count(states[{x.name}]) AS DOUBLE)")
            continue
        keep = {c: math.exp(-c.length * n / (n - 1)) for c in x.children}
        rows = [" * ".join(f"({keep[c]:.17g}::DOUBLE * {where[c][0][s]} + {(1 - keep[c]) / n:.17g}::DOUBLE * {where[c][1]})" for c in x.children) for s in range(n)]
        steps.append(f"p{k} AS (SELECT *, {', '.join(f'{v} AS v{k}_{s}' for s, v in enumerate(rows))} FROM {last})")
        last, where[x] = f"p{k}", ([f"v{k}_{s}" for s in range(n)], "(" + " + ".join(f"v{k}_{s}" for s in range(n)) + ")")
    return f"{_PROT}, {', '.join(steps)} SELECT part, round(sum(freq * ln({where[root][1]} / {n})), 3) AS lnl FROM {last} GROUP BY part"


def _site_rates_sql() -> str:
    model = model_of(GAMMA)
    steps, last, parts = likelihood_sql(model, TREE, "l", "pats")
    each, total = ", ".join(f"{p} AS c{i}" for i, p in enumerate(parts)), " + ".join(f"c{i}" for i in range(len(parts)))
    rate = " + ".join(f"c{i} * {v:.17g}::DOUBLE" for i, v in enumerate(model.rates))
    near = ", ".join(f"round(c{i} / ({total}), 9)" for i in range(len(parts)))
    best = f"list_position([{near}], greatest({near}))"
    return f"{_COLS}, {', '.join(steps)}, cl AS (SELECT part, first_site, {each} FROM {last}) SELECT part, first_site, round(({rate}) / ({total}), 6) AS rate, CAST({best} AS BIGINT) AS category FROM cl"


def _sankoff_sql() -> str:
    root, steps, last, where = N.parse(TREE), [], "pats", {}
    for k, x in enumerate(root.walk()):
        if not x.children:
            where[x] = [f"(CASE WHEN (states[{x.name}] & {1 << s}) <> 0 THEN 0 ELSE 1000000 END)" for s in range(4)]
            continue
        rows = [" + ".join("least(" + ", ".join(f"{where[c][t]} + {COSTS[s][t]}" for t in range(4)) + ")" for c in x.children) for s in range(4)]
        steps.append(f"k{k} AS (SELECT *, {', '.join(f'{v} AS k{k}_{s}' for s, v in enumerate(rows))} FROM {last})")
        last, where[x] = f"k{k}", [f"k{k}_{s}" for s in range(4)]
    return f"{_COLS}, {', '.join(steps)} SELECT part, CAST(sum(freq * least({', '.join(where[root])})) AS BIGINT) AS score FROM {last} GROUP BY part"


def _ancestral_sql() -> str:
    model, root = model_of(GAMMA.replace("+I{0.1}", "")), N.parse(TREE)
    steps, last, _ = likelihood_sql(model, TREE, "l", "pats")
    k = len(list(root.walk())) - 1
    each = [" + ".join(f"{share:.17g}::DOUBLE * lv{c}_{k}_{s}" for c, share in enumerate(model.shares)) for s in range(4)]
    return f"{_COLS}, {', '.join(steps)}, st AS (SELECT part, first_site, {', '.join(f'{e} AS s{i}' for i, e in enumerate(each))} FROM {last}) SELECT part, first_site, {', '.join(f'round(s{i} / (s0 + s1 + s2 + s3), 6) AS p{s}' for i, s in enumerate(A.STATES))} FROM st"


_CODONS = [(a + b + c, aa) for (a, b, c), aa in zip(__import__("itertools").product("TCAG", repeat=3), A.CODE, strict=True) if aa != "*"]
_BASE = {"T": 8, "C": 2, "A": 1, "G": 4}
_CLASH2 = "NOT (len(list_intersect(a.m, b.m)) = len(a.m) OR len(list_intersect(a.m, b.m)) = len(b.m) OR len(a.m) + len(b.m) - len(list_intersect(a.m, b.m)) = a.ntaxa)"
_PSTATES = [1 << i for i in range(20)]
_LIST = "array_to_string(states, ',') AS states"
_CONST = "bit_and_all <> 0"
_STATS = f"""list_reduce(states, lambda a, b: a & b) <> 0 AS is_const, {" + ".join(f"CAST(len(list_filter(states, lambda x: x = {s})) >= 2 AS INT)" for s in A.STATES)} >= 2 AS informative"""
_N = [f"len(list_filter(states, lambda x: x = {s}))" for s in A.STATES]
_SETS = f"""leafs AS (SELECT node AS leaf FROM leaf), sets AS (SELECT CAST(rep AS INTEGER) AS rep, leaf FROM (SELECT rep, leaf, row_number() OVER (PARTITION BY rep ORDER BY {ORDER}, leaf) AS n FROM leafs, range(1, 21) t(rep)) WHERE n <= 4)"""
_SUB = f"{_SP}, k AS (SELECT list(DISTINCT taxon ORDER BY taxon) AS k FROM clades WHERE taxon % 3 = 0)"
_RES = f"""{_SUB}, cut AS (SELECT tree, list_filter(m, lambda x: list_contains(k, x)) AS c, weight, k FROM sp, k),
res AS (SELECT tree, CASE WHEN list_contains(c, k[1]) THEN c ELSE list_filter(k, lambda x: NOT list_contains(c, x)) END AS m, CAST(sum(weight) AS BIGINT) AS weight, any_value(k) AS k FROM cut WHERE len(c) BETWEEN 1 AND len(k) - 1 GROUP BY 1, 2)"""
_CLASH = "NOT (len(list_intersect(m, {0})) = len(m) OR len(list_intersect(m, {0})) = len({0}) OR len(m) + len({0}) - len(list_intersect(m, {0})) = len(k))"
_NODES = """tx AS (SELECT every FROM taxa), cl AS (SELECT DISTINCT m FROM (SELECT list_filter(every, lambda x: NOT list_contains(m, x)) AS m FROM {0}, tx UNION ALL SELECT [unnest(every)] FROM tx) WHERE len(m) >= 1),
nd AS (SELECT m, array_to_string(m, ',') AS node, len(m) AS leaves FROM cl) SELECT a.node, coalesce(arg_min(b.node, (b.leaves, b.node)), 'root') AS parent, a.leaves FROM nd a LEFT JOIN nd b ON b.leaves > a.leaves AND list_has_all(b.m, a.m) GROUP BY a.node, a.leaves"""
_FIRST = f"{_ALN}, one AS (SELECT 't' || taxon AS taxon, CAST(dense_rank() OVER (ORDER BY site) AS BIGINT) AS site, mask FROM aln WHERE part = 1) SELECT taxon, site, mask FROM one"
_PARTD = f"""{_ALN}, rk AS (SELECT *, CAST(dense_rank() OVER (ORDER BY taxon) - 1 AS INTEGER) AS t FROM aln),
pd AS (SELECT a.part, a.t AS t1, b.t AS t2, count(*) FILTER (bit_count(a.mask) = 1 AND bit_count(b.mask) = 1) AS total, count(*) FILTER (bit_count(a.mask) = 1 AND bit_count(b.mask) = 1 AND a.mask <> b.mask) AS diff FROM rk a JOIN rk b ON a.site = b.site AND a.t < b.t GROUP BY ALL),
dd AS (SELECT part, t1, t2, CASE WHEN total > 0 AND 1 - 4 * diff / (3 * total) > 0 THEN least(-0.75 * ln(1 - 4 * diff / (3 * total)), 9.0) ELSE 9.0 END AS d FROM pd)"""
_PRANK = "ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY taxon) - 1 AS INTEGER) AS t FROM aln)"
ORACLES = {
    "aln_by_characters": f"{_COLS} SELECT part, first_site, num_chars, row_number() OVER (ORDER BY num_chars DESC, first_site) AS place FROM pats",
    "aln_keep_frequent": f"{_COLS} SELECT part, first_site, freq FROM pats WHERE freq BETWEEN 2 AND 20",
    "aln_keep_residues": f"{_ALN}, rr AS (SELECT part, site, mask, sum(CASE WHEN mask <> 15 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY site) AS k FROM aln WHERE taxon = 3) SELECT aln.* FROM aln JOIN rr USING (part, site) WHERE rr.mask <> 15 AND k BETWEEN 11 AND 40",
    "aln_drop_identical": f"""{_ALN}, tw AS (SELECT * FROM aln UNION ALL SELECT taxon + 10, site, part, mask FROM aln WHERE taxon <= 3 UNION ALL SELECT taxon + 20, site, part, mask FROM aln WHERE taxon <= 2), s AS (SELECT taxon, list(mask ORDER BY part, site) AS q, count(*) AS cells FROM tw GROUP BY taxon),
n AS (SELECT taxon, cells, row_number() OVER (PARTITION BY q ORDER BY taxon) AS k FROM s) SELECT taxon, cells FROM n WHERE k <= 2""",
    "aln_drop_empty": f"{_ALN} SELECT taxon, count(*) AS cells FROM aln GROUP BY taxon HAVING count(*) FILTER (mask <> 15) > 0",
    "aln_keep_partitions": f"{_ALN} SELECT CASE WHEN part IN (0, 3) THEN 'kept' ELSE 'rest' END AS side, taxon, site, mask FROM aln",
    "aln_codon_frequencies": f"""{_ALN}, k AS (SELECT (row_number() OVER (PARTITION BY taxon, part ORDER BY site) - 1) % 3 AS p, mask FROM aln), n AS (SELECT p, mask, count(*) AS n FROM k WHERE bit_count(mask) = 1 GROUP BY ALL),
f AS (SELECT p, mask, n / sum(n) OVER (PARTITION BY p) AS f, sum(n) OVER (PARTITION BY mask) / sum(n) OVER () AS g FROM n), w(codon, a, b, c) AS (VALUES {", ".join(f"('{w}', {_BASE[w[0]]}, {_BASE[w[1]]}, {_BASE[w[2]]})" for w, _ in _CODONS)}),
v AS (SELECT codon, x.f * y.f * z.f AS v, x.g * y.g * z.g AS u FROM w JOIN f x ON x.p = 0 AND x.mask = a JOIN f y ON y.p = 1 AND y.mask = b JOIN f z ON z.p = 2 AND z.mask = c) SELECT codon, round(v / sum(v) OVER (), 6) AS share, round(u / sum(u) OVER (), 6) AS pooled FROM v""",
    "split_incompatible_between": f"{_SP}, t AS (SELECT DISTINCT tree FROM sp), c AS (SELECT DISTINCT a.tree AS t1, b.tree AS t2, a.m FROM sp a JOIN sp b ON a.tree <> b.tree WHERE {_CLASH2}) SELECT x.tree AS t1, y.tree AS t2, count(c.m) AS conflicts FROM t x JOIN t y ON x.tree <> y.tree LEFT JOIN c ON c.t1 = x.tree AND c.t2 = y.tree GROUP BY ALL",
    "split_branch_lengths": f"{_SP}, o AS (SELECT DISTINCT tree FROM sp WHERE tree <> 'click') SELECT array_to_string(a.m, ',') AS members, o.tree, a.weight AS own, b.weight FROM sp a, o LEFT JOIN sp b ON b.tree = o.tree AND b.m = a.m WHERE a.tree = 'click'",
    "pd_best_pair": f"{_SP}, w AS (SELECT m, max(weight) AS weight FROM sp GROUP BY m), tx AS (SELECT DISTINCT taxon FROM clades), p AS (SELECT a.taxon AS a, b.taxon AS b, CAST(sum(weight) FILTER (list_contains(m, a.taxon) <> list_contains(m, b.taxon)) AS BIGINT) AS pd FROM tx a JOIN tx b ON a.taxon < b.taxon, w GROUP BY ALL) SELECT a, b, coalesce(pd, 0) AS pd FROM p ORDER BY pd DESC NULLS LAST, a, b LIMIT 1",
    "tree_diameter": f"""{_UP}, dep AS (SELECT leaf, sum(brlen) AS d FROM path GROUP BY leaf), nd AS (SELECT up.node, sum(t.brlen) AS d FROM up JOIN tree t ON t.node = up.above GROUP BY up.node), i AS (SELECT leaf, node, d FROM path JOIN nd USING (node) WHERE leaf <> node),
m AS (SELECT x.leaf AS a, y.leaf AS b, max(x.d) AS d FROM i x JOIN i y ON x.node = y.node AND x.leaf < y.leaf GROUP BY ALL), e AS (SELECT p.leaf AS a, q.leaf AS b, round(p.d + q.d - 2 * coalesce(m.d, 0), 9) AS d FROM dep p JOIN dep q ON p.leaf < q.leaf LEFT JOIN m ON m.a = p.leaf AND m.b = q.leaf)
SELECT round(max(d), 6) AS diameter, first(a || ',' || b ORDER BY d DESC, a, b) AS pair, round(avg(d), 6) AS mean FROM e""",
    "tree_rf_adjacent": f"""{_SP}, n AS (SELECT tree, count(*) AS n, row_number() OVER (ORDER BY tree) AS k FROM sp GROUP BY tree), s AS (SELECT a.tree AS t1, b.tree AS t2, count(*) AS shared FROM sp a JOIN sp b ON a.m = b.m AND a.tree < b.tree GROUP BY ALL)
SELECT x.tree AS t1, y.tree AS t2, x.n + y.n - 2 * coalesce(shared, 0) AS rf, x.k + 1 = y.k AS adjacent, x.k <= 2 AS with_first_two FROM n x JOIN n y ON x.tree < y.tree LEFT JOIN s ON t1 = x.tree AND t2 = y.tree WHERE x.k + 1 = y.k OR x.k <= 2""",
    "parsimony_sankoff": _sankoff_sql(),
    "lik_ancestral": _ancestral_sql(),
    "boot_gene": f"WITH {CTE['ptnlh']}, b AS (SELECT *, CAST(ptn % 5 AS INTEGER) AS part, CAST(rp AS INTEGER) AS rep FROM ptnlh, range(1, 11) t(rp)) SELECT tree, rep, round(sum(({BY_GENE}) * freq * lnl), 3) AS by_gene, round(sum(({BY_GENE}) * ({BY_SITE}) * lnl), 3) AS by_site FROM b GROUP BY tree, rep",
    "prot_summary": f"{_PROT} SELECT part, CAST(sum(freq) AS BIGINT) AS sites, count(*) AS patterns, CAST(coalesce(sum(freq) FILTER (is_const), 0) AS BIGINT) AS constant, CAST(coalesce(sum(freq) FILTER (informative), 0) AS BIGINT) AS informative, CAST(coalesce(sum(freq) FILTER (NOT is_const), 0) AS BIGINT) AS variable FROM pats GROUP BY ROLLUP (part)",
    "prot_distance": f"""{_PROT}, k AS (SELECT site, shared <> 0 AS k FROM cols), {_PRANK}, d0 AS (SELECT a.t AS t1, b.t AS t2, count(*) FILTER (NOT k AND bit_count(a.mask) = 1 AND bit_count(b.mask) = 1 AND a.mask <> b.mask) AS diff,
  count(*) FILTER (k OR (bit_count(a.mask) = 1 AND bit_count(b.mask) = 1)) AS total FROM ranked a JOIN ranked b ON a.site = b.site AND a.t < b.t JOIN k ON k.site = a.site GROUP BY ALL), dd AS (SELECT t1, t2, CASE WHEN total > 0 THEN diff / total ELSE 9.0 END AS d FROM d0)
SELECT t1, t2, round(d, 6) AS d, round(CASE WHEN 1 - d * 20 / 19.0 > 0 THEN -ln(1 - d * 20 / 19.0) * 19 / 20.0 ELSE 9.0 END, 6) AS jc FROM dd""",
    "prot_composition": f"""WITH {CTE["protein"]}, n AS (SELECT taxon, {", ".join(f"count(*) FILTER (mask = {s}) AS n{s}" for s in _PSTATES)}, count(*) AS cells FROM aln GROUP BY taxon), o AS (SELECT *, {" + ".join(f"n{s}" for s in _PSTATES)} AS own FROM n),
a AS (SELECT {", ".join(f"sum(n{s}) AS a{s}" for s in _PSTATES)}, sum(own) AS a FROM o)
SELECT taxon, round({" + ".join(f"CASE WHEN a{s} > 0 THEN own * (a{s} / a - n{s} / own) * (a{s} / a - n{s} / own) / (a{s} / a) ELSE 0 END" for s in _PSTATES)}, 6) AS chi2,
CAST({" + ".join(f"CAST(a{s} > 0 AS INT)" for s in _PSTATES)} - 1 AS BIGINT) AS df, round(100 * (cells - own) / cells, 6) AS gap_percent FROM o, a WHERE own > 0""",
    "prot_likelihood": _poisson_sql(),
    "lik_site_rates": _site_rates_sql(),
    "aln_marginal_symmetry": f"""{_PAIRS}, i AS (SELECT t1, t2, CAST(log2(s1) AS INT) AS a, CAST(log2(s2) AS INT) AS b, n FROM pairs),
m AS (SELECT t1, t2, {", ".join(f"coalesce(sum(n) FILTER (a = {x} AND b = {y}), 0)::DOUBLE AS n{x}{y}" for x in range(4) for y in range(4))} FROM i GROUP BY t1, t2),
g AS (SELECT t1, t2, {", ".join(f"({' + '.join(f'n{x}{y}' for y in range(4))}) AS r{x}, ({' + '.join(f'n{y}{x}' for y in range(4))}) AS c{x}" for x in range(4))}, {", ".join(f"n{x}{y}" for x in range(4) for y in range(4))} FROM m),
v AS (SELECT t1, t2, {", ".join(f"r{x} - c{x} AS u{x}" for x in range(3))}, {", ".join(f"r{x} + c{x} - 2 * n{x}{x} AS v{x}{x}" for x in range(3))}, -(n01 + n10) AS v01, -(n02 + n20) AS v02, -(n12 + n21) AS v12 FROM g),
d AS (SELECT *, v00 * (v11 * v22 - v12 * v12) - v01 * (v01 * v22 - v12 * v02) + v02 * (v01 * v12 - v11 * v02) AS det FROM v)
SELECT t1, t2, round(CASE WHEN abs(det) > 1e-9 THEN (u0 * u0 * (v11 * v22 - v12 * v12) + u1 * u1 * (v00 * v22 - v02 * v02) + u2 * u2 * (v00 * v11 - v01 * v01)
  + 2 * u0 * u1 * (v02 * v12 - v01 * v22) + 2 * u0 * u2 * (v01 * v12 - v02 * v11) + 2 * u1 * u2 * (v01 * v02 - v00 * v12)) / det END, 4) AS stuart, 3 AS df FROM d""",
    "aln_add_constant": f"""{_COLS}, more AS (SELECT part, states, freq FROM pats UNION ALL {" UNION ALL ".join(f"SELECT 1, [CAST({s} AS INTEGER) FOR i IN range(7)], {k}" for s, k in CONSTANT.items())}),
g AS (SELECT part, states, CAST(sum(freq) AS BIGINT) AS freq FROM more GROUP BY part, states) SELECT part, {_LIST}, freq, {_STATS} FROM g""",
    "aln_keep_taxa": f"""{_ALN}, own AS (SELECT * FROM aln WHERE taxon IN ({", ".join(map(str, KEPT))})), s AS (SELECT part, site FROM own GROUP BY part, site HAVING count(*) FILTER (mask <> 15) >= {MIN_CHARS}),
p AS (SELECT part FROM own WHERE mask <> 15 GROUP BY part HAVING count(DISTINCT taxon) >= {MIN_TAXA}) SELECT own.part, own.site, own.taxon, own.mask FROM own JOIN s USING (part, site) JOIN p USING (part)""",
    "aln_supermatrix": f"WITH {CTE['pres']}, o AS (SELECT taxon, list(part ORDER BY part) AS p FROM pres GROUP BY taxon) SELECT taxon, len(p) AS parts, min(taxon) OVER (PARTITION BY p) AS pattern FROM o",
    "aln_copy_gaps": f"{_ALN} SELECT a.taxon, a.site, a.part, CASE WHEN b.mask = 15 THEN 15 ELSE a.mask END AS mask FROM aln a LEFT JOIN aln b ON b.site = a.site AND b.taxon % 7 + 1 = a.taxon",
    "aln_shuffled": f"{_COLS}, a AS (SELECT part, site, row_number() OVER (PARTITION BY part ORDER BY site) AS k, row_number() OVER (PARTITION BY part ORDER BY {SHUFFLE}, site) AS j FROM cols) SELECT x.part, x.site, y.site AS from_site FROM a x JOIN a y ON x.part = y.part AND x.k = y.j",
    "aln_multinomial_lnl": f"""{_COLS}, e AS (SELECT states, sum(freq) AS e FROM pats GROUP BY states), t AS (SELECT sum(freq) AS t FROM pats)
SELECT part, round(lgamma(CAST(sum(freq) + 1 AS DOUBLE)) + sum(freq * ln(e / t) - lgamma(CAST(freq + 1 AS DOUBLE))), 4) AS lnl FROM pats JOIN e USING (states), t GROUP BY part""",
    "aln_unseen_constant": f"{_COLS}, p2 AS (SELECT part, list_reduce(states, lambda a, b: a & b) AS c FROM pats WHERE freq > 1) SELECT DISTINCT p2.part, s.state FROM p2, (VALUES (1), (2), (4), (8)) s(state) WHERE NOT EXISTS (SELECT 1 FROM p2 x WHERE x.part = p2.part AND x.c = s.state)",
    "aln_expected_frequencies": _expected_sql(),
    "boot_rebuild": f"""{_COLS}, w AS (SELECT part, states, first_site, CAST(rep AS INTEGER) AS rep, (rep * 31 + first_site * 17) % 3 AS w FROM pats, range(1, 3) t(rep)),
u AS (SELECT *, sum(w) OVER (PARTITION BY rep, part ORDER BY first_site) AS upto FROM w) SELECT rep, part, CAST(unnest(range(CAST(upto - w + 1 AS BIGINT), CAST(upto + 1 AS BIGINT))) AS BIGINT) AS site, {_LIST} FROM u WHERE w > 0""",
    "parsimony_bounds": f"{_COLS} SELECT part, CAST(sum(freq * greatest(num_chars - 1, 0)) AS BIGINT) AS least, CAST(sum(freq * ({' + '.join(_N)} - greatest({', '.join(_N)}))) AS BIGINT) AS most FROM pats GROUP BY part",
    "dist_by_partition": f"{_PARTD} SELECT part, t1, t2, round(d, 6) AS d FROM dd",
    "report_alignment": f"""{_COLS}, s AS (SELECT coalesce(CAST(part AS VARCHAR), 'all') AS part, CAST(sum(freq) AS DOUBLE) AS sites, CAST(count(*) AS DOUBLE) AS patterns, CAST(coalesce(sum(freq) FILTER (is_const), 0) AS DOUBLE) AS constant,
CAST(coalesce(sum(freq) FILTER (informative), 0) AS DOUBLE) AS informative, CAST(coalesce(sum(freq) FILTER (NOT is_const), 0) AS DOUBLE) AS variable FROM pats GROUP BY ROLLUP (part))
SELECT 'partitions' AS section, part, item, value FROM (UNPIVOT s ON sites, patterns, constant, informative, variable INTO NAME item VALUE value)
UNION ALL SELECT 'cells', 'all', 'gaps', CAST(count(*) FILTER (mask = 15) AS DOUBLE) FROM aln UNION ALL SELECT 'cells', 'all', 'ambiguous', CAST(count(*) FILTER (mask <> 15 AND bit_count(mask) > 1) AS DOUBLE) FROM aln""",
    "split_branch_statistics": f"{_SP} SELECT array_to_string(m, ',') AS members, count(*) AS trees, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS sd, min(weight) AS low, max(weight) AS high FROM sp GROUP BY m",
    "split_restrict": f"{_RES} SELECT tree, array_to_string(m, ',') AS members, weight FROM res",
    "split_constraint": f"""{_RES}, c0 AS (SELECT *, list_filter(k, lambda x: x % 8 IN (0, 1)) AS x1, list_filter(k, lambda x: x % 2 = 0) AS x2 FROM res),
c AS (SELECT tree, m, k, CASE WHEN list_contains(x1, k[1]) THEN x1 ELSE list_filter(k, lambda x: NOT list_contains(x1, x)) END AS a, CASE WHEN list_contains(x2, k[1]) THEN x2 ELSE list_filter(k, lambda x: NOT list_contains(x2, x)) END AS b FROM c0)
SELECT tree, count(*) FILTER ({_CLASH.format("a")} OR {_CLASH.format("b")}) AS conflicts FROM c GROUP BY tree""",
    "split_circular": f"""{_SP}, o AS (SELECT taxon, row_number() OVER (ORDER BY taxon % 8, taxon) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT taxon FROM clades)),
b AS (SELECT tree, m, k, n, list_contains(m, taxon) AS i FROM sp, o) SELECT x.tree, array_to_string(x.m, ',') AS members, count(*) FILTER (x.i <> y.i) <= 2 AS circular FROM b x JOIN b y ON x.tree = y.tree AND x.m = y.m AND y.k = x.k % x.n + 1 GROUP BY x.tree, x.m""",
    "split_tree_nodes": f"{_SP}, own AS (SELECT m FROM sp WHERE tree = 'click'), {_NODES.format('own')}",
    "split_majority_tree": f"{_SP}, nt AS (SELECT count(DISTINCT tree) AS k FROM sp), own AS (SELECT m FROM sp, nt GROUP BY m, k HAVING count(*) > 0.5 * k), {_NODES.format('own')}",
    "tree_distances_from": f"""{_UP}, nd AS (SELECT up.node, sum(t.brlen) AS d FROM up JOIN tree t ON t.node = up.above GROUP BY up.node), me AS (SELECT above FROM up WHERE node = 's7'),
mt AS (SELECT up.node, max(nd.d) AS m FROM up JOIN me USING (above) JOIN nd ON nd.node = up.above GROUP BY up.node) SELECT nd.node, round(nd.d + (SELECT d FROM nd WHERE node = 's7') - 2 * coalesce(m, 0), 6) AS d FROM nd LEFT JOIN mt USING (node)""",
    "pd_random_sets": f"{_UP}, {_SETS} SELECT rep, leaf FROM sets",
    "pd_distribution": f"{_UP}, {_SETS}, h AS (SELECT DISTINCT rep, node, brlen FROM sets JOIN path USING (leaf)) SELECT rep, round(sum(brlen), 6) AS pd FROM h GROUP BY rep",
    "pd_taxa_frequency": f"WITH {CTE['pres']} SELECT 's' || taxon AS leaf, count(*) AS areas, CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS rank FROM pres GROUP BY taxon",
    "lik_partition": _partition_sql(), "lik_unrest": _lik(UNREST), "lik_error": _lik(ERROR), "lik_mixture": _mixture_sql(False), "lik_site_frequencies": _mixture_sql(True), "lik_site_lnl": _site_lnl_sql(),
    **{f"io_{k}": _FIRST for k in ("phylip", "fasta", "nexus", "clustal", "msf")},
    "io_distances": f"{_PARTD} SELECT t1, t2, round(d, 6) AS d FROM dd WHERE part = 0",
    "io_presence": f"WITH {CTE['pres']}, k AS (SELECT part, CAST(row_number() OVER (ORDER BY part) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT part FROM pres)) SELECT taxon, i AS part FROM pres JOIN k USING (part)",
    "io_newick": f"WITH {CTE['tree']} SELECT node, parent, round(brlen, 6) AS brlen FROM tree",
    "io_partitions": f"{_ALN} SELECT taxon, site, part, mask FROM aln WHERE site >= 1",
    "io_taxonomy": "SELECT CAST(r_regionkey + 1000 AS BIGINT) AS id, CAST(1 AS BIGINT) AS parent, 'region' AS rank, r_name AS name FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_regionkey + 1000 AS BIGINT), 'nation', n_name FROM nation",
    "io_dates": """WITH o AS (SELECT o_custkey AS c, strftime(min(o_orderdate), '%Y-%m-%d') AS a, strftime(max(o_orderdate), '%Y-%m-%d') AS b FROM orders GROUP BY o_custkey)
SELECT 'c' || c AS taxon, CASE WHEN c % 3 = 2 THEN NULL ELSE a END AS lower, CASE WHEN c % 3 = 0 THEN a ELSE b END AS upper FROM o""",
    "io_site_table": f"""{_COLS}, letters(s, l) AS (VALUES (1, 'A'), (2, 'C'), (4, 'G'), (8, 'T')), seen AS (SELECT part, site, string_agg(DISTINCT l, '' ORDER BY l) AS observed FROM aln JOIN letters ON mask = s GROUP BY part, site)
SELECT c.part, c.site, CASE WHEN is_const THEN 'C' WHEN informative THEN 'I' ELSE '-' END AS stat, coalesce(observed, '') AS observed FROM cols c JOIN pats USING (part, states) LEFT JOIN seen ON seen.part = c.part AND seen.site = c.site""",
}
