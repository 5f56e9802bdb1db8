"""Alignments as DataFrames (taxon, site, part, mask): masks are bit sets of compatible states, a gap is all of them.

Site columns, patterns and their classes come from one aggregation by site and one by pattern; both combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladeforge.sources.storage import written

#: Nucleotide symbols and the sets of states (A 1, C 2, G 4, T 8) they stand for; all else is a gap.
DNA = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "W": 9, "S": 6, "M": 3, "K": 12, "B": 14, "H": 11, "D": 13, "V": 7}
GAP, STATES = 15, (1, 2, 4, 8)


#: Amino acids in the order of states, and symbols that stand for two of them.
AMINO, AMINO_PAIRS = "ARNDCQEGHILKMFPSTWYV", {"B": "ND", "Z": "QE", "J": "IL"}
#: The symbols of each kind of sequence, with their sets of states.
ALPHABETS = {
    "DNA": DNA, "BIN": {"0": 1, "1": 2}, "AA": {c: 1 << i for i, c in enumerate(AMINO)} | {k: sum(1 << AMINO.index(c) for c in v) for k, v in AMINO_PAIRS.items()},
    "MORPH": {c: 1 << i for i, c in enumerate("0123456789ABCDEFGHIJ")},
}
STATES_OF = {"DNA": 4, "BIN": 2, "AA": 20, "MORPH": 20}


#: Letters of a sequence that are taken apart at once.
STRETCH = 4096


def gap_of(n_states: int) -> int:
    """The mask of a cell that may be any state."""
    return (1 << n_states) - 1


def encode(sequences: DataFrame, taxon: str = "taxon", seq: str = "seq", kind: str = "DNA") -> DataFrame:
    """(taxon, site, mask) of sequences of a kind (DNA, AA, BIN, MORPH), sites from 1; symbols in either case, unknown ones gaps. A long sequence is dealt out in stretches."""
    codes = F.create_map(*(x for k, v in ALPHABETS[kind].items() for x in (F.lit(k), F.lit(v))))
    pieces = sequences.select(taxon, F.posexplode(F.regexp_extract_all(F.upper(seq), F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))).alias("__k", "__piece")).repartition(taxon, "__k")
    cells = pieces.select(taxon, "__k", F.posexplode(F.split("__piece", "")).alias("pos", "c")).where("c <> ''")
    return cells.select(taxon, (F.col("__k").cast("long") * STRETCH + F.col("pos") + 1).alias("site"), F.coalesce(F.element_at(codes, F.col("c")), F.lit(gap_of(STATES_OF[kind]))).alias("mask"))


def columns(aln: DataFrame) -> DataFrame:
    """(part, site, states): each site's masks in the order of taxa. A table that has states already is taken as it is."""
    if "states" in aln.columns:
        return aln.select("part", "site", "states")
    return aln.groupBy("part", "site").agg(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "mask"))), lambda x: x["mask"]).alias("states"))


def single(mask: Column) -> Column:
    return F.bit_count(mask) == 1


def classified(cols: DataFrame, n_states: int = 4) -> DataFrame:
    """Adds is_const (the masks share a state), informative (two unambiguous states seen twice), num_chars and const_state (a mask)."""
    shared = F.aggregate("states", F.lit(gap_of(n_states)), lambda a, x: a.bitwiseAND(x))
    seen = F.expr("array_sort(filter(states, x -> bit_count(x) = 1))")
    out = cols.withColumn("__seen", seen)
    twice = F.expr("array_distinct(filter(__seen, (x, i) -> i > 0 AND __seen[i - 1] = x))")
    return out.select(
        *cols.columns, (shared != 0).alias("is_const"), shared.alias("const_state"), (F.size(twice) >= 2).alias("informative"), F.size(F.array_distinct("__seen")).cast("long").alias("num_chars")
    )


def patterns(aln: DataFrame, by: tuple[str, ...] = ("part",), n_states: int = 4) -> DataFrame:
    """Distinct columns: (part, states, freq, first_site) and their classes."""
    p = columns(aln).groupBy(*by, "states").agg(F.count("*").alias("freq"), F.min("site").alias("first_site"))
    return classified(p, n_states)


def ranked(df: DataFrame, by: list[str], key: str, name: str, buckets: int = 1024) -> DataFrame:
    """Adds `name`: the place of each row by an integer column in its group, from 1, ties in any order.

    Rows are numbered in buckets of the key's range, and a bucket starts where those before it end, so that one group is many tasks' work. The table is read three times, so
    it is written to the shared folder first."""
    df = written(df, "ranked")
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    cut = df.join(F.broadcast(span)).withColumn("__b", F.expr(f"CAST(({key} - lo) * {buckets}D / (hi - lo + 1) AS INT)")).drop("lo", "hi")  # one row
    size = cut.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = size.withColumn("__before", F.sum("__n").over(W.partitionBy(*by).orderBy("__b")) - F.col("__n")).drop("__n")
    own = F.row_number().over(W.partitionBy(*by, "__b").orderBy(key))
    return cut.withColumn("__k", own).join(before, [*by, "__b"]).withColumn(name, F.col("__before") + F.col("__k")).drop("__b", "__k", "__before")


def numbered(pats: DataFrame) -> DataFrame:
    """Adds ptn, counting by first appearance within each partition."""
    return ranked(pats, ["part"], "first_site", "ptn").withColumn("ptn", F.col("ptn") - 1)


def partition_summary(aln: DataFrame, n_states: int = 4) -> DataFrame:
    """Sites, patterns, constant, informative and variable sites of each partition, and of all (part null)."""
    p = patterns(aln, n_states=n_states)
    total = lambda c: F.sum(F.when(c, F.col("freq")).otherwise(0))
    return p.rollup("part").agg(
        F.sum("freq").alias("sites"), F.count("*").alias("patterns"), total(F.col("is_const")).alias("constant"), total(F.col("informative")).alias("informative"),
        total(~F.col("is_const")).alias("variable"),
    )


def site_gaps(aln: DataFrame) -> DataFrame:
    return aln.groupBy("part", "site").agg(F.sum((F.col("mask") == GAP).cast("long")).alias("gaps"), F.sum(((F.col("mask") != GAP) & ~single(F.col("mask"))).cast("long")).alias("ambiguous"))


def sequence_frequencies(aln: DataFrame) -> DataFrame:
    """(taxon, state, n, share) over unambiguous cells."""
    n = aln.where(single(F.col("mask"))).groupBy("taxon", F.col("mask").alias("state")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("taxon")))


def composition_test(aln: DataFrame, n_states: int = 4) -> DataFrame:
    """Per taxon chi2 = N sum (f_j - f_tj)^2 / f_j against the alignment's frequencies, its df, and the percentage of gaps or ambiguity."""
    STATES = tuple(1 << i for i in range(n_states))  # noqa: N806
    n = aln.groupBy("taxon").agg(*(F.sum((F.col("mask") == s).cast("long")).alias(f"n{s}") for s in STATES), F.count("*").alias("cells"))
    own = sum(F.col(f"n{s}") for s in STATES)
    whole = n.agg(*(F.sum(f"n{s}").alias(f"a{s}") for s in STATES))
    n = n.withColumn("own", own).join(F.broadcast(whole))  # one row
    every = sum(F.col(f"a{s}") for s in STATES)
    f = lambda s: F.col(f"a{s}") / every
    chi2 = sum(F.when(F.col(f"a{s}") > 0, F.col("own") * (f(s) - F.col(f"n{s}") / F.col("own")) ** 2 / f(s)).otherwise(0.0) for s in STATES)
    df = sum((F.col(f"a{s}") > 0).cast("long") for s in STATES) - 1
    return n.where("own > 0").select("taxon", chi2.alias("chi2"), df.alias("df"), (100 * (F.col("cells") - F.col("own")) / F.col("cells")).alias("gap_percent"))


def empirical_frequencies(aln: DataFrame, rounds: int = 8) -> DataFrame:
    """(f1, f2, f4, f8): frequencies with each ambiguity dealt over its states in proportion to the last estimate, `rounds` times from 1/4.

    The masks are counted first; the rounds are one fold over that row of 15 numbers."""
    counts = aln.groupBy("mask").agg(F.count("*").alias("n"))  # 15 rows at most
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct("mask", "n"))).alias("m"))
    row = row.select(F.expr("transform(sequence(1, 15), k -> CAST(coalesce(element_at(m, k), 0) AS DOUBLE))").alias("c"))
    whole = [f"aggregate(sequence(0, 3), 0D, (t, j) -> t + if((k & shiftleft(1, j)) <> 0, f[j], 0D))", "aggregate(sequence(1, 15), 0D, (g, k) -> g + if((k & shiftleft(1, i)) <> 0, c[k - 1] * f[i] / {0}, 0D))"]
    deal = f"transform(sequence(0, 3), i -> {whole[1].format(whole[0])})"
    scaled = f"transform(array({deal}), g -> transform(g, x -> x / aggregate(g, 0D, (a, y) -> a + y)))[0]"
    row = row.select(F.expr(f"aggregate(sequence(1, {rounds}), array(0.25D, 0.25D, 0.25D, 0.25D), (f, r) -> {scaled})").alias("f"))
    return row.select(*(F.col("f")[i].alias(f"f{s}") for i, s in enumerate(STATES)))


def unconstrained_lnl(pats: DataFrame) -> DataFrame:
    """Sum of f ln(f / N) over patterns, by partition."""
    n = pats.withColumn("all", F.sum("freq").over(W.partitionBy("part")))
    return n.groupBy("part").agg(F.sum(F.col("freq") * F.log(F.col("freq") / F.col("all"))).alias("lnl"))


def pair_counts(aln: DataFrame) -> DataFrame:
    """(t1, t2, s1, s2, n): unambiguous state pairs of two taxa at one site, t1 < t2; counted on patterns."""
    pats = patterns(aln)
    pairs = F.expr("flatten(transform(states, (a, i) -> transform(filter(transform(states, (b, j) -> struct(i AS i, j AS j, a AS a, b AS b)), x -> x.j > x.i AND bit_count(x.a) = 1 AND bit_count(x.b) = 1), x -> x)))")
    return pats.select("freq", F.explode(pairs).alias("x")).groupBy(F.col("x.i").alias("t1"), F.col("x.j").alias("t2"), F.col("x.a").alias("s1"), F.col("x.b").alias("s2")).agg(F.sum("freq").alias("n"))


def symmetry_test(pairs: DataFrame) -> DataFrame:
    """(t1, t2, symmetry, df): sum (n_ij - n_ji)^2 / (n_ij + n_ji) over state pairs that occur."""
    off = pairs.where("s1 <> s2").select("t1", "t2", F.least("s1", "s2").alias("lo"), F.greatest("s1", "s2").alias("hi"), F.when(F.col("s1") < F.col("s2"), F.col("n")).otherwise(-F.col("n")).alias("d"), "n")
    cell = off.groupBy("t1", "t2", "lo", "hi").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return cell.groupBy("t1", "t2").agg(F.sum(F.col("d") * F.col("d") / F.col("n")).alias("symmetry"), F.count("*").alias("df"))


def divergence(pairs: DataFrame) -> DataFrame:
    """(s1, s2, share): symmetrised state-pair counts, each row scaled to sum 1."""
    both = pairs.select("s1", "s2", "n").unionByName(pairs.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "n")).groupBy("s1", "s2").agg(F.sum("n").alias("n"))
    return both.select("s1", "s2", (F.col("n") / F.sum("n").over(W.partitionBy("s1"))).alias("share"))


def missing_fraction(aln: DataFrame) -> DataFrame:
    """1 - sum over partitions of (sequences with data * sites) / (sequences * sites)."""
    per = aln.groupBy("part", "taxon").agg(F.max((F.col("mask") != GAP).cast("long")).alias("has"), F.count("*").alias("sites")).groupBy("part").agg(F.sum("has").alias("nseq"), F.max("sites").alias("nsite"), F.count("*").alias("taxa"))
    return per.agg((1 - F.sum(F.col("nseq") * F.col("nsite")) / (F.max("taxa") * F.sum("nsite"))).alias("missing"))


def drop_sites(aln: DataFrame, gappy: bool = False, constant: bool = False, uninformative: bool = False) -> DataFrame:
    """The alignment without sites that have a gap or ambiguity, are constant, or are uninformative."""
    c = classified(columns(aln))
    keep = F.lit(True)
    if gappy:
        keep &= ~F.exists("states", lambda x: F.bit_count(x) != 1)
    if constant:
        keep &= ~F.col("is_const")
    if uninformative:
        keep &= F.col("informative")
    return aln.join(c.where(keep).select("part", "site"), ["part", "site"], "left_semi")


def site_ranges(spec: str, last: int) -> list[tuple[int, int, int]]:
    """(lower, upper, step) of a specification like `1-99\\3, 200-.`: positions from 1, both ends included, `.` the last."""
    out = []
    for item in spec.replace(",", " ").split():
        body, _, step = item.partition("\\")
        lo, _, hi = body.partition("-")
        at = lambda x: last if x == "." else int(x)
        low, high = at(lo), at(hi or lo)
        if not 1 <= low <= high <= last:
            raise ValueError(f"site range {item!r} is not within 1-{last}")
        out.append((low, high, int(step or 1)))
    return out


def select_sites(aln: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    hit = F.lit(False)
    for lo, hi, step in ranges:
        hit |= F.col("site").between(lo, hi) & ((F.col("site") - lo) % step == 0)
    return aln.where(hit)


def residues(aln: DataFrame) -> DataFrame:
    """Adds residue: the number of the taxon's non-gap cells up to this one (null at gaps)."""
    n = F.sum((F.col("mask") != GAP).cast("long")).over(W.partitionBy("taxon", "part").orderBy("site"))
    return aln.withColumn("residue", F.when(F.col("mask") != GAP, n))


def identical_sequences(aln: DataFrame) -> DataFrame:
    """(taxon, kept_as): each taxon and the first taxon that has its sequence. Sequences are told by their length and two sums of hashes of their cells, so
    none is put together."""
    own = lambda salt: F.sum(F.xxhash64("part", "site", "mask", F.lit(salt)).cast("decimal(38,0)"))
    seq = aln.groupBy("taxon").agg(F.count("*").alias("n"), own(1).alias("a"), own(2).alias("b"))
    return seq.select("taxon", F.min("taxon").over(W.partitionBy("n", "a", "b")).alias("kept_as"))


def concatenate(parts: DataFrame) -> DataFrame:
    """Partitions one after the other: adds position, counting sites from 1 over (part, site)."""
    sites = parts.select("part", "site").distinct()
    size = sites.groupBy("part").agg(F.count("*").alias("n"))
    start = size.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for each partition
    place = ranked(sites, ["part"], "site", "k").join(start, "part").select("part", "site", (F.col("start") + F.col("k")).alias("position"))
    return parts.join(place, ["part", "site"])


def consensus(aln: DataFrame) -> DataFrame:
    """(part, site, state): the commonest unambiguous state of each site, the smallest of several; null if there is none."""
    if "states" in aln.columns:  # a site is a row already
        none, more = ", ".join(f"0 AS n{x}" for x in STATES), ", ".join(f"a.n{x} + if(x = {x}, 1, 0) AS n{x}" for x in STATES)
        kinds = ", ".join(f"struct(a.n{x} * 16 - {x} AS w, {x} AS s)" for x in STATES)
        # the states are named once: Spark makes an array anew wherever it is named
        best = F.expr(f"aggregate(states, struct({none}), (a, x) -> struct({more}), a -> array_max(filter(array({kinds}), c -> c.w > 0)))")
        return aln.select("part", "site", best["s"].alias("state"))
    n = aln.groupBy("part", "site", F.when(single(F.col("mask")), F.col("mask")).alias("s")).agg(F.count("*").alias("n"))
    return n.groupBy("part", "site").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("n") * 16 - F.col("s"))).alias("state"))


#: The standard genetic code over T, C, A, G in this order, the first base slowest.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(aln: DataFrame) -> DataFrame:
    """(taxon, part, codon, aa): triplets of neighbouring sites (in order, from the first) as amino acids; `X` where a base is ambiguous."""
    k = F.row_number().over(W.partitionBy("taxon", "part").orderBy("site")) - 1
    digit = F.when(F.col("mask") == 8, 0).when(F.col("mask") == 2, 1).when(F.col("mask") == 1, 2).when(F.col("mask") == 4, 3)
    rows = aln.withColumn("k", k).select("taxon", "part", F.expr("k div 3").alias("codon"), (F.col("k") % 3).alias("p"), digit.alias("d"))
    index = F.sum(F.col("d") * F.pow(F.lit(4), 2 - F.col("p"))).cast("int")
    out = rows.groupBy("taxon", "part", "codon").agg(index.alias("i"), F.count("d").alias("n"), F.count("*").alias("all")).where("all = 3")
    return out.select("taxon", "part", "codon", F.when(F.col("n") == 3, F.substring(F.lit(CODE), F.col("i") + 1, F.lit(1))).otherwise("X").alias("aa"))


def observed_distance(aln: DataFrame, n_states: int = 4) -> DataFrame:
    """(t1, t2, d): differing sites over sites that are constant or unambiguous in both; 9.0 without any. t1 < t2 count taxa from 0."""
    pats = patterns(aln, n_states=n_states)
    pair = F.expr("flatten(transform(states, (a, i) -> transform(filter(transform(states, (b, j) -> struct(i AS i, j AS j, a AS a, b AS b)), x -> x.j > x.i), x -> x)))")
    x = pats.select("freq", "is_const", F.explode(pair).alias("x"))
    both = (F.bit_count("x.a") == 1) & (F.bit_count("x.b") == 1)
    out = x.groupBy(F.col("x.i").alias("t1"), F.col("x.j").alias("t2")).agg(
        F.sum(F.when(~F.col("is_const") & both & (F.col("x.a") != F.col("x.b")), F.col("freq")).otherwise(0)).alias("diff"), F.sum(F.when(F.col("is_const") | both, F.col("freq")).otherwise(0)).alias("total")
    )
    return out.select("t1", "t2", F.when(F.col("total") > 0, F.col("diff") / F.col("total")).otherwise(9.0).alias("d"))


def jc_distance(observed: DataFrame, n_states: int = 4) -> DataFrame:
    z = n_states / (n_states - 1)
    left = 1 - z * F.col("d")
    return observed.withColumn("jc", F.when(left > 0, -F.log(F.when(left > 0, left)) / z).otherwise(9.0))


def distance_variance(dist: DataFrame, d: str = "d") -> DataFrame:
    """Adds the variance of each scheme: ols 1, wls first order d, Fitch-Margoliash d^2."""
    return dist.select("*", F.lit(1.0).alias("ols"), F.col(d).alias("wls1"), (F.col(d) * F.col(d)).alias("fm"))


def marginal_symmetry(pairs: DataFrame) -> DataFrame:
    """(t1, t2, stuart, df, p_marginal): Stuart's test of marginal symmetry, U' V^-1 U with one state left out; null where V is singular."""

    def test(frame):
        import numpy as np
        import pandas as pd

        from cladeforge.functions.numerics import chi2_sf

        n = np.zeros((4, 4))
        for a, b, k in zip(frame["s1"], frame["s2"], frame["n"], strict=True):
            n[int(a).bit_length() - 1, int(b).bit_length() - 1] += k
        u = (n.sum(1) - n.sum(0))[:3]
        v = -(n + n.T)[:3, :3]
        np.fill_diagonal(v, (n.sum(1) + n.sum(0) - 2 * np.diag(n))[:3])
        ok = np.linalg.matrix_rank(v) == 3
        s = float(u @ np.linalg.solve(v, u)) if ok else None
        return pd.DataFrame({"t1": frame["t1"].iloc[:1], "t2": frame["t2"].iloc[:1], "stuart": [s], "df": [3], "p_marginal": [float(chi2_sf(s, 3)[0]) if ok else None]})

    return pairs.groupBy("t1", "t2").applyInPandas(test, "t1 int, t2 int, stuart double, df int, p_marginal double")


def codon_position_frequencies(aln: DataFrame) -> DataFrame:
    """(position, state, share): base frequencies at each codon position (F3x4), and pooled (position null, F1x4), over unambiguous cells."""
    k = F.row_number().over(W.partitionBy("taxon", "part").orderBy("site")) - 1
    n = aln.withColumn("position", (k % 3).cast("int")).where(single(F.col("mask"))).groupBy("position", F.col("mask").alias("state")).agg(F.count("*").alias("n"))
    pooled = n.groupBy("state").agg(F.sum("n").alias("n")).select(F.lit(None).cast("int").alias("position"), "state", "n")
    return n.unionByName(pooled).select("position", "state", (F.col("n") / F.sum("n").over(W.partitionBy("position"))).alias("share"))


def clade_identity(pats: DataFrame, clades: list[list[int]]) -> DataFrame:
    """(clade, identity): percent of sites (whole number, rounded down) at which the unambiguous states of a clade's taxa (their places) agree."""
    agree = [F.bit_count(F.aggregate(F.array(*(F.element_at("states", i + 1) for i in c)), F.lit(0), lambda a, x: F.when(F.bit_count(x) == 1, a.bitwiseOR(x)).otherwise(a))) <= 1 for c in clades]
    row = pats.agg(F.sum("freq").alias("all"), *(F.sum(F.when(a, F.col("freq")).otherwise(0)).alias(f"c{i}") for i, a in enumerate(agree)))
    return row.select("all", F.posexplode(F.array(*(f"c{i}" for i in range(len(clades))))).alias("clade", "n")).select("clade", F.floor(100 * F.col("n") / F.col("all")).alias("identity"))


def add_constant(pats: DataFrame, counts: dict[int, int], part: int) -> DataFrame:
    """Patterns (part, states, freq, first_site) with so many more sites of each constant state (a mask) in one partition; new ones come after all sites."""
    own = pats.select("part", "states", "freq", "first_site")
    taxa = own.agg(F.max(F.size("states")).alias("n"), F.max("first_site").alias("last"))
    new = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(k).cast("long").alias("k")) for s, k in counts.items()))
    more = taxa.select("n", "last", F.explode(new).alias("c")).where("c.k > 0")
    more = more.select(F.lit(part).alias("part"), F.expr("array_repeat(c.s, n)").alias("states"), F.col("c.k").alias("freq"), (F.col("last") + 1).alias("first_site"))
    both = own.unionByName(more).groupBy("part", "states").agg(F.sum("freq").alias("freq"), F.min("first_site").alias("first_site"))
    return classified(both)


def keep_taxa(aln: DataFrame, taxa: DataFrame, min_taxa: int = 1, min_chars: int = 0) -> DataFrame:
    """The cells of the given taxa: sites with at least `min_chars` cells that are no gaps, in partitions where at least `min_taxa` taxa have data."""
    own = aln.join(taxa.select("taxon").distinct(), "taxon", "left_semi")
    data = (F.col("mask") != GAP).cast("long")
    site = own.groupBy("part", "site").agg(F.sum(data).alias("n")).where(F.col("n") >= min_chars).select("part", "site")
    part = own.where(F.col("mask") != GAP).groupBy("part").agg(F.countDistinct("taxon").alias("n")).where(F.col("n") >= min_taxa).select("part")
    return own.join(part, "part", "left_semi").join(site, ["part", "site"], "left_semi")


def supermatrix(presence: DataFrame) -> DataFrame:
    """(taxon, parts, pattern): of (taxon, part) the union of taxa, how many partitions each is in, and which taxon first has the same ones."""
    own = presence.distinct().groupBy("taxon").agg(F.array_sort(F.collect_list("part")).alias("p"))
    return own.select("taxon", F.size("p").cast("long").alias("parts"), F.min("taxon").over(W.partitionBy("p")).alias("pattern"))


def copy_gaps(aln: DataFrame, other: DataFrame) -> DataFrame:
    """`aln` with gaps wherever the other alignment has one at the same taxon and site."""
    gaps = other.where(F.col("mask") == GAP).select("taxon", "site", F.lit(True).alias("__gap")).distinct()
    return aln.join(gaps, ["taxon", "site"], "left").withColumn("mask", F.when(F.col("__gap"), GAP).otherwise(F.col("mask"))).drop("__gap")


def shuffled(cols: DataFrame, order: str) -> DataFrame:
    """(part, site, from_site): a permutation of each partition's sites: those ordered by `order` (SQL, a whole number, then by site) take the places of
    those in order."""
    keyed = cols.select("part", "site").withColumn("__o", F.expr(order).cast("long"))
    own = ranked(keyed.withColumn("__o", F.col("__o") * 2**31 + F.col("site")), ["part"], "__o", "k").select("part", "k", F.col("site").alias("from_site"))
    return ranked(cols.select("part", "site"), ["part"], "site", "k").join(own, ["part", "k"]).select("part", "site", "from_site")


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers: a sum of logarithms up to 20, Stirling's series beyond (its error is below 1e-12 there)."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(20)) + 1), F.lit(0.0), lambda a, i: a + F.when(i <= n, F.log(i.cast("double"))).otherwise(0.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.lit(3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, small).otherwise(series)


def multinomial_lnl(pats: DataFrame, expected: DataFrame) -> DataFrame:
    """(part, lnl): ln N! - sum ln n! + sum n ln p of each partition's patterns, p being their shares in `expected` (states, freq); null where a
    pattern is not expected at all."""
    share = expected.groupBy("states").agg(F.sum("freq").alias("e"))
    every = share.agg(F.sum("e").alias("all"))
    x = pats.select("part", "states", "freq").join(share, "states", "left").join(F.broadcast(every))  # one row
    own = F.col("freq") * F.log(F.col("e") / F.col("all")) - log_factorial(F.col("freq"))
    n = x.groupBy("part").agg(F.sum("freq").alias("n"), F.sum(own).alias("s"), F.max(F.col("e").isNull()).alias("none"))
    return n.select("part", F.when(~F.col("none"), log_factorial(F.col("n")) + F.col("s")).alias("lnl"))


def unseen_constant(pats: DataFrame) -> DataFrame:
    """(part, state): the constant states without a site in a partition, which a correction for unobserved patterns adds."""
    each = pats.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, STATES))).alias("state"))
    seen = pats.where("is_const").where(single(F.col("const_state"))).select("part", F.col("const_state").alias("state"))
    return each.join(seen, ["part", "state"], "left_anti")


def expected_frequencies(scored: DataFrame) -> DataFrame:
    """Adds expected: each pattern's likelihood times the sites of its partition."""
    return scored.withColumn("expected", F.exp("lnl") * F.sum("freq").over(W.partitionBy("part")))


def rebuild(pats: DataFrame, counts: DataFrame) -> DataFrame:
    """(rep, part, site, states): alignments of (rep, part, first_site, w): each pattern w times, in the order of their first sites, sites from 1."""
    own = pats.join(counts.where("w > 0"), ["part", "first_site"])
    upto = F.sum("w").over(W.partitionBy("rep", "part").orderBy("first_site"))
    placed = own.withColumn("__end", upto)
    return placed.select("rep", "part", F.explode(F.expr("sequence(__end - w + 1, __end)")).alias("site"), "states")


def parsimony_bounds(pats: DataFrame) -> DataFrame:
    """(part, least, most): the fewest changes any tree can need (states less one) and the most (taxa less the commonest state), over unambiguous cells."""
    n = [F.size(F.expr(f"filter(states, x -> x = {s})")) for s in STATES]
    most = sum(n[1:], n[0]) - F.greatest(*n)
    least = F.greatest(F.col("num_chars") - 1, F.lit(0))
    return pats.groupBy("part").agg(F.sum(F.col("freq") * least).alias("least"), F.sum(F.col("freq") * most).alias("most"))


def part_distances(pats: DataFrame, weight: str = "freq", by: str = "part") -> DataFrame:
    """(by, t1, t2, d): JC distances of unambiguous pairs in each group of weighted patterns; 9 where they are saturated or there are none."""
    pair = F.expr("flatten(transform(states, (a, i) -> transform(filter(transform(states, (b, j) -> struct(i AS i, j AS j, a AS a, b AS b)), x -> x.j > x.i), x -> x)))")
    x = pats.select(by, F.col(weight).alias("w"), F.explode(pair).alias("x"))
    both = (F.bit_count("x.a") == 1) & (F.bit_count("x.b") == 1)
    out = x.groupBy(by, F.col("x.i").alias("t1"), F.col("x.j").alias("t2")).agg(F.sum(F.when(both & (F.col("x.a") != F.col("x.b")), F.col("w")).otherwise(0)).alias("diff"), F.sum(F.when(both, F.col("w")).otherwise(0)).alias("total"))
    left = 1 - 4 * F.col("diff") / (3 * F.col("total"))
    return out.select(by, "t1", "t2", F.when((F.col("total") > 0) & (left > 0), F.least(-0.75 * F.log(F.when(left > 0, left)), F.lit(9.0))).otherwise(9.0).alias("d"))


def by_characters(pats: DataFrame) -> DataFrame:
    """Adds place: patterns from the most to the fewest different unambiguous states, then by first site, from 1; numbered by count of states first, so that the order needs no
    single task."""
    size = pats.groupBy("num_chars").agg(F.count("*").alias("__n"))
    start = size.select("num_chars", (F.sum("__n").over(W.orderBy(F.col("num_chars").desc())) - F.col("__n")).alias("__start"))  # a row for each count
    return ranked(pats, ["num_chars"], "first_site", "place").join(start, "num_chars").withColumn("place", F.col("__start") + F.col("place")).drop("__start")


def keep_frequent(pats: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Patterns that stand at `least` to `most` sites."""
    return pats.where((F.col("freq") >= least) & (F.lit(most is None) | (F.col("freq") <= F.lit(most or 0))))


def keep_residues(aln: DataFrame, taxon, first: int, last: int) -> DataFrame:
    """The sites at which a taxon's own residues `first` to `last` stand, its gaps left out; in each partition."""
    own = residues(aln.where(F.col("taxon") == taxon)).where(F.col("residue").between(first, last)).select("part", "site")
    return aln.join(own, ["part", "site"], "left_semi")


def drop_identical(aln: DataFrame, kept: int = 2) -> DataFrame:
    """The alignment with `kept` of each group of identical sequences, the first by name."""
    same = identical_sequences(aln).withColumn("n", F.row_number().over(W.partitionBy("kept_as").orderBy("taxon")))
    return aln.join(F.broadcast(same.where(F.col("n") <= kept).select("taxon")), "taxon", "left_semi")  # names of taxa


def drop_empty(aln: DataFrame, n_states: int = 4) -> DataFrame:
    """The alignment without taxa that are gaps only."""
    return aln.join(aln.where(F.col("mask") != gap_of(n_states)).select("taxon").distinct(), "taxon", "left_semi")


def keep_partitions(aln: DataFrame, parts: list[int], remove: bool = False) -> DataFrame:
    """The given partitions, or all others."""
    inside = F.col("part").isin(parts)
    return aln.where(~inside if remove else inside)


def codon_frequencies(aln: DataFrame, per_position: bool = True) -> DataFrame:
    """(codon, share): sense codons' frequencies as products of base frequencies, at each codon position (F3x4) or pooled (F1x4), scaled to sum 1."""
    f = codon_position_frequencies(aln)
    f = f.where("position IS NOT NULL") if per_position else f.where("position IS NULL").select(F.explode(F.array(*map(F.lit, range(3)))).alias("position"), "state", "share")
    m = f.agg(F.map_from_entries(F.collect_list(F.struct((F.col("position") * 16 + F.col("state")).alias("k"), "share"))).alias("m"))  # twelve numbers
    order = {"T": 8, "C": 2, "A": 1, "G": 4}
    words = [a + b + c for a in order for b in order for c in order]
    rows = F.array(*(F.struct(F.lit(w).alias("codon"), *(F.lit(16 * i + order[x]).alias(f"k{i}") for i, x in enumerate(w))) for w, aa in zip(words, CODE, strict=True) if aa != "*"))
    get = lambda i: F.coalesce(F.element_at("m", F.col(f"c.k{i}")), F.lit(0.0))
    out = m.select("m", F.explode(rows).alias("c")).select("c.codon", (get(0) * get(1) * get(2)).alias("v"))
    return out.select("codon", (F.col("v") / F.sum("v").over(W.partitionBy())).alias("share"))  # 61 rows
