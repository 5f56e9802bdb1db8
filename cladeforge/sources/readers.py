"""Readers of sequence, tree, partition and matrix files: text in, DataFrames out. Compressed files are read by their extension."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.operators.alignment import site_ranges


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def _parse(files: DataFrame, parser, schema: str) -> DataFrame:
    """A row set for each file; a file is one alignment or tree set, so it is one task's."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames):
        import pandas as pd

        for f in frames:
            for name, text in zip(f["file"], f["value"], strict=True):
                yield pd.DataFrame([(name, *row) for row in parser(text)], columns=["file", *names])

    return files.mapInPandas(run, f"file string, {schema}")


def parse_phylip(text: str) -> list[tuple[str, str]]:
    """Interleaved or sequential: by the header's number of sites."""
    lines = [x for x in text.splitlines() if x.strip()]
    n, sites = map(int, lines[0].split()[:2])
    body = lines[1:]
    names, seqs = [], []
    if len(body) >= n and all(len(x.split(None, 1)) == 2 for x in body[:n]):
        names = [x.split(None, 1)[0] for x in body[:n]]
        seqs = ["".join(re.sub(r"\s", "", x) for x in [body[i].split(None, 1)[1], *body[n + i :: n]]) for i in range(n)]
    if not seqs or any(len(s) != sites for s in seqs):  # sequential: a record may span lines
        names, own, size = [], [], sites
        for x in body:
            if not own or size >= sites:
                name, _, x = x.strip().partition(" ")
                names.append(name)
                own.append([])
                size = 0
            own[-1].append(re.sub(r"\s", "", x))
            size += len(own[-1][-1])
        seqs = ["".join(v) for v in own]
    _check(names, seqs, sites)
    return list(zip(names, map(str.upper, seqs), strict=True))


def _check(names: list[str], seqs: list[str], sites: int | None = None) -> None:
    if len(set(names)) < len(names):
        raise ValueError("a sequence name occurs twice")
    if len({len(s) for s in seqs} | ({sites} if sites is not None and seqs else set())) > 1:
        raise ValueError("sequences differ in length")


def parse_fasta(text: str) -> list[tuple[str, str]]:
    out = []
    for record in re.split(r"(?m)^>", text)[1:]:
        head, _, body = record.partition("\n")
        out.append((head.strip(), re.sub(r"\s", "", body).upper()))
    short = [h.split()[0] if h else "" for h, _ in out]
    names = short if len(set(short)) == len(short) else [re.sub(r"\s+", "_", h) for h, _ in out]
    _check(names, [s for _, s in out])
    return list(zip(names, [s for _, s in out], strict=True))


def parse_nexus_data(text: str) -> list[tuple[str, str]]:
    m = re.search(r"(?is)\bmatrix\b(.*?);", re.sub(r"\[[^\]]*\]", "", text))
    if not m:
        return []
    seqs: dict[str, list[str]] = {}
    for line in m[1].splitlines():
        parts = re.match(r"\s*('(?:[^']|'')*'|\S+)\s+(.*\S)\s*$", line)
        if parts:
            seqs.setdefault(parts[1].strip("'"), []).append(re.sub(r"\s", "", parts[2]))
    return _joined(seqs)


def _joined(pieces: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(name, sequence) of the pieces found for each name, joined once."""
    seqs = {k: "".join(v).upper() for k, v in pieces.items()}
    _check(list(seqs), list(seqs.values()))
    return list(seqs.items())


def parse_clustal(text: str) -> list[tuple[str, str]]:
    seqs: dict[str, list[str]] = {}
    for line in text.splitlines()[1:]:
        m = re.match(r"(\S+)\s+([A-Za-z.~*?-]+)(?:\s+\d+)?\s*$", line)
        if m:
            seqs.setdefault(m[1], []).append(m[2])
    return _joined(seqs)


def parse_msf(text: str) -> list[tuple[str, str]]:
    head, _, body = text.partition("//")
    names = re.findall(r"(?m)^\s*Name:\s*(\S+)", head)
    if len(set(names)) < len(names):
        raise ValueError("a sequence name occurs twice")
    seqs: dict[str, list[str]] = {k: [] for k in names}
    for line in body.splitlines():
        parts = line.split(None, 1)
        if len(parts) == 2 and parts[0] in seqs:
            seqs[parts[0]].append(re.sub(r"[\s\d]", "", parts[1]))
    return _joined(seqs)


def detect(text: str) -> str:
    head = text.lstrip()[:200]
    for kind, pattern in (("fasta", r">"), ("nexus", r"(?i)#nexus"), ("clustal", r"(?i)clustal"), ("msf", r"(?is)(!!|pileup|.*msf:)"), ("newick", r"\("), ("phylip", r"\d+\s+\d+")):
        if re.match(pattern, head):
            return kind
    return "unknown"


PARSERS = {"phylip": parse_phylip, "fasta": parse_fasta, "nexus": parse_nexus_data, "clustal": parse_clustal, "msf": parse_msf}


def read_alignment(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, taxon, seq) of alignment files; the format is found from each file's beginning unless given."""
    return _parse(_whole(spark, path), lambda t: PARSERS[kind or detect(t)](t), "taxon string, seq string")


def sequence_type(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: counts of symbols and seq_type (DNA, BIN, AA, MORPH or unknown), over all characters."""
    c = sequences.select(F.explode(F.split(F.upper(seq), "")).alias("c")).where(~F.col("c").isin("", "?", "-", "."))
    n = c.groupBy("c").agg(F.count("*").alias("n"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    nuc = F.col("c").isin("A", "C", "G", "T", "U")
    s = n.agg(total(~F.col("c").isin("N", "X", "~")).alias("ungap"), total(nuc).alias("nuc"), total(F.col("c").isin("0", "1")).alias("bin"), total(F.col("c").rlike("^[0-9]$")).alias("digit"), total(F.col("c").rlike("^[A-Z]$") & ~nuc).alias("alpha"))
    kind = F.when(F.col("nuc") > 0.9 * F.col("ungap"), "DNA").when(F.col("bin") == F.col("ungap"), "BIN").when(F.col("alpha") + F.col("nuc") > 0.9 * F.col("ungap"), "AA").when(F.col("alpha") + F.col("digit") + F.col("nuc") > 0.9 * F.col("ungap"), "MORPH").otherwise("unknown")
    return s.withColumn("seq_type", kind)


def parse_trees(text: str) -> Iterator[tuple[str]]:
    """Trees of a Newick list or of a NEXUS trees block (its translate table applied)."""
    if text.lstrip()[:6].upper() != "#NEXUS":
        yield from ((t.strip() + ";",) for t in text.split(";") if t.strip())
        return
    names = {}
    if m := re.search(r"(?is)\btranslate\b(.*?);", text):
        names = dict(x.split(None, 1) for x in re.sub(r"\s+", " ", m[1]).strip().split(",") if x.strip() for x in [x.strip()])
    for m in re.finditer(r"(?im)^\s*tree\s+[^=]*=\s*(?:\[[^\]]*\]\s*)?(.*?;)", text):
        yield (re.sub(r"(?<=[(,])([^(),:;\[\]]+)", lambda k: names.get(k[1].strip(), k[1]), m[1]),)


def read_trees(spark: SparkSession, path: str, burn_in: int = 0, most: int | None = None) -> DataFrame:
    """(file, tree, newick), trees counted from 0 in file order, the first `burn_in` left out."""
    rows = _parse(_whole(spark, path), lambda t: [(i, *x) for i, x in enumerate(parse_trees(t))], "tree long, newick string")
    return rows.where((F.col("tree") >= burn_in) & (F.lit(most is None) | (F.col("tree") < burn_in + (most or 0))))


def parse_partitions(text: str) -> list[tuple[str, str, str, str]]:
    """(name, type or file, sites, model) of a NEXUS sets block or of `TYPE, name = sites` lines."""
    if "charset" in text.lower():
        model = {n.strip().strip("'"): m.strip() for body in re.findall(r"(?is)\bcharpartition\s+[^=]*=(.*?);", text) for m, n in (x.rsplit(":", 1) for x in body.split(",") if ":" in x)}
        out = []
        for name, spec in re.findall(r"(?is)\bcharset\s+(\S+?)\s*=\s*(.*?);", text):
            kind, colon, sites = spec.rpartition(":")
            out.append((name, kind.strip(" ,") if colon else "", sites.strip(), model.get(name, "")))
        return out
    out = []
    for line in text.splitlines():
        if "=" in line:
            left, spec = line.split("=", 1)
            kind, _, name = left.partition(",")
            out.append((name.strip(), kind.strip(), spec.strip(), kind.strip()))
    return out


def read_partitions(spark: SparkSession, path: str, last_site: int) -> DataFrame:
    """(file, part, name, lower, upper, step, seq_type, model): a row for each range."""

    def rows(text: str):
        for i, (name, kind, spec, model) in enumerate(parse_partitions(text)):
            for lo, hi, step in site_ranges(spec, last_site):
                yield i, name, lo, hi, step, kind, model

    return _parse(_whole(spark, path), rows, "part int, name string, lower long, upper long, step long, seq_type string, model string")


#: Sites that meet the ranges of one bucket.
SPAN = 4096


def assign_partitions(aln: DataFrame, charsets: DataFrame) -> DataFrame:
    """`aln` (taxon, site, mask) with part, by a join on the ranges that hold the site; a site in no range is left out.

    A range is a row for each bucket of sites it reaches into, not for each site, so what may be broadcast is a small part of the alignment."""
    ranges = charsets.select("part", "lower", "upper", "step", F.explode(F.expr(f"sequence(lower div {SPAN}, upper div {SPAN})")).alias("__span"))
    cells = aln.withColumn("__span", F.expr(f"CAST(site AS LONG) div {SPAN}"))
    return cells.join(ranges, "__span").where("site BETWEEN lower AND upper AND (site - lower) % step = 0").select("taxon", "site", "part", "mask")


def parse_matrix(text: str) -> list[tuple[str, str, float]]:
    """(t1, t2, d) of a square or lower-triangular distance matrix, each pair once."""
    lines = [x.split() for x in text.splitlines() if x.strip()][1:]
    names = [x[0] for x in lines]
    return [(names[j], names[i], float(v)) for i, x in enumerate(lines) for j, v in enumerate(x[1:]) if j < i]


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    return _parse(_whole(spark, path), parse_matrix, "t1 string, t2 string, d double")


def read_presence(spark: SparkSession, path: str) -> DataFrame:
    """(file, taxon, part) where a 0/1 matrix has 1; parts from 0."""
    return _parse(_whole(spark, path), lambda t: [(x.split()[0], i) for x in t.splitlines()[1:] if x.strip() for i, v in enumerate(x.split()[1:]) if v == "1"], "taxon string, part int")


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """(id, parent, rank, name) of a taxonomy dump: fields between bars, scientific names."""
    field = lambda i: F.regexp_replace(F.element_at(F.split("value", r"\|"), i), r"^\s+|\s+$", "")
    n = spark.read.text(nodes).select(field(1).cast("long").alias("id"), field(2).cast("long").alias("parent"), field(3).alias("rank"))
    m = spark.read.text(names).where(field(4) == "scientific name").select(field(1).cast("long").alias("id"), field(2).alias("name"))
    return n.join(m, "id", "left")


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, lower, upper) of `name date` lines; a date may be a range `a:b` with an open end."""
    x = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") >= 2)
    date = F.split(F.element_at("x", 2), ":")
    one = F.size(date) == 1
    return x.select(F.element_at("x", 1).alias("taxon"), F.nullif(F.element_at(date, 1), F.lit("")).alias("lower"), F.when(one, F.element_at(date, 1)).otherwise(F.nullif(F.try_element_at(date, F.lit(2)), F.lit(""))).alias("upper"))


def parse_models(text: str) -> list[tuple[str, str, str]]:
    """(name, kind, definition) of the model and frequency lines of a NEXUS models block."""
    return [(name, kind.lower(), re.sub(r"\s+", " ", body).strip()) for kind, name, body in re.findall(r"(?is)\b(model|frequency)\s+([^\s=]+)\s*=\s*(.*?);", re.sub(r"\[[^\]]*\]", "", text))]


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    """(name, values) of lines of a name and numbers."""
    x = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.element_at(x, 1).alias("name"), F.transform(F.slice(x, 2, F.size(x)), lambda v: v.cast("double")).alias("values"))


def _fields(spark: SparkSession, path: str, sep: str = r"[\s,]+") -> DataFrame:
    """(x): the fields of each line that is neither empty nor a comment (#), quotes taken off."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).where(line != "").select(F.transform(F.split(line, sep), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", "")).alias("x"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, chrom, pos, population, counts): allele counts (A, C, G, T) of populations by site, from a counts file: a line COUNTSFILE with its sizes, a line CHROM POS and the
    populations, then a line for each site."""

    def rows(text: str):
        lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
        at = next(i for i, x in enumerate(lines) if x[0].upper() == "CHROM")
        for x in lines[at + 1 :]:
            if len(x) != len(lines[at]):
                raise ValueError(f"a site of {len(x) - 2} populations where {len(lines[at]) - 2} are named")
            for name, c in zip(lines[at][2:], x[2:], strict=True):
                yield x[0], int(x[1]), name, [int(v) for v in c.split(",")]

    return _parse(_whole(spark, path), rows, "chrom string, pos long, population string, counts array<long>")


def population_states(counts: DataFrame, size: int) -> DataFrame:
    """Adds state: a population's state by its counts: 0 to 3 one base only, 4 and up a pair of bases by the share of the first, rounded to k of `size`, 0 < k < size (pairs AC AG AT
    CG CT GT); null without counts or with more than two bases."""
    kinds = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at("counts", i + 1) > 0)
    i, j = F.col("kinds")[0], F.col("kinds")[1]
    pair = (i * (7 - i) / 2 + j - i - 1).cast("int")
    share = F.element_at("counts", i + 1) / (F.element_at("counts", i + 1) + F.element_at("counts", j + 1))
    k = F.least(F.greatest(F.round(share * size), F.lit(1)), F.lit(size - 1)).cast("int")
    out = counts.withColumn("kinds", kinds)
    return out.withColumn("state", F.when(F.size("kinds") == 1, i).when(F.size("kinds") == 2, 4 + pair * (size - 1) + k - 1)).drop("kinds")


def read_site_values(spark: SparkSession, path: str) -> DataFrame:
    """(site, values): site-specific frequencies or rates: a site (or a range a-b) and its numbers on each line."""
    x = _fields(spark, path)
    ends = F.transform(F.split(F.element_at("x", 1), "-"), lambda v: v.cast("long"))
    return x.select(F.explode(F.sequence(F.element_at(ends, 1), F.element_at(ends, -1))).alias("site"), F.transform(F.slice("x", 2, F.size("x")), lambda v: v.cast("double")).alias("values"))


def parse_costs(text: str) -> list[list[float]]:
    """A cost matrix: its size, then the numbers row by row, or `fitch` or `e` for unit costs. Where a detour is cheaper than a step, its price is taken."""
    from cladeforge.operators.search import metric_closure

    import numpy as np

    body = [x.split() for x in text.splitlines() if x.strip()]
    if body[0][0].lower() in ("fitch", "e"):
        n = int(body[0][1]) if len(body[0]) > 1 else 4
        return (1 - np.eye(n)).tolist()
    n = int(body[0][0])
    m = np.array([float(v) for row in body[1:] for v in row]).reshape(n, n)
    return metric_closure(m).tolist()


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, cost) of a cost matrix, states from 0."""
    return _parse(_whole(spark, path), lambda t: [(i, j, v) for i, row in enumerate(parse_costs(t)) for j, v in enumerate(row)], "a int, b int, cost double")


def read_constraint(spark: SparkSession, path: str) -> DataFrame:
    """(file, members): the splits of a constraint tree, which may have nodes of many children and only some of the taxa; each is the side of the first taxon."""
    from cladeforge.operators.newick import parse, splits

    def rows(text: str):
        for (tree,) in parse_trees(text):
            root = parse(tree)
            taxa = sorted(root.leaves())
            for s, _ in splits(root):
                yield (sorted(s if taxa[0] in s else set(taxa) - set(s)),)

    return _parse(_whole(spark, path), rows, "members array<string>")


def read_diversity_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, weight, cost): the scale of a first line of one number is each taxon's factor; then a taxon, its weight and, where given, its cost on each line."""
    x = _whole(spark, path)

    def rows(text: str):
        lines = [y.split() for y in text.splitlines() if y.strip() and not y.startswith("#")]
        scale = float(lines[0][0]) if len(lines[0]) == 1 else 1.0
        for y in lines[len(lines[0]) == 1 :]:
            yield y[0], scale * float(y[1]), float(y[2]) if len(y) > 2 else 1.0

    return _parse(x, rows, "taxon string, weight double, cost double").drop("file")


def read_food_web(spark: SparkSession, path: str) -> DataFrame:
    """(predator, prey, weight): a directed arc on each line, its weight 1 where none is given; raises an error for a cycle, as nothing eats itself."""

    def rows(text: str):
        arcs = [y.split() for y in text.splitlines() if y.strip() and not y.startswith("#")]
        eats: dict[str, set[str]] = {}
        for y in arcs:
            eats.setdefault(y[0], set()).add(y[1])
        left = dict(eats)
        while free := [k for k, v in left.items() if not v & left.keys()]:
            for k in free:
                del left[k]
        if left:
            raise ValueError(f"a cycle among {sorted(left)}")
        return [(y[0], y[1], float(y[2]) if len(y) > 2 else 1.0) for y in arcs]

    return _parse(_whole(spark, path), rows, "predator string, prey string, weight double").drop("file")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, taxon): groups of taxa for quartets, from the taxsets of a NEXUS sets block (one called `ignored` is group 0), or a Newick list, a group a tree."""

    def rows(text: str):
        sets = re.findall(r"(?is)\btaxset\s+(\S+)\s*=\s*(.*?);", text)
        if sets:
            n = 0
            for name, body in sets:
                n += name.lower() != "ignored"
                yield from ((0 if name.lower() == "ignored" else n, t) for t in body.split())
        else:
            yield from ((i, t.strip()) for i, (tree,) in enumerate(parse_trees(text), 1) for t in re.findall(r"[^\s(),;]+", tree))

    return _parse(_whole(spark, path), rows, "cluster int, taxon string").drop("file")


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """(node, old, site, new): predefined substitutions, lines of a node and a list such as `A10G/C3T`; sites from 1."""
    x = _fields(spark, path, r"\s+")
    one = x.select(F.element_at("x", 1).alias("node"), F.explode(F.split(F.element_at("x", 2), "[/,]")).alias("m"))
    part = lambda i: F.regexp_extract("m", r"^([A-Za-z])(\d+)([A-Za-z-])$", i)
    return one.select("node", F.upper(part(1)).alias("old"), part(2).cast("long").alias("site"), F.upper(part(3)).alias("new")).where("site IS NOT NULL")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A written state (a fitted model, a pool of trees, a search): a Parquet table or, by its extension, JSON lines."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
