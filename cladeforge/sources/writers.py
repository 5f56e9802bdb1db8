"""Writers of alignments, trees, splits, matrices and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.operators.alignment import DNA

_LETTER = {v: k for k, v in reversed(DNA.items()) if k != "U"}


def letter(mask: str = "mask") -> Column:
    out = F.lit("-")
    for m, k in _LETTER.items():
        out = F.when(F.col(mask) == m, k).otherwise(out)
    return out


#: Sites whose letters are put together before the sequences are.
STRETCH = 4096


def sequences(aln: DataFrame) -> DataFrame:
    """(taxon, seq) of an alignment, sites in order: letters are joined to stretches, stretches to sequences, so that no task sorts a sequence's cells."""
    joined = lambda key, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), what.alias("v")))), lambda x: x["v"]), "")
    stretch = aln.groupBy("taxon", F.expr(f"CAST(floor(site / {STRETCH}) AS BIGINT)").alias("stretch")).agg(joined(F.col("site"), letter()).alias("piece"))
    return stretch.groupBy("taxon").agg(joined(F.col("stretch"), F.col("piece")).alias("seq"))


def fasta(aln: DataFrame) -> DataFrame:
    return sequences(aln).select(F.concat(F.lit(">"), F.col("taxon").cast("string"), F.lit("\n"), "seq").alias("value"))


def phylip(aln: DataFrame) -> DataFrame:
    """Lines (order, value): a header and a line for each taxon."""
    s = sequences(aln)
    head = s.agg(F.lit(-(2**63)).alias("order"), F.concat(F.count("*").cast("string"), F.lit(" "), F.max(F.length("seq")).cast("string")).alias("value"))
    return head.unionByName(s.select(F.xxhash64("taxon").alias("order"), F.concat(F.rpad(F.col("taxon").cast("string"), 10, " "), F.lit(" "), "seq").alias("value")))


def site_table(classified: DataFrame) -> DataFrame:
    """(part, site, stat, observed): class of each site (C constant, I informative, - else) and its states."""
    stat = F.when(F.col("is_const"), "C").when(F.col("informative"), "I").otherwise("-")
    seen = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("states", _of), lambda c: c != "-"))), "")
    return classified.select("part", "site", stat.alias("stat"), seen.alias("observed"))


def _of(mask: Column) -> Column:
    out = F.lit("-")
    for m, k in _LETTER.items():
        out = F.when(mask == m, k).otherwise(out)
    return out


def distance_lines(dist: DataFrame, a: str = "t1", b: str = "t2", d: str = "d") -> DataFrame:
    """(taxon, value): the lines of a square matrix, taxa in order."""
    both = dist.select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(d).alias("d")).unionByName(dist.select(F.col(b).alias("x"), F.col(a).alias("y"), F.col(d).alias("d")))
    taxa = both.select("x").distinct()
    both = both.unionByName(taxa.select("x", F.col("x").alias("y"), F.lit(0.0).alias("d")))
    return both.groupBy("x").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "d"))), lambda v: F.format_number(v["d"], 6)), " ").alias("v")).select(F.col("x").alias("taxon"), F.concat(F.col("x").cast("string"), F.lit(" "), "v").alias("value"))


def split_lines(system: DataFrame) -> DataFrame:
    """Lines of a NEXUS splits matrix."""
    return system.select(F.concat(F.col("support").cast("string"), F.lit("\t"), F.array_join(F.transform("members", lambda x: x.cast("string")), " "), F.lit(",")).alias("value"))


def partition_lines(charsets: DataFrame) -> DataFrame:
    """NEXUS charset lines, one for each partition."""
    span = F.concat("lower", F.lit("-"), "upper", F.when(F.col("step") > 1, F.concat(F.lit("\\"), "step")).otherwise(""))
    return charsets.groupBy("part", "name").agg(F.array_join(F.array_sort(F.collect_list(span)), " ").alias("s")).select(F.concat(F.lit("  charset "), "name", F.lit(" = "), "s", F.lit(";")).alias("value"))


def nexus(aln: DataFrame) -> DataFrame:
    """Lines (order, value) of a NEXUS data block."""
    s = sequences(aln)
    size = s.agg(F.count("*").cast("string").alias("n"), F.max(F.length("seq")).cast("string").alias("k"))
    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    head = size.select(low.alias("order"), F.concat(F.lit("#NEXUS\nbegin data;\n  dimensions ntax="), "n", F.lit(" nchar="), "k", F.lit(";\n  format datatype=dna missing=? gap=-;\n  matrix")).alias("value"))
    end = size.select(high.alias("order"), F.lit("  ;\nend;").alias("value"))
    return head.unionByName(s.select(F.xxhash64("taxon").alias("order"), F.concat(F.lit("  "), F.col("taxon").cast("string"), F.lit(" "), "seq").alias("value"))).unionByName(end)


def _blocks(aln: DataFrame, width: int) -> DataFrame:
    """(block, taxon, piece): sequences in pieces of `width` letters, a sequence gone through once; an empty one is one empty piece."""
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    s = sequences(aln).select(F.col("taxon").cast("string").alias("taxon"), F.posexplode(F.when(F.col("seq") == "", F.array(F.lit(""))).otherwise(pieces)).alias("block", "piece"))
    return s.select("block", "taxon", "piece")


def clustal(aln: DataFrame, width: int = 60) -> DataFrame:
    """Lines (order, value) of an interleaved Clustal file; an order is (block, taxon)."""
    b = _blocks(aln, width)
    head = b.agg(F.struct(F.lit(-1).cast("long").alias("block"), F.lit("").alias("taxon")).alias("order")).select("order", F.lit("CLUSTAL multiple alignment").alias("value"))
    gap = b.select("block").distinct().select(F.struct(F.col("block").cast("long").alias("block"), F.lit("").alias("taxon")).alias("order"), F.lit("").alias("value"))
    rows = b.select(F.struct(F.col("block").cast("long").alias("block"), "taxon").alias("order"), F.concat(F.rpad("taxon", 12, " "), "piece").alias("value"))
    return head.unionByName(gap).unionByName(rows)


def msf(aln: DataFrame, width: int = 50) -> DataFrame:
    """Lines (order, value) of an MSF file; an order is (block, taxon)."""
    s, b = sequences(aln), _blocks(aln, width)
    place = lambda block, taxon: F.struct(F.lit(block).cast("long").alias("block"), taxon.alias("taxon")).alias("order")
    size = s.agg(F.max(F.length("seq")).cast("string").alias("k"))
    head = size.select(place(-3, F.lit("")), F.concat(F.lit("PileUp\n\n MSF: "), "k", F.lit(" Type: N Check: 0 ..\n")).alias("value"))
    name = s.select(place(-2, F.col("taxon").cast("string")), F.concat(F.lit(" Name: "), F.col("taxon").cast("string"), F.lit(" Len: "), F.length("seq").cast("string"), F.lit(" Check: 0 Weight: 1.0")).alias("value"))
    bar = size.select(place(-1, F.lit("")), F.lit("\n//\n").alias("value"))
    rows = b.select(F.struct(F.col("block").cast("long").alias("block"), "taxon").alias("order"), F.concat(F.lit(" "), F.rpad("taxon", 12, " "), "piece").alias("value"))
    return head.unionByName(name).unionByName(bar).unionByName(rows)


def tree_drawing(newick: str) -> str:
    """A tree as lines of text, leaves from top to bottom in their order, a column for each level."""
    from cladeforge.operators.newick import Node, parse

    lines: list[str] = []

    def draw(x: Node, first: str, rest: str) -> None:
        if not x.children:
            lines.append(f"{first} {x.name}")
            return
        for i, c in enumerate(x.children):
            last = i == len(x.children) - 1
            draw(c, (first if i == 0 else rest) + ("+--" if i == 0 and first else "\\--" if last else "|--" if i else "+--"), rest + ("   " if last else "|  "))

    draw(parse(newick), "", "")
    return "\n".join(lines)


def comma_lines(table: DataFrame) -> DataFrame:
    """Lines (order, value) of a table with its header, fields quoted where they need it; rows in the order of their fields."""
    quote = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    row = F.concat_ws(",", *(quote(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in table.columns))
    head = table.sparkSession.range(1).select(F.lit("").alias("order"), F.lit(",".join(table.columns)).alias("value"))
    return head.unionByName(table.select(F.concat(F.lit("1"), row).alias("order"), row.alias("value")))


def branch_table(nodes: DataFrame, rates: DataFrame) -> DataFrame:
    """(part, node, parent, length): each branch's length in each partition, of node rows (node, parent, brlen) and partitions' rates (part, rate)."""
    return nodes.withColumn("__one", F.lit(1)).join(rates.withColumn("__one", F.lit(1)), "__one").select("part", "node", "parent", (F.col("brlen") * F.col("rate")).alias("length"))

