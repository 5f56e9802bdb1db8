"""Phylogenomic views of the star-schema tables: an alignment, splits, trees, pattern likelihoods, presence.

Each view is a function (spark, sf_dir) -> DataFrame over whole tables, and the same view in SQL for the oracle (`CTE`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GAP = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taxa_of(spark: SparkSession, sf_dir: str) -> list[int]:
    """The alignment's taxa, in order: its rows, so few; one column is read."""
    return [r[0] for r in table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().orderBy("l_linenumber").collect()]


#: Bytes of files for each task that rows are dealt out to.
SHARE = 4 << 20


def by_bytes(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows of a table dealt out by keys to a task for each SHARE of its files, so that a task's memory does not grow with the table; small tables as Spark sees fit."""
    tasks = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SHARE
    return rows.repartition(tasks, *key) if tasks > table.sparkSession.sparkContext.defaultParallelism else rows.repartition(*key)


def site_columns(spark: SparkSession, sf_dir: str, protein: bool = False) -> DataFrame:
    """(part, site, states): orders are sites, line numbers are taxa; a line's flag and quantity are its state, missing lines gaps.

    Lines meet by order, once: cells and columns are aggregated on the same side of that exchange. The taxa are a subquery of the same plan."""
    rows = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")  # as a number that keeps the order of flags: a text would have every line sorted
    code = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "N", 2).when(flag == "N", 3).when(flag > "N", 4)
    line = rows.select(F.col("l_linenumber").alias("taxon"), F.col("l_orderkey").alias("site"), "l_quantity", code.alias("flag"))
    taxa = line.agg(F.array_sort(F.collect_set("taxon"))).scalar()
    gap = GAP
    state = F.when(F.min("l_quantity") > 40, 8).when(F.min("flag") == 1, 1).when(F.min("flag") == 3, 2).otherwise(4)
    if protein:  # twenty states by quantity
        gap, state = 2**20 - 1, F.expr("CAST(shiftleft(1, CAST(min(l_quantity) AS INT) % 20) AS INT)")
    cells = by_bytes(rows, line, "site").groupBy("site", "taxon").agg(state.alias("mask"))
    by_site = cells.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("taxon", "mask"))).alias("m")).withColumn("taxa", taxa)
    return by_site.select((F.col("site") % 4).cast("int").alias("part"), "site", F.transform("taxa", lambda t: F.coalesce(F.element_at("m", t), F.lit(gap))).alias("states"), "taxa")


def alignment(spark: SparkSession, sf_dir: str, protein: bool = False) -> DataFrame:
    """(taxon, site, part, mask): the cells of `site_columns`."""
    cell = site_columns(spark, sf_dir, protein).select("part", "site", F.explode(F.arrays_zip("taxa", "states")).alias("c"))
    return cell.select(F.col("c.taxa").alias("taxon"), "site", "part", F.col("c.states").alias("mask"))


def pattern_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, ptn, lnl, freq): line numbers are trees, suppliers are patterns."""
    line = table(spark, sf_dir, "lineitem")
    freq = line.groupBy(F.col("l_suppkey").alias("ptn")).agg(F.count("*").alias("freq"))
    lnl = line.groupBy(F.col("l_linenumber").alias("tree"), F.col("l_suppkey").alias("ptn")).agg((-F.log(1 + F.avg("l_extendedprice"))).alias("lnl"))
    return lnl.join(freq, "ptn").select("tree", "ptn", "lnl", "freq")


def clade_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, clade, taxon, weight): event types are trees; users of one residue are a clade, a few by their values of the next.

    Values are added in the order of events, as SQL does on one thread: a floating sum's last bit, and with it whether it reaches a whole number, hangs on that order. The
    running total is a window's, which holds no user's events together."""
    order = W.partitionBy("event_type", "user_id").orderBy("event_id", "value")
    upto = table(spark, sf_dir, "events").select("event_type", "user_id", F.sum("value").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("v"), F.row_number().over(order).cast("long").alias("n"))
    per = upto.groupBy("event_type", "user_id").agg(F.max_by("v", "n").alias("v"), F.max("n").alias("n"))
    return per.select(F.col("event_type").alias("tree"), ((F.col("user_id") + F.when(F.floor("v") % 40 == 0, 1).otherwise(0)) % 8).cast("int").alias("clade"), F.col("user_id").alias("taxon"), "n")


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, brlen): regions, nations and suppliers as a rooted tree."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = region.select(name("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(1.0).alias("brlen"))
    out = out.unionByName(nation.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), ((F.col("n_nationkey") + 1) / 100).alias("brlen")))
    return out.unionByName(supplier.select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent"), (F.abs("s_acctbal") / 10000).alias("brlen")))


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxon, part): suppliers and the brands they deliver."""
    line, part = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("taxon"), F.col("p_brand").alias("part")).distinct()


def sample_weights(rep: str, ptn: str) -> str:
    """A hash-derived bootstrap weight, in SQL that both engines read."""
    return f"(({rep} * 7919 + {ptn} * 104729) % 5)"


CTE = {
    "aln": """cells AS (SELECT l_linenumber AS taxon, l_orderkey AS site, CASE WHEN min(l_quantity) > 40 THEN 8 WHEN min(l_returnflag) = 'A' THEN 1 WHEN min(l_returnflag) = 'N' THEN 2 ELSE 4 END AS mask FROM lineitem GROUP BY ALL),
aln AS (SELECT t.taxon, s.site, CAST(s.site % 4 AS INTEGER) AS part, coalesce(c.mask, 15) AS mask FROM (SELECT DISTINCT taxon FROM cells) t CROSS JOIN (SELECT DISTINCT site FROM cells) s LEFT JOIN cells c ON c.taxon = t.taxon AND c.site = s.site)""",
    "protein": """cells AS (SELECT l_linenumber AS taxon, l_orderkey AS site, CAST(1 << (CAST(min(l_quantity) AS INTEGER) % 20) AS INTEGER) AS mask FROM lineitem GROUP BY ALL),
aln AS (SELECT t.taxon, s.site, CAST(s.site % 4 AS INTEGER) AS part, coalesce(c.mask, 1048575) AS mask FROM (SELECT DISTINCT taxon FROM cells) t CROSS JOIN (SELECT DISTINCT site FROM cells) s LEFT JOIN cells c ON c.taxon = t.taxon AND c.site = s.site)""",
    "ptnlh": """ptnlh AS (SELECT l_linenumber AS tree, l_suppkey AS ptn, -ln(1 + avg(l_extendedprice)) AS lnl, (SELECT count(*) FROM lineitem x WHERE x.l_suppkey = l.l_suppkey) AS freq FROM lineitem l GROUP BY l_linenumber, l_suppkey)""",
    "clades": """clades AS (SELECT event_type AS tree, (user_id + CASE WHEN CAST(floor(sum(value)) AS BIGINT) % 40 = 0 THEN 1 ELSE 0 END) % 8 AS clade, user_id AS taxon, count(*) AS n FROM events GROUP BY event_type, user_id)""",
    "tree": """tree AS (SELECT 'r' || r_regionkey AS node, 'root' AS parent, 1.0::DOUBLE AS brlen FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey + 1) / 100.0::DOUBLE FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, abs(s_acctbal) / 10000 FROM supplier)""",
    "pres": """pres AS (SELECT DISTINCT l_suppkey AS taxon, p_brand AS part FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}
