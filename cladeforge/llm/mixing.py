"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents form one stream of words, packed into blocks of `block` words. Each output shard of
`SHARD` slots draws how many of its slots go to each source (a multinomial draw: one categorical draw a slot, by
a hash of the slot's number). A source's slots count up over the shards; slots drawn beyond the number that the
source's target needs are handed to sources that were drawn too rarely, so each total is exact. Slot n of a source
is block perm(n mod blocks) of epoch n div blocks, where perm is a swap-or-not shuffle of the source's full blocks,
anew for each epoch; the short last block ends each epoch. Taken blocks meet the documents by (source, block).

The driver holds a few numbers for each source. Stream offsets come from sums by (source, bucket of documents), so
no source is handled by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladeforge.llm.common import WORD, materialize, table

BLOCK, SHARD, BUCKETS, ROUNDS, LIMIT, SLOTS_A_TASK, SPAN = 128, 4096, 1024, 12, 3, 1 << 16, 4096
#: The modulus and multipliers of the hash; weights repeat.
P, WEIGHTS = 2147483647, (1, 2, 3)


def _hash(x: str) -> str:
    """A hash in [0, P) of a non-negative integer below P, as SQL for Spark and for DuckDB."""
    a = f"(({x}) * 48271 + 1299721) % {P}"
    b = f"(({a}) * (({a}) % 32749 + 1)) % {P}"
    return f"((({b}) * 69621 + 40692) % {P})"


def _bucket(ident: str) -> str:
    return f"(((abs(coalesce({ident}, -1) % {P}) * 48271 + 12345) % {P}) % {BUCKETS})"


def _round(x: str, q: str, domain: str) -> tuple[str, str]:
    """Of a swap-or-not round with number q (source, epoch and round in one): the partner of x, and whether to swap."""
    partner = f"((({q} * 16807 + 11) % {P} * 48271) % {P} % {domain} - {x} + {domain}) % {domain}"
    t = f"((greatest({x}, {partner}) % {P}) * 69621 + {q} * 40692 + 7) % {P}"
    return partner, f"((({t}) * (({t}) % 32749 + 1)) % {P} % 2048 >= 1024)"


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    words: int  # to take: the target, rounded
    blocks: int
    slots: int
    last: int  # words of the last slot; 0: whole


def plan_sources(sizes: list[tuple[str | None, int]], block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> list[Source]:
    """Targets: the total shared by weight, none above `limit` times its size, the excess shared anew."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    left, open_ = sum(n for _, n in order), set(range(len(order)))
    while True:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] > limit * order[i][1] * total}
        if not over:
            break
        left -= sum(limit * order[i][1] for i in over)
        open_ -= over
    out = []
    for i, (name, size) in enumerate(order):
        target = left * weight[i] / total if i in open_ else float(limit * size)
        words = (2 * left * weight[i] + total) // (2 * total) if i in open_ else limit * size
        blocks = -(-size // block)
        rest = words % size if size else 0
        slots = (words // size) * blocks + -(-rest // block) if size else 0
        out.append(Source(name, size, target, words, blocks, slots, rest - (-(-rest // block) - 1) * block if rest else 0))
    return out


def _array(values: list[int]) -> F.Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values) or '0L'})")


def slots(spark: SparkSession, plan: list[Source], block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix: (shard, s, n, epoch, block, words): slot n of source number s, its shard, its block and the words it takes."""
    total = sum(p.slots for p in plan)
    reach, so_far = [], 0
    for p in plan:
        so_far += p.slots
        reach.append(so_far * P // max(total, 1))
    drawn = spark.range(total).select(F.expr(f"id div {shard}").alias("shard"), F.expr(_hash(f"id % {P}")).alias("u"))
    drawn = drawn.select("shard", F.size(F.filter(_array(reach), lambda x: x <= F.col("u"))).cast("long").alias("s"))
    drawn = materialize(drawn.groupBy("shard", "s").agg(F.count("*").alias("c")), "draws")
    have = dict(drawn.groupBy("s").agg(F.sum("c")).collect())  # a number for each source
    extra, short, e, d = [], [], 0, 0
    for i, p in enumerate(plan):
        extra.append(e)
        e += max(0, have.get(i, 0) - p.slots)
        d += max(0, p.slots - have.get(i, 0))
        short.append(d)
    at = lambda values, i: F.element_at(_array(values), (i + 1).cast("int"))
    # a source's shards count up in spans, and the spans among themselves, so that a source with very many shards is many tasks' work
    spans = drawn.groupBy("s", F.expr(f"shard div {SPAN}").alias("span")).agg(F.sum("c").alias("n"))
    before = spans.select("s", "span", (F.sum("n").over(W.partitionBy("s").orderBy("span")) - F.col("n")).alias("before"))
    inner = F.coalesce(F.sum("c").over(W.partitionBy("s", "span").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.withColumn("span", F.expr(f"shard div {SPAN}")).withColumn("inner", inner).join(before, ["s", "span"])
    each = placed.withColumn("start", F.col("before") + F.col("inner")).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLOTS_A_TASK), "s", "shard").select("shard", "s", F.explode(F.expr("sequence(start, start + c - 1)")).alias("n"))
    facts = spark.range(len(plan)).select(F.col("id").alias("s"), *(at([getattr(p, k) for p in plan], F.col("id")).alias(k) for k in ("size", "blocks", "slots", "last")))
    wanted = facts.select("s", F.col("slots").alias("need"))
    each = each.join(wanted, "s").withColumn("rank", F.when(F.col("n") >= F.col("need"), at(extra, F.col("s")) + F.col("n") - F.col("need")))
    to = F.size(F.filter(_array(short), lambda x: x <= F.col("rank"))).cast("long")
    each = each.select("shard", F.when(F.col("rank").isNull(), F.col("s")).otherwise(to).alias("s"), F.col("rank"), F.col("n"))
    first = at([have.get(i, 0) - (short[i - 1] if i else 0) for i in range(len(plan))], F.col("s"))
    each = each.select("shard", "s", F.when(F.col("rank").isNull(), F.col("n")).otherwise(first + F.col("rank")).alias("n"))
    each = each.join(facts, "s").selectExpr("*", "n div blocks AS epoch", "n % blocks AS pos")
    turn = f"aggregate(sequence(1, {ROUNDS}), pos, (x, r) -> {_turn('x', '(s * 64 + epoch * 16 + r)', '(blocks - 1)')})"
    each = each.withColumn("block", F.expr(f"CASE WHEN pos = blocks - 1 THEN pos ELSE {turn} END"))
    whole = F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block)
    return each.select("shard", "s", "n", "epoch", "block", F.when((F.col("n") == F.col("slots") - 1) & (F.col("last") > 0), F.col("last")).otherwise(whole).alias("words"), whole.alias("whole"))


def _turn(x: str, q: str, domain: str) -> str:
    partner, swaps = _round(x, q, domain)
    return f"CASE WHEN {swaps} THEN {partner} ELSE {x} END"


def _taken(docs: DataFrame, ident: str, source: str, size: str, also: list[str] | None, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of `docs` cut along the blocks, each piece with its place in its row and block; the slots that take each block, whole (__times)
    or in part; and the rows without words."""
    spark, keep = docs.sparkSession, [ident, *(also or [])]
    docs = docs.select(*keep, F.col(source).alias("__source"), F.col(size).alias("size"))
    plan = plan_sources([tuple(r) for r in docs.groupBy("__source").agg(F.sum("size")).collect()], block)  # a row for each source
    number = F.create_map(*(x for i, p in enumerate(plan) if p.name is not None for x in (F.lit(p.name), F.lit(i).cast("long")))) if any(p.name is not None for p in plan) else None
    s = F.coalesce(F.element_at(number, F.col("__source")), F.lit(len(plan) - 1).cast("long")) if number is not None else F.lit(0).cast("long")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)) if values else F.array(F.lit(0)), (i + 1).cast("int"))
    docs = docs.withColumn("__s", s).withColumn("__b", F.expr(_bucket(ident)))
    docs = docs.withColumn("source_size", at([p.size for p in plan], F.col("__s")).cast("long")).withColumn("target", at([p.target for p in plan], F.col("__s")).cast("double"))
    sized, none = docs.where("size > 0"), docs.where("size = 0")
    own = W.partitionBy("__s", "__b").orderBy(F.col(ident).asc_nulls_last(), "size", *(also or []))
    before = sized.groupBy("__s", "__b").agg(F.sum("size").alias("__n"))
    before = before.select("__s", "__b", F.coalesce(F.sum("__n").over(W.partitionBy("__s").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = sized.withColumn("__row", F.row_number().over(own)).withColumn("__off", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(before, ["__s", "__b"]).withColumn("__off", F.col("__off") + F.col("__before"))
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(__off div {block}, (__off + size - 1) div {block})")))
    pieces = pieces.withColumn("__lo", F.greatest(F.lit(0), F.col("__off") - F.col("block") * block)).withColumn("__hi", F.least(F.lit(block), F.col("__off") + F.col("size") - F.col("block") * block))
    takes = slots(spark, plan, block).groupBy(F.col("s").alias("__s"), "block").agg(F.sum((F.col("words") == F.col("whole")).cast("long")).alias("__times"), F.sum(F.when(F.col("words") < F.col("whole"), F.col("words")).otherwise(0)).alias("__part"))
    return pieces, takes, none


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", size: str = "size", also: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """`ident`, `also`, size, source_size, target and taken for each row of `docs` (which has its word count in `size`).

    Null sources are a source of their own, the last. Rows without words have taken 0. Repeated rows each have their own place
    in the stream; a null ident comes last in its bucket. An empty table gives an empty result. Reruns agree: nothing depends
    on the order or the number of partitions."""
    pieces, takes, none = _taken(docs, ident, source, size, also, block)
    taken = F.coalesce(F.col("__times") * (F.col("__hi") - F.col("__lo")) + F.greatest(F.lit(0), F.least("__hi", "__part") - F.col("__lo")), F.lit(0))
    columns = [ident, *(also or []), "size", "source_size", "target"]
    out = pieces.join(takes, ["__s", "block"], "left").groupBy("__s", "__b", "__row", *columns).agg(F.sum(taken).alias("taken"))
    return out.select(*columns, "taken").unionByName(none.select(*columns, F.lit(0).cast("long").alias("taken")))


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix(materialize(sizes, "sizes"))


def word_ranges(docs: DataFrame, ident: str = "doc_id", source: str = "source", size: str = "size", also: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """`ident`, `also`, size and __ranges, a row for each copy that the mix takes of a row of `docs`: the (at, n) of its words that drawn
    blocks hold, in order. Copy c holds the blocks drawn c times or more; the part of a block that the last slot takes follows its whole draws."""
    pieces, takes, _ = _taken(docs, ident, source, size, also, block)
    got = pieces.join(takes, ["__s", "block"]).withColumn("at", F.col("block") * block + F.col("__lo") - F.col("__off")).withColumn("n", F.col("__hi") - F.col("__lo"))
    got = got.withColumn("part", F.greatest(F.lit(0), F.least("__hi", "__part") - F.col("__lo"))).where("__times > 0 OR part > 0")
    keys = [ident, *(also or []), "size"]
    held = F.sort_array(F.collect_list(F.struct("at", "n", F.col("__times").alias("times"), "part"))).alias("held")
    got = got.groupBy("__s", "__b", "__row", *keys).agg(held, F.max(F.col("__times") + (F.col("part") > 0).cast("long")).alias("copies"))
    got = got.withColumn("c", F.explode(F.expr("sequence(1L, copies)")))
    ranges = "transform(filter(held, p -> p.times >= c OR (p.times = c - 1 AND p.part > 0)), p -> struct(p.at AS at, CASE WHEN p.times >= c THEN p.n ELSE p.part END AS n))"
    return got.select(*keys, F.expr(ranges).alias("__ranges"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes words of it: a row holds the words of the blocks drawn, in order, with the white space before
    each word; a row that holds all is the text itself. n_chars is that of the row's text."""
    keyed = docs.withColumn("__own", F.xxhash64(*docs.columns))
    sizes = materialize(keyed.select("doc_id", "source", "__own", word_count().alias("size")), "sizes")
    taken = word_ranges(sizes, also=["__own"]).withColumnsRenamed({"doc_id": "__id", "size": "__size"})
    one = keyed.dropDuplicates(["__own", "doc_id"]).join(taken, (keyed["__own"] == taken["__own"]) & keyed["doc_id"].eqNullSafe(taken["__id"])).drop(taken["__own"])
    # the split stands outside the inner function, so that it is made once a row
    drawn = F.expr(r"transform(array(split(text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])')), ws -> concat_ws('', flatten(transform(__ranges, r -> slice(ws, CAST(r.at + 1 AS INT), CAST(r.n AS INT))))))[0]")
    drawn = F.when(F.col("__ranges")[0]["at"] > 0, F.regexp_replace(drawn, r"^[\x20\x09-\x0D]+", "")).otherwise(drawn)
    whole = F.expr("aggregate(__ranges, 0L, (x, r) -> x + r.n) = __size")
    one = one.withColumn("text", F.when(whole, F.col("text")).otherwise(drawn))
    if "n_chars" in docs.columns:
        one = one.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return one.select(*docs.columns)


def _oracle() -> str:
    q = lambda r: f"(s * 64 + epoch * 16 + {r})"
    rounds, last = [], "slot"
    for r in range(1, ROUNDS + 1):
        x = "pos" if r == 1 else "x"
        rounds.append(f"r{r} AS (SELECT *{' EXCLUDE (x)' if r > 1 else ''}, CASE WHEN pos = blocks - 1 THEN {x} ELSE {_turn(x, q(r), '(CASE WHEN blocks > 1 THEN blocks - 1 ELSE 1 END)')} END AS x FROM {last})")
        last = f"r{r}"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, row_number() OVER () AS r FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source),
wt AS (SELECT *, s % 3 + 1 AS w FROM src),
filled AS (SELECT *, sum(source_size) OVER () - coalesce(sum({LIMIT} * source_size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS ws
           FROM wt WINDOW before AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flag AS (SELECT *, rest * w > {LIMIT} * source_size * ws AS capped FROM filled),
level AS (SELECT CAST(sum(source_size) - coalesce(sum({LIMIT} * source_size) FILTER (capped), 0) AS BIGINT) AS rest, CAST(coalesce(sum(w) FILTER (NOT capped), 1) AS BIGINT) AS ws FROM flag),
aim AS (SELECT source, s, source_size, CASE WHEN capped THEN CAST({LIMIT} * source_size AS DOUBLE) ELSE CAST(level.rest * w AS DOUBLE) / level.ws END AS target,
        CASE WHEN capped THEN {LIMIT} * source_size ELSE (2 * level.rest * w + level.ws) // (2 * level.ws) END AS words, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM flag, level),
part AS (SELECT *, CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest FROM aim),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN (words // source_size) * blocks + (rest + {BLOCK - 1}) // {BLOCK} ELSE 0 END AS slots,
         CASE WHEN rest > 0 THEN rest - ((rest + {BLOCK - 1}) // {BLOCK} - 1) * {BLOCK} ELSE 0 END AS last FROM part),
slot AS (SELECT s, n // blocks AS epoch, n % blocks AS pos, n, blocks, slots, last, source_size FROM (SELECT *, unnest(range(slots)) AS n FROM plan)),
{", ".join(rounds)},
used AS (SELECT s, CASE WHEN pos = blocks - 1 THEN pos ELSE x END AS block, least({BLOCK}, source_size - (CASE WHEN pos = blocks - 1 THEN pos ELSE x END) * {BLOCK}) AS whole,
         CASE WHEN n = slots - 1 AND last > 0 THEN last ELSE least({BLOCK}, source_size - (CASE WHEN pos = blocks - 1 THEN pos ELSE x END) * {BLOCK}) END AS words FROM {last}),
takes AS (SELECT s, block, sum(CASE WHEN words = whole THEN 1 ELSE 0 END) AS times, sum(CASE WHEN words < whole THEN words ELSE 0 END) AS part FROM used GROUP BY s, block),
placed AS (SELECT d.*, plan.s, plan.source_size, plan.target, CAST(sum(size) OVER (PARTITION BY plan.s ORDER BY {_bucket("doc_id")}, doc_id NULLS LAST, size, r ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS off
           FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
pieces AS (SELECT *, greatest(0, off - block * {BLOCK}) AS lo, least({BLOCK}, off + size - block * {BLOCK}) AS hi FROM (SELECT *, unnest(range(off // {BLOCK}, (off + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0)),
got AS (SELECT r, sum(times * (hi - lo) + greatest(0, least(hi, part) - lo)) AS taken FROM pieces JOIN takes USING (s, block) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN got USING (r)
"""


ORACLE_OP6 = _oracle()
