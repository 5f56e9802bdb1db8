"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of different value are dealt into tiles of about equal size, cut along the population counts of the
four 16-bit parts of their first word. Two tiles are compared only if those counts can lie within the radius
(the sum of the parts' count differences never exceeds the Hamming distance), then exactly, with numpy's
exclusive-or and bit counts. A tile reports a spanning forest of its own links, and a tile pair only links between the trees of its
tiles, so thousands of close fingerprints cost thousands of rows, not millions. Components come from minimum labels with pointer jumping.

What the driver holds is bounded: the counts of at most 17^4 cells and the list of tile pairs (at most
`MAX_TILES` tiles; tiles grow with the number of fingerprints). Fingerprints and links stay in the cluster.

The pipeline's stage takes tiles for a search only: texts that close fingerprints chain together are compared by their sets of shingles. Its tiles are cut
along the sizes of the sets, which similar sets share up to a factor; population counts would prune nothing at its radius.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import discard, lean, materialize, mix64, small_batches, table

TILE, MAX_TILES, PARTNERS, ROWS, COLUMNS = 2048, 2048, 16, 128, 8192
SEED = 42
PIECE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_hashes(raw: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 values of the k-word shingles of a text, piece by piece; a text of fewer words gives one."""
    h = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    left: list[bytes] = []
    at, seen = 0, 0
    while at < len(raw):
        cut = _GAP.search(raw, at + PIECE)
        to = cut.start() if cut else len(raw)
        words = left + raw[at:to].translate(_LOWER).split()
        n = len(words) - k + 1
        if n > 0:
            yield np.fromiter(map(h, map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))), np.uint64, n)
            seen += n
        left, at = words[max(n, 0) :], to
    if not seen and left:
        yield np.array([h(b" ".join(left))], np.uint64)


def fingerprint(raw: bytes, k: int = 4, words: int = 1) -> list[int]:
    """`words` 64-bit fingerprints of a UTF-8 text: a bit is 1 if set in over half of the shingles' values."""
    return _majority(_shingle_hashes(raw, k), words)


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """The different XXH64 values of a text's k-word shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(raw, k)]))


def set_fingerprint(raw: bytes, k: int, words: int) -> list[int]:
    """`words` fingerprints of a text's set of shingles, each counted once, a hash of the set and its size."""
    own = shingle_set(raw, k)
    return [*_majority([own], words), xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)]


def _majority(pieces: Iterable[np.ndarray], words: int) -> list[int]:
    total, counts = 0, np.zeros((words, 64), np.int64)
    for values in pieces:
        total += len(values)
        for w in range(words):
            part = values
            for _ in range(w):
                part = mix64(part + np.uint64(0x9E3779B97F4A7C15))
            for lo in range(0, len(part), 1 << 16):
                bits = np.unpackbits(part[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts[w] += bits.sum(axis=0, dtype=np.int32)
    bit = 1 << np.arange(64, dtype=object)
    return [int(bit[2 * row > total].sum()) if total else 0 for row in counts]


def fingerprints(docs: DataFrame, key: list[str], text: str = "text", k: int = 4, words: int = 1, sets: bool = False) -> DataFrame:
    """`key` columns and `fp`, 16 lower-case hex digits for each word of the fingerprint. Null texts count as empty: zero.
    `sets`: of the sets of shingles, with a hash of the set and its size as the last words."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    docs = docs.select(*key, F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("fp", T.StringType())])
    of = set_fingerprint if sets else fingerprint

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ["".join(f"{x:016x}" for x in of(t.as_py() or b"", k, words)) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], "fp"])

    return docs.mapInArrow(lean(run), schema)


def plan_tiles(cells: np.ndarray, counts: np.ndarray, radius: int, size: int = TILE, flat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 17^4 cells its first tile and number of tiles, and the pairs (i <= j) of tiles to compare. A cell is four counts, or, if
    `flat`, one number."""
    size = max(size, int(counts.sum()) // (MAX_TILES // 2))
    at = cells[:, None] if flat else np.stack([cells // 17**3, cells // 289 % 17, cells // 17 % 17, cells % 17], 1).astype(np.int64)
    first, number = np.zeros(17**4, np.int32), np.ones(17**4, np.int32)
    low, high, todo = [], [], [np.arange(len(cells))] if len(cells) else []
    while todo:
        own = todo.pop()
        lo, hi = at[own].min(0), at[own].max(0)
        if counts[own].sum() > size and (hi > lo).any():
            d = int((hi - lo).argmax())
            own = own[np.argsort(at[own, d], kind="stable")]
            half = np.searchsorted(np.cumsum(counts[own]), counts[own].sum() / 2)
            v = at[own[half], d]
            left = at[own, d] < v if v > lo[d] else at[own, d] <= v
            todo += [own[left], own[~left]]
            continue
        n = -(-int(counts[own].sum()) // size) if len(own) == 1 else 1
        first[cells[own]], number[cells[own]] = len(low), n
        low += [lo] * n
        high += [hi] * n
    if not low:
        return first, number, np.zeros((0, 2), np.int64)
    low, high, pairs = np.array(low), np.array(high), []
    for i in range(len(low)):
        apart = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:])).sum(1)
        j = np.flatnonzero(apart <= radius) + i
        pairs.append(np.stack([np.full(len(j), i), j], 1))
    return first, number, np.concatenate(pairs)


def _parts(word: np.ndarray) -> np.ndarray:
    count = lambda s: np.bitwise_count((word >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64)
    return ((count(0) * 17 + count(16)) * 17 + count(32)) * 17 + count(48)


#: Bins of set sizes for each doubling, and by how many the bins of sets of similarity 0.8 differ at most (a bin is 1/32 of its sizes at least).
BINS, BIN_REACH = 16, 8


def _size_bin(n: np.ndarray) -> np.ndarray:
    e = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1  # exact below 2^53
    return np.where(n > 0, e * BINS + ((n.astype(np.int64) * BINS >> np.maximum(e, 0)) & (BINS - 1)), 0)


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of n points, over links that come in portions; `label`: as far as it is known."""
    label = np.arange(n) if label is None else label.copy()
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (jump := label[label]).tobytes() != label.tobytes():
                label = jump
    return label


def compare(one: np.ndarray, other: np.ndarray | None, radius: int, first: int | None = None, words: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row indices (into one, into other) of fingerprints at most `radius` bits apart, and in the first word at most `first`; other
    None: within one. Words after the first `words` don't count."""
    right, first, words = one if other is None else other, radius if first is None else first, words or one.shape[1]
    for lo in range(0, len(one), ROWS):
        left = one[lo : lo + ROWS]
        for at in range(lo if other is None else 0, len(right), COLUMNS):
            part = right[at : at + COLUMNS]
            a, b = np.nonzero(np.bitwise_count(left[:, 0, None] ^ part[None, :, 0]) <= first)
            if words > 1 and len(a):
                ok = np.bitwise_count(left[a, :words] ^ part[b, :words]).sum(1) <= radius
                a, b = a[ok], b[ok]
            yield a + lo, b + at


def links(nodes: DataFrame, radius: int, words: int = 1, tile: int = TILE, first_radius: int | None = None, more: int = 0, sized: bool = False) -> DataFrame:
    """Spanning links (a, b) between the different fingerprints `fp` of `nodes`, at most `radius` bits apart and in the first word at most
    `first_radius`. `fp` ends with `more` words that don't count; if `sized`, the last is a size, and sizes far apart need not be linked."""
    spark, width = nodes.sparkSession, words + more
    near = radius if first_radius is None else first_radius
    part = lambda lo: F.bit_count(F.conv(F.substring("fp", lo, 4), 16, 10).cast("int"))
    cell = ((part(13) * 17 + part(9)) * 17 + part(5)) * 17 + part(1)
    if sized:
        n = "CAST(conv(substring(fp, -16, 16), 16, 10) AS BIGINT)"
        cell = F.expr(f"CASE WHEN {n} = 0 THEN 0 ELSE (length(bin({n})) - 1) * {BINS} + (shiftright({n} * {BINS}, length(bin({n})) - 1) & {BINS - 1}) END")
    seen = nodes.groupBy(cell.alias("cell")).count().collect()  # 17^4 rows at most
    cells, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], np.int64)
    first, number, pairs = plan_tiles(cells, counts, BIN_REACH if sized else near, tile, sized)
    goes: dict[int, list[tuple[int, bool]]] = {}
    group, of, left = -1, -1, 0
    for i, j in pairs.tolist():
        if i != of or not left:
            group, of, left = group + 1, i, PARTNERS
            goes.setdefault(i, []).append((group, True))
        left -= 1
        if j != i:
            goes.setdefault(j, []).append((group, False))
    within = {}  # the group in which a tile meets itself
    for i in goes:
        within[i] = min(g for g, own in goes[i] if own)
    plan = spark.sparkContext.broadcast((first, number, goes, {g: i for i, g in within.items()}))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // (8 * tile) + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, _, _ = plan.value
        for b in batches:
            f = np.array([int(x[i : i + 16], 16) for x in b.column(0).to_pylist() for i in range(0, 16 * width, 16)], np.uint64).reshape(-1, width)
            c = _size_bin(f[:, -1]) if sized else _parts(f[:, 0])
            t = first[c] + (mix64(f[:, 0] ^ np.uint64(99)) % number[c].astype(np.uint64)).astype(np.int64)
            order = np.argsort(t, kind="stable")
            f, t = f[order], t[order]
            cut = np.flatnonzero(np.diff(t, prepend=-1, append=-1))
            yield pa.RecordBatch.from_arrays([pa.array(t[cut[:-1]], pa.int64()), pa.array([f[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["tile", "fps"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goes, have = plan.value[2], {}
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                have.setdefault(t, []).append(x)
        for t, xs in have.items():
            to, blob = goes[t], b"".join(sorted(xs))
            points = np.frombuffer(blob, np.uint64).reshape(-1, width)
            blob += forest(len(points), compare(points, None, radius, near, words)).astype("<u8").tobytes()
            for lo in range(0, len(to), 64):
                some = to[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in some], pa.int64()), pa.array([own for _, own in some]), pa.array([blob] * len(some), pa.binary())], names=["pairs", "own", "fps"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selfish, key, own = plan.value[3], None, None
        hexed = lambda f: pa.array(["".join(f"{v:016x}" for v in row) for row in f.tolist()], pa.string())

        def back(x: bytes) -> tuple[np.ndarray, np.ndarray]:
            """A tile's points and the roots of the trees they are in."""
            n = len(x) // (8 * width + 8)
            return np.frombuffer(x, np.uint64, n * width).reshape(-1, width), np.frombuffer(x, "<i8", n, 8 * width * n)

        def report(points: np.ndarray, old: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
            child = np.flatnonzero(new != old)
            return pa.RecordBatch.from_arrays([hexed(points[child]), hexed(points[new[child]])], names=["a", "b"])

        for batch in batches:  # by key, the own tile first
            for g, is_own, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_own:
                    key, own = g, back(x)
                    if g in selfish:
                        yield report(own[0], np.arange(len(own[0])), own[1])
                else:
                    assert g == key
                    other = back(x)
                    points, old = np.concatenate([own[0], other[0]]), np.concatenate([own[1], other[1] + len(own[0])])
                    new = forest(len(points), ((a, b + len(own[0])) for a, b in compare(own[0], other[0], radius, near, words)), old)
                    roots = np.flatnonzero(old == np.arange(len(old)))
                    yield report(points[roots], np.arange(len(roots)), np.searchsorted(roots, new[roots]))

    tiles = nodes.select("fp").mapInArrow(lean(deal), "tile long, fps binary").repartition(n, "tile").mapInArrow(lean(gather), "pairs long, own boolean, fps binary")
    return tiles.repartition(n, "pairs").sortWithinPartitions("pairs", F.col("own").desc()).mapInArrow(lean(meet), "a string, b string")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an undirected graph: root is the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label of that label; it is written to the
    shared folder, and the loop ends with the round that changes nothing."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = materialize(e.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "labels")
    while True:
        near = e.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        low = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = materialize(low.join(jump, "root").select("node", F.least("root", "above").alias("root"), (F.least("root", "above") != F.col("was")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(label)
        label = new
        if not moved:
            discard(e)
            return label.select("node", "root")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4, words: int = 1, also: list[str] | None = None) -> DataFrame:
    """`ident`, `fp` (hex) and `component_id`, one row for each row of `docs`: the smallest ident of the texts that links
    of at most `radius` bits reach, the row itself included.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay, each with its component.
    A null ident is larger than any other: its row gets null only if nothing it reaches has an ident.
    An empty table gives an empty result. `also` names further columns to carry."""
    key = [ident, *(also or [])]
    marks = materialize(fingerprints(docs, key, text, k, words), "fingerprints")
    nodes = materialize(marks.groupBy("fp").agg(F.min(ident).alias("least_id")), "nodes")
    roots = components(links(nodes, radius, words))
    joined = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = materialize(joined.groupBy("root").agg(F.min("least_id").alias("component_id")), "lowest")  # a table, so that the join may split a large component
    member = materialize(joined.join(lowest, "root").select("fp", "component_id"), "members")
    return marks.join(member, "fp").select(*key, "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


#: Of the pipeline's stage: five-word shingles, and the least similarity (Jaccard) of near copies, as a fraction.
STAGE_K, SIMILAR = 5, (4, 5)
#: Its search: four words of fingerprint. At a similarity of 0.8 the cosine of two sets is 1.6 / 1.8 or more, so a bit differs with probability
#: 0.1515 (0.1875 for sets of four and five shingles, the worst case): 39 to 48 of 256 bits. The radii are four deviations above the worst case.
STAGE_WORDS, STAGE_RADIUS, STAGE_FIRST = 4, 76, 24
#: Texts of a candidate group that are compared in one place.
GROUP = 64


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets reach the similarity SIMILAR."""
    num, den = SIMILAR
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * den >= num * (len(a) + len(b) - common)


def agree(dealt: DataFrame) -> DataFrame:
    """Verified links (a, b) of `dealt` (root, part, node, sub, own, set): in each (root, part) all pairs are compared of which one at least is its
    own, but for those that `sub` or links found before join already."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            up = {sub: sub for _, sub, _, _ in group}

            def top(x: str) -> str:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            out = []
            for i, (node, sub, own, values) in enumerate(group):
                for other, sub2, own2, values2 in group[:i]:
                    if (own or own2) and (x := top(sub)) != (y := top(sub2)) and similar(values, values2):
                        up[max(x, y)] = min(x, y)
                        out.append((node, other))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["a", "b"])

        key, group = None, []
        for b in batches:
            for root, part, node, sub, own, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (root, part):
                    yield finish()
                    key, group = (root, part), []
                group.append((node, sub, own, np.frombuffer(values, np.uint64)))
        yield finish()

    dealt = dealt.select("root", "part", "node", "sub", "own", "set").repartition(n, "root", "part").sortWithinPartitions("root", "part", F.col("node") != F.col("root"), "node")
    return dealt.mapInArrow(lean(run), "a string, b string")


def verified(docs: DataFrame, marks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Links (a, b) that join the texts of each candidate group `found` (node, root) as far as pairs of similar sets join them.

    A group of over GROUP texts is dealt into parts. Each part compares its own texts and the group's root; then what is not joined to
    the largest portion of its group goes to all parts, so that each pair has met or is joined."""
    size = found.groupBy("root").agg(F.count("*").alias("size"))
    rows = found.join(marks.groupBy(F.col("fp").alias("node")).agg(F.min("__own").alias("__own")), "node").join(size, "root")
    rows = rows.withColumn("parts", F.expr(f"(size - 1) div {GROUP} + 1")).withColumn("mine", F.pmod(F.xxhash64("node"), "parts")).drop("size")
    rows = rows.join(docs.select("__own", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")), "__own").drop("__own").dropDuplicates(["node"])
    rows = rows.select("node", "root", "parts", "mine", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([shingle_set(t.as_py(), k).tobytes() for t in b.column(4)], pa.binary())], names=[*b.schema.names[:-1], "set"])

    sets = materialize(rows.mapInArrow(lean(run), "node string, root string, parts long, mine long, set binary"), "sets")
    deal = lambda df, wide: df.withColumn("part", F.explode(F.when(wide, F.expr("sequence(0L, parts - 1)")).otherwise(F.array("mine")))).withColumn("own", F.col("part") == F.col("mine"))
    one = materialize(agree(deal(sets.withColumn("sub", F.col("node")), F.col("node") == F.col("root"))), "agree")
    large = sets.where("parts > 1")
    if large.isEmpty():
        return one
    subs = components(one).select("node", F.col("root").alias("sub"))
    large = large.select("node", "root").join(subs, "node", "left").withColumn("sub", F.coalesce("sub", "node"))
    portion = large.groupBy("root", "sub").agg(F.count("*").alias("n"))
    main = portion.groupBy("root").agg(F.max(F.struct("n", "sub")).alias("most"), F.count("*").alias("subs")).where("subs > 1").select("root", F.col("most.sub").alias("main"))
    rest = materialize(large.join(main, "root").select("node", "sub", (F.col("sub") != F.col("main")).alias("wide")), "rest")
    return one.unionByName(agree(deal(sets.join(rest, "node"), F.col("wide"))))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, __own and component_id of each row of `docs` (doc_id, text, __own): texts of the same set of shingles, or joined by pairs of
    texts whose sets are similar, share a component."""
    marks = materialize(fingerprints(docs, ["doc_id", "__own"], "text", STAGE_K, STAGE_WORDS, sets=True), "fingerprints")
    nodes = materialize(marks.select("fp").distinct(), "nodes")
    found = components(links(nodes, STAGE_RADIUS, STAGE_WORDS, first_radius=STAGE_FIRST, more=2, sized=True))
    roots = components(verified(docs, marks, found, STAGE_K))
    return marks.join(roots, marks.fp == roots.node, "left").select("doc_id", "__own", F.coalesce("root", "fp").alias("component_id"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; of rows that share that id and text, one."""
    own = F.concat_ws(":", F.xxhash64(*docs.columns).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keyed = docs.withColumn("__own", own)
    groups = near_copies(keyed.select("doc_id", "text", "__own"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__own")).alias("best")
    stay = groups.groupBy("component_id").agg(best).select(F.col("best.__own").alias("__own"))
    return keyed.join(stay, "__own", "left_semi").dropDuplicates(["__own"]).select(*docs.columns)
