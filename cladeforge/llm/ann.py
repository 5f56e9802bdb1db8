"""Nearest neighbours by randomly rotated one-bit codes (Gao and Long 2024).

Vectors are centred, scaled to length one and rotated; a code keeps the signs, packed to bits, and two correction
scalars. A query's inner product with a vector is estimated from the packed bits of the code and of the query's
bit planes; the estimate's error is bounded with a chosen confidence. Only vectors whose smallest possible
distance reaches the query's present k-th best are reranked, on the original vectors in double precision.

Vectors are encoded once, in tiles of about `TILE_BYTES` that are written to the shared folder with their codes. Tiles are dealt into groups of about
`GROUP_BYTES`; the queries of each tile form a block, and each block visits each group. A task holds its group, streams the
blocks past it and returns each query's k best of the group. Nothing is broadcast, and the driver holds one mean for each number of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cladeforge.llm.common import lean, materialize, partitions, small_batches, table

K, EVERY = 10, 100
#: Standard deviations of the estimate that its error bound covers; bits of a query's coordinates.
CONFIDENCE, QUERY_BITS = 5.0, 6
TILE_BYTES, GROUP_BYTES, ROWS = 1 << 20, 32 << 20, 4096
#: Rows that the codes' centre is the mean of, about: a sample, as any centre gives valid bounds.
CENTRE_ROWS = 10_000
SEED = 7


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same dimension."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED + dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (n, ceil(dim / 64)) as unsigned 64-bit words, distances from the centre, and products of code and vector."""
    dim = x.shape[1]
    y = (x - centre) @ turn
    norm = np.sqrt((y * y).sum(1))
    bits = y > 0
    unit = np.abs(y).sum(1) / np.sqrt(dim) / np.where(norm > 0, norm, 1)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -dim % 64))), axis=1, bitorder="little").view(np.uint64)
    return packed, norm, np.where(norm > 0, unit, 1.0)


class Queries:
    """A block of queries: what estimates need, and the best candidates so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> None:
        """`rows`: the queries' own rows, which are no candidates of theirs."""
        self.rows, self.vectors, self.k, self.dim = rows, vectors, k, vectors.shape[1]
        y = (vectors - centre) @ turn
        self.norm = np.sqrt((y * y).sum(1))
        y = y / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.low = y.min(1)
        self.step = np.maximum((y.max(1) - self.low) / (2**QUERY_BITS - 1), 1e-300)
        level = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.uint64)
        self.sum = level.sum(1).astype(np.float64)
        pad = np.pad(level, ((0, 0), (0, -self.dim % 64)))
        self.planes = [np.packbits((pad >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(QUERY_BITS)]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in rows]
        self.reach = np.full(len(rows), np.inf)

    def lower_bounds(self, codes: np.ndarray, norm: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Squared distances (query, vector) that the true ones are not below, with the chosen confidence."""
        ones = np.bitwise_count(codes).sum(1).astype(np.float64)
        hit = np.zeros((len(self.rows), len(codes)))
        for b, plane in enumerate(self.planes):
            both = sum(np.bitwise_count(plane[:, None, w] & codes[None, :, w]).astype(np.float64) for w in range(codes.shape[1]))
            hit += both * (1 << b)
        root = np.sqrt(self.dim)
        product = (2 * (self.step[:, None] * hit + self.low[:, None] * ones) - (self.step * self.sum + self.low * self.dim)[:, None]) / root
        error = np.sqrt(np.maximum(1 - unit**2, 0) / unit**2) * CONFIDENCE / np.sqrt(max(self.dim - 1, 1)) + 0.5 * self.step[:, None] * root / unit
        top = np.minimum(product / unit + error, 1.0)
        return norm**2 + self.norm[:, None] ** 2 - 2 * norm * self.norm[:, None] * top

    def offer(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, unit: np.ndarray) -> None:
        bound = self.lower_bounds(codes, norm, unit)
        if np.isinf(self.reach).any():  # the most promising first, so that the bound can work
            near = np.argpartition(bound, min(4 * self.k, bound.shape[1]) - 1, axis=1)[:, : 4 * self.k]
            q = np.repeat(np.arange(len(self.rows)), near.shape[1])
            self._rerank(q, near.ravel(), rows, ids, x)
            bound[q, near.ravel()] = np.inf
        slack = 1e-9 * (1 + self.reach**2)
        q, r = np.nonzero((bound <= (self.reach**2 + slack)[:, None]) & ~np.isposinf(bound))
        for lo in range(0, len(q), 1 << 18):
            self._rerank(q[lo : lo + (1 << 18)], r[lo : lo + (1 << 18)], rows, ids, x)

    def _rerank(self, q: np.ndarray, r: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        keep = rows[r] != self.rows[q]
        q, r = q[keep], r[keep]
        total = np.zeros(len(q))
        for d in range(self.dim):
            total += (self.vectors[q, d] - x[r, d]) ** 2
        score = np.sqrt(total)
        order = np.lexsort((ids[r], score, q))
        q, r, score = q[order], r[order], score[order]
        cut = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            i, hi = q[lo], min(hi, lo + self.k)
            s, v = np.concatenate([self.best[i][0], score[lo:hi]]), np.concatenate([self.best[i][1], ids[r[lo:hi]]])
            top = np.lexsort((v, s))[: self.k]
            self.best[i] = s[top], v[top]
            if len(top) == self.k:
                self.reach[i] = s[top[-1]]


def search(vectors: DataFrame, is_query: F.Column, ident: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest rows of each query row by Euclidean distance, ties to the smaller ident.

    A query row is no candidate of itself. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without ident, take no part. Vectors meet those of their own length only. Repeated rows and idents are queries and candidates each: a copy
    of a query's row is its neighbour at distance 0. `vectors` may have further columns of any name. An empty table gives an empty result."""
    spark = small_batches(vectors.sparkSession)
    single = isinstance(vectors.select(vector).schema[0].dataType.elementType, T.FloatType)
    kind = "float" if single else "double"
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.exists("v", lambda x: x != 0))
    n, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)) * (4 if single else 8)).first()
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // CENTRE_ROWS))) == 0)
    means = sample.select(F.size("v").alias("d"), F.posexplode(F.col("v").cast("array<double>"))).groupBy("d", "pos").agg(F.avg("col")).collect()
    centres: dict[int, np.ndarray] = {}
    for d, pos, mean in means:
        centres.setdefault(d, np.zeros(d))[pos] = mean
    n_groups, dtype = partitions(spark, n_bytes, GROUP_BYTES), "<f4" if single else "<f8"
    turns: dict[int, np.ndarray] = {}

    def frame(dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in turns:
            turns[dim] = rotation(dim)
        return centres.get(dim, np.zeros(dim)), turns[dim]

    names = ["dim", "row", "vec_id", "q", "v", "codes", "norm", "unit"]

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, row, q = b.column(0).to_numpy(), b.column(1).offsets.to_numpy(), b.column(3).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            flat, dims = b.column(1).values.to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                own, step = np.flatnonzero(dims == dim), max(1, min(ROWS, TILE_BYTES // (flat.itemsize * dim)))
                for lo in range(0, len(own), step):
                    i = own[lo : lo + step]
                    x = flat[at[i][:, None] + np.arange(dim)]
                    codes, norm, unit = encode(x.astype(np.float64), *frame(dim))
                    blobs = (a.tobytes() for a in (row[i], ids[i], q[i], x.astype(dtype), codes, norm, unit))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    def load(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for dim, *blobs in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            row, ids, q, v, codes, norm, unit = (np.frombuffer(x, t) for x, t in zip(blobs, ("<i8", "<i8", bool, dtype, "<u8", "<f8", "<f8"), strict=True))
            yield dim, row, ids, q, v.reshape(-1, dim), codes.reshape(-1, -(-dim // 64)), norm, unit

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each tile, for every group."""
        for b in batches:
            for dim, row, ids, q, v, *_ in load(b):
                if q.any():
                    blobs, m = [row[q].tobytes(), ids[q].tobytes(), b"", v[q].tobytes(), b"", b"", b""], n_groups
                    for lo in range(0, m, 256):
                        g = np.arange(lo, min(m, lo + 256))
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array([1] * len(g), pa.int32()), pa.array([dim] * len(g), pa.int32()), *(pa.array([x] * len(g), pa.binary()) for x in blobs)], names=["g", "kind", *names])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, g = {}, None
        for b in batches:  # by group, its tiles first
            for part, at, asks in zip(load(b), b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at != g:
                    own, g = {}, at
                if not asks:
                    own.setdefault(part[0], []).append(part[1:])
                    continue
                dim, row, ids, _, v, *_ = part
                if dim not in own:
                    continue
                queries = Queries(row, v.astype(np.float64), *frame(dim), k)
                for r, i, _, x, codes, norm, unit in own[dim]:
                    queries.offer(r, i, x.astype(np.float64), codes, norm, unit)
                m = [len(s) for s, _ in queries.best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, m)), pa.array(np.repeat(ids, m)), pa.array(np.concatenate([y for _, y in queries.best])), pa.array(np.concatenate([s for s, _ in queries.best]))], names=["row", "query_id", "vec_id", "score"])

    schema = "dim int, row binary, vec_id binary, q binary, v binary, codes binary, norm binary, unit binary"
    tiles = materialize(rows.withColumn("row", F.monotonically_increasing_id()).select("vec_id", "v", "q", "row").mapInArrow(lean(tile), schema), "tiles")
    held = tiles.select(F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("long").alias("g"), F.lit(0).alias("kind"), *names)
    asked = tiles.mapInArrow(lean(ask), "g long, kind int, " + schema)
    met = held.unionByName(asked).repartition(n_groups, "g").sortWithinPartitions("g", "kind").mapInArrow(lean(near), "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("row").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_OP4 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
good AS (SELECT *, row_number() OVER () AS r FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
met AS (SELECT q.r, q.vec_id AS query_id, g.vec_id, sqrt(list_reduce(list_transform(range(1, len(g.e) + 1), lambda i: (q.e[i] - g.e[i]) * (q.e[i] - g.e[i])), lambda a, b: a + b)) AS score
        FROM good q JOIN good g ON q.vec_id % {EVERY} = 0 AND q.r <> g.r AND len(q.e) = len(g.e)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS INTEGER) AS rank FROM met)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
