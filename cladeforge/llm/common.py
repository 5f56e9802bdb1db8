"""What the operators share: the scratch folder, written tables, byte-level text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cladeforge.sources.storage import discard, scratch_path, shared_dir, written as materialize  # noqa: F401

#: The bytes of `[\x20\x09-\x0D]`.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same class as a pattern for words, for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch; texts of some kilobytes make the default of 10,000 rows tens of megabytes in each of four buffers.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
_ARROW_ROWS, _ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batches where they are larger, so that a Python worker's memory stays small."""
    if int(spark.conf.get(_ARROW_ROWS)) == 10_000:
        spark.conf.set(_ARROW_ROWS, BATCH_ROWS)
    with contextlib.suppress(Exception):  # older versions of Spark have rows only
        if _bytes(spark.conf.get(_ARROW_BYTES)) > BATCH_BYTES:
            spark.conf.set(_ARROW_BYTES, BATCH_BYTES)
    return spark


def _bytes(size: str) -> int:
    """Bytes of a size as Spark's settings give it."""
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(size.lower().rstrip("b")[-1:], 0)
    return int(size.lower().rstrip("kmgtb")) << unit


def partitions(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Enough partitions that each handles about `each` bytes, and never fewer than the session shuffles to."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of an Arrow string or binary column and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offs[-1] - offs[0])
    return (np.frombuffer(data, np.uint8, size, int(offs[0])) if size else np.zeros(0, np.uint8)), offs - offs[0]


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that ends by giving free memory back to the system; an idle Python worker would keep it."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def row_blocks(offsets: np.ndarray, limit: int):
    """(first, after) row ranges of about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the rolling-hash base and its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n >> 20) << 20 if n > 1 << 20 else max(n, 2 * len(self.up))
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


def prefix_hash(data: np.ndarray, powers: Powers, salt: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial hash: the hash of data[a:b] is (p[b] - p[a]) * down[a]."""
    up, _ = powers.get(len(data) + 1)
    values = _BYTE if not salt else mix64(_BYTE + np.uint64(salt))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers.get(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


SLICE = 1 << 20


def slices(start: np.ndarray, end: np.ndarray, extent: int = SLICE) -> Iterator[tuple[int, int, int, int]]:
    """(first, after, low, high): runs of spans (in order) that lie within `extent` bytes, and those bytes; a longer span is a run by itself."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + extent, "right")))
        yield i, j, int(start[i]), int(end[j - 1])
        i = j


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers, extent: int = SLICE) -> np.ndarray:
    """A hash of each of many spans (in order, none inside another), slice by slice, so that little is held beside the result."""
    out = np.empty(len(start), np.uint64)
    for i, j, lo, hi in slices(start, end, extent):
        if hi - lo > extent:
            out[i] = xxhash.xxh64_intdigest(data[lo:hi].tobytes())
        else:
            out[i:j] = span_hash(prefix_hash(data[lo:hi], powers), powers, start[i:j] - lo, end[i:j] - lo)
    return out


def span_chars(data: np.ndarray, start: np.ndarray, end: np.ndarray, extent: int = SLICE) -> np.ndarray:
    """The number of code points in each span (in order, none inside another)."""
    out = np.empty(len(start), np.int64)
    for i, j, lo, hi in slices(start, end, extent):
        heads = np.zeros(hi - lo + 1, np.int32)
        np.cumsum((data[lo:hi] & 0xC0) != 0x80, out=heads[1:])
        out[i:j] = heads[end[i:j] - lo] - heads[start[i:j] - lo]
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word `[^\\x20\\x09-\\x0D]+`; words end with their document."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_IS_SPACE[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
