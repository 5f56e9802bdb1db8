"""Token-id files: every document compressed by itself, with one shared zstandard dictionary.

A file is a row of segments. A segment holds a header, the documents' idents, their token counts, an offset index and
one zstandard frame for each document, so that a short document is read without its neighbours. The dictionary
is trained on the serialized ids of a bounded sample and stored beside the files; each segment names it by SHA-256.

Layout, little-endian: magic `CFTK0001`; dictionary SHA-256 (32 bytes); segment length, number of documents (u64 each);
idents (i64 each); null flags (u8 each); token counts (u64 each); offsets of frames (u64 each, one more than documents);
frames; a line feed. A frame holds ids as u32.

Files are written by Spark's text writer, which passes a string's bytes through: any Hadoop file system, committed by task.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cladeforge.llm.common import Powers, lean, materialize, partitions, prefix_hash, row_blocks, scratch_path, small_batches, span_hash, table, text_bytes

MAGIC, END_ID = b"CFTK0001", 2
#: The dictionary: documents and characters of each that it is trained on, and its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 20_000, 64 << 10
PARTITION_BYTES, SEGMENT_BYTES, BLOCK_BYTES, LEVEL = 24 << 20, 4 << 20, 4 << 20, 1
CACHE_PIECES = 1_500_000
#: Pieces of one word after a space: any, and with marks behind letters.
_PLAIN, _ENDED = re.compile(rb" ?(?:[!-~]|[\xc3-\xc9][\x80-\xbf])+").fullmatch, re.compile(rb"( ?[a-zA-Z]+)([.,;:!?#$%&*|]+)").fullmatch
_MARKS = b".,;:!?#$%&*|"
#: Bytes that may follow a space at which a text is cut: neither white space nor the first byte of one.
_AFTER_SPACE = np.ones(256, bool)
_AFTER_SPACE[[*range(33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_BEFORE_FEED = np.zeros(256, bool)
_BEFORE_FEED[33:127] = True


class Encoder:
    """A byte-level BPE tokenizer that remembers the ids of the pieces it has met.

    Pre-tokens of the byte-level pattern never reach across the place before a space that a non-space follows, so a text's ids are
    those of the pieces between such places, and between a line feed and the non-spaces around it. Places are found in a batch's bytes; equal pieces of a batch meet by a 64-bit hash, and each different
    one is looked up once by its bytes. New pieces are encoded together, separated by line feeds, which stand alone as pre-tokens there;
    pieces with other white space are encoded one by one. Added tokens, such as `<|endoftext|>`, part a text before all else: what stands between them
    is encoded like a text of its own. A worker keeps what it has learnt for its next tasks, up to CACHE_PIECES."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept = sys.modules.setdefault("_cladeforge_encoders", type(sys)("_cladeforge_encoders")).__dict__
        if path not in kept:
            tok = Tokenizer.from_file(path)
            added = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in tok.get_added_tokens_decoder().items()}
            kept[path] = (tok, {}, Powers(), added, re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) or b"(?!)"))
        self.tok, self.known, self.powers, self.added, self.special = kept[path]
        self.feed = self._ids("\n")

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces."""
        known = self.known
        plain, rest = [], []
        ended = []
        for p in pieces:
            if p[-1] in _MARKS and (m := _ENDED(p)):
                ended.append((p, m[1], m[2]))
            elif _PLAIN(p):
                plain.append(p)
            else:
                rest.append(p)
        plain += dict.fromkeys(x for _, w, m in ended for x in (w, m) if x not in known)  # a word and marks, which no pre-token joins
        for lo in range(0, len(plain), 128):
            some = plain[lo : lo + 128]
            text = b"\n".join(some) + b"\n"
            ids = np.array(self._ids(text.decode()), "<u4")
            cut = np.flatnonzero(ids == self.feed[0])
            if len(self.feed) == 1 and len(cut) == len(some):
                raw, at = ids.tobytes(), (4 * cut).tolist()
                known.update(zip(some, [raw[a:z] for a, z in zip([0, *(x + 4 for x in at[:-1])], at, strict=True)], strict=True))
            else:
                rest += some
        if rest:
            for p, e in zip(rest, self.tok.encode_batch([p.decode() for p in rest], add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<u4").tobytes()
        known.update((p, known[w] + known[m]) for p, w, m in ended)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, end: bytes = b"") -> list[bytes]:
        """The ids of each text (concatenated UTF-8 and offsets), as little-endian unsigned 32-bit integers, each text closed by `end`."""
        if self.special.search(data):
            return self._parted(data, offsets, end)
        return self._plain(data, offsets, end)

    def giant(self, data: np.ndarray, limit: int) -> list[np.ndarray]:
        """The parts of a long text, of about `limit` bytes each, cut where pre-tokens end: before a space that a non-space follows. Added tokens hold no space."""
        parts, at = [], 0
        while len(data) - at > limit:
            cut = at + limit
            while cut < len(data) - 1:
                near = data[cut : cut + (1 << 16) + 1]
                hit = np.flatnonzero((near[:-1] == 32) & _AFTER_SPACE[near[1:]])
                if len(hit):
                    break
                cut += 1 << 16
            else:
                break
            parts.append(data[at : cut + int(hit[0])])
            at = cut + int(hit[0])
        return [*parts, data[at:]]

    def _plain(self, data: np.ndarray, offsets: np.ndarray, end: bytes = b"") -> list[bytes]:
        """encode_bytes() for texts without added tokens."""
        if not len(data):
            return [end] * (len(offsets) - 1)
        if len(self.known) > CACHE_PIECES:  # the common pieces are among the first
            first = dict(islice(self.known.items(), CACHE_PIECES // 4))
            self.known.clear()
            self.known.update(first)
        mark = np.zeros(len(data), bool)
        space = np.flatnonzero(data[:-1] == 32)
        mark[space[_AFTER_SPACE[data[space + 1]]]] = True
        feed = np.flatnonzero(data[1:-1] == 10) + 1
        feed = feed[_BEFORE_FEED[data[feed - 1]] & _AFTER_SPACE[data[feed + 1]]]
        ends = np.zeros(len(data) + 1, bool)
        ends[offsets] = True
        feed = feed[~ends[feed] & ~ends[feed + 1]]
        mark[feed] = mark[feed + 1] = True
        mark[offsets[1:-1][offsets[1:-1] > 0] - 1] = False  # a space that ends its text
        mark[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(mark)
        stop = np.append(start[1:], len(data))
        key = span_hash(prefix_hash(data, self.powers), self.powers, start, stop)
        order = np.argsort(key)
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        first, place = order[new], np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        raw = data.tobytes()
        own = [raw[a:z] for a, z in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        ids = list(map(self.known.get, own))
        if None in ids:
            self.learn([p for p, x in zip(own, ids, strict=True) if x is None])
            ids = list(map(self.known.__getitem__, own))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = (np.cumsum(size) - size)[place]
        flat, count = np.frombuffer(b"".join(ids), "<u4"), size[place]
        before = np.cumsum(count) - count
        out = flat[np.repeat(at - before, count) + np.arange(int(count.sum()))].tobytes()
        edge = 4 * np.append(before, len(out) // 4)[np.searchsorted(start, offsets)]
        return [out[a:z] + end for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _parted(self, data: np.ndarray, offsets: np.ndarray, end: bytes) -> list[bytes]:
        """encode_bytes() for texts that hold added tokens."""
        raw, edge = data.tobytes(), offsets.tolist()
        kept, cuts, marks = [], [0], []  # bytes without added tokens, their ends, and for each part its text and what follows it
        for i, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            at = a
            for m in [*self.special.finditer(raw, a, z), None]:
                kept.append(raw[at : m.start() if m else z])
                cuts.append(cuts[-1] + len(kept[-1]))
                marks.append((i, self.added[m[0]] if m else end))
                at = m.end() if m else z
        out: list[list[bytes]] = [[] for _ in edge[1:]]
        rest = np.frombuffer(b"".join(kept), np.uint8)
        # without its tokens a text may read as one anew: such a token lies across parts, so each part is safe by itself
        parts = self._plain(rest, np.array(cuts, np.int64))
        for (i, mark), ids in zip(marks, parts, strict=True):
            out[i] += [ids, mark]
        return list(map(b"".join, out))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_bytes(*text_bytes(pa.array(texts, pa.string())))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; of too few samples, their bytes themselves."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _coders(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A compressor and a decompressor; a process keeps those of its last dictionary."""
    kept = sys.modules.setdefault("_cladeforge_coders", type(sys)("_cladeforge_coders"))
    if getattr(kept, "dictionary", None) != dictionary:
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        kept.coders = zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)
        kept.dictionary = dictionary
    return kept.coders


def pack_segment(rows: list[tuple[int | None, int, bytes]], dictionary: bytes) -> bytes:
    """A segment of (ident, number of ids, frame); the line feed that closes it is the writer's."""
    n = len(rows)
    idents = np.array([r[0] or 0 for r in rows], "<i8").tobytes() + np.array([r[0] is None for r in rows], "<u1").tobytes()
    counts = np.array([r[1] for r in rows], "<u8").tobytes()
    head = len(MAGIC) + 32 + 16 + 9 * n + 8 * n + 8 * (n + 1)
    offsets = np.cumsum([head] + [len(r[2]) for r in rows]).astype("<u8")
    return b"".join([MAGIC, hashlib.sha256(dictionary).digest(), np.array([int(offsets[-1]), n], "<u8").tobytes(), idents, counts, offsets.tobytes(), *(r[2] for r in rows)])


class Segment:
    """A segment at `at` in a file's bytes; documents are read one by one through the offset index."""

    def __init__(self, data: bytes | memoryview, dictionary: bytes, at: int = 0) -> None:
        self.data = memoryview(data)[at:]
        if self.data[:8] != MAGIC:
            raise ValueError("not a token segment")
        if self.data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        self.dictionary = dictionary
        size, n = np.frombuffer(self.data, "<u8", 2, 40).tolist()
        self.end, at = at + size + 1, 56
        self.idents = np.frombuffer(self.data, "<i8", n, at)
        self.null = np.frombuffer(self.data, "<u1", n, at + 8 * n)
        self.counts = np.frombuffer(self.data, "<u8", n, at + 9 * n)
        self.offsets = np.frombuffer(self.data, "<u8", n + 1, at + 17 * n)

    def ids(self, i: int) -> bytes:
        lo, hi = int(self.offsets[i]), int(self.offsets[i + 1])
        return _coders(self.dictionary)[1].decompress(self.data[lo:hi], max_output_size=4 * int(self.counts[i]) or 1)


def segments(data: bytes, dictionary: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(data):
        s = Segment(data, dictionary, at)
        yield s
        at = s.end


def write_files(docs: DataFrame, path: str, tokenizer: str, ident: str = "doc_id", text: str = "text", end_id: int = END_ID) -> bytes:
    """Encode `docs` into files under `path` in ascending order of `ident`, nulls last, ties by a hash of their texts; returns the dictionary,
    which is also written, to `path`-dictionary."""
    spark = small_batches(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes, n_docs = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count("*")).first()
    n = partitions(spark, n_bytes, PARTITION_BYTES)
    # about SAMPLE_DOCS different texts, the same in every run
    chosen = F.pmod(F.xxhash64("text"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0
    sample = rows.where(chosen).select(F.substring("text", 1, SAMPLE_CHARS).alias("t")).distinct().orderBy("t").limit(2 * SAMPLE_DOCS).collect()
    dictionary = train_dictionary(Encoder(tokenizer).encode([r[0] for r in sample]))
    spark.createDataFrame([(bytearray(dictionary),)], "value binary").select(F.col("value").cast("string")).coalesce(1).write.text(path + "-dictionary")
    sent = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    end = int(end_id).to_bytes(4, "little")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = Encoder(tokenizer), _coders(sent.value)[0]
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([pack_segment(held, sent.value)], pa.binary())], names=["value"])
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                data, offsets = text_bytes(part.column(1))
                idents = part.column(0).to_pylist()
                for a, z in row_blocks(offsets, BLOCK_BYTES):
                    own = data[offsets[a] : offsets[z]]
                    if len(own) > BLOCK_BYTES:  # one long text
                        ids = [b"".join([*(encoder.encode_bytes(p, np.array([0, len(p)]))[0] for p in encoder.giant(own, BLOCK_BYTES)), end])]
                    else:
                        ids = encoder.encode_bytes(own, offsets[a : z + 1] - offsets[a], end)
                    for ident, x in zip(idents[a:z], ids, strict=True):
                        held.append((ident, len(x) // 4, pack.compress(x)))
                        size += len(held[-1][2]) + 25
                        if size >= SEGMENT_BYTES:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    # texts are dealt out before they are encoded, as the partitioner's sample would encode them twice else; null idents go by their texts
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    lines = dealt.mapInArrow(lean(lay_out), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.text(path)  # a line feed closes each segment
    return dictionary


def read_files(spark: SparkSession, path: str, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids_bytes) of every document in the files, start being the ids of all before it."""
    sent = spark.sparkContext.broadcast(dictionary)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = 0
                for s in segments(content.as_py(), sent.value):
                    n = s.counts.astype(np.int64)
                    crc = [zlib.crc32(s.ids(i)) for i in range(len(n))]
                    own = start + np.cumsum(n) - n
                    start += int(n.sum())
                    m = len(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * m), pa.array(s.idents, pa.int64(), mask=s.null.astype(bool)), pa.array(own), pa.array(n), pa.array(crc, pa.int64())], names=["file", "doc_id", "own", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = materialize(files.mapInArrow(lean(parse), "file string, doc_id long, own long, n_tokens long, ids_crc32 long"), "read")
    before = found.groupBy("file").agg(F.sum("n_tokens").alias("all"))  # a row for each file
    before = before.select("file", F.coalesce(F.sum("all").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(F.broadcast(before) if _few(before) else before, "file").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def _few(files: DataFrame, most: int = 20_000) -> bool:
    return files.limit(most + 1).count() <= most


def store(docs: DataFrame, path: str, tokenizer: str, ident: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write `docs` and read them back: (doc_id, start, n_tokens, ids_crc32), a row for each row of `docs`.

    A null or empty text has only the end id. Rows with a null ident come last; rows that share an ident follow each other, by a hash of their
    texts. Extra columns are ignored. A long text is encoded in parts; its ids are held once. An empty table writes no document and gives an empty result."""
    return read_files(docs.sparkSession, path, write_files(docs, path, tokenizer, ident, text, end_id))


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return store(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
