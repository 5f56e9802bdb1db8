"""Removal of long passages that an earlier document holds, by a depth-limited radix sort of suffixes.

A passage is repeated if one of its windows of `width` bytes starts in a document with a smaller ident. Only the first `width` bytes
of suffixes are ever ordered, by most-significant-digit passes; groups that are equal after the last pass are exactly the
repeated windows.

The first digit of a window is its minimizer: the smallest hash of the `K`-byte strings in it. A first pass sends only values of minimizers
and how many strings have them, and learns, block by block, which of them another block holds too; the rest are groups of one
and drop out. Neighbouring windows share a minimizer, so they travel as one string, and equal windows meet in one bucket. Inside
a bucket the next digits are the minimizer's place in the window, then the window's bytes, `DIGIT` a pass: a pass orders what is left of each
group by its next bytes and drops groups that come from one document only.

Equal strings are reduced to the smallest ident's, the others being known to be repeated: in a block of documents before the shuffle, and
again while a bucket takes its strings in, so that what a bucket holds is different text. A task deals out the strings of many blocks at once, in parcels, as
the number of pieces that travel grows with the number of parcels times that of buckets. A minimizer with more than `HOT` strings in the whole
table is hot: its windows travel one by one, in the bucket of the window, so that a passage which a third of all documents share, with different words
around it, fills no bucket. The first pass counts this exactly, for all blocks alike.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeforge.llm.common import lean, mix64, partitions, small_batches, table

WIDTH, K = 50, 16
BLOCK = 2 << 20  # positions must fit 22 bits
BUCKET_BYTES, GROUP_BYTES, CHUNK, SLICE = 6 << 20, 12 << 20, 1 << 18, 512
#: Bytes of blocks, and places of strings, that a task holds before it deals them out; bytes of text to a list of minimizers; repeated ranges that a bucket holds.
PARCEL, PLACES, LIST_BYTES, RANGES = 16 << 20, 1 << 20, 16 << 20, 1 << 18
#: Bytes of strings that a bucket takes in before it reduces them; strings that make a minimizer hot; bytes of a radix pass.
HOLD, HOT, DIGIT = 8 << 20, 1 << 14, 5
RESERVED = ("__n_bytes", "__n_removed", "__n_spans", "__kept")
_LOW = np.uint64((1 << 22) - 1)
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LAST = (1 << 63) - 1  # the ident of a document without one


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as an unsigned integer (a view); the last 7 positions are padded."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _gram_hash(w: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    if isinstance(at, slice):
        return mix64(w[:-8] * _ODD[0] + w[8:] * _ODD[1])
    return mix64(w[at] * _ODD[0] + w[at + 8] * _ODD[1])


def strings(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: first window, number of windows, place of the minimizer, its hash, document."""
    z = np.zeros(0, np.int64)
    n = len(data) - width + 1
    if n <= 0 or np.diff(offsets).max() < width:
        return z, z, z, z.astype(np.uint64), z
    words, place = _words(data), np.empty(n, np.int32)
    for lo in range(0, n, 1 << 16):  # slice by slice, so that little is held at once
        hi = min(n, lo + (1 << 16))
        h = _gram_hash(words[lo : hi + width - K + 8], slice(None))[: hi - lo + width - K]
        v, grams, span = (h & ~_LOW) | np.arange(lo, lo + len(h), dtype=np.uint64), width - K + 1, 1
        while 2 * span <= grams:
            v = np.minimum(v[: len(v) - span], v[span:])
            span *= 2
        if span < grams:
            v = np.minimum(v[: len(v) - (grams - span)], v[grams - span :])
        place[lo:hi] = v & _LOW
    valid = np.ones(n, bool)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(lo, hi - width + 1) : hi] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    start = np.flatnonzero(new)
    last = valid
    last[:-1] &= ~valid[1:] | new[1:]
    count = np.flatnonzero(last) - start + 1
    at = place[start].astype(np.int64)
    return start, count, at, _gram_hash(words, at), np.searchsorted(offsets, start, "right") - 1


def _content(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each string of 8 bytes or more; strings have at most 2 * width - K bytes."""
    h = size.astype(np.uint64)
    for d in range(0, int(size.max()) if len(size) else 0, 8):
        # a string's own size says how often it is mixed, whatever stands beside it
        h = np.where(d < size, mix64(h * _ODD[3] + words[start + np.minimum(d, size - 8)]), h)
    return h


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[s : s + n] of each pair, one after the other."""
    return np.frombuffer(_pieces(data.tobytes(), start, size), np.uint8)


def _pieces(raw: bytes, start: np.ndarray, size: np.ndarray) -> bytes:
    return b"".join([raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(count) items its group and its number in the group."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


@functools.cache
def _coder() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes() + "".join(f"{a.dtype.str:4}" for a in arrays).encode()
    return _coder()[0].compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = _coder()[1].decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lens, at = np.frombuffer(raw, "<i8", n, 8).tolist(), 8 + 8 * n
    kinds = [raw[at + 4 * i : at + 4 * i + 4].decode().strip() for i in range(n)]
    at, out = at + 4 * n, []
    for kind, size in zip(kinds, lens, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out


class Mapper:
    """Turns blocks of documents into strings for the buckets, and marks what repeats inside a block. `n_lists`: lists that minimizers are dealt to."""

    def __init__(self, n_buckets: int, n_groups: int, width: int = WIDTH, n_lists: int | None = None) -> None:
        self.n_buckets, self.n_groups, self.width, self.n_lists = n_buckets, n_groups, width, n_lists or n_buckets
        self.held: list[tuple[np.ndarray, ...]] = []
        self.ranges: list[tuple[np.ndarray, ...]] = []
        self.size = self.places = 0

    def digits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of minimizers: the different (list, 32-bit value) in order, as one number; where each list begins; and each one's place."""
        q = mix64(h + np.uint64(1)) >> np.uint64(16)
        n = np.uint64(self.n_lists)
        code, place = np.unique((q % n << np.uint64(32)) | (q // n & np.uint64(0xFFFFFFFF)), return_inverse=True)
        return code, np.flatnonzero(np.diff((code >> np.uint64(32)).astype(np.int64), prepend=-1)), place

    def announce(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(list, blob of the minimizers' values and how many strings have them) of a block."""
        code, first, place = self.digits(strings(data, offsets, self.width)[3])
        count = np.minimum(np.bincount(place, minlength=len(code)), 65_535).astype("<u2")
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=False):
            yield int(code[lo] >> np.uint64(32)), _pack(np.diff(code[lo:hi] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype("<u4"), count[lo:hi])

    def _known(self, h: np.ndarray, doc: np.ndarray, replies: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of strings: whether another block holds the minimizer (all, where no reply came) or another document of this one, whether it
        is hot, and whether no reply tells."""
        code, first, place = self.digits(h)
        ok, hot, open_ = np.ones(len(code), bool), np.zeros(len(code), bool), np.zeros(len(code), bool)
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=False):
            bits = replies.get(int(code[lo] >> np.uint64(32)))
            if bits is None:
                open_[lo:hi] = True
            else:
                ok[lo:hi], hot[lo:hi] = (np.unpackbits(x, count=hi - lo).astype(bool) for x in np.split(bits, 2))
        low, high = np.full(len(code), len(doc) + 1), np.full(len(code), -1)
        np.minimum.at(low, place, doc)
        np.maximum.at(high, place, doc)
        return (ok | (low < high))[place], hot[place], open_[place]

    def block(self, data: np.ndarray, offsets: np.ndarray, ident: np.ndarray, key: np.ndarray, shift: np.ndarray, replies: dict[int, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        """(kind, bucket or group, blob) of a block by itself."""
        self.take(data, offsets, ident, key, shift, replies)
        yield from self.flush()

    def full(self) -> bool:
        return self.size >= PARCEL or self.places >= PLACES

    def take(self, data: np.ndarray, offsets: np.ndarray, ident: np.ndarray, key: np.ndarray, shift: np.ndarray, replies: dict[int, np.ndarray]) -> None:
        """Holds a block's strings and repeated ranges until `flush`; shift: where in its document each part of a block starts.

        A list without a reply (its block was cut otherwise when it was announced, as after the loss of an executor) may hold hot minimizers: its
        strings travel both whole and window by window, so that they meet the others either way."""
        found = strings(data, offsets, self.width)
        if not len(found[0]):
            return
        alive, hot, open_ = self._known(found[3], found[4], replies)
        whole, single = np.flatnonzero(alive & ~hot), np.flatnonzero(alive & (hot | open_))
        if not len(whole) and not len(single):
            return
        start, count, place, h, doc = (a[whole] for a in found)
        cold = len(whole)
        if len(single):
            own, j = _spread(found[1][single])
            start, place, h, doc = (np.concatenate([a, b[single][own] + (j if i == 0 else 0)]) for i, (a, b) in enumerate(((start, found[0]), (place, found[2]), (h, found[3]), (doc, found[4]))))
            count = np.concatenate([count, np.ones(len(j), np.int64)])
        size = count + self.width - 1
        content = _content(_words(data), start, size)
        way = h.copy()
        way[cold:] = content[cold:]
        bucket = (mix64(way + np.uint64(1)) % np.uint64(self.n_buckets)).astype(np.int64)
        same = mix64(content + way * _ODD[2])
        order = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ident[doc][order], first), np.diff(np.append(first, len(order))))
        later = ident[doc] > least
        pos = start - offsets[doc] + shift[doc]
        if later.any():
            self.ranges.append((ident[doc[later]], key[doc[later]], pos[later], pos[later] + size[later]))
        # of equal strings one is sent, with every place where the smallest ident has it
        keep = order[~later[order]]
        head = np.flatnonzero(np.diff(same[keep], prepend=~same[keep[0]])) if len(keep) else keep
        lead, refs = keep[head], np.diff(np.append(head, len(keep)))
        docs, idx = np.unique(doc[keep], return_inverse=True)
        self.held.append((data, start[lead], size[lead].astype(np.int32), (place[lead] - start[lead]).astype("<u2"), refs.astype(np.int32), bucket[lead].astype(np.int32), idx.astype(np.int32), pos[keep], ident[docs], key[docs]))
        self.size += len(data)
        self.places += len(keep) + int(later.sum())

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        """(kind, bucket or group, blob) of the blocks held: one piece for each bucket, the ranges joined."""
        held, ranges = self.held, self.ranges
        self.held, self.ranges, self.size, self.places = [], [], 0, 0
        if ranges:
            yield from spans(*(np.concatenate(x) for x in zip(*ranges, strict=True)), self.n_groups)
        if not held:
            return
        parts = list(zip(*held, strict=True))
        before = lambda of: np.cumsum([0, *map(len, of)]).tolist()
        start = np.concatenate([x + n for x, n in zip(parts[1], before(parts[0]), strict=False)])
        doc = np.concatenate([x + np.int32(n) for x, n in zip(parts[6], before(parts[8]), strict=False)])
        raw = b"".join(x.tobytes() for x in parts[0])
        size, place, refs, bucket, pos, ident, key = (np.concatenate(parts[i]) for i in (2, 3, 4, 5, 7, 8, 9))
        del held, parts
        by, refs = np.argsort(bucket, kind="stable"), refs.astype(np.int64)
        which, j = _spread(refs[by])
        ref = (np.cumsum(refs) - refs)[by][which] + j
        start, size, place, refs, bucket, doc, pos = start[by], size[by], place[by], refs[by], bucket[by], doc[ref], pos[ref]
        ends = np.cumsum(refs)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=False):
            a, z = int(ends[lo] - refs[lo]), int(ends[hi - 1])
            docs, idx = np.unique(doc[a:z], return_inverse=True)
            yield 0, int(bucket[lo]), _pack(
                np.frombuffer(_pieces(raw, start[lo:hi], size[lo:hi]), np.uint8), size[lo:hi].astype("<u4" if size[lo:hi].max() > 65535 else "<u2"), place[lo:hi], refs[lo:hi].astype("<u4"),
                ident[docs], key[docs], idx.astype("<u4"), pos[a:z].astype("<i8"),
            )


def spans(ident: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray, n_groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Repeated byte ranges of documents, dealt out by groups of documents and joined where they touch."""
    order = np.lexsort((start, ident, key))
    ident, key, start, end = ident[order], key[order], start[order], end[order]
    new_doc = np.concatenate([[True], (ident[1:] != ident[:-1]) | (key[1:] != key[:-1])])
    doc = np.cumsum(new_doc) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * far)
    new = new_doc.copy()
    new[1:] |= (start + doc * far)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    stop = reach[np.append(first[1:], len(reach)) - 1] - doc[first] * far
    ident, key, start = ident[first], key[first], start[first]
    g = group_of(key, n_groups)
    by = np.argsort(g, kind="stable")
    cut = np.flatnonzero(np.diff(g[by], prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(by)), strict=True):
        o = by[lo:hi]
        yield 1, int(g[o[0]]), _pack(ident[o], key[o], start[o].astype("<i8"), (stop[o] - start[o]).astype("<i8"))


def group_of(key: np.ndarray, n_groups: int) -> np.ndarray:
    return (mix64(key.view(np.uint64)) % np.uint64(n_groups)).astype(np.int64)


class Bucket:
    """Takes in a bucket's blobs and reduces equal strings as it goes: what it holds is the bucket's different text."""

    def __init__(self, n_groups: int, width: int = WIDTH) -> None:
        self.n_groups, self.width = n_groups, width
        self.held: list[list[np.ndarray]] = []
        self.blobs: list[bytes] = []
        self.ranges: list[tuple[np.ndarray, ...]] = []
        self.waiting = self.size = 0

    def add(self, blob: bytes) -> Iterator[tuple[int, int, bytes]]:
        self.blobs.append(blob)
        self.waiting += zstandard.frame_content_size(blob)
        if self.waiting > max(HOLD, self.size):
            self._reduce()
            if sum(len(x[0]) for x in self.ranges) > RANGES:
                yield from self._dealt()

    def _dealt(self) -> Iterator[tuple[int, int, bytes]]:
        """The ranges found so far, in one piece for each group of documents."""
        if self.ranges:
            ranges, self.ranges = self.ranges, []
            yield from spans(*(np.concatenate(x) for x in zip(*ranges, strict=True)), self.n_groups)

    def _reduce(self) -> None:
        parts = self.held + [_unpack(b) for b in self.blobs]
        docs = np.cumsum([0] + [len(p[4]) for p in parts])
        text, size, place, refs, ids, keys = (np.concatenate([p[i] for p in parts]) for i in range(6))
        size, place, refs = size.astype(np.int64), place.astype(np.int64), refs.astype(np.int64)
        ref_doc = np.concatenate([p[6].astype(np.int64) + d for p, d in zip(parts, docs, strict=False)])
        ref_pos = np.concatenate([p[7] for p in parts])
        self.held, self.blobs, self.waiting = [], [], 0
        del parts
        at, ref_at = np.cumsum(size) - size, np.cumsum(refs) - refs
        ident = ids[ref_doc[ref_at]]  # all places of a string are in documents of one ident
        words = _words(text)
        same = mix64(_content(words, at, size) + place.astype(np.uint64))
        order = np.argsort(same)
        first = np.flatnonzero(np.concatenate([[True], same[order[1:]] != same[order[:-1]]]))
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ident[order], first), np.diff(np.append(first, len(order))))
        later = ident > least
        if later.any():
            which, j = _spread(refs[later])
            ref, end = ref_at[later][which] + j, size[later][which]
            self.ranges.append((ids[ref_doc[ref]], keys[ref_doc[ref]], ref_pos[ref], ref_pos[ref] + end))
            stay = ~later
            which, j = _spread(refs[stay])
            ref = ref_at[stay][which] + j
            text = _gather(text, at[stay], size[stay])
            size, place, refs = size[stay], place[stay], refs[stay]
            used, ref_doc = np.unique(ref_doc[ref], return_inverse=True)
            ids, keys, ref_pos = ids[used], keys[used], ref_pos[ref]
        self.held, self.size = [[text, size, place, refs, ids, keys, ref_doc, ref_pos]], len(text) + 24 * len(size) + 32 * len(ref_pos)

    def finish(self) -> Iterator[tuple[int, int, bytes]]:
        """The repeated ranges that the bucket's strings still show, as `spans` gives them."""
        if self.blobs:
            self._reduce()
        text, size, place, refs, ids, keys, ref_doc, ref_pos = self.held[0]
        ref_at = np.cumsum(refs) - refs
        e, j = repeated_windows(text, size, place, ids[ref_doc[ref_at]], self.width)
        if not len(e):
            yield from self._dealt()
            return
        a = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (j[1:] != j[:-1] + 1)]))
        z = np.append(a[1:], len(e)) - 1
        run_e, run_lo, run_hi = e[a], j[a], j[z] + self.width
        which, k = _spread(refs[run_e])
        ref = ref_at[run_e][which] + k
        self.ranges.append((ids[ref_doc[ref]], keys[ref_doc[ref]], ref_pos[ref] + run_lo[which], ref_pos[ref] + run_hi[which]))
        yield from self._dealt()


def _many(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items in the order of their keys, without those whose key only one ident has; and which group of equal keys each is in."""
    order = np.argsort(key)
    k, own = key[order], ident[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    many = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
    size = np.diff(np.append(first, len(order)))
    return order[np.repeat(many, size)], np.repeat(np.arange(int(many.sum())), size[many])


def _extend(group: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """One number for each (group, digit), in their order."""
    if int(group.max()) < 1 << (64 - 8 * DIGIT):
        return group.astype(np.uint64) << np.uint64(8 * DIGIT) | digit
    order = np.lexsort((digit, group))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], (group[order[1:]] != group[order[:-1]]) | (digit[order[1:]] != digit[order[:-1]])]))
    return out


def repeated_windows(text: np.ndarray, size: np.ndarray, place: np.ndarray, ident: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of each window of the strings that also starts in a string with a smaller ident, in order.

    Suffixes are ordered by minimizer, its place in the window, then DIGIT bytes a pass, as far as `width` bytes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(size):
        return none
    at = np.cumsum(size) - size
    words = _words(np.concatenate([text, np.zeros(16, np.uint8)]))
    order, group = _many(_gram_hash(words, at + place), ident)
    windows = np.cumsum(size[order] - width + 1)
    digits = [*range(0, width - DIGIT, DIGIT), width - DIGIT]
    found, lo = [none], 0
    while lo < len(order):
        hi = int(np.searchsorted(windows, (windows[lo - 1] if lo else 0) + CHUNK, "right"))
        hi = max(hi, lo + 1)
        if hi < len(order):  # whole groups only
            back = int(np.searchsorted(group, group[hi]))
            hi = back if back > lo else int(np.searchsorted(group, group[lo], "right"))
        s, j = _spread(size[order[lo:hi]] - width + 1)
        e = order[lo:hi][s]
        begin, who = at[e] + j, ident[e]
        live = np.arange(len(begin))
        g = (group[lo:hi][s] - group[lo]) * (width + 1) + (place[e] - j)
        for d in digits:
            if not len(live):
                break
            digit = words[begin[live] + d].byteswap() >> np.uint64(64 - 8 * DIGIT)
            o, g = _many(_extend(g, digit), who[live])
            live = live[o]
        if len(live):
            first = np.flatnonzero(np.diff(g, prepend=-1))
            least = np.repeat(np.minimum.reduceat(who[live], first), np.diff(np.append(first, len(live))))
            live = np.sort(live[who[live] > least])
            found.append((e[live], j[live]))
        lo = hi
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["__kind", "__g", "__blob"])


def _some(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in portions of some megabytes, as they come."""
    own, size = [], 0
    for row in rows:
        own.append(row)
        size += len(row[2])
        if size > 4 << 20:
            yield own
            own, size = [], 0
    if own:
        yield own


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks of rows (ident, key, text), each with a name made of what is in it: (name, [bytes, offsets, idents, keys, shifts])."""

    def name(*arrays: np.ndarray) -> int:
        return int.from_bytes(hashlib.blake2b(b"".join(a.tobytes() for a in arrays), digest_size=8).digest(), "little", signed=True)

    texts, ids, keys, size = [], [], [], 0

    def done() -> tuple[int, list[np.ndarray]]:
        i, k, shift = np.array(ids, np.int64), np.array(keys, np.int64), np.zeros(len(ids), np.int64)
        return name(i, k, shift), [np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), i, k, shift]

    for b in batches:
        for i, k, t in zip(b.column(0).fill_null(_LAST).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            n = len(t.as_buffer()) if t.is_valid else 0
            if n < width:
                continue
            if n > BLOCK:  # a giant text by itself, in parts whose windows don't overlap
                raw = np.frombuffer(t.as_buffer(), np.uint8)
                for at in range(0, n - width + 1, BLOCK - width):
                    part, shift = raw[at : at + BLOCK - 1], np.array([at])
                    yield name(np.array([i]), np.array([k]), shift), [part, np.array([0, len(part)]), np.array([i]), np.array([k]), shift]
                continue
            if size + n > BLOCK:
                yield done()
                texts, ids, keys, size = [], [], [], 0
            texts.append(t.as_py())
            ids.append(i)
            keys.append(k)
            size += n
    if texts:
        yield done()


def _shared(blobs: list[bytes], hot: int) -> list[bytes]:
    """For each blob of values, a bit for each value: whether another blob holds it too; then a bit for each: whether over `hot` strings have it."""
    parts = [_unpack(b) for b in blobs]
    values = [np.cumsum(p[0].astype(np.uint64)) for p in parts]
    _, place, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    both, much = count[place] > 1, np.bincount(place, np.concatenate([p[1] for p in parts]))[place] > hot
    at, out = 0, []
    for v in values:
        out.append(np.packbits(both[at : at + len(v)]).tobytes() + np.packbits(much[at : at + len(v)]).tobytes())
        at += len(v)
    return out


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """All rows and columns of `docs`, and n_bytes, n_removed, n_spans (long) and kept (binary: the bytes that stay).

    A byte goes if a window of `width` bytes around it also starts in a row with a smaller ident; windows lie within one row's text.
    Null and empty texts have no bytes. A row without ident comes after all others and never makes another lose bytes; rows that share an ident don't
    touch each other. An empty table gives an empty result. New columns are called `__n_bytes`, `__n_removed`,
    `__n_spans`, `__kept` and take the place of columns of `docs` so called; other columns keep any name. With `as_text` what stays is a
    string; where a cut parts the bytes of a character, its rest goes too. `width` is 24 at least. A minimizer with over `hot` strings is spread by window."""
    if width < K + 8:
        raise ValueError(f"windows of {K + 8} bytes at least")
    spark = small_batches(docs.sparkSession)
    docs = docs.drop(*RESERVED)
    names = docs.columns
    docs, ident, text = docs.toDF(*(f"c{i}" for i in range(len(names)))), f"c{names.index(ident)}", f"c{names.index(text)}"
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    n_buckets, n_groups, n_lists, n_parcels = (partitions(spark, n_bytes, each) for each in (BUCKET_BYTES, GROUP_BYTES, LIST_BYTES, PARCEL))
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.col(ident).cast("long").alias("i"), key.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(n_buckets, n_groups, width, n_lists)
        for name, part in _blocks(batches, width):
            rows = [(bucket, name, blob) for bucket, blob in mapper.announce(part[0], part[1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "name", "blob"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * n, pa.int64()), pa.array([bucket] * n, pa.int64()), pa.array(_shared([r[1] for r in rows], hot), pa.binary())], names=["name", "kind", "bucket", "blob"])

        bucket, rows = None, []
        for b in batches:
            for own, name, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != bucket and rows:
                    yield done(bucket, rows)
                    rows = []
                bucket = own
                rows.append((name, blob))
        if rows:
            yield done(bucket, rows)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([1], pa.int64()), pa.array([0], pa.int64()), pa.array([_pack(*part)], pa.binary())], names=["name", "kind", "bucket", "blob"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper, own, replies = Mapper(n_buckets, n_groups, width, n_lists), None, {}
        for b in batches:  # by name, a block's replies before the block
            for name, kind, bucket, blob in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if name != own:
                    own, replies = name, {}
                if kind == 0:
                    replies[bucket] = np.frombuffer(blob.as_py(), np.uint8)
                else:
                    mapper.take(*_unpack(blob.as_py()), replies)
                    if mapper.full():
                        yield from map(_rows, _some(mapper.flush()))
        yield from map(_rows, _some(mapper.flush()))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, bucket = None, None
        for b in batches:
            for kind, own, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket and (kind != 0 or own != g):
                    if out := list(bucket.finish()):
                        yield _rows(out)
                    bucket = None
                if kind == 0:
                    g, bucket = own, bucket or Bucket(n_groups, width)
                    if out := list(bucket.add(blob.as_py())):
                        yield _rows(out)
                else:
                    yield _rows([(kind, own, blob.as_py())])
        if bucket and (out := list(bucket.finish())):
            yield _rows(out)

    schema = "__kind long, __g long, __blob binary"
    replies = slim.mapInArrow(lean(announce), "bucket long, name long, blob binary").repartition(n_lists, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(reply), "name long, kind long, bucket long, blob binary")
    wrapped = slim.mapInArrow(lean(wrap), "name long, kind long, bucket long, blob binary").unionByName(replies)
    found = wrapped.repartition(n_parcels, "name").sortWithinPartitions("name", "kind").mapInArrow(lean(cut), schema).repartition(n_buckets, "__kind", "__g").sortWithinPartitions("__kind", "__g").mapInArrow(lean(sort), schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = group_of(b.column(b.num_columns - 1).to_numpy(), n_groups)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g)], names=[*b.schema.names, "__g"])

    with_key = docs.withColumn("__key", key)
    dealt = with_key.mapInArrow(lean(label), T.StructType([*with_key.schema.fields, T.StructField("__g", T.LongType())])).withColumn("__kind", F.lit(2).cast("long"))
    both = dealt.unionByName(found, allowMissingColumns=True).repartition(n_groups, "__g").sortWithinPartitions("__g", "__kind")
    at_id, at_text, at_key, n_own = docs.columns.index(ident), docs.columns.index(text), len(docs.columns), len(docs.columns)
    out_schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in RESERVED[:3]), T.StructField(RESERVED[3], T.StringType() if as_text else T.BinaryType())])
    at_g, at_kind, at_blob = (both.columns.index(c) for c in ("__g", "__kind", "__blob"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cuts, waiting = None, {}, []
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            kind, own, blob = b.column(at_kind).to_pylist(), b.column(at_g).to_pylist(), b.column(at_blob)
            size, removed, n_spans, kept, rows = [], [], [], [], []
            ids, keys, texts = b.column(at_id), b.column(at_key), b.column(at_text).cast(pa.binary())
            for i, k in enumerate(kind):
                if own[i] != g:
                    g, cuts, waiting = own[i], {}, []
                if k != 2:
                    waiting.append(blob[i].as_py())
                    continue
                if waiting:
                    cuts, waiting = _by_document(waiting), []
                raw = texts[i].as_py() or b""
                ident_value = ids[i].as_py()
                mine = cuts.get((_LAST if ident_value is None else ident_value, keys[i].as_py())) if cuts else None
                left = raw
                n = 0
                if mine is not None:
                    left, n = _without(raw, *mine)
                rows.append(i)
                size.append(len(raw))
                removed.append(len(raw) - len(left))
                n_spans.append(n)
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(n_own)), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())], names=out_schema.names)

    return both.mapInArrow(lean(apply), out_schema).toDF(*names, *RESERVED)


def _by_document(blobs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    parts = [_unpack(b) for b in blobs]
    ident, key, start, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((start, ident, key))
    ident, key, start, end = ident[order], key[order], start[order], start[order] + size[order]
    cut = np.flatnonzero(np.concatenate([[True], (ident[1:] != ident[:-1]) | (key[1:] != key[:-1])]))
    return {(i, k): (start[a:z], end[a:z]) for i, k, a, z in zip(ident[cut].tolist(), key[cut].tolist(), cut.tolist(), np.append(cut[1:], len(start)).tolist(), strict=True)}


def _without(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside the ranges (in order of their starts), and the number of maximal ranges."""
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    lo, hi = start[first].tolist(), reach[np.append(first[1:], len(reach)) - 1].tolist()
    return b"".join(raw[a:b] for a, b in zip([0, *hi], [*lo, len(raw)], strict=True)), len(lo)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def stage_suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated passages; one that loses everything goes. n_chars is that of the text that stays."""
    out = remove_repeats(docs, as_text=True).where("__n_removed = 0 OR __kept <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") == 0, F.col("n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.when(F.col("__n_removed") == 0, F.col("text")).otherwise(F.col("__kept"))).select(*docs.columns)
