"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text's tokens are the best path through a lattice of pieces. For a unigram model a path's value is the sum of its pieces'
scores. For a BPE model it is 0 if every two neighbouring pieces stand together and minus infinity else: two pieces stand
together if merging their joined characters gives back those two. Greedy merging never crosses the borders of its result,
and a sequence whose neighbours all stand together is what merging the whole gives, so exactly one path has value 0 and it is
the library's encoding. (A first crossing merge would also be the first in its two pieces alone.)

A giant text is cut into chunks anywhere. A boundary's states are the pieces that reach it: (characters beyond it, piece). A chunk's
transfer matrix holds the best value from each entry state to each exit state; matrices combine associatively (max-plus product), which
gives each boundary's state; then each chunk traces its own path. No piece reaches over the place before a word's mark, so a
chunk's words between its first and last such place are encoded once each and remembered; many words run through the lattice at once as
numpy lanes, and what stays of the chunk, its head and its tail, is where the boundary's states matter.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeforge.llm.common import Powers, lean, materialize, partitions, prefix_hash, small_batches, span_hash, table, text_bytes

MARK, PROBE = "▁", "\x01"
CHUNK, LANE, CACHE_RUNS, BATCH, PARTITION_CHARS = 32_768, 128, 250_000, 1024, 16 << 20
State = tuple[int, int]  # characters of the piece beyond the boundary, the piece (-1: any, or none before it)
Matrix = dict[State, dict[State, float]]


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialized model: 1 unigram, 2 BPE. Field numbers 2 and 3 of the public format."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                size = varint() if kind == 2 else 8 if kind == 1 else 4
                yield tag >> 3, data[at : at + size]
                at += size

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1)


class Lattice:
    """A model's pieces, the values of paths, and the encodings of the words met so far."""

    def __init__(self, path: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = self.sp.get_piece_size()
        self.texts = [self.sp.id_to_piece(i) for i in range(self.n)]
        own = [i for i in range(self.n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in own}
        self.bpe = _model_type(self.sp.serialized_model_proto()) == 2
        self.longest = max(map(len, self.ids))
        self.worst = min((self.sp.get_score(i) for i in own), default=0.0) - 10.0
        #: whether no piece reaches from another character into a mark
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        probe = "a  b \ufb01\u2460\t\u00a0e\u0301\u200b\ufeff\x01 "
        #: whether normalization only puts a mark before the text and for each space
        self.plain = self.cuts and self.sp.Normalize(probe) == MARK + probe.replace(" ", MARK)
        self.powers = Powers()
        self._split = re.compile(f"(?<=[^{MARK}])(?={MARK})") if self.cuts else None
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(self.sp.is_byte(i) for i in self.bytes)
        self.probe = self.sp.encode(PROBE)
        self.known: dict[str, bytes] = {}
        self._pair_key, self._pair_value = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._scores = np.array([self.value(i) for i in range(self.n)] + [self.worst if not self.bpe else 0.0])
        self._table()

    # pieces: an id, or n + code point for a character that is no piece

    def text_of(self, piece: int) -> str:
        return self.texts[piece] if piece < self.n else chr(piece - self.n)

    def expand(self, piece: int) -> list[int]:
        if piece < self.n:
            return [piece]
        return [self.bytes[b] for b in chr(piece - self.n).encode()] if self.fallback else [self.sp.unk_id()]

    def value(self, piece: int) -> float:
        return 0.0 if self.bpe else self.sp.get_score(piece) if piece < self.n else self.worst

    def _stand(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two pieces stand together; the first may be -1, nothing."""
        got = self.sp.encode([PROBE + (self.text_of(a) if a >= 0 else "") + self.text_of(b) for a, b in pairs], num_threads=1)
        return [g == self.probe + (self.expand(a) if a >= 0 else []) + self.expand(b) for g, (a, b) in zip(got, pairs, strict=True)]

    def together(self, a: int, b: int) -> bool:
        if not self.bpe:
            return True
        if (a, b) not in self._pairs:
            if len(self._pairs) > 1 << 18:
                self._pairs.clear()
            self._pairs[a, b] = self._stand([(a, b)])[0]
        return self._pairs[a, b]

    def _together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for many pairs, with a table of fixed size that remembers the latest."""
        if not self.bpe:
            return np.ones(len(a), bool)
        code = (a + 1) * np.int64(1 << 22) + b
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out = self._pair_value[slot]
        miss = self._pair_key[slot] != code
        if miss.any():
            new, at = np.unique(code[miss], return_inverse=True)
            ok = np.array(self._stand([(int(x >> 22) - 1, int(x & ((1 << 22) - 1))) for x in new.tolist()]), bool)
            out[miss] = ok[at]
            self._pair_key[slot[miss]], self._pair_value[slot[miss]] = code[miss], ok[at]
        return out

    # many words at once

    def _table(self) -> None:
        """Pieces by a hash of their characters: a table, and what collides in it."""
        self._mul = np.uint64(0xD6E8FEB86659FD93)
        hashes = np.array([reduce(lambda h, c: (h * int(self._mul) + ord(c) + 1) & (1 << 64) - 1, p, 0) for p in self.ids], np.uint64)
        ids = np.array(list(self.ids.values()), np.int64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self._key, self._id = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int64)
        slot = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self._key[slot[first]], self._id[slot[first]] = hashes[first], ids[first]
        rest = np.setdiff1d(np.arange(len(ids)), first)
        rest = rest[np.argsort(hashes[rest])]
        self._more, self._more_id = np.append(hashes[rest], np.uint64((1 << 64) - 1)), np.append(ids[rest], -1)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
        out = np.where(self._key[slot] == hashes, self._id[slot], -1)
        odd = np.flatnonzero((out < 0) & (self._id[slot] >= 0))
        if len(odd):
            at = np.searchsorted(self._more, hashes[odd])
            out[odd] = np.where(self._more[at] == hashes[odd], self._more_id[at], -1)
        return out

    def _lanes(self, words: list[str]) -> list[bytes]:
        """The ids of words of at most LANE characters."""
        size = np.array([len(w) for w in words])
        n, top = len(words), int(size.max())
        chars = np.frombuffer("".join(w.ljust(top, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, top).astype(np.int64)
        scores = self._scores
        best = np.full((n, top + 1), -np.inf)
        last, back = np.full((n, top + 1), -2, np.int64), np.zeros((n, top + 1), np.int16)  # -1: nothing before; -2: not reached
        best[:, 0], last[:, 0] = 0.0, -1
        hashes: list[np.ndarray] = []  # of the strings that end here, by length, shifted along
        for i in range(1, top + 1):
            live = np.flatnonzero(size >= i)
            c = chars[:, i - 1].astype(np.uint64) + np.uint64(1)
            hashes = [c, *(h * self._mul + c for h in hashes[: self.longest - 1])]
            for k in range(1, len(hashes) + 1):
                if not len(live):
                    break
                piece = self._find(hashes[k - 1][live])
                if k == 1:
                    piece = np.where(piece < 0, self.n + chars[live, i - 1], piece)
                if self.bpe:  # a prefix has one path, so the first that is found is it
                    has = np.flatnonzero((piece >= 0) & (last[live, i - k] > -2))
                    has = has[self._together(last[live[has], i - k], piece[has])]
                    rows = live[has]
                    best[rows, i], last[rows, i], back[rows, i] = 0.0, piece[has], k
                    live = np.delete(live, has)
                    continue
                has = piece >= 0
                rows, piece = live[has], piece[has]
                value = best[rows, i - k] + scores[np.minimum(piece, self.n)]
                better = value > best[rows, i]
                rows, piece, value = rows[better], piece[better], value[better]
                best[rows, i], last[rows, i], back[rows, i] = value, piece, k
        at, rows, steps = size.copy(), np.arange(n), []
        while len(rows):
            if (back[rows, at[rows]] <= 0).any():
                raise ValueError("a word has no path")
            steps.append((rows, last[rows, at[rows]]))
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        word, piece = (np.concatenate([x[i] for x in reversed(steps)]) for i in range(2))
        order = np.argsort(word, kind="stable")
        word, piece = word[order], piece[order]
        ends = np.searchsorted(word, np.arange(n), "right").tolist()
        raw, odd = piece.astype("<u4").tobytes(), set(word[piece >= self.n].tolist())
        begins = [0, *ends[:-1]]
        return [self.pack(piece[a:z].tolist()) if i in odd else raw[4 * a : 4 * z] for i, (a, z) in enumerate(zip(begins, ends, strict=True))]

    def learn(self, keys: list[str]) -> None:
        """Encode runs: a key is what follows a run's one mark, or a mark and then the run itself."""
        runs = [k[1:] if k[:1] == MARK else MARK + k for k in keys]
        order = sorted(range(len(runs)), key=list(map(len, runs)).__getitem__)
        short = [i for i in order if len(runs[i]) <= LANE]
        for lo in range(0, len(short), 8192):
            some = short[lo : lo + 8192]
            self.known.update(zip([keys[i] for i in some], self._lanes([runs[i] for i in some]), strict=True))
        for i in order[len(short) :]:
            self.known[keys[i]] = self.pack(self.long_run(runs[i]))

    def keys(self, text: str) -> list[str]:
        """The runs of a text between its cut places, as keys."""
        if not text:
            return []
        if not self.cuts:
            return [MARK + text]
        if text[0] == MARK and text[-1] != MARK and MARK + MARK not in text:
            return text.split(MARK)[1:]
        return [r[1:] if r[0] == MARK and len(r) > 1 and r[1] != MARK else MARK + r for r in self._split.split(text)]

    def pack(self, path: list[int]) -> bytes:
        return np.array([i for p in path for i in self.expand(p)], "<u4").tobytes()

    # chunks and their boundaries

    def entries(self, s: str, lo: int) -> list[State]:
        """The states that the text allows at the boundary `lo`."""
        if lo == 0:
            return [(0, -1)]
        out = set()
        for start in range(max(0, lo - self.longest), lo):
            for end in range(max(lo, start + 1), min(len(s), start + self.longest) + 1):
                p = self.ids.get(s[start:end], self.n + ord(s[start]) if end == start + 1 else None)
                if p is not None:
                    out.add((end - lo, p if self.bpe else -1))
        return sorted(out)

    def walk(self, s: str, lo: int, hi: int, entry: State, last: bool) -> dict[State, tuple[float, list[int]]]:
        """The best value and path from an entry state at `lo` to each exit state at `hi`; `last`: the text ends there."""
        at = lo + entry[0]
        if at >= hi:
            return {} if last and at > hi else {(at - hi, entry[1]): (0.0, [])}
        best: dict[int, tuple[float, int, int]] = {at: (0.0, entry[1], -1)}
        for p in range(at, hi):
            if p not in best:
                continue
            value, before, _ = best[p]
            for q in range(p + 1, min(len(s), p + self.longest) + 1):
                piece = self.ids.get(s[p:q], self.n + ord(s[p]) if q == p + 1 else None)
                if piece is None or (last and q > hi):
                    continue
                v = value + self.value(piece)
                if (q not in best or v > best[q][0]) and self.together(before, piece):
                    best[q] = (v, piece, p)
        out = {}
        for q in range(hi, min(len(s), hi + self.longest) + 1):
            if q in best:
                path, p = [], q
                while best[p][2] >= 0:
                    path.append(best[p][1])
                    p = best[p][2]
                out[q - hi, best[q][1] if self.bpe else -1] = (best[q][0], path[::-1])
        return out

    def cut_places(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last place within [lo, hi] that no piece reaches across."""
        if not self.cuts:
            return None
        found = [m.start() for m in self._split.finditer(s, max(lo - 1, 0), min(hi + 1, len(s))) if lo <= m.start() <= hi]
        return (found[0], found[-1]) if found else None

    def matrix(self, s: str, lo: int, hi: int, last: bool) -> Matrix:
        """The transfer matrix of s[lo:hi], with what stands around it as context."""
        places = self.cut_places(s, lo, hi)
        if places is None:
            return {e: {x: v for x, (v, _) in w.items()} for e in self.entries(s, lo) if (w := self.walk(s, lo, hi, e, last))}
        first, final = places
        middle = 0.0 if self.bpe else self.run_value(s[first:final])
        tail = {x: v for x, (v, _) in self.walk(s, final, hi, (0, -1), last).items()} if final < hi else {(0, -1): 0.0}
        out: Matrix = {}
        for e in [(0, -1)] if lo == 0 or first == lo else self.entries(s, lo):
            head = self._head(s, lo, first, e)
            if head is not None:
                out[e] = {x: head[0] + middle + v for x, v in tail.items()}
        if first == lo and lo > 0:
            out |= {e: out[0, -1] for e in self.entries(s, lo) if e[0] == 0}
        return out

    def _head(self, s: str, lo: int, first: int, entry: State) -> tuple[float, list[int]] | None:
        if first == lo:
            return (0.0, []) if entry[0] == 0 else None
        found = [x for (over, _), x in self.walk(s[:first], lo, first, entry, True).items() if over == 0]
        return found[0] if found else None

    def traces(self, chunks: list[tuple[str, int, int, State, State, bool]]) -> list[bytes]:
        """The ids of the pieces that start in each chunk s[lo:hi], its boundary states known; all chunks' words go through the lattice together."""
        ends: list[tuple[bytes, bytes]] = []
        middles = []
        for s, lo, hi, entry, exit_, last in chunks:
            places = self.cut_places(s, lo, hi)
            if places is None:
                ends.append((self.pack(self.walk(s, lo, hi, entry, last)[exit_][1]), b""))
                middles.append("")
                continue
            first, final = places
            head = self._head(s, lo, first, entry)
            ends.append((self.pack(head[1]), self.pack(self.walk(s, final, hi, (0, -1), last)[exit_][1] if final < hi else [])))
            middles.append(s[first:final])
        return [a + m + z for (a, z), m in zip(ends, self.runs(middles), strict=True)]

    def run_value(self, s: str) -> float:
        return float(sum(self.value(i) if self.sp.id_to_piece(i) in self.ids else self.worst for i in np.frombuffer(self.runs([s])[0], "<u4").tolist()))

    def long_run(self, s: str) -> list[int]:
        """The pieces of a long text without cut places, by the scan over chunks of LANE characters."""
        bounds = [*range(0, len(s), LANE), len(s)]
        parts = list(zip(bounds[:-1], bounds[1:], strict=True))
        ctx = [(max(0, a - self.longest), min(len(s), b + self.longest)) for a, b in parts]
        mats = [{e: {x: v for x, (v, _) in w.items()} for e in (self.entries(s[x:y], a - x) if a else [(0, -1)]) if (w := self.walk(s[x:y], a - x, b - x, e, b == len(s)))} for (a, b), (x, y) in zip(parts, ctx, strict=True)]
        states = boundary_states(mats)
        return [p for (a, b), (x, y), i, o in zip(parts, ctx, states[:-1], states[1:], strict=True) for p in self.walk(s[x:y], a - x, b - x, i, b == len(s))[o][1]]

    # whole texts

    def runs(self, texts: list[str]) -> list[bytes]:
        """The ids of normalized texts that begin and end at cut places."""
        if len(self.known) > CACHE_RUNS:  # the common runs are among the first
            self.known = dict(islice(self.known.items(), CACHE_RUNS // 4))
        get, out, gaps, new = self.known.get, [], [], set()
        for t in texts:
            keys = self.keys(t)
            ids = list(map(get, keys))
            if None in ids:
                gap = [i for i, x in enumerate(ids) if x is None]
                lost = [keys[i] for i in gap]
                new.update(lost)
                gaps.append((ids, gap, lost))
            out.append(ids)
        if new:
            self.learn(list(new))
        for ids, gap, lost in gaps:
            for i, k in zip(gap, lost, strict=True):
                ids[i] = self.known[k]
        return [b"".join(x) for x in out]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text (concatenated UTF-8 and offsets), for models that only put a mark before a text and for each space.

        Cut places are found in the bytes; equal runs of a batch meet by a 64-bit hash, and each different one is looked up once."""
        n = len(offsets) - 1
        if not len(data):
            return [b""] * n
        if len(self.known) > CACHE_RUNS:
            self.known = dict(islice(self.known.items(), CACHE_RUNS // 4))
        mark = data == 32
        mark[1:] &= data[:-1] != 32
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        mark[begins] = True
        start = np.flatnonzero(mark)
        stop = np.append(start[1:], len(data))
        first_of_text = np.zeros(len(start), bool)
        first_of_text[np.searchsorted(start, begins)] = True
        key = span_hash(prefix_hash(data, self.powers), self.powers, start, stop) + first_of_text.astype(np.uint64)
        order = np.argsort(key)
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        first, place = order[new], np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        raw = data.tobytes()
        runs = [b" " * f + raw[a:z] for f, a, z in zip(first_of_text[first].tolist(), start[first].tolist(), stop[first].tolist(), strict=True)]
        keys = [r[1:].decode() if len(r) > 1 and r[1] != 32 else MARK + r.decode().replace(" ", MARK) for r in runs]
        ids = list(map(self.known.get, keys))
        if None in ids:
            self.learn([k for k, x in zip(keys, ids, strict=True) if x is None])
            ids = list(map(self.known.__getitem__, keys))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        at, count = (np.cumsum(size) - size)[place], size[place]
        before = np.cumsum(count) - count
        all_ids = flat[np.repeat(at - before, count) + np.arange(int(count.sum()))].tobytes()
        edge = np.searchsorted(start, offsets)
        cut = 4 * np.append(before, len(all_ids) // 4)[edge]
        return [all_ids[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def normalize(self, texts: list[str]) -> list[str]:
        return self.sp.Normalize(texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.runs(self.normalize(texts))


class Decoder:
    """What each id of a model stands for."""

    def __init__(self, path: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.out = [self._bytes_of(i) for i in range(self.sp.get_piece_size())]

    def _bytes_of(self, i: int) -> bytes:
        if self.sp.is_control(i):
            return b""
        if self.sp.is_byte(i):
            return bytes([int(self.sp.id_to_piece(i)[3:5], 16)])
        return b" \xe2\x81\x87 " if self.sp.is_unknown(i) else self.sp.id_to_piece(i).replace(MARK, " ").encode()

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; the space before the first word is the model's own."""
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def same(self, ids: list[bytes], texts: list[bytes]) -> list[bool]:
        """Whether each document's ids, decoded, give its text."""
        joined = self.out.__getitem__
        raw = (b"".join(map(joined, memoryview(x).cast("I"))) for x in ids)
        return [(r[1:] if r[:1] == b" " else r) == t for r, t in zip(raw, texts, strict=True)]


def coders(path: str) -> tuple[Lattice, Decoder]:
    """A model's coders; a worker keeps those of its last model, with the runs and pairs they have met, for its next tasks."""
    kept = sys.modules.setdefault("_cladeforge_lattices", type(sys)("_cladeforge_lattices"))
    if getattr(kept, "path", None) != path:
        kept.coders = Lattice(path), Decoder(path)
        kept.path = path
    return kept.coders


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product; a state of any piece meets any entry that lies as far beyond the boundary."""
    out: Matrix = {}
    for e, row in a.items():
        best: dict[State, float] = {}
        for m, v in row.items():
            for x, w in b.get(m, {}).items():
                if v + w > best.get(x, -np.inf):
                    best[x] = v + w
        if best:
            out[e] = best
    return out


def prefixes(mats: list[Matrix]) -> list[Matrix]:
    """The products of the first 1, 2, ... matrices, by pairs (the depth grows with the logarithm of their number)."""
    if len(mats) < 2:
        return list(mats)
    half = prefixes([combine(a, b) for a, b in zip(mats[::2], mats[1::2], strict=False)])
    out = [mats[0]]
    for i in range(1, len(mats)):
        out.append(half[i // 2] if i % 2 else combine(half[i // 2 - 1], mats[i]))
    return out


def boundary_states(mats: list[Matrix]) -> list[State]:
    """The state of each boundary, the text's begin and end included, on the best path."""
    ahead = prefixes(mats)
    start = next(iter(ahead[-1]))
    states = [max(ahead[-1][start].items(), key=lambda x: (x[1], x[0]))[0]]
    for before, mat in zip(reversed([None, *ahead[:-1]]), reversed(mats), strict=True):
        if before is None:
            states.append(start)
            continue
        options = [(v + mat[s][states[-1]], s) for s, v in before[start].items() if states[-1] in mat.get(s, {})]
        states.append(max(options)[1])
    return states[::-1]


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def _unpack_states(rows: list[tuple]) -> list[Matrix]:
    mats: dict[int, Matrix] = {}
    for no, ea, et, xa, xt, v in rows:
        mats.setdefault(no, {}).setdefault((ea, et), {})[xa, xt] = v
    return [mats[i] for i in sorted(mats)]


def encode(docs: DataFrame, model: str, text: str = "text", chunk: int = CHUNK, check: bool = False, arrays: bool = False) -> DataFrame:
    """All rows and columns of `docs`, and `__ids` (binary; with `arrays` an array of int): the ids that the model's library gives, little-endian unsigned 32-bit.
    With `check` also `__same`: whether decoding them gives the text.

    Null and empty texts have no ids. Giant texts (over `chunk` characters) are encoded once for each different text, in chunks that any executor can
    take; rows that repeat one share the result. An empty table gives an empty result. A path of a model that all executors can read is needed."""
    small_batches(docs.sparkSession)
    narrow = T.StructType([*docs.schema.fields, T.StructField("__ids", T.ArrayType(T.IntegerType(), False) if arrays else T.BinaryType()), *([T.StructField("__same", T.BooleanType())] if check else [])])
    at = docs.columns.index(text)
    giant = F.length(F.coalesce(F.col(text), F.lit(""))) > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = coders(model)
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                data, offsets = text_bytes(part.column(at))
                raw = data.tobytes()
                texts = [raw[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ids = lattice.encode_bytes(data, offsets) if lattice.plain and MARK.encode() not in raw else lattice.encode([t.decode() for t in texts])
                same = [pa.array(decoder.same(ids, texts), pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids) if arrays else pa.array(ids, pa.binary()), *same], names=narrow.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = coders(model)
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s, reach = lattice.normalize([raw.as_py()])[0], lattice.longest
                n = -(-len(s) // chunk)
                rows = [(key, i, s[max(0, i * chunk - reach) : (i + 1) * chunk + reach], min(reach, i * chunk), i == n - 1) for i in range(n)]
                for lo in range(0, n, 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[lo : lo + 64], strict=True)], names=["key", "no", "s", "lo", "last"])

    def bounds(s: str, lo: int, last: bool) -> tuple[int, int]:
        return lo, len(s) if last else lo + chunk

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = coders(model)
        for b in batches:
            for key, no, s, lo, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = lattice.matrix(s, *bounds(s, lo, last), last)
                rows = [(key, no, ea, et, xa, xt, v) for (ea, et), row in m.items() for (xa, xt), v in row.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "no", "ea", "et", "xa", "xt", "v"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: str, rows: list[tuple]) -> pa.RecordBatch:
            states = boundary_states(_unpack_states(rows))
            return pa.RecordBatch.from_arrays([pa.array([key] * (len(states) - 1)), pa.array(range(len(states) - 1), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*((*a, *b) for a, b in zip(states[:-1], states[1:], strict=True)), strict=True))], names=["key", "no", "ea", "et", "xa", "xt"])

        key, rows = None, []
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key and rows:
                    yield done(key, rows)
                    rows = []
                key = k
                rows.append(tuple(row))
        if rows:
            yield done(key, rows)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = coders(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                rows = list(zip(*(c.to_pylist() for c in whole.slice(at, 32).columns), strict=True))
                ids = lattice.traces([(s, *bounds(s, lo, last), (ea, et), (xa, xt), last) for _, _, s, lo, last, ea, et, xa, xt in rows])
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array(ids, pa.binary())], names=["key", "no", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key]), _lists([b"".join(parts)]) if arrays else pa.array([b"".join(parts)], pa.binary())], names=["__key", "__ids"])
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key and parts:
                    yield out()
                    parts = []
                key = k
                parts.append(ids)
        if parts:
            yield out()

    done = docs.where(~giant).mapInArrow(lean(short), narrow)
    key = F.sha2(F.col(text).cast("binary"), 256)
    big = docs.where(giant).withColumn("__key", key)
    texts = big.select("__key", F.col(text).alias("t")).dropDuplicates(["__key"]).select(F.col("__key").alias("key"), "t")
    n_chars = big.agg(F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()[0]
    n = partitions(docs.sparkSession, n_chars, PARTITION_CHARS)
    parts = materialize(texts.mapInArrow(lean(cut), "key string, no long, s string, lo long, last boolean").repartition(n, "key", "no"), "chunks")
    states = parts.mapInArrow(lean(transfer), "key string, no long, ea long, et long, xa long, xt long, v double")
    states = states.repartition(n, "key").sortWithinPartitions("key", "no").mapInArrow(lean(settle), "key string, no long, ea long, et long, xa long, xt long")
    paths = parts.join(states, ["key", "no"]).select("key", "no", "s", "lo", "last", "ea", "et", "xa", "xt").mapInArrow(lean(trace), "key string, no long, ids binary")
    whole = paths.repartition(n, "key").sortWithinPartitions("key", "no").mapInArrow(lean(assemble), f"__key string, __ids {'array<int>' if arrays else 'binary'}")
    whole = big.join(whole, "__key")
    if check:
        whole = decode(whole, model).withColumn("__same", F.col("__decoded") == F.col(text))
    return done.unionByName(whole.select(*narrow.names))


def decode(rows: DataFrame, model: str, ids: str = "__ids", out: str = "__decoded") -> DataFrame:
    """All rows and columns of `rows`, and the text that its ids stand for; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coders(model)
        for whole in batches:
            at = whole.schema.get_field_index(ids)
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                texts = [None if x is None else decoder.decode(x) for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip: whether decoding gives the text back (a text that itself holds the mark does not)."""
    rows = encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model, check=True)
    return rows.select("doc_id", (F.length("__ids") / 4).cast("long").alias("n_tokens"), F.crc32("__ids").alias("ids_crc32"), F.col("__same").alias("round_trip"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), model or _default_model())


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """The columns of documents without the text, and its ids: n_tokens and token_ids (an array)."""
    rows = encode(docs, model or _default_model(), arrays=True)
    return rows.select(*(c for c in docs.columns if c != "text"), F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("token_ids"))
