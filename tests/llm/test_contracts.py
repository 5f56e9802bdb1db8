"""Each operator against its SQL or a brute-force version, on the small tables and on fixtures of awkward rows."""

import glob
import gzip
import hashlib
import itertools
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeforge.llm import ann, html, mixing, pieces, quality, queries, simhash, suffixes, token_files, urls, warc
from cladeforge.llm.common import scratch_path
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n", "a", "a b c", "x " * 3000, "same words here again " * 40, "same words here again " * 40, "é ü 漢字 🎉 <s> </s>", "tab\tand\r\nbreak\x0b\x0c", "word " * 49 + "last", "q" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, ties, repeats, extra columns and clashing names."""
    rows = [(i if i != 3 else None, t, "en", f"src{i % 3}" if i != 5 else None, len(t or ""), i, "x") for i, t in enumerate(ODD)] + [(4, "a", "en", "src1", 1, 9, "y")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, fp string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, same, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


# quality rules


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, words))

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        many = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, c in __import__("collections").Counter(grams).items() if c > 1}
        return {j for i, g in enumerate(grams) if g in many for j in range(i, i + n)}

    repeat = len(covered(3))
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    bad = any(100 * sum(len(words[j]) for j in covered(n)) > round(100 * top) * chars for n, top in quality.NGRAM_LIMITS.items())
    bad |= 100 * sum(len(w) for x in dup for w in WORD.findall(x)) > 20 * chars
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(dup), repeat, failed, not failed and not bad


def test_quality_brute(odd):
    got = quality.quality_rules(odd).collect()
    assert len(got) == len(ODD) + 2 and set(odd.columns) < set(got[0].asDict())
    for r in got:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed, r.q_kept) == brute_quality(r.text)


@pytest.mark.parametrize("extent", [16, 100, 1 << 20])
def test_quality_in_slices(monkeypatch, extent):
    import pyarrow as pa

    from cladeforge.llm import common

    monkeypatch.setattr(common.span_hashes, "__defaults__", (extent,))
    monkeypatch.setattr(common.span_chars, "__defaults__", (extent,))
    texts = [*ODD, "é" * 300 + " word " * 20 + "\nsame line\nsame line\n" + "z" * 500, "q r s " * 100]
    m = quality._batches(pa.array(texts, pa.string()), common.Powers())
    got = list(zip(*(m[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), strict=True))
    assert got == [brute_quality(t) for t in texts]


# SimHash


def test_fingerprints_and_components(spark, odd):
    def brute(text, k=4):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(odd).collect()
    texts = [(r.doc_id, brute(r.text)) for r in odd.collect()]
    want = {}
    for i, f in texts:
        group, grew = {f}, True
        while grew:
            more = {g for _, g in texts if any((g ^ h).bit_count() <= 4 for h in group)}
            grew, group = more != group, group | more
        want.setdefault((i, f"{f:016x}"), min((j for j, g in texts if g in group and j is not None), default=None))
    assert sorted(map(str, ((r.doc_id, r.fp, r.component_id) for r in got))) == sorted(str((i, f"{f:016x}", want[i, f"{f:016x}"])) for i, f in texts)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("words,radius", [(1, 4), (1, 9), (2, 19)])
def test_tiles_lose_no_link(spark, words, radius):
    g = np.random.default_rng(5)
    base = g.integers(0, 1 << 63, (60, words), dtype=np.uint64)
    f = np.concatenate([base, *(base[g.integers(0, 60, 300)] ^ np.bitwise_or.reduce(np.uint64(1) << g.integers(0, 64, (k, 300, words), dtype=np.uint64)) for k in (1, 2, 4))])
    f = np.unique(f, axis=0)
    names = ["".join(f"{x:016x}" for x in r) for r in f.tolist()]
    nodes = spark.createDataFrame([(n,) for n in names], "fp string")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, radius, words, tile=64)).collect()}
    lab = simhash.forest(len(f), simhash.compare(f, None, radius))
    groups, mine = {}, {}
    for i, n in enumerate(names):
        groups.setdefault(int(lab[i]), set()).add(n)
        mine.setdefault(roots.get(n, n), set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_stage_keeps_one_of_each_group(spark):
    rnd = random.Random(2)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    one, two = text(), text()
    near = one.replace(one[:6], "zzzzzz")
    docs = spark.createDataFrame([(5, one), (2, one), (3, near), (9, two), (9, two), (None, two)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, DATA).collect()) == [2, 9]


@pytest.mark.parametrize("group", [simhash.GROUP, 6])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd, texts = random.Random(7), ["", None, "a b", "A  b", "a b c", "a b c d e f g h", "a b c d e f g h i", "x y z " * 40, "x y z " * 90]
    for base in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(12 if base < 4 else 2):  # 2 to 7 % of the words, so similarities from 0.65 to 0.9
            new = list(words)
            for at in rnd.sample(range(len(words)), max(1, int(len(words) * rnd.uniform(0.01, 0.07)))):
                new[at] = f"n{rnd.randrange(10**6)}"
            texts.append(" ".join(new))

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    sets = list(map(shingles, texts))
    lab = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, DATA).collect()) == sorted(set(lab))


# nearest neighbours


def test_search_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (200, [5.0, 5.0]), (4, [1.0, None]), (5, [2.0, 2.0, 1.0]), (300, [1.0, 1.0, 1.0]), (6, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df.drop("v"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 200), (200, 1, 0), (200, 2, 1), (200, 3, 1), (300, 1, 5)]
    assert ann.search(df.drop("v").limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_search_repeated_idents_and_clashes(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [2.0, 0.0], 2), (1, [3.0, 1.0], 3), (100, [2.0, 0.0], 2), (200, [9.0, 9.0], None)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int"), (F.col("vec_id") % 100 == 0) & (F.col("v") >= 1), k=2)
    want = []
    for i, (q, x, v) in enumerate(rows):
        if q % 100 == 0 and v:
            near = sorted((float(np.hypot(x[0] - y[0], x[1] - y[1])), c) for j, (c, y, _) in enumerate(rows) if j != i)[:2]
            want += [(q, n, c, round(d, 9)) for n, (d, c) in enumerate(near, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_search_recall_on_clusters(spark):
    g = np.random.default_rng(1)
    x = (g.standard_normal((20, 96))[g.integers(0, 20, 3000)] + 0.3 * g.standard_normal((3000, 96))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = ((x[::100, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    d[np.arange(30), np.arange(0, 3000, 100)] = np.inf
    hits = sum(len(got[100 * i] & set(np.argsort(d[i])[:10].tolist())) for i in range(30))
    assert hits >= 0.99 * 300


# WARC


def test_archives_awkward_pages(spark):
    rows = [(1, "http://a.com/x", "x" * 2000), (2, "http://b.com/x", "x" * 2000), (2, "http://b.com/\r\nx", "x" * 2000), (None, None, "x" * 2000), (5, "u", None), (6, "u", "a\r\n\r\nb\r\nWARC/1.1\r\n\r\n"), (7, "u", "é" * 600), (8, "u", "é" * 600), (9, "u", "s" * 999), (10, "u", "s" * 999)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit(1)), scratch_path(spark, "w")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("1", 2000, "revisit", "2"), ("2", 2000, "response", "None"), ("2", 2000, "response", "None"), ("None", 2000, "revisit", "2"), ("5", 0, "response", "None"), ("6", 20, "response", "None"), ("7", 1200, "revisit", "8"), ("8", 1200, "response", "None"), ("9", 999, "response", "None"), ("10", 999, "response", "None")]
    )
    assert [warc.rank(tuple(r)) for r in got] == sorted(warc.rank(tuple(r)) for r in got)
    assert {r.payload_digest for r in got if r.page_id == 6} == {hashlib.sha1(rows[5][2].encode()).hexdigest()}


def test_index_points_into_the_archive(spark):
    rows = [(i, f"http://a.com/{i}", f"page {i} " * (1 + 50 * (i % 7))) for i in range(200)]
    path = scratch_path(spark, "w")
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path).collect()
    files = {f.rsplit("/", 1)[-1]: open(f, "rb").read() for f in glob.glob(path.removeprefix("file:") + "/part-*")}
    for r in index:
        header, payload = warc.fetch(files[r.run], r.offset, r.length)
        assert header["WARC-Target-URI"] == f"http://a.com/{r.page_id}" and payload.decode() == rows[r.page_id][2]
    assert sum(gzip.decompress(x).count(b"WARC/1.1\r\n") for x in files.values()) == 200
    ranges = warc.merge_runs(warc.read_runs(spark, path))
    assert [r.url_key for r in ranges.collect()] == sorted(r.url_key for r in index)


def test_loser_tree():
    rnd = random.Random(1)
    for n in range(20):
        runs = [sorted((rnd.randint(0, 9), i) for _ in range(rnd.randint(0, 6))) for i in range(n)]
        assert list(warc.LoserTree(runs, lambda r: r)) == sorted(itertools.chain(*runs))


# mixing


def test_targets():
    plan = {p.name: p for p in mixing.plan_sources([("a", 100), ("b", 1), ("c", 0), (None, 99)])}
    assert plan["b"].target == 3 and plan["c"].target == 0 and sum(p.target for p in plan.values()) == pytest.approx(200)
    assert plan["a"].target == pytest.approx(197 / 2)


def test_mix_awkward_rows(spark, odd):
    docs = odd.withColumn("size", mixing.word_count())
    got = mixing.mix(docs, also=["lang"]).collect()
    assert len(got) == len(ODD) + 2
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.target, []).append(r.taken)
    for target, taken in by.items():
        assert sum(taken) == pytest.approx(target * round(sum(taken) / target) if target and sum(taken) > 1.5 * target else target, abs=1)
    again = mixing.mix(docs.repartition(7), also=["lang"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_permutation_is_one(spark):
    plan = mixing.plan_sources([("a", 128 * 37 + 5)])
    rows = mixing.slots(spark, plan, shard=8).collect()
    assert sorted(r.block for r in rows if r.epoch == 0) == list(range(38))
    assert sum(r.words for r in rows) == plan[0].words


def test_stage_mix_takes_words(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour " * (3 + i % 5), f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    out = mixing.stage_mix(spark, docs, DATA)
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    assert got == {p.name: p.words for p in mixing.plan_sources(list(sizes.items()))}


def test_stage_mix_emits_the_drawn_blocks(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(f"{i}.{j}" for j in range(rnd.choice([1, 40, 500, 4000]))), f"s{i % 4}") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    streams = {}
    for i, text, s in sorted(docs, key=lambda d: ((d[0] * 48271 + 12345) % mixing.P % mixing.BUCKETS, d[0])):
        streams.setdefault(s, []).extend(text.split())
    plan, want = mixing.plan_sources([(s, len(w)) for s, w in streams.items()]), {}
    for r in mixing.slots(spark, plan).collect():
        for w in streams[plan[r.s].name][r.block * mixing.BLOCK :][: r.words]:
            want[w] = want.get(w, 0) + 1
    got = {}
    for r in mixing.stage_mix(spark, frame, DATA).collect():
        own = [tuple(map(int, w.split("."))) for w in r.text.split(" ")]
        assert all(d == r.doc_id for d, _ in own) and own == sorted(set(own))
        for w in r.text.split(" "):
            got[w] = got.get(w, 0) + 1
    assert got == want


# token files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_files(spark, odd, duck, tokenizer):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    rows = sorted(documents(duck))
    start, want = 0, []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.op8_token_files(spark, DATA).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    awkward = token_files.store(odd, scratch_path(spark, "t"), tokenizer).orderBy("start").collect()
    assert len(awkward) == len(ODD) + 2 and awkward[-1].doc_id is None
    assert [r.start for r in awkward] == [sum(x.n_tokens for x in awkward[:i]) for i in range(len(awkward))]
    assert token_files.store(odd.limit(0), scratch_path(spark, "t"), tokenizer).count() == 0


def test_pieces_give_the_tokenizers_ids(tokenizer):
    from tokenizers import Tokenizer

    tok, enc, rnd = Tokenizer.from_file(tokenizer), token_files.Encoder(tokenizer), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b's", "é,", ".1", " ", "　", "\x1c", "don't", "漢", "!?", "🎉"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_the_librarys(spark, tokenizer):
    from tokenizers import Tokenizer

    tok, enc, rnd = Tokenizer.from_file(tokenizer), token_files.Encoder(tokenizer), random.Random(3)
    parts = ["<|endoftext|>", " ", "\n", "a", "b's", "<|", "endoftext|>", "é", "."]
    texts = ["end of one.<|endoftext|>Start of two", "one <|endoftext|> two", "x  <|endoftext|>  y", "<|endoftext|>", "<|endo<|endoftext|>ftext|>", "", "a <|endof", "text|> b"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [437, 286, 530, 13, 50256, 10434, 286, 734]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
    got = token_files.store(spark.createDataFrame(list(enumerate(texts[:8])), "doc_id long, text string"), scratch_path(spark, "t"), tokenizer).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(w) + 1 for w in want[:8]]


def test_long_texts_in_parts(spark, monkeypatch, tokenizer):
    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(tokenizer), random.Random(5)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 3000)
    parts = ["word", " word", "  two", "\n", " 'tis", "<|endoftext|>", " é", "漢字 ", ".", " 12", "\t"]
    texts = ["".join(rnd.choice(parts) for _ in range(n)) for n in (10, 4000, 9000, 3)] + ["x" * 20_000, "<|endoftext|> " * 900]
    got = token_files.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch_path(spark, "t"), tokenizer).orderBy("doc_id").collect()
    want = [np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w) // 4, zlib.crc32(w)) for w in want]


def test_segment_random_access():
    samples = [np.arange(i, i + 200, dtype="<u4").tobytes() for i in range(300)]
    d = token_files.train_dictionary(samples, 4096)
    pack = token_files._coders(d)[0].compress
    data = token_files.pack_segment([(7, 200, pack(samples[7])), (None, 0, pack(b""))], d) + b"\n"
    s = token_files.Segment(data, d)
    assert s.ids(0) == samples[7] and s.ids(1) == b"" and s.end == len(data)
    with pytest.raises(ValueError):
        token_files.Segment(data, d + b"x")


# suffixes


def brute_suffixes(rows, width=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first, out = {}, []
    for i, b in rows:
        for p in range(len(b) - width + 1 if i is not None else 0):
            first[b[p : p + width]] = min(i, first.get(b[p : p + width], i))
    for i, b in rows:
        cut = bytearray(len(b))
        for p in range(len(b) - width + 1):
            x = first.get(b[p : p + width])
            if x is not None and (i is None or x < i):
                cut[p : p + width] = b"\1" * width
        out.append(str((i, len(b), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(bytes(c for c, f in zip(b, cut, strict=True) if not f)).hexdigest())))
    return sorted(out)


def found(df):
    out = suffixes.remove_repeats(df).select("doc_id", "__n_bytes", "__n_removed", "__n_spans", F.sha2("__kept", 256))
    return sorted(str(tuple(r)) for r in out.collect())


def test_suffixes_brute(spark, odd, duck):
    got = suffixes.op9_suffix_array_dedup(spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_suffixes(documents(duck))
    assert found(odd) == brute_suffixes([(r.doc_id, r.text) for r in odd.collect()])
    assert found(odd.limit(0)) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffixes_random(spark, seed):
    rnd = random.Random(seed)
    base = ["a" * 300, "ab" * 200, "x" * 49, "y" * 50, "".join(rnd.choice("ab") for _ in range(3000)), "".join(rnd.choice("abcdefé ") for _ in range(2000))]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            c = rnd.choice(base)
            lo = rnd.randint(0, len(c) - 1)
            t += c[lo : lo + rnd.randint(1, 300)] + "".join(rnd.choice("qwertz") for _ in range(rnd.randint(0, 3)))
        rows.append((rnd.choice([None, *range(40)]) if i % 3 == 0 else i, None if i % 50 == 7 else t))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_suffixes(rows)


def test_suffixes_giant_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 3000)
    rnd = random.Random(4)
    big = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    rows = [(1, big), (2, "zz" + big[2900:3200] + "z" + big[8970:9030]), (3, big[5:])]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_suffixes(rows)


@pytest.mark.parametrize("hot", [2, 30])
def test_hot_minimizers_change_nothing(spark, duck, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "BLOCK", 20_000)
    monkeypatch.setattr(suffixes, "HOLD", 4_000)
    rows = documents(duck)[:60]
    passage = "the passage that half of the documents hold, word by word, in all of them"
    rows += [(1000 + i, f"{i * i} {passage if i % 2 else ''} {i} tail of the document {i * 7}") for i in range(300)]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    assert sorted(str(tuple(r)) for r in out.select("doc_id", "__n_bytes", "__n_removed", "__n_spans", F.sha2("__kept", 256)).collect()) == brute_suffixes(rows)


def test_one_window_in_half_of_many_documents(spark):
    g = np.random.default_rng(3)
    words = g.integers(0, 1 << 40, (20_000, 8))
    window = "0123456789 abcdefghij klmnopqrst uvwxyz ABCDEFGHIJ"
    assert len(window) == 50
    rows = [(i, " ".join(f"{x:010x}" for x in w[:4]) + (window if i % 2 else "") + " ".join(f"{x:010x}" for x in w[4:])) for i, w in enumerate(words.tolist())]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=500)
    # where the windows' neighbours agree by chance, a few bytes more go
    got = {r.k: r.n for r in got.groupBy(F.expr("CASE WHEN __n_removed = 0 THEN 0 WHEN __n_removed BETWEEN 50 AND 70 AND __n_spans = 1 THEN 1 END").alias("k")).agg(F.count("*").alias("n")).collect()}
    assert got == {0: 10_001, 1: 9_999}


def test_blocks_without_replies_meet_the_others():
    """A block that was cut otherwise when it was announced sends its windows by both ways."""
    g = np.random.default_rng(0)
    texts = [bytes(g.choice(list(b"abcd "), 30).tolist()) + b"the passage that very many of the documents hold, word by word, in all of them" + bytes(g.choice(list(b"abcd "), 30).tolist()) for _ in range(60)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    ids, key, shift = np.arange(60), np.arange(60) * 7, np.zeros(60, np.int64)
    mapper = suffixes.Mapper(5, 3)
    part = lambda a, b: (data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    announced = [dict(mapper.announce(*part(a, b))) for a, b in ((0, 25), (25, 60))]

    def removed(hot, known):
        replies = [{}, {}]
        for bucket in set(announced[0]) | set(announced[1]):
            who = [i for i in (0, 1) if bucket in announced[i]]
            for i, x in zip(who, suffixes._shared([announced[i][bucket] for i in who], hot), strict=True):
                replies[i][bucket] = np.frombuffer(x, np.uint8)
        rows = [list(mapper.block(*part(a, b), ids[a:b], key[a:b], shift[a:b], replies[i] if known[i] else {})) for i, (a, b) in enumerate(((0, 25), (25, 60)))]
        buckets, out = {}, []
        for kind, to, x in itertools.chain(*rows):
            if kind == 0:
                out += buckets.setdefault(to, suffixes.Bucket(3)).add(x)
            else:
                out.append((kind, to, x))
        for b in buckets.values():
            out += b.finish()
        return {(int(i), p) for _, _, x in out for i, _, at, n in zip(*suffixes._unpack(x), strict=True) for p in range(int(at), int(at + n))}

    want = removed(10**9, (True, True))
    assert want and all(removed(hot, known) == want for hot in (5, 10**9) for known in itertools.product((True, False), repeat=2))


def test_many_blocks_travel_as_one_piece_a_bucket():
    """What travels grows with parcels times buckets, not with blocks times buckets, and shows the same ranges."""
    g = np.random.default_rng(1)
    base = g.choice(np.frombuffer(b"abcdefgh ", np.uint8), 40_000)
    blocks = [[base[(lo := int(g.integers(0, 39_000))) : lo + 400] for _ in range(5)] for _ in range(24)]

    def removed(together):
        mapper, rows = suffixes.Mapper(16, 4), []
        for n, texts in enumerate(blocks):
            ids = np.arange(5) + 5 * n
            block = (np.concatenate(texts), np.cumsum([0, *map(len, texts)]), ids, ids * 7, np.zeros(5, np.int64), {})
            if together:
                mapper.take(*block)
            else:
                rows += mapper.block(*block)
        rows += mapper.flush()
        buckets, out = {}, [x for kind, _, x in rows if kind == 1]
        for kind, to, x in rows:
            if kind == 0:
                out += [y for _, _, y in buckets.setdefault(to, suffixes.Bucket(4)).add(x)]
        out += [y for b in buckets.values() for _, _, y in b.finish()]
        return sum(kind == 0 for kind, _, _ in rows), {(int(i), p) for x in out for i, _, at, n in zip(*suffixes._unpack(x), strict=True) for p in range(int(at), int(at + n))}

    pieces_of_blocks, want = removed(False)
    pieces_of_a_parcel, got = removed(True)
    assert want and got == want and pieces_of_a_parcel <= 16 < pieces_of_blocks


@pytest.mark.parametrize("width", [24, 40, 100])
def test_suffixes_other_widths(spark, width):
    rnd = random.Random(width)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(i, "".join(base[(lo := rnd.randrange(800)) : lo + rnd.randint(width - 3, width + 30)] + rnd.choice("xyz") * 3 for _ in range(4))) for i in range(30)]
    seen, want = set(), []
    for i, t in rows:
        own = {t[k : k + width] for k in range(len(t) - width + 1)}
        gone = {j for k in range(len(t) - width + 1) if t[k : k + width] in seen for j in range(k, k + width)}
        seen |= own
        want.append((i, len(gone)))
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=width)
    assert sorted((r.doc_id, r["__n_removed"]) for r in out.collect()) == want


def test_suffixes_clashing_names(spark):
    rows = [(1, "a" * 60, 1, 2, 3, "b", 5, "c"), (2, "b" + "a" * 60, 1, 2, 3, "b", 5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __g int, __kind int, __key int, __blob string, __n_spans int, c1 string")
    got = suffixes.remove_repeats(df).orderBy("doc_id").collect()
    assert [(r["__g"], r["__kind"], r["__key"], r["__blob"], r.c1, r["__n_removed"], r["__n_spans"]) for r in got] == [(1, 2, 3, "b", "c", 0, 0), (1, 2, 3, "b", "c", 60, 1)]


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces._default_model()


def test_pieces_equal_the_library(spark, duck, odd, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = dict(documents(duck))
    for r in pieces.op2_sentencepiece(spark, DATA).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    rows = pieces.decode(pieces.encode(odd, model, chunk=500), model).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert np.frombuffer(r["__ids"], "<u4").tolist() == sp.encode(r.text or "") and r["__decoded"] == (r.text or "")
    assert pieces.encode(odd.limit(0), model).count() == 0


def test_chunks_cut_anywhere(model):
    lattice, rnd = pieces.Lattice(model), random.Random(5)
    for _ in range(150):
        text = "".join(rnd.choice(["the", " ", "ing", "  ", "tion", "a", "ö", "\n", "漢", "🎉", ". ", "10", "▁"]) for _ in range(rnd.randint(1, 50)))
        s = lattice.normalize([text])[0]
        for size in (3, 17, 64):
            n, r = -(-len(s) // size), lattice.longest
            parts = [(s[max(0, i * size - r) : (i + 1) * size + r], min(r, i * size), i == n - 1) for i in range(n)]
            parts = [(x, lo, len(x) if last else lo + size, last) for x, lo, last in parts]
            states = pieces.boundary_states([lattice.matrix(*p) for p in parts])
            ids = b"".join(lattice.traces([(x, lo, hi, i, o, last) for (x, lo, hi, last), i, o in zip(parts, states[:-1], states[1:], strict=True)]))
            assert np.frombuffer(ids, "<u4").tolist() == lattice.sp.encode(text)


def test_matrices_combine_associatively(model):
    lattice = pieces.Lattice(model)
    s = lattice.normalize(["internationalisation of the unbelievable " * 3])[0]
    m = [lattice.matrix(s, i, min(i + 9, len(s)), i + 9 >= len(s)) for i in range(0, len(s), 9)]
    for a, b, c in zip(m, m[1:], m[2:], strict=False):
        assert pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))


# URLs and HTML


def test_urls_awkward(spark):
    rows = [(1, "http://a.org/x", '<a href="http://B.com/q">'), (2, "http://b.com/q", "<a href='//c.net/'> <a href=https://d.com/de/1>"), (3, "https://d.com/de/2", ""), (4, None, None), (5, "nohost", "x"), (6, "HTTP://E.COM?x", '<a href="http://d.com/de/2"/>'), (7, "http://c.net#a", ""), (7, "http://c.net#a", "")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z"))).collect()}
    assert got == {(1, "a.org", "/x", "org/", "allow"), (2, "b.com", "/q", None, "allow"), (3, "d.com", "/de/2", "com/de/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "e.com", "", None, "block"), (7, "c.net", "", None, "allow")}


def test_urls_far_and_faint_distrust(spark):
    link = lambda to: f"<a href='http://{to}/'>"
    rows = [("http://bad.com/de/1", "")] + [(f"http://far{i}.net/", link(f"far{i - 1}.net" if i else "bad.com")) for i in range(20)]
    rows += [("http://worse.com/de/1", "")] + [(f"http://faint{i}.net/", link(f"faint{i - 1}.net" if i else "worse.com")) for i in range(7)]
    rows += [(f"http://x{i}y{j}.net/", link(f"faint{i}.net")) for i in range(7) for j in range(99)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert {r.verdict for r in urls.filter_urls(pages).collect()} == {"block"}


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>one<br>two &nbsp; <b>three</b><p>four</p><aside>no</aside><section id='comments'><p>me too</p></section></article><footer>&copy; x</footer>"


def test_article_page(spark):
    assert [t for k, t in html.blocks(PAGE) if k == html.ARTICLE] == ["Head & more", "one two three", "four"]
    assert html.blocks("") == [] and html.blocks("<p>a < b & c") == [(html.OPEN, "a < b & c")]
    got = html.extract(spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", "")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [("Head & more\n\none two three\n\nfour", 32), ("", 0), ("", 0)]


def test_host_boilerplate(spark):
    page = lambda i, host: (i, f"http://{host}/{i}", f"<div>Home About us and contact our team for more news today</div><div>body {' '.join(f'w{i}x{j}' for j in range(12))}</div><div>All rights reserved by the owner of this very nice site</div>")
    rows = [page(i, "h.com") for i in range(5)] + [page(3, "h.com"), page(9, "other.com")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].startswith("body w2x0") and got[2].endswith("w2x11") and got[3].startswith("body w3x0")
    assert "contact our team" in got[9]


class Articles(HTMLParser):
    """An independent reading of the pages of the test tables: the text of headings and paragraphs in the article element."""

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.now = False, [], ""

    def end(self):
        if text := " ".join(self.now.split()):
            self.out.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag not in ("b", "a", "i", "em", "span"):
            if self.inside:
                self.end()
            self.inside |= tag == "article"
            self.now = self.now if self.inside else ""

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i", "em", "span", "br") and self.inside:
            self.end()
            self.inside &= tag != "article"

    def handle_data(self, data):
        self.now += data if self.inside else ""


def test_pages_brute(spark, duck):
    got = {r.page_id: r.text for r in html.op10_html_extraction(spark, DATA).collect()}
    pages = duck.sql("SELECT page_id, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for i, page in pages:
        reader = Articles()
        reader.feed(page)
        assert got[i] == "\n\n".join(reader.out), i


def words_of(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


NOTICE = "Sign up for our daily letter and get the best stories of the week in your mail box every Monday morning for free"


@pytest.fixture(scope="module")
def hosts(spark):
    """Pages of hosts without any telling class, and what is to stay of each."""
    rnd, rows, want = random.Random(3), [], {}
    menu = "home news sports weather culture travel about us contact imprint jobs advertise with us here"
    near, quote = words_of(rnd, 200).split(), words_of(rnd, 60)
    for i in range(12):
        a, b, c = words_of(rnd, 120), words_of(rnd, 60), words_of(rnd, 5)
        rows.append((i, f"http://a.example/{i}", f"<article><h1>{c}</h1><p>{a}</p><div>{NOTICE}</div><p>{b}</p></article>"))
        want[i] = "\n\n".join((c, a, b))
        rows.append((100 + i, f"http://b.example/{i}", f"<div>{menu}</div><div><p>{a}</p><p>{b}</p></div><div>{NOTICE}</div>"))
        want[100 + i] = f"{a}\n\n{b}"
    for i in range(40):  # near copies of one article, with and without the element
        text = " ".join([*near[: 4 * i], f"changed{i}", *near[4 * i + 1 :]])
        rows += [(1000 + i, f"http://c.example/{i}", f"<article><p>{text}</p></article>"), (2000 + i, f"http://d.example/{i}", f"<div><p>{text}</p></div>")]
        want |= {1000 + i: text, 2000 + i: text}
    for i in range(20):  # a passage that a third of the articles quote
        parts = [words_of(rnd, 50), *([quote] if i % 3 == 0 else []), words_of(rnd, 30)]
        rows.append((3000 + i, f"http://e.example/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"))
        want[3000 + i] = "\n\n".join(parts)
    rows += [rows[0]] * 3 + [(0, "http://a.example/other", f"<article>{words_of(rnd, 0)}</article>")]  # repeated rows and idents
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows, want


def test_host_decides(spark, hosts, monkeypatch):
    df, rows, want = hosts
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    assert all(r.text == want[r.page_id] for r in got if r.text) and sum(not r.text for r in got) == 1
    monkeypatch.setattr(html, "_stands", lambda n, pages: F.lit(False))  # without the suffix array's verdict the notice stays
    got = {r.page_id: r.text for r in html.extract(df.where("page_id BETWEEN 1 AND 111")).collect()}
    assert all(NOTICE in got[i] for i in [*range(1, 12), *range(100, 112)])


def test_all_words_tell_pages_apart(spark):
    """Hosts of three pages that are menu for the most part: the least windows of two may all be the menu's. And near copies beside a page that quotes them."""
    rnd, rows, want = random.Random(8), [], {}
    for h in range(30):
        menu = words_of(rnd, 120)
        for i in range(3):
            want[10 * h + i] = words_of(rnd, 60)
            rows.append((10 * h + i, f"http://m{h}.example/{i}", f"<div>{menu}</div><p>{want[10 * h + i]}</p>"))
        near, more = words_of(rnd, 40).split(), words_of(rnd, 60)
        for i in range(6):
            text = " ".join([*near[: 4 * i], f"changed{i}", *near[4 * i + 1 :]])
            parts = [words_of(rnd, 50), more, words_of(rnd, 30)] if i == 5 else [text, more]
            want[1000 + 10 * h + i] = "\n\n".join(parts)
            rows.append((1000 + 10 * h + i, f"http://n{h}.example/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_names_of_classes():
    apart = lambda attrs, tag="div": html.blocks(f"<article><p>text</p><{tag} {attrs}>inner</{tag}></article>") == [(html.ARTICLE, "text"), (html.OTHER, "inner")]
    assert all(apart(f'class="{c}"') for c in ("ad", "cookie-notice", "x comments", "site-footer", "related-posts", "share", "newsletter_box"))
    assert not any(apart(f'class="{c}"') for c in ("has-sidebar", "with-ads", "shared", "related-work", "address", "social-history", "noticeable", "admin"))
    assert apart('id="comments"') and not apart('id="related-work"') and not apart('id="social-security"', "h2") and not apart('class="menu"', "h2")
    kept = '<body class="has-sidebar"><article class="post sidebar"><p>one</p></article></body>'
    assert html.blocks(kept) == [(html.ARTICLE, "one")]
    lost = '<div class="ad">buy<article><p>one</p></article>'  # never closed
    assert (html.ARTICLE, "one") in html.blocks(lost) and (html.OTHER, "buy") in html.blocks(lost)
    inside = '<article><p>one</p></article><div class="comments"><article><p>me too</p></article></div>'
    assert [t for k, t in html.blocks(inside) if k == html.ARTICLE] == ["one"]


@pytest.mark.parametrize("page", ["<script>" * 20_000, "<div>" * 20_000 + "x", "<a '" * 20_000, "<" * 100_000, "<p " * 50_000, "<!-- " * 20_000, "<p>a</b>" * 20_000, "<svg/>x" * 20_000])
def test_awkward_markup_takes_linear_time(page):
    began = time.perf_counter()
    html.blocks(page)
    assert time.perf_counter() - began < 5


def test_suffix_order():
    g = np.random.default_rng(2)
    t, at = g.integers(0, 3, 200), np.arange(0, 195)
    order = html.suffix_order(t, at, 5)
    assert sorted(order.tolist()) == at.tolist()
    assert all(tuple(t[a : a + 5]) <= tuple(t[b : b + 5]) for a, b in zip(order, order[1:], strict=False))


def test_near_copies_of_the_documents(spark, duck):
    """The op7 query and the pipeline's stage against brute force over the whole small table."""
    rows = [(i, t or "") for i, t in documents(duck)]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op7_simhash_near_dedup(spark, DATA).collect()}
    ids = sorted(got)
    for i, t in rows:
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(len(w) - 3, 1))] if w else []
        assert got[i][0] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def groups(linked):
        root = {i: i for i in ids}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for n, i in enumerate(ids):
            for j in ids[:n]:
                if linked(i, j) and top(i) != top(j):
                    root[max(top(i), top(j))] = min(top(i), top(j))
        return {i: top(i) for i in ids}

    assert {i: c for i, (_, c) in got.items()} == groups(lambda i, j: (got[i][0] ^ got[j][0]).bit_count() <= 4)
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in rows}
    stay = simhash.stage_simhash(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    assert {r.doc_id for r in stay.collect()} == set(groups(lambda i, j: simhash.similar(sets[i], sets[j])).values())


def test_size_bins_reach():
    n = np.arange(1, 20_000, dtype=np.uint64)
    assert (simhash._size_bin(n * np.uint64(5) // np.uint64(4)) - simhash._size_bin(n) <= simhash.BIN_REACH).all()
