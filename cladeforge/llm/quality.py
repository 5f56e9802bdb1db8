"""Quality rules: repetition coverage by rolling n-gram hashes.

For several n-gram lengths the share of a document's word characters that lie inside an n-gram found twice
or more in it is measured, and the share inside repeated lines; a document that exceeds a limit is rejected.
Everything is one narrow pass over Arrow batches; no row leaves its partition and no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cladeforge.llm.common import Powers, lean, mix64, row_blocks, small_batches, span_chars, span_hashes, table, text_bytes, word_spans

#: The highest share of characters inside repeated n-grams, by n, and inside repeated lines (Rae et al. 2021).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
#: The base rule's window, symbols, fewest words and highest share of repeated words in percent.
REPEAT_WINDOW, SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT = 3, "#*$%&|<>", 50, 50
BLOCK_BYTES = 2 << 20
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _in_repeats(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words stand in an n-word window that its document holds twice or more. hashes: of the n-word windows."""
    covered = np.zeros(len(doc) + 1, np.int64)
    if len(doc) >= n:
        at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        keys = mix64(hashes[at] + mix64(doc[at].astype(np.uint64)))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            found = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            at = at[twice[found] == keys]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
    return np.cumsum(covered[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> dict[str, np.ndarray]:
    """The measures of a block of documents (concatenated UTF-8 and offsets)."""
    n_docs = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    count = lambda weight: np.bincount(doc, weight, n_docs).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    symbols = np.searchsorted(offsets, np.flatnonzero(symbol[data]), "right") - 1
    chars, words = span_chars(data, start, end), span_hashes(data, start, end, powers)
    out = {"n_words": np.bincount(doc, minlength=n_docs).astype(np.int64), "word_chars": count(chars), "n_symbols": np.bincount(symbols, minlength=n_docs).astype(np.int64)}
    rolling = words.copy()
    for n in range(2, max(NGRAM_LIMITS) + 1):
        if len(words) < n:
            rolling = rolling[:0]
        else:
            rolling = mix64(rolling[: len(words) - n + 1] * np.uint64(0x2545F4914F6CDD1D) + words[n - 1 :])
        if n == REPEAT_WINDOW or n in NGRAM_LIMITS:
            covered = _in_repeats(rolling, doc, n)
            if n == REPEAT_WINDOW:
                out["n_repeat_words"] = count(covered)
            if n in NGRAM_LIMITS:
                out[f"covered_{n}"] = count(np.where(covered, chars, 0))
    # lines: of the words, the first in each line tells that it has one
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < max(len(data), 1)] if len(data) else line_start[:0]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end, 1) - 1] == 10) if len(data) else 0)
    first = np.searchsorted(start, line_start)
    has = (first < len(start)) & (np.append(start, len(data) + 1)[np.minimum(first, len(start))] < line_end)
    line_start, line_end = line_start[has], line_end[has]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    keys = mix64(span_hashes(data, line_start, line_end, powers) + mix64(line_doc.astype(np.uint64)))
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    again = first[inverse] != np.arange(len(keys)) if len(keys) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs).astype(np.int64)
    of_line = np.zeros(len(keys) + 1, np.int64)
    if len(keys):
        np.cumsum(np.bincount(np.searchsorted(line_start, start, "right") - 1, chars, len(keys)).astype(np.int64), out=of_line[1:])
    out["line_chars"] = np.bincount(line_doc[again], np.diff(of_line)[again], n_docs).astype(np.int64)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    kept = ~base_failed & (100 * m["line_chars"] <= round(100 * LINE_LIMIT) * m["word_chars"])
    for n, limit in NGRAM_LIMITS.items():
        kept &= 100 * m[f"covered_{n}"] <= round(100 * limit) * m["word_chars"]
    return base_failed, kept


def _batches(column: pa.Array, powers: Powers) -> dict[str, np.ndarray]:
    data, offsets = text_bytes(column)
    parts = []
    for lo, hi in row_blocks(offsets, BLOCK_BYTES):
        part = measure(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], powers)
        part["base_failed"], part["kept"] = verdicts(part)
        parts.append(part)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def quality_rules(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """All rows and columns of `docs`, and `<prefix>` + n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    covered_<n> for the n-gram lengths, line_chars (long), base_failed and kept (boolean).

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, and a document's measures that lie exactly on a limit pass. Columns of `docs`
    that are called like new ones give way to them; others keep their values whatever their names. A text is measured as a whole: its bytes pass
    in slices, its words take about 100 bytes each. An empty table gives an empty result.
    """
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    names = [*COLUMNS, *(f"covered_{n}" for n in NGRAM_LIMITS), "line_chars", "base_failed", "kept"]
    docs = docs.drop(*(prefix + c for c in names))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + c, T.BooleanType() if c in ("base_failed", "kept") else T.LongType()) for c in names)])
    at = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            if b.num_rows:
                m = _batches(b.column(at), powers)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m[c]) for c in names)], names=[*b.schema.names, *(prefix + c for c in names)])

    return docs.mapInArrow(lean(judge), schema)


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select("doc_id", "text"), prefix="").drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects, with their columns and as often as they come; null and short texts are rejected by the base rule, and an empty table stays empty."""
    return quality_rules(docs, prefix="__q_").where("__q_kept").select(*docs.columns)


_LIMITS_SQL = ", ".join(f"({n}, {round(100 * v)})" for n, v in NGRAM_LIMITS.items())
ORACLE_OP3 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
split AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split),
limits(n, top) AS (VALUES (3, 0), {_LIMITS_SQL}),
led AS (SELECT r, i, w, {", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, 10))} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS ({" UNION ALL ".join(f"SELECT r, {n} AS n, i, concat_ws(' ', w, {', '.join(f'w{k}' for k in range(1, n))}) AS g FROM led WHERE w{n - 1} IS NOT NULL" for n in (REPEAT_WINDOW, *NGRAM_LIMITS))}),
windows AS (SELECT r, n, unnest(s) AS i, len(s) AS c FROM (SELECT r, n, list(i) AS s FROM grams GROUP BY r, n, g HAVING count(*) > 1)),
inside AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM windows WHERE c > 1),
covered AS (SELECT r, n, count(*) AS words, sum(length(w)) AS chars FROM inside JOIN words USING (r, i) GROUP BY r, n),
sizes AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines WHERE k > 1 GROUP BY r),
bad AS (SELECT DISTINCT r FROM covered JOIN limits USING (n) JOIN sizes USING (r) WHERE n >= 5 AND 100 * chars > top * word_chars
        UNION SELECT r FROM dup JOIN sizes USING (r) WHERE 100 * dup.chars > {round(100 * LINE_LIMIT)} * word_chars),
three AS (SELECT r, words FROM covered WHERE n = 3),
{"".join(f"c{n} AS (SELECT r, chars FROM covered WHERE n = {n})," for n in NGRAM_LIMITS)}
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM (
  SELECT doc_id, r, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(three.words, 0) AS BIGINT) AS n_repeat_words, {", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS covered_{n}" for n in NGRAM_LIMITS)},
    CAST(coalesce(dup.chars, 0) AS BIGINT) AS line_chars
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN dup USING (r) LEFT JOIN three USING (r) {" ".join(f"LEFT JOIN c{n} USING (r)" for n in NGRAM_LIMITS)}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {", ".join(f"covered_{n}" for n in NGRAM_LIMITS)}, line_chars,
  base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM judged
"""
