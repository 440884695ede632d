"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark every n-gram of a text that occurs in it twice or more. What counts is
how many characters of words lie inside marked n-grams, or inside repeated lines, as a share of all characters of
words. Hashes are worked out in numpy for a whole batch of texts; n-grams with equal hashes are compared by the hashes
of their words, so two different n-grams count as one only if 64-bit hashes of different words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .shared import lean_batches, table
from .textnp import BYTE, U, chunks, column, mix, ngrams, prefix, spans, words

#: Largest share of characters inside repeated n-grams by n-gram length, and inside repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS_LIMIT = 0.20
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_dup_chars long, "
    "line_coverage double, ngram_coverage array<double>, base_failed boolean, kept boolean"
)


def _repeated(keys: np.ndarray, rows: np.ndarray, first_too: bool) -> np.ndarray:
    """Which keys occur more than once within their row; without ``first_too`` the first occurrence is left out."""
    if not len(keys):
        return np.zeros(0, bool)
    key = mix(keys + rows.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first_too:
        out[order[:-1][same]] = True
    return out


def _by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def measure(data: np.ndarray, offs: np.ndarray, limits=None, line_limit: float = LINE_CHARS_LIMIT) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for the rows of one chunk."""
    limits = NGRAM_LIMITS if limits is None else limits
    n = len(offs) - 1
    starts, ends, count = words(data, offs)
    rows = np.repeat(np.arange(n), count)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    chars = points[ends] - points[starts]
    pre = prefix(np.take(BYTE, data))
    h = spans(pre, starts, ends)
    word_chars = _by_row(chars, rows, n)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_symbols = symbols[offs[1:]] - symbols[offs[:-1]]

    # Lines: split at \n and at row ends; a line counts if it has a word.
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(breaks + 1, offs[:-1][offs[1:] > offs[:-1]])
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offs, line_start, "right") - 1
    line_end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_start)], offs[line_row + 1])
    first_word = np.searchsorted(starts, line_start)
    last_word = np.searchsorted(starts, line_end)
    real = last_word > first_word
    line_start, line_end, line_row = line_start[real], line_end[real], line_row[real]
    before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = before[last_word[real]] - before[first_word[real]]
    dup = _repeated(spans(pre, line_start, line_end), line_row, False)
    n_dup_lines = _by_row(dup, line_row, n)
    n_dup_chars = _by_row(line_chars * dup, line_row, n)

    shares, repeat_words = [], np.zeros(n, np.int64)
    for size in sorted({5, *limits}):
        grams = ngrams(h, size)
        within = rows[: len(grams)] == rows[size - 1 :] if len(grams) else np.zeros(0, bool)
        at = np.flatnonzero(within)
        hit = at[_repeated(grams[at], rows[at], True)]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        if size == 5:
            repeat_words = _by_row(covered, rows, n)
        if size in limits:
            shares.append(_by_row(chars * covered, rows, n) / np.maximum(word_chars, 1))
    failed = (count < 10) | (100 * repeat_words > 20 * count)
    line_share = n_dup_chars / np.maximum(word_chars, 1)
    kept = ~failed & (line_share <= line_limit)
    for limit, share in zip([limits[k] for k in sorted(limits)], shares, strict=True):
        kept &= share <= limit
    return {
        "n_words": count.astype(np.int64), "word_chars": word_chars, "n_symbols": n_symbols.astype(np.int64), "n_dup_lines": n_dup_lines,
        "n_repeat_words": repeat_words, "n_dup_chars": n_dup_chars, "line_coverage": line_share, "ngram_coverage": np.array(shares).T.reshape(n, -1),
        "base_failed": failed, "kept": kept,
    }


#: Names of the columns that quality_rules adds.
ADDED = [f.split()[0] for f in SCHEMA.split(", ")]


def quality_rules(docs: DataFrame, limits=None, line_limit: float = LINE_CHARS_LIMIT) -> DataFrame:
    """Add the measures of SCHEMA and the verdict ``kept`` to every row of ``docs``; columns of these names are replaced.

    Rows that repeat are judged each for itself; an empty table stays empty, with the columns of SCHEMA.

    A null text has no words; it and an empty text fail the base rule (fewer than ten words). Nothing is shuffled. A
    very long text is worked on alone, at about 100 bytes of memory a byte of text.
    """
    lean_batches(docs.sparkSession)
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    own = ADDED
    docs = docs.drop(*own)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(column(batch, "text")):
                m = measure(data, offs, limits, line_limit)
                part = batch.slice(a, b - a)
                cells = [pa.array(list(m[k])) if m[k].ndim > 1 else pa.array(m[k]) for k in own]
                if b - a and not m["ngram_coverage"].shape[1]:
                    cells[own.index("ngram_coverage")] = pa.array([[]] * (b - a), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *cells], names=[*part.schema.names, *own])

    return docs.mapInArrow(run, schema)


def op4_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_GRAMS = ", ".join(f"({k}, {v})" for k, v in NGRAM_LIMITS.items())
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (
  SELECT w.doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram
  FROM w, (VALUES {_GRAMS}) AS s(n, lim), LATERAL (SELECT unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i) AS p),
rep AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, n, i + o AS i FROM rep, LATERAL (SELECT unnest(range(0, n)) AS o) AS q),
c AS (
  SELECT cov.doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM cov JOIN u ON u.doc_id = cov.doc_id AND u.i = cov.i GROUP BY ALL),
l0 AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
l2 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ld AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM l2 WHERE k > 1 GROUP BY doc_id),
b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ld.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(ld.chars, 0) AS BIGINT) AS dup_chars,
         CAST(coalesce((SELECT words FROM c WHERE c.doc_id = w.doc_id AND n = 5), 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN ld USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
bad AS (
  SELECT DISTINCT c.doc_id FROM c JOIN b USING (doc_id) JOIN (VALUES {_GRAMS}) AS s(n, lim) ON s.n = c.n
  WHERE c.chars::DOUBLE / greatest(word_chars, 1)::DOUBLE > lim::DOUBLE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AND dup_chars::DOUBLE / greatest(word_chars, 1)::DOUBLE <= {LINE_CHARS_LIMIT}::DOUBLE AS kept
FROM f
"""
