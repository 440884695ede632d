"""Importance resampling towards a target distribution of hashed word runs.

Words with their offsets come from an untrained pre-tokeniser, a split by a pattern over texts in lower case (ASCII only).
A window over neighbouring offset pairs is a run of words; the CRC of its words, joined by one space, names its bucket.
Bucket histograms of the corpus and of the target give a gain a bucket, a document's weight is the mean gain of its runs,
and with Gumbel noise from a hash of the document's id the highest scores are a sample without replacement.

A document's buckets are written once and serve for the histogram and the weights. Ranks come from sorted ranges of
scores and the numbers of rows in the ranges before, so no task holds more than its range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from .shared import Workspace, lean_batches, small, table
from .textnp import chunks, column, trim

#: Fixed by the contract: what a word is, words of the longest run, buckets, words of a document that may be drawn, per cent drawn.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST, BUCKETS, LEAST_WORDS, PER_CENT, SEED = 2, 10_000, 20, 25, 7
#: Bytes of texts that are looked at together, and that are split at once.
BLOCK, PIECE = 8 << 20, 1 << 16


@cache
def _splitter(pattern: str) -> Split:
    return Split(Regex(pattern), "removed", invert=True)


def words_of(text: str, pattern: str = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the words of ``text``."""
    cut = PreTokenizedString(text)
    _splitter(pattern).pre_tokenize(cut)
    offsets = [o for _, o, _ in cut.get_splits("original", "byte")]
    if not offsets or offsets == [(0, 0)]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.array(offsets, np.int64)
    return at[:, 0], at[:, 1]


def _fragments(data: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct fragments of all rows, each from a space (or a row's start) on to the next; what each row has of them."""
    here = data == 0x20
    here[offs[:-1][offs[:-1] < len(data)]] = True
    at = np.flatnonzero(here)
    raw, known = data.tobytes(), {}
    edges = [*at.tolist(), len(raw)]
    index = np.fromiter((known.setdefault(raw[i:j], len(known)) for i, j in zip(edges, edges[1:])), np.int64, len(at))
    return list(known), index, np.diff(np.searchsorted(at, offs))


def runs(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, runs of each row, and the buckets of the runs, row after row.

    Fragments between spaces are split once however often they occur: a space is in no word.
    """
    fragments, index, per_row = _fragments(data, offs)
    size = np.fromiter(map(len, fragments), np.int64, len(fragments)) + 1
    ends = np.cumsum(size)
    words: list[bytes] = []
    of = []
    for part in np.split(np.arange(len(fragments)), np.flatnonzero(np.diff((ends - size) // PIECE)) + 1):
        if len(part):
            joined = b" ".join([fragments[i] for i in part.tolist()])
            first, last = words_of(joined.decode())
            words += [joined[i:j] for i, j in zip(first.tolist(), last.tolist())]
            base = ends[part[0]] - size[part[0]]
            of.append(part[np.searchsorted(ends[part] - base, first, "right")])
    of = np.concatenate(of) if of else np.zeros(0, np.int64)
    n_words = np.bincount(of, minlength=len(fragments)).astype(np.int64)
    first = np.cumsum(n_words) - n_words
    count = n_words[index]
    ends = np.cumsum(count)
    word = np.repeat(first[index] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    row = np.repeat(np.repeat(np.arange(len(per_row)), per_row), count)
    own = np.bincount(row, minlength=len(per_row)).astype(np.int64)
    at = np.cumsum(own) - own
    place = np.arange(len(row)) - at[row]  # of a word in its row
    # A run of n words that ends at a word continues the checksum of the run of n - 1 words that ends before it and of a space.
    so_far = np.fromiter((crc32(w) for w in words), np.uint32, len(words))[word]
    spaced = np.fromiter((crc32(b" ", crc32(w)) for w in words), np.uint32, len(words))[word] if longest > 1 else so_far
    rows, found, text = [row], [so_far % buckets], None
    for n in range(2, longest + 1):
        ending = np.flatnonzero(place >= n - 1)
        text = text or list(map(words.__getitem__, word.tolist()))
        sums = np.fromiter(map(crc32, [text[i] for i in ending.tolist()], spaced[ending - 1].tolist()), np.uint32, len(ending))
        rows.append(row[ending])
        found.append(sums % buckets)
        if n < longest:
            whole = np.zeros(len(row), np.uint32)
            whole[ending] = np.fromiter((crc32(b" ", c) for c in sums.tolist()), np.uint32, len(ending))
            spaced = whole
    rows, found = np.concatenate(rows), np.concatenate(found)
    return own, np.bincount(rows, minlength=len(per_row)).astype(np.int64), found[np.argsort(rows, kind="stable")]


def features(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_words, n_features and the buckets of all runs (little-endian unsigned 32-bit numbers) of every row of ``docs``."""
    lean_batches(docs.sparkSession)
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("n_words long, n_features long, buckets binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(pc.ascii_lower(column(batch, "_text")), BLOCK):
                n_words, n, found = runs(data, offs, buckets, longest)
                ends = np.concatenate([[0], np.cumsum(n)]) * 4
                held = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(found.astype("<u4").tobytes())])
                own = [column(batch, c).slice(a, b - a) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_words), pa.array(n), held.cast(pa.binary())], names=schema.names)
            trim()

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def histogram(made: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """How many runs of ``features`` each bucket has: at most ``buckets`` numbers, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, _ in chunks(column(batch, "buckets")):
                total += np.bincount(data.view("<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = made.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r.bucket: r.n for r in rows}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of the target's share over the corpus' share of each bucket, rounded down; one is added to every bucket."""
    total_s, total_t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = (((target.get(k, 0) + 1.0) * total_s) / ((corpus.get(k, 0) + 1.0) * total_t) for k in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from the first 8 hexadecimal digits of sha256 of ``seed:doc_id``."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], ws: Workspace, name: str = "rank") -> DataFrame:
    """``rows`` with a column ``rank``: 1, 2, 3... in ``order``, by ranges that are sorted each for itself."""
    kept = rows.columns
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = ws.write(dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), name)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = dealt.join(small(ws.write(before, f"{name}-before")), F.col("_part") == F.col("_of"))
    return out.select(*kept, (F.col("_own") + F.col("_before")).cast("long").alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text) as drawn towards ``target`` (text).

    Of the rows with ``least_words`` words or more, ``per_cent`` per cent (rounded down) are drawn, those with the highest
    scores, ties to the smaller doc_id; rank counts them from 1 and is null for all others. A null or empty text has no
    features and weight 0, and is never drawn where words are asked for. Rows that repeat a doc_id are rows of their own
    with the same noise, and equal ones are ranked in any order; a null doc_id is noised as an empty one and comes first
    among ties. Texts of any length are read whole. Other columns are not read, whatever their names. An empty table gives
    no rows; an empty target is one where every bucket is as likely.
    """
    ws = Workspace(docs.sparkSession, "resample")
    made = ws.write(features(docs, buckets, longest), "features")
    gain = docs.sparkSession.sparkContext.broadcast(gains(histogram(made, buckets), histogram(features(target.select("text"), buckets, longest, ()), buckets), buckets))
    schema = StructType([made.schema["doc_id"], *StructType.fromDDL("n_words long, n_features long, weight long").fields])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = column(batch, "n_features").to_numpy()
            total = np.zeros(len(n), np.int64)
            for a, b, data, offs in chunks(column(batch, "buckets"), BLOCK):
                upto = np.concatenate([[0], np.cumsum(gain.value[data.view("<u4")])])
                total[a:b] = np.diff(upto[offs // 4])
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_words"), pa.array(n), pa.array(weight)], names=schema.names)
        trim()

    scored = made.mapInArrow(weigh, schema)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("may", F.col("n_words") >= least_words)
    scored = ws.write(scored.drop("n_words"), "scored")
    drawn = scored.where("may").count() * per_cent // 100
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    out = ranked(scored, order, ws)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def op13_target_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
