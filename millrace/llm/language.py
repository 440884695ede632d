"""Language identification in two steps: the family first, then the language within it.

Texts are seen as runs of two to four bytes of their letters in lower case, hashed into buckets; a text's features are the
shares of its runs. Linear support vector machines, one a family against the rest, choose the family; within a family
one machine for every two languages has a vote, and most votes win. All machines are fitted by dual coordinate descent in
numpy on a bounded sample of labelled rows; whole texts are scored in tasks, as sums of weights over all runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import lean_batches, small, table
from .textnp import chunks, column, trim

#: Families of languages by ISO 639 code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Rows of the sample in all, buckets, lengths of the runs in bytes; what the machines pay for an error, passes over the sample.
SAMPLE, BUCKETS, LENGTHS, COST, PASSES = 3000, 1 << 13, (2, 3, 4), 1.0, 30
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_KEPT = np.full(256, 0x20, np.uint8)
_KEPT[0x61:0x7B], _KEPT[0x80:] = np.arange(0x61, 0x7B), np.arange(0x80, 256)


def runs(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts of the rows in what is left of them, how many runs each has, and for each length the bucket of the run at each place.

    What isn't a letter becomes a space, several spaces one, and a row begins and ends with one. A run that would leave
    its row has the bucket ``buckets``.
    """
    kept = np.insert(_KEPT[data], offs[1:], 0x20)  # a space after each row
    ends = offs[1:] + np.arange(1, len(offs))
    first = np.concatenate([[0], ends[:-1]])
    space = kept == 0x20
    stays = np.ones(len(kept), bool)
    stays[1:] = ~(space[1:] & space[:-1])
    stays[ends - 1] = True  # the space after a row
    upto = np.concatenate([[0], np.cumsum(stays)])
    kept, starts, ends = kept[stays], upto[first], upto[ends]
    kept = np.insert(kept, starts, 0x20)  # and one before it
    starts, ends = starts + np.arange(len(starts)), ends + np.arange(1, len(ends) + 1)
    size = ends - starts
    left = np.repeat(ends, size) - np.arange(len(kept))
    code, out, total = np.zeros(len(kept), np.uint64), [], np.zeros(len(size), np.int64)
    padded = np.concatenate([kept, np.zeros(max(lengths), np.uint8)]).astype(np.uint64)
    for n in range(1, max(lengths) + 1):
        code = code | padded[n - 1 : n - 1 + len(kept)] << np.uint64(8 * (n - 1))
        if n in lengths:
            h = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            bucket[left < n] = buckets
            out.append(bucket)
            total += np.maximum(size - n + 1, 0)
    return starts, total, out


def machine(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, cost: float = COST, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine on some rows of ``x``; ``y`` is +1 or -1 for each of them, and both classes pay the same in all."""
    rng, n = np.random.RandomState(seed), len(y)
    rows = np.arange(n) if rows is None else rows
    square = np.einsum("ij,ij->i", x, x)[rows] + 1.0
    most = np.where(y > 0, cost * n / (2 * max(1, (y > 0).sum())), cost * n / (2 * max(1, (y < 0).sum())))
    alpha, w, b = np.zeros(n), np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(n).tolist():
            own = x[rows[i]]
            gradient = y[i] * (float(own @ w) + b) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w += np.float32(step) * own
                b += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


@dataclass
class Model:
    """Machines as columns of weights with a last row of zeros: of the families, and by family of its languages, two by two."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    top: np.ndarray | None = None
    top_bias: np.ndarray | None = None
    within: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def fit(x: np.ndarray, langs: list[str], family_of: dict[str, str] = FAMILY_OF, cost: float = COST, passes: int = PASSES) -> Model:
        """From shares of runs, a row a text. A bucket's shares are divided by the root of their mean, in place, so that rare ones count."""
        lang = np.array(langs, object)
        family = np.array([family_of.get(c, c) for c in langs], object)
        mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        scale = np.where(mean > 0, 1 / np.sqrt(np.maximum(mean, 1e-12)), 0.0).astype(np.float32)
        x *= scale
        out = Model(sorted(set(family)))

        def columns(fitted: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
            weights = np.zeros((x.shape[1] + 1, len(fitted)))
            for k, (w, _) in enumerate(fitted):
                weights[:-1, k] = w * scale
            return weights, np.array([b for _, b in fitted])

        against = out.families if len(out.families) > 1 else []
        out.top, out.top_bias = columns([machine(x, np.where(family == f, 1.0, -1.0), None, cost, passes) for f in against])
        for f in out.families:
            own = out.languages[f] = sorted(set(lang[family == f]))
            fitted = []
            for a, b in combinations(own, 2):
                at = np.flatnonzero((lang == a) | (lang == b))
                fitted.append(machine(x, np.where(lang[at] == a, 1.0, -1.0), at, cost, passes))
            out.within[f] = columns(fitted)
        return out

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of a chunk of lower-case text."""
        n = len(offs) - 1
        starts, total, found = runs(data, offs, len(self.top) - 1)

        def margins(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """Means of the weights over the runs of some rows, plus the bias."""
            size = np.diff(np.append(starts, len(found[0])))[rows]
            first = np.cumsum(size) - size
            at = slice(None) if len(rows) == n else np.repeat(starts[rows] - first, size) + np.arange(size.sum())
            out = np.zeros((len(rows), len(bias)))
            for bucket in found:
                out += np.add.reduceat(weights[bucket[at]], first, axis=0)
            return out / np.maximum(total[rows], 1)[:, None] + bias

        best, sure = np.zeros(n, np.int64), np.ones(n)
        if len(self.families) > 1:
            m = 2 * margins(self.top, self.top_bias, np.arange(n))
            best = m.argmax(1)
            sure = 1 / np.exp(m - m.max(1, keepdims=True)).sum(1)
        lang = np.empty(n, object)
        for k, f in enumerate(self.families):
            rows, own = np.flatnonzero(best == k), self.languages[f]
            if len(own) == 1:
                lang[rows] = own[0]
            elif len(rows):
                m = margins(*self.within[f], rows)
                votes, share = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
                for p, (a, b) in enumerate(combinations(range(len(own)), 2)):
                    yes = 1 / (1 + np.exp(-2 * m[:, p]))
                    votes[:, a] += m[:, p] >= 0
                    votes[:, b] += m[:, p] < 0
                    share[:, a] += yes
                    share[:, b] += 1 - yes
                won = (votes + share / (len(own) + 1)).argmax(1)  # shares decide where votes are even
                lang[rows] = np.array(own, object)[won]
                sure[rows] *= share[np.arange(len(rows)), won] / (len(own) - 1)
        return lang, np.clip(sure, 0.0, 1.0)


def fit(docs: DataFrame, learn: Column, rows: int = SAMPLE, buckets: int = BUCKETS, family_of: dict[str, str] = FAMILY_OF) -> Model:
    """The model of the labelled rows of ``docs`` (doc_id, text, lang) where ``learn`` holds.

    Of each language as many rows are taken, by a hash of their doc_id, and no more than ``rows`` in all; only they reach the driver.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", F.xxhash64("doc_id").alias("_h"), F.col("text").alias("_text"))
    counts = labelled.groupBy("lang").count().select(F.col("lang").alias("_of"), F.col("count").alias("_rows"))
    n = counts.count()
    if n > rows // 2:
        raise ValueError(f"{n} languages need a sample of {2 * n} rows or more")
    each = rows // max(1, n)
    few = labelled.join(small(counts), F.col("lang") == F.col("_of")).where((F.pmod("_h", F.lit(1 << 20)) / float(1 << 20)) * F.col("_rows") <= 2.0 * each)
    few = few.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_text"))).where(F.col("_k") <= each).select("lang", "_text")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(pc.utf8_lower(column(batch, "_text"))):
                starts, total, found = runs(data, offs, buckets)
                row = np.repeat(np.arange(b - a), np.diff(np.append(starts, len(found[0]))))
                key = np.concatenate([row[f < buckets] * buckets + f[f < buckets] for f in found])
                key, times = np.unique(key, return_counts=True)
                ends = np.searchsorted(key, np.arange(b - a + 1) * buckets)
                at, share = (key % buckets).astype("<i4"), (times / np.maximum(total, 1)[key // buckets]).astype("<f4")
                cut = lambda v: pa.array([v[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([column(batch, "lang").slice(a, b - a), cut(at), cut(share)], names=["lang", "at", "share"])

    taken = few.mapInArrow(shares, "lang string, at binary, share binary").orderBy("lang", "at", "share").toArrow()
    x = np.zeros((len(taken), buckets), np.float32)
    for i, (at, share) in enumerate(zip(taken["at"], taken["share"])):
        x[i, np.frombuffer(at.as_buffer(), "<i4")] = np.frombuffer(share.as_buffer(), "<f4")
    return Model.fit(x, taken["lang"].to_pylist(), family_of)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score (0 to 1) of every row of ``docs`` (text), by the text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the model has no language. Texts of
    any length are read whole; repeated rows are rows of their own; an empty table gives none.
    """
    lean_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            text = pc.utf8_lower(column(batch, "_text"))
            for a, b, data, offs in chunks(text):
                lang, score = model.predict(data, offs) if model.families else (np.full(b - a, UNKNOWN, object), np.zeros(b - a))
                letters = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
                for i in np.flatnonzero(np.diff(letters[offs]) == 0).tolist():
                    if not _LETTER.search(data[offs[i] : offs[i + 1]].tobytes().decode()):
                        lang[i], score[i] = UNKNOWN, 0.0
                own = [column(batch, c).slice(a, b - a) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score)], names=schema.names)
            trim()

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op12_language_id(spark, sf_dir):
    """Learns from the rows that aren't held out; a null doc_id isn't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
