"""Document scores of a log-bilinear language model trained by noise-contrastive estimation.

Words are 64-bit hashes. The most frequent words are symbols of their own, all others fall into classes by their ending;
the end of a text is a symbol too. The network predicts a symbol from the two before it: the context's feature vector is
a sum of linear maps of theirs, its score for a symbol a dot product and a bias. It is trained in numpy on counts of
symbol triples of the whole training corpus: each round passes over every distinct triple, weighted by its count. Tasks
run noise-contrastive estimation on their share of the triples, as many as the table needs and dealt anew each round, and
the parameters are averaged. A word within a class is predicted by its add-one relative frequency.

The number of word symbols grows with the cube root of the vocabulary, so the normalisers of all contexts, made once by
batched matrix products, cost work in proportion to it. Words beyond a bounded table of frequent ones get their counts
by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, table
from .textnp import BYTE, LOWER, U, chunks, column, mix, prefix, spans, words

#: The least number of words that are symbols, and the factor of the vocabulary's cube root; classes of other words,
#: features, and words whose counts every task holds.
TOP, GROWTH, CLASSES, WIDTH, HELD = 1000, 4, 48, 24, 1 << 18
#: Training: distinct triples a share has at least (if there are few shares) and at most about, rounds, sample and noise batch, step.
FEW, MANY, SHARES, ROUNDS, BATCH, NOISE, RATE = 50_000, 1_000_000, 8, 3, 1024, 128, 0.15
_GATHER = 6_000_000
_ENDING = (mix(np.arange(65536, dtype=U) * U(0x9E3779B97F4A7C15)) % U(CLASSES)).astype(np.int64)


def hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word classes, words of each row) of the chunks of a column, A-Z lower-cased."""
    for a, b, data, offs in chunks(texts):
        data = LOWER[data]
        starts, ends, count = words(data, offs)
        last = data[ends - 1].astype(np.int64)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        yield a, b, spans(prefix(BYTE[data]), starts, ends), _ENDING[before << 8 | last], count


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the sums of the first value and the other values of any one occurrence."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(values[0][order], at) if len(at) else values[0][:0]
    return keys[at], sums, *(v[order][at] for v in values[1:])


def count_words(docs: DataFrame) -> DataFrame:
    """(h, class, c) of every word of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts) -> Iterator[pa.RecordBatch]:
            h, c, k = _sum_by(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for i in range(0, len(h), 500_000):
                s = slice(i, i + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(k[s].astype(np.int32)), pa.array(c[s])], names=["h", "class", "c"])

        parts, held = [], 0
        for batch in batches:
            for _, _, h, k, _ in hashed(column(batch, "text")):
                h, c, k = _sum_by(h, np.ones(len(h), np.int64), k.astype(np.int16))
                parts.append((h, c, k))
                held += len(h)
                if held > _GATHER:
                    yield from packed(parts)
                    parts, held = [], 0
        if held:
            yield from packed(parts)

    found = docs.select("text").mapInArrow(run, "h long, class int, c long")
    return found.groupBy("h").agg(F.min("class").alias("class"), F.sum("c").alias("c"))


def frequent(vocabulary: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted), counts and classes of at most ``limit`` words, those of the highest counts (whole eighths of a log2)."""
    level = F.floor(8 * F.log2("c"))
    total, least = 0, None
    for r in sorted(vocabulary.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if total + r.n > limit:
            break
        total, least = total + r.n, r.k
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = vocabulary.where(level >= least).toArrow()
    h = got["h"].to_numpy().view(U)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy()[order], got["class"].to_numpy()[order].astype(np.int64)


class Symbols:
    """What a task needs to turn words into symbols."""

    def __init__(self, held: tuple[np.ndarray, np.ndarray, np.ndarray], top: int) -> None:
        self.h, self.c, classes = held
        best = np.lexsort((self.h, -self.c))[:top]
        self.end, self.n, self.start = top, top + 1 + CLASSES, top + 1 + CLASSES
        self.symbol = classes + top + 1
        self.symbol[best] = np.arange(len(best))
        self.best, self.best_class = best, classes[best]

    def of(self, h: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols and counts of words, and which words are held here."""
        if not len(self.h):
            return classes + self.end + 1, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        held = self.h[at] == h
        return np.where(held, self.symbol[at], classes + self.end + 1), np.where(held, self.c[at], 0), held

    def contexts(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Target, the two symbols before it (last first) and row, for each word and each end; rows have ``count`` words."""
        rows = np.repeat(np.arange(len(count)), count + 1)
        target = np.full(len(rows), self.end, np.int64)
        ends = np.cumsum(count + 1) - 1
        word = np.ones(len(rows), bool)
        word[ends] = False
        target[word] = symbols
        one, two = np.full(len(rows), self.start, np.int64), np.full(len(rows), self.start, np.int64)
        one[1:], two[2:] = target[:-1], target[:-2]
        first = ends - count
        one[first] = self.start
        two[first] = self.start
        two[np.minimum(first + 1, ends)[count > 0]] = self.start
        return target, one, two, rows


def count_triples(docs: DataFrame, shared, n: int) -> DataFrame:
    """(code, c): how often each symbol follows each two symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts) -> Iterator[pa.RecordBatch]:
            code, c = _sum_by(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for i in range(0, len(code), 500_000):
                part = slice(i, i + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(code[part]), pa.array(c[part])], names=["code", "c"])

        symbols, parts, held = shared.value, [], 0
        for batch in batches:
            for _, _, h, k, count in hashed(column(batch, "text")):
                target, one, two, _ = symbols.contexts(symbols.of(h, k)[0], count)
                parts.append(np.unique((one * (n + 1) + two) * n + target, return_counts=True))
                held += len(parts[-1][0])
                if held > _GATHER // 2:
                    yield from packed(parts)
                    parts, held = [], 0
        if held:
            yield from packed(parts)

    return docs.select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The sums of rows by their index, for indices below ``n``."""
    at, rows = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width)


class Model:
    """Parameters: context features, their maps by place, target features and biases."""

    def __init__(self, n: int, unigram: np.ndarray, width: int = WIDTH, seed: int = 7) -> None:
        rng = np.random.RandomState(seed)
        self.n = n
        self.p = [rng.normal(0, 0.1, (n + 1, width)), np.eye(width), 0.5 * np.eye(width), rng.normal(0, 0.1, (n, width)), np.log(unigram)]

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise_p: np.ndarray, rng, rate: float = RATE, weight: np.ndarray | None = None) -> None:
        """A pass of noise-contrastive estimation over (weighted) samples, with a step for each parameter that shrinks as it learns."""
        weight = np.ones(len(target)) if weight is None else weight
        r, c1, c2, q, b = self.p
        speed = [np.full_like(x, 1e-2) for x in self.p]
        log_noise = np.log(noise_p) + np.log(NOISE)
        for i in range(0, len(target), BATCH):
            x1, x2, w = one[i : i + BATCH], two[i : i + BATCH], target[i : i + BATCH]
            m = len(w)
            z = rng.choice(self.n, NOISE, p=noise_p)
            context = r[x1] @ c1 + r[x2] @ c2
            real = (context * q[w]).sum(1) + b[w] - log_noise[w]
            # Noise in single precision: most of the work is here.
            qz = q[z].astype(np.float32)
            fake = context.astype(np.float32) @ qz.T + (b[z] - log_noise[z]).astype(np.float32)
            u = weight[i : i + BATCH]
            g = u / (1 + np.exp(np.clip(real, -30, 30)))
            f = -u[:, None].astype(np.float32) / (1 + np.exp(-np.clip(fake, -30, 30)))
            back = (g[:, None] * q[w] + f @ qz) / m
            dq = _summed([(w, g[:, None] * context / m), (z, f.T @ context.astype(np.float32) / m)], self.n)
            db = np.bincount(w, g / m, self.n) + np.bincount(z, f.sum(0) / m, self.n)
            dr = _summed([(x1, back @ c1.T), (x2, back @ c2.T)], self.n + 1)
            for x, s, d in zip(self.p, speed, (dr, r[x1].T @ back, r[x2].T @ back, dq, db), strict=True):
                s += d * d
                x += rate * d / np.sqrt(s)

    def table(self) -> np.ndarray:
        """log10 probabilities [last symbol, symbol before, target] of all contexts; each context's sum to 1."""
        r, c1, c2, q, b = self.p
        first, second = r @ c1, r @ c2
        out = np.empty((self.n + 1, self.n + 1, self.n), np.float32)
        for i in range(self.n + 1):
            s = (first[i] + second) @ q.T + b
            s -= s.max(1, keepdims=True)
            out[i] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return out


def norms(model: Model, spark) -> np.ndarray:
    """Natural logarithm of each context's sum of exponentials, [last symbol, symbol before]."""
    r, c1, c2, q, b = (x.astype(np.float32) for x in model.p)
    shared = spark.sparkContext.broadcast((r @ c1, r @ c2, q, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, q, b = shared.value
        for batch in batches:
            out = []
            for i in column(batch, "id").to_pylist():
                parts = []
                for a in range(0, len(second), 256):
                    s = (first[i] + second[a : a + 256]) @ q.T + b
                    top = s.max(1)
                    parts.append(top + np.log(np.exp(s - top[:, None]).sum(1)))
                out.append(np.concatenate(parts).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(out, pa.binary())], names=["id", "z"])

    got = spark.range(0, model.n + 1, 1, min(model.n + 1, 64)).mapInArrow(run, "id long, z binary").collect()
    return np.stack([np.frombuffer(x.z, "<f4") for x in sorted(got, key=lambda x: x.id)])


def spread(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of a pass in which each triple has its count as weight, frequent ones in several equal parts."""
    mean = c.mean()
    parts = np.ceil(c / (4 * mean)).astype(np.int64)
    return np.repeat(np.arange(len(c)), parts), np.repeat(c / parts / mean, parts)


def _round(shared, n: int):
    """A share's part in a round: a pass over all its triples (a few, if there are few), its parameters times its weight."""

    def run(block: pa.Table) -> pa.Table:
        own, noise, turn = shared.value
        code, c = block["code"].to_numpy(), block["c"].to_numpy()
        by = np.argsort(code)
        code, c = code[by], c[by]
        rng = np.random.RandomState((int(code[0]) + 7919 * turn) % (1 << 31))
        at, weight = spread(c)
        model = Model.__new__(Model)
        model.n, model.p = own.n, [x.copy() for x in own.p]
        order = np.concatenate([rng.permutation(len(at)) for _ in range(min(max(3 * FEW // len(at), 1), 4))])
        drawn, weight = code[at[order]], weight[order]
        model.train(drawn // n // (n + 1), drawn // n % (n + 1), drawn % n, noise, rng, RATE / (1 + turn), weight)
        flat = np.concatenate([x.ravel() for x in model.p]) * c.sum()
        return pa.table({"share": block["share"][:1], "weight": [float(c.sum())], "p": pa.array([flat.tobytes()], pa.binary())})

    return run


def _added(block: pa.Table) -> pa.Table:
    """The sums of some shares; the order of addition is fixed."""
    block = block.sort_by("share")
    total = sum(np.frombuffer(p) for p in block["p"].to_pylist())
    return pa.table({"share": block["share"][:1], "weight": [float(sum(block["weight"].to_pylist()))], "p": pa.array([total.tobytes()], pa.binary())})


def fit(triples: DataFrame, n: int, rounds: int = ROUNDS, many: int = MANY) -> Model:
    """Train on counts of triples, all of them in each round."""
    spark = triples.sparkSession
    by_target = triples.groupBy((F.col("code") % n).alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect()  # a row for each symbol
    unigram = np.ones(n)
    for r in by_target:
        unigram[r.t] += r.c
    distinct = sum(r.k for r in by_target)
    shares = max(1, min(SHARES, distinct // FEW), -(-distinct // many))
    unigram /= unigram.sum()
    noise = unigram**0.75 / (unigram**0.75).sum()
    model, schema = Model(n, unigram), "share long, weight double, p binary"
    for turn in range(rounds):
        now = spark.sparkContext.broadcast((model, noise, turn))

        share = F.pmod(F.xxhash64("code", F.lit(turn)), F.lit(shares)).cast("long")
        got = triples.select("code", "c", share.alias("share")).groupBy("share").applyInArrow(_round(now, n), schema)
        got = got.groupBy((F.col("share") % (2 * SHARES)).alias("some")).applyInArrow(lambda key, block: _added(block), schema) if shares > 2 * SHARES else got
        got = sorted(got.collect(), key=lambda x: x.share)
        if not got:
            break
        mean = sum(np.frombuffer(g.p) for g in got) / sum(g.weight for g in got)
        at = 0
        for k, x in enumerate(model.p):
            model.p[k] = mean[at : at + x.size].reshape(x.shape)
            at += x.size
        now.unpersist()
    return model


def lm_scores(docs: DataFrame, held_out=None, top: int | None = None, held: int = HELD) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by the model and by add-one frequencies.

    ``held_out`` is a condition on doc_id; such rows aren't learned from. By default those whose crc32(doc_id as text) mod
    7 is 2; null ids are learned from. A null text is empty and has its end alone. An empty training set makes all words
    unknown. ``top`` words are symbols, by default as many as the vocabulary's size asks for. A very long text is worked on
    alone. Rows that repeat a doc_id are scored each for itself; a doc_id is a whole number or null; further columns go,
    whatever their names; an empty table gives no rows. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = docs.where("not held_out")
    vocabulary = ws.write(count_words(train), "vocabulary")
    ends = train.count()
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = total.n + ends, total.v + (ends > 0)

    top = max(TOP, round(GROWTH * total.v ** (1 / 3))) if top is None else top
    symbols = Symbols(frequent(vocabulary, max(held, top)), top)
    n = symbols.n
    shared = spark.sparkContext.broadcast(symbols)
    model = fit(ws.write(count_triples(train, shared, n), "triples"), n)
    # Add-one mass of each class: its words that aren't symbols, and one unknown word.
    per_class = np.ones(CLASSES)
    for r in vocabulary.groupBy("class").agg((F.sum("c") + F.count("*")).alias("m")).collect():
        per_class[r["class"]] += r.m
    np.subtract.at(per_class, symbols.best_class, symbols.c[symbols.best] + 1)
    known = spark.sparkContext.broadcast((model, norms(model, spark), np.log10(per_class)))
    base_below, end_count = float(np.log10(n_train + v_train + 1)), ends

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a document; kind 1: (rid, word, how often) of a word whose count isn't held."""
        symbols, (model, log_z, class_mass) = shared.value, known.value
        r_, c1, c2, q, bias = (x.astype(np.float32) for x in model.p)
        before, last, rid = r_ @ c2, r_ @ c1, TaskContext.get().partitionId() << 40
        names = ["kind", "rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "h"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            for a, b, h, k, count in hashed(column(batch, "text")):
                m = b - a
                symbol, c, here = symbols.of(h, k)
                target, one, two, rows = symbols.contexts(symbol, count)
                word_rows = np.repeat(np.arange(m), count)
                by_row = lambda v, r: np.bincount(r, v, m)
                log_c = np.log10(c + 1.0)
                in_class = symbol > symbols.end
                logs = np.einsum("ij,ij->i", last[one] + before[two], q[target]) + bias[target] - log_z[one, two]
                p = by_row(logs / np.log(10), rows)
                p += by_row(np.where(in_class, log_c - class_mass[np.maximum(symbol - symbols.end - 1, 0)], 0.0), word_rows)
                base = by_row(log_c, word_rows) + np.log10(end_count + 1.0) - (count + 1) * base_below
                n_known = by_row((c > 0).astype(float), word_rows).astype(np.int64) + (end_count > 0)
                rids = rid + np.arange(m)
                rid += m
                null = lambda t, size: pa.nulls(size, t)
                part = batch.slice(a, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), pa.array(rids), column(part, "doc_id"), column(part, "held_out"), pa.array(count.astype(np.int64) + 1), pa.array(n_known), pa.array(base), pa.array(p), null(pa.int64(), m)], names=names
                )
                rare_h, rare_row = h[~here], word_rows[~here]
                by = np.lexsort((rare_h, rare_row))
                rare_h, rare_row = rare_h[by], rare_row[by]
                first = np.flatnonzero(np.append(True, (rare_h[1:] != rare_h[:-1]) | (rare_row[1:] != rare_row[:-1]))) if len(by) else np.zeros(0, np.int64)
                times, r = np.diff(np.append(first, len(by))), len(first)
                cols = [pa.array(np.ones(r, np.int32)), pa.array(rids[rare_row[first]]), null(kinds[2], r), null(kinds[3], r), pa.array(times.astype(np.int64)), *(null(kinds[i], r) for i in (5, 6, 7)), pa.array(rare_h[first].view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = docs.mapInArrow(score, "kind int, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long")
    scored = ws.write(scored, "scored")
    rare = scored.where("kind = 1").select("rid", "h", F.col("n_tokens").alias("times")).join(vocabulary.select("h", "c"), "h")
    more = rare.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    out = scored.where("kind = 0").join(more, "rid", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def op3_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
