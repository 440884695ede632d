"""Language-model scores and packing."""

import collections
import math
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from millrace.llm import lm_scoring, packing
from tests.conftest import SF

from .test_text_operators import WORD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_scores(rows, got, held_out):
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    count = collections.Counter(w for i, _ in rows if not held_out(i) for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for r in got:
        words = tokens[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.held_out) == (len(words), n, held_out(r.doc_id))
        assert r.n_known == sum(count[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)


@pytest.mark.parametrize("held", [1 << 18, 200])
def test_scores_of_the_documents(spark, held):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm_scoring.lm_scores(docs, held=held).collect()
    check_scores([(r.doc_id, r.text) for r in docs.collect()], got, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    held_out = [r for r in got if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b a"), (4, "a " * 3000), (5, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = lm_scoring.lm_scores(docs, held_out=F.col("doc_id") == 5).collect()
    check_scores(rows, got, lambda i: i == 5)
    assert all(r.score < 0 for r in got)
    assert lm_scoring.lm_scores(docs.limit(0)).count() == 0
    untrained = lm_scoring.lm_scores(docs.where("doc_id = 5"), held_out=F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in untrained] == [(0, 0, 0.0)]


def test_model_is_normalised_and_learns():
    rng = np.random.RandomState(0)
    n = 12
    model = lm_scoring.Model(n, np.full(n, 1 / n))
    one, two = rng.randint(0, n, 40_000), rng.randint(0, n, 40_000)
    target = (one + 1) % n
    model.train(one, two, target, np.full(n, 1 / n), rng)
    table = 10.0 ** model.table()
    assert np.allclose(table.sum(2), 1, atol=1e-4)
    assert np.mean([table[i, j, (i + 1) % n] for i in range(n) for j in range(n)]) > 0.5


def brute_pieces(rows, capacity):
    t = tokenizers.Tokenizer.from_file(packing.vocabulary())
    out = collections.Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            out[d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check_packing(rows, got, capacity):
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(rows, capacity)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.op6_packing(spark, SF).collect()
    used = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, 4096)
    assert used <= 1.03 * sum(r.length for r in got) / 4096 + 1


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "It's <|endoftext|> \x01 x\x01 don't é é 12"), (3, "word " * 900), (3, "word " * 900), (4, "  b 　 ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(docs, packing.vocabulary(), capacity=64, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in got)
    check_packing(rows, got, 64)
    assert packing.pack(docs.limit(0), packing.vocabulary()).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.RandomState(3)
    for capacity in (64, 1024):
        counts = collections.Counter(np.minimum(rng.geometric(8 / capacity, 3000), capacity).tolist())
        plan = packing.Plan(dict(counts), capacity)
        used = collections.Counter()
        for lengths, count in plan.kinds:
            assert sum(lengths) <= capacity
            for n in lengths:
                used[n] += count
        assert used == counts
        assert sum(c for _, c in plan.kinds) <= 1.02 * sum(n * c for n, c in counts.items()) / capacity + 2


def test_best_pattern_is_the_knapsack_optimum():
    rng = np.random.RandomState(1)
    for _ in range(30):
        prices = np.append(0, rng.rand(12) * (rng.rand(12) > 0.4))
        best = np.zeros(13)
        for c in range(1, 13):
            best[c] = max([best[c - 1], *(best[c - k] + prices[k] for k in range(1, c + 1) if prices[k] > 0)])
        pattern = packing.best_pattern(prices)
        assert sum(pattern) <= 12 and math.isclose(sum(prices[k] for k in pattern), best[12])
