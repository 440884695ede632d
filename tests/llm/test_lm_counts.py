"""The language model learns from every triple, and knows more words where there are more."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lm_scoring


def test_a_pass_has_every_triple_by_its_count():
    c = np.array([1, 1, 2, 7, 4000])
    at, weight = lm_scoring.spread(c)
    assert np.allclose(np.bincount(at, weight) * c.mean(), c) and weight.max() <= 4


def test_a_round_has_every_share_and_norms_are_the_tables(spark):
    n = 60
    code = (np.arange(n)[:, None] * (n + 1) + np.arange(n)) * n + (np.arange(n)[:, None] + 1) % n
    rows = [(int(x), 1 + int(x) % 5) for x in code.ravel()]
    model = lm_scoring.fit(spark.createDataFrame(rows, "code long, c long"), n, many=150)  # 24 shares, added in two steps
    assert np.allclose((10.0 ** model.table()).sum(2), 1, atol=1e-4)
    model = lm_scoring.fit(spark.createDataFrame(rows, "code long, c long"), n)
    table = model.table()
    assert np.mean([table[a, b, (a + 1) % n] for a in range(n) for b in range(n)]) > -np.log10(n)
    log_z, (r, c1, c2, q, b) = lm_scoring.norms(model, spark), model.p
    want = (r[3] @ c1 + r[9] @ c2) @ q.T + b - log_z[3, 9]
    assert log_z.shape == (n + 1, n + 1) and np.allclose(want / np.log(10), table[3, 9], atol=1e-3)


def test_symbols_grow_with_the_vocabulary(spark, monkeypatch):
    tops, real = [], lm_scoring.frequent
    monkeypatch.setattr(lm_scoring, "TOP", 150)
    monkeypatch.setattr(lm_scoring, "frequent", lambda words, limit: tops.append(limit) or real(words, limit))
    for words in (1000, 125_000):
        docs = spark.range(words).groupBy((F.col("id") % 50).alias("doc_id")).agg(F.array_join(F.collect_list(F.concat(F.lit("w"), "id")), " ").alias("text"))
        assert lm_scoring.lm_scores(docs, held_out=F.lit(False), held=1).count() == 50
    assert tops == [150, 200]
