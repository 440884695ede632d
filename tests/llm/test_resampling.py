"""Importance resampling against plain counting."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import resampling
from tests.conftest import SF

WORD = re.compile(resampling.WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b"), (5, "x▁y z,q"), (7, "日本 語 　 と é à ñ x"), (8, "a" * 5000), (9, "a\n b\t c \r\n"), (11, "\x00\x01 a"),
    (None, "The Cat " * 20), (12, "the cat " * 2000), (12, "the cat " * 11), (12, "the cat " * 11), (13, "É ÀB ab"), (14, "..."),
]


def found(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return w, [zlib.crc32(x.encode()) % 10_000 for x in runs]


def brute(rows, target, longest=2):
    all_of = [(d, *found(t, longest)) for d, t in rows]
    s, t = collections.Counter(b for _, _, f in all_of for b in f), collections.Counter(b for x in target for b in found(x, longest)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (total_s + 10_000) / ((s[k] + 1) * (total_t + 10_000))))
    out = []
    for d, w, f in all_of:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    may = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    rank = {id(x): k + 1 for k, x in enumerate(may[: 25 * len(may) // 100])}
    return collections.Counter((*x[:4], rank.get(id(x))) for x in out)


def test_resampling_of_the_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = resampling.op13_target_resampling(spark, SF)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_of_odd_rows(spark, longest):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"rank": F.lit("clash"), "_text": F.lit(1), "buckets": F.lit(2)})
    target = spark.createDataFrame([("the cat",), (None,), ("",)], "text string")
    got = collections.Counter(tuple(r) for r in resampling.resample(docs, target, longest=longest).collect())
    assert got == brute(ODD, ["the cat", None, ""], longest)
    assert resampling.resample(docs.limit(0), target.limit(0)).count() == 0


def test_ranks_go_on_over_ranges(spark):
    from millrace.llm.shared import Workspace

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(8)
    got = resampling.ranked(rows, [F.col("k").desc(), F.col("id")], Workspace(spark, "ranks")).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
