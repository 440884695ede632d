"""Mixing, exact deduplication and line deduplication: DataFrame functions only."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, line_dedup, mixing, registry
from tests.conftest import SF

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", ["op1_mixing", "op4_quality_rules", "op5_warc", "op7_line_dedup", "op8_exact_dedup", "op10_ngram_join"])
def test_query_matches_its_sql(name, spark, same):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


@pytest.mark.parametrize("name", ["op1_mixing", "op7_line_dedup", "op8_exact_dedup"])
def test_no_python_in_the_plan(name, spark):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def odd(spark):
    """Null ids and texts, empty texts, repeated rows, a long text, a clashing column name."""
    rows = [(1, "a b", "x"), (2, "ab", None), (2, "ab", None), (None, "a  b", "y"), (3, None, "x"), (4, "", "x"), (5, " \n", None), (6, "w " * 50_000, "y")]
    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("h", F.lit(1))


def test_exact_dedup_odd_rows(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd(spark)).collect()}
    assert got == {(1, 1, 4, False), (2, None, 4, False), (None, None, 4, True), (3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True), (6, 6, 1, True)} - {(1, 1, 4, False), (2, None, 4, False)} | {
        (1, None, 4, False), (2, None, 4, False),
    }
    assert exact_dedup.exact_dedup(odd(spark).limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    from millrace.llm.shared import Workspace

    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    buckets = exact_dedup.directory(keys, Workspace(spark, "t"), capacity=40).collect()
    assert sum(b.n_keys for b in buckets) == 1000 and max(b.n_keys for b in buckets) <= 40
    assert sum(2.0**-b.depth for b in buckets) <= 1
    small = exact_dedup.exact_dedup(spark.createDataFrame([(i, str(i % 300), "s") for i in range(900)], DOCS), capacity=8).collect()
    assert len(small) == 900 and all(r.group_size == 3 and r.keep_id == r.doc_id % 300 for r in small)


def test_mixing_targets(spark):
    rows = [(i, "w " * (10 + i % 7), f"s{i % 4}") for i in range(400)] + [(1000, "w " * 20, None), (1001, None, None), (None, "w w", "s0")]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in out)
    assert abs(sum(x[0].target for x in by.values()) - total) < 1e-3
    for source, x in by.items():
        size, taken, target = sum(r.size for r in x), sum(r.taken for r in x), x[0].target
        assert size == x[0].source_size and target <= 3 * size + 1e-6
        assert abs(taken - target) <= max(r.size for r in x), source
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    only_empty = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "a")], DOCS)).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0), (0.0, 0)]


def test_mixing_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(5)))
    assert a == b


def test_line_chunks_resist_shifts(spark):
    lines = [f"line {i * i % 97} of text" for i in range(60)]
    passage = "\n".join(lines)
    rows = [(1, passage, "a"), (2, "head\n" + passage + "\ntail", "a"), (3, None, "a"), (4, "", "a"), (None, passage, "a"), (5, "\n\n\n", "a")]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[1].kept_text == passage and out[1].n_removed_lines == 0
    assert out[2].n_removed_lines >= 40 and out[2].kept_text.startswith("head\n") and out[2].kept_text.endswith("tail")
    assert out[None].n_removed_lines >= 40
    assert (out[3].n_lines, out[4].n_lines, out[3].kept_text, out[5].kept_text) == (0, 0, "", "\n\n\n")
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_line_chunks_join_to_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    joined = docs.select("text", F.array_join(line_dedup.line_chunks(F.col("text")), "\n").alias("j"))
    assert joined.where("text <> j").count() == 0
    digest = {r.doc_id: r.kept_sha256 for r in line_dedup.op7_line_dedup(spark, SF).where("n_removed_chunks = 0").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(hashlib.sha256(text[d].encode()).hexdigest() == h for d, h in digest.items())
