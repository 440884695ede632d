"""Ranks counted over ranges, on keys that hold most of a table, against plain loops."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import curate, sampling
from millrace.plans import registry, scenes
from millrace.plans.store import table_store

from .test_builders import sequential_locked, sequential_turns

BIG = "/root/testdata/sf0.01"


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_ranges(many_ranges):
    spark, rng = many_ranges, random.Random(1)
    rows = [(i, None if i % 7 == 0 else "a" if i % 3 else "b", rng.randrange(5)) for i in range(500)]
    df = sampling.binned(spark.createDataFrame(rows, "i int, k string, v int"), ["i"], table_store(spark))
    assert df.select("_bin").distinct().count() > 2
    used = spark.createDataFrame([("a", 100), (None, 7)], "k string, _used int")
    got = {r.i: r.s for r in sampling.running_sum(df, ["k"], ["i"], "s", F.col("v"), used).collect()}
    total, want = collections.Counter({"a": 100, None: 7}), {}
    for i, k, v in rows:
        total[k] += v
        want[i] = total[k]
    assert got == want
    assert sorted(r.i for r in sampling.first_rows(df.select("i"), [F.col("i").desc()], 123, table_store(spark)).collect()) == list(range(377, 500))


def test_caps_of_a_hot_key(many_ranges):
    spark, rng = many_ranges, random.Random(2)
    rows = [(i, rng.choice("aaaaaaaab"), rng.randrange(60)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, m int")
    got = {r.i for r in sampling.multi_cap(df, {"k": 90, "m": 2}, ["i"], table_store(spark)).collect()}
    used, want = collections.Counter(), set()
    for i, k, m in rows:
        if used[k] < 90 and used[m] < 2:
            used.update((k, m))
            want.add(i)
    assert got == want


def test_wrong_labels_of_a_large_pool(spark):
    rows = [(i, "p" if i else "q", f"l{i % 3000}") for i in range(4000)]
    got = curate.wrong_evidence(spark.createDataFrame(rows, "row int, pool string, label string"), "pool", "label", "row").collect()
    labels = sorted({r[2] for r in rows if r[1] == "p"}, key=lambda x: (hashlib.md5(f"wrong|p|{x}".encode()).hexdigest(), x))
    after = dict(zip(labels, labels[1:] + labels[:1]))
    assert len(got) == 3999 and all(r.wrong_label == after[r.label] for r in got)


def test_locked_rows_of_the_orders(spark):
    rows = [{**r.asDict(), "i": (r.k, r.id)} for r in scenes._mined(spark, BIG).collect()]
    rows.sort(key=lambda r: r["i"])
    got = {r.id for r in scenes.locked_rows(spark, BIG).collect()}
    assert got == {i[1] for i in sequential_locked(rows, 500, {"category": 80, "strategy": 120, "image_id": 3})}


def test_strategy_pairs_of_the_lines(spark):
    lines = spark.read.parquet(f"{BIG}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber").collect()
    key = lambda r: hashlib.md5(f"pair|{r.l_orderkey}|{r.l_linenumber}|{r.l_partkey}".encode()).hexdigest()
    rows = [(r.l_orderkey, r.l_partkey, r.l_suppkey, r.l_returnflag, key(r)) for r in lines]
    got = sorted((r.turn, r.strategy, r.image_id, r.positive, r.negative) for r in scenes.strategy_pairs(spark, BIG).collect())
    assert got == sequential_turns(rows, 600, 2)


def test_unique_pairs_of_the_lines(spark):
    order = ["l_orderkey", "l_linenumber", "a", "b", "l_quantity", "l_extendedprice"]
    rows = spark.read.parquet(f"{BIG}/lineitem.parquet").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").distinct().collect()
    used, want = set(), set()
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
        if r.a != r.b and not {r.a, r.b} & used:
            used |= {r.a, r.b}
            want.add((r.a, r.b))
    assert {(r.a, r.b) for r in scenes.unique_pairs(spark, BIG).collect()} == want


def test_caps_of_the_orders(spark):
    rows = registry.read(spark, BIG, "orders").select("o_custkey", "o_orderpriority", "o_orderkey").collect()
    used, want = collections.Counter(), set()
    for r in sorted(rows, key=lambda r: (hashlib.md5(f"caps|{r.o_orderkey}".encode()).hexdigest(), r.o_orderkey)):
        if used[r.o_custkey] < 3 and used[r.o_orderpriority] < 200:
            used.update((r.o_custkey, r.o_orderpriority))
            want.add(r.o_orderkey)
    assert {r.o_orderkey for r in registry.multi_cap(spark, BIG).collect()} == want
