"""Spans of several words, relations within words, sheets."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import audits


@pytest.mark.parametrize("span, want", [
    ("traffic light is dark red", ("traffic light", "dark red")), ("red traffic light", ("red traffic", "light")), ("dog", ("dog", "")), ("", ("", "")), ("a is b is c", ("a", "b is c")),
])
def test_attribute_spans(spark, span, want):
    assert tuple(spark.range(1).select(audits.split_attribute(F.lit(span)).alias("s")).first().s) == want


@pytest.mark.parametrize("span, want", [
    ("traffic light left of wine glass", ("traffic light", "left of", "wine glass")), ("big dog right of cat", ("big dog", "right of", "cat")), ("dog above wine glass", ("dog", "above", "wine glass")),
    ("dog cat", ("dog cat", "", "")), ("", ("", "", "")), ("left of dog", ("", "left of", "dog")),
])
def test_relation_spans(spark, span, want):
    assert tuple(spark.range(1).select(audits.split_relation(F.lit(span)).alias("s")).first().s) == want


def test_mentions_and_relations(spark):
    rows = [("A wine-glass.", "wine glass", True), ("a wineglass", "wine glass", False), ("x", "", False), (None, "x", False), ("x", None, False)]
    df = spark.createDataFrame(rows, "t string, n string, w boolean")
    assert all(r.got == r.w for r in df.select("w", text.mentions(F.col("t"), F.col("n")).alias("got")).collect())
    rows = [("it leftover", "left_of", True), ("subject=a; relation=right_of", "Right", True), ("a above b", "above", True), ("a b", "", False), ("a b", None, False), (None, "left", False)]
    df = spark.createDataFrame(rows, "t string, n string, w boolean")
    assert all(r.got == r.w for r in df.select("w", audits.relation_in(F.col("t"), F.col("n")).alias("got")).collect())


def test_sheets_keep_marks_unless_overwritten(spark):
    sheet = spark.createDataFrame([(1, "no", ""), (2, " ", None), (3, "", "x")], "id int, a string, b string")
    marked = spark.createDataFrame([(1, "yes", "yes", ["r"]), (2, "yes", "no", [])], "id int, a string, b string, reasons array<string>")
    got = lambda **k: sorted((r.id, r.a, r.b, r.has_record) for r in audits.completed(sheet, marked, ["a", "b"], **k).collect())
    assert got() == [(1, "no", "yes", True), (2, "yes", "no", True), (3, "", "x", False)]
    assert got(overwrite=True) == [(1, "yes", "yes", True), (2, "yes", "no", True), (3, "", "x", False)]
