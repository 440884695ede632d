"""Tables of large rows have small row groups, so that a task never holds all of its rows."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace.llm import alignment, shared


def groups(made):
    return [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]


def test_rows_bound_a_row_group(spark):
    made = shared.Workspace(spark, "large").write(spark.range(0, 5, 1, 1), "t", rows=2)
    assert [(m.num_rows, m.num_row_groups) for m in groups(made)] == [(5, 3)]
    assert sorted(r.id for r in made.collect()) == list(range(5))


def test_blocks_are_row_groups(spark, monkeypatch):
    kept = {}
    write = shared.Workspace.write
    monkeypatch.setattr(shared.Workspace, "write", lambda self, df, name, rows=None: kept.setdefault(name, write(self, df, name, rows)))
    docs = spark.range(0, 6, 1, 3).select(F.col("id").alias("doc_id"), F.lit("a plain text").alias("text")).coalesce(1)
    monkeypatch.setattr(alignment, "blocks", lambda *a, f=alignment.blocks: f(*a).union(f(*a)).coalesce(1))  # two blocks in one task
    assert alignment.align(docs, *alignment.vocabularies()).count() == 12
    assert [(m.num_rows, m.num_row_groups) for m in groups(kept["blocks"])] == [(2, 2)]
