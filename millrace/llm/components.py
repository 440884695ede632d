"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots; a root is the smallest node of its component.

    Every round replaces each node's neighbours by the smallest of them, first among all neighbours, then among the
    smaller ones, and is written to the shared folder; rounds grow with the logarithm of the longest path. The least
    neighbours are one row a node: they are broadcast while they take few bytes, so a node with a great many links is
    only an aggregation, combined before its shuffle; beyond that its join can be split, as one side has one row of it.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    name = f"edges-{uuid.uuid4().hex[:8]}"
    edges, was, turn = ws.write(edges, f"{name}-0"), None, 0
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if mark == was or not mark.n:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        was = mark
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = small(ws.write(least, f"{name}-least-{turn}"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = ws.write(large, f"{name}-large-{turn}")
        least = ws.write(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w"), f"{name}-low-{turn}")
        near = large.join(small(least), F.col("hi") == F.col("w")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = near.unionByName(least.select(F.col("w").alias("hi"), F.col("m").alias("lo"))).distinct()
        turn += 1
        edges = ws.write(new, f"{name}-{turn}")
        ws.drop(f"{name}-{turn - 1}", *(f"{name}-{k}-{turn - 1}" for k in ("least", "large", "low")))
