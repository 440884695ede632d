"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a weight and a token budget. Budgets share the whole corpus size by weight; none exceeds
``max_epochs`` times its source, and what is cut off goes to the other sources by weight. A source is taken in complete
epochs first. The rest of its budget is a weighted sample without replacement: each document gets an exponential key
``-ln(u) / quality`` with u from a hash of its id, documents are sorted by key within the source, and a prefix of the
running token sum fills the budget.

The sort is spread out: keys fall into bins of about ``BIN_ROWS`` documents, bins into coarse bins. Running sums are
taken over coarse bins, over the bins of one coarse bin and over the documents of one bin, so a source that holds a
third of all rows is never in one task. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, small, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BIN_ROWS = 64


def _ranked(sources: DataFrame, ws: Workspace) -> DataFrame:
    """Add ``rank`` (from 0): the place of each source by code point, null last, numbered over range partitions."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    parts = ws.write(parts.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    counts = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return parts.join(F.broadcast(counts), part == F.col("part")).withColumn("rank", place + F.col("before")).drop("at", "part", "before")


def source_targets(sources: DataFrame, ws: Workspace, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Add ``target`` to rows (source, source_size). Targets are rounded to six decimals."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    left = ws.write(_ranked(sources, ws).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "weighted")
    total = (left.agg(F.sum("source_size")).first()[0] or 0) * share
    # Raise the level (tokens per unit of weight) until no source newly exceeds its cap; each round is one aggregation.
    level = 0.0
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        row = left.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if not row.open:
            break
        new = (total - row.capped) / row.open
        if new <= level:
            break
        level = new
    return left.withColumn("target", F.round(F.least("cap", F.col("weight") * F.lit(level)), 6)).drop("rank", "weight", "cap")


def quality(text) -> F.Column:
    """Quality weight of a document: 1, less five times the share of symbols in its text, 0.1 at least."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>{}\\]", ""))
    return F.when(text == "", 0.1).otherwise(F.greatest(F.lit(0.1), 1.0 - 5.0 * symbols / F.length(text)))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = "mix", keep=()) -> DataFrame:
    """Take documents so that each source comes near its target.

    Size is the number of words of a text (null: 0). Sources are taken by code point, null last, and weigh
    ``weights`` in turn. A document is part of the fractional epoch if the middle of its span in the running sum is
    within the rest of the budget, so a source is off by half of one document at most. Ties in the key go by doc_id;
    rows that repeat a doc_id each stand for themselves. Sources whose texts are all empty get a target of 0. An empty table
    gives no rows, a very long text counts whole; columns that aren't read may have any name, those in ``keep`` none of
    the result's.

    Returns doc_id, source, size, source_size, target, copies, taken and the columns named in ``keep``, for every row.
    """
    ws = Workspace(docs.sparkSession, "mix")
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality(F.col("text")).alias("quality"), *keep)
    rows = ws.write(rows.withColumn("key", -F.ln(u) / F.col("quality")), "sizes")

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("quality").alias("mean"))
    targets = ws.write(source_targets(ws.write(sources, "sources"), ws, weights, max_epochs, share), "targets")
    epochs = F.when(F.col("source_size") == 0, 0).when(F.col("target") >= F.col("source_size") * max_epochs, max_epochs)
    epochs = epochs.otherwise(F.floor(F.col("target") / F.col("source_size")))
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # 1 - exp(-key * mean quality) grows with the key and is spread nearly evenly over (0, 1).
    bins = F.ceil(F.col("n") / BIN_ROWS)
    coarse = F.ceil(F.sqrt(bins))
    keyed = rows.withColumnRenamed("source", "doc_source").join(small(targets), F.col("doc_source").eqNullSafe(F.col("source")))
    place = 1 - F.exp(-F.col("key") * F.col("mean"))
    keyed = keyed.withColumn("bin", F.least(F.floor(place * bins), bins - 1)).withColumn("coarse", F.floor(F.col("bin") / coarse)).drop("doc_source")

    fine = keyed.groupBy("source", "coarse", "bin").agg(F.sum("size").alias("bin_size"))
    big = fine.groupBy("source", "coarse").agg(F.sum("bin_size").alias("coarse_size"))
    before = (Window.unboundedPreceding, -1)
    over_coarse = Window.partitionBy("source").orderBy("coarse").rowsBetween(*before)
    over_bins = Window.partitionBy("source", "coarse").orderBy("bin").rowsBetween(*before)
    over_rows = Window.partitionBy("source", "coarse", "bin").orderBy("key", "doc_id", "size").rowsBetween(*before)
    zero = F.lit(0).cast("long")
    big = big.select(F.col("source").alias("s1"), F.col("coarse").alias("c1"), F.coalesce(F.sum("coarse_size").over(over_coarse), zero).alias("coarse_before"))
    fine = fine.withColumn("bin_before", F.coalesce(F.sum("bin_size").over(over_bins), zero))
    fine = fine.join(small(ws.write(big, "coarse")), F.col("source").eqNullSafe(F.col("s1")) & (F.col("coarse") == F.col("c1")))
    fine = fine.select(F.col("source").alias("s2"), F.col("coarse").alias("c2"), F.col("bin").alias("b2"), (F.col("coarse_before") + F.col("bin_before")).alias("offset"))
    joined = keyed.join(
        small(ws.write(fine, "fine")), F.col("source").eqNullSafe(F.col("s2")) & (F.col("coarse") == F.col("c2")) & (F.col("bin") == F.col("b2"))
    )
    running = F.col("offset") + F.coalesce(F.sum("size").over(over_rows), zero)
    extra = (F.col("size") > 0) & (running + F.col("size") / 2 <= F.col("rest"))
    out = joined.withColumn("copies", F.col("epochs") + extra.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *keep)


def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
q AS (
  SELECT doc_id, source, size,
         CASE WHEN t = '' THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE
           - (5.0::DOUBLE * (length(t) - length(regexp_replace(t, '[#*$%&|<>{}\\]', '', 'g'))))::DOUBLE / length(t)::DOUBLE) END AS quality,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM d),
k AS (SELECT *, -ln(u) / quality AS key FROM q),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM k GROUP BY source),
w AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank % 3 + 1)::INT] AS weight FROM s),
lv AS (
  SELECT 0.0::DOUBLE AS level, 0 AS i
  UNION ALL
  SELECT ((SELECT sum(source_size) FROM w)
           - (SELECT coalesce(sum(cap), 0) FROM w WHERE cap < weight * lv.level))
         / (SELECT sum(weight) FROM w WHERE NOT cap < weight * lv.level), i + 1
  FROM lv WHERE i < 40 AND EXISTS (SELECT 1 FROM w WHERE NOT cap < weight * lv.level)),
t AS (
  SELECT source, source_size, round(least(cap, weight * (SELECT max(level) FROM lv)), 6) AS target FROM w),
e AS (
  SELECT k.doc_id, k.size, k.key, t.*,
         CASE WHEN source_size = 0 THEN 0 WHEN target >= 3 * source_size THEN 3 ELSE floor(target / source_size) END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running
  FROM e)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN size > 0 AND running + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
