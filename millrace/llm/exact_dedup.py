"""Exact deduplication over an extendible-hash index on shared files.

The index has a directory and buckets. A text's key is a 64-bit hash of its normalised form. The directory starts with one
slot and doubles (one more leading bit of the key) until no bucket holds more keys than its capacity; buckets that are not
overfull keep their smaller depth, so several directory slots point to one bucket. Equal keys can't be split.

Rows find their bucket in the directory, and owner tasks take ranges of buckets. A key that one row has is an entry without
its text. Of a key that several rows have, the owner gets the texts: it chains them, compares them byte by byte along the
chain and picks the row of each text that stays. The chained entries are written to the shared folder, and what becomes of
each row is read from there. Before texts are sent to owners, each task combines its own equal ones, so a text that a third
of all rows share costs a row a task at most.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, Workspace, small, table

#: Keys per bucket before it is split, and rows at most that equal texts are combined to on their way to the owner.
CAPACITY, COMBINED = 2048, 512


def directory(keys: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """Rows (depth, prefix, n_keys): the buckets of an extendible hash table over ``keys``, one row for each key ``h``.

    ``prefix`` is the bucket's leading ``depth`` bits as an unsigned number. Each round doubles the directory: it splits the
    overfull buckets by one more bit, for as long as there are any (63 bits at most, where two keys can be together).
    """
    capacity = max(capacity, 2)
    # Counts for some bits more than an even hash needs: those of all shallower buckets are sums of these.
    top = min(max((keys.count() // capacity).bit_length() + 3, 4), 63)
    address = lambda bits: F.shiftrightunsigned("h", 64 - bits)
    slots = ws.write(keys.groupBy(address(top).alias("slot")).agg(F.count("*").alias("n")), "slots")
    out, depth = None, 0
    while True:
        if depth > top:  # an uneven hash: count its full slots anew by more bits
            over = slots.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > capacity).select(F.col("slot").alias("over"))
            more = min(top + 8, 63)
            slots = keys.join(over, address(top) == F.col("over"), "left_semi").groupBy(address(more).alias("slot")).agg(F.count("*").alias("n"))
            slots, top = ws.write(slots, f"slots-{more}"), more
        prefix = F.shiftright("slot", top - depth)
        buckets = ws.write(slots.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n_keys")), f"depth-{depth}")
        over = buckets.where((F.col("n_keys") > capacity) & F.lit(depth < 63)).select(F.col("prefix").alias("over"))
        done = buckets.join(over, F.col("prefix") == F.col("over"), "left_anti").select(F.lit(depth).alias("depth"), "prefix", "n_keys")
        out = done if out is None else out.unionByName(done)
        if over.isEmpty():
            return ws.write(out, "directory")
        slots = slots.join(over, prefix == F.col("over"), "left_semi")
        depth += 1


def slots_of(buckets: DataFrame, bits: int) -> DataFrame:
    """(slot, depth, bucket) for every slot of a directory of so many bits; ``bucket`` is the first slot that points to it."""
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    every = F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {bits} - depth)") - 1))
    return buckets.select("depth", first.alias("bucket"), every.alias("slot"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Group equal texts; one row of each group stays.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a null text counts as
    empty, and all empty texts are one group. Of equal texts the row with the most code points in the original, then
    the smallest doc_id (nulls last) stays. Where rows repeat a doc_id within a group, each of these rows says the same.
    An empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names. A long text is
    shuffled only if its key occurs again.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.
    """
    ws = Workspace(docs.sparkSession, "exact_dedup")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("points"), F.regexp_replace(text, SPACE, "").alias("norm"))
    # The best row is the least of these.
    rank = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id").alias("rank")
    keyed = rows.select(F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"), rank, "norm")
    keys = ws.write(keyed.drop("norm"), "keys")
    counts = ws.write(keys.groupBy("h").agg(F.count("*").alias("n"), F.min("sha").alias("sha"), F.min("rank").alias("best")), "counts")
    buckets = directory(counts, ws, capacity)
    bits = buckets.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    slots = ws.write(slots_of(buckets, bits), "directory-slots")

    several = ws.write(counts.where("n > 1").select(F.col("h").alias("again")), "several")
    texts = keyed.join(small(several), F.col("h") == F.col("again"), "left_semi")
    texts = texts.groupBy("h", "sha", "norm", F.pmod(F.spark_partition_id(), F.lit(COMBINED)).alias("task")).agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    entries = texts.select("h", "sha", "norm", "best", "n").unionByName(counts.where("n = 1").select("h", "sha", F.lit(None).cast("string").alias("norm"), "best", "n"))
    slot = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    entries = ws.write(entries.join(small(slots), slot == F.col("slot")).drop("slot"), "entries")

    # Owner tasks have ranges of buckets; both windows and the aggregation work on what a task has.
    owned = entries.repartitionByRange("bucket", "h")
    owned = owned.withColumn("chain", F.dense_rank().over(Window.partitionBy("bucket", "h").orderBy("norm")))  # compares bytes
    index = owned.groupBy("bucket", "depth", "h", "chain").agg(F.min("sha").alias("sha"), F.min("best").alias("best"), F.sum("n").alias("group_size"), F.min("norm").alias("norm"))
    alike = F.count("*").over(Window.partitionBy("bucket", "h", "sha")) > 1  # different texts with one digest
    index = index.withColumn("alike", alike).withColumn("norm", F.when(F.col("alike"), F.col("norm")))
    index = ws.write(index.withColumn("keep_id", F.col("best.doc_id")).drop("best"), "index")
    ws.drop("entries", "slots", "counts")

    out = keys.join(index.where("not alike").select("h", "sha", "keep_id", "group_size"), ["h", "sha"])
    out = out.select(F.col("rank.doc_id").alias("doc_id"), "keep_id", "group_size", "sha")
    clash = index.where("alike").select("h", "sha", "norm", "keep_id", "group_size")
    if not clash.isEmpty():
        told = keyed.join(clash, ["h", "sha", "norm"])
        out = out.unionByName(told.select(F.col("rank.doc_id").alias("doc_id"), "keep_id", "group_size", "sha"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
"""
