"""Deterministic sampling that doesn't depend on partitioning.

Random order is replaced by the order of ``md5(seed|id)``: the same sample on any cluster, and the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(seed: str, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[i.cast("string") for i in ids]))


def stable_unit(seed: str, *ids: Column) -> Column:
    """A number in (0, 1) from the first eight hex digits of the stable key."""
    return (F.conv(F.substring(stable_key(seed, *ids), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: exact for "keep the first seen"."""
    return capped_per_key(df, keys, 1, order)


def capped_per_key(df: DataFrame, keys: list[str], cap: int, order: list[Column]) -> DataFrame:
    """At most ``cap`` rows of each key, by ``order``. One cap is a window; the group limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def shared_cap(first: DataFrame, second: DataFrame, keys: list[str], cap: int, order: list[Column]) -> DataFrame:
    """A cap for each key over two passes: the second pass gets what the first has left."""
    taken = capped_per_key(first, keys, cap, order)
    used = taken.groupBy(*keys).agg(F.count("*").alias("_used"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rest = second.withColumn("_rank", rank).join(used, keys, "left").where(F.col("_rank") <= cap - F.coalesce("_used", F.lit(0)))
    return taken.withColumn("pass", F.lit(1)).unionByName(rest.drop("_rank", "_used").withColumn("pass", F.lit(2)))


def round_robin(df: DataFrame, bucket: str, n: int, order: list[Column]) -> DataFrame:
    """``n`` rows taken in turn from the buckets, in the order of the bucket names."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)).cast("long")
    return df.withColumn("turn", rank).where(F.col("turn") <= n).orderBy("turn", bucket).limit(n)


def _ranked(df: DataFrame, ids: Column, seed: str) -> DataFrame:
    """Add ``_place`` (from 1): the place in stable order over all rows, from counts by key prefix."""
    keyed = df.withColumn("_key", stable_key(seed, ids)).withColumn("_bin", F.substring("_key", 1, 3))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # 4096 bins at most
    bins = keyed.groupBy("_bin").agg(F.count("*").alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_key", ids)) + F.col("_before")
    return keyed.join(F.broadcast(bins), "_bin").withColumn("_place", rank).drop("_key", "_bin", "_before")


def ratio_split(df: DataFrame, ids: Column, ratio: float, seed: str) -> DataFrame:
    """Mark exactly round-half-even(n * ratio) rows, in stable order, as ``picked``."""
    n = round(df.count() * ratio)
    return _ranked(df, ids, seed).withColumn("picked", F.col("_place") <= n).drop("_place")


def sample_exactly(df: DataFrame, ids: Column, n: int, seed: str, label: str = "sample", allow_short: bool = False) -> DataFrame:
    """Mark ``n`` rows in stable order as ``picked``; fewer rows than that are an error unless ``allow_short``."""
    if n < 0:
        raise ValueError(f"{label}: the number of rows must not be negative")
    have = df.count()
    if have < n and not allow_short:
        raise ValueError(f"{label}: {n} rows are asked for and there are {have}")
    return _ranked(df, ids, seed).withColumn("picked", F.col("_place") <= n).drop("_place")


def sample_pairs(pairs: DataFrame, ids: Column, n_rows: int, seed: str, label: str = "pairs") -> DataFrame:
    """``n_rows`` / 2 pairs in stable order; an odd number, or fewer pairs, is an error."""
    if n_rows % 2:
        raise ValueError(f"{label}: the number of rows must be even")
    return sample_exactly(pairs, ids, n_rows // 2, seed, label).where("picked").drop("picked")


def weighted_pick(df: DataFrame, keys: list[str], weight: Column, ids: Column, n: int = 1, seed: str = "pick") -> DataFrame:
    """``n`` rows of each key without replacement, with chances by weight: the largest ln(u) / weight."""
    score = F.ln(stable_unit(seed, ids)) / F.greatest(weight.cast("double"), F.lit(1e-9))
    return capped_per_key(df.withColumn("_score", score), keys, n, [F.col("_score").desc(), ids]).drop("_score")


def binned(df: DataFrame, order: list, store, name: str = "binned") -> DataFrame:
    """``df``, written, with ``_bin``: the range in ``order`` that a row lies in.

    Ranks and sums within a key that has a great part of all rows are then counted range by range.
    """
    return store(df.repartitionByRange(*order).withColumn("_bin", F.spark_partition_id()), name)


def running_sum(rows: DataFrame, keys: list[str], order: list, name: str, value: Column | None = None, used: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` (1, so a rank) over a key's rows up to this one, in the ``order`` of ``binned`` rows.

    A window spans one range of a key; what the key has in the ranges before is a sum over one row for each range. ``used``
    (keys, _used), a row for each key, is where the sums of some keys begin. A null key is a key.
    """
    value = F.lit(1) if value is None else value
    own = F.sum(value).over(Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*keys, "_bin").agg(F.sum(value).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    theirs = [f"_key{i}" for i in range(len(keys))]
    sums = sums.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs)], F.col("_bin").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    if used is not None:
        used = used.select(*[F.col(k).alias(f"_u{t}") for k, t in zip(keys, theirs)], "_used")
        same = [F.col(t).eqNullSafe(F.col(f"_u{t}")) for t in theirs]
        sums = sums.join(used, same, "left").withColumn("_before", F.col("_before") + F.coalesce("_used", F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs)]
    out = rows.withColumn("_own", own).join(sums, [*same, F.col("_bin") == F.col("_of")])
    return out.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def first_rows(df: DataFrame, order: list, n: int, store, name: str = "first") -> DataFrame:
    """The first ``n`` rows in ``order``, however many: sorted ranges are counted, so no task holds all of them."""
    return running_sum(binned(df, order, store, name), [], order, "_rank").where(F.col("_rank") <= n).select(*df.columns)


def multi_cap(df: DataFrame, caps: dict[str, int], order: list[str], store, taken: DataFrame | None = None) -> DataFrame:
    """Greedy selection in ``order`` under a cap on every one of several keys, exactly as a sequential pass takes rows.

    Each round accepts the undecided rows that rank within what is left of all their caps among undecided rows, and drops
    those whose key is used up by earlier accepted rows. Ranks are counted over ranges of the order, so a key with a great
    part of all rows isn't sorted in one task. ``store(df, name)`` writes a table and reads it again; it cuts the lineage
    between rounds. Rows must be unique by ``order``. Rows ``taken`` before count towards the caps.
    """
    keys, columns = list(caps), [*caps, *[c for c in order if c not in caps]]
    order = ["_pass", *order]
    open_ = binned(df.select(*columns, F.lit(1).alias("_pass")), order, store, "open0")
    accepted, turn = None if taken is None else taken.select(*columns, F.lit(0).alias("_pass"), F.lit(-1).alias("_bin")), 0
    while not open_.isEmpty():
        ranked, fits = open_, F.lit(True)
        for k in keys:
            used = None if accepted is None else accepted.groupBy(k).agg(F.count("*").alias("_used"))
            ranked = running_sum(ranked, [k], order, f"_r_{k}", used=used)
            fits = fits & (F.col(f"_r_{k}") <= caps[k])
        ranked = store(ranked.withColumn("_fits", fits), f"ranked{turn}")
        new = ranked.where("_fits").select(*open_.columns)
        accepted = store(new if accepted is None else accepted.unionByName(new), f"accepted{turn}")
        rest = ranked.where("not _fits").select(*open_.columns)
        # A row goes when one of its keys has its cap full of earlier accepted rows; the last of them tells.
        for k in keys:
            full = accepted.groupBy(F.col(k).alias("_k")).agg(F.count("*").alias("_n"), F.max(F.struct(*order)).alias("_last")).where(F.col("_n") >= caps[k])
            rest = rest.join(full, F.col(k).eqNullSafe(F.col("_k")), "left").where(F.col("_last").isNull() | (F.struct(*order) < F.col("_last"))).select(*open_.columns)
        turn += 1
        open_ = store(rest, f"open{turn}")
    return (accepted if accepted is not None else open_).where("_pass = 1").select(*columns)


def with_ids(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Number rows ``prefix_000001`` on in the given order: sorted ranges are numbered from the counts of those before."""
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(starts), part == F.col("_p"))
    return rows.withColumn("id", F.format_string(f"{prefix}_%06d", F.col("_before") + at + 1)).drop("_at", "_p", "_before")


def unique_pairs(df: DataFrame, left: str, right: str, order: list[str], store) -> DataFrame:
    """Greedy pairs in ``order`` none of which shares an item (from ``left`` or ``right``) with an earlier kept one.

    Each round keeps the pairs that come first for both of their items and drops those that share an item with a kept
    pair: exactly the sequential result. ``store`` as for multi_cap; rows must be unique by ``order``. What comes first is
    found among one row an item, so pairs are shuffled only to drop those that go.
    """
    columns = df.columns
    whole = F.struct(*order, *[c for c in columns if c not in order])
    open_ = store(df.where(F.col(left) != F.col(right)), "pairs0")
    kept, turn = None, 0
    while not open_.isEmpty():
        first = open_.select(whole.alias("_row"), F.explode(F.array(left, right)).alias("_item")).groupBy("_item").agg(F.min("_row").alias("_row"))
        both = first.groupBy("_row").agg(F.count("*").alias("_n")).where("_n = 2")  # a pair's items differ
        new = store(both.select(*[F.col("_row")[c].alias(c) for c in columns]), f"pairs_kept{turn}")
        used = new.select(F.explode(F.array(left, right)).alias("_item")).distinct()
        rest = open_
        for side in (left, right):
            rest = rest.join(used, F.col(side) == F.col("_item"), "left_anti")
        kept = new if kept is None else kept.unionByName(new)
        turn += 1
        open_ = store(rest, f"pairs{turn}")
    return kept if kept is not None else open_


def split_targets(df: DataFrame, group: Column, targets: dict[str, int], order: list[Column], store, backfill: str | None = None) -> DataFrame:
    """``targets[g]`` rows of each group g by ``order``; what a group lacks is taken from the further rows of ``backfill``.

    The lack is a sum over one count for each group; ranks within a group are counted over ranges of the order.
    """
    rows = binned(df.withColumn("_group", group).where(F.col("_group").isin(list(targets))), order, store, "split")
    have = {r["_group"]: r["n"] for r in rows.groupBy("_group").agg(F.count("*").alias("n")).collect()}  # a row a target
    want = {g: min(n, have.get(g, 0)) for g, n in targets.items()}
    if backfill is not None:
        want[backfill] = min(have.get(backfill, 0), want[backfill] + sum(targets.values()) - sum(want.values()))
    limit = F.coalesce(*[F.when(F.col("_group") == g, n) for g, n in want.items()])
    return running_sum(rows, ["_group"], order, "_rank").where(F.col("_rank") <= limit).select(*df.columns)
