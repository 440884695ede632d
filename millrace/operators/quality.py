"""Rule reports, train/eval leakage and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: dict[str, Column] | list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, null if none. Rules are conditions that mean failure; null is no failure."""
    pairs = rules.items() if isinstance(rules, dict) else rules
    return F.coalesce(*[F.when(cond, name) for name, cond in pairs], F.lit(None).cast("string"))


def all_reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_failed) over one pass; rules that no row breaks have 0."""
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n_failed")


def reason_counts(df: DataFrame, rules: dict[str, Column] | list[tuple[str, Column]]) -> DataFrame:
    return df.groupBy(F.coalesce(first_reason(rules), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def overlap(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides."""
    return train.select(key).distinct().join(held.select(key).distinct(), key, "left_semi")


def overlap_report(train: DataFrame, held: DataFrame, key: str, first: int = 20) -> DataFrame:
    """One row: n_train, n_held and n_overlap, distinct keys as text, and the ``first`` common ones in order."""
    some = lambda df: df.select(F.col(key).cast("string").alias("k")).where("k is not null")
    both = some(train).select("k", F.lit(1).alias("t"), F.lit(0).alias("h")).unionByName(some(held).select("k", F.lit(0).alias("t"), F.lit(1).alias("h")))
    keys = both.groupBy("k").agg(F.max("t").alias("t"), F.max("h").alias("h"))
    counts = keys.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n_train"), F.coalesce(F.sum("h"), F.lit(0)).alias("n_held"), F.count_if((F.col("t") == 1) & (F.col("h") == 1)).alias("n_overlap"))
    shown = keys.where("t = 1 and h = 1").orderBy("k").limit(first).agg(F.array_sort(F.collect_list("k")).alias("first"))
    return counts.crossJoin(shown)  # a row each


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def audit_rates(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, column, n, n_yes, n_no, n_blank, pass_rate) for every group and for all rows (by null)."""
    rows = df.select(by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([by], columns, "column", "mark")
    out = rows.groupingSets([[by, "column"], ["column"]], by, "column").agg(
        F.count("*").alias("n"), F.count_if(F.col("mark").isin("yes", "1")).alias("n_yes"), F.count_if(F.col("mark").isin("no", "0")).alias("n_no"),
        F.count_if(F.col("mark").isNull() | (F.col("mark") == "")).alias("n_blank"), F.grouping(by).alias("total"),
    )
    judged = F.col("n_yes") + F.col("n_no")
    return out.withColumn("pass_rate", F.when(judged == 0, 0.0).otherwise(F.col("n_yes").cast("double") / judged))


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)
