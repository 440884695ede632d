"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that later steps read from the row.

    Projections that follow one another are merged, and then an expression is worked out wherever its column is named. An
    array of one row, exploded, stays between them.
    """
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, made.alias("_once")).select(*kept, *[F.col(f"_once.{k}").alias(k) for k in columns])


def compiled_once(df: DataFrame, **columns: Column) -> DataFrame:
    """As ``once``, the row made by a projection before it is exploded: that is compiled and shares what columns have in common."""
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, F.struct(*[v.alias(k) for k, v in columns.items()]).alias("_once"))
    return made.select(*kept, F.explode(F.array("_once")).alias("_once")).select(*kept, *[F.col(f"_once.{k}").alias(k) for k in columns])
