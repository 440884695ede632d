"""Scoring of answers as they arrive. An extension: batch scoring gives the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import binary_metrics, count_columns, score_rows


def windowed_accuracy(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window start, n, n_correct) of a stream of (time, target, generation); rows later than ``late`` are let go."""
    scored = score_rows(stream.withWatermark(time, late))
    out = scored.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"))
    return out.select(F.col("w.start").alias("start"), "n", "n_correct")


def scored_stream(stream: DataFrame, key: str, time: str, folder: str, late: str = "36500 days") -> DataFrame:
    """Confusion metrics of a stream of (key, time, target, generation) up to now, as ``evaluate`` gives them for all rows at once.

    Times are later than the first moment of 1970, where watermarks begin. An answer that comes again, within ``late`` of the newest one, doesn't count twice: its key is kept as state until then.
    Each batch writes its counts under its number below ``folder``, so a batch that is run again replaces what it wrote;
    the state's checkpoint stands there too.
    """
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    counts = count_columns("target")

    def write(batch: DataFrame, number: int) -> None:
        batch.agg(*[v.alias(k) for k, v in counts.items()]).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    query = score_rows(once).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/counts").drop("batch")
    total = lambda k: (F.max(k) if k.startswith("max_") else F.coalesce(F.sum(k), F.lit(0))).cast(rows.schema[k].dataType).alias(k)
    return binary_metrics(rows.agg(*[total(k) for k in counts]))
