"""Tables between the rounds of an iterative operator, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid


def shared_path(spark, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder, in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_store(spark):
    """A function (df, name) that writes ``df`` below spark.checkpoint.dir and reads it again."""
    base = shared_path(spark, "rounds")

    def store(df, name):
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    return store
