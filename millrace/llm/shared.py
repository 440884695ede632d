"""Tables in the cluster's shared folder, and joins with a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a small table is broadcast explicitly; beyond it the join is left to the optimizer.
BROADCAST = 32 << 20
#: Bytes of rows that a Python worker gets at once.
BATCH = 8 << 20
#: The white space that separates words, as a class for Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of our own, in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def lean_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, unless it has a bound of its own: texts can be very long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # the default
        spark.conf.set(name, f"{BATCH}b")


class Workspace:
    """A folder of one operator run, below the shared root. Tables written here cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        lean_batches(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows`` bounds the rows of a row group: readers and writers hold a group at once, so tables of large rows need it."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer if rows is None else writer.option("parquet.block.row.count.limit", rows)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``limit`` bytes, else as it is. ``df`` should be a written table."""
    fixed = 16 + 8 * len(df.columns)
    width = F.lit(fixed).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            return df
    some = df.limit(limit // fixed + 1).agg(F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if some["size"] <= limit else df


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
