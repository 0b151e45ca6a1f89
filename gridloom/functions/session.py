"""Where a job may put intermediate data.

Intermediate tables lie below ``spark.checkpoint.dir`` until ``discard`` removes them, or whoever owns that folder does.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one, if driver and executors are one
    process (local runs, tests); an error on a cluster, whose machines would not see it."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not wanted:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            wanted = "file://" + tempfile.mkdtemp(prefix="gridloom-checkpoint-")
        context.setCheckpointDir(wanted)
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    return saved_at(df, name)[0]


def dealt(df: DataFrame, *by) -> DataFrame:
    """Rows dealt by key to all cores, whatever their bytes: for work that costs time, not space. By a hash of the key: Spark
    drops a repartition by a key that rows are partitioned by already, however few partitions it has made of them."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(*by))


def spread(df: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """Rows partitioned by key, some ``most`` in each of as many partitions as that takes: joins by the key that follow keep
    them, so what a task sorts doesn't grow with the input. One more partition where the session's own number would be met, for
    adaptive execution may merge those by their bytes."""
    spark = df.sparkSession
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(4 * spark.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(wanted + (wanted == own), key)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of ``saved_at`` that no unfinished DataFrame reads."""
    if not path.startswith(checkpoint_root(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is no intermediate table")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
