"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to Python, so that long texts don't add up in a task.
BATCH_BYTES = "4m"


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by bytes; rows alone would let long texts fill a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def fold_of(id_col: Column, folds: int = 4) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` different rows, those with the least hashes, with their hash as ``__h``. Read in two passes, so that
    only hashes are ranked and broadcast. Equal rows share a hash: callers keep one of each by ``dropDuplicates(["__h"])``
    once a row is as small as it gets."""
    keyed = df.withColumn("__h", F.xxhash64(*df.columns))
    chosen = keyed.select("__h").distinct().orderBy(F.xxhash64("__h", F.lit(17)), "__h").limit(rows)
    return keyed.join(F.broadcast(chosen), "__h")
