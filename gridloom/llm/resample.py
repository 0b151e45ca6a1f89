"""Importance resampling of documents towards a target distribution, by hashed n-grams.

A document's features are its runs of 1 to 3 consecutive words, repeats counted. Words are found by Arrow kernels over a
batch: ascii_lower, split_pattern_regex, list_flatten, dictionary_encode. A bigram is the pair of a dictionary index and
the next one, a trigram that of a bigram's number and the index after it; each distinct pair gets one CRC-32, carried on
from its first part's. Buckets are the CRC modulo ``buckets``. Two passes: the counts of all buckets in the documents and
in the target, as one array a task, then each document's weight, the sum of its features' gains (take, segment-reduce).

The draw is by Gumbel top-k: weight plus noise from a hash of the id. Ranks come from one range-partitioned sort: a row's
place in its partition and the counts of the partitions before.

Defined results: null texts have no words. Rows are drawn one by one, so repeated rows get equal scores and ranks next to
each other; null ids hash as the text ``null`` and come last among ties. An empty table gives an empty table; without a
target every gain follows from T = 0. Only id and text are read, so other columns cannot clash. A text is worked on whole:
a task needs some 40 bytes of memory for each of its longest text's.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.session import saved
from gridloom.llm.common import small_batches
from gridloom.llm.words import encoded

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, row of each feature, bucket of each feature)."""
    rows, ids, words = encoded(texts, BETWEEN)
    raw = words.cast(pa.binary()).to_pylist()
    crc = np.array([zlib.crc32(w) for w in raw], np.int64)
    spaced = [b" " + w for w in raw]
    found_rows, found = [rows], [crc[ids] % buckets] if len(ids) else [ids]
    number, crcs = ids, crc.tolist()
    for _ in range(2):
        # runs that go on by one word in the same row
        n = len(number) - 1
        if n < 1:
            break
        last = ids[len(ids) - n :]
        same = rows[:n] == rows[len(rows) - n :]
        pairs, number_of = np.unique(number[:n] * len(raw) + last, return_inverse=True)
        crcs = [zlib.crc32(spaced[b], crcs[a]) for a, b in zip((pairs // len(raw)).tolist(), (pairs % len(raw)).tolist())]
        found_rows.append(rows[:n][same])
        found.append((np.array(crcs, np.int64) % buckets)[number_of][same])
        number = number_of
    return np.bincount(rows, minlength=len(texts)), np.concatenate(found_rows), np.concatenate(found)


def bucket_counts(docs: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, ``buckets`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0), buckets)[2], minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares, floored."""
    counts = []
    for df, col in ((docs, text_col), (target, target_text_col)):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, col, buckets).collect():  # a row a bucket
            n[r["bucket"]] = r["n"]
        counts.append(n.tolist())
    s, t = counts
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def noise(id_col: Column, seed: str) -> Column:
    """A thousand times a Gumbel number from the id's hash, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("bigint")


def ranked(scored: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``scored`` with each row's place from 1 in the whole order, by a range-partitioned sort without a single task."""
    # the id's low 33 bits are the place in the partition; written once, so that places and counts are of one run
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    start = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part bigint, _before bigint")
    joined = placed.join(F.broadcast(start), part == F.col("_part"))
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return joined.withColumn(name, place).drop("_place", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: str = "42", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    shared = docs.sparkSession.sparkContext.broadcast(gains(docs, target, text_col, target_text_col, buckets))  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n_words, rows, found = features(batch.column(1), buckets)
            order = np.argsort(rows, kind="stable")
            n = np.bincount(rows, minlength=batch.num_rows)
            weight = np.zeros(batch.num_rows, np.int64)
            if len(rows):
                starts = np.cumsum(n) - n
                weight[n > 0] = np.add.reduceat(gain.take(found[order]), starts[n > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    weighed = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    # written, as a range-partitioned sort reads its input twice
    scored = saved(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fits", F.col("n_words") >= least_words), "scored")
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(scored, order, "rank")
    wanted = percent * (placed.where("fits").count()) // 100
    rank = F.when(F.col("fits") & (F.col("rank") <= wanted), F.col("rank"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
