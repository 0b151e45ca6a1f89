"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source of size s and share w of the target total T is repeated at mean rate w T / s. Each row draws a number in (0, 1)
from a hash of the row, its occurrence and the seed, and its count of copies inverts the Poisson distribution of that mean:
how many of the cumulative probabilities it exceeds. Rows are exploded by count and dealt to partitions, and ordered in them,
by a second hash: a shuffle of the whole. Results depend on rows, weights and seed, not on partitioning.

Rows are told apart by a digest of all columns, so a null or repeated key matters to no one. Rows that are equal in all of
them are counted, 1, 2, 3 and so on, by a partial aggregate; where there are none, nothing moves for it but digests.

A mean over ``split_mean`` is drawn as the sum of several Poisson numbers of equal, smaller means, which is the same
distribution: tables stay short and probabilities clear of underflow.

Defined results: a source not named has weight ``other``; a null source is a source, named by None. Weight 0 drops it. Every
row draws on its own, repeated rows and rows without an id too; ``copy`` counts the copies of one row. An empty table gives
an empty table. The copy number and order key take names that the table does not have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.session import saved
from gridloom.llm.common import free_name

#: Sources up to which the table of rates is broadcast (some kilobytes each).
BROADCAST_SOURCES = 2_000


#: Equal rows that a task counts out at once.
CHUNK = 1_000


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns of a row; a null differs from every text of common use."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1enull")) for c in df.columns)))


def uniform(key: Column, seed: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the key."""
    digest = F.md5(F.concat(key, F.lit(":"), seed))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def counted_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a digest and the number of the occurrence among equal rows."""
    keyed = docs.withColumn("__digest", row_digest(docs))
    repeated = saved(keyed.groupBy("__digest").agg(F.count(F.lit(1)).alias("__times")).where("__times > 1"), "mix-repeats")
    if repeated.isEmpty():
        return keyed.withColumn("__row", F.concat("__digest", F.lit(":1"))).drop("__digest")
    once = keyed.join(repeated, "__digest", "left_anti").withColumn("__nth", F.lit(1).cast("bigint"))
    more = keyed.join(repeated.select("__digest"), "__digest", "left_semi").groupBy("__digest").agg(F.any_value(F.struct(*(f"`{c}`" for c in docs.columns))).alias("__r"), F.count(F.lit(1)).alias("__times"))
    # counted out in chunks that are dealt anew, so that a crowd of equal rows is no task's alone
    chunks = more.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__times") - 1) / CHUNK)))).repartition("__digest", "__chunk")
    first = F.col("__chunk") * CHUNK + 1
    told = chunks.withColumn("__nth", F.explode(F.sequence(first, F.least(F.col("__times"), first + (CHUNK - 1))))).select("__digest", "__r.*", "__nth")
    both = once.unionByName(told)
    return both.withColumn("__row", F.concat("__digest", F.lit(":"), F.col("__nth").cast("string"))).drop("__digest", "__nth")


def poisson_table(mean: Column, split_mean: float) -> Column:
    """Cumulative probabilities of 0, 1, ... for means up to ``split_mean``, far into the tail."""
    last = int(split_mean + 12 * math.sqrt(split_mean) + 20)
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    added = F.aggregate(
        F.sequence(F.lit(1), F.lit(last)),
        start,
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * mean / k)).alias("sums"),
        ),
    )
    return added["sums"]


def repetition_rates(docs: DataFrame, source_col: str, weights: dict, other: float, total: float | None, split_mean: float) -> DataFrame:
    """(source, size, draws, sums): a row for each source, as many as the data has sources."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("size"))
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("weight").alias("w"), F.sum("size").alias("s")).first()
    target = float(sums["s"] or 0) if total is None else float(total)
    mean = F.col("weight") / float(sums["w"] or 1.0) * target / F.col("size")
    draws = F.greatest(F.lit(1), F.ceil(mean / split_mean)).cast("int")
    return sizes.select("source", "size", draws.alias("draws"), poisson_table(mean / draws, split_mean).alias("sums"))


def copies_of(key: Column, draws: Column, sums: Column, seed: str) -> Column:
    """The Poisson number of a key: for each draw, how many cumulative probabilities its uniform number reaches."""

    def drawn(k: Column) -> Column:
        u = uniform(key, F.concat(F.lit(seed + ":"), k.cast("string")))
        return F.size(F.filter(sums, lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda n, k: n + drawn(k))


def mix_sources(docs: DataFrame, source_col: str, weights: dict, other: float = 1.0, total: float | None = None, seed: str = "mix", split_mean: float = 16.0) -> tuple[DataFrame, str, str]:
    """The mixed table in shuffled order, and the names of its copy and order columns. ``total``: rows wanted, as many as
    there are by default."""
    spark = docs.sparkSession
    copy, order = free_name(docs, "copy"), free_name(docs, "shuffle_key")
    rates = saved(repetition_rates(docs, source_col, weights, other, total, split_mean).select(F.struct("source", "draws", "sums").alias("__rate")), "mix-rates")
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = counted_rows(docs)
    joined = rows.join(F.broadcast(rates) if small else rates, rows[source_col].eqNullSafe(F.col("__rate.source")))
    count = copies_of(F.col("__row"), F.col("__rate.draws"), F.col("__rate.sums"), seed)
    copies = joined.withColumn("__n", count).where("__n > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("__n"))))
    keyed = copies.withColumn(order, F.md5(F.concat_ws(":", "__row", F.col(copy).cast("string"), F.lit(seed + "-order"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return keyed.repartition(parts, F.col(order)).sortWithinPartitions(order).drop("__rate", "__n", "__row"), copy, order
