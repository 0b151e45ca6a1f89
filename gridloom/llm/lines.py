"""Line dedup over an index that can take documents in and give them up again.

A line's key is the line without blanks at its ends and with A-Z lower-cased, held as a 128-bit digest. Keys shorter than
``least_chars`` code points are not indexed, so their lines always stay. The index has three tables below its path, each
written in updates (a folder an insertion or deletion):

* ``refs``: (shard, key, doc, change), +1 where a document began to hold a key and -1 where it ceased to; the exact
  references.
* ``counts``: (shard, key, refs, first), of each key that an update touched how many documents hold it now, and the least.
* ``filters``: (shard, blob), a cuckoo filter of each shard with ``min(refs, 2)`` copies of every key's fingerprint.

The filter decides what has to be looked up exactly. An insertion looks up only keys of which the filter holds a copy: the
others are new. Cleaning looks up only references of whose key it holds two: one copy is proof that no second document has
the line. A filter never misses a copy, and its false positives end at the counts. Deleting takes copies out again, so
after ``delete`` the index answers as if the documents had never come. What doesn't fit a filter's buckets waits in its
stash, so no insertion fails; ``compact`` rewrites the tables as one update, with filters of the right size.

Filters meet their rows in a stream: both are dealt by shard and sorted with the filter first, so a task holds one filter.
Shards with over twice the mean of references are dealt to several tasks, each with a copy of the filter.

Defined results: a null text is one empty line. A line ends at ``\\n`` only. Rows with one id are one document, null ids too;
a null id comes after all others. Repeated lines of a document count once as a reference and all go or all stay. An id that
is inserted again adds the keys it didn't hold. Unknown ids to delete are ignored. An empty table gives an empty table.
Results are added in one struct column under a name that the table does not have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.session import scratch_path
from gridloom.llm.common import free_name, small_batches

#: References for which a shard is made; its filter has some 4 bytes for each.
SHARD_KEYS = 1 << 18
SLOTS = 4
MASK16 = np.uint64(0xFFFF)


class CuckooFilter:
    """A multiset of 64-bit hashes, kept as 16-bit fingerprints in one of two buckets of four slots each. Counts are never
    too low."""

    def __init__(self, table: np.ndarray, stash: np.ndarray):
        self.table, self.stash = table, stash

    @classmethod
    def sized(cls, entries: int, load: float = 0.8) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, entries) / (SLOTS * load)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, np.uint64))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        buckets = int.from_bytes(blob[:8], "little")
        end = 8 + buckets * SLOTS * 2
        return cls(np.frombuffer(blob[8:end], np.uint16).reshape(buckets, SLOTS).copy(), np.frombuffer(blob[end:], np.uint64).copy())

    def to_bytes(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.tobytes() + self.stash.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = np.maximum(hashes >> np.uint64(48), np.uint64(1))
        return marks, hashes & np.uint64(len(self.table) - 1)

    def _other(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (marks * np.uint64(0x5BD1E995) & np.uint64(len(self.table) - 1))

    def _codes(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One number for a fingerprint and its two buckets."""
        return np.minimum(at, self._other(marks, at)) << np.uint64(16) | marks

    def _fill(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; True where there was none."""
        order = np.argsort(at, kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order], "left")
        taken = self.table[at] != 0
        fits = rank < SLOTS - taken.sum(axis=1)
        slot = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.table[at[fits], slot] = marks[fits]
        return ~fits

    def _insert(self, marks: np.ndarray, at: np.ndarray, rounds: int = 200) -> None:
        left = self._fill(marks, at)
        marks, at = marks[left], self._other(marks[left], at[left])
        draw = np.random.default_rng(7)
        for _ in range(rounds):
            if not len(marks):
                return
            left = self._fill(marks, at)
            marks, at = marks[left], at[left]
            if not len(marks):
                return
            bucket, one = np.unique(at, return_index=True)  # one eviction a bucket and round
            slot = draw.integers(0, SLOTS, len(bucket))
            out = self.table[bucket, slot].astype(np.uint64)
            self.table[bucket, slot] = marks[one]
            marks, at = marks.copy(), at.copy()
            marks[one], at[one] = out, self._other(out, bucket)
        self.stash = np.sort(np.concatenate([self.stash, self._codes(marks, at)]))

    def add(self, hashes: np.ndarray) -> None:
        self._insert(*self._places(hashes))

    def copies(self, hashes: np.ndarray) -> np.ndarray:
        marks, at = self._places(hashes)
        other = self._other(marks, at)
        found = (self.table[at] == marks[:, None]).sum(axis=1) + np.where(other != at, (self.table[other] == marks[:, None]).sum(axis=1), 0)
        if len(self.stash):
            codes = self._codes(marks, at)
            found = found + np.searchsorted(self.stash, codes, "right") - np.searchsorted(self.stash, codes, "left")
        return found

    def remove(self, hashes: np.ndarray) -> None:
        """Takes out one copy for each hash; every one must have been added."""
        marks, at = self._places(hashes)
        codes, times = np.unique(self._codes(marks, at), return_counts=True)
        while len(codes):
            marks, at = codes & MASK16, codes >> np.uint64(16)
            gone = np.zeros(len(codes), bool)
            for bucket in (at, self._other(marks, at)):
                here = self.table[bucket] == marks[:, None]
                hit = here.any(axis=1) & ~gone
                self.table[bucket[hit], here[hit].argmax(axis=1)] = 0
                gone |= hit
            for code in codes[~gone]:
                k = int(np.searchsorted(self.stash, code))
                if k == len(self.stash) or self.stash[k] != code:
                    raise ValueError("removed a key that the filter does not hold")
                self.stash = np.delete(self.stash, k)
            times -= 1
            codes, times = codes[times > 0], times[times > 0]
        waiting, self.stash = self.stash, self.stash[:0]
        self._insert(waiting & MASK16, waiting >> np.uint64(16))


def line_keys(raw: bytes, least_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None if it is too short to count."""
    found: list[bytes | None] = []
    for line in raw.split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()  # bytes: A-Z only
        long_enough = len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars)
        found.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return found


def document_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(doc, key): each key of each row once."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [list({k for k in line_keys(t or b"", least_chars) if k}) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([k for some in keys for k in some], pa.binary())], ["doc", "key"])

    return small_batches(docs).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind.simpleString()}, key binary")


def _hashes(keys: pa.Array) -> np.ndarray:
    """The first half of each digest."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[::2]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, CuckooFilter | None, pa.RecordBatch]]:
    """Runs of rows of one shard with its filter, of a stream in which the filter comes first."""
    shard, own = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(np.diff(shards))[0] + 1), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if part.num_rows and shards[a] != shard:
                shard, own = int(shards[a]), None
            blobs = part.column("blob").drop_null()
            if len(blobs):
                own = CuckooFilter.from_bytes(blobs[0].as_py())
            part = part.filter(pc.is_null(part.column("blob")))
            if part.num_rows:
                yield shard, own, part


def _beside_filters(rows: DataFrame, filters: DataFrame | None, run: Callable, schema: str, *salt: str) -> DataFrame:
    """mapInArrow of ``run`` over rows dealt by shard and salts, each shard's filter before its rows."""
    both = rows.withColumn("blob", F.lit(None).cast("binary"))
    if filters is not None:
        both = both.unionByName(filters, allowMissingColumns=True)
    dealt = both.repartition("shard", *salt).sortWithinPartitions("shard", *salt, F.col("blob").isNull())
    return small_batches(dealt).mapInArrow(run, schema)


@dataclass(frozen=True)
class LineIndex:
    """A version of an index: its updates so far. ``insert`` and ``delete`` return the next version."""

    spark: SparkSession
    path: str
    shards: int
    least_chars: int = 10
    updates: tuple[int, ...] = ()

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """An index of ``docs``, with as many shards as its references ask for."""
        spark = docs.sparkSession
        path = path or scratch_path(spark, "line-index")
        document_keys(docs, id_col, text_col, least_chars).write.parquet(f"{path}/first-keys")
        keys = spark.read.parquet(f"{path}/first-keys")
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // shard_keys + 1)
        return cls(spark, path, shards, least_chars)._insert_keys(keys)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The newest version at a path."""
        rows = spark.read.parquet(f"{path}/versions").collect()  # a row an update
        newest = max(rows, key=lambda r: r["number"])
        return cls(spark, path, newest["shards"], newest["least_chars"], tuple(newest["updates"]))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._insert_keys(document_keys(docs, id_col, text_col, self.least_chars))

    def _insert_keys(self, keys: DataFrame) -> LineIndex:
        held = keys.groupBy("key", "doc").agg(F.lit(1).alias("change"))
        if self.updates:
            ids = keys.select(F.col("doc").alias("_id")).distinct()
            own = self.references().join(ids, F.col("doc").eqNullSafe(F.col("_id")), "left_semi").select(F.struct("key", "doc").alias("_own"))
            held = held.join(own, (F.col("key") == F.col("_own.key")) & F.col("doc").eqNullSafe(F.col("_own.doc")), "left_anti")
        number = self._write_refs(held.select(self._shard().alias("shard"), "key", "doc", "change"))
        added = self._table("refs", number).groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"))
        before, least = F.lit(0).cast("bigint"), F.col("least")
        if self.updates:
            kind = added.schema["least"].dataType.simpleString()
            fields = ["shard", "key", "n", "least"]

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for _, own, rows in _by_shard(batches):
                    seen = np.zeros(rows.num_rows, bool) if own is None else own.copies(_hashes(rows.column("key"))) > 0
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in fields), pa.array(seen)], [*fields, "seen"])

            added = _beside_filters(added, self.filters(), probe, f"shard int, key binary, n bigint, least {kind}, seen boolean")
            known = self.counts().select(F.col("key").alias("_key"), F.col("refs").alias("_refs"), F.col("first").alias("_first"))
            # keys that the filter has not seen get one that no row has, and not null, which would meet in one task
            wanted = F.when(F.col("seen"), F.col("key")).otherwise(F.concat("key", F.lit(b"0")))
            added = added.join(known, wanted == F.col("_key"), "left")
            before, least = F.coalesce("_refs", before), F.least("least", "_first")
        return self._commit(number, added.select("shard", "key", (before + F.col("n")).alias("refs"), least.alias("first"), before.alias("before")))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents whose ids are in ``ids``."""
        gone_ids = ids.select(F.col(id_col).alias("_id")).distinct()
        gone = self.references().join(gone_ids, F.col("doc").eqNullSafe(F.col("_id")), "left_semi")
        number = self._write_refs(gone.select("shard", "key", "doc", F.lit(-1).alias("change")))
        lost = self._table("refs", number).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        rest = self.references().join(lost, "key", "left_semi").join(gone_ids, F.col("doc").eqNullSafe(F.col("_id")), "left_anti")
        rest = rest.groupBy(F.col("key").alias("_key")).agg(F.min("doc").alias("least"))
        after = self.counts().join(lost, "key").join(rest, F.col("key") == F.col("_key"), "left")
        return self._commit(number, after.select("shard", "key", (F.col("refs") - F.col("n")).alias("refs"), F.col("least").alias("first"), F.col("refs").alias("before")))

    def compact(self) -> LineIndex:
        """The same index as one update, with shards and filters of the right size."""
        live = self.references().select("key", "doc")
        shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), live.count() // SHARD_KEYS + 1)
        return LineIndex(self.spark, self.path, shards, self.least_chars, ())._insert_keys(live)

    def _shard(self) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _table(self, name: str, *updates: int) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{name}/update={n}" for n in updates))

    def _newest(self, name: str, key: str) -> DataFrame:
        """Rows of a table that no later update replaced."""
        if len(self.updates) == 1:
            return self._table(name, *self.updates)
        df = self._table(name, *self.updates).withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), r"update=(\d+)", 1).cast("int"))
        fields = [c for c in df.columns if c not in (key, "_at")]
        return df.groupBy(key).agg(F.max_by(F.struct(*fields), "_at").alias("_row")).select(key, "_row.*")

    def references(self) -> DataFrame:
        """(shard, key, doc): which document holds which key."""
        log = self._table("refs", *self.updates)
        if len(self.updates) == 1:
            return log.select("shard", "key", "doc")
        return log.groupBy("shard", "key", "doc").agg(F.sum("change").alias("n")).where("n > 0").drop("n")

    def counts(self) -> DataFrame:
        """(key, shard, refs, first) of the keys that a document holds."""
        return self._newest("counts", "key").where("refs > 0").select("key", "shard", "refs", "first")

    def filters(self) -> DataFrame:
        """(shard, blob)."""
        return self._newest("filters", "shard").select("shard", "blob")

    def _write_refs(self, rows: DataFrame) -> int:
        last = [0]
        if self._exists("versions"):
            last = [r["number"] for r in self.spark.read.parquet(f"{self.path}/versions").select("number").collect()]
        number = max(last) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/refs/update={number}")
        return number

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _commit(self, number: int, counted: DataFrame) -> LineIndex:
        """Writes counts (with ``before``, the references so far) and the filters they change, then the version."""
        counted.write.mode("overwrite").parquet(f"{self.path}/counts/update={number}")
        copies = F.least("refs", F.lit(2)) - F.least("before", F.lit(2))
        changes = self._table("counts", number).select("shard", "key", copies.cast("int").alias("copies")).where("copies <> 0")

        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, parts in groupby(_by_shard(batches), key=lambda p: p[0]):
                found = [(own, _hashes(rows.column("key")), rows.column("copies").to_numpy()) for _, own, rows in parts]
                own, h, c = found[0][0], np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
                own = own or CuckooFilter.sized(int(c[c > 0].sum()))
                own.remove(np.repeat(h[c < 0], -c[c < 0]))
                own.add(np.repeat(h[c > 0], c[c > 0]))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([own.to_bytes()], pa.binary())], ["shard", "blob"])

        filters = _beside_filters(changes, self.filters() if self.updates else None, change, "shard int, blob binary")
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/update={number}")
        updates = (*self.updates, number)
        version = self.spark.createDataFrame([(number, self.shards, self.least_chars, list(updates))], "number int, shards int, least_chars int, updates array<int>")
        version.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/update={number}")
        return LineIndex(self.spark, self.path, self.shards, self.least_chars, updates)

    def dropped_keys(self) -> DataFrame:
        """(doc, key): the lines that a document loses, since another with a smaller id has them."""
        refs = self.references()
        sizes = refs.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        mean = (sizes.agg(F.sum("n")).first()[0] or 0) / self.shards
        salts = F.ceil(F.col("n") / (2 * mean + 1)).cast("int")
        # only shards over twice the mean, so fewer than half as many rows as there are shards
        hot = sizes.select(F.col("shard").alias("_shard"), salts.alias("salts")).where("salts > 1")
        refs = refs.join(F.broadcast(hot), F.col("shard") == F.col("_shard"), "left")
        refs = refs.select("shard", "key", "doc", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
        filters = self.filters().join(F.broadcast(hot), F.col("shard") == F.col("_shard"), "left")
        filters = filters.select("shard", "blob", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        kind = refs.schema["doc"].dataType.simpleString()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, own, rows in _by_shard(batches):
                held = rows.filter(pa.array(own.copies(_hashes(rows.column("key"))) > 1))
                yield pa.RecordBatch.from_arrays([held.column("doc"), held.column("key")], ["doc", "key"])

        likely = _beside_filters(refs, filters, probe, f"doc {kind}, key binary", "salt")
        shared = self.counts().where("refs > 1").select("key", "first")
        return likely.join(shared, "key").where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "key")

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
        """``docs`` (documents of the index) with a struct of text, n_lines and n_dropped, and that column's name."""
        name, drops = free_name(docs, "lines"), free_name(docs, "_drops")
        lists = self.dropped_keys().groupBy("doc").agg(F.collect_list("key").alias("keys")).select(F.struct("doc", "keys").alias(drops))
        joined = docs.join(lists, docs[id_col].eqNullSafe(F.col(f"{drops}.doc")), "left")
        least = self.least_chars

        def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
            kept, lines, dropped = [], [], []
            for raw, gone in zip(texts.cast(pa.binary()).to_pylist(), keys.to_pylist()):
                raw = raw or b""
                if not gone:
                    kept.append(raw)
                    lines.append(raw.count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone = set(gone)
                every = raw.split(b"\n")
                stay = [line for line, key in zip(every, line_keys(raw, least)) if key not in gone]
                kept.append(b"\n".join(stay))
                lines.append(len(every))
                dropped.append(len(every) - len(stay))
            return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

        cleaned = F.arrow_udf(run, "text string, n_lines bigint, n_dropped bigint")(F.col(text_col), F.col(f"{drops}.keys"))
        return small_batches(joined).withColumn(name, cleaned).drop(drops), name
