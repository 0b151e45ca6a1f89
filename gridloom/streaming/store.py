"""A table that ``foreachBatch`` keeps current, in generations.

Rows lie in buckets by a hash of their key. A batch writes its rows of each bucket as one more generation of that bucket;
a bucket with ``most`` generations is merged into one, in which only the latest row of each id stays. A manifest says which
generations make up each bucket. It is written last, so readers see a batch wholly or not at all, and the one before stays,
so a replayed batch starts from where it started the first time and leaves the same. Generations that neither names are
removed. So a batch reads at most ``most`` files of each bucket it touches, however many batches came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Rows of the latest ``version`` of each ``id_col``, in buckets by ``bucket_by``."""

    def __init__(self, spark: SparkSession, path: str, bucket_by: str, id_col: str, version: str, buckets: int = 256, most: int = 8):
        self.spark, self.path, self.bucket_by, self.id_col, self.version, self.buckets, self.most = spark, path.rstrip("/"), bucket_by, id_col, version, buckets, most

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        found = (n for n in self._names("manifest") if n.isdigit())
        return sorted(int(n) for n in found if self._at(f"{self.path}/manifest/{n}/_SUCCESS")[1].exists(self._at(f"{self.path}/manifest/{n}/_SUCCESS")[0]))

    def manifest(self, before: int | None = None) -> dict[int, list[int]]:
        """bucket -> its generations, of the newest batch (earlier than ``before``). ``buckets`` times ``most`` numbers."""
        numbers = [n for n in self._numbers() if before is None or n < before]
        if not numbers:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/{numbers[-1]}").collect()
        return {r["bucket"]: list(r["generations"]) for r in rows}

    def files_of(self, manifest: dict[int, list[int]], wanted: list[int]) -> list[str]:
        return [f"{self.path}/rows/generation={g}/bucket={b}" for b in wanted for g in manifest.get(b, ())]

    def _latest(self, rows: DataFrame) -> DataFrame:
        fields = rows.columns
        return rows.groupBy(F.col(self.id_col).alias("_id")).agg(F.max_by(F.struct(*fields), F.struct(self.version, *(c for c in fields if c != self.version))).alias("_r")).select("_r.*")

    def read(self, wanted: list[int] | None = None, manifest: dict[int, list[int]] | None = None) -> DataFrame | None:
        """The current rows (of some buckets); None if there are none yet."""
        manifest = self.manifest() if manifest is None else manifest
        files = self.files_of(manifest, sorted(manifest) if wanted is None else wanted)
        return self._latest(self.spark.read.parquet(*files)) if files else None

    def add(self, batch: DataFrame, number: int) -> tuple[dict[int, list[int]], list[int]]:
        """Takes in a batch as generation ``number``. The new manifest, and the buckets that the batch touched."""
        before = self.manifest(number)
        folder = f"{self.path}/rows/generation={number}"
        fields = batch.columns
        own = batch.withColumn("bucket", self.bucket())
        self._latest(own).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        touched = [int(n.split("=")[1]) for n in self._names(f"rows/generation={number}") if n.startswith("bucket=")]
        full = [b for b in touched if len(before.get(b, ())) + 1 >= self.most]
        if full:
            files = self.files_of(before, full)
            old = self.spark.read.parquet(*files, *(f"{folder}/bucket={b}" for b in full)).select(*fields)
            merged = self._latest(old.withColumn("bucket", self.bucket())).repartition("bucket")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/generation={-number - 1}")
        after = before | {b: [*before.get(b, []), number] for b in touched} | {b: [-number - 1] for b in full}
        return after, touched

    def commit(self, manifest: dict[int, list[int]], number: int) -> None:
        """Makes a manifest the current one, and removes what it and the one before don't name."""
        rows = [(b, g) for b, g in sorted(manifest.items())]
        table = self.spark.createDataFrame(rows, "bucket int, generations array<int>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        numbers = self._numbers()
        for n in numbers[:-2]:
            at, fs = self._at(f"{self.path}/manifest/{n}")
            fs.delete(at, True)
        named = {(b, g) for m in (manifest, self.manifest(number)) for b, gs in m.items() for g in gs}
        for name in self._names("rows"):
            g = int(name.split("=")[1])
            inner = [n for n in self._names(f"rows/{name}") if n.startswith("bucket=")]
            gone = [n for n in inner if (int(n.split("=")[1]), g) not in named]
            for n in gone if len(gone) < len(inner) else [""]:
                at, fs = self._at(f"{self.path}/rows/{name}/{n}".rstrip("/"))
                fs.delete(at, True)
