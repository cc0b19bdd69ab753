"""Tables in hash buckets, of which a change rewrites only those it touches.

A table's folder holds data/<version>/bucket=<k>, Parquet in order of the key, and manifest/v=<n>, a small Parquet
table that names for each bucket the version that holds it. A manifest is written after the data it names, as one
file that appears at once, so readers see a change as a whole or not at all. One writer at a time; a writer that
died leaves folders that no manifest names, which the next change removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: bucket -1 tells of the table: its buckets, and the batch that the manifest commits.
MANIFEST = "bucket int, version string, buckets int, batch long"


class Folder:
    """Names and removes what lies in a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._path = path, spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, inside: str) -> list[str]:
        at = self._path(f"{self.path}/{inside}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def holds(self, inside: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{inside}"))

    def remove(self, inside: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{inside}"), True)


class BucketedTable:
    """Rows of `schema` in `buckets` buckets by the hash of `key`. The manifest has a row for each bucket, so their number, not the data's size, bounds what the driver reads."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str | Y.StructType, buckets: int = 256):
        self.spark, self.path, self.key, self.folder = spark, path.rstrip("/"), key, Folder(spark, path.rstrip("/"))
        self.schema = Y.StructType.fromDDL(schema) if isinstance(schema, str) else Y.StructType([Y.StructField(f.name, f.dataType) for f in schema])
        self.buckets = self._manifest(self.version())["buckets"] if self.version() >= 0 else buckets

    def bucket(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*(key or [F.col(c) for c in self.key])), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The last manifest that is whole; -1 before the first."""
        numbers = sorted((int(n[2:]) for n in self.folder.names("manifest") if n.startswith("v=")), reverse=True)
        return next((n for n in numbers if self.folder.holds(f"manifest/v={n}/_SUCCESS")), -1)

    def _manifest(self, version: int) -> dict:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect() if version >= 0 else []
        about = next((r for r in rows if r["bucket"] < 0), None)
        return {"at": {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, "buckets": about and about["buckets"], "batch": about and about["batch"]}

    def last_batch(self) -> int | None:
        return self._manifest(self.version())["batch"]

    def files(self, buckets: list[int] | None = None, back: int = 0) -> list[str]:
        """The folders of some buckets, or of all; as they were `back` changes before, one at most."""
        at, wanted = self._manifest(self.version() - back)["at"], None if buckets is None else set(buckets)
        return [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(at.items()) if wanted is None or b in wanted]

    def read(self, buckets: list[int] | None = None, back: int = 0) -> DataFrame:
        """The rows of some buckets, or of all."""
        files = self.files(buckets, back)
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of keys(key...): a list of at most `buckets` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def of_values(self, values: list[str]) -> DataFrame:
        """The rows with one of a few values of the first key column, from their buckets' files alone; the filter reaches the scan."""
        found = self.spark.range(1).select(F.array_distinct(F.array(*[self.bucket(F.lit(v)) for v in values])).alias("b")).first()["b"] if values else []
        return self.read(found).filter(F.col(self.key[0]).isin(*values))

    def lookup(self, keys: DataFrame, back: int = 0) -> DataFrame:
        """The rows that have one of the keys, from their buckets alone."""
        return self.read(self.buckets_of(keys), back).join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def write(self, rows: DataFrame, batch: int | None = None) -> None:
        """Puts rows in place of all."""
        self._commit(self._put(rows), None, batch)

    def change(self, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> bool:
        """Merges delta(key..., ...) into the buckets that it touches: merge(stored, delta) gives their rows anew.

        With a batch number, a change that was committed before is left out, so that it can be run again.
        """
        last = self.last_batch()
        if batch is not None and last is not None and batch <= last:
            return False
        touched = self.buckets_of(delta)
        self._commit(self._put(merge(self.read(touched), delta)), touched, batch)
        return True

    def _put(self, rows: DataFrame) -> str:
        version = f"{self.version() + 1:08d}-{uuid.uuid4().hex}"
        placed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("bucket", self.bucket())
        placed.repartition("bucket").sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        return version

    def _commit(self, version: str, touched: list[int] | None, batch: int | None) -> None:
        last = self.version()
        known = self._manifest(last)
        at = {} if touched is None else {b: v for b, v in known["at"].items() if b not in set(touched)}
        at |= {int(n[7:]): version for n in self.folder.names(f"data/{version}") if n.startswith("bucket=")}
        about = (-1, None, self.buckets, known["batch"] if batch is None else batch)
        rows = [about, *((b, v, None, None) for b, v in sorted(at.items()))]
        self.folder.remove(f"manifest/v={last + 1}")  # what a writer left that died
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/v={last + 1}")
        self._forget(last, at)

    def _forget(self, last: int, at: dict[int, str]) -> None:
        """Removes what neither the newest manifest names nor the one before it, from which readers may still read."""
        named = set(at.values()) | set(self._manifest(last)["at"].values())
        for name in self.folder.names("data"):
            if name not in named:
                self.folder.remove(f"data/{name}")
        for name in self.folder.names("manifest"):
            if name.startswith("v=") and int(name[2:]) < last:
                self.folder.remove(f"manifest/{name}")
