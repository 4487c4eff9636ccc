"""Tables whose upserts rewrite only the buckets of the changed keys.

Rows lie in ``buckets`` folders by a hash of their key. An upsert reads the buckets its keys fall into, merges them with any
operator over (existing, changes) frames, writes these buckets anew beside the old ones, and publishes a version that names the
new folders for them and the old folders for all others. Readers see one version; a writer that dies changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firmlens.sinks import manifest

Merge = Callable[[DataFrame, DataFrame], DataFrame]
_BUCKET = "_bucket"


class BucketTable:
    """A versioned table of a folder; give it the same ``key`` and ``buckets`` at every use.

    ``buckets`` is best set so that a bucket fills one task (a gigabyte or so): an upsert costs at least its buckets.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int):
        self._spark, self._folder, self._schema, self._key, self._buckets = spark, folder.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.expr(f"cast(pmod(xxhash64(`{self._key}`), {self._buckets}) as int)")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*(f"{self._folder}/{name}" for name in folders))

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the newest version, or of the given one."""
        return self._rows(list(manifest.current(self._spark, self._folder, number).folders.values()))

    def folders(self, number: int | None = None) -> dict[int, str]:
        """Data folder of every bucket that has rows."""
        return {int(name): data for name, data in manifest.current(self._spark, self._folder, number).folders.items()}

    def upsert(self, changes: DataFrame, merge: Merge) -> manifest.Version:
        """Publish ``merge(existing, changes)``; ``merge`` must change rows of the keys of ``changes`` only.

        ``changes`` is read twice: for its buckets, of which the driver gets one number each, and for the merge. No
        changes publish nothing.
        """
        base = manifest.current(self._spark, self._folder)
        touched = {row[0] for row in changes.select(self._bucket().alias(_BUCKET)).distinct().collect()}
        if not touched:
            return base
        old = [base.folders[str(bucket)] for bucket in sorted(touched) if str(bucket) in base.folders]
        merged = merge(self._rows(old), changes).select(*self._schema.fieldNames())
        data = manifest.new_folder()
        placed = merged.withColumn(_BUCKET, self._bucket())
        placed.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self._folder}/{data}")
        written = self._spark.read.parquet(f"{self._folder}/{data}").select(_BUCKET).distinct() if self._any(data) else None
        filled = {row[0] for row in written.collect()} if written is not None else set()
        if not filled <= touched:
            raise ValueError("the merge returned rows of keys that were not changed")
        folders = {name: path for name, path in base.folders.items() if int(name) not in touched}
        folders |= {str(bucket): f"{data}/{_BUCKET}={bucket}" for bucket in filled}
        return manifest.switch(self._spark, self._folder, base, folders)

    def _any(self, data: str) -> bool:
        system = manifest.file_system(self._spark, self._folder)
        statuses = system.listStatus(self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{data}"))
        return any(status.isDirectory() for status in statuses)
