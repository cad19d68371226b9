"""Continuous evidence ingest: the same statement arriving again adds nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factweave.operators.evidence import ingest


def within_watermark(stream: DataFrame, identity: list[str], event_time: str, delay: str) -> DataFrame:
    """Repeats within the watermark collapse; state for older statements is dropped, so this form is bounded but not exact."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(identity)


#: Parts of the store by hash of the identity; a micro-batch reads those that it has statements for.
BUCKETS = 256
#: Folders of one tier that are merged into one of the next.
MERGE = 8


class Store:
    """Statements in folders, and a manifest per micro-batch that names the folders that count.

    A manifest is written aside and renamed, so a batch is there as a whole or not at all. A batch starts
    from the last manifest before its own number, so a batch that is run again ignores what its first run left.
    New statements are a folder of tier 0; ``MERGE`` folders of a tier become one of the next. After n
    batches at most ``MERGE - 1`` folders of each of log(n) tiers count, and a statement has been rewritten once a tier.
    Folders that neither a batch nor the one before it names are removed, so a reader has one batch's time to end;
    a store has one writer.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path
        own = [f for f in schema if f.name not in ("batch_id", "bucket")]
        self.schema = T.StructType([*own, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())])
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def _manifest(self, number: int) -> list[tuple[int, str]]:
        stream = self._files.open(self._path(f"{self.path}/manifests/{number}"))
        try:
            return [tuple(x) for x in json.loads(bytes(stream.readAllBytes()).decode())]
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def folders(self, before: int | None = None) -> list[tuple[int, str]]:
        """Tier and name of the folders that count, after the last batch or after the last one ``before`` a number."""
        numbers = [n for n in self._numbers() if before is None or n < before]
        return self._manifest(numbers[-1]) if numbers else []

    def read(self, folders: list[tuple[int, str]]) -> DataFrame:
        paths = [f"{self.path}/data/{name}" for _, name in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path + "/data").parquet(*paths).select(*self.schema.names)

    def write(self, rows: DataFrame, tier: int) -> tuple[int, str]:
        name = f"folder={uuid.uuid4().hex}"
        rows.select(*self.schema.names).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        return tier, name

    def commit(self, number: int, folders: list[tuple[int, str]]) -> None:
        aside, final = (self._path(f"{self.path}/manifests/{n}") for n in (f"aside-{uuid.uuid4().hex}", number))
        out = self._files.create(aside)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        if self._files.exists(final):  # left by a run whose number was not noted as done
            self._files.delete(final, False)
        if not self._files.rename(aside, final):
            raise OSError(f"manifest {number} can't be put in place")

    def tidy(self, number: int) -> None:
        """Removes manifests before the last one before ``number``, and folders that none of the rest names."""
        numbers = self._numbers()
        kept = [n for n in numbers if n >= max((n for n in numbers if n < number), default=number)]
        named = {name for n in kept for _, name in self._manifest(n)}
        for folder, gone in (("manifests", {str(n) for n in numbers if n not in kept}), ("data", set(self._names("data")) - named)):
            for name in gone:
                self._files.delete(self._path(f"{self.path}/{folder}/{name}"), True)


def continuous_ingest(stream: DataFrame, identity: list[str], order: str, store: str, checkpoint: str) -> StreamingQuery:
    """Exact form: each micro-batch is anti-joined with its buckets of the ``Store`` and its new statements are added under the batch's number."""

    def add(batch: DataFrame, number: int) -> None:
        held = Store(batch.sparkSession, store, batch.schema)
        keyed = batch.withColumn("bucket", F.pmod(F.xxhash64(*identity), F.lit(BUCKETS)).cast("int")).persist()
        try:
            touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most BUCKETS
            folders = held.folders(before=number)
            stored = held.read(folders).filter(F.col("bucket").isin(touched))
            fresh = ingest(stored.select(*identity), keyed, identity, order).withColumn("batch_id", F.lit(number).cast("long"))
            if touched:
                folders = [*folders, held.write(fresh, 0)]
        finally:
            keyed.unpersist()
        tier = 0
        while len(full := [f for f in folders if f[0] == tier]) >= MERGE:
            folders = [f for f in folders if f[0] != tier] + [held.write(held.read(full), tier + 1)]
            tier += 1
        held.commit(number, folders)
        held.tidy(number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_statements(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The store's statements with ``batch_id`` and ``bucket``; none before the first batch."""
    held = Store(spark, store, schema)
    return held.read(held.folders())
