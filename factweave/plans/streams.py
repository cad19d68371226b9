"""Streaming forms run over the driver's events until they are used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import coverage as cov
from factweave.plans.coverage import _FOLD
from factweave.plans.ledger import ID, IDS
from factweave.plans.registry import query
from factweave.sources import bindings as b
from factweave.sources import tables
from factweave.sources.rounds import shared_dir
from factweave.streaming import ingest, probes


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(tables.table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")  # a pattern may be one file or a folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


@query("s01_stream_ingest", b.with_views("obs") + f"SELECT {IDS}, min(seq) AS seq FROM obs GROUP BY {IDS}")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    folder, stream = _folder(spark), b.obs_of(_stream(spark, sf))
    ingest.continuous_ingest(stream, ID, "seq", f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return ingest.stored_statements(spark, f"{folder}/store", stream.schema).select(*ID, "seq")


@query("s01_stream_watermark", b.with_views("obs") + f"SELECT DISTINCT {IDS} FROM obs")
def s01_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """The bounded form, with a delay that is longer than the events reach."""
    folder = _folder(spark)
    stream = b.obs_of(_stream(spark, sf)).withColumn("at", F.to_timestamp("revision"))
    once = ingest.within_watermark(stream, ID, "at", "3650 days").select(*ID)
    once.writeStream.format("parquet").option("path", f"{folder}/once").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/once")


@query("s02_stream_probes", b.with_views("probes") + _FOLD + " SELECT item_id, state, attempts FROM merged")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    folder, rows = _folder(spark), b.probes_of(_stream(spark, sf))
    kind = F.when(F.col("status") == "timeout", "timeout").otherwise(cov.probe_class(F.col("status"), F.col("before_hash"), F.col("after_hash")))
    tracked = probes.track(rows.withColumn("o", kind), "item_id", "session", "attempt", "o", 3)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={number}")

    tracked.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(tracked.schema.add("batch_id", "long")).parquet(f"{folder}/out").filter("NOT late")
    last = out.groupBy("item_id").agg(F.max_by(F.struct("state", "attempts"), "batch_id").alias("r"))
    return last.select("item_id", "r.state", "r.attempts")
