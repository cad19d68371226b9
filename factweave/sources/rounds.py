"""Cutting lineage between the rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of our own by application, where the session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset.

    Only a single process may go without the setting: it gets a temporary folder, which is kept here as
    the setting is fixed once a session runs. A cluster without it is an error, as no folder is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.applicationId not in _OWN:
            local = context.master.startswith("local[") or context.master == "local"
            if not local:
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="factweave-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
