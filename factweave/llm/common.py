"""What the corpus operators share: table access, durable cuts of lineage and bounded Arrow loops."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.sources.rounds import shared_dir
from factweave.sources.tables import table  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    Unlike a cached frame the files survive executors, and unlike a checkpoint they are columnar
    and carry no partitioning, so that adaptive execution may split a skewed join above them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def runs(df: DataFrame, columns: list[str], each: int) -> DataFrame:
    """Rows alike in ``columns`` as runs: ``(*columns, _run, _alike)``, the number of a run and how many rows it stands for, ``each`` at most.

    Rows are counted where they are read, so rows that repeat one id are spread like any others. Nulls are alike.
    """
    alike = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    alike = alike.select(*columns, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / each))).alias("_run"))
    return alike.select(*columns, "_run", F.least(F.lit(each).cast("long"), F.col("_n") - F.col("_run") * each).alias("_alike"))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with one object per task: ``make()`` runs on the executor and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if batch.num_rows:
                yield apply(batch)

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def hashed_share(key: Column, most: int, of: int) -> Column:
    """Whether a row is in a sample of about ``most`` of ``of`` rows, by its key's hash. A filter, so no task or driver sees more."""
    share = min(1.0, most / max(of, 1))
    return F.lit(True) if share == 1.0 else F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, longer by as many underscores as no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def chunks_for(rows: int, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` rows hold ``rows`` rows."""
    return max(least, -(-rows // each))
