"""Reading and writing: Parquet tables, checked delimited text, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: A delimited evidence file has exactly these columns, in this order.
EVIDENCE = T.StructType(
    [
        T.StructField("subject_key", T.LongType(), False),
        T.StructField("family", T.StringType(), False),
        T.StructField("item_id", T.LongType(), False),
        T.StructField("value", T.LongType(), False),
        T.StructField("slot", T.IntegerType(), True),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed_lines(lines: DataFrame, column: str, schema: T.StructType = EVIDENCE, separator: str = ",") -> DataFrame:
    """Fields of delimited ``lines`` by a fixed schema, with ``reject``: why a row can't be used, or null.

    The separator is taken as it is; a field in double quotes may hold it. A row is rejected for a
    wrong number of fields, a missing required field or a failed cast; nothing is raised, so one bad
    row doesn't end a job.
    """
    names = [f"f{i}" for i in range(len(schema))]
    parsed = F.from_csv(F.col(column), ", ".join(f"{n} string" for n in [*names, "wrong"]), {"sep": separator, "escape": '"', "columnNameOfCorruptRecord": "wrong"})
    lines = lines.select(parsed.alias("p"), (F.trim(column) == "").alias("blank"))
    raw = lambda i: F.nullif(F.trim(F.col("p")[names[i]]), F.lit(""))
    values = [raw(i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    bad = F.when(F.col("p.wrong").isNotNull() | F.coalesce("blank", F.lit(True)), F.lit("field_count"))
    for i, f in enumerate(schema):
        if not f.nullable:
            bad = bad.when(raw(i).isNull(), F.lit(f"missing:{f.name}"))
        bad = bad.when(raw(i).isNotNull() & raw(i).try_cast(f.dataType).isNull(), F.lit(f"type:{f.name}"))
    return lines.select(*values, bad.alias("reject"))


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of evidence files with a header line."""
    lines = spark.read.text(path).filter(F.col("value") != F.lit(",".join(EVIDENCE.fieldNames())))
    rows = typed_lines(lines.withColumnRenamed("value", "_line"), "_line")
    return rows.filter("reject is null").drop("reject"), rows.filter("reject is not null")


def write_report(df: DataFrame, path: str, form: str = "json", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).format(form).save(path)
