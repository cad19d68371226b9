"""Pages of three-state searches: judge all, count all, then filter, sort and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import tristate as ts


def judge(rows: DataFrame, predicates: list[Column]) -> DataFrame:
    """Add ``ok`` (nullable boolean) and ``state``. ``ok`` is a plain boolean expression, so a filter on it is pushed down."""
    ok = ts.every(predicates)
    return rows.withColumn("ok", ok).withColumn("state", ts.state(F.col("ok")))


def summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("state").agg(F.count("*").alias("n"))


def page(judged: DataFrame, key: Column, id_col: Column, limit: int, descending: bool = False) -> DataFrame:
    """The first ``limit`` (1 to 1000) rows with their position. Only the limited rows reach the final numbering."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    order = ts.page_order(key, id_col, descending)
    rows = judged.orderBy(*order).limit(limit)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))
