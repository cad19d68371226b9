"""Constraints as audits: row rules, keys, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass; an unknown result passes, as in a SQL CHECK."""
    counts = rows.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")
