"""Reports over the evidence: sources, conflicts, unselected facts, resolution and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_facts(statements: DataFrame, selected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per fact, the base of all reports: statements, distinct values, sources, and whether it is selected."""
    per = statements.groupBy(*keys).agg(F.count("*").alias("statements"), F.count_distinct(value).alias("distinct_values"), F.count_distinct("source_key").alias("sources"))
    marked = selected.select(*keys, F.lit(True).alias("selected"), "policy")
    return per.join(marked, keys, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def fact_state(selected: Column, distinct_values: Column) -> Column:
    return F.when(selected, "selected").when(distinct_values == 0, "empty_unselected").when(distinct_values > 1, "conflict_unselected").otherwise("single_value_unselected")


def conflicts(groups: DataFrame) -> DataFrame:
    return groups.filter("distinct_values > 1").withColumn("unresolved", ~F.col("selected"))


def unselected(groups: DataFrame) -> DataFrame:
    return groups.filter("not selected and distinct_values = 1")


def levels(rows: DataFrame, sets: list[list[str]], **aggregates: Column) -> DataFrame:
    """Several groupings in one pass; ``level`` names the columns a row is grouped by."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    named = [[F.col(c) for c in s] for s in sets]
    return rows.groupingSets(named, *[F.col(c) for c in columns]).agg(level.alias("level"), *[a.alias(n) for n, a in aggregates.items()])
