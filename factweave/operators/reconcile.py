"""Bringing stored state in line with what is desired, without losing protected picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_actions(desired: DataFrame, current: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Insert, update or unchanged for each desired row."""
    c = current.select(*keys, F.struct(*values).alias("_old"))
    j = desired.join(c, keys, "left")
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_old.{v}")) for v in values])
    return j.withColumn("action", F.when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")).drop("_old")


def sync_sets(desired: DataFrame, current: DataFrame, keys: list[str], managed: Column, complete: Column | None = None, never: Column | None = None) -> DataFrame:
    """An action for every member, wanted or stored.

    Stored members that are not desired are deleted only if managed, only for owners whose set is
    ``complete`` (default: all) and unless ``never``; else they are protected or kept.
    """
    j = desired.select(*keys, F.lit(True).alias("_want")).join(current.withColumn("_have", F.lit(True)), keys, "full_outer")
    whole = F.lit(True) if complete is None else F.coalesce(complete, F.lit(False))
    spared = F.lit(False) if never is None else F.coalesce(never, F.lit(False))
    action = (
        F.when(F.col("_have").isNull(), "insert")
        .when(F.col("_want").isNotNull(), "keep")
        .when(~F.coalesce(managed, F.lit(False)), "protected")
        .when(~whole | spared, "kept_partial")
        .otherwise("delete")
    )
    return j.withColumn("action", action).drop("_want", "_have")


def set_headers(actions: DataFrame, owner: list[str]) -> DataFrame:
    left = F.col("action") != "delete"
    return actions.groupBy(*owner).agg(F.count_if(left).alias("members"), F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "delete").alias("deleted"), F.count_if(F.col("action") == "protected").alias("protected"))


def delete_if_unowned(candidates: DataFrame, owners: list[DataFrame], key: str) -> DataFrame:
    """Candidates that no owner (protected pick or dependant) refers to."""
    return reduce(lambda rows, o: rows.join(o.select(key), key, "left_anti"), owners, candidates)


def unresolved(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Rows with their first failing reason."""
    reason = reduce(lambda c, r: c.when(r[1], r[0]), reasons[1:], F.when(reasons[0][1], reasons[0][0]))
    return rows.withColumn("reason", reason).filter("reason is not null")


def resolve_ids(rows: DataFrame, native: str, identities: DataFrame, canonical: str) -> DataFrame:
    """Keep the native id and add the canonical one where the identity exists."""
    return rows.join(identities.select(F.col(canonical).alias("_c")).distinct(), F.col(native) == F.col("_c"), "left").withColumnRenamed("_c", canonical)


def reconcile(base: DataFrame, patch: DataFrame, current: DataFrame, key: str, protected: Column) -> tuple[DataFrame, DataFrame]:
    """Compose, compare with stored state and decide: ``(actions, new_state)``. Protected stored rows win over both change and removal."""
    from factweave.operators.compose import overlay

    fields = [c for c in base.columns if c != key]
    desired = overlay(base, patch, key).select(key, F.struct(*fields).alias("_want"))
    j = desired.join(current.select(key, F.struct(*fields).alias("_have"), protected.alias("_protected")), key, "full_outer")
    same = F.col("_want").eqNullSafe(F.col("_have"))
    action = (
        F.when(F.col("_have").isNull(), "insert")
        .when(same, "unchanged")
        .when(F.col("_protected"), "protected")
        .when(F.col("_want").isNull(), "delete")
        .otherwise("update")
    )
    j = j.withColumn("action", action)
    new = j.filter("action <> 'delete'").select(key, F.when(F.col("action").isin("insert", "update"), F.col("_want")).otherwise(F.col("_have")).alias("_r"))
    return j.select(key, "action"), new.select(key, "_r.*")


def pivot_facts(facts: DataFrame, subject: str, fact: str, value: str, names: list[str]) -> DataFrame:
    """Typed tables from selected facts; the pivot values are given, so no extra pass looks for them."""
    return facts.groupBy(subject).pivot(fact, names).agg(F.first(value))
