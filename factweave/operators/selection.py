"""Selecting at most one winner per fact, under named policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_selection(old: DataFrame, new: DataFrame, keys: list[str], call: str) -> DataFrame:
    """One winner per fact: the newest call."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(call))
    return old.unionByName(new).withColumn("_at", F.row_number().over(newest)).filter("_at = 1").drop("_at")


def select_first(statements: DataFrame, selected: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first statement of every fact that has no winner yet."""
    return statements.join(selected.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(seq).alias(seq))


def authoritative(current: DataFrame, statements: DataFrame, keys: list[str], seq: str, is_authority: Column) -> DataFrame:
    """The authority's latest statement wins wherever there is one, chosen before or not."""
    best = statements.filter(is_authority).groupBy(*keys).agg(F.max(seq).alias("_best"))
    return current.join(best, keys, "full_outer").select(*keys, F.coalesce("_best", seq).alias(seq), F.col("_best").isNotNull().alias("forced"))


def overlay_selection(current: DataFrame, overlay: DataFrame, keys: list[str], seq: str, policy: str, managed: list[str]) -> DataFrame:
    """An overlay's statement replaces managed picks and fills gaps; a custom pick is protected and reported so."""
    joined = overlay.select(*keys, F.col(seq).alias("_new")).join(current.select(*keys, F.col(seq).alias("_old"), F.col(policy).alias("_policy")), keys, "left")
    free = F.col("_policy").isNull() | F.col("_policy").isin(managed)
    action = F.when(F.col("_policy").isNull(), "selected").when(free, "replaced").otherwise("protected")
    return joined.select(*keys, F.when(free, F.col("_new")).otherwise(F.col("_old")).alias(seq), action.alias("action"))


def guard_absence(picks: DataFrame, subject: list[str], absent: Column, protected: Column) -> DataFrame:
    """A statement of absence may win only where no selected fact of its subject is protected."""
    held = Window.partitionBy(*subject)
    return picks.withColumn("subject_protected", F.bool_or(protected).over(held)).withColumn("allowed", ~(absent & F.col("subject_protected")))


def ranked_resolution(evidence: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """The highest rank wins; differing values at that rank leave no winner; any two values are a conflict."""
    per = evidence.withColumn("_rank", rank).groupBy(*keys, "_rank").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
    top = F.max(F.struct(F.col("_rank").alias("rank"), F.col("_low").alias("low"), F.col("_high").alias("high")))
    out = per.groupBy(*keys).agg(top.alias("t"), F.min("_low").alias("_min"), F.max("_high").alias("_max"), F.sum("_n").alias("statements"))
    ambiguous = F.col("t.low") != F.col("t.high")
    return out.select(
        *keys,
        F.col("t.rank").alias("rank"),
        F.when(~ambiguous, F.col("t.low")).alias("value"),
        F.when(ambiguous, "ambiguous_same_priority").otherwise("resolved").alias("status"),
        (F.col("_min") != F.col("_max")).alias("conflict"),
        "statements",
    )


def guarded_update(current: DataFrame, incoming: DataFrame, keys: list[str], value: str, rank: str, source: str, protected: str) -> DataFrame:
    """What an incoming value does: never lowers a rank, never touches protected rows, and equal rank counts for its own source only."""
    c = current.select(*keys, *[F.col(x).alias(f"_{x}") for x in (value, rank, source, protected)])
    j = incoming.join(c, keys, "left")
    action = (
        F.when(F.col(f"_{rank}").isNull(), "inserted")
        .when(F.col(f"_{protected}"), "protected")
        .when(F.col(rank) < F.col(f"_{rank}"), "kept_higher_rank")
        .when((F.col(rank) == F.col(f"_{rank}")) & (F.col(source) != F.col(f"_{source}")), "kept_equal_rank")
        .when(F.col(value) == F.col(f"_{value}"), "unchanged")
        .otherwise("updated")
    )
    j = j.withColumn("action", action)
    return j.select(*keys, F.when(F.col("action").isin("inserted", "updated"), F.col(value)).otherwise(F.col(f"_{value}")).alias(value), "action")


def clear_ambiguous(selected: DataFrame, resolution: DataFrame, keys: list[str], managed: Column) -> DataFrame:
    """Managed selections go where the best evidence has become ambiguous."""
    return selected.join(resolution.filter("status = 'ambiguous_same_priority'").select(*keys, F.lit(True).alias("_amb")), keys, "left").filter(~(managed & F.coalesce("_amb", F.lit(False)))).drop("_amb")


def active_members(members: DataFrame, complete: DataFrame, owner: list[str], member: str, managed: Column, partial_positive: Column) -> DataFrame:
    """With a complete set, managed members outside it are inactive unless a partial-positive source holds them; custom ones always count."""
    sets = complete.select(*owner, F.col(member), F.lit(True).alias("_in")).distinct()
    owners = complete.select(*owner).distinct().withColumn("_set", F.lit(True))
    j = members.join(sets, [*owner, member], "left").join(owners, owner, "left")
    outside = F.coalesce("_set", F.lit(False)) & ~F.coalesce("_in", F.lit(False))
    return j.withColumn("active", ~(managed & outside & ~partial_positive)).drop("_in", "_set")


def selected_facts(selected: DataFrame, statements: DataFrame, sources: DataFrame, keys: list[str], seq: str, source: str) -> DataFrame:
    """The view under every query: fact, selection, statement and source."""
    return selected.join(statements, [*keys, seq]).join(sources, source)


def unique_fallback(wanted: DataFrame, facts: DataFrame, exact: list[str], target: list[str], fact_id: str, attributes: tuple[str, ...] = ()) -> DataFrame:
    """Provenance by exact key, else by the only fact with the same target whose attributes agree; two candidates are none.

    An attribute agrees if it is equal or missing on either side.
    """
    by_key = facts.groupBy(*exact).agg(F.min(fact_id).alias("_exact"))
    own = [c for c in dict.fromkeys([*exact, *target, *attributes])]
    asked = wanted.select(*own).distinct()
    held = facts.select(*target, F.col(fact_id).alias("_id"), *[F.col(a).alias(f"_{a}") for a in attributes])
    agree = reduce(lambda x, y: x & y, [F.col(a).isNull() | F.col(f"_{a}").isNull() | (F.col(a) == F.col(f"_{a}")) for a in attributes], F.lit(True))
    by_target = asked.join(held, target).filter(agree).groupBy(*own).agg(F.count("*").alias("_n"), F.min("_id").alias("_only")) if attributes else facts.groupBy(*target).agg(F.count("*").alias("_n"), F.min(fact_id).alias("_only"))
    j = wanted.join(by_key, exact, "left")
    if attributes:
        same = reduce(lambda x, y: x & y, [j[c].eqNullSafe(by_target[c]) for c in own])
        j = j.join(by_target, same, "left").select(j["*"], "_n", "_only")
    else:
        j = j.join(by_target, target, "left")
    only = F.when(F.col("_n") == 1, F.col("_only"))
    how = F.when(F.col("_exact").isNotNull(), "exact").when(only.isNotNull(), "unique_target").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return j.withColumn(fact_id, F.coalesce("_exact", only)).withColumn("how", how).drop("_exact", "_n", "_only")
