"""Comparing versions of member sets, and the places of their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.rounds import settle

EPSILON = 1e-9


def fact_comparison(comparison: DataFrame, active: DataFrame, keys: list[str], value: str, comparable: Column) -> DataFrame:
    """Five states per fact; facts that can't be compared directly say so first."""
    j = comparison.select(*keys, F.col(value).alias("_c")).withColumn("_in_c", F.lit(True)).join(active.select(*keys, F.col(value).alias("_a")).withColumn("_in_a", F.lit(True)), keys, "full_outer")
    state = (
        F.when(F.col("_in_a").isNull(), "comparison_only")
        .when(F.col("_in_c").isNull(), "active_only")
        .when(~comparable, "not_directly_comparable")
        .when(F.col("_a").eqNullSafe(F.col("_c")), "same_value")
        .otherwise("different_value")
    )
    return j.select(*keys, state.alias("state"))


def presence(left: Column, right: Column) -> Column:
    """Shared, one-sided or absent on both sides; unknown where either side says nothing."""
    return F.when(left.isNull() | right.isNull(), "unknown").when(left & right, "shared").when(right, "comparison_only").when(left, "active_only").otherwise("absent_both")


def pattern(*sides: str) -> Column:
    """Which versions hold a member, as a text of 0 and 1."""
    return F.concat(*[F.when(F.col(s), "1").otherwise("0") for s in sides])


def set_relation(members: DataFrame, owner: list[str], left: str, right: str) -> DataFrame:
    """Equal, strict superset either way, disjoint or partial overlap, with cardinalities."""
    a, b = F.col(left), F.col(right)
    counts = members.groupBy(*owner).agg(F.count_if(a).alias("left_members"), F.count_if(b).alias("right_members"), F.count_if(a & b).alias("shared"))
    only_a, only_b = F.col("left_members") - F.col("shared"), F.col("right_members") - F.col("shared")
    relation = (
        F.when((only_a == 0) & (only_b == 0), "equal")
        .when(only_b == 0, "left_superset")
        .when(only_a == 0, "right_superset")
        .when(F.col("shared") == 0, "disjoint")
        .otherwise("partial_overlap")
    )
    return counts.withColumn("relation", relation)


def topology(active_only: Column, comparison_only: Column, shared: Column) -> Column:
    return F.when((active_only > 0) & (comparison_only > 0), "mixed").when(active_only > 0, "active_only").when(comparison_only > 0, "comparison_only").when(shared > 0, "shared_only").otherwise("empty")


def cardinality(n: Column) -> Column:
    return F.when(n == 0, "zero").when(n == 1, "one").otherwise("multiple")


def pair_distances(left: DataFrame, right: DataFrame, bucket: list[str], member: str) -> DataFrame:
    """Distances of all pairs in one parent and context: an equi-join on the bucket, never a cross join."""
    a = left.select(*bucket, F.col(member).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = right.select(*bucket, F.col(member).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.join(b, bucket).select(*bucket, "a", "b", F.sqrt(dx * dx + dy * dy).alias("distance"))


def nearest(pairs: DataFrame, bucket: list[str]) -> DataFrame:
    """Pairs that are nearest from either side, ties within epsilon kept, and whether mutually so.

    Pairs are made once: both windows keep the partitioning by bucket that the pairs' join has, so
    they sort but don't shuffle, and hold one member's partners at a time.
    """
    of = {side: Window.partitionBy(*bucket, side) for side in "ab"}
    near = lambda side: (F.col("distance") <= F.min("distance").over(of[side]) + EPSILON).alias(f"nearest_{side}")
    j = pairs.select("*", near("a"), F.count("*").over(of["a"]).alias("candidates_a")).select("*", near("b"), F.count("*").over(of["b"]).alias("candidates_b"))
    return j.filter("nearest_a or nearest_b").withColumn("mutual", F.col("nearest_a") & F.col("nearest_b"))


def band(distance: Column, edges: tuple[float, ...]) -> Column:
    """``0``, then right-closed bands up to the last edge, then above it."""
    out, low = F.when(distance <= EPSILON, "0"), 0
    for edge in edges:
        out = out.when(distance <= edge + EPSILON, f"({low:g},{edge:g}]")
        low = edge
    return out.otherwise(f">{low:g}")


def cumulative_share(totals: DataFrame, key: str, total: str) -> DataFrame:
    """Rank by total, running total and its share in percent, rounded to six places, half to even.

    Keys are ranked inside ranges of the order, each of which starts where those before it end, so
    no task sorts all of them.
    """
    order = [F.desc(total), F.col(key)]
    parts = settle(totals.select(key, total).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(total).alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sizes.select("_p", upto("_n").alias("_rank"), upto("_t").alias("_sum"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    own = Window.partitionBy("_p").orderBy(*order)
    rows = parts.withColumn("_at", F.row_number().over(own)).withColumn("_own", F.sum(total).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    running = F.col("_sum") + F.col("_own")
    rows = rows.join(F.broadcast(starts), "_p")
    return rows.select(key, total, (F.col("_rank") + F.col("_at")).alias("rank"), running.alias("running"), F.bround(running * 100.0 / F.col("_all"), 6).alias("share"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


STATES = ("comparison_only", "active_only", "same_value", "different_value", "not_directly_comparable")


def comparison_report(compared: DataFrame, *, kinds: tuple[str, ...] | None = None, families: tuple[str, ...] | None = None, states: tuple[str, ...] = STATES, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(counts, examples)`` of ``compared(subject_kind, fact_family, state, ...)``: counts by kind, family and state over all that the filters leave, and the first rows in the wanted states."""
    if not states or not set(states) <= set(STATES):
        raise ValueError(f"states are some of {', '.join(STATES)}")
    if isinstance(limit, bool) or not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    rows = compared
    for column, wanted in (("subject_kind", kinds), ("fact_family", families)):
        if wanted is not None:
            rows = rows.filter(F.col(column).isin(*wanted))
    counts = rows.groupBy("subject_kind", "fact_family").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return counts, rows.filter(F.col("state").isin(*states)).orderBy("subject_kind", "subject_key", "fact_key").limit(limit)


def pair_classes(near: DataFrame, left: str, right: str, distance: Column) -> DataFrame:
    """Nearest pairs by the patterns of both members and the distance's band: all, mutual, and how many partners tie for nearest."""
    ties = F.count_if("nearest_a").over(Window.partitionBy("parent", "context", "a"))
    rows = near.withColumn("_ties", ties).withColumn("tied", F.when(F.col("nearest_a"), cardinality(F.col("_ties"))).otherwise("not_nearest"))
    return rows.groupBy(F.concat(F.col(left), F.lit(">"), F.col(right)).alias("class"), distance.alias("band"), "tied").agg(F.count("*").alias("pairs"), F.count_if("mutual").alias("mutual"))
