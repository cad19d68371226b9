"""Entity views: where items come from, where things are, and what is known about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def located(spawns: DataFrame, zones: DataFrame, maps: DataFrame) -> DataFrame:
    """Spawns with zone and map names; the map is the zone's. Small dimension tables join by hash as their size allows."""
    return spawns.join(zones.select("zone_id", "zone_name", "map_id"), "zone_id", "left").join(maps.select("map_id", "map_name"), "map_id", "left")


def item_sources(loot: DataFrame, places: DataFrame) -> DataFrame:
    """One row per item, source and place, with its acquisition paths folded.

    Sources without a place stay, with nulls. ``chance`` is the one distinct chance of all paths or
    null; chances are never combined. Paths are distinct and in order.
    """
    path = F.struct("family", "reference_id", "chance", "max_count")
    folded = loot.groupBy("item_id", "source_id").agg(F.array_sort(F.collect_set(path)).alias("paths"))
    return folded.join(places, "source_id", "left").withColumn("chance", common_chance(F.col("paths")))


def common_chance(paths: Column) -> Column:
    chances = F.array_distinct(F.filter(F.transform(paths, lambda p: p["chance"]), lambda c: c.isNotNull()))
    return F.when(F.size(chances) == 1, chances[0])


def path_text(paths: Column) -> Column:
    part = lambda p: F.concat_ws("/", p["family"], F.coalesce(p["reference_id"].cast("string"), F.lit("-")), F.coalesce(p["chance"].cast("string"), F.lit("-")), F.coalesce(p["max_count"].cast("string"), F.lit("-")))
    return F.array_join(F.array_sort(F.transform(paths, part)), ",")


def acquisition_match(sources: DataFrame, on_path: Column, on_source: Column) -> DataFrame:
    """Per item: whether one source passes with one of its paths passing; otherwise unknown, as absence proves nothing."""
    hit = on_source & F.exists("paths", lambda p: on_path(p))
    return sources.groupBy("item_id").agg(F.max(F.when(hit, F.lit(True))).alias("acquired"), F.count_if(hit).alias("matching_sources"))


#: Why an entity's place is known or not, in the order in which reasons are tried.
GEOGRAPHY_REASONS = (
    "known_matching_spawn",
    "no_selected_spawn_set",
    "selected_spawn_set_differs_from_stored_spawns",
    "spawn_with_unresolved_zone",
    "spawn_with_unresolved_map",
    "complete_spawn_set_proves_no_match",
)


def spawn_set_coverage(declared: DataFrame, selected: DataFrame, spawns: DataFrame) -> DataFrame:
    """``(kind, id, declared, selected_members, distinct_members, stored_members, unresolved, extra, complete)`` of every entity with a set or a spawn.

    ``declared(kind, id)`` names the selected sets, also empty ones, and ``selected(kind, id, spawn_key)`` their members as
    the source has them; ``spawns(kind, id, spawn_key)`` is what is stored. A set is complete where it and the stored spawns hold
    the same keys: equal numbers prove nothing. Keys are compared in one aggregation by key, so a large set is no large group.
    """
    part = lambda rows, s, m: rows.select("kind", "id", "spawn_key", F.lit(s).alias("_s"), F.lit(m).alias("_m"))
    keys = part(selected, 1, 0).unionByName(part(spawns, 0, 1)).groupBy("kind", "id", "spawn_key").agg(F.sum("_s").alias("_s"), F.max("_m").alias("_m"))
    mine, stored = F.col("_s") > 0, F.col("_m") > 0
    per = keys.groupBy("kind", "id").agg(
        F.sum("_s").alias("selected_members"), F.count_if(mine).alias("distinct_members"), F.count_if(stored).alias("stored_members"), F.count_if(mine & ~stored).alias("unresolved"), F.count_if(stored & ~mine).alias("extra")
    )
    out = declared.select("kind", "id").distinct().withColumn("_declared", F.lit(True)).join(per, ["kind", "id"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("kind", "id", F.coalesce("_declared", F.lit(False)).alias("declared"), *map(zero, ("selected_members", "distinct_members", "stored_members", "unresolved", "extra")))
    return out.withColumn("complete", F.col("declared") & (F.col("unresolved") == 0) & (F.col("extra") == 0))


def geography(spawns: DataFrame, declared: DataFrame, selected: DataFrame, here: Column, no_zone: Column, no_map: Column) -> DataFrame:
    """``(kind, id, answer, reason, spawns)``: a match by any spawn that is ``here``; a non-match only if the selected set equals the stored spawns and each of these says where it is; else unknown.

    ``no_zone`` and ``no_map`` tell spawns that lack what is asked. Entities with neither a set nor a spawn have no row.
    """
    found = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    per = spawns.groupBy("kind", "id").agg(found(here).alias("_hit"), found(no_zone).alias("_zone"), found(no_map).alias("_map"), F.count("*").alias("spawns"))
    j = spawn_set_coverage(declared, selected, spawns).join(per, ["kind", "id"], "left")
    tests = [F.coalesce(c, F.lit(False)) for c in (F.col("_hit"), ~F.col("declared"), ~F.col("complete"), F.col("_zone"), F.col("_map"))]
    pick = lambda values: F.coalesce(*(F.when(t, F.lit(v)) for t, v in zip(tests, values, strict=False)), F.lit(values[-1]))
    reason = pick(GEOGRAPHY_REASONS)
    answer = F.when(reason == GEOGRAPHY_REASONS[0], True).when(reason == GEOGRAPHY_REASONS[-1], False)
    return j.select("kind", "id", answer.alias("answer"), reason.alias("reason"), F.coalesce("spawns", F.lit(0)).alias("spawns"))
