"""What is known about one thing, or everything about a zone: nested views over whole tables, keyed so that one thing is a filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.entities import geography
from factweave.sources.rounds import settle

from factweave.operators.selection import unique_fallback


@dataclass(frozen=True)
class ZoneInspection:
    """Tables keyed by ``zone_id``; ``coverage`` has one row per zone, with what was cut off."""

    entities: DataFrame
    items: DataFrame
    quests: DataFrame
    vendors: DataFrame
    trainers: DataFrame
    recipes: DataFrame | None
    coverage: DataFrame


def first_per(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group in order, and ``in_group``, how many there are."""
    own = Window.partitionBy(group)
    return rows.withColumn("_at", F.row_number().over(own.orderBy(*order))).filter(F.col("_at") <= most).drop("_at")


def inspect_zones(
    zones: DataFrame, spawns: DataFrame, loot: DataFrame, ends: DataFrame, trainers: DataFrame, evidence: DataFrame | None, *, entity_limit: int = 1000, recipe_limit: int = 100
) -> ZoneInspection:
    """All zones at once; ``inspect_zones(zones.filter("zone_id = 12"), ...)`` inspects one.

    The first ``entity_limit`` entities of ``spawns(kind, id, zone_id)`` in each zone, by kind and id, are projected
    to their items (``loot`` paths), quests (``ends(quest_id, role, kind, id)``), vendors and
    trainers (``trainers(trainer_id, recipe_id, known)``). ``evidence(zone_id, kind, id, recipe_id, evidence)`` shows recipes that an
    entity of the zone can teach, ``recipe_limit`` per zone; without it recipes are left out. What isn't
    proven stays unknown. Every projection is its own table, so no zone is gathered in one row.
    """
    if not 1 <= entity_limit <= 1000 or not 1 <= recipe_limit <= 1000:
        raise ValueError("limits are 1 to 1000")
    here = spawns.join(zones.select("zone_id"), "zone_id", "left_semi").select("zone_id", "kind", "id").distinct()
    entities = settle(first_per(here, "zone_id", ["kind", "id"], entity_limit))  # every projection starts from it
    creatures = entities.filter("kind = 'creature'").select("zone_id", F.col("id").alias("source_id"))
    sold = loot.join(creatures, "source_id")
    path = F.struct("source_id", "family", "reference_id", "chance", "max_count")
    items = sold.groupBy("zone_id", "item_id").agg(F.array_sort(F.collect_set(path)).alias("paths"))
    vendors = sold.filter("family = 'vendor'").groupBy("zone_id", F.col("source_id").alias("vendor_id")).agg(F.array_sort(F.collect_set(F.struct("item_id", "max_count"))).alias("items"))
    quests = ends.join(entities, ["kind", "id"]).groupBy("zone_id", "role", "quest_id").agg(F.array_sort(F.collect_set(F.struct("kind", "id"))).alias("by"))
    taught = trainers.join(creatures.withColumnRenamed("source_id", "trainer_id"), "trainer_id").groupBy("zone_id", "trainer_id", F.when(F.col("known"), "known").otherwise("unresolved").alias("state")).agg(F.array_sort(F.collect_set("recipe_id")).alias("recipes"))
    recipes = shown = None
    if evidence is not None:
        shown = evidence.join(entities, ["zone_id", "kind", "id"], "left_semi").groupBy("zone_id", "recipe_id").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))
        recipes = first_per(shown, "zone_id", ["recipe_id"], recipe_limit)
    counts = [here.groupBy("zone_id").agg(F.count("*").alias("entities_total")), entities.groupBy("zone_id").agg(F.count("*").alias("entities"))]
    for name, rows in (("items", items), ("quests", quests), ("vendors", vendors), ("trainers", taught)):
        counts.append(rows.groupBy("zone_id").agg(F.count("*").alias(name)))
    if shown is not None:
        counts.append(shown.groupBy("zone_id").agg(F.count("*").alias("recipes_shown")))
    out = zones.select("zone_id", "zone_name")
    for part in counts:
        out = out.join(part, "zone_id", "left")
    numbers = [c for c in out.columns if c not in ("zone_id", "zone_name")]
    out = out.select("zone_id", "zone_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    out = out.withColumn("entities_truncated", F.col("entities_total") > F.col("entities"))
    out = out.withColumn("recipes_truncated", F.col("recipes_shown") > recipe_limit if shown is not None else F.lit(None).cast("boolean"))
    return ZoneInspection(entities, items, quests, vendors, taught, recipes, out)


def zone_states(zones: DataFrame, entities: DataFrame, spawns: DataFrame, declared: DataFrame, selected: DataFrame) -> DataFrame:
    """``(zone_id, known_match, known_non_match, unknown)``: how many entities each zone holds, surely doesn't hold, or may hold.

    Apart from the zones that its spawns prove, an entity is a non-match everywhere or unknown everywhere
    (see ``entities.geography``), so each zone's numbers are all entities' less those that it holds: no zone is paired with all entities.
    """
    never = F.lit(False)
    proven = geography(spawns, declared, selected, never, F.col("zone_id").isNull(), never).select("kind", "id", F.col("answer").isNotNull().alias("_proven"))
    known = entities.select("kind", "id").join(proven, ["kind", "id"], "left").select("kind", "id", F.coalesce("_proven", never).alias("_proven"))
    held = spawns.filter("zone_id is not null").select("zone_id", "kind", "id").distinct().join(known, ["kind", "id"])
    held = held.groupBy("zone_id").agg(F.count("*").alias("known_match"), F.count_if("_proven").alias("_p"))
    total = known.agg(F.count("*").alias("_n"), F.count_if("_proven").alias("_all"))  # one row
    out = zones.select("zone_id").join(held, "zone_id", "left").join(F.broadcast(total))
    match, own = F.coalesce("known_match", F.lit(0)), F.coalesce("_p", F.lit(0))
    return out.select("zone_id", match.alias("known_match"), (F.col("_all") - own).alias("known_non_match"), (F.col("_n") - F.col("_all") - match + own).alias("unknown"))


def field_provenance(subjects: DataFrame, facts: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``(subject_key, field, seq, how)``: the selected fact behind each field: the named one, else the only one of its family.

    ``fields`` maps a field to its fact's key and family; ``facts(subject_key, fact_key, fact_family, seq)``.
    """
    kinds = F.array(*[F.struct(F.lit(name).alias("field"), F.lit(key).alias("fact_key"), F.lit(family).alias("fact_family")) for name, (key, family) in fields.items()])
    wanted = subjects.select("subject_key", F.inline(kinds))
    exact, target = ["subject_key", "fact_key"], ["subject_key", "fact_family"]
    return unique_fallback(wanted, facts.select("subject_key", "fact_key", "fact_family", "seq"), exact, target, "seq").select("subject_key", "field", "seq", "how")


def member_states(selected: DataFrame, stored: DataFrame, keys: list[str], reason: Column) -> DataFrame:
    """Every member that is selected or stored: resolved where both say so, else unresolved with ``reason``, or extra."""
    j = selected.withColumn("_s", F.lit(True)).join(stored.select(*keys, F.lit(True).alias("_m")), keys, "full_outer")
    state = F.when(F.col("_s") & F.col("_m"), "resolved").when(F.col("_s"), "unresolved").otherwise("extra")
    return j.select(*keys, state.alias("state"), F.when(state == "unresolved", reason).alias("reason"))


def listed(column: str | Column, *parts: str, between: str = "/") -> Column:
    """An array of structs as text: parts joined by ``between``, missing ones as ``-``, elements by commas in order of their text."""
    one = lambda x: F.concat_ws(between, *[F.coalesce(x[p].cast("string"), F.lit("-")) for p in parts])
    return F.array_join(F.array_sort(F.transform(column, one)), ",")
