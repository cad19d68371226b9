"""Items' sources, places, quests, recipes and zones over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import tristate as ts
from factweave.operators import entities as en
from factweave.operators import search
from factweave.plans.ledger import EK, _ACT, _RES, resolution
from factweave.plans.registry import query
from factweave.sources import bindings as b

_PLACES = ", places AS (SELECT s.id AS source_id, s.zone_id, z.map_id FROM spawns s LEFT JOIN zones z ON s.zone_id = z.zone_id WHERE s.kind = 'creature')"
_SRC = _PLACES + """, src AS (SELECT l.item_id, l.source_id, p.zone_id, p.map_id, CASE WHEN count(DISTINCT l.chance) = 1 THEN min(l.chance) END AS chance, count(DISTINCT (l.family, l.reference_id, l.chance, l.max_count)) AS paths,
  string_agg(DISTINCT l.family || '/' || coalesce(CAST(l.reference_id AS VARCHAR), '-') || '/' || coalesce(CAST(l.chance AS VARCHAR), '-') || '/' || coalesce(CAST(l.max_count AS VARCHAR), '-'), ',' ORDER BY l.family || '/' || coalesce(CAST(l.reference_id AS VARCHAR), '-') || '/' || coalesce(CAST(l.chance AS VARCHAR), '-') || '/' || coalesce(CAST(l.max_count AS VARCHAR), '-')) AS path_list
  FROM loot l LEFT JOIN places p ON l.source_id = p.source_id GROUP BY l.item_id, l.source_id, p.zone_id, p.map_id)"""
LOOT = b.with_views("loot", "spawns", "zones")
_STATE = "CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'known_match' ELSE 'known_non_match' END AS state"


def places(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.spawns(spark, sf).filter("kind = 'creature'").select(F.col("id").alias("source_id"), "zone_id")
    return rows.join(b.zones(spark, sf).select("zone_id", "map_id"), "zone_id", "left").select("source_id", "zone_id", "map_id")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return en.item_sources(b.loot(spark, sf), places(spark, sf))


@query("e04_item_sources", LOOT + _SRC + " SELECT * FROM src")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).select("item_id", "source_id", "zone_id", "map_id", "chance", F.size("paths").cast("long").alias("paths"), en.path_text(F.col("paths")).alias("path_list"))


@query("e05_vendor_count_check", b.with_views("loot") + "SELECT source_id, item_id, max_count, CASE WHEN source_id % 9 = 4 THEN 'no_selected_relation' WHEN max_count < 10 THEN 'count_too_small' END AS violation FROM loot WHERE family = 'vendor' AND (source_id % 9 = 4 OR max_count < 10)")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    from factweave.operators.reconcile import unresolved

    rows = b.loot(spark, sf).filter("family = 'vendor'")
    out = unresolved(rows, [("no_selected_relation", F.col("source_id") % 9 == 4), ("count_too_small", F.col("max_count") < 10)])
    return out.select("source_id", "item_id", "max_count", F.col("reason").alias("violation"))


@query(
    "e06_item_acquisitions",
    b.with_views("items", "loot", "spawns", "zones")
    + _PLACES
    + """, hits AS (SELECT l.item_id, count(DISTINCT l.source_id) AS n FROM loot l JOIN places p USING (source_id) WHERE p.zone_id IN (1, 2, 3, 4, 5, 6, 7) AND p.map_id = p.zone_id % 5 AND l.family <> 'vendor' AND l.chance >= 5 GROUP BY l.item_id)
  SELECT s.item_id, coalesce(h.n, 0) AS matching_sources, CASE WHEN NOT ok THEN 'known_non_match' WHEN h.n IS NULL THEN 'unknown' ELSE 'known_match' END AS state FROM (SELECT item_id, contains(lower(name), 'ring') AS ok FROM items) s LEFT JOIN hits h USING (item_id)""",
)
def e06(spark: SparkSession, sf: str) -> DataFrame:
    """Zone, map and kind on one source row, path kind and chance on one of its paths; the absence of one proves nothing."""
    on_source = F.col("zone_id").isin(*range(1, 8)) & (F.col("map_id") == F.col("zone_id") % 5)
    found = en.acquisition_match(sources(spark, sf), lambda p: (p["family"] != "vendor") & (p["chance"] >= 5), on_source)
    rows = b.items(spark, sf).join(found, "item_id", "left")
    judged = search.judge(rows, [ts.contains(F.col("name"), "ring"), ts.positive_only(F.col("acquired"))])
    return judged.select("item_id", F.coalesce("matching_sources", F.lit(0)).cast("long").alias("matching_sources"), "state")


@query("e07_world_locations", b.with_views("entities", "spawns", "zones", "maps") + "SELECT e.kind, e.id, e.name, s.zone_id, z.zone_name, z.map_id, m.map_name FROM entities e JOIN spawns s USING (kind, id) LEFT JOIN zones z ON s.zone_id = z.zone_id LEFT JOIN maps m ON z.map_id = m.map_id WHERE e.name ILIKE '%R#0000000_7%'")
def e07(spark: SparkSession, sf: str) -> DataFrame:
    found = b.entities(spark, sf).filter(F.col("name").ilike("%R#0000000_7%")).join(b.spawns(spark, sf), ["kind", "id"])
    return en.located(found, b.zones(spark, sf), b.maps(spark, sf)).select("kind", "id", "name", "zone_id", "zone_name", "map_id", "map_name")


#: Sets and stored spawns of each entity by key, and the reasons of a place in order.
COVERED = """, k AS (SELECT kind, id, spawn_key, sum(s) AS s, max(m) AS m FROM (SELECT kind, id, spawn_key, 1 AS s, 0 AS m FROM set_members UNION ALL SELECT kind, id, spawn_key, 0, 1 FROM spawn_keys) GROUP BY ALL),
  sets AS (SELECT kind, id, CAST(sum(s) AS BIGINT) AS selected_members, count(*) FILTER (s > 0) AS distinct_members, count(*) FILTER (m > 0) AS stored_members, count(*) FILTER (s > 0 AND m = 0) AS unresolved, count(*) FILTER (s = 0) AS extra FROM k GROUP BY ALL),
  covered AS (SELECT kind, id, h.k IS NOT NULL AS declared, coalesce(selected_members, 0) AS selected_members, coalesce(distinct_members, 0) AS distinct_members, coalesce(stored_members, 0) AS stored_members, coalesce(unresolved, 0) AS unresolved, coalesce(extra, 0) AS extra
   FROM (SELECT *, 1 AS k FROM set_headers) h FULL JOIN sets USING (kind, id))"""
REASON = """CASE WHEN hit THEN 'known_matching_spawn' WHEN NOT declared THEN 'no_selected_spawn_set' WHEN unresolved > 0 OR extra > 0 THEN 'selected_spawn_set_differs_from_stored_spawns'
  WHEN no_zone THEN 'spawn_with_unresolved_zone' WHEN no_map THEN 'spawn_with_unresolved_map' ELSE 'complete_spawn_set_proves_no_match' END"""
SETS = ("entities", "spawn_keys", "set_headers", "set_members")


@query(
    "e08_world_entities",
    b.with_views(*SETS, "zones")
    + COVERED
    + """, per AS (SELECT kind, id, bool_or(coalesce(s.zone_id IN (3, 4, 5) AND z.map_id < 4, false)) AS hit, bool_or(s.zone_id IS NULL) AS no_zone, bool_or(z.map_id IS NULL) AS no_map FROM spawn_keys s LEFT JOIN zones z USING (zone_id) GROUP BY kind, id)
  SELECT kind, id, CASE reason WHEN 'known_matching_spawn' THEN 'known_match' WHEN 'complete_spawn_set_proves_no_match' THEN 'known_non_match' ELSE 'unknown' END AS state, reason FROM (SELECT kind, id, """
    + REASON
    + " AS reason FROM covered LEFT JOIN per USING (kind, id))",
)
def e08(spark: SparkSession, sf: str) -> DataFrame:
    """T-08 within E-08: a non-match needs a selected set whose keys are those of the stored spawns, all of them placed."""
    where = b.spawn_keys(spark, sf).join(b.zones(spark, sf).select("zone_id", "map_id"), "zone_id", "left")
    here = F.col("zone_id").isin(3, 4, 5) & (F.col("map_id") < 4)
    found = en.geography(where, b.set_headers(spark, sf), b.set_members(spark, sf), here, F.col("zone_id").isNull(), F.col("map_id").isNull())
    return found.select("kind", "id", ts.state(F.col("answer")).alias("state"), "reason")


@query("e09_spawn_set_keys", b.with_views(*SETS) + COVERED + " SELECT *, declared AND unresolved = 0 AND extra = 0 AS complete FROM covered")
def e09_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Selected and stored spawns of every entity compared by key."""
    return en.spawn_set_coverage(b.set_headers(spark, sf), b.set_members(spark, sf), b.spawn_keys(spark, sf))


@query("e09_spawn_set_coverage", b.with_views("members") + "SELECT parent, count(*) FILTER (in_base) AS declared, count(*) FILTER (in_active) AS materialised, count(*) FILTER (in_base AND NOT in_active) AS unresolved, count(*) FILTER (in_active AND NOT in_base) AS extra, parent % 6 <> 5 AND bool_and(in_base = in_active) AS complete FROM members GROUP BY parent")
def e09(spark: SparkSession, sf: str) -> DataFrame:
    base, active = F.col("in_base"), F.col("in_active")
    per = b.members(spark, sf).groupBy("parent")
    out = per.agg(F.count_if(base).alias("declared"), F.count_if(active).alias("materialised"), F.count_if(base & ~active).alias("unresolved"), F.count_if(active & ~base).alias("extra"), F.bool_and(base == active).alias("_same"))
    return out.withColumn("complete", (F.col("parent") % 6 != 5) & F.col("_same")).drop("_same")


@query("e10_entity_item_roles", b.with_views("loot") + "SELECT source_id, count(DISTINCT item_id) FILTER (family = 'direct') AS direct_items, count(DISTINCT item_id) FILTER (family = 'reference') AS reference_items, count(DISTINCT item_id) FILTER (family = 'vendor') AS vendor_items, count(DISTINCT item_id) AS items FROM loot GROUP BY source_id")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda family: F.count_distinct(F.when(F.col("family") == family, F.col("item_id"))).alias(f"{family}_items")
    return b.loot(spark, sf).groupBy("source_id").agg(of("direct"), of("reference"), of("vendor"), F.count_distinct("item_id").alias("items"))


@query("e11_entity_quest_roles", b.with_views("objectives") + "SELECT creature_id, quest_id, CASE WHEN bool_or(item_id % 5 <> 0) AND bool_or(item_id % 3 <> 0) THEN 'materialised' WHEN bool_or(item_id % 3 <> 0) THEN 'selected_only' ELSE 'stored_only' END AS role FROM objectives WHERE item_id % 5 <> 0 OR item_id % 3 <> 0 GROUP BY creature_id, quest_id")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    """Materialised rows merged with selected relations that no row shows."""
    keys = ["creature_id", "quest_id"]
    rows = b.objectives(spark, sf)
    stored = rows.filter("item_id % 5 <> 0").select(*keys).distinct().withColumn("_s", F.lit(True))
    chosen = rows.filter("item_id % 3 <> 0").select(*keys).distinct().withColumn("_c", F.lit(True))
    role = F.when(F.col("_s") & F.col("_c"), "materialised").when(F.col("_c"), "selected_only").otherwise("stored_only")
    return stored.join(chosen, keys, "full_outer").select(*keys, role.alias("role"))


@query("e12_trainer_roles", b.with_views("teaching", "recipes", "entities") + "SELECT t.source_id AS trainer_id, e.name AS trainer, t.recipe_id, r.skill FROM teaching t LEFT JOIN (SELECT * FROM entities WHERE kind = 'creature' AND id % 12 <> 0) e ON t.source_id = e.id LEFT JOIN recipes r USING (recipe_id) WHERE t.kind = 'trainer'")
def e12(spark: SparkSession, sf: str) -> DataFrame:
    """By native entry, also where the trainer is unresolved."""
    names = b.entities(spark, sf).filter("kind = 'creature' and id % 12 <> 0").select(F.col("id").alias("trainer_id"), F.col("name").alias("trainer"))
    rows = b.teaching(spark, sf).filter("kind = 'trainer'").select(F.col("source_id").alias("trainer_id"), "recipe_id")
    return rows.join(names, "trainer_id", "left").join(b.recipes(spark, sf).select("recipe_id", "skill"), "recipe_id", "left").select("trainer_id", "trainer", "recipe_id", "skill")


def _entity_detail(spark: SparkSession, sf: str) -> DataFrame:
    spawn = F.array_sort(F.collect_list(F.struct("zone_id", "x", "y")))
    per = b.spawns(spark, sf).groupBy("kind", "id").agg(spawn.alias("spawns"))
    roles = e10(spark, sf).select(F.lit("creature").alias("kind"), F.col("source_id").alias("id"), F.struct("direct_items", "reference_items", "vendor_items").alias("item_roles"))
    return b.entities(spark, sf).join(per, ["kind", "id"], "left").join(roles, ["kind", "id"], "left")


@query("e13_entity_detail", b.with_views("entities", "spawns", "loot") + "SELECT e.kind, e.id, e.name, (SELECT count(*) FROM spawns s WHERE s.kind = e.kind AND s.id = e.id) AS spawns, r.v AS vendor_items FROM entities e LEFT JOIN (SELECT source_id, count(DISTINCT item_id) FILTER (family = 'vendor') AS v FROM loot GROUP BY source_id) r ON e.kind = 'creature' AND e.id = r.source_id")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entity_detail(spark, sf)
    return rows.select("kind", "id", "name", F.coalesce(F.size("spawns"), F.lit(0)).cast("long").alias("spawns"), F.col("item_roles.vendor_items").alias("vendor_items"))


@query(
    "e14_inspect_zones",
    b.with_views("zones", "spawns", "loot", "teaching")
    + """, here AS (SELECT zone_id, kind, id FROM spawns WHERE zone_id IS NOT NULL)
  SELECT z.zone_id, z.zone_name, count(DISTINCT (h.kind, h.id)) AS entities, count(DISTINCT l.item_id) AS items, count(DISTINCT CASE WHEN l.family = 'vendor' THEN h.id END) AS vendors,
   (SELECT count(DISTINCT t.source_id) FROM teaching t JOIN here x ON x.kind = 'creature' AND x.id = t.source_id WHERE t.kind = 'trainer' AND x.zone_id = z.zone_id) AS trainers
  FROM zones z LEFT JOIN here h ON z.zone_id = h.zone_id LEFT JOIN loot l ON h.kind = 'creature' AND l.source_id = h.id GROUP BY z.zone_id, z.zone_name""",
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    """All zones in one plan, the zone kept as a key; one zone is a filter on it. Each side is counted before the join."""
    here = b.spawns(spark, sf).filter("zone_id is not null").select("zone_id", "kind", "id")
    entities = here.groupBy("zone_id").agg(F.count_distinct("kind", "id").alias("entities"))
    creatures = here.filter("kind = 'creature'").select("zone_id", F.col("id").alias("source_id"))
    items = b.loot(spark, sf).select("source_id", "item_id", "family").join(creatures, "source_id")
    items = items.groupBy("zone_id").agg(F.count_distinct("item_id").alias("items"), F.count_distinct(F.when(F.col("family") == "vendor", F.col("source_id"))).alias("vendors"))
    trainers = b.teaching(spark, sf).filter("kind = 'trainer'").join(creatures, "source_id").groupBy("zone_id").agg(F.count_distinct("source_id").alias("trainers"))
    rows = b.zones(spark, sf).select("zone_id", "zone_name")
    for part in (entities, items, trainers):
        rows = rows.join(part, "zone_id", "left")
    return rows.select("zone_id", "zone_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entities", "items", "vendors", "trainers")])


@query("e15_zone_items", LOOT + _PLACES + " SELECT p.zone_id, l.item_id, count(DISTINCT l.source_id) AS sources, count(DISTINCT (l.source_id, l.family)) AS paths FROM loot l JOIN places p USING (source_id) WHERE p.zone_id IS NOT NULL GROUP BY ALL")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    """A source and item's families are folded into bits where they are read, so that nothing is counted distinct later."""
    bit = F.when(F.col("family") == "direct", 1).when(F.col("family") == "reference", 2).otherwise(4)
    edges = b.loot_lines(spark, sf).groupBy("source_id", "item_id").agg(F.bit_count(F.bit_or(bit)).alias("_families"))
    where = places(spark, sf).filter("zone_id is not null").select("source_id", "zone_id").distinct()
    return edges.join(where, "source_id").groupBy("zone_id", "item_id").agg(F.count("*").alias("sources"), F.sum("_families").alias("paths"))


def _endpoints(spark: SparkSession, sf: str) -> DataFrame:
    giver = b.quests(spark, sf).select("quest_id", F.lit("given").alias("role"), F.lit("object").alias("kind"), F.col("giver").alias("id"))
    o = b.objective_lines(spark, sf)
    finisher = o.groupBy("quest_id").agg(F.min("creature_id").alias("id")).select("quest_id", F.lit("finished").alias("role"), F.lit("creature").alias("kind"), "id")
    objective = o.select("quest_id", F.lit("objective").alias("role"), F.lit("creature").alias("kind"), F.col("creature_id").alias("id")).distinct()
    return giver.unionByName(finisher).unionByName(objective)


_END = """, ends AS (SELECT quest_id, 'given' AS role, 'object' AS kind, giver AS id FROM quests UNION ALL SELECT quest_id, 'finished', 'creature', min(creature_id) FROM objectives GROUP BY quest_id
  UNION ALL SELECT DISTINCT quest_id, 'objective', 'creature', creature_id FROM objectives)"""
QUEST = b.with_views("quests", "objectives", "spawns", "zones") + _END


@query("e16_zone_quests", QUEST + " SELECT s.zone_id, e.role, count(DISTINCT e.quest_id) AS quests FROM ends e JOIN spawns s USING (kind, id) WHERE s.zone_id IS NOT NULL GROUP BY ALL")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    rows = _endpoints(spark, sf).join(b.spawns(spark, sf).filter("zone_id is not null"), ["kind", "id"])
    return rows.groupBy("zone_id", "role").agg(F.count_distinct("quest_id").alias("quests"))


@query("e17_zone_trainers", b.with_views("teaching", "spawns") + "SELECT s.zone_id, count(DISTINCT t.source_id) FILTER (t.source_id % 12 <> 0) AS known, count(DISTINCT t.source_id) FILTER (t.source_id % 12 = 0) AS unresolved FROM teaching t LEFT JOIN (SELECT * FROM spawns WHERE kind = 'creature') s ON t.source_id = s.id WHERE t.kind = 'trainer' GROUP BY s.zone_id")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    where = b.spawns(spark, sf).filter("kind = 'creature'").select(F.col("id").alias("source_id"), "zone_id")
    rows = b.teaching(spark, sf).filter("kind = 'trainer'").join(where, "source_id", "left")
    known = F.col("source_id") % 12 != 0
    return rows.groupBy("zone_id").agg(F.count_distinct(F.when(known, F.col("source_id"))).alias("known"), F.count_distinct(F.when(~known, F.col("source_id"))).alias("unresolved"))


@query(
    "e18_zone_recipes",
    QUEST.replace("WITH RECURSIVE ", "WITH RECURSIVE recipes AS (" + b.SQL["recipes"] + "), teaching AS (" + b.SQL["teaching"] + "), loot AS (" + b.SQL["loot"] + "), ")
    + """, ev AS (SELECT DISTINCT s.zone_id, t.kind AS evidence, t.recipe_id FROM teaching t JOIN loot l ON t.kind = 'item' AND l.item_id = t.source_id JOIN spawns s ON s.kind = 'creature' AND s.id = l.source_id WHERE s.zone_id IS NOT NULL
   UNION SELECT DISTINCT s.zone_id, 'trainer', t.recipe_id FROM teaching t JOIN spawns s ON t.kind = 'trainer' AND s.kind = 'creature' AND s.id = t.source_id WHERE s.zone_id IS NOT NULL
   UNION SELECT DISTINCT s.zone_id, 'quest_' || e.role, t.recipe_id FROM teaching t JOIN ends e ON t.kind = 'quest' AND t.source_id = e.quest_id JOIN spawns s USING (kind, id) WHERE s.zone_id IS NOT NULL)
  SELECT zone_id, count(DISTINCT recipe_id) AS known, (SELECT count(*) FROM recipes) - count(DISTINCT recipe_id) AS unknown, count(*) FILTER (evidence = 'item') AS by_item, count(*) FILTER (evidence = 'trainer') AS by_trainer, count(*) FILTER (evidence LIKE 'quest%') AS by_quest FROM ev GROUP BY zone_id""".replace("USING (kind, id)", "ON s.kind = e.kind AND s.id = e.id"),
)
def e18(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes that a zone can teach by evidence of five kinds; what is not proven is unknown, never a non-match."""
    here = b.spawns(spark, sf).filter("zone_id is not null").select("zone_id", "kind", "id")
    creatures = here.filter("kind = 'creature'").select("zone_id", F.col("id").alias("source_id"))
    teach = b.teaching(spark, sf)
    of = lambda kind, column: teach.filter(F.col("kind") == kind).select(F.col("source_id").alias(column), "recipe_id")
    by_item = of("item", "item_id").join(b.loot(spark, sf).select("item_id", "source_id").distinct(), "item_id").join(creatures, "source_id").select("zone_id", F.lit("item").alias("evidence"), "recipe_id")
    by_trainer = of("trainer", "source_id").join(creatures, "source_id").select("zone_id", F.lit("trainer").alias("evidence"), "recipe_id")
    by_quest = of("quest", "quest_id").join(_endpoints(spark, sf), "quest_id").join(here, ["kind", "id"]).select("zone_id", F.concat(F.lit("quest_"), "role").alias("evidence"), "recipe_id")
    ev = by_item.unionByName(by_trainer).unionByName(by_quest).distinct()
    total = b.recipes(spark, sf).agg(F.count("*").alias("total"))
    counts = ev.groupBy("zone_id").agg(
        F.count_distinct("recipe_id").alias("known"), F.count_if(F.col("evidence") == "item").alias("by_item"), F.count_if(F.col("evidence") == "trainer").alias("by_trainer"), F.count_if(F.col("evidence").startswith("quest")).alias("by_quest")
    )
    return counts.join(F.broadcast(total)).withColumn("unknown", F.col("total") - F.col("known")).drop("total")


@query(
    "e19_quests_search",
    QUEST
    + """, geo AS (SELECT e.quest_id, bool_or(e.role = 'given' AND s.zone_id IN (1, 2, 3)) AS g, bool_or(e.role = 'objective' AND s.zone_id IN (4, 5, 6, 7, 8) AND z.map_id IS NOT NULL) AS o FROM ends e JOIN spawns s USING (kind, id) LEFT JOIN zones z ON s.zone_id = z.zone_id GROUP BY e.quest_id),
  j AS (SELECT q.quest_id, q.level, (q.level >= 5 AND q.level <= 30 AND CASE WHEN g.g THEN true END AND CASE WHEN g.o THEN true END) AS ok FROM quests q LEFT JOIN geo g USING (quest_id)) SELECT quest_id, level, """
    + _STATE
    + " FROM j",
)
def e19(spark: SparkSession, sf: str) -> DataFrame:
    """Levels decide both ways; places of giver and objective only prove a match: T-07."""
    where = _endpoints(spark, sf).join(b.spawns(spark, sf).select("kind", "id", "zone_id"), ["kind", "id"]).join(b.zones(spark, sf).select("zone_id", "map_id"), "zone_id", "left")
    given = (F.col("role") == "given") & F.col("zone_id").isin(1, 2, 3)
    goal = (F.col("role") == "objective") & F.col("zone_id").isin(4, 5, 6, 7, 8) & F.col("map_id").isNotNull()
    geo = where.groupBy("quest_id").agg(F.bool_or(given).alias("g"), F.bool_or(goal).alias("o"))
    rows = b.quests(spark, sf).join(geo, "quest_id", "left")
    judged = search.judge(rows, [ts.at_least(F.col("level"), 5), ts.at_most(F.col("level"), 30), ts.positive_only(F.col("g")), ts.positive_only(F.col("o"))])
    return judged.select("quest_id", "level", "state")


@query("e20_quest_detail", b.with_views("quests", "objectives", "edges") + "SELECT q.quest_id, q.level, (SELECT string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FROM edges e WHERE e.a = q.quest_id) AS prerequisites, (SELECT string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) FROM edges e WHERE e.b = q.quest_id) AS follow_ups, (SELECT count(*) FROM objectives o WHERE o.quest_id = q.quest_id) AS objectives FROM quests q")
def e20(spark: SparkSession, sf: str) -> DataFrame:
    edges = b.edges(spark, sf)
    ids = lambda own, other, name: edges.groupBy(F.col(own).alias("quest_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(other)), lambda x: x.cast("string")), ",").alias(name))
    goals = b.objectives(spark, sf).groupBy("quest_id").agg(F.count("*").alias("objectives"))
    rows = b.quests(spark, sf).join(ids("a", "b", "prerequisites"), "quest_id", "left").join(ids("b", "a", "follow_ups"), "quest_id", "left").join(goals, "quest_id", "left")
    return rows.select("quest_id", "level", "prerequisites", "follow_ups", F.coalesce("objectives", F.lit(0)).cast("long").alias("objectives"))


@query("e21_progression_members", b.with_views("quests", "edges") + "SELECT a AS quest_id, count(*) FILTER (b % 7 <> 2) AS resolved, count(*) FILTER (b % 7 = 2) AS unresolved, bool_and(b % 7 <> 2) AND a % 6 <> 5 AS complete FROM edges GROUP BY a")
def e21(spark: SparkSession, sf: str) -> DataFrame:
    known = b.quests(spark, sf).filter("quest_id % 7 <> 2").select(F.col("quest_id").alias("b"), F.lit(True).alias("known"))
    rows = b.edges(spark, sf).join(known, "b", "left")
    out = rows.groupBy(F.col("a").alias("quest_id")).agg(F.count_if("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    return out.withColumn("complete", (F.col("unresolved") == 0) & (F.col("quest_id") % 6 != 5))


@query(
    "e22_quest_objectives",
    QUEST + """, br AS (SELECT DISTINCT quest_id, CASE creature_id % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'O' ELSE 'A' END AS subtype, creature_id AS target FROM objectives UNION ALL SELECT DISTINCT quest_id, CASE item_id % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'IR' ELSE 'Z' END, item_id FROM objectives)
  SELECT quest_id, subtype, count(*) AS selected, count(*) FILTER (target % 11 <> 4) AS materialised, count(*) = count(*) FILTER (target % 11 <> 4) AS complete FROM br GROUP BY ALL""",
)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    o = b.objective_lines(spark, sf)
    of = lambda c, names: F.when(F.col(c) % 3 == 0, names[0]).when(F.col(c) % 3 == 1, names[1]).otherwise(names[2])
    branch = lambda c, names: o.select("quest_id", F.col(c).alias("target")).distinct().select("quest_id", of("target", names).alias("subtype"), "target")
    rows = branch("creature_id", ("U", "O", "A")).unionByName(branch("item_id", ("I", "IR", "Z")))
    out = rows.groupBy("quest_id", "subtype").agg(F.count("*").alias("selected"), F.count_if(F.col("target") % 11 != 4).alias("materialised"))
    return out.withColumn("complete", F.col("selected") == F.col("materialised"))


@query(
    "e23_quest_item_facts",
    b.with_views("evid") + _RES + _ACT + """ SELECT r.subject_key, r.family, count(*) AS items, count(*) FILTER (r.value IS NOT NULL) AS resolved, count(*) FILTER (r.conflict) AS conflicts, count(cs.item_id) AS in_complete_set, count(*) - count(cs.item_id) AS outside FROM resolution r LEFT JOIN cs USING (subject_key, family, item_id) GROUP BY ALL""",
)
def e23(spark: SparkSession, sf: str) -> DataFrame:
    complete = b.evid(spark, sf).filter("source_key = 2 and subject_key % 3 <> 0").select(*EK).distinct().withColumn("_in", F.lit(True))
    rows = resolution(spark, sf).join(complete, EK, "left")
    return rows.groupBy("subject_key", "family").agg(
        F.count("*").alias("items"), F.count("value").alias("resolved"), F.count_if("conflict").alias("conflicts"), F.count("_in").alias("in_complete_set"), F.count_if(F.col("_in").isNull()).alias("outside")
    )


@query(
    "e24_recipes_search",
    b.with_views("recipes", "teaching", "reagents", "items")
    + """, t AS (SELECT recipe_id, bool_or(kind = 'trainer') AS trained FROM teaching GROUP BY recipe_id), g AS (SELECT recipe_id, bool_or(i.name IS NOT NULL AND contains(i.name, 'r') AND quantity >= 5) AS hit, bool_or(i.name IS NULL AND quantity >= 5) AS maybe FROM reagents r LEFT JOIN (SELECT * FROM items WHERE item_id % 6 <> 0) i USING (item_id) GROUP BY recipe_id),
  j AS (SELECT r.recipe_id, r.skill, r.required, (r.skill IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') AND r.required <= 40 AND CASE WHEN t.trained THEN true END AND CASE WHEN g.recipe_id IS NULL THEN NULL WHEN g.hit THEN true WHEN g.maybe THEN NULL ELSE false END) AS ok
   FROM recipes r LEFT JOIN t USING (recipe_id) LEFT JOIN g USING (recipe_id)) SELECT recipe_id, skill, required, """
    + _STATE
    + " FROM j",
)
def e24(spark: SparkSession, sf: str) -> DataFrame:
    """T-05 (reagents, with unknown names) and T-06 (trained: positive only) over recipes."""
    trained = b.teaching(spark, sf).groupBy("recipe_id").agg(F.bool_or(F.col("kind") == "trainer").alias("trained"))
    names = b.items(spark, sf).filter("item_id % 6 <> 0")
    r = b.reagents(spark, sf).join(names, "item_id", "left")
    enough = F.col("quantity") >= 5
    hit = F.bool_or(F.col("name").isNotNull() & F.coalesce(F.col("name").contains("r"), F.lit(False)) & enough)
    reagent = r.groupBy("recipe_id").agg(hit.alias("hit"), F.bool_or(F.col("name").isNull() & enough).alias("maybe"))
    has = F.when(F.col("hit").isNull(), None).when(F.col("hit"), True).when(F.col("maybe"), None).otherwise(False)
    rows = b.recipes(spark, sf).join(trained, "recipe_id", "left").join(reagent, "recipe_id", "left")
    judged = search.judge(rows, [F.col("skill").isin(*[f"Brand#{i}" for i in range(1, 6)]), ts.at_most(F.col("required"), 40), ts.positive_only(F.col("trained")), has])
    return judged.select("recipe_id", "skill", "required", "state")


@query(
    "e25_recipe_detail",
    b.with_views("recipes", "teaching", "reagents", "items")
    + "SELECT r.recipe_id, r.skill, i.name AS output, (SELECT count(*) FROM reagents g WHERE g.recipe_id = r.recipe_id) AS reagents, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM teaching t WHERE t.recipe_id = r.recipe_id) AS learned_from FROM recipes r LEFT JOIN items i ON i.item_id = r.output_id",
)
def e25(spark: SparkSession, sf: str) -> DataFrame:
    output = b.items(spark, sf).select(F.col("item_id").alias("output_id"), F.col("name").alias("output"))
    parts = b.reagents(spark, sf).groupBy("recipe_id").agg(F.count("*").alias("reagents"))
    taught = b.teaching(spark, sf).groupBy("recipe_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("learned_from"))
    rows = b.recipes(spark, sf).select("recipe_id", "skill", "output_id").join(output, "output_id", "left").join(parts, "recipe_id", "left").join(taught, "recipe_id", "left")
    return rows.select("recipe_id", "skill", "output", F.coalesce("reagents", F.lit(0)).cast("long").alias("reagents"), "learned_from")
