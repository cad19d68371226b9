"""Parameterised searches over the driver's tables: pages of many filters at once, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import tristate as ts
from factweave.operators import searches as s
from factweave.plans.entities import COVERED, QUEST, REASON, SETS, _endpoints, places, sources
from factweave.plans.registry import query
from factweave.sources import bindings as b

ALL = (ts.MATCH, ts.NON_MATCH, ts.UNKNOWN)
OPEN = (ts.MATCH, ts.UNKNOWN)


def judged_sql(rows: str, filters: list[tuple[str, str]]) -> str:
    """``judged``: ``rows`` with the conjunction of ``filters`` (label, condition), the state and the filters' states as text."""
    state = lambda x: f"CASE WHEN ({x}) IS NULL THEN 'unknown' WHEN ({x}) THEN 'known_match' ELSE 'known_non_match' END"
    ok = " AND ".join(f"({c})" for _, c in filters)
    text = " || ';' || ".join(f"'{label.replace(chr(39), chr(39) * 2)}:' || {state(c)}" for label, c in filters)
    return f", judged AS (SELECT *, {state(ok)} AS state, {text} AS predicates FROM ({rows}))"


def page_sql(columns: str, key: str, tie: str, limit: int, descending: bool, states: tuple[str, ...]) -> str:
    """The first rows in the order of a page: unknown keys last, ties by id in the key's direction."""
    down = " DESC" if descending else ""
    key = f"lower({key})" if key.endswith(("name", "title")) else key
    order = f"{key} IS NULL, {key}{down} NULLS LAST, CASE WHEN {key} IS NOT NULL THEN {tie} END{down} NULLS LAST, {tie}"
    wanted = ", ".join(f"'{x}'" for x in states)
    return f" SELECT row_number() OVER (ORDER BY {order}) AS position, {columns}, state, predicates FROM judged WHERE state IN ({wanted}) ORDER BY 1 LIMIT {limit}"


def flat(page: s.Page, *columns: str) -> DataFrame:
    return page.rows.select("position", *columns, "state", s.predicates_text(F.col("predicates")).alias("predicates"))


# -- items -----------------------------------------------------------------------------------------
_ITEMS = {
    "name_contains": "A", "min_item_level": 5, "max_item_level": 45, "min_required_level": 2, "max_required_level": 22, "min_armor": 900, "min_max_durability": 10,
    "min_fire_resistance": 0, "min_shadow_resistance": 1, "min_arcane_resistance": 1, "min_stats": {2: 5},
}
_ITEM_SQL = [
    ("name~A", "contains(lower(name), 'a')"), ("item_level>=5", "item_level >= 5"), ("item_level<=45", "item_level <= 45"), ("required_level>=2", "required_level >= 2"), ("required_level<=22", "required_level <= 22"),
    ("armor>=900", "armor >= 900"), ("max_durability>=10", "max_durability >= 10"), ("fire_resistance>=0", "fire_resistance >= 0"), ("shadow_resistance>=1", "shadow_resistance >= 1"),
    ("arcane_resistance>=1", "arcane_resistance >= 1"), ("stat_2>=5", "CASE WHEN templated THEN (t0 = 2 AND v0 >= 5) OR (t1 = 2 AND v1 >= 5) END"),
]
_ITEM_ROWS = "SELECT i.item_id AS item_id, i.name, t.* EXCLUDE (item_id), t.item_id IS NOT NULL AS templated FROM items i LEFT JOIN templates t ON i.item_id = t.item_id"


def _items(spark: SparkSession, sf: str) -> s.Page:
    facts = b.selections(spark, sf).join(b.obs(spark, sf), [*b.GROUP, "seq"]).select(F.col("subject_key").alias("item_id"), "fact_key", "value", "source_key", "policy")
    wanted = s.Wanted(OPEN, "item_level", True, 200)
    return s.query_items(b.items(spark, sf), b.templates(spark, sf), facts=facts, wanted=wanted, **_ITEMS)


@query(
    "e02_query_items",
    b.with_views("items", "templates", "obs", "selections")
    + judged_sql(_ITEM_ROWS, _ITEM_SQL)
    + ", page AS ("
    + page_sql("item_id, item_level, CASE WHEN templated THEN 'complete' ELSE 'no_template' END AS coverage", "item_level", "item_id", 200, True, OPEN)
    + """), f AS (SELECT subject_key AS item_id, string_agg(fact_key || '=' || value || '@' || source_key || '/' || policy, ',' ORDER BY fact_key, value) AS facts FROM selections JOIN obs USING (subject_kind, subject_key, fact_key, seq) GROUP BY ALL)
  SELECT page.*, f.facts FROM page LEFT JOIN f USING (item_id)""",
)
def e02(spark: SparkSession, sf: str) -> DataFrame:
    page = _items(spark, sf)
    one = lambda x: F.concat(x["fact_key"], F.lit("="), x["value"].cast("string"), F.lit("@"), x["source_key"].cast("string"), F.lit("/"), x["policy"])
    text = F.array_join(F.transform("facts", one), ",")
    return page.rows.select("position", "item_id", "item_level", "coverage", "state", s.predicates_text(F.col("predicates")).alias("predicates"), text.alias("facts"))


@query("e02_query_items_summary", b.with_views("items", "templates") + judged_sql(_ITEM_ROWS, _ITEM_SQL) + " SELECT state, count(*) AS n FROM judged GROUP BY state")
def e02_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over all items, whatever the page shows."""
    return _items(spark, sf).summary


@query(
    "e02_query_items_by_class",
    b.with_views("items", "templates")
    + judged_sql(_ITEM_ROWS, [("quality=3", "quality = 3"), ("class_id=4", "class_id = 4"), ("subclass_id=1", "subclass_id = 1"), ("inventory_type=12", "inventory_type = 12"), ("holy_resistance>=0", "holy_resistance >= 0"), ("nature_resistance>=0", "nature_resistance >= 0"), ("frost_resistance>=1", "frost_resistance >= 1")])
    + page_sql("item_id, name", "name", "item_id", 1000, False, ALL),
)
def e02_by_class(spark: SparkSession, sf: str) -> DataFrame:
    wanted = s.Wanted(ALL, "name", False, 1000)
    page = s.query_items(b.items(spark, sf), b.templates(spark, sf), wanted=wanted, quality=3, class_id=4, subclass_id=1, inventory_type=12, min_holy_resistance=0, min_nature_resistance=0, min_frost_resistance=1)
    return flat(page, "item_id", "name")


@query("e03_query_item_templates", b.with_views("templates") + "SELECT item_id, required_level, item_level FROM templates WHERE required_level <= 20 AND inventory_type = 7 AND ((t0 = 0 AND v0 >= 3) OR (t1 = 0 AND v1 >= 3)) ORDER BY required_level, item_level, item_id LIMIT 50")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return s.query_item_templates(b.templates(spark, sf), max_required_level=20, inventory_type=7, min_stats={0: 3}, limit=50).select("item_id", "required_level", "item_level")


# -- zones -----------------------------------------------------------------------------------------
@query(
    "e01_query_zones",
    b.with_views("zones", "maps")
    + judged_sql("SELECT zone_id, zone_name, z.map_id, CASE WHEN m.map_id IS NOT NULL THEN z.map_id END AS known_map, map_name FROM zones z LEFT JOIN maps m ON z.map_id = m.map_id", [("name~1", "contains(lower(zone_name), '1')"), ("map_id=1", "known_map = 1"), ("map_name~a", "contains(lower(map_name), 'a')")])
    + page_sql("zone_id, zone_name, map_name", "zone_name", "zone_id", 20, True, ALL),
)
def e01(spark: SparkSession, sf: str) -> DataFrame:
    wanted = s.Wanted(ALL, "zone_name", True, 20)
    return flat(s.query_zones(b.zones(spark, sf), b.maps(spark, sf), name_contains="1", map_id=1, map_name_contains="a", wanted=wanted), "zone_id", "zone_name", "map_name")


# -- acquisitions ----------------------------------------------------------------------------------
_HIT = ", hits AS (SELECT l.item_id, count(DISTINCT (l.source_id, p.zone_id, p.map_id)) AS matching FROM loot l JOIN places p USING (source_id) WHERE p.zone_id = 3 AND p.map_id = 3 AND l.family IN ('direct', 'reference') AND l.chance >= 2.5 GROUP BY l.item_id)"
_PLACES = ", places AS (SELECT s.id AS source_id, s.zone_id, z.map_id FROM spawns s LEFT JOIN zones z ON s.zone_id = z.zone_id WHERE s.kind = 'creature')"


@query(
    "e06_query_item_acquisitions",
    b.with_views("items", "templates", "loot", "spawns", "zones")
    + _PLACES
    + _HIT
    + judged_sql(_ITEM_ROWS.replace("AS templated FROM", "AS templated, h.matching FROM") + " LEFT JOIN hits h ON h.item_id = i.item_id", [("name~e", "contains(lower(name), 'e')"), ("quality=2", "quality = 2"), ("item_level>=1", "item_level >= 1"), ("required_level<=25", "required_level <= 25"), ("acquisition", "CASE WHEN matching IS NOT NULL THEN true END")])
    + page_sql("item_id, coalesce(matching, 0) AS matching", "item_id", "item_id", 500, False, OPEN),
)
def e06_query(spark: SparkSession, sf: str) -> DataFrame:
    """Eight filters: name, fields, kinds of path and source, chance, zone and map on one source."""
    known = sources(spark, sf).withColumn("source_kind", F.lit("creature"))
    wanted = s.Wanted(OPEN, "item_id", False, 500)
    page = s.query_item_acquisitions(
        b.items(spark, sf), b.templates(spark, sf), known, path_kinds=["direct", "reference"], source_kinds=["creature"], min_drop_chance=2.5, zone_id=3, map_id=3, wanted=wanted,
        name_contains="e", quality=2, min_item_level=1, max_required_level=25,
    )
    rows = page.rows.withColumn("matching", F.coalesce(F.size("matching"), F.lit(0)).cast("long"))
    return flat(s.Page(page.summary, rows), "item_id", "matching")


# -- world entities --------------------------------------------------------------------------------
@query(
    "e08_query_world_entities",
    b.with_views(*SETS, "zones")
    + COVERED
    + """, per AS (SELECT kind, id, bool_or(coalesce(s.zone_id = 4 AND z.map_id = 4, false)) AS hit, bool_or(s.zone_id IS NULL) AS no_zone, bool_or(z.map_id IS NULL) AS no_map FROM spawn_keys s LEFT JOIN zones z USING (zone_id) GROUP BY kind, id),
  geo AS (SELECT kind, id, """
    + REASON
    + " AS reason FROM covered LEFT JOIN per USING (kind, id))"
    + judged_sql(
        "SELECT e.kind AS entity_kind, e.id AS entity_id, e.name, reason FROM entities e LEFT JOIN geo USING (kind, id)",
        [("entity_kind=object", "entity_kind = 'object'"), ("name~#0000", "contains(lower(name), '#0000')"), ("zone_id=4,map_id=4", "CASE reason WHEN 'known_matching_spawn' THEN true WHEN 'complete_spawn_set_proves_no_match' THEN false END")],
    )
    + page_sql("entity_kind, entity_id", "name", "(entity_id, entity_kind)", 700, True, ALL),
)
def e08_query(spark: SparkSession, sf: str) -> DataFrame:
    wanted = s.Wanted(ALL, "name", True, 700)
    page = s.query_world_entities(b.entities(spark, sf), b.spawn_keys(spark, sf), b.set_headers(spark, sf), b.set_members(spark, sf), b.zones(spark, sf), entity_kind="object", name_contains="#0000", zone_id=4, map_id=4, wanted=wanted)
    return flat(page, "entity_kind", "entity_id")


# -- quests ----------------------------------------------------------------------------------------
_ENDS_AT = """, ends_at AS (SELECT e.quest_id, e.role, s.zone_id, z.map_id FROM ends e JOIN spawns s USING (kind, id) LEFT JOIN zones z ON s.zone_id = z.zone_id),
  per AS (SELECT quest_id, bool_or(role = 'given' AND zone_id = 3 AND map_id = 3) AS g, bool_or(role = 'finished' AND map_id = 1) AS f, bool_or(role = 'objective' AND zone_id = 2 AND map_id = 2) AS o FROM ends_at GROUP BY quest_id)"""
_SHOWN = "CASE WHEN {0} THEN true END"


def ends_at(spark: SparkSession, sf: str) -> DataFrame:
    where = b.spawns(spark, sf).select("kind", "id", "zone_id").join(b.zones(spark, sf).select("zone_id", "map_id"), "zone_id", "left")
    return _endpoints(spark, sf).join(where, ["kind", "id"]).select("quest_id", "role", "zone_id", "map_id")


@query(
    "e19_query_quests",
    QUEST
    + _ENDS_AT
    + judged_sql(
        "SELECT q.*, g, f, o FROM quests q LEFT JOIN per USING (quest_id)",
        [
            ("title~ed", "contains(lower(title), 'ed')"), ("level>=2", "level >= 2"), ("level<=40", "level <= 40"), ("minimum_level>=1", "minimum_level >= 1"), ("minimum_level<=20", "minimum_level <= 20"),
            ("giver_zone=3,giver_map=3", _SHOWN.format("g")), ("finisher_map=1", _SHOWN.format("f")), ("objective_zone=2,objective_map=2", _SHOWN.format("o")),
        ],
    )
    + page_sql("quest_id, title, level", "level", "quest_id", 300, True, OPEN),
)
def e19_query(spark: SparkSession, sf: str) -> DataFrame:
    wanted = s.Wanted(OPEN, "level", True, 300)
    page = s.query_quests(
        b.quests(spark, sf), ends_at(spark, sf), title_contains="ed", min_level=2, max_level=40, min_minimum_level=1, max_minimum_level=20, giver_zone_id=3, giver_map_id=3, finisher_map_id=1, objective_zone_id=2, objective_map_id=2, wanted=wanted
    )
    return flat(page, "quest_id", "title", "level")


# -- recipes ---------------------------------------------------------------------------------------
_LEARNED = """, ends_at AS (SELECT e.quest_id, e.role, s.zone_id, z.map_id FROM ends e JOIN spawns s USING (kind, id) LEFT JOIN zones z ON s.zone_id = z.zone_id), place AS (SELECT s.id, s.zone_id, z.map_id FROM spawns s LEFT JOIN zones z ON s.zone_id = z.zone_id WHERE s.kind = 'creature'),
  learned AS (SELECT t.recipe_id, 'item' AS kind, CAST(NULL AS VARCHAR) AS role, p.zone_id, p.map_id FROM teaching t LEFT JOIN loot l ON l.item_id = t.source_id LEFT JOIN place p ON p.id = l.source_id WHERE t.kind = 'item'
   UNION ALL SELECT t.recipe_id, 'trainer', NULL, p.zone_id, p.map_id FROM teaching t LEFT JOIN place p ON p.id = t.source_id WHERE t.kind = 'trainer'
   UNION ALL SELECT t.recipe_id, 'quest', a.role, a.zone_id, a.map_id FROM teaching t LEFT JOIN ends_at a ON a.quest_id = t.source_id WHERE t.kind = 'quest'),
  sk AS (SELECT recipe_id, bool_or(coalesce(contains(lower(skill), 'brand#3') AND required >= 3 AND required <= 45, false)) AS hit, bool_or((contains(lower(skill), 'brand#3') AND required >= 3 AND required <= 45) IS NULL) AS maybe FROM recipes GROUP BY recipe_id),
  rg AS (SELECT recipe_id, bool_or(item_id = 40) AS reagent FROM reagents GROUP BY recipe_id),
  ln AS (SELECT recipe_id, bool_or(kind IN ('trainer', 'quest')) AS l0, bool_or(coalesce(kind = 'item' AND zone_id = 3, false)) AS l1, bool_or(coalesce(kind = 'trainer' AND map_id = 3, false)) AS l2, bool_or(coalesce(kind = 'quest' AND zone_id = 1 AND map_id = 1 AND role = 'given', false)) AS l3,
   bool_or(coalesce(kind = 'quest' AND map_id = 2 AND role = 'finished', false)) AS l4, bool_or(coalesce(kind = 'quest' AND zone_id = 4 AND role = 'objective', false)) AS l5 FROM learned GROUP BY recipe_id)"""


def learned(spark: SparkSession, sf: str) -> DataFrame:
    """``(recipe_id, kind, role, zone_id, map_id)``: every way to learn a recipe, with its places or none."""
    teach = b.teaching(spark, sf)
    of = lambda kind, column: teach.filter(F.col("kind") == kind).select("recipe_id", "kind", F.col("source_id").alias(column))
    none = F.lit(None).cast("string").alias("role")
    where = places(spark, sf)
    sold_at = b.loot(spark, sf).select("item_id", "source_id").distinct().join(where, "source_id", "left").select("item_id", "zone_id", "map_id").distinct()  # a common item has many sources, but few places; sources without one share a row without
    by_item = of("item", "item_id").join(sold_at, "item_id", "left").select("recipe_id", "kind", none, "zone_id", "map_id")
    by_trainer = of("trainer", "source_id").join(where, "source_id", "left").select("recipe_id", "kind", none, "zone_id", "map_id")
    by_quest = of("quest", "quest_id").join(ends_at(spark, sf), "quest_id", "left").select("recipe_id", "kind", "role", "zone_id", "map_id")
    return by_item.unionByName(by_trainer).unionByName(by_quest)


def _recipes(spark: SparkSession, sf: str, wanted: s.Wanted, **filters) -> s.Page:
    rows = b.recipes(spark, sf)
    outputs = rows.select("recipe_id", F.col("output_id").alias("item_id"))
    return s.query_recipes(rows.select("recipe_id", "name"), rows.select("recipe_id", "skill", "required"), outputs, b.reagents(spark, sf), learned(spark, sf), wanted=wanted, **filters)


@query(
    "e24_query_recipes",
    QUEST.replace("WITH RECURSIVE ", "WITH RECURSIVE recipes AS (" + b.SQL["recipes"] + "), teaching AS (" + b.SQL["teaching"] + "), loot AS (" + b.SQL["loot"] + "), reagents AS (" + b.SQL["reagents"] + "), ")
    + _LEARNED
    + judged_sql(
        "SELECT r.recipe_id, r.name, r.output_id, hit, maybe, reagent, l0, l1, l2, l3, l4, l5 FROM recipes r LEFT JOIN sk USING (recipe_id) LEFT JOIN rg USING (recipe_id) LEFT JOIN ln USING (recipe_id)",
        [
            ("name~a", "contains(lower(name), 'a')"), ("skill~brand#3,required>=3,required<=45", "CASE WHEN hit THEN true WHEN NOT maybe THEN false END"), ("reagent=40", "coalesce(reagent, false)"), ("learned_by=trainer|quest", _SHOWN.format("l0")),
            ("teaching_zone=3", _SHOWN.format("l1")), ("trainer_map=3", _SHOWN.format("l2")), ("quest_giver_zone=1,quest_giver_map=1", _SHOWN.format("l3")), ("quest_finisher_map=2", _SHOWN.format("l4")), ("quest_objective_zone=4", _SHOWN.format("l5")),
        ],
    )
    + page_sql("recipe_id, name", "name", "recipe_id", 1000, False, ALL),
)
def e24_query(spark: SparkSession, sf: str) -> DataFrame:
    page = _recipes(
        spark, sf, s.Wanted(ALL, "name", False, 1000), name_contains="a", skill="brand#3", min_required=3, max_required=45, reagent_item_id=40, learning_kinds=["quest", "trainer"], teaching_zone_id=3, trainer_map_id=3,
        quest_giver_zone_id=1, quest_giver_map_id=1, quest_finisher_map_id=2, quest_objective_zone_id=4,
    )
    return flat(page, "recipe_id", "name")
