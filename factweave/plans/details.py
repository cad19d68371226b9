"""Details of entities, quests and recipes and the inspection of zones over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import details as d
from factweave.plans.entities import COVERED, LOOT, QUEST, REASON, SETS, _endpoints
from factweave.plans.ledger import KEYS
from factweave.plans.registry import query
from factweave.plans.searches import learned
from factweave.sources import bindings as b

ENTITY_LIMIT, RECIPE_LIMIT = 40, 25
_ALL = QUEST.replace("WITH RECURSIVE ", "WITH RECURSIVE recipes AS (" + b.SQL["recipes"] + "), teaching AS (" + b.SQL["teaching"] + "), loot AS (" + b.SQL["loot"] + "), ")
_HERE = f""", here AS (SELECT zone_id, kind, id, row_number() OVER (PARTITION BY zone_id ORDER BY kind, id) AS nth FROM (SELECT DISTINCT zone_id, kind, id FROM spawns WHERE zone_id IS NOT NULL)), shown AS (SELECT * FROM here WHERE nth <= {ENTITY_LIMIT}),
  cr AS (SELECT zone_id, id AS source_id FROM shown WHERE kind = 'creature'), sold AS (SELECT * FROM loot JOIN cr USING (source_id))"""
_EV = """, ev AS (SELECT s.zone_id, s.kind, s.id, t.recipe_id, t.kind AS evidence FROM teaching t JOIN loot l ON t.kind = 'item' AND l.item_id = t.source_id JOIN shown s ON s.kind = 'creature' AND s.id = l.source_id
   UNION SELECT s.zone_id, s.kind, s.id, t.recipe_id, 'trainer' FROM teaching t JOIN shown s ON t.kind = 'trainer' AND s.kind = 'creature' AND s.id = t.source_id
   UNION SELECT s.zone_id, s.kind, s.id, t.recipe_id, 'quest_' || e.role FROM teaching t JOIN ends e ON t.kind = 'quest' AND t.source_id = e.quest_id JOIN shown s ON s.kind = e.kind AND s.id = e.id)"""
ZONE = _ALL + _HERE


def text_list(*parts: str) -> str:
    """SQL for ``details.listed`` of distinct rows."""
    one = " || '/' || ".join(f"coalesce(CAST({p} AS VARCHAR), '-')" for p in parts)
    return f"string_agg(DISTINCT {one}, ',' ORDER BY {one})"


def zone_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """``(zone_id, kind, id, recipe_id, evidence)``: which entity of a zone shows how a recipe is learned."""
    here = b.spawns(spark, sf).filter("zone_id is not null").select("zone_id", "kind", "id").distinct()
    teach, creature = b.teaching(spark, sf), F.lit("creature").alias("kind")
    of = lambda kind, column: teach.filter(F.col("kind") == kind).select(F.col("source_id").alias(column), "recipe_id")
    by_item = of("item", "item_id").join(b.loot(spark, sf).select("item_id", F.col("source_id").alias("id")).distinct(), "item_id").select(creature, "id", "recipe_id", F.lit("item").alias("evidence"))
    by_trainer = of("trainer", "id").select(creature, "id", "recipe_id", F.lit("trainer").alias("evidence"))
    by_quest = of("quest", "quest_id").join(_endpoints(spark, sf), "quest_id").select("kind", "id", "recipe_id", F.concat(F.lit("quest_"), "role").alias("evidence"))
    return by_item.unionByName(by_trainer).unionByName(by_quest).distinct().join(here, ["kind", "id"])


def inspection(spark: SparkSession, sf: str, include_recipes: bool = True) -> d.ZoneInspection:
    trainers = b.teaching(spark, sf).filter("kind = 'trainer'").select(F.col("source_id").alias("trainer_id"), "recipe_id", (F.col("source_id") % 12 != 0).alias("known"))
    evidence = zone_evidence(spark, sf) if include_recipes else None
    spawns = b.spawns(spark, sf).filter("zone_id is not null")
    return d.inspect_zones(b.zones(spark, sf), spawns, b.loot(spark, sf), _endpoints(spark, sf), trainers, evidence, entity_limit=ENTITY_LIMIT, recipe_limit=RECIPE_LIMIT)


@query("e14_zone_entities", ZONE + " SELECT zone_id, kind, id FROM shown")
def e14_entities(spark: SparkSession, sf: str) -> DataFrame:
    return inspection(spark, sf).entities


@query(
    "e14_zone_coverage",
    ZONE
    + _EV
    + f""", rs AS (SELECT zone_id, count(DISTINCT recipe_id) AS n FROM ev GROUP BY zone_id), it AS (SELECT zone_id, count(DISTINCT item_id) AS n FROM sold GROUP BY zone_id), ve AS (SELECT zone_id, count(DISTINCT source_id) AS n FROM sold WHERE family = 'vendor' GROUP BY zone_id),
  qu AS (SELECT zone_id, count(DISTINCT (e.role, e.quest_id)) AS n FROM ends e JOIN shown s ON s.kind = e.kind AND s.id = e.id GROUP BY zone_id), tr AS (SELECT zone_id, count(DISTINCT t.source_id) AS n FROM teaching t JOIN cr ON t.kind = 'trainer' AND cr.source_id = t.source_id GROUP BY zone_id),
  en AS (SELECT zone_id, count(*) AS total, count(*) FILTER (nth <= {ENTITY_LIMIT}) AS n FROM here GROUP BY zone_id)
  SELECT z.zone_id, z.zone_name, coalesce(en.total, 0) AS entities_total, coalesce(en.n, 0) AS entities, coalesce(it.n, 0) AS items, coalesce(qu.n, 0) AS quests, coalesce(ve.n, 0) AS vendors, coalesce(tr.n, 0) AS trainers, coalesce(rs.n, 0) AS recipes_shown,
   coalesce(en.total, 0) > coalesce(en.n, 0) AS entities_truncated, coalesce(rs.n, 0) > {RECIPE_LIMIT} AS recipes_truncated
  FROM zones z LEFT JOIN en USING (zone_id) LEFT JOIN it USING (zone_id) LEFT JOIN qu USING (zone_id) LEFT JOIN ve USING (zone_id) LEFT JOIN tr USING (zone_id) LEFT JOIN rs USING (zone_id)""",
)
def e14_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return inspection(spark, sf).coverage


@query("e15_zone_item_paths", ZONE + f" SELECT zone_id, item_id, {text_list('source_id', 'family', 'reference_id', 'chance', 'max_count')} AS paths FROM sold GROUP BY zone_id, item_id")
def e15_paths(spark: SparkSession, sf: str) -> DataFrame:
    return inspection(spark, sf).items.select("zone_id", "item_id", d.listed("paths", "source_id", "family", "reference_id", "chance", "max_count").alias("paths"))


@query("e16_zone_quest_buckets", ZONE + f" SELECT s.zone_id, e.role, e.quest_id, {text_list('s.kind', 's.id')} AS \"by\" FROM ends e JOIN shown s ON s.kind = e.kind AND s.id = e.id GROUP BY s.zone_id, e.role, e.quest_id")
def e16_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return inspection(spark, sf).quests.select("zone_id", "role", "quest_id", d.listed("by", "kind", "id").alias("by"))


@query("e17_zone_vendors", ZONE + f" SELECT zone_id, source_id AS vendor_id, {text_list('item_id', 'max_count')} AS items FROM sold WHERE family = 'vendor' GROUP BY zone_id, source_id")
def e17_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return inspection(spark, sf).vendors.select("zone_id", "vendor_id", d.listed("items", "item_id", "max_count").alias("items"))


@query("e17_zone_trainer_recipes", ZONE + " SELECT cr.zone_id, t.source_id AS trainer_id, CASE WHEN t.source_id % 12 <> 0 THEN 'known' ELSE 'unresolved' END AS state, string_agg(DISTINCT CAST(t.recipe_id AS VARCHAR), ',' ORDER BY CAST(t.recipe_id AS VARCHAR)) AS recipes FROM teaching t JOIN cr ON t.kind = 'trainer' AND cr.source_id = t.source_id GROUP BY ALL")
def e17_recipes(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("recipes", lambda x: x.cast("string"))), ",")
    return inspection(spark, sf).trainers.withColumn("recipes", ids)


@query("e18_zone_recipe_pages", ZONE + _EV + f", r AS (SELECT zone_id, recipe_id, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence, row_number() OVER (PARTITION BY zone_id ORDER BY recipe_id) AS nth FROM ev GROUP BY zone_id, recipe_id) SELECT zone_id, recipe_id, evidence FROM r WHERE nth <= {RECIPE_LIMIT}")
def e18_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The five kinds of evidence for each shown recipe; all others are unknown."""
    return inspection(spark, sf).recipes.withColumn("evidence", F.array_join("evidence", ","))


# -- entities --------------------------------------------------------------------------------------
_SEL = f", sel AS (SELECT subject_key, fact_key, fact_family, seq FROM selections JOIN obs USING ({KEYS}, seq)), fam AS (SELECT subject_key, fact_family, count(*) AS n, min(seq) AS only FROM sel GROUP BY ALL)"
FIELDS = {"name": ("view.1", "view"), "place": ("click.2", "click"), "level": ("signup.3", "signup")}


def provenance_sql(subjects: str) -> str:
    values = ", ".join(f"('{field}', '{key}', '{family}')" for field, (key, family) in FIELDS.items())
    return f""" SELECT w.subject_key, w.field, coalesce(s.seq, CASE WHEN f.n = 1 THEN f.only END) AS seq, CASE WHEN s.seq IS NOT NULL THEN 'exact' WHEN f.n = 1 THEN 'unique_target' WHEN f.n > 1 THEN 'ambiguous' ELSE 'none' END AS how
  FROM (SELECT * FROM {subjects}, (VALUES {values}) v(field, fact_key, fact_family)) w LEFT JOIN sel s ON s.subject_key = w.subject_key AND s.fact_key = w.fact_key LEFT JOIN fam f ON f.subject_key = w.subject_key AND f.fact_family = w.fact_family"""


def provenance(spark: SparkSession, sf: str, subjects: DataFrame) -> DataFrame:
    facts = b.selections(spark, sf).join(b.obs(spark, sf), [*b.GROUP, "seq"]).select("subject_key", "fact_key", "fact_family", "seq")
    return d.field_provenance(subjects, facts, FIELDS)


@query("e13_entity_provenance", b.with_views("entities", "obs", "selections") + _SEL + provenance_sql("(SELECT DISTINCT id AS subject_key FROM entities)"))
def e13_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The selected fact behind every field of every entity."""
    return provenance(spark, sf, b.entities(spark, sf).select(F.col("id").alias("subject_key")).distinct())


@query(
    "e13_entity_places",
    b.with_views("entities", "spawns", "loot")
    + f""", sp AS (SELECT kind, id, {text_list('zone_id', 'x', 'y')} AS spawns FROM spawns GROUP BY kind, id), l AS (SELECT source_id, count(DISTINCT item_id) FILTER (family = 'direct') AS direct, count(DISTINCT item_id) FILTER (family = 'reference') AS reference, count(DISTINCT item_id) FILTER (family = 'vendor') AS vendor FROM loot GROUP BY source_id)
  SELECT e.kind, e.id, e.name, CASE WHEN e.id % 17 = 0 THEN 'no_name' ELSE 'present' END AS presence, sp.spawns, coalesce(l.direct, 0) AS direct, coalesce(l.reference, 0) AS reference, coalesce(l.vendor, 0) AS vendor
  FROM entities e LEFT JOIN sp USING (kind, id) LEFT JOIN l ON e.kind = 'creature' AND l.source_id = e.id""",
)
def e13_places(spark: SparkSession, sf: str) -> DataFrame:
    """Presence, every spawn with its place, and counts by role."""
    spawns = b.spawns(spark, sf).groupBy("kind", "id").agg(F.collect_set(F.struct("zone_id", "x", "y")).alias("spawns"))
    count = lambda f: F.count_distinct(F.when(F.col("family") == f, F.col("item_id"))).alias(f)
    roles = b.loot(spark, sf).groupBy(F.col("source_id").alias("id")).agg(count("direct"), count("reference"), count("vendor")).withColumn("kind", F.lit("creature"))
    rows = b.entities(spark, sf).join(spawns, ["kind", "id"], "left").join(roles, ["kind", "id"], "left")
    presence = F.when(F.col("id") % 17 == 0, "no_name").otherwise("present").alias("presence")
    return rows.select("kind", "id", "name", presence, d.listed("spawns", "zone_id", "x", "y").alias("spawns"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "reference", "vendor")])


@query("e10_entity_item_paths", LOOT + f" SELECT source_id, item_id, {text_list('family', 'reference_id', 'chance', 'max_count')} AS paths FROM loot GROUP BY source_id, item_id")
def e10_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.loot(spark, sf).groupBy("source_id", "item_id").agg(F.collect_set(F.struct("family", "reference_id", "chance", "max_count")).alias("paths"))
    return rows.select("source_id", "item_id", d.listed("paths", "family", "reference_id", "chance", "max_count").alias("paths"))


# -- quests ----------------------------------------------------------------------------------------
@query(
    "e20_quest_endpoints",
    QUEST + f" SELECT e.quest_id, e.role, e.kind, e.id, {text_list('s.zone_id', 'z.map_id', 's.x', 's.y')} AS places, e.id % 7 <> 2 AS resolved, e.quest_id % 6 <> 5 AS set_complete FROM ends e LEFT JOIN spawns s ON s.kind = e.kind AND s.id = e.id LEFT JOIN zones z ON s.zone_id = z.zone_id GROUP BY ALL".replace("AS places", "FILTER (s.id IS NOT NULL) AS places"),
)
def e20_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Each endpoint with its places, whether it is resolved, and whether the quest's set of them is complete."""
    where = b.spawns(spark, sf).join(b.zones(spark, sf).select("zone_id", "map_id"), "zone_id", "left").groupBy("kind", "id").agg(F.collect_set(F.struct("zone_id", "map_id", "x", "y")).alias("places"))
    rows = _endpoints(spark, sf).join(where, ["kind", "id"], "left")
    return rows.select("quest_id", "role", "kind", "id", d.listed("places", "zone_id", "map_id", "x", "y").alias("places"), (F.col("id") % 7 != 2).alias("resolved"), (F.col("quest_id") % 6 != 5).alias("set_complete"))


@query("e20_quest_provenance", b.with_views("quests", "obs", "selections") + _SEL + provenance_sql("(SELECT quest_id AS subject_key FROM quests)"))
def e20_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return provenance(spark, sf, b.quests(spark, sf).select(F.col("quest_id").alias("subject_key")))


@query(
    "e21_member_reasons",
    b.with_views("quests", "edges")
    + """, sel AS (SELECT a, b FROM edges WHERE b % 5 <> 1), sto AS (SELECT a, b FROM edges WHERE b % 7 <> 2)
  SELECT coalesce(s.a, m.a) AS quest_id, coalesce(s.b, m.b) AS target, CASE WHEN s.a IS NOT NULL AND m.a IS NOT NULL THEN 'resolved' WHEN s.a IS NOT NULL THEN 'unresolved' ELSE 'extra' END AS state,
   CASE WHEN m.a IS NULL THEN CASE WHEN s.a % 6 = 5 THEN 'set_not_complete' ELSE 'target_not_materialised' END END AS reason FROM sel s FULL JOIN sto m ON s.a = m.a AND s.b = m.b""",
)
def e21_reasons(spark: SparkSession, sf: str) -> DataFrame:
    edges = b.edges(spark, sf).select(F.col("a").alias("quest_id"), F.col("b").alias("target"))
    reason = F.when(F.col("quest_id") % 6 == 5, "set_not_complete").otherwise("target_not_materialised")
    return d.member_states(edges.filter("target % 5 <> 1"), edges.filter("target % 7 <> 2"), ["quest_id", "target"], reason)


_BRANCH = ", br AS (SELECT DISTINCT quest_id, CASE creature_id % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'O' ELSE 'A' END AS subtype, creature_id AS target, 'creature' AS kind FROM objectives UNION ALL SELECT DISTINCT quest_id, CASE item_id % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'IR' ELSE 'Z' END, item_id, 'item' FROM objectives)"


@query(
    "e22_objective_places",
    QUEST + _BRANCH + f" SELECT b.quest_id, b.subtype, b.target, b.target % 11 <> 4 AS materialised, {text_list('s.zone_id', 's.x', 's.y')} FILTER (s.id IS NOT NULL) AS places FROM br b LEFT JOIN spawns s ON b.kind = 'creature' AND s.kind = CASE b.subtype WHEN 'O' THEN 'object' ELSE 'creature' END AND s.id = b.target GROUP BY ALL",
)
def e22_places(spark: SparkSession, sf: str) -> DataFrame:
    """Every objective with the places of its own subtype: creatures, objects, or none for items."""
    o = b.objectives(spark, sf)
    branch = lambda c, names, kind: o.select("quest_id", F.when(F.col(c) % 3 == 0, names[0]).when(F.col(c) % 3 == 1, names[1]).otherwise(names[2]).alias("subtype"), F.col(c).alias("target"), F.lit(kind).alias("of")).distinct()
    rows = branch("creature_id", ("U", "O", "A"), "creature").unionByName(branch("item_id", ("I", "IR", "Z"), "item"))
    rows = rows.withColumn("kind", F.when(F.col("of") == "creature", F.when(F.col("subtype") == "O", "object").otherwise("creature")))
    where = b.spawns(spark, sf).groupBy("kind", F.col("id").alias("target")).agg(F.collect_set(F.struct("zone_id", "x", "y")).alias("places"))
    return rows.join(where, ["kind", "target"], "left").select("quest_id", "subtype", "target", (F.col("target") % 11 != 4).alias("materialised"), d.listed("places", "zone_id", "x", "y").alias("places"))


@query(
    "e23_item_differences",
    b.with_views("quests", "objectives")
    + """, o AS (SELECT quest_id, list_sort(list(DISTINCT item_id) FILTER (item_id % 3 <> 0)) AS wanted, list_sort(list(DISTINCT item_id) FILTER (item_id % 4 <> 1)) AS required, min(item_id) FILTER (item_id % 5 = 2) AS provided FROM objectives GROUP BY quest_id)
  SELECT quest_id, provided, array_to_string(list_sort(list_filter(coalesce(wanted, []), lambda x: NOT list_contains(coalesce(required, []), x))), ',') AS only_objective, array_to_string(list_sort(list_filter(coalesce(required, []), lambda x: NOT list_contains(coalesce(wanted, []), x))), ',') AS only_required FROM o""",
)
def e23_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The item that a quest hands out, and where its objectives and its required items differ."""
    item = F.col("item_id")
    per = b.objectives(spark, sf).groupBy("quest_id").agg(F.collect_set(F.when(item % 3 != 0, item)).alias("wanted"), F.collect_set(F.when(item % 4 != 1, item)).alias("required"), F.min(F.when(item % 5 == 2, item)).alias("provided"))
    less = lambda a, c: F.array_join(F.transform(F.array_sort(F.array_except(a, c)), lambda x: x.cast("string")), ",")
    return per.select("quest_id", "provided", less("wanted", "required").alias("only_objective"), less("required", "wanted").alias("only_required"))


# -- recipes ---------------------------------------------------------------------------------------
@query(
    "e25_recipe_parts",
    b.with_views("recipes", "reagents", "items")
    + f""", g AS (SELECT recipe_id, {text_list('slot', 'item_id', 'quantity', 'known')} AS reagents, bool_and(known) AS reagents_resolved FROM (SELECT r.*, i.item_id IS NOT NULL AS known FROM reagents r LEFT JOIN (SELECT item_id FROM items WHERE item_id % 6 <> 0) i USING (item_id)) GROUP BY recipe_id)
  SELECT r.recipe_id, coalesce(r.skill, '-') || '/' || r.required AS skills, r.output_id, i.item_id IS NOT NULL AS output_resolved, g.reagents, g.reagents_resolved FROM recipes r LEFT JOIN items i ON i.item_id = r.output_id LEFT JOIN g USING (recipe_id)""",
)
def e25_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Skills, output and reagents, with what is resolved."""
    known = b.items(spark, sf).filter("item_id % 6 <> 0").select("item_id", F.lit(True).alias("known"))
    parts = b.reagents(spark, sf).join(known, "item_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    parts = parts.groupBy("recipe_id").agg(F.collect_set(F.struct("slot", "item_id", "quantity", "known")).alias("reagents"), F.bool_and("known").alias("reagents_resolved"))
    made = b.items(spark, sf).select(F.col("item_id").alias("output_id"), F.lit(True).alias("made"))
    rows = b.recipes(spark, sf).join(made, "output_id", "left").join(parts, "recipe_id", "left")
    skills = F.array(F.struct("skill", "required"))
    return rows.select("recipe_id", d.listed(skills, "skill", "required").alias("skills"), "output_id", F.coalesce("made", F.lit(False)).alias("output_resolved"), d.listed("reagents", "slot", "item_id", "quantity", "known").alias("reagents"), "reagents_resolved")


@query(
    "e25_recipe_ways",
    _ALL
    + """, place AS (SELECT s.id, s.zone_id, z.map_id FROM spawns s LEFT JOIN zones z ON s.zone_id = z.zone_id WHERE s.kind = 'creature'), ends_at AS (SELECT e.quest_id, e.role, s.zone_id, z.map_id FROM ends e JOIN spawns s USING (kind, id) LEFT JOIN zones z ON s.zone_id = z.zone_id),
  learned AS (SELECT t.recipe_id, 'item' AS kind, CAST(NULL AS VARCHAR) AS role, p.zone_id, p.map_id FROM teaching t LEFT JOIN loot l ON l.item_id = t.source_id LEFT JOIN place p ON p.id = l.source_id WHERE t.kind = 'item'
   UNION ALL SELECT t.recipe_id, 'trainer', NULL, p.zone_id, p.map_id FROM teaching t LEFT JOIN place p ON p.id = t.source_id WHERE t.kind = 'trainer'
   UNION ALL SELECT t.recipe_id, 'quest', a.role, a.zone_id, a.map_id FROM teaching t LEFT JOIN ends_at a ON a.quest_id = t.source_id WHERE t.kind = 'quest')"""
    + f" SELECT recipe_id, kind, {text_list('role', 'zone_id', 'map_id')} AS places, bool_or(zone_id IS NOT NULL) AS placed FROM learned GROUP BY recipe_id, kind",
)
def e25_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of way to learn a recipe with its places."""
    per = learned(spark, sf).groupBy("recipe_id", "kind").agg(F.collect_set(F.struct("role", "zone_id", "map_id")).alias("places"), F.bool_or(F.col("zone_id").isNotNull()).alias("placed"))
    return per.withColumn("places", d.listed("places", "role", "zone_id", "map_id"))


@query("e25_recipe_provenance", b.with_views("recipes", "obs", "selections") + _SEL + provenance_sql("(SELECT recipe_id AS subject_key FROM recipes)"))
def e25_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return provenance(spark, sf, b.recipes(spark, sf).select(F.col("recipe_id").alias("subject_key")))


@query(
    "e14_zone_states",
    b.with_views(*SETS, "zones")
    + COVERED
    + """, pairs AS (SELECT z.zone_id AS asked, e.kind, e.id, coalesce(declared, false) AS declared, coalesce(unresolved, 0) AS unresolved, coalesce(extra, 0) AS extra FROM zones z, entities e LEFT JOIN covered USING (kind, id)),
  per AS (SELECT p.asked, p.kind, p.id, p.declared, p.unresolved, p.extra, coalesce(bool_or(s.zone_id = p.asked), false) AS hit, coalesce(bool_or(s.kind IS NOT NULL AND s.zone_id IS NULL), false) AS no_zone, false AS no_map FROM pairs p LEFT JOIN spawn_keys s USING (kind, id) GROUP BY ALL),
  judged AS (SELECT asked, """
    + REASON
    + """ AS reason FROM per)
  SELECT asked AS zone_id, count(*) FILTER (reason = 'known_matching_spawn') AS known_match, count(*) FILTER (reason = 'complete_spawn_set_proves_no_match') AS known_non_match, count(*) FILTER (reason NOT IN ('known_matching_spawn', 'complete_spawn_set_proves_no_match')) AS unknown FROM judged GROUP BY asked""",
)
def e14_states(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of all entities in each zone."""
    return d.zone_states(b.zones(spark, sf), b.entities(spark, sf), b.spawn_keys(spark, sf), b.set_headers(spark, sf), b.set_members(spark, sf))
