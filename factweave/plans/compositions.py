"""Composition, reconciliation, quality and replay over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import compose as c
from factweave.operators import quality as qa
from factweave.operators import reconcile as rec
from factweave.plans.ledger import G, KEYS
from factweave.plans.registry import query
from factweave.sources import bindings as b
from factweave.sources import tables


@query("c01_overlay", b.with_views("composed") + "SELECT * FROM composed")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return c.overlay(b.base(spark, sf), b.patch(spark, sf), "id")


_WRITES = """, e AS (SELECT p_partkey AS id, f.path, f.v AS value FROM part, LATERAL (VALUES ('name', p_name), ('brand', p_brand)) f(path, v) WHERE p_partkey % 5 = 0),
  w AS (SELECT event_id % 400 AS id, CASE WHEN event_id % 2 = 0 THEN 'name' ELSE 'brand' END AS path, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END AS value FROM events),
  lw AS (SELECT id, path, arg_max(struct_pack(v := value), seq) AS w FROM w GROUP BY ALL)"""


def _paths(spark: SparkSession, sf: str):
    p = tables.table(spark, sf, "part").filter("p_partkey % 5 = 0")
    entries = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).unpivot("id", ["name", "brand"], "path", "value")
    key = F.col("event_id")
    writes = tables.table(spark, sf, "events").select((key % 400).alias("id"), F.when(key % 2 == 0, "name").otherwise("brand").alias("path"), key.alias("seq"), F.when(key % 6 != 0, F.col("event_type")).alias("value"))
    return c.overwrite_paths(entries, writes, "id", "path", "value", "seq")


@query("c02_overwrite_paths", "WITH x AS (SELECT 1)" + _WRITES + ", k AS (SELECT lw.* FROM lw SEMI JOIN e USING (id)) SELECT id, path, CASE WHEN w IS NOT NULL THEN w.v ELSE value END AS value FROM e FULL JOIN k USING (id, path) WHERE (CASE WHEN w IS NOT NULL THEN w.v ELSE value END) IS NOT NULL")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf)[0]


@query("c02_orphan_writes", "WITH x AS (SELECT 1)" + _WRITES + " SELECT id, path FROM lw ANTI JOIN e USING (id)")
def c02_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf)[1]


@query("c03_key_list_deletion", b.with_views("composed") + "SELECT composed.* FROM composed WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    gone = tables.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"))
    return c01(spark, sf).join(gone, "id", "left_anti")


@query(
    "c04_compare_views",
    b.with_views("composed")
    + """SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' WHEN l.name <> r.name OR l.price <> r.price OR l.size <> r.size THEN 'changed' ELSE 'inherited' END AS change,
  CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN concat_ws(',', CASE WHEN l.name <> r.name THEN 'name' END, CASE WHEN l.price <> r.price THEN 'price' END, CASE WHEN l.size <> r.size THEN 'size' END) END AS changed_fields FROM base l FULL JOIN composed r ON l.id = r.id""",
)
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return c.compare_views(b.base(spark, sf), c01(spark, sf), "id")


@query("c05_required_identity", b.with_views("placed") + "SELECT kind, id, name, CASE WHEN id % 17 = 0 THEN 'no_name' ELSE 'present' END AS presence FROM placed")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a localized name are reported and not effective."""
    data = b.entities(spark, sf)
    names = data.filter("id % 17 <> 0").select("kind", "id", F.lit("present").alias("presence"))
    return data.join(names, ["kind", "id"], "left").withColumn("presence", F.coalesce("presence", F.lit("no_name")))


@query(
    "c06_spawn_sets",
    b.with_views("spawns") + "SELECT zone_id, kind, id // 100 AS block, count(*) AS spawns, string_agg(printf('%s:%d:zone_percent:%d:%.6f:%.6f', kind, id, zone_id, x, y), ' ' ORDER BY printf('%s:%d:zone_percent:%d:%.6f:%.6f', kind, id, zone_id, x, y)) AS keys FROM spawns WHERE zone_id IS NOT NULL GROUP BY zone_id, kind, id // 100",
)
def c06(spark: SparkSession, sf: str) -> DataFrame:
    """A zone's set comes in blocks of ids, so that no task or row holds a whole zone."""
    rows = b.spawns(spark, sf).filter("zone_id is not null")
    key = c.spawn_key(F.col("kind"), F.col("id"), F.col("zone_id"), F.col("x"), F.col("y"))
    rows = rows.select("zone_id", "kind", F.expr("id div 100").alias("block"), key.alias("k"))
    return rows.groupBy("zone_id", "kind", "block").agg(F.count("*").alias("spawns"), F.array_join(F.array_sort(F.collect_list("k")), " ").alias("keys"))


@query(
    "c07_level_ranges",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 10 = 8 THEN p_size ELSE least(p_size, p_size % 7) END AS low, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE CASE WHEN p_partkey % 10 = 8 THEN p_size ELSE greatest(p_size, p_size % 7) END END AS high, p_partkey % 10 = 9 AS rejected FROM part",
)
def c07(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.when(key % 10 == 9, F.col("p_brand")).when(key % 10 == 8, size.cast("string")).otherwise(F.concat_ws("-", size.cast("string"), (size % 7).cast("string")))
    out = tables.table(spark, sf, "part").select(key.alias("id"), c.level_range(text).alias("r"))
    return out.select("id", "r.low", "r.high", F.col("r").isNull().alias("rejected"))


@query(
    "c08_id_lists",
    "SELECT l_orderkey AS id, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) END AS members, CASE WHEN l_orderkey % 9 <> 0 THEN count(*) - count(DISTINCT l_partkey) END AS repeats FROM lineitem GROUP BY l_orderkey",
)
def c08(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("l"))
    raw = F.when(F.col("id") % 9 != 0, F.col("l"))
    return rows.select("id", F.array_join(c.id_list(raw), ",").alias("members"), (F.size(raw) - F.size(c.id_list(raw))).cast("long").alias("repeats")).withColumn("repeats", F.when(F.col("id") % 9 != 0, F.col("repeats")))


@query("c09_signed_targets", "SELECT o_orderkey AS quest_id, CASE WHEN o_custkey % 3 = 0 THEN 'object' ELSE 'creature' END AS kind, o_custkey + 1 AS id FROM orders")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_custkey") + 1
    signed = F.when(F.col("o_custkey") % 3 == 0, -key).otherwise(key)
    return tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("quest_id"), F.inline(F.array(c.signed_target(signed))))


@query(
    "c10_slot_evidence",
    """SELECT p_partkey AS id, s.slot, s.item_id, s.count FROM part, LATERAL (VALUES (0, p_partkey % 3, CAST(p_size AS BIGINT)), (1, p_partkey % 5, CAST(p_size % 4 AS BIGINT)), (2, p_partkey % 2, CAST(0 AS BIGINT)), (3, CAST(p_size % 2 AS BIGINT), CAST(1 AS BIGINT))) s(slot, item_id, count) WHERE s.item_id > 0""",
)
def c10(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    columns = [[key % 3, size], [key % 5, size % 4], [key % 2, F.lit(0).cast("long")], [size % 2, F.lit(1).cast("long")]]
    return c.slots(tables.table(spark, sf, "part"), [key.alias("id")], columns, ["item_id", "count"])


@query("c11_flat_acquisition", b.with_views("loot") + "SELECT family, source_id, item_id, reference_id, chance, max_count FROM loot WHERE family = 'direct' UNION ALL SELECT family, source_id, item_id, reference_id, chance, max_count FROM loot WHERE family <> 'direct'")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.loot(spark, sf)
    direct = rows.filter("family = 'direct'").select("family", "source_id", "item_id", "chance")
    reference = rows.filter("family = 'reference'").select("family", "source_id", "item_id", "reference_id", "chance")
    vendor = rows.filter("family = 'vendor'").select("family", "source_id", "item_id", "max_count")
    return c.union_all([direct, reference, vendor])


@query("c12_flat_endpoints", b.with_views("quests", "objectives") + "SELECT quest_id, 'start' AS endpoint, 'object' AS target_kind, giver AS target_id FROM quests UNION ALL SELECT quest_id, 'end', 'creature', min(creature_id) FROM objectives GROUP BY quest_id")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    finisher = b.objectives(spark, sf).groupBy("quest_id").agg(F.min("creature_id").alias("finisher"))
    j = b.quests(spark, sf).join(finisher, "quest_id", "left")
    start = F.struct(F.lit("start").alias("endpoint"), F.lit("object").alias("target_kind"), F.col("giver").alias("target_id"))
    end = F.struct(F.lit("end").alias("endpoint"), F.lit("creature").alias("target_kind"), F.col("finisher").alias("target_id"))
    return j.select("quest_id", F.inline(F.array(start, end))).filter("target_id is not null")


def _replay_sql(merging: bool) -> str:
    live = "CASE WHEN r.live THEN coalesce(x.{f}, r.{f}) ELSE x.{f} END" if merging else "CASE WHEN r.live THEN r.{f} ELSE x.{f} END"
    field = lambda f: (
        f"CASE x.op WHEN 'INSERT' THEN {live.format(f=f)} WHEN 'INSERT IGNORE' THEN CASE WHEN r.live THEN r.{f} ELSE x.{f} END WHEN 'REPLACE' THEN x.{f} "
        f"WHEN 'UPDATE' THEN CASE WHEN r.live THEN CASE WHEN r.a % 2 = x.a % 2 THEN coalesce(x.{f}, r.{f}) ELSE r.{f} END END ELSE CASE WHEN r.live AND NOT (r.a % 2 = x.a % 2) THEN r.{f} END END"
    )
    error = "" if merging else "WHEN x.op = 'INSERT' AND r.live THEN 1 "
    return (
        b.with_views("log")
        + f""", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM log),
  r AS (SELECT key, CAST(0 AS BIGINT) AS k, false AS live, CAST(0 AS BIGINT) AS errors, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT DISTINCT key FROM log)
   UNION ALL SELECT r.key, x.k, CASE WHEN x.op IN ('INSERT', 'INSERT IGNORE', 'REPLACE') THEN true WHEN x.op = 'UPDATE' THEN r.live ELSE r.live AND NOT (r.a % 2 = x.a % 2) END,
    r.errors + CASE {error}WHEN x.op IN ('UPDATE', 'DELETE') AND NOT r.live THEN 1 ELSE 0 END, {field("a")}, {field("b")} FROM r JOIN n x ON x.key = r.key AND x.k = r.k + 1)
  SELECT key, live, errors, a, b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC) AS last FROM r) WHERE last = 1"""
    )


@query("c13_replay_strict", _replay_sql(False))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return c.replay(b.log(spark, sf), "key", "seq", "op", ["a", "b"], "acc.a % 2 = x.a % 2", merging=False)


@query("c14_replay_merging", _replay_sql(True))
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return c.replay(b.log(spark, sf), "key", "seq", "op", ["a", "b"], "acc.a % 2 = x.a % 2", merging=True)


@query("c13_after_truncate", b.with_views("log") + "SELECT op, count(*) AS n FROM log WHERE seq > (SELECT max(seq) FROM log WHERE a % 1000 = 500 OR seq = 7) GROUP BY op")
def c13_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return c.after_truncate(b.log(spark, sf), "seq", (F.col("a") % 1000 == 500) | (F.col("seq") == 7)).groupBy("op").agg(F.count("*").alias("n"))


@query("c15_template_expansion", b.with_views("recipes", "spawns") + "SELECT r.recipe_id, s.id AS trainer_id FROM recipes r JOIN spawns s ON s.kind = 'creature' AND s.id // 3 = r.recipe_id // 40")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    """Templates grow with the tables: ten recipes each, carried by three trainers at most."""
    rows = b.recipes(spark, sf).select("recipe_id", F.expr("recipe_id div 40").alias("template"))
    carriers = b.spawns(spark, sf).filter("kind = 'creature'").select(F.col("id").alias("trainer_id"), F.expr("id div 3").alias("template"))
    return c.expand_templates(rows, carriers, "template")[0].select("recipe_id", "trainer_id")


@query("c15_uncarried_templates", b.with_views("recipes", "spawns") + "SELECT DISTINCT recipe_id // 40 AS template FROM recipes WHERE recipe_id // 40 NOT IN (SELECT id // 3 FROM spawns WHERE kind = 'creature')")
def c15_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.recipes(spark, sf).select(F.expr("recipe_id div 40").alias("template"))
    return c.expand_templates(rows, b.spawns(spark, sf).filter("kind = 'creature'").select(F.expr("id div 3").alias("template")), "template")[1]


@query(
    "c16_reward_precedence",
    "SELECT o_orderkey AS quest_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 WHEN o_custkey % 4 > 0 THEN o_custkey % 4 END AS spell_id, CASE WHEN o_orderkey % 3 > 0 THEN 'cast' WHEN o_custkey % 4 > 0 THEN 'reward' END AS field FROM orders",
)
def c16(spark: SparkSession, sf: str) -> DataFrame:
    cast, reward = F.col("o_orderkey") % 3, F.col("o_custkey") % 4
    pick = F.when(cast > 0, F.struct(cast.alias("spell_id"), F.lit("cast").alias("field"))).when(reward > 0, F.struct(reward.alias("spell_id"), F.lit("reward").alias("field")))
    return tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("quest_id"), pick.alias("p")).select("quest_id", "p.*")


@query("c17_item_spell_slots", "SELECT p_partkey AS item_id, s.slot, s.spell_id FROM part, LATERAL (VALUES (0, p_partkey % 2), (1, p_partkey % 3), (2, p_partkey % 5), (3, p_partkey % 7), (4, p_partkey % 11)) s(slot, spell_id) WHERE s.spell_id > 0")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    return c.slots(tables.table(spark, sf, "part"), [F.col("p_partkey").alias("item_id")], [[F.col("p_partkey") % k] for k in (2, 3, 5, 7, 11)], ["spell_id"])


@query(
    "c18_proven_links",
    """WITH f AS (SELECT l_suppkey AS wrapper, l_partkey AS learned, min(l_linenumber) AS first_proof FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), s AS (SELECT l_suppkey AS wrapper, l_partkey AS learned, min(l_linenumber) AS second_proof FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
  SELECT wrapper, learned, first_proof, second_proof, CASE WHEN first_proof IS NOT NULL THEN 'first' ELSE 'second' END AS proof FROM f FULL JOIN s USING (wrapper, learned)""",
)
def c18(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("wrapper"), F.col("l_partkey").alias("learned"), "l_linenumber", "l_returnflag")
    return c.proven_links(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), ["wrapper", "learned"], "l_linenumber")


@query("c19_recipe_derivation", "SELECT DISTINCT l_partkey AS recipe_id FROM lineitem WHERE l_linenumber = 4 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_size > 5)")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe has a creating effect and a skill membership."""
    line, part = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "part")
    effect = line.filter("l_linenumber = 4").select(F.col("l_partkey").alias("recipe_id")).distinct()
    return effect.join(part.filter("p_partkey % 4 = 0 and p_size > 5").select(F.col("p_partkey").alias("recipe_id")), "recipe_id", "left_semi")


@query("c20_reagent_slots", b.with_views("reagents") + "SELECT recipe_id, slot, count(*) AS reagents, CAST(sum(quantity) AS BIGINT) AS quantity FROM reagents WHERE item_id > 0 AND slot BETWEEN 0 AND 7 GROUP BY recipe_id, slot")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.reagents(spark, sf).filter("item_id > 0 and slot between 0 and 7")
    return rows.groupBy("recipe_id", "slot").agg(F.count("*").alias("reagents"), F.sum("quantity").alias("quantity"))


@query("c21_stat_slots", b.with_views("templates") + "SELECT item_id, s.slot, s.type, s.value FROM templates, LATERAL (VALUES (0, CAST(t0 AS BIGINT), CAST(v0 AS BIGINT)), (1, CAST(t1 AS BIGINT), CAST(v1 AS BIGINT))) s(slot, type, value) WHERE s.type <> 0 OR s.value <> 0")
def c21(spark: SparkSession, sf: str) -> DataFrame:
    return b.templates(spark, sf).select("item_id", F.inline(c.non_empty_stats(F.col("stats"))))


@query("c22_hierarchy", b.with_views("zones", "maps") + "SELECT zone_id, zone_name, z.map_id, map_name, CASE z.map_id WHEN 0 THEN 'continent' WHEN 1 THEN 'continent' WHEN 2 THEN 'dungeon' WHEN 3 THEN 'raid' ELSE 'unknown:' || coalesce(CAST(z.map_id AS VARCHAR), '-') END AS kind, CASE WHEN zone_id >= 5 THEN zone_id - 5 END AS parent_id FROM zones z LEFT JOIN maps m ON z.map_id = m.map_id")
def c22(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in ((0, "continent"), (1, "continent"), (2, "dungeon"), (3, "raid")) for x in pair])
    zones = b.zones(spark, sf)
    parents = zones.select((F.col("zone_id") + 5).alias("zone_id"), F.col("zone_id").alias("parent_id"))
    label = F.coalesce(F.try_element_at(kinds, F.col("map_id")), F.concat(F.lit("unknown:"), F.coalesce(F.col("map_id").cast("string"), F.lit("-"))))
    return zones.join(b.maps(spark, sf), "map_id", "left").join(parents, "zone_id", "left").select("zone_id", "zone_name", "map_id", "map_name", label.alias("kind"), "parent_id")


@query(
    "m01_upsert_actions",
    b.with_views("composed") + "SELECT d.id, CASE WHEN b.id IS NULL THEN 'inserted' WHEN d.name = b.name AND d.price = b.price THEN 'unchanged' ELSE 'updated' END AS action FROM composed d LEFT JOIN base b USING (id)",
)
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return rec.upsert_actions(c01(spark, sf), b.base(spark, sf), ["id"], ["name", "price"]).select("id", "action")


_SYNC = """, s AS (SELECT parent, member, in_active AS want, in_base AS have, member % 13 = 0 AS custom, parent % 6 <> 5 AS header FROM members WHERE in_active OR in_base)"""


def _sync(spark: SparkSession, sf: str, partial: bool) -> DataFrame:
    rows = b.members(spark, sf)
    current = rows.filter("in_base").select("parent", "member").withColumn("managed", F.col("member") % 13 != 0)
    desired = rows.filter("in_active").select("parent", "member")
    whole = F.col("parent") % 6 != 5 if partial else None
    return rec.sync_sets(desired, current, ["parent", "member"], F.col("managed"), whole, F.col("member") % 10 == 0 if partial else None)


@query("m02_complete_set_sync", b.with_views("members") + _SYNC + " SELECT parent, member, CASE WHEN NOT have THEN 'insert' WHEN want THEN 'keep' WHEN custom THEN 'protected' ELSE 'delete' END AS action FROM s")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    return _sync(spark, sf, partial=False).select("parent", "member", "action")


@query(
    "m02_set_headers",
    b.with_views("members") + _SYNC + """ SELECT parent, count(*) FILTER (NOT (have AND NOT want AND NOT custom)) AS members, count(*) FILTER (NOT have) AS inserted, count(*) FILTER (have AND NOT want AND NOT custom) AS deleted, count(*) FILTER (have AND NOT want AND custom) AS protected FROM s GROUP BY parent""",
)
def m02_headers(spark: SparkSession, sf: str) -> DataFrame:
    return rec.set_headers(_sync(spark, sf, partial=False), ["parent"])


@query("m03_partial_evidence_sync", b.with_views("members") + _SYNC + " SELECT parent, member, CASE WHEN NOT have THEN 'insert' WHEN want THEN 'keep' WHEN custom THEN 'protected' WHEN NOT header OR member % 10 = 0 THEN 'kept_partial' ELSE 'delete' END AS action FROM s")
def m03(spark: SparkSession, sf: str) -> DataFrame:
    return _sync(spark, sf, partial=True).select("parent", "member", "action")


@query(
    "m04_relation_sync",
    b.with_views("loot")
    + """, cur AS (SELECT DISTINCT family, source_id, item_id FROM loot WHERE item_id % 3 <> 0), des AS (SELECT DISTINCT family, source_id, item_id FROM loot WHERE item_id % 4 <> 0)
  SELECT family, source_id, item_id, CASE WHEN c.k IS NULL THEN 'insert' WHEN d.k IS NOT NULL THEN 'keep' WHEN source_id % 5 = 0 THEN 'protected' ELSE 'delete' END AS action FROM (SELECT *, 1 AS k FROM cur) c FULL JOIN (SELECT *, 1 AS k FROM des) d USING (family, source_id, item_id)""",
)
def m04(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["family", "source_id", "item_id"]
    rows = b.loot_lines(spark, sf).select(*keys).distinct()
    return rec.sync_sets(rows.filter("item_id % 4 <> 0"), rows.filter("item_id % 3 <> 0"), keys, F.col("source_id") % 5 != 0).select(*keys, "action")


@query("m05_delete_if_unowned", b.with_views("patch") + "SELECT id FROM patch WHERE tombstone AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) AND id NOT IN (SELECT user_id FROM events WHERE user_id % 2 = 0)")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    used = tables.table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("id"))
    held = tables.table(spark, sf, "events").filter("user_id % 2 = 0").select(F.col("user_id").alias("id"))
    return rec.delete_if_unowned(b.patch(spark, sf).filter("tombstone").select("id"), [used, held], "id")


@query(
    "m06_unresolved",
    b.with_views("members") + "SELECT parent, member, CASE WHEN parent % 6 = 5 THEN 'no_selected_set' WHEN member % 7 = 3 THEN 'no_selected_relation' WHEN t.p_partkey IS NULL THEN 'no_target' END AS reason FROM members m LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0) t ON m.member = t.p_partkey WHERE in_active AND (parent % 6 = 5 OR member % 7 = 3 OR t.p_partkey IS NULL)",
)
def m06(spark: SparkSession, sf: str) -> DataFrame:
    targets = tables.table(spark, sf, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("member"), F.lit(True).alias("known"))
    rows = b.members(spark, sf).filter("in_active").join(targets, "member", "left")
    reasons = [("no_selected_set", F.col("parent") % 6 == 5), ("no_selected_relation", F.col("member") % 7 == 3), ("no_target", F.col("known").isNull())]
    return rec.unresolved(rows, reasons).select("parent", "member", "reason")


@query("m07_native_ids", b.with_views("teaching", "recipes") + "SELECT t.kind, t.source_id, t.recipe_id AS native_id, r.recipe_id FROM teaching t LEFT JOIN (SELECT recipe_id FROM recipes WHERE skill IS NOT NULL) r ON t.recipe_id = r.recipe_id")
def m07(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.teaching(spark, sf).withColumnRenamed("recipe_id", "native_id")
    return rec.resolve_ids(rows, "native_id", b.recipes(spark, sf).filter("skill is not null"), "recipe_id")


@query(
    "m08_relation_identities",
    b.with_views("loot") + "SELECT item_id, bool_or(family <> 'reference') AS required, CASE WHEN item_id % 19 <> 0 THEN 'created' WHEN bool_or(family <> 'reference') THEN 'error' ELSE 'reported' END AS outcome FROM loot GROUP BY item_id",
)
def m08(spark: SparkSession, sf: str) -> DataFrame:
    """Targets named by relations become items if they have a name; unnamed ones are errors only where an edge requires them."""
    targets = b.loot(spark, sf).groupBy("item_id").agg(F.bool_or(F.col("family") != "reference").alias("required"))
    named = b.items(spark, sf).filter("item_id % 19 <> 0").select("item_id", F.lit(True).alias("named"))
    outcome = F.when(F.col("named"), "created").when(F.col("required"), "error").otherwise("reported")
    return targets.join(named, "item_id", "left").select("item_id", "required", outcome.alias("outcome"))


_REC = """, cur AS (SELECT p_partkey AS id, p_name AS name, CAST(round(p_retailprice * 100) AS BIGINT) AS price, p_size AS size FROM part WHERE p_partkey % 3 <> 0),
  acts AS (SELECT coalesce(d.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'insert' WHEN d.id IS NOT NULL AND d.name = c.name AND d.price = c.price AND d.size = c.size THEN 'unchanged' WHEN c.id % 8 = 0 THEN 'protected' WHEN d.id IS NULL THEN 'delete' ELSE 'update' END AS action,
    d.name AS dn, d.price AS dp, c.name AS cn, c.price AS cp FROM composed d FULL JOIN cur c ON d.id = c.id)"""


def _reconciled(spark: SparkSession, sf: str):
    part = tables.table(spark, sf, "part").filter("p_partkey % 3 <> 0")
    current = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), F.col("p_size").alias("size"))
    return rec.reconcile(b.base(spark, sf), b.patch(spark, sf), current, "id", F.col("id") % 8 == 0)


@query("m09_reconcile_actions", b.with_views("composed") + _REC + " SELECT id, action FROM acts")
def m09(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf)[0]


@query("m09_reconcile_state", b.with_views("composed") + _REC + " SELECT id, CASE WHEN action IN ('insert', 'update') THEN dn ELSE cn END AS name, CASE WHEN action IN ('insert', 'update') THEN dp ELSE cp END AS price FROM acts WHERE action <> 'delete'")
def m09_state(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf)[1].select("id", "name", "price")


@query(
    "q04_idempotency",
    b.with_views("composed")
    + _REC
    + """, state AS (SELECT a.id, CASE WHEN a.action IN ('insert', 'update') THEN d.name ELSE c.name END AS name, CASE WHEN a.action IN ('insert', 'update') THEN d.price ELSE c.price END AS price, CASE WHEN a.action IN ('insert', 'update') THEN d.size ELSE c.size END AS size
    FROM acts a LEFT JOIN composed d ON a.id = d.id LEFT JOIN cur c ON a.id = c.id WHERE a.action <> 'delete'),
  again AS (SELECT CASE WHEN s.id IS NULL THEN 'insert' WHEN d.id IS NOT NULL AND d.name = s.name AND d.price = s.price AND d.size = s.size THEN 'unchanged' WHEN s.id % 8 = 0 THEN 'protected' WHEN d.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM composed d FULL JOIN state s ON d.id = s.id)
  SELECT pass, count(*) FILTER (changed) AS actions FROM (SELECT 'first' AS pass, action NOT IN ('unchanged', 'protected') AS changed FROM acts UNION ALL SELECT 'second', action NOT IN ('unchanged', 'protected') FROM again) GROUP BY pass""",
)
def q04(spark: SparkSession, sf: str) -> DataFrame:
    """Reconciling the reconciled state changes nothing: what either pass does."""
    actions, state = _reconciled(spark, sf)
    again = rec.reconcile(b.base(spark, sf), b.patch(spark, sf), state, "id", F.col("id") % 8 == 0)[0]
    both = actions.select(F.lit("first").alias("pass"), "action").unionByName(again.select(F.lit("second").alias("pass"), "action"))
    return both.groupBy("pass").agg(F.count_if(~F.col("action").isin("unchanged", "protected")).alias("actions"))


FACTS = [(k, d) for k in ("click", "error", "purchase", "signup", "view") for d in range(10)]


@query(
    "m10_materialise",
    b.with_views("obs", "selections")
    + f"SELECT subject_key, {', '.join(f"max(value) FILTER (fact_key = '{k}.{d}') AS {k}_{d}" for k, d in FACTS)} FROM (SELECT o.* FROM selections JOIN obs o USING ({KEYS}, seq)) GROUP BY subject_key",
)
def m10(spark: SparkSession, sf: str) -> DataFrame:
    """A column for every fact that a subject can have."""
    chosen = b.selections(spark, sf).join(b.obs(spark, sf), [*G, "seq"]).withColumn("fact", F.replace("fact_key", F.lit("."), F.lit("_")))
    return rec.pivot_facts(chosen, "subject_key", "fact", "value", [f"{k}_{d}" for k, d in FACTS])


@query(
    "q01_row_checks",
    b.with_views("placed")
    + "SELECT r.rule, count(*) FILTER (NOT r.ok) AS violations FROM placed, LATERAL (VALUES ('zone_range', zone_id BETWEEN 0 AND 20), ('x_range', x BETWEEN 0 AND 99), ('has_place', NOT spawned OR zone_id IS NOT NULL)) r(rule, ok) GROUP BY r.rule",
)
def q01(spark: SparkSession, sf: str) -> DataFrame:
    rows = b._placed(spark, sf)
    return qa.row_checks(rows, {"zone_range": F.col("zone_id").between(0, 20), "x_range": F.col("x").between(0, 99), "has_place": ~F.col("spawned") | F.col("zone_id").isNotNull()})


@query("q02_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    return qa.duplicate_keys(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q03_orphans", b.with_views("zones") + "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3) GROUP BY l_partkey")
def q03(spark: SparkSession, sf: str) -> DataFrame:
    return qa.orphans(tables.table(spark, sf, "lineitem"), "l_partkey", b.templates(spark, sf), "item_id").groupBy("l_partkey").agg(F.count("*").alias("n"))
