"""How the operators' inputs are drawn from the driver's tables: a DataFrame and the same text in SQL for each view.

Integer arithmetic on keys leaves gaps on purpose, so that unknown, unresolved, protected and
repeated cases occur at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.tables import table

#: Named WITH items; ``with_views("items", "obs")`` joins them.
SQL: dict[str, str] = {}


def with_views(*names: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed) + "\n"


NEEDS: dict[str, tuple[str, ...]] = {}

# -- items ---------------------------------------------------------------------------------------
SQL["items"] = "SELECT p_partkey AS item_id, p_name AS name FROM part"
RESISTANCES = ("holy", "fire", "nature", "frost", "shadow", "arcane")
SQL["templates"] = f"""SELECT p_partkey AS item_id, p_size % 6 AS quality, p_size AS item_level, p_size // 2 AS required_level,
  p_type AS class, CAST(floor(p_retailprice) AS BIGINT) AS armor, p_partkey % 7 AS t0, p_size AS v0, p_size % 5 AS t1, p_partkey % 11 AS v1,
  p_partkey % 16 AS class_id, p_size % 8 AS subclass_id, p_partkey % 28 AS inventory_type, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 2 END AS max_durability,
  {", ".join(f"(p_partkey // {k + 2}) % {k + 3} AS {r}_resistance" for k, r in enumerate(RESISTANCES))}
  FROM part WHERE p_partkey % 10 <> 3"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))


def templates(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of most items; a missing row means unknown."""
    stat = lambda slot, kind, value: F.struct(F.lit(slot).alias("slot"), kind.cast("long").alias("type"), value.cast("long").alias("value"))
    size, key = F.col("p_size"), F.col("p_partkey")
    return (
        table(spark, sf, "part")
        .filter(key % 10 != 3)
        .select(
            key.alias("item_id"),
            (size % 6).alias("quality"),
            size.alias("item_level"),
            F.expr("p_size div 2").cast("int").alias("required_level"),
            F.col("p_type").alias("class"),
            F.floor("p_retailprice").cast("long").alias("armor"),
            F.array(stat(0, key % 7, size), stat(1, size % 5, key % 11)).alias("stats"),
            (key % 16).alias("class_id"),
            (size % 8).alias("subclass_id"),
            (key % 28).alias("inventory_type"),
            F.when(key % 4 != 0, size * 2).alias("max_durability"),
            *[F.expr(f"(p_partkey div {k + 2}) % {k + 3}").alias(f"{r}_resistance") for k, r in enumerate(RESISTANCES)],
        )
    )


# -- geography -----------------------------------------------------------------------------------
SQL["maps"] = "SELECT r_regionkey AS map_id, r_name AS map_name FROM region"
SQL["zones"] = "SELECT n_nationkey AS zone_id, n_name AS zone_name, CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE n_regionkey END AS map_id FROM nation"
_SPAWN = """SELECT '{kind}' AS kind, {k} AS id, {n} AS name, {k} % 13 <> 5 AS spawned, CASE WHEN {k} % 9 = 8 THEN NULL ELSE {z} END AS zone_id,
  abs(CAST(round({b} * 100) AS BIGINT)) % 10000 / 100.0 AS x, CAST({k} % 100 AS DOUBLE) AS y FROM {t}"""
SQL["placed"] = "\nUNION ALL ".join(
    (
        _SPAWN.format(kind="creature", k="s_suppkey", n="s_name", z="s_nationkey", b="s_acctbal", t="supplier"),
        _SPAWN.format(kind="object", k="c_custkey", n="c_name", z="c_nationkey", b="c_acctbal", t="customer"),
    )
)
SQL["entities"] = "SELECT kind, id, name FROM placed"
SQL["spawns"] = "SELECT kind, id, zone_id, CAST(x AS DOUBLE) AS x, y FROM placed WHERE spawned"
# stored spawns by key, and the selected sets: none for some entities, others with a member too many, another member instead, or one twice
SQL["spawn_keys"] = "SELECT kind, id, zone_id, concat_ws(':', id, CAST(x * 100 AS BIGINT), CAST(y AS BIGINT)) AS spawn_key FROM spawns"
SQL["set_headers"] = "SELECT kind, id FROM entities WHERE id % 6 <> 1"
SQL["set_members"] = """SELECT kind, id, spawn_key FROM spawn_keys WHERE id % 6 NOT IN (1, 3) UNION ALL SELECT kind, id, spawn_key FROM spawn_keys WHERE id % 6 = 4
  UNION ALL SELECT kind, id, 'other' FROM spawn_keys WHERE id % 6 IN (2, 3)"""
NEEDS |= {"entities": ("placed",), "spawns": ("placed",), "spawn_keys": ("spawns",), "set_headers": ("entities",), "set_members": ("spawn_keys",)}


def maps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("map_id"), F.col("r_name").alias("map_name"))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    region = F.when(F.col("n_nationkey") % 7 != 6, F.col("n_regionkey"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone_name"), region.alias("map_id"))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    def one(kind: str, name: str, p: str) -> DataFrame:
        key = F.col(f"{p}_{'suppkey' if p == 's' else 'custkey'}")
        cents = F.abs(F.round(F.col(f"{p}_acctbal") * 100).cast("long"))
        return table(spark, sf, name).select(
            F.lit(kind).alias("kind"),
            key.alias("id"),
            F.col(f"{p}_name").alias("name"),
            (key % 13 != 5).alias("spawned"),
            F.when(key % 9 != 8, F.col(f"{p}_nationkey")).alias("zone_id"),
            (cents % 10000 / 100.0).alias("x"),
            (key % 100).cast("double").alias("y"),
        )

    return one("creature", "supplier", "s").unionByName(one("object", "customer", "c"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf).select("kind", "id", "name")


def spawns(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf).filter("spawned").select("kind", "id", "zone_id", "x", "y")


def spawn_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws(":", F.col("id").cast("string"), F.round(F.col("x") * 100).cast("long").cast("string"), F.col("y").cast("long").cast("string"))
    return spawns(spark, sf).select("kind", "id", "zone_id", key.alias("spawn_key"))


def set_headers(spark: SparkSession, sf: str) -> DataFrame:
    return entities(spark, sf).filter("id % 6 <> 1").select("kind", "id")


def set_members(spark: SparkSession, sf: str) -> DataFrame:
    """Selected members of spawn sets: most as stored; some sets have one more, another one instead, or one twice."""
    keys = spawn_keys(spark, sf).select("kind", "id", "spawn_key")
    own = F.filter(F.array(F.when(~(F.col("id") % 6).isin(1, 3), F.col("spawn_key")), F.when(F.col("id") % 6 == 4, F.col("spawn_key")), F.when((F.col("id") % 6).isin(2, 3), F.lit("other"))), lambda k: k.isNotNull())
    return keys.select("kind", "id", F.explode(own).alias("spawn_key"))


# -- acquisition edges ---------------------------------------------------------------------------
SQL["loot"] = """SELECT l_suppkey AS source_id, l_partkey AS item_id, CASE l_returnflag WHEN 'R' THEN 'direct' WHEN 'A' THEN 'reference' ELSE 'vendor' END AS family,
  CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS reference_id,
  CASE l_returnflag WHEN 'R' THEN CAST(round(max(l_discount) * 100) AS BIGINT) WHEN 'A' THEN CAST(round(max(l_tax) * 100) AS BIGINT) END AS chance,
  CASE WHEN l_returnflag = 'N' THEN CAST(max(l_quantity) AS BIGINT) END AS max_count
  FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag, CASE WHEN l_returnflag = 'A' THEN l_linenumber END"""


def loot_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Source, item and family of every loot edge, with repeats, for those who fold them anyway."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("item_id"), _family(F.col("l_returnflag")).alias("family"))


def _family(flag: Column) -> Column:
    return F.when(flag == "R", "direct").when(flag == "A", "reference").otherwise("vendor")


def loot(spark: SparkSession, sf: str) -> DataFrame:
    """Item edges of three families: direct and reference with a chance in percent, vendor with a count."""
    flag = F.col("l_returnflag")
    family = _family(flag)
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("item_id"), family.alias("family"), F.when(flag == "A", F.col("l_linenumber")).alias("reference_id"), "l_discount", "l_tax", "l_quantity"
    )
    percent = lambda c: F.round(F.max(c) * 100).cast("long")
    rows = rows.groupBy("source_id", "item_id", "family", "reference_id").agg(percent("l_discount").alias("_d"), percent("l_tax").alias("_t"), F.max("l_quantity").cast("long").alias("_q"))
    chance = F.when(F.col("family") == "direct", F.col("_d")).when(F.col("family") == "reference", F.col("_t"))
    return rows.select("source_id", "item_id", "family", "reference_id", chance.alias("chance"), F.when(F.col("family") == "vendor", F.col("_q")).alias("max_count"))


# -- observations --------------------------------------------------------------------------------
SQL["obs"] = """SELECT event_id AS seq, 'user' AS subject_kind, user_id AS subject_key, event_type || '.' || CAST(day(ts) % 10 AS VARCHAR) AS fact_key,
  event_type AS fact_family, event_id % 3 AS source_key, CAST(CAST(ts AS DATE) AS VARCHAR) AS revision, event_id % 2 AS raw_id, CAST(floor(value / 50) AS BIGINT) AS value FROM events"""
SQL["groups"] = "SELECT subject_kind, subject_key, fact_key, max(seq) AS last_seq FROM obs GROUP BY ALL"
SQL["selections"] = """SELECT subject_kind, subject_key, fact_key, last_seq AS seq, CASE WHEN subject_key % 5 = 0 THEN 'custom' ELSE 'managed' END AS policy
  FROM groups WHERE subject_key % 4 <> 0"""
NEEDS |= {"groups": ("obs",), "selections": ("groups",)}
GROUP = ("subject_kind", "subject_key", "fact_key")
IDENTITY = (*GROUP, "source_key", "revision", "raw_id", "value")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Statements about users: one fact per event type and last digit of the day."""
    return obs_of(table(spark, sf, "events"))


def obs_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        F.lit("user").alias("subject_kind"),
        F.col("user_id").alias("subject_key"),
        F.concat("event_type", F.lit("."), (F.dayofmonth("ts") % 10).cast("string")).alias("fact_key"),
        F.col("event_type").alias("fact_family"),
        (F.col("event_id") % 3).alias("source_key"),
        F.to_date("ts").cast("string").alias("revision"),
        (F.col("event_id") % 2).alias("raw_id"),
        F.floor(F.col("value") / 50).cast("long").alias("value"),
    )


def selections(spark: SparkSession, sf: str) -> DataFrame:
    last = obs(spark, sf).groupBy(*GROUP).agg(F.max("seq").alias("seq"))
    return last.filter("subject_key % 4 <> 0").withColumn("policy", F.when(F.col("subject_key") % 5 == 0, "custom").otherwise("managed"))


# -- ranked evidence -----------------------------------------------------------------------------
SQL["evid"] = """SELECT DISTINCT l_suppkey AS subject_key, l_returnflag AS family, l_partkey AS item_id, l_linenumber AS slot,
  l_orderkey % 4 AS source_key, CAST(floor(l_quantity / 10) AS BIGINT) AS value FROM lineitem"""


def evid(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of four ranked sources (3 best); source 2 states complete sets, source 3 only what it has seen."""
    return (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_suppkey").alias("subject_key"),
            F.col("l_returnflag").alias("family"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_linenumber").alias("slot"),
            (F.col("l_orderkey") % 4).alias("source_key"),
            F.floor(F.col("l_quantity") / 10).cast("long").alias("value"),
        )
        .distinct()
    )


# -- base and overlay ----------------------------------------------------------------------------
SQL["base"] = "SELECT p_partkey AS id, p_name AS name, CAST(round(p_retailprice * 100) AS BIGINT) AS price, p_size AS size FROM part WHERE p_partkey % 7 <> 0"
SQL["patch"] = """SELECT p_partkey AS id, p_partkey % 11 = 0 AS tombstone, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS name,
  CAST(round(p_retailprice * 100) AS BIGINT) + CASE WHEN p_partkey % 2 = 0 THEN 500 ELSE 0 END AS price, p_size AS size FROM part WHERE p_partkey % 5 = 0"""
SQL["composed"] = """SELECT coalesce(b.id, p.id) AS id, CASE WHEN p.id IS NULL THEN b.name ELSE p.name END AS name,
  CASE WHEN p.id IS NULL THEN b.price ELSE p.price END AS price, CASE WHEN p.id IS NULL THEN b.size ELSE p.size END AS size
  FROM base b FULL JOIN patch p ON b.id = p.id WHERE NOT coalesce(p.tombstone, false)"""
NEEDS |= {"composed": ("base", "patch")}


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"), F.col("p_size").alias("size"))


def base(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).filter("id % 7 <> 0")


def patch(spark: SparkSession, sf: str) -> DataFrame:
    p = _priced(spark, sf).filter("id % 5 = 0").withColumn("tombstone", F.col("id") % 11 == 0)
    return p.withColumn("name", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name"))).withColumn("price", F.col("price") + F.when(F.col("id") % 2 == 0, 500).otherwise(0))


# -- set versions --------------------------------------------------------------------------------
SQL["members"] = """SELECT l_suppkey AS parent, l_partkey AS member, l_suppkey % 13 <> 6 AND bool_or(l_orderkey % 5 IN (0, 1)) AS in_base,
  l_suppkey % 10 <> 7 AND CASE WHEN l_suppkey % 4 = 1 THEN l_suppkey % 13 <> 6 AND bool_or(l_orderkey % 5 IN (0, 1)) WHEN l_suppkey % 7 = 3 THEN bool_or(l_orderkey % 5 IN (0, 1, 2)) ELSE bool_or(l_orderkey % 5 IN (1, 2)) END AS in_active,
  l_suppkey % 9 <> 4 AND bool_or(l_orderkey % 5 IN (1, 3)) AS in_comparison, min(l_linestatus) AS context, min(l_quantity) AS x, CAST(round(min(l_tax) * 100) AS DOUBLE) * 10 AS y
  FROM lineitem GROUP BY l_suppkey, l_partkey"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each parent with the versions that hold them, and a place for each.

    Some parents are in two versions only, are unchanged, or only grow; a member may be in none.
    """
    kind, parent = F.col("l_orderkey") % 5, F.col("parent")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("member"))
    held = lambda *kinds: F.bool_or(kind.isin(*kinds))
    rows = rows.agg(
        held(0, 1).alias("_base"), held(0, 1, 2).alias("_grown"), held(1, 2).alias("_other"), held(1, 3).alias("_comparison"),
        F.min("l_linestatus").alias("context"), F.min("l_quantity").alias("x"), (F.round(F.min("l_tax") * 100).cast("double") * 10).alias("y"),
    )
    base = (parent % 13 != 6) & F.col("_base")
    active = F.when(parent % 4 == 1, base).when(parent % 7 == 3, F.col("_grown")).otherwise(F.col("_other"))
    return rows.select("parent", "member", base.alias("in_base"), ((parent % 10 != 7) & active).alias("in_active"), ((parent % 9 != 4) & F.col("_comparison")).alias("in_comparison"), "context", "x", "y")


# -- quests and their graph ----------------------------------------------------------------------
SQL["quests"] = """SELECT o_orderkey AS quest_id, o_orderpriority AS title, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE CAST(floor(o_totalprice / 10000) AS INTEGER) END AS level,
  CASE WHEN o_orderkey % 9 <> 4 THEN CAST(floor(o_totalprice / 20000) AS INTEGER) END AS minimum_level, o_custkey AS giver FROM orders"""
SQL["objectives"] = "SELECT DISTINCT l_orderkey AS quest_id, l_partkey AS item_id, l_suppkey AS creature_id FROM lineitem"
SQL["edges"] = """SELECT DISTINCT a, b FROM (
  SELECT o_orderkey AS a, lag(o_orderkey) OVER w AS b, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN lag(o_orderkey, 2) OVER w END, o_custkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  UNION ALL SELECT first_value(o_orderkey) OVER w, CASE WHEN o_custkey % 10 = 0 THEN last_value(o_orderkey) OVER w END, o_custkey FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE b IS NOT NULL"""


def quests(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("o_orderkey") % 8 != 7, F.floor(F.col("o_totalprice") / 10000).cast("int"))
    least = F.when(F.col("o_orderkey") % 9 != 4, F.floor(F.col("o_totalprice") / 20000).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("quest_id"), F.col("o_orderpriority").alias("title"), level.alias("level"), least.alias("minimum_level"), F.col("o_custkey").alias("giver"))


def objective_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Objectives with repeats, for those who fold them anyway."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("quest_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("creature_id"))


def objectives(spark: SparkSession, sf: str) -> DataFrame:
    return objective_lines(spark, sf).distinct()


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """quest a needs quest b: the customer's order before, for some the one before that, and a cycle for some customers."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key = F.col("o_orderkey")
    first, last = F.first(key).over(whole), F.when(F.col("o_custkey") % 10 == 0, F.last(key).over(whole))
    o = o.select(key.alias("k"), F.lag(key).over(w).alias("before"), F.when(key % 4 == 0, F.lag(key, 2).over(w)).alias("branch"), first.alias("first"), last.alias("last"))
    pair = lambda a, z: F.struct(F.col(a).alias("a"), F.col(z).alias("b"))
    return o.select(F.inline(F.array(pair("k", "before"), pair("k", "branch"), pair("first", "last")))).filter("b is not null").distinct()


# -- recipes -------------------------------------------------------------------------------------
SQL["recipes"] = "SELECT p_partkey AS recipe_id, p_name AS name, CASE WHEN p_partkey % 24 = 0 THEN NULL ELSE p_brand END AS skill, p_size AS required, p_partkey + 1 AS output_id FROM part WHERE p_partkey % 4 = 0"
SQL["teaching"] = """SELECT 'item' AS kind, p_partkey AS source_id, p_partkey - 1 AS recipe_id FROM part WHERE p_partkey % 4 = 1 AND p_partkey > 1
  UNION SELECT 'trainer', l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 4 = 0 AND l_returnflag = 'N' AND l_linenumber = 1
  UNION SELECT 'quest', l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 4 = 0 AND l_returnflag = 'R' AND l_linenumber = 2"""
SQL["reagents"] = "SELECT DISTINCT l_partkey - l_partkey % 4 AS recipe_id, CAST(l_linenumber + l_orderkey % 3 AS INTEGER) AS slot, l_suppkey * 20 AS item_id, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem"


def recipes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").filter(key % 4 == 0).select(key.alias("recipe_id"), F.col("p_name").alias("name"), F.when(key % 24 != 0, F.col("p_brand")).alias("skill"), F.col("p_size").alias("required"), (key + 1).alias("output_id"))


def teaching(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    item = table(spark, sf, "part").filter((key % 4 == 1) & (key > 1)).select(F.lit("item").alias("kind"), key.alias("source_id"), (key - 1).alias("recipe_id"))
    line = table(spark, sf, "lineitem").filter("l_partkey % 4 = 0")
    trainer = line.filter("l_returnflag = 'N' and l_linenumber = 1").select(F.lit("trainer").alias("kind"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("recipe_id"))
    quest = line.filter("l_returnflag = 'R' and l_linenumber = 2").select(F.lit("quest").alias("kind"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("recipe_id"))
    return item.unionByName(trainer).unionByName(quest).distinct()


def reagents(spark: SparkSession, sf: str) -> DataFrame:
    """From every line; some slots are out of range."""
    part = F.col("l_partkey")
    return table(spark, sf, "lineitem").select((part - part % 4).alias("recipe_id"), (F.col("l_linenumber") + F.col("l_orderkey") % 3).cast("int").alias("slot"), (F.col("l_suppkey") * 20).alias("item_id"), F.col("l_quantity").cast("long").alias("quantity")).distinct()


# -- change log and probes -----------------------------------------------------------------------
SQL["log"] = """SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'signup' THEN 'INSERT IGNORE' WHEN 'purchase' THEN 'REPLACE' WHEN 'click' THEN 'UPDATE' WHEN 'view' THEN 'INSERT' ELSE 'DELETE' END AS op,
  CAST(floor(value) AS BIGINT) AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events"""
SQL["probes"] = """SELECT user_id AS item_id, event_id AS attempt, CAST(CAST(ts AS DATE) AS VARCHAR) AS session,
  CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'cached' ELSE 'loaded' END AS status,
  CASE WHEN event_id % 3 = 0 THEN sha256(CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR)) END AS before_hash,
  CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN sha256(CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR)) END AS after_hash FROM events"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "INSERT IGNORE").when(kind == "purchase", "REPLACE").when(kind == "click", "UPDATE").when(kind == "view", "INSERT").otherwise("DELETE")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.floor("value").cast("long").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return probes_of(table(spark, sf, "events"))


def probes_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    digest = F.sha2(F.floor(F.col("value") / 100).cast("long").cast("string"), 256)
    return events.select(
        F.col("user_id").alias("item_id"),
        F.col("event_id").alias("attempt"),
        F.to_date("ts").cast("string").alias("session"),
        F.when(kind == "error", "timeout").when(kind == "view", "cached").otherwise("loaded").alias("status"),
        F.when(F.col("event_id") % 3 == 0, digest).alias("before_hash"),
        F.when(F.floor("value") % 2 == 0, digest).alias("after_hash"),
    )
