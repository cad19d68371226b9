"""Version comparison over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import compose, places
from factweave.operators import versions as v
from factweave.plans.ledger import G, KEYS
from factweave.plans.registry import query
from factweave.sources import bindings as b
from factweave.sources import tables
from factweave.sources.rounds import settle

M = b.with_views("members")
MZ = b.with_views("members", "zones")
_PAIRS = ", pairs AS (SELECT l.parent, l.context, l.member AS a, r.member AS b, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS distance FROM members l JOIN members r USING (parent, context) WHERE l.in_active AND NOT l.in_comparison AND r.in_comparison AND NOT r.in_active)"
_NEAR = _PAIRS + """, nn AS (SELECT *, distance <= min(distance) OVER (PARTITION BY parent, context, a) + 1e-9 AS nearest_a, distance <= min(distance) OVER (PARTITION BY parent, context, b) + 1e-9 AS nearest_b,
  count(*) OVER (PARTITION BY parent, context, a) AS candidates_a FROM pairs)"""
_BAND = "CASE WHEN distance <= 1e-9 THEN '0' WHEN distance <= 5 + 1e-9 THEN '(0,5]' WHEN distance <= 10 + 1e-9 THEN '(5,10]' WHEN distance <= 25 + 1e-9 THEN '(10,25]' ELSE '>25' END"
EDGES = (5, 10, 25)


@query(
    "d01_fact_comparison",
    b.with_views("obs", "selections")
    + f""", c AS (SELECT {KEYS}, max(value) AS value FROM obs WHERE source_key = 0 GROUP BY {KEYS}), a AS (SELECT {KEYS}, o.value FROM selections JOIN obs o USING ({KEYS}, seq))
  SELECT {KEYS}, CASE WHEN a.k IS NULL THEN 'comparison_only' WHEN c.k IS NULL THEN 'active_only' WHEN fact_key LIKE 'error%' THEN 'not_directly_comparable' WHEN a.value = c.value THEN 'same_value' ELSE 'different_value' END AS state
  FROM (SELECT *, 1 AS k FROM c) c FULL JOIN (SELECT *, 1 AS k FROM a) a USING ({KEYS})""",
)
def d01(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.obs(spark, sf)
    comparison = rows.filter("source_key = 0").groupBy(*G).agg(F.max("value").alias("value"))
    active = b.selections(spark, sf).select(*G, "seq").join(rows, [*G, "seq"]).select(*G, "value")
    return v.fact_comparison(comparison, active, G, "value", ~F.col("fact_key").startswith("error"))


def _parents(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.members(spark, sf)
    a, c = F.col("in_active"), F.col("in_comparison")
    return rows.groupBy("parent").agg(F.count_if(a & ~c).alias("active_only"), F.count_if(c & ~a).alias("comparison_only"), F.count_if(a & c).alias("shared"))


_PAR = ", par AS (SELECT parent, count(*) FILTER (in_active AND NOT in_comparison) AS active_only, count(*) FILTER (in_comparison AND NOT in_active) AS comparison_only, count(*) FILTER (in_active AND in_comparison) AS shared FROM members GROUP BY parent)"


@query(
    "d02_presence_context",
    M + "SELECT parent, CASE WHEN parent % 6 = 5 THEN 'unknown' WHEN l AND r THEN 'shared' WHEN r THEN 'comparison_only' WHEN l THEN 'active_only' ELSE 'absent_both' END AS presence FROM (SELECT parent, bool_or(in_active) AS l, bool_or(in_comparison) AS r FROM members GROUP BY parent)",
)
def d02(spark: SparkSession, sf: str) -> DataFrame:
    known = F.col("parent") % 6 != 5
    per = b.members(spark, sf).groupBy("parent").agg(F.bool_or("in_active").alias("l"), F.bool_or("in_comparison").alias("r"))
    return per.select("parent", v.presence(F.when(known, F.col("l")), F.when(known, F.col("r"))).alias("presence"))


@query("d03_membership_context", M + _PAR + "SELECT * FROM par")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    return _parents(spark, sf)


@query("d04_parent_keys", M + "SELECT parent, count(*) AS children FROM members GROUP BY parent")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    """The parent is read from the child's key ``kind:parent:member``."""
    keys = b.members(spark, sf).select(F.concat_ws(":", F.lit("spawn"), F.col("parent").cast("string"), F.col("member").cast("string")).alias("key"))
    return keys.groupBy(F.split_part("key", F.lit(":"), F.lit(2)).cast("long").alias("parent")).agg(F.count("*").alias("children"))


_SIDED = "SELECT parent, member, CASE WHEN in_active THEN 'active_only' ELSE 'comparison_only' END AS direction, m.zone_id, z.map_id FROM (SELECT *, CASE WHEN member % 9 = 8 THEN NULL ELSE member % 25 END AS zone_id FROM members) m LEFT JOIN zones z ON m.zone_id = z.zone_id WHERE in_active <> in_comparison"


@query("d05_one_sided_members", MZ + _SIDED)
def d05(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.members(spark, sf).filter("in_active <> in_comparison")
    rows = rows.withColumn("zone_id", F.when(F.col("member") % 9 != 8, F.col("member") % 25)).withColumn("direction", F.when(F.col("in_active"), "active_only").otherwise("comparison_only"))
    return rows.join(b.zones(spark, sf).select("zone_id", "map_id"), "zone_id", "left").select("parent", "member", "direction", "zone_id", "map_id")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Places of members that only the active or only the comparison version holds, and the versions that hold each."""
    rows = settle(b.members(spark, sf).filter("in_active <> in_comparison").select("parent", "context", "member", "x", "y", "in_active", v.pattern("in_base", "in_active", "in_comparison").alias("pattern")))
    return rows.filter("in_active"), rows.filter("not in_active")


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return places.nearest_partners(*_sides(spark, sf), ["parent", "context"], "member")


@query("d06_pair_distances", M + _PAIRS + " SELECT parent, context, count(*) AS pairs, round(max(distance), 6) AS farthest, round(min(distance), 6) AS closest FROM pairs GROUP BY parent, context")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    found = places.distance_extremes(*_sides(spark, sf), ["parent", "context"])
    return found.select("parent", "context", "pairs", F.round("farthest", 6).alias("farthest"), F.round("closest", 6).alias("closest"))


@query("d07_nearest_partners", M + _NEAR + " SELECT parent, context, a, b, nearest_a, nearest_b, nearest_a AND nearest_b AS mutual, candidates_a FROM nn WHERE nearest_a OR nearest_b")
def d07(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("parent", "context", "a", "b", "nearest_a", "nearest_b", "mutual", "candidates_a")


@query("d08_distance_bands", M + _PAIRS + f" SELECT context, {_BAND} AS band, count(*) AS pairs FROM pairs GROUP BY ALL")
def d08(spark: SparkSession, sf: str) -> DataFrame:
    return places.distance_bands(*_sides(spark, sf), ["parent", "context"], ["context"], EDGES)


@query(
    "d09_topology",
    M + _PAR + """SELECT CASE WHEN active_only > 0 AND comparison_only > 0 THEN 'mixed' WHEN active_only > 0 THEN 'active_only' WHEN comparison_only > 0 THEN 'comparison_only' WHEN shared > 0 THEN 'shared_only' ELSE 'empty' END AS topology,
  CASE active_only WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'multiple' END AS active_cardinality, count(*) AS parents, CAST(sum(active_only) AS BIGINT) AS members FROM par GROUP BY 1, 2""",
)
def d09(spark: SparkSession, sf: str) -> DataFrame:
    t = v.topology(F.col("active_only"), F.col("comparison_only"), F.col("shared")).alias("topology")
    return _parents(spark, sf).groupBy(t, v.cardinality(F.col("active_only")).alias("active_cardinality")).agg(F.count("*").alias("parents"), F.sum("active_only").alias("members"))


@query("d10_attribution", M + "SELECT (CASE WHEN in_base THEN '1' ELSE '0' END) || (CASE WHEN in_active THEN '1' ELSE '0' END) || (CASE WHEN in_comparison THEN '1' ELSE '0' END) AS pattern, count(*) AS members, count(DISTINCT parent) AS parents FROM members WHERE in_active <> in_comparison GROUP BY 1")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a one-sided member came by addition or by removal: the base version decides."""
    rows = b.members(spark, sf).filter("in_active <> in_comparison")
    return rows.groupBy(v.pattern("in_base", "in_active", "in_comparison").alias("pattern")).agg(F.count("*").alias("members"), F.count_distinct("parent").alias("parents"))


@query("d11_replacement_pairs", M + _NEAR + f" SELECT {_BAND} AS band, count(*) AS pairs, count(*) FILTER (nearest_a) AS nearest, count(*) FILTER (nearest_a AND nearest_b) AS mutual FROM nn WHERE nearest_a OR nearest_b GROUP BY 1")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    near = _near(spark, sf)
    return near.groupBy(v.band(F.col("distance"), EDGES).alias("band")).agg(F.count("*").alias("pairs"), F.count_if("nearest_a").alias("nearest"), F.count_if("mutual").alias("mutual"))


@query("d12_addition_classes", M + "SELECT parent, CASE WHEN a > 0 AND c > 0 THEN 'both' WHEN a > 0 THEN 'active_only' WHEN c > 0 THEN 'comparison_only' ELSE 'none' END AS coverage, a AS active_added, c AS comparison_added FROM (SELECT parent, count(*) FILTER (in_active AND NOT in_base) AS a, count(*) FILTER (in_comparison AND NOT in_base) AS c FROM members GROUP BY parent)")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.members(spark, sf).groupBy("parent").agg(F.count_if(F.col("in_active") & ~F.col("in_base")).alias("active_added"), F.count_if(F.col("in_comparison") & ~F.col("in_base")).alias("comparison_added"))
    a, c = F.col("active_added") > 0, F.col("comparison_added") > 0
    return rows.withColumn("coverage", F.when(a & c, "both").when(a, "active_only").when(c, "comparison_only").otherwise("none"))


@query(
    "d13_cumulative_share",
    M + ", t AS (SELECT parent, count(*) AS total FROM members WHERE in_active AND NOT in_base GROUP BY parent), r AS (SELECT parent, total, row_number() OVER w AS rank, CAST(sum(total) OVER (ORDER BY total DESC, parent ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum(total) OVER () AS BIGINT) AS everything FROM t WINDOW w AS (ORDER BY total DESC, parent)) SELECT parent, total, rank, running, round_even(running * 100.0 / everything, 6) AS share FROM r",
)
def d13(spark: SparkSession, sf: str) -> DataFrame:
    totals = b.members(spark, sf).filter("in_active and not in_base").groupBy("parent").agg(F.count("*").alias("total"))
    return v.cumulative_share(totals, "parent", "total")


@query(
    "d14_set_relations",
    M + """SELECT parent, l AS left_members, r AS right_members, s AS shared, CASE WHEN l = s AND r = s THEN 'equal' WHEN r = s THEN 'left_superset' WHEN l = s THEN 'right_superset' WHEN s = 0 THEN 'disjoint' ELSE 'partial_overlap' END AS relation
  FROM (SELECT parent, count(*) FILTER (in_base) AS l, count(*) FILTER (in_active) AS r, count(*) FILTER (in_base AND in_active) AS s FROM members GROUP BY parent)""",
)
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return v.set_relation(b.members(spark, sf), ["parent"], "in_base", "in_active")


@query(
    "d15_payload_classes",
    b.with_views("composed") + "SELECT CASE WHEN l.name <> r.name AND l.price <> r.price THEN 'several_fields' WHEN l.name <> r.name THEN 'name_only' WHEN l.price <> r.price THEN 'price_only' ELSE 'same' END AS class, count(*) AS n FROM base l JOIN composed r USING (id) GROUP BY 1",
)
def d15(spark: SparkSession, sf: str) -> DataFrame:
    rows = compose.compare_views(b.base(spark, sf), compose.overlay(b.base(spark, sf), b.patch(spark, sf), "id"), "id").filter("changed_fields is not null")
    f = F.col("changed_fields")
    kind = F.when(f == "", "same").when(f == "name", "name_only").when(f == "price", "price_only").otherwise("several_fields")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("d16_strata", MZ + f", o AS ({_SIDED}) SELECT zone_id, direction, count(*) AS n, min(parent * 1000000 + member) AS first_key FROM o GROUP BY zone_id, direction")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by stratum and its first member by key."""
    return d05(spark, sf).groupBy("zone_id", "direction").agg(F.count("*").alias("n"), F.min(F.col("parent") * 1000000 + F.col("member")).alias("first_key"))


@query("d17_transforms", M + "SELECT parent, count(*) FILTER (in_base AND in_active) AS inherited, count(*) FILTER (in_base AND NOT in_active) AS removed, count(*) FILTER (NOT in_base AND in_active) AS added, CASE WHEN bool_or(in_base) AND NOT bool_or(in_active) THEN 'removed' WHEN NOT bool_or(in_base) THEN 'parent_added' WHEN bool_and(in_base = in_active) THEN 'inherited' ELSE 'replaced' END AS transform FROM members GROUP BY parent")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    base, active = F.col("in_base"), F.col("in_active")
    transform = F.when(F.bool_or(base) & ~F.bool_or(active), "removed").when(~F.bool_or(base), "parent_added").when(F.bool_and(base == active), "inherited").otherwise("replaced")
    return b.members(spark, sf).groupBy("parent").agg(F.count_if(base & active).alias("inherited"), F.count_if(base & ~active).alias("removed"), F.count_if(~base & active).alias("added"), transform.alias("transform"))


@query("d18_duplicate_collapse", "SELECT l_suppkey AS parent, l_partkey AS member, count(*) AS raw, min(l_orderkey) AS kept FROM lineitem GROUP BY ALL HAVING raw > 1")
def d18(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("member"))
    return rows.agg(F.count("*").alias("raw"), F.min("l_orderkey").alias("kept")).filter("raw > 1")


@query("d19_membership_check", M + "SELECT parent, member, CASE WHEN in_base THEN 'missing' ELSE 'extra' END AS side FROM members WHERE in_base <> in_active")
def d19(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.members(spark, sf)
    raw, stored = rows.filter("in_base").select("parent", "member"), rows.filter("in_active").select("parent", "member")
    return raw.exceptAll(stored).withColumn("side", F.lit("missing")).unionByName(stored.exceptAll(raw).withColumn("side", F.lit("extra")))


@query("d20_cross_overlay", M + "SELECT member % 25 AS zone_id, count(*) FILTER (in_active AND in_comparison AND NOT in_base) AS shared_added, count(*) FILTER (in_active AND NOT in_comparison AND NOT in_base) AS active_added, count(*) FILTER (in_comparison AND NOT in_active AND NOT in_base) AS comparison_added FROM members WHERE member % 25 IN (1, 2, 3, 5, 8) GROUP BY 1")
def d20(spark: SparkSession, sf: str) -> DataFrame:
    a, c, new = F.col("in_active"), F.col("in_comparison"), ~F.col("in_base")
    rows = b.members(spark, sf).withColumn("zone_id", F.col("member") % 25).filter(F.col("zone_id").isin(1, 2, 3, 5, 8))
    return rows.groupBy("zone_id").agg(F.count_if(a & c & new).alias("shared_added"), F.count_if(a & ~c & new).alias("active_added"), F.count_if(c & ~a & new).alias("comparison_added"))


@query("d21_top_per_zone", MZ + f", o AS ({_SIDED}), t AS (SELECT zone_id, parent, count(*) AS total FROM o WHERE zone_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY total DESC, parent) AS rank FROM t) SELECT zone_id, parent, total, rank FROM r WHERE rank <= 3")
def d21(spark: SparkSession, sf: str) -> DataFrame:
    totals = d05(spark, sf).filter("zone_id is not null").groupBy("zone_id", "parent").agg(F.count("*").alias("total"))
    return v.top_per_group(totals, ["zone_id"], [F.desc("total"), F.col("parent")], 3).select("zone_id", "parent", "total", "rank")


_COMPARED = f""", c AS (SELECT {KEYS}, max(value) AS value FROM obs WHERE source_key = 0 GROUP BY {KEYS}), a AS (SELECT {KEYS}, o.value FROM selections JOIN obs o USING ({KEYS}, seq)),
  cmp AS (SELECT {KEYS}, split_part(fact_key, '.', 1) AS fact_family, CASE WHEN a.k IS NULL THEN 'comparison_only' WHEN c.k IS NULL THEN 'active_only' WHEN fact_key LIKE 'error%' THEN 'not_directly_comparable' WHEN a.value = c.value THEN 'same_value' ELSE 'different_value' END AS state
  FROM (SELECT *, 1 AS k FROM c) c FULL JOIN (SELECT *, 1 AS k FROM a) a USING ({KEYS}))"""
FAMILIES = ("click", "error", "view")


def _report(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    compared = d01(spark, sf).withColumn("fact_family", F.substring_index("fact_key", ".", 1))
    return v.comparison_report(compared, kinds=("user",), families=FAMILIES, states=("different_value", "comparison_only"), limit=500)


@query("d01_report_counts", b.with_views("obs", "selections") + _COMPARED + f" SELECT subject_kind, fact_family, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in v.STATES)} FROM cmp WHERE fact_family IN {FAMILIES} GROUP BY ALL")
def d01_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)[0]


@query("d01_report_examples", b.with_views("obs", "selections") + _COMPARED + f" SELECT {KEYS}, fact_family, state FROM cmp WHERE fact_family IN {FAMILIES} AND state IN ('different_value', 'comparison_only') ORDER BY subject_kind, subject_key, fact_key LIMIT 500")
def d01_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)[1]


@query("d09_count_distribution", M + _PAR + "SELECT active_only + comparison_only AS one_sided, count(*) AS parents FROM par GROUP BY 1")
def d09_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """How many parents have how many one-sided members."""
    return _parents(spark, sf).groupBy((F.col("active_only") + F.col("comparison_only")).alias("one_sided")).agg(F.count("*").alias("parents"))


@query("d09_top_parents", M + _PAR + "SELECT parent, active_only, comparison_only, shared FROM par ORDER BY active_only + comparison_only DESC, parent LIMIT 25")
def d09_parents(spark: SparkSession, sf: str) -> DataFrame:
    return _parents(spark, sf).orderBy((F.col("active_only") + F.col("comparison_only")).desc(), "parent").limit(25)


@query("d09_top_zones", MZ + f", o AS ({_SIDED}) SELECT zone_id, map_id, count(*) FILTER (direction = 'active_only') AS active_only, count(*) FILTER (direction = 'comparison_only') AS comparison_only FROM o WHERE zone_id IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, zone_id LIMIT 10")
def d09_zones(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda side: F.count_if(F.col("direction") == side).alias(side)
    rows = d05(spark, sf).filter("zone_id is not null").groupBy("zone_id", "map_id").agg(one("active_only"), one("comparison_only"), F.count("*").alias("_n"))
    return rows.orderBy(F.desc("_n"), "zone_id").limit(10).drop("_n")


_PATTERN = "(CASE WHEN {0}in_base THEN '1' ELSE '0' END) || (CASE WHEN {0}in_active THEN '1' ELSE '0' END) || (CASE WHEN {0}in_comparison THEN '1' ELSE '0' END)"


@query(
    "d11_pair_classes",
    M
    + _NEAR
    + f""", near AS (SELECT nn.*, CASE WHEN nearest_a THEN count(*) FILTER (nearest_a) OVER (PARTITION BY parent, context, a) END AS ties FROM nn WHERE nearest_a OR nearest_b)
  SELECT {_PATTERN.format('l.')} || '>' || {_PATTERN.format('r.')} AS class, {_BAND} AS band, CASE WHEN ties IS NULL THEN 'not_nearest' WHEN ties = 1 THEN 'one' ELSE 'multiple' END AS tied, count(*) AS pairs, count(*) FILTER (nearest_a AND nearest_b) AS mutual
  FROM near n JOIN members l ON l.parent = n.parent AND l.member = n.a JOIN members r ON r.parent = n.parent AND r.member = n.b GROUP BY 1, 2, 3""",
)
def d11_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Replacement candidates by which versions hold each of both."""
    who = [side.withColumn("who", F.struct("member", "pattern")) for side in _sides(spark, sf)]
    near = places.nearest_partners(*who, ["parent", "context"], "who")
    return v.pair_classes(near, "a.pattern", "b.pattern", v.band(F.col("distance"), EDGES))
