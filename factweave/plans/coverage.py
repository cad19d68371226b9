"""Graph, coverage and promotion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import coverage as cov
from factweave.operators import graph as g
from factweave.plans.registry import query
from factweave.sources import bindings as b
from factweave.sources import tables

DEPTH = 6
_WALK = f""", walk AS (SELECT o_orderkey AS root, o_orderkey AS node, [o_orderkey] AS path, 0 AS depth FROM orders UNION ALL SELECT w.root, e.b, list_append(w.path, e.b), w.depth + 1 FROM walk w JOIN edges e ON w.node = e.a WHERE w.depth < {DEPTH}),
  best AS (SELECT root, node, path, depth FROM (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth, path) AS nth FROM walk) WHERE nth = 1), nodes AS (SELECT root, node, depth FROM best)"""
_LINKS = f", links AS (SELECT n.root, e.a, e.b, n.depth + 1 AS depth, list_contains(n.path, e.b) AS cycle FROM best n JOIN edges e ON n.node = e.a WHERE n.depth < {DEPTH})"


def _walk(spark: SparkSession, sf: str, depth: int = DEPTH, direction: str = "prerequisite"):
    """From every order, over all edges."""
    roots = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("root"))
    edges = b.edges(spark, sf)
    return (*g.traverse(edges, roots, depth, 500, direction), edges)


@query("g01_traverse_nodes", b.with_views("edges") + _WALK + " SELECT * FROM nodes")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf)[0]


@query("g01_traverse_links", b.with_views("edges") + _WALK + _LINKS + " SELECT * FROM links")
def g01_links(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf)[1]


@query("g01_follow_up_links", b.with_views("edges") + ", fwd AS (SELECT b AS a, a AS b FROM edges)" + (_WALK + _LINKS).replace("JOIN edges e", "JOIN fwd e") + " SELECT * FROM links")
def g01_follow_ups(spark: SparkSession, sf: str) -> DataFrame:
    """From every order to what needs it."""
    return _walk(spark, sf, direction="follow_up")[1]


@query(
    "g02_traversal_flags",
    b.with_views("edges")
    + _WALK
    + _LINKS
    + f""", ln AS (SELECT root, a, count(*) AS n FROM links GROUP BY ALL), amb AS (SELECT root, bool_or(n > 1) AS ambiguous FROM ln GROUP BY root),
  l AS (SELECT root, bool_or(cycle) AS cycle, bool_or(b % 7 = 2) AS unresolved FROM links GROUP BY root)
  SELECT n.root, count(*) AS nodes, max(depth) AS deepest, coalesce(any_value(ambiguous), false) AS ambiguous, coalesce(any_value(cycle), false) AS cycle, bool_or(depth = {DEPTH} AND node IN (SELECT a FROM edges)) AS truncated_by_depth,
   false AS truncated_by_budget, coalesce(any_value(unresolved), false) AS unresolved, bool_or(node % 6 = 5) AS incomplete FROM nodes n LEFT JOIN amb USING (root) LEFT JOIN l USING (root) GROUP BY n.root""",
)
def g02(spark: SparkSession, sf: str) -> DataFrame:
    orders = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"))
    return g.walk_flags(b.edges(spark, sf), orders.withColumnRenamed("node", "root"), DEPTH, 500, known=orders.filter("node % 7 <> 2"), partial=orders.filter("node % 6 = 5"))


BUDGET = 4


@query(
    "g02_budget_flags",
    b.with_views("edges")
    + _WALK
    + """, placed AS (SELECT b.root, b.node, b.depth, row_number() OVER (PARTITION BY b.root ORDER BY b.depth, b.path) AS nth FROM best b)"""
    + f""", d1 AS (SELECT * FROM placed WHERE depth <= 1), one AS (SELECT root, node, depth FROM d1 WHERE nth <= {BUDGET})
  SELECT root, count(*) AS nodes, bool_or(cut) AS truncated_by_budget FROM (SELECT root, node, nth <= {BUDGET} AS held, nth > {BUDGET} AS cut FROM d1) GROUP BY root""".replace("count(*) AS nodes", "count(*) FILTER (held) AS nodes"),
)
def g02_budget(spark: SparkSession, sf: str) -> DataFrame:
    """One step from every order with room for few nodes."""
    roots = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("root"))
    edges = b.edges(spark, sf)
    nodes, links = g.traverse(edges, roots, 1, BUDGET)
    return g.traversal_flags(nodes, links, edges, 1).select("root", "nodes", "truncated_by_budget")


@query(
    "g03_strong_components",
    b.with_views("edges") + ", reach AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a) SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a",
)
def g03(spark: SparkSession, sf: str) -> DataFrame:
    return g.strong_components(b.edges(spark, sf))


@query(
    "g04_group_consistency",
    """WITH m AS (SELECT DISTINCT l_suppkey AS o, l_partkey AS m FROM lineitem), s AS (SELECT o, list_sort(list(DISTINCT m)) AS s FROM m GROUP BY o)
  SELECT DISTINCT least(m.o, m.m) AS "left", greatest(m.o, m.m) AS "right" FROM m JOIN s a ON a.o = m.o JOIN s c ON c.o = m.m WHERE m.o <> m.m AND a.s <> c.s""",
)
def g04(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("o"), F.col("l_partkey").alias("m")).distinct()
    return g.group_consistency(rows, "o", "m")


@query(
    "f01_coverage",
    b.with_views("templates", "loot")
    + """SELECT count(*) FILTER (c IS NOT NULL AND k IS NOT NULL) AS both, count(*) FILTER (k IS NULL) AS cache_only, count(*) FILTER (c IS NULL) AS missing, min(item_id) FILTER (c IS NULL) AS lowest_missing, max(item_id) FILTER (c IS NULL) AS highest_missing,
   round_even(count(*) FILTER (c IS NOT NULL AND k IS NOT NULL) / count(*) FILTER (k IS NOT NULL), 8) AS ratio FROM (SELECT item_id, 1 AS c FROM templates) FULL JOIN (SELECT DISTINCT item_id, 1 AS k FROM loot WHERE item_id % 4 <> 0) USING (item_id)""",
)
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return cov.id_coverage(b.templates(spark, sf), b.loot(spark, sf).filter("item_id % 4 <> 0"), "item_id")


DISTRIBUTED = ("quality", "class_id", "subclass_id", "inventory_type", "required_level")


@query(
    "f01_distributions",
    b.with_views("templates")
    + f"SELECT concat_ws('+', {', '.join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in DISTRIBUTED)}) AS level, {', '.join(DISTRIBUTED)}, count(*) AS n FROM templates GROUP BY GROUPING SETS ({', '.join(f'({c})' for c in DISTRIBUTED)})",
)
def f01_distributions(spark: SparkSession, sf: str) -> DataFrame:
    from factweave.operators.audit import levels

    return levels(b.templates(spark, sf).select(*DISTRIBUTED), [[c] for c in DISTRIBUTED], n=F.count("*"))


@query(
    "f01_restrictions",
    b.with_views("templates") + "SELECT count(*) AS items, count(*) FILTER (required_level > 0) AS level_restricted, count(*) FILTER (max_durability IS NOT NULL) AS with_durability, count(*) FILTER (armor > 0) AS with_armor, count(*) FILTER (holy_resistance + fire_resistance + nature_resistance + frost_resistance + shadow_resistance + arcane_resistance > 0) AS with_resistance, count(*) FILTER (t0 <> 0 OR v0 <> 0 OR t1 <> 0 OR v1 <> 0) AS with_stats FROM templates",
)
def f01_restrictions(spark: SparkSession, sf: str) -> DataFrame:
    """How many items have a restriction or a non-empty field."""
    return cov.field_counts(
        b.templates(spark, sf),
        {
            "level_restricted": F.col("required_level") > 0,
            "with_durability": F.col("max_durability").isNotNull(),
            "with_armor": F.col("armor") > 0,
            "with_resistance": sum((F.col(f"{r}_resistance") for r in b.RESISTANCES), F.lit(0)) > 0,
            "with_stats": F.exists("stats", lambda s: (s["type"] != 0) | (s["value"] != 0)),
        },
    )


@query("f02_spread_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, rank FROM r WHERE rank IN (SELECT CAST(round_even(i * (n - 1) / 99, 0) AS BIGINT) FROM range(100) t(i), (SELECT any_value(n) AS n FROM r))")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    return cov.spread_sample(tables.table(spark, sf, "orders"), "o_orderkey", 100)


_CLASS = "CASE WHEN before_hash IS NOT NULL THEN 'historical' WHEN status = 'loaded' AND after_hash IS NOT NULL THEN 'refresh_proven' WHEN status = 'loaded' THEN 'session_only' ELSE 'unknown' END"


@query("f03_probe_classes", b.with_views("probes") + f"SELECT {_CLASS} AS class, status, count(*) AS n FROM probes GROUP BY ALL")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    kind = cov.probe_class(F.col("status"), F.col("before_hash"), F.col("after_hash"))
    return b.probes(spark, sf).groupBy(kind.alias("class"), "status").agg(F.count("*").alias("n"))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.probes(spark, sf)
    kind = cov.probe_class(F.col("status"), F.col("before_hash"), F.col("after_hash"))
    proofs = rows.filter(kind == "refresh_proven").select("item_id", "after_hash")
    current = rows.filter("item_id % 6 <> 5").groupBy("item_id").agg(F.max_by("before_hash", "attempt").alias("now")).filter("now is not null")
    return cov.promotion_plan(proofs, current, "item_id", "after_hash", "now")


_PLAN = f""", proofs AS (SELECT item_id, after_hash FROM probes WHERE {_CLASS} = 'refresh_proven'), cur AS (SELECT item_id, arg_max(struct_pack(h := before_hash), attempt).h AS now FROM probes WHERE item_id % 6 <> 5 GROUP BY item_id),
  plan AS (SELECT p.item_id, CASE WHEN max(c.now) IS NULL THEN 'gone' WHEN bool_or(p.after_hash = c.now) THEN 'eligible' ELSE 'drifted' END AS plan, count(DISTINCT p.after_hash) AS proofs FROM proofs p LEFT JOIN cur c USING (item_id) GROUP BY p.item_id)"""


@query("f04_promotion_plan", b.with_views("probes") + _PLAN + " SELECT * FROM plan")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


@query("f05_incremental_plan", b.with_views("probes") + _PLAN + " SELECT item_id, CASE WHEN plan = 'eligible' AND item_id IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0) THEN 'already_current' ELSE plan END AS plan, proofs FROM plan")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    promoted = tables.table(spark, sf, "lineitem").filter("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("item_id"))
    return cov.incremental_plan(_plan(spark, sf), promoted, "item_id").select("item_id", "plan", "proofs")


_OUT = "CASE WHEN status = 'timeout' THEN 'timeout' ELSE " + _CLASS + " END"
_FOLD = f""", per AS (SELECT item_id, session, arg_max({_OUT}, attempt) AS o, max(attempt) AS s FROM probes GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s) AS k FROM per),
  f AS (SELECT item_id, CAST(0 AS BIGINT) AS k, 'queued' AS state, 0 AS attempts FROM (SELECT DISTINCT item_id FROM per) UNION ALL
   SELECT f.item_id, n.k, CASE WHEN f.state IN ('refresh_proven', 'historical', 'terminal') THEN f.state WHEN n.o = 'timeout' THEN CASE WHEN f.attempts + 1 >= 3 THEN 'terminal' ELSE 'retryable' END ELSE n.o END,
    CASE WHEN f.state IN ('refresh_proven', 'historical', 'terminal') THEN f.attempts ELSE f.attempts + 1 END FROM f JOIN n ON n.item_id = f.item_id AND n.k = f.k + 1),
  merged AS (SELECT item_id, arg_max(state, k) AS state, arg_max(attempts, k) AS attempts FROM f GROUP BY item_id)"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.probes(spark, sf)
    kind = F.when(F.col("status") == "timeout", "timeout").otherwise(cov.probe_class(F.col("status"), F.col("before_hash"), F.col("after_hash")))
    return cov.merge_sessions(rows.withColumn("o", kind), "item_id", "session", "attempt", "o", 3)


@query("f06_session_merge", b.with_views("probes") + _FOLD + " SELECT item_id, state, attempts FROM merged")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf)


@query("f07_retire_present", b.with_views("probes") + _FOLD + " SELECT item_id, CASE WHEN state IN ('queued', 'retryable') AND item_id % 3 = 0 THEN 'retired' ELSE state END AS state FROM merged")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that the current state holds by now are retired before the next session."""
    present = b.probes(spark, sf).filter("item_id % 3 = 0").select("item_id").distinct().withColumn("present", F.lit(True))
    rows = merged(spark, sf).join(present, "item_id", "left")
    return rows.select("item_id", F.when(F.col("state").isin("queued", "retryable") & F.col("present"), "retired").otherwise(F.col("state")).alias("state"))


_CAMPAIGN = _FOLD + ", items AS (SELECT c_custkey AS item_id, coalesce(m.state, 'queued') AS state, coalesce(m.attempts, 0) AS attempts FROM customer LEFT JOIN merged m ON m.item_id = c_custkey)"
BATCH = 20


def campaign(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's id as a candidate; those without a session are queued."""
    ids = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))
    rows = ids.join(merged(spark, sf), "item_id", "left")
    return rows.select("item_id", F.coalesce("state", F.lit("queued")).alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query(
    "f08_next_batch",
    b.with_views("probes")
    + _CAMPAIGN
    + f""", r AS (SELECT item_id, state, row_number() OVER (PARTITION BY state ORDER BY item_id) - 1 AS rank, count(*) OVER (PARTITION BY state) AS n FROM items WHERE state IN ('queued', 'retryable')),
  kinds AS (SELECT bool_or(state = 'queued') AS q, bool_or(state = 'retryable') AS t FROM r), room AS (SELECT CASE WHEN q AND t THEN {BATCH - 1} WHEN q THEN {BATCH} ELSE 0 END AS q, CASE WHEN q AND t THEN 1 WHEN t THEN {BATCH} ELSE 0 END AS t FROM kinds),
  w AS (SELECT r.*, CASE state WHEN 'queued' THEN room.q ELSE room.t END AS room FROM r, room)
  SELECT item_id, state AS part, rank FROM w WHERE room > 0 AND (n <= room OR (room = 1 AND rank = (n - 1) // 2) OR (room > 1 AND rank IN (SELECT CAST(round_even(i * (n - 1) / (room - 1), 0) AS BIGINT) FROM range(room) t(i))))""",
)
def f08(spark: SparkSession, sf: str) -> DataFrame:
    """One retryable item and a spread of the queued ones."""
    return cov.next_batch(campaign(spark, sf), "item_id", "state", BATCH).select("item_id", "part", "rank")


@query(
    "f09_campaign_totals",
    b.with_views("probes")
    + _CAMPAIGN
    + """, t AS (SELECT count(*) AS candidates, count(*) FILTER (attempts > 0) AS attempted, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries, count(*) FILTER (state = 'refresh_proven') AS refresh_proven, count(*) FILTER (state = 'session_only') AS session_limited,
   count(*) FILTER (state IN ('retryable', 'terminal')) AS unknown, count(*) FILTER (state = 'terminal') AS terminal, count(*) FILTER (state = 'queued') AS unattempted, count(*) FILTER (state IN ('queued', 'retryable')) AS eligible FROM items)
  SELECT *, round_even(refresh_proven / attempted, 8) AS refresh_proven_rate, round_even(session_limited / attempted, 8) AS session_limited_rate, round_even(unknown / attempted, 8) AS unknown_rate FROM t""",
)
def f09_totals(spark: SparkSession, sf: str) -> DataFrame:
    return cov.campaign_report(campaign(spark, sf), "state", "attempts")


@query("f09_campaign_report", b.with_views("probes") + _FOLD + " SELECT state, count(*) AS items, CAST(sum(attempts) AS BIGINT) AS attempts, round_even(count(*) / (SELECT count(*) FROM merged), 8) AS share FROM merged GROUP BY state")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    per = merged(spark, sf).groupBy("state").agg(F.count("*").alias("items"), F.sum("attempts").alias("attempts"))
    return per.withColumn("share", F.bround(F.col("items") / F.sum("items").over(Window.partitionBy()), 8))
