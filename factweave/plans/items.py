"""Items and zones by three-state predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import tristate as ts
from factweave.operators import search
from factweave.plans.registry import query
from factweave.sources import bindings as b

_ITEM = """, judged AS (SELECT i.item_id, i.name, t.quality, t.item_level, t.required_level,
    (contains(lower(i.name), 'ring') AND t.quality >= 2 AND t.required_level <= 20
     AND CASE WHEN t.item_id IS NULL THEN NULL ELSE (t.t0 = 3 AND t.v0 >= 10) OR (t.t1 = 3 AND t.v1 >= 10) END) AS ok
  FROM items i LEFT JOIN templates t USING (item_id)),
 stated AS (SELECT *, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'known_match' ELSE 'known_non_match' END AS state FROM judged)
"""


def item_predicates() -> list[Column]:
    return [
        ts.contains(F.col("name"), "RING"),
        ts.at_least(F.col("quality"), 2),
        ts.at_most(F.col("required_level"), 20),
        ts.any_element(F.col("stats"), lambda s: (s["type"] == 3) & (s["value"] >= 10)),
    ]


def judged_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.items(spark, sf).join(b.templates(spark, sf), "item_id", "left")
    return search.judge(rows, item_predicates())


@query("items_search", b.with_views("items", "templates") + _ITEM + "SELECT item_id, name, quality, item_level, required_level, state FROM stated WHERE state <> 'known_non_match'")
def items_search(spark: SparkSession, sf: str) -> DataFrame:
    """Items that match or may match: E-02 with T-01 to T-04."""
    return judged_items(spark, sf).filter("state <> 'known_non_match'").select("item_id", "name", "quality", "item_level", "required_level", "state")


@query("items_summary", b.with_views("items", "templates") + _ITEM + "SELECT state, count(*) AS n FROM stated GROUP BY state")
def items_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by state over all items, before any filter or limit: T-09."""
    return search.summary(judged_items(spark, sf))


@query(
    "items_page",
    b.with_views("items", "templates")
    + _ITEM
    + """SELECT row_number() OVER (ORDER BY item_level IS NULL, item_level DESC NULLS LAST, CASE WHEN item_level IS NOT NULL THEN item_id END DESC NULLS LAST, item_id) AS position, item_id, item_level, state
  FROM stated WHERE state <> 'known_non_match' ORDER BY 1 LIMIT 100""",
)
def items_page(spark: SparkSession, sf: str) -> DataFrame:
    """A descending page of 100, unknown keys last: T-10."""
    rows = judged_items(spark, sf).filter("state <> 'known_non_match'")
    return search.page(rows, F.col("item_level"), F.col("item_id"), 100, descending=True).select("position", "item_id", "item_level", "state")


@query(
    "items_templates",
    b.with_views("templates")
    + "SELECT item_id, required_level, item_level FROM templates WHERE required_level <= 15 AND ((t0 = 2 AND v0 >= 5) OR (t1 = 2 AND v1 >= 5)) AND ((t0 = 4 AND v0 >= 1) OR (t1 = 4 AND v1 >= 1))",
)
def items_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Two-valued template search with one existence test per stat: E-03."""
    has = lambda kind, least: F.exists("stats", lambda s: (s["type"] == kind) & (s["value"] >= least))
    return b.templates(spark, sf).filter((F.col("required_level") <= 15) & has(2, 5) & has(4, 1)).select("item_id", "required_level", "item_level")


@query(
    "items_predicate_trace",
    b.with_views("items", "templates")
    + """SELECT i.item_id, p.predicate, CASE WHEN p.ok IS NULL THEN 'unknown' WHEN p.ok THEN 'known_match' ELSE 'known_non_match' END AS state, CASE WHEN p.ok IS NULL THEN 'no value known' END AS reason
  FROM items i LEFT JOIN templates t USING (item_id), LATERAL (VALUES ('quality', t.quality >= 2), ('required_level', t.required_level <= 20)) p(predicate, ok)""",
)
def items_predicate_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Each predicate's label, state and reason: T-01."""
    rows = b.items(spark, sf).join(b.templates(spark, sf), "item_id", "left")
    q, r = F.col("quality"), F.col("required_level")
    out = rows.select("item_id", F.inline(F.array(ts.trace("quality", ts.at_least(q, 2), q), ts.trace("required_level", ts.at_most(r, 20), r))))
    return out.drop("actual")


@query(
    "zones_search",
    b.with_views("zones", "maps")
    + """, judged AS (SELECT z.zone_id, z.zone_name, z.map_id, (contains(lower(z.zone_name), '_1') AND m.map_id IN (0, 1) AND contains(lower(m.map_name), 'a')) AS ok FROM zones z LEFT JOIN maps m USING (map_id))
  SELECT zone_id, zone_name, map_id, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'known_match' ELSE 'known_non_match' END AS state FROM judged""",
)
def zones_search(spark: SparkSession, sf: str) -> DataFrame:
    """E-01: zones by name, map and map name; no map is unknown."""
    rows = b.zones(spark, sf).join(b.maps(spark, sf), "map_id", "left").withColumn("known_map", F.when(F.col("map_name").isNotNull(), F.col("map_id")))
    judged = search.judge(rows, [ts.contains(F.col("zone_name"), "_1"), F.col("known_map").isin(0, 1), ts.contains(F.col("map_name"), "A")])
    return judged.select("zone_id", "zone_name", "map_id", "state")
