"""Evidence audits over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import audit
from factweave.plans.ledger import G, KEYS, _RES, EK, resolution
from factweave.plans.registry import query
from factweave.sources import bindings as b

_GF = f""", gf AS (SELECT {KEYS}, any_value(fact_family) AS fact_family, count(*) AS statements, count(DISTINCT value) AS distinct_values, count(DISTINCT source_key) AS sources FROM obs GROUP BY {KEYS}),
  facts AS (SELECT gf.*, s.seq IS NOT NULL AS selected, s.policy FROM gf LEFT JOIN selections s USING ({KEYS}))"""
VIEWS = b.with_views("obs", "selections") + _GF


def facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.group_facts(b.obs(spark, sf), b.selections(spark, sf), G, "value")
    return rows.withColumn("fact_family", F.substring_index("fact_key", ".", 1))


@query("a01_source_report", VIEWS + "SELECT source_key, count(*) AS batches, string_agg(revision || ':' || n, ';' ORDER BY revision) AS detail FROM (SELECT source_key, revision, count(*) AS n FROM obs GROUP BY ALL) GROUP BY source_key")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    per = b.obs(spark, sf).groupBy("source_key", "revision").agg(F.count("*").alias("n"))
    detail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("revision", "n"))), lambda x: F.concat_ws(":", x["revision"], x["n"].cast("string"))), ";")
    return per.groupBy("source_key").agg(F.count("*").alias("batches"), detail.alias("detail"))


@query("a02_trace_report", VIEWS + f"SELECT {KEYS}, count(*) AS statements, string_agg(seq || '=' || value, ';' ORDER BY seq) AS trace, max(s.seq) AS chosen FROM (SELECT {KEYS}, seq, value FROM obs) LEFT JOIN (SELECT {KEYS}, seq FROM selections) s USING ({KEYS}) GROUP BY {KEYS}".replace("seq || '='", "q || '='").replace("SELECT subject_kind, subject_key, fact_key, seq, value FROM obs", "SELECT subject_kind, subject_key, fact_key, seq AS q, value FROM obs").replace("ORDER BY seq)", "ORDER BY q)"))
def a02(spark: SparkSession, sf: str) -> DataFrame:
    """Each fact's statements in order, and which was chosen."""
    rows = b.obs(spark, sf).groupBy(*G).agg(F.count("*").alias("statements"), F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("t"))
    trace = F.array_join(F.transform("t", lambda x: F.concat_ws("=", x["seq"].cast("string"), x["value"].cast("string"))), ";")
    return rows.join(b.selections(spark, sf).select(*G, F.col("seq").alias("chosen")), G, "left").select(*G, "statements", trace.alias("trace"), "chosen")


@query("a03_conflicts", VIEWS + f"SELECT {KEYS}, distinct_values, NOT selected AS unresolved FROM facts WHERE distinct_values > 1")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return audit.conflicts(facts(spark, sf)).select(*G, "distinct_values", "unresolved")


@query("a04_unselected", VIEWS + f"SELECT {KEYS}, statements, sources FROM facts WHERE NOT selected AND distinct_values = 1 AND EXISTS (SELECT 1 FROM obs o WHERE o.subject_key = facts.subject_key AND o.fact_key = facts.fact_key AND o.source_key = 1)")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    """Unselected facts of one value that source 1 states too."""
    by_source = b.obs(spark, sf).filter("source_key = 1").select(*G)
    return audit.unselected(facts(spark, sf)).join(by_source, G, "left_semi").select(*G, "statements", "sources")


@query(
    "a05_unselected_aggregates",
    VIEWS
    + f""", u AS (SELECT o.*, o.source_key AS src FROM obs o JOIN facts f USING ({KEYS}) WHERE NOT f.selected AND f.distinct_values = 1)
  SELECT concat_ws('+', CASE WHEN grouping(subject_kind) = 0 THEN 'subject_kind' END, CASE WHEN grouping(fact_family) = 0 THEN 'fact_family' END, CASE WHEN grouping(source_key) = 0 THEN 'source_key' END, CASE WHEN grouping(revision) = 0 THEN 'revision' END) AS level,
   subject_kind, fact_family, source_key, revision, count(DISTINCT (subject_key, fact_key)) AS groups, count(DISTINCT seq) AS statements FROM u
  GROUP BY GROUPING SETS ((subject_kind), (fact_family), (source_key), (source_key, revision), (fact_family, source_key))""",
)
def a05(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.obs(spark, sf).join(audit.unselected(facts(spark, sf)).select(*G), G, "left_semi")
    out = audit.levels(
        rows.select("subject_kind", "fact_family", "source_key", "revision", "subject_key", "fact_key", "seq"),
        [["subject_kind"], ["fact_family"], ["source_key"], ["source_key", "revision"], ["fact_family", "source_key"]],
        groups=F.count_distinct("subject_key", "fact_key"),
        statements=F.count_distinct("seq"),
    )
    return out


@query(
    "a05_fact_patterns",
    VIEWS + "SELECT pattern, count(*) AS subjects FROM (SELECT subject_key, string_agg(DISTINCT fact_family, ',' ORDER BY fact_family) AS pattern FROM facts WHERE NOT selected AND distinct_values = 1 GROUP BY subject_key) GROUP BY pattern",
)
def a05_patterns(spark: SparkSession, sf: str) -> DataFrame:
    per = audit.unselected(facts(spark, sf)).groupBy("subject_key").agg(F.array_join(F.array_sort(F.collect_set("fact_family")), ",").alias("pattern"))
    return per.groupBy("pattern").agg(F.count("*").alias("subjects"))


_STATE = "CASE WHEN selected THEN 'selected' WHEN distinct_values = 0 THEN 'empty_unselected' WHEN distinct_values > 1 THEN 'conflict_unselected' ELSE 'single_value_unselected' END"


@query("a06_sibling_states", VIEWS + f"SELECT subject_key, count(*) FILTER ({_STATE} = 'selected') AS selected, count(*) FILTER ({_STATE} = 'conflict_unselected') AS conflict_unselected, count(*) FILTER ({_STATE} = 'single_value_unselected') AS single_value_unselected FROM facts GROUP BY subject_key")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).withColumn("state", audit.fact_state(F.col("selected"), F.col("distinct_values")))
    states = ("selected", "conflict_unselected", "single_value_unselected")
    return rows.groupBy("subject_key").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


@query(
    "a07_resolution_report",
    VIEWS
    + """SELECT concat_ws('+', CASE WHEN grouping(policy) = 0 THEN 'policy' END, CASE WHEN grouping(fact_family) = 0 THEN 'fact_family' END) AS level, policy, fact_family, count(*) AS groups, count(*) FILTER (selected) AS selected,
   count(*) FILTER (distinct_values > 1) AS conflicts, count(*) FILTER (distinct_values > 1 AND selected) AS resolved_conflicts, count(*) FILTER (distinct_values = 1 AND NOT selected) AS single_unselected, CAST(sum(statements) AS BIGINT) AS statements
  FROM facts GROUP BY GROUPING SETS ((), (policy), (fact_family))""",
)
def a07(spark: SparkSession, sf: str) -> DataFrame:
    many, sel = F.col("distinct_values") > 1, F.col("selected")
    return audit.levels(
        facts(spark, sf).drop(*G),
        [[], ["policy"], ["fact_family"]],
        groups=F.count("*"),
        selected=F.count_if(sel),
        conflicts=F.count_if(many),
        resolved_conflicts=F.count_if(many & sel),
        single_unselected=F.count_if(~many & ~sel),
        statements=F.sum("statements"),
    )


@query(
    "a08_coverage_report",
    VIEWS + "SELECT subject_kind, count(DISTINCT subject_key) AS subjects, count(*) AS groups, CAST(sum(statements) AS BIGINT) AS statements, count(*) FILTER (distinct_values > 1) AS conflicts, count(*) FILTER (distinct_values > 1 AND NOT selected) AS unresolved FROM facts GROUP BY ROLLUP (subject_kind)",
)
def a08(spark: SparkSession, sf: str) -> DataFrame:
    many = F.col("distinct_values") > 1
    return facts(spark, sf).rollup("subject_kind").agg(
        F.count_distinct("subject_key").alias("subjects"), F.count("fact_key").alias("groups"), F.sum("statements").alias("statements"), F.count_if(many).alias("conflicts"), F.count_if(many & ~F.col("selected")).alias("unresolved")
    )


@query("a09_conflict_listing", b.with_views("evid") + _RES + " SELECT e.subject_key, e.family, e.item_id, e.source_key, e.slot, e.value, coalesce(e.source_key = r.rank AND e.value = r.value, false) AS selected FROM evid e JOIN resolution r USING (subject_key, family, item_id) WHERE r.conflict")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    r = resolution(spark, sf).filter("conflict").select(*EK, F.col("rank").alias("_rank"), F.col("value").alias("_value"))
    selected = F.coalesce((F.col("source_key") == F.col("_rank")) & (F.col("value") == F.col("_value")), F.lit(False))
    return b.evid(spark, sf).join(r, EK).select(*EK, "source_key", "slot", "value", selected.alias("selected"))


_BATCH = ", batches AS (SELECT source_key, revision, CASE WHEN max(seq) % 7 = 0 THEN 'failed' WHEN max(seq) % 5 = 0 THEN 'partial' ELSE 'imported' END AS status FROM obs GROUP BY ALL)"


@query("a05_batch_statuses", VIEWS + _BATCH + f", u AS (SELECT o.* FROM obs o JOIN facts f USING ({KEYS}) WHERE NOT f.selected AND f.distinct_values = 1) SELECT status, count(DISTINCT (subject_key, fact_key)) AS groups, count(DISTINCT seq) AS statements, count(DISTINCT (source_key, revision)) AS batches FROM u JOIN batches USING (source_key, revision) GROUP BY status")
def a05_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Unselected facts by the status of the batches that state them."""
    last = F.max("seq")
    status = F.when(last % 7 == 0, "failed").when(last % 5 == 0, "partial").otherwise("imported").alias("status")
    batches = b.obs(spark, sf).groupBy("source_key", "revision").agg(status)
    rows = b.obs(spark, sf).join(audit.unselected(facts(spark, sf)).select(*G), G, "left_semi").join(batches, ["source_key", "revision"])
    return rows.groupBy("status").agg(F.count_distinct("subject_key", "fact_key").alias("groups"), F.count_distinct("seq").alias("statements"), F.count_distinct("source_key", "revision").alias("batches"))


@query("a07_selected_sources", VIEWS + f"SELECT o.source_key, count(*) AS selected, count(*) FILTER (f.distinct_values > 1) AS resolved_conflicts, count(*) FILTER (f.policy = 'custom') AS custom, CAST(sum(f.statements) AS BIGINT) AS statements FROM facts f JOIN selections s USING ({KEYS}) JOIN obs o USING ({KEYS}) WHERE o.seq = s.seq GROUP BY o.source_key")
def a07_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The resolution report by the source of the selected statement."""
    source = b.selections(spark, sf).select(*G, "seq").join(b.obs(spark, sf).select(*G, "seq", "source_key"), [*G, "seq"])
    rows = facts(spark, sf).join(source, G)
    return rows.groupBy("source_key").agg(F.count("*").alias("selected"), F.count_if(F.col("distinct_values") > 1).alias("resolved_conflicts"), F.count_if(F.col("policy") == "custom").alias("custom"), F.sum("statements").alias("statements"))
