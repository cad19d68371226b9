"""The world, its items and its quests reconciled from end to end, twice."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import pipelines
from factweave.plans.registry import query
from factweave.sources import bindings as b
from factweave.sources.rounds import settle

#: View, key and two fields of each domain. Kinds of entities have ids of their own, so a world key tells them apart.
DOMAINS = {"world": ("entities", "id * 2 + CASE WHEN kind = 'creature' THEN 0 ELSE 1 END", "name", "kind"), "items": ("items", "item_id", "name", "item_id % 100"), "quests": ("quests", "quest_id", "title", "level")}


def _passes(n: int, statements: str, selections: str, state: str) -> str:
    """One pass over the desired rows ``des``: recorded, picked, wanted and synced."""
    return f""", inc{n} AS (SELECT k, 'f1' AS field, f1 AS value FROM des WHERE f1 IS NOT NULL UNION ALL SELECT k, 'f2', f2 FROM des WHERE f2 IS NOT NULL),
  rec{n} AS (SELECT i.*, CASE WHEN s.k IS NULL THEN 'new' ELSE 'known' END AS action FROM inc{n} i LEFT JOIN (SELECT DISTINCT k, field, value FROM {statements}) s USING (k, field, value)),
  pick{n} AS (SELECT i.k, i.field, CASE WHEN o.policy = 'custom' THEN o.value ELSE i.value END AS value, coalesce(o.policy, 'managed') AS policy, CASE WHEN o.policy IS NULL THEN 'selected' WHEN o.policy = 'custom' THEN 'protected' WHEN o.value = i.value THEN 'unchanged' ELSE 'replaced' END AS action FROM inc{n} i LEFT JOIN {selections} o USING (k, field)),
  want{n} AS (SELECT k, max(value) FILTER (field = 'f1') AS f1, max(value) FILTER (field = 'f2') AS f2 FROM pick{n} GROUP BY k),
  sync{n} AS (SELECT coalesce(w.k, h.k) AS k, w.f1 AS w1, w.f2 AS w2, h.f1 AS h1, h.f2 AS h2, CASE WHEN h.k IS NULL THEN 'insert' WHEN w.k IS NOT NULL AND w.f1 IS NOT DISTINCT FROM h.f1 AND w.f2 IS NOT DISTINCT FROM h.f2 THEN 'unchanged' WHEN h.k % 8 = 0 THEN 'protected' WHEN w.k IS NULL THEN 'delete' ELSE 'update' END AS action FROM want{n} w FULL JOIN {state} h ON w.k = h.k)"""


def _sql(view: str, key: str, first: str, second: str, dependants: str = "") -> str:
    """Both passes in SQL: everything is text, keyed by ``k``; with ``dependants``, what these make of the state in place of the passes' summary."""
    one = f"SELECT DISTINCT {key} AS k, CAST({first} AS VARCHAR) AS f1, CAST({second} AS VARCHAR) AS f2 FROM {view}"

    sums = " UNION ALL ".join(f"SELECT {n} AS pass, '{step}' AS step, action, count(*) AS n FROM {t}{n} GROUP BY action" for n in (1, 2) for step, t in (("record", "rec"), ("select", "pick"), ("sync", "sync")))
    return (
        b.with_views(view)
        + f""", rw AS ({one}), des AS (SELECT coalesce(p.k, x.k) AS k, CASE WHEN p.k IS NULL THEN x.f1 ELSE p.f1 END AS f1, CASE WHEN p.k IS NULL THEN x.f2 ELSE p.f2 END AS f2
    FROM (SELECT * FROM rw WHERE k % 7 <> 0) x FULL JOIN (SELECT k, CASE WHEN k % 3 = 0 THEN f1 || '!' ELSE f1 END AS f1, f2, k % 11 = 0 AS gone FROM rw WHERE k % 5 = 0) p ON x.k = p.k WHERE NOT coalesce(p.gone, false)),
  st0 AS (SELECT k, 'f1' AS field, f1 AS value FROM rw WHERE k % 4 = 0 AND f1 IS NOT NULL), se0 AS (SELECT k, 'f1' AS field, f1 AS value, CASE WHEN k % 9 = 0 THEN 'custom' ELSE 'managed' END AS policy FROM rw WHERE k % 2 = 0 AND f1 IS NOT NULL), cu0 AS (SELECT * FROM rw WHERE k % 3 <> 0)"""
        + _passes(1, "st0", "se0", "cu0")
        + ", st1 AS (SELECT k, field, value FROM st0 UNION SELECT k, field, value FROM inc1), se1 AS (SELECT k, field, value, policy FROM pick1), cu1 AS (SELECT k, CASE WHEN action IN ('insert', 'update') THEN w1 ELSE h1 END AS f1, CASE WHEN action IN ('insert', 'update') THEN w2 ELSE h2 END AS f2 FROM sync1 WHERE action <> 'delete')"
        + (dependants or _passes(2, "st1", "se1", "cu1") + " " + sums)
    )


class Pass(NamedTuple):
    """The overlay's base and patch, the rows stored before, what the first pass leaves, and its summary."""

    base: DataFrame
    patch: DataFrame
    before: DataFrame
    after: pipelines.Domain
    did: DataFrame


def first_pass(spark: SparkSession, sf: str, name: str) -> Pass:
    view, key, first, second = DOMAINS[name]
    rows = getattr(b, view)(spark, sf)
    rows = rows.select(F.expr(key).alias("k"), F.expr(first).cast("string").alias("f1"), F.expr(second).cast("string").alias("f2"))
    rows = settle(rows.distinct())  # base, patch and stored state all start from it
    base = rows.filter("k % 7 <> 0")
    patch = rows.filter("k % 5 = 0").withColumn("tombstone", F.col("k") % 11 == 0).withColumn("f1", F.when(F.col("k") % 3 == 0, F.concat("f1", F.lit("!"))).otherwise(F.col("f1")))
    fact = rows.filter("f1 is not null").select("k", F.lit("f1").alias("field"), F.col("f1").alias("value"))
    policy = F.when(F.col("k") % 9 == 0, "custom").otherwise("managed").alias("policy")
    stored = pipelines.Domain(fact.filter("k % 4 = 0"), fact.filter("k % 2 = 0").select("k", "field", "value", policy), rows.filter("k % 3 <> 0"))
    once, did = pipelines.reconcile_domain(base, patch, "k", stored, F.col("k") % 8 == 0)
    return Pass(base, patch, stored.state, once, did)


def run(spark: SparkSession, sf: str, name: str) -> DataFrame:
    base, patch, _, once, did = first_pass(spark, sf, name)
    again = pipelines.reconcile_domain(base, patch, "k", once, F.col("k") % 8 == 0)[1]
    return did.withColumn("pass", F.lit(1)).unionByName(again.withColumn("pass", F.lit(2)))


@query("m09_world_pipeline", _sql(*DOMAINS["world"]))
def m09_world(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, "world")


@query("m09_items_pipeline", _sql(*DOMAINS["items"]))
def m09_items(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, "items")


@query("m09_quests_pipeline", _sql(*DOMAINS["quests"]))
def m09_quests(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, "quests")


def _members_sql() -> str:
    view, key, *_ = DOMAINS["world"]
    one = lambda n, stored: f""", fnd{n} AS (SELECT w.*, CASE WHEN w.k NOT IN (SELECT k FROM cu1) THEN 'no_owner' WHEN w.zone_id % 11 = 4 THEN 'no_target' ELSE 'resolved' END AS action FROM wanted w),
  mem{n} AS (SELECT coalesce(w.k, h.k) AS k, coalesce(w.spawn_key, h.spawn_key) AS spawn_key, coalesce(h.custom, false) AS custom, CASE WHEN h.k IS NULL THEN 'insert' WHEN w.k IS NOT NULL THEN 'keep' WHEN h.custom THEN 'protected'
    WHEN h.k IN (SELECT k FROM cu1) AND h.k % 6 = 1 THEN 'kept_partial' ELSE 'delete' END AS action FROM (SELECT DISTINCT k, spawn_key FROM fnd{n} WHERE action = 'resolved') w FULL JOIN {stored} h ON w.k = h.k AND w.spawn_key = h.spawn_key)"""  # noqa: E731
    keyed = f""", keyed AS (SELECT DISTINCT {key} AS k, spawn_key, zone_id FROM spawn_keys), wanted AS (SELECT * FROM keyed WHERE zone_id % 5 <> 0),
  mem0 AS (SELECT k, spawn_key, bool_or(k % 9 = 0) AS custom FROM keyed WHERE zone_id % 3 <> 0 GROUP BY k, spawn_key)"""
    sums = " UNION ALL ".join(f"SELECT {n} AS pass, '{step}' AS step, action, count(*) AS n FROM {t}{n} GROUP BY action" for n in (1, 2) for step, t in (("resolve", "fnd"), ("members", "mem")))
    dependants = keyed + one(1, "mem0") + ", kept1 AS (SELECT k, spawn_key, custom FROM mem1 WHERE action <> 'delete')" + one(2, "kept1") + " " + sums
    return _sql(*DOMAINS["world"], dependants).replace(b.with_views(view), b.with_views("entities", "spawn_keys"))


@query("m09_world_members", _members_sql())
def m09_members(spark: SparkSession, sf: str) -> DataFrame:
    """Spawns of the reconciled world, twice; zones that can't be resolved are marked by their number."""
    owners = first_pass(spark, sf, "world").after.state
    rows = b.spawn_keys(spark, sf).select(F.expr(DOMAINS["world"][1]).alias("k"), "spawn_key", "zone_id")
    wanted = rows.filter("zone_id % 5 <> 0")
    zones = rows.filter("zone_id % 11 <> 4").select("zone_id")
    stored = rows.filter("zone_id % 3 <> 0").select("k", "spawn_key", (F.col("k") % 9 == 0).alias("custom"))
    step = lambda held: pipelines.reconcile_members(wanted, held, owners, zones, ["k", "spawn_key"], "zone_id", F.col("k") % 6 != 1)
    once, did = step(stored)
    return did.withColumn("pass", F.lit(1)).unionByName(step(once)[1].withColumn("pass", F.lit(2)))


#: Dependants of quests: the owners' domain, the targets' domain of each family, the members (SQL and DataFrame), which sets are whole.
STEPS = {
    "progression": ("quests", {"prerequisite": "quests", "close": "quests"}, "SELECT DISTINCT a AS owner, CASE WHEN b % 3 = 0 THEN 'close' ELSE 'prerequisite' END AS family, b AS target FROM edges", "owner % 6 <> 1"),
    "objectives": (
        "quests", {"creature": "world", "item": "items"},
        "SELECT quest_id AS owner, 'item' AS family, item_id AS target FROM objectives UNION SELECT quest_id, 'creature', creature_id * 2 FROM objectives", "family = 'item' OR owner % 6 <> 1",
    ),
    "quest_items": ("items", {"objective": "quests"}, "SELECT DISTINCT item_id AS owner, 'objective' AS family, quest_id AS target FROM objectives", "owner % 4 = 0"),
}
_NAMES = r"\b(rw|des|(?:st|se|cu|inc|rec|pick|want|sync)[0-9])\b"


def _needed(names: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(d for n in names for d in (STEPS[n][0], *STEPS[n][1].values())))


def _steps_sql(names: tuple[str, ...], result: str) -> str:
    """Both passes of the domains that ``names`` need and of their dependants, in SQL, and then ``result``."""
    prefixed = lambda d, sql: re.sub(_NAMES, rf"{d}_\1", sql)
    domains = _needed(names)
    views = b.with_views(*[DOMAINS[d][0] for d in domains], *(("edges",) if "progression" in names else ()), *(("objectives",) if set(names) - {"progression"} else ()))
    out = [views]
    for d in domains:
        out.append(prefixed(d, _sql(*DOMAINS[d], " ").replace(b.with_views(DOMAINS[d][0]), "").rstrip()))
        out.append(f", {d}_gone1 AS (SELECT * FROM {d}_cu0 WHERE k NOT IN (SELECT k FROM {d}_cu1))")
    for n in names:
        out.append(f", {n}_all AS ({STEPS[n][2]}), {n}_w AS (SELECT * FROM {n}_all WHERE (owner + target) % 5 <> 0), {n}_m0 AS (SELECT *, (owner + target) % 9 = 0 AS custom FROM {n}_all WHERE target % 3 <> 1)")
    for p in (1, 2):
        if p == 2:
            for d in domains:
                out.append(f", {d}_kept1 AS (SELECT * FROM {d}_cu1 UNION ALL SELECT * FROM {d}_held1)" + prefixed(d, _passes(2, "st1", "se1", f"{d}_kept1")))
                out.append(prefixed(d, ", cu2 AS (SELECT k, CASE WHEN action IN ('insert', 'update') THEN w1 ELSE h1 END AS f1, CASE WHEN action IN ('insert', 'update') THEN w2 ELSE h2 END AS f2 FROM sync2 WHERE action <> 'delete')"))
                out.append(f", {d}_gone2 AS (SELECT * FROM {d}_kept1 WHERE k NOT IN (SELECT k FROM {d}_cu2))")
        for n in names:
            owners, refers, _, whole = STEPS[n]
            there = " OR ".join(f"(family = '{f}' AND target IN (SELECT k FROM {d}_cu{p}))" for f, d in refers.items())
            loop = "WHEN owner = target THEN 'self'" if owners in refers.values() else ""
            out.append(f""", {n}_f{p} AS (SELECT *, CASE WHEN owner NOT IN (SELECT k FROM {owners}_cu{p}) THEN 'no_owner' {loop} WHEN NOT ({there}) THEN 'no_target' ELSE 'resolved' END AS action FROM {n}_w),
  {n}_y{p} AS (SELECT owner, family, target, coalesce(h.custom, false) AS custom, CASE WHEN h.custom IS NULL THEN 'insert' WHEN w.wanted THEN 'keep' WHEN h.custom THEN 'protected'
    WHEN owner IN (SELECT k FROM {owners}_cu{p}) AND NOT ({whole}) THEN 'kept_partial' ELSE 'delete' END AS action
    FROM (SELECT owner, family, target, true AS wanted FROM {n}_f{p} WHERE action = 'resolved') w FULL JOIN {n}_m{p - 1} h USING (owner, family, target)),
  {n}_m{p} AS (SELECT owner, family, target, custom FROM {n}_y{p} WHERE action <> 'delete')""")
        for d in domains:
            used = [f"SELECT owner FROM {n}_m{p}" for n in names if STEPS[n][0] == d] + [f"SELECT target FROM {n}_m{p} WHERE family = '{f}'" for n in names for f, t in STEPS[n][1].items() if t == d]
            out.append(f", {d}_held{p} AS (SELECT * FROM {d}_gone{p} WHERE k IN ({' UNION '.join(used)}))")
    return "".join(out) + " " + result


def _steps_summary(names: tuple[str, ...]) -> str:
    parts = [f"SELECT {p} AS pass, '{n}:{step}' AS step, family, action, count(*) AS n FROM {n}_{t}{p} GROUP BY family, action" for p in (1, 2) for n in names for step, t in (("resolve", "f"), ("members", "y"))]
    parts += [f"SELECT {p}, '{d}:guard', NULL, CASE WHEN k IN (SELECT k FROM {d}_held{p}) THEN 'held' ELSE 'deleted' END AS action, count(*) FROM {d}_gone{p} GROUP BY action" for p in (1, 2) for d in _needed(names)]
    return " UNION ALL ".join(parts)


def _steps(spark: SparkSession, sf: str, names: tuple[str, ...]):
    """A function of (domains by name with what they held before, stored sets) that reconciles the dependants ``names``, and its first arguments."""
    domains = {d: first_pass(spark, sf, d) for d in _needed(names)}
    member = lambda o, f, t: F.struct(F.col(o).cast("long").alias("owner"), f.alias("family"), t.cast("long").alias("target"))

    def rows(name: str) -> DataFrame:
        if name == "progression":
            parts = [member("a", F.when(F.col("b") % 3 == 0, "close").otherwise("prerequisite"), F.col("b"))]
        elif name == "objectives":
            parts = [member("quest_id", F.lit("item"), F.col("item_id")), member("quest_id", F.lit("creature"), F.col("creature_id") * 2)]
        else:
            parts = [member("item_id", F.lit("objective"), F.col("quest_id"))]
        return (b.edges if name == "progression" else b.objectives)(spark, sf).select(F.inline(F.array(*parts))).distinct()

    sets = {n: settle(rows(n)) for n in names}  # both passes read what is wanted and what is stored from it
    stored = {n: r.filter("target % 3 <> 1").withColumn("custom", (F.col("owner") + F.col("target")) % 9 == 0) for n, r in sets.items()}

    def step(after: dict[str, DataFrame], before: dict[str, DataFrame], held: dict[str, DataFrame]) -> pipelines.Dependants:
        gone = {d: before[d].join(after[d], "k", "left_anti") for d in domains}
        todo = {n: pipelines.Members(sets[n].filter("(owner + target) % 5 <> 0"), held[n], STEPS[n][0], STEPS[n][1], F.expr(STEPS[n][3])) for n in names}
        return pipelines.reconcile_dependants(after, gone, "k", todo)

    return step, domains, stored


def run_steps(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """What both passes did: resolved and unresolved members, changes of the sets by family, and which deletes of the domains were held back."""
    step, domains, stored = _steps(spark, sf, names)
    once = step({d: x.after.state for d, x in domains.items()}, {d: x.before for d, x in domains.items()}, stored)
    kept = {d: x.after.state.unionByName(once.held[d]) for d, x in domains.items()}
    again = {d: pipelines.domain_state(x.base, x.patch, "k", pipelines.Domain(x.after.statements, x.after.selections, kept[d]), F.col("k") % 8 == 0) for d, x in domains.items()}
    twice = step(again, kept, once.members)
    return once.summary.withColumn("pass", F.lit(1)).unionByName(twice.summary.withColumn("pass", F.lit(2)))


@query("m09_progression_pipeline", _steps_sql(("progression",), _steps_summary(("progression",))))
def m09_progression(spark: SparkSession, sf: str) -> DataFrame:
    return run_steps(spark, sf, "progression")


@query("m09_objectives_pipeline", _steps_sql(("objectives",), _steps_summary(("objectives",))))
def m09_objectives(spark: SparkSession, sf: str) -> DataFrame:
    return run_steps(spark, sf, "objectives")


@query("m09_quest_items_pipeline", _steps_sql(("quest_items",), _steps_summary(("quest_items",))))
def m09_quest_items(spark: SparkSession, sf: str) -> DataFrame:
    return run_steps(spark, sf, "quest_items")


_UNRESOLVED = " UNION ALL ".join(f"SELECT '{n}' AS step, owner, family, target, action AS reason FROM {n}_f1 WHERE action <> 'resolved'" for n in STEPS)


@query("m09_quest_unresolved", _steps_sql(tuple(STEPS), _UNRESOLVED))
def m09_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    """Every wanted member of the three families that has no place, with its reason."""
    step, domains, stored = _steps(spark, sf, tuple(STEPS))
    return step({d: x.after.state for d, x in domains.items()}, {d: x.before for d, x in domains.items()}, stored).unresolved
