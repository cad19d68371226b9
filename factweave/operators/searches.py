"""Searches with parameters: each filter that is asked for is judged with three answers, counted, paged and traced.

Every search takes DataFrames and keyword filters, checks the filters before any job runs, and gives a
``Page``: counts by state over all rows, and the wanted rows with their state and the record of each
filter. Filters are boolean columns, so nothing is evaluated row by row outside the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import tristate as ts
from factweave.operators import entities as en
from factweave.operators import search as paging

STATES = (ts.MATCH, ts.NON_MATCH, ts.UNKNOWN)
PATH_KINDS = ("direct", "reference", "vendor")
LEARNING_KINDS = ("item", "trainer", "quest")
ENTITY_KINDS = ("creature", "object")
RESISTANCES = ("holy", "fire", "nature", "frost", "shadow", "arcane")


@dataclass(frozen=True)
class Page:
    """``summary(state, n)`` over all rows, and the page's ``rows`` with ``position``, ``state`` and ``predicates``."""

    summary: DataFrame
    rows: DataFrame


@dataclass(frozen=True)
class Asked:
    """A filter that was asked for: its label, its answer (null: unknown) and what was found."""

    label: str
    answer: Column
    actual: Column
    reason: str | Column = "no value known"

    def record(self) -> Column:
        reason = self.reason if isinstance(self.reason, Column) else F.when(self.answer.isNull(), F.lit(self.reason))
        return F.struct(F.lit(self.label).alias("predicate"), ts.state(self.answer).alias("state"), self.actual.cast("string").alias("actual"), reason.alias("reason"))


# -- checks ----------------------------------------------------------------------------------------


def whole(name: str, value, least: int = 0) -> None:
    if value is None:
        return
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be a whole number")
    if value < least:
        raise ValueError(f"{name} must be {least} or more")


def text(name: str, value: str | None) -> str | None:
    if value is None:
        return None
    if not isinstance(value, str):
        raise TypeError(f"{name} must be text")
    if not value.strip():
        raise ValueError(f"{name} must not be blank")
    return value.strip()


def bounds(name: str, low, high, least: int = 0) -> None:
    whole(f"min_{name}", low, least)
    whole(f"max_{name}", high, least)
    if low is not None and high is not None and low > high:
        raise ValueError(f"min_{name} must not be above max_{name}")


def some_of(name: str, value: Sequence[str] | None, known: Sequence[str]) -> tuple[str, ...] | None:
    """``value`` in the order of ``known``; a bare text, none at all or an unknown name is an error."""
    if value is None:
        return None
    if isinstance(value, str):
        raise TypeError(f"{name} must be a list of texts")
    if not value or not set(value) <= set(known):
        raise ValueError(f"{name} must be some of {', '.join(known)}")
    return tuple(k for k in known if k in value)


def minima(min_stats: Mapping[int, int] | None) -> list[tuple[int, int]]:
    for kind, least in (min_stats or {}).items():
        whole("a stat's type", kind)
        if isinstance(least, bool) or not isinstance(least, int):
            raise TypeError("a stat's minimum must be a whole number")
    return sorted((min_stats or {}).items())


@dataclass(frozen=True)
class Wanted:
    """Which rows a page shows: states, order and number."""

    include_states: Sequence[str] = (ts.MATCH,)
    sort_by: str | None = None
    descending: bool = False
    limit: int = 100

    def check(self, fields: Sequence[str]) -> None:
        some_of("include_states", self.include_states, STATES)
        if self.sort_by is not None and self.sort_by not in fields:
            raise ValueError(f"rows are sorted by one of {', '.join(fields)}")
        if not isinstance(self.descending, bool):
            raise TypeError("descending must be true or false")
        whole("limit", self.limit, 1)
        if self.limit > 1000:
            raise ValueError("limit must be 1000 or less")


def paged(rows: DataFrame, asked: list[Asked], wanted: Wanted, fields: Sequence[str], tie: Sequence[str]) -> Page:
    """Judge all rows by all filters; count; then filter by state, sort (texts by their lower case, unknown keys last) and limit."""
    none = F.array().cast("array<struct<predicate: string, state: string, actual: string, reason: string>>")
    judged = paging.judge(rows, [a.answer for a in asked]).withColumn("predicates", F.array(*[a.record() for a in asked]) if asked else none)
    tied = F.struct(*tie) if len(tie) > 1 else F.col(tie[0])
    found = judged.filter(F.col("state").isin(*wanted.include_states))
    by = wanted.sort_by or fields[0]
    page = paging.page(found, F.lower(by) if dict(rows.dtypes)[by] == "string" else F.col(by), tied, wanted.limit, wanted.descending)
    return Page(paging.summary(judged), page.drop("ok"))


def _equal(label: str, column: str, value) -> list[Asked]:
    return [] if value is None else [Asked(f"{label}={value}", ts.equals(F.col(column), value), F.col(column))]


def _least(label: str, column: str, value) -> list[Asked]:
    return [] if value is None else [Asked(f"{label}>={value}", ts.at_least(F.col(column), value), F.col(column))]


def _most(label: str, column: str, value) -> list[Asked]:
    return [] if value is None else [Asked(f"{label}<={value}", ts.at_most(F.col(column), value), F.col(column))]


def _contains(label: str, column: str, value: str | None) -> list[Asked]:
    return [] if value is None else [Asked(f"{label}~{value}", ts.contains(F.col(column), value), F.col(column))]


def _placed(role: str, zone_id: int | None, map_id: int | None, column: str) -> list[Asked]:
    """A place that proves a match if one row of ``column`` (locations) has both zone and map; its absence proves nothing."""
    if zone_id is None and map_id is None:
        return []
    label = ",".join(f"{role}_{k}={v}" for k, v in (("zone", zone_id), ("map", map_id)) if v is not None)
    return [Asked(label, ts.positive_only(F.exists(column, lambda p: in_place(p["zone_id"], p["map_id"], zone_id, map_id))), F.size(column), "no location shows it")]


def in_place(zone: Column, map_: Column, zone_id: int | None, map_id: int | None) -> Column:
    tests = [F.coalesce(c == v, F.lit(False)) for c, v in ((zone, zone_id), (map_, map_id)) if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def stat_is(kind: int, least: int) -> Callable[[Column], Column]:
    return lambda s: (s["type"] == kind) & (s["value"] >= least)


# -- searches --------------------------------------------------------------------------------------

ZONE_FIELDS = ("zone_id", "zone_name", "map_id")


def query_zones(zones: DataFrame, maps: DataFrame, *, zone_id: int | None = None, name_contains: str | None = None, map_id: int | None = None, map_name_contains: str | None = None, wanted: Wanted = Wanted()) -> Page:
    """``zones(zone_id, zone_name, map_id)`` with ``maps(map_id, map_name)``; a zone without a known map leaves the map's filters unknown."""
    for name, value in (("zone_id", zone_id), ("map_id", map_id)):
        whole(name, value)
    name_contains, map_name_contains = text("name_contains", name_contains), text("map_name_contains", map_name_contains)
    wanted.check(ZONE_FIELDS)
    rows = zones.join(maps.select("map_id", "map_name"), "map_id", "left").withColumn("known_map", F.when(F.col("map_name").isNotNull(), F.col("map_id")))
    asked = _equal("zone_id", "zone_id", zone_id) + _contains("name", "zone_name", name_contains) + _equal("map_id", "known_map", map_id) + _contains("map_name", "map_name", map_name_contains)
    return paged(rows, asked, wanted, ZONE_FIELDS, ["zone_id"])


ITEM_FIELDS = ("item_id", "name", "quality", "class_id", "subclass_id", "inventory_type", "item_level", "required_level", "armor", "max_durability")
_ITEM_EQUAL = ("item_id", "quality", "class_id", "subclass_id", "inventory_type")
_ITEM_RANGES = ("item_level", "required_level")
_ITEM_LEAST = ("armor", "max_durability", *(f"{r}_resistance" for r in RESISTANCES))


def item_filters(filters: dict) -> list[Asked]:
    """The filters of ``query_items`` over items joined with their templates; a missing template leaves its filters unknown."""
    known = {*_ITEM_EQUAL, "name_contains", "min_stats", *(f"{b}_{f}" for f in _ITEM_RANGES for b in ("min", "max")), *(f"min_{f}" for f in _ITEM_LEAST)}
    if not set(filters) <= known:
        raise TypeError(f"no such filter: {', '.join(sorted(set(filters) - known))}")
    get = filters.get
    for name in (*_ITEM_EQUAL, *(f"min_{f}" for f in _ITEM_LEAST)):
        whole(name, get(name), 1 if name == "item_id" else 0)
    for name in _ITEM_RANGES:
        bounds(name, get(f"min_{name}"), get(f"max_{name}"))
    asked = _equal("item_id", "item_id", get("item_id")) + _contains("name", "name", text("name_contains", get("name_contains")))
    for name in _ITEM_EQUAL[1:]:
        asked += _equal(name, name, get(name))
    for name in _ITEM_RANGES:
        asked += _least(name, name, get(f"min_{name}")) + _most(name, name, get(f"max_{name}"))
    for name in _ITEM_LEAST:
        asked += _least(name, name, get(f"min_{name}"))
    for kind, least in minima(get("min_stats")):
        asked.append(Asked(f"stat_{kind}>={least}", ts.any_element(F.col("stats"), stat_is(kind, least)), F.size("stats")))
    return asked


def query_items(items: DataFrame, templates: DataFrame, *, facts: DataFrame | None = None, wanted: Wanted = Wanted(), **filters) -> Page:
    """Items by name, scalar fields and stats: see ``item_filters`` for the keywords.

    ``facts(item_id, fact_key, value, source_key, policy)``, where given, adds each shown item's selected facts in
    order of their keys; only the page's items are looked up. ``coverage`` says whether a template is known.
    """
    asked = item_filters(filters)
    wanted.check(ITEM_FIELDS)
    rows = items.join(templates.withColumn("coverage", F.lit("complete")), "item_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit("no_template")))
    page = paged(rows, asked, wanted, ITEM_FIELDS, ["item_id"])
    if facts is None:
        return page
    trace = facts.join(F.broadcast(page.rows.select("item_id")), "item_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("fact_key", "value", "source_key", "policy"))).alias("facts"))  # a page's ids
    return Page(page.summary, page.rows.join(trace, "item_id", "left"))


def query_item_templates(templates: DataFrame, *, max_required_level: int | None = None, inventory_type: int | None = None, min_stats: Mapping[int, int] | None = None, limit: int = 100) -> DataFrame:
    """Templates that meet every bound (two answers only), by required level, item level and id."""
    whole("max_required_level", max_required_level)
    whole("inventory_type", inventory_type)
    Wanted(limit=limit).check(ITEM_FIELDS)
    rows = templates
    if max_required_level is not None:
        rows = rows.filter(F.col("required_level") <= max_required_level)
    if inventory_type is not None:
        rows = rows.filter(F.col("inventory_type") == inventory_type)
    for kind, least in minima(min_stats):
        rows = rows.filter(F.exists("stats", stat_is(kind, least)))
    return rows.orderBy("required_level", "item_level", "item_id").limit(limit)


def query_item_acquisitions(
    items: DataFrame, templates: DataFrame, sources: DataFrame, *, path_kinds: Sequence[str] | None = None, source_kinds: Sequence[str] | None = None, min_drop_chance: float | None = None,
    zone_id: int | None = None, map_id: int | None = None, wanted: Wanted = Wanted(), **filters,
) -> Page:
    """Items by where they come from, besides the filters of ``query_items``.

    ``sources(item_id, source_kind, source_id, zone_id, map_id, paths)``: one source must be of the asked kind and
    place and have one path of the asked kind and chance. No such source leaves the item unknown.
    ``matching_sources`` counts those that match, and ``matching`` lists them in order, for the page's items only.
    """
    asked = item_filters(filters)
    path_kinds, source_kinds = some_of("path_kinds", path_kinds, PATH_KINDS), some_of("source_kinds", source_kinds, ENTITY_KINDS)
    for name, value in (("zone_id", zone_id), ("map_id", map_id)):
        whole(name, value)
    if min_drop_chance is not None and (isinstance(min_drop_chance, bool) or not isinstance(min_drop_chance, (int, float)) or not 0 <= min_drop_chance <= 100):
        raise ValueError("min_drop_chance must be 0 to 100")
    wanted.check(ITEM_FIELDS)
    on_source = in_place(F.col("zone_id"), F.col("map_id"), zone_id, map_id)
    if source_kinds is not None:
        on_source = on_source & F.col("source_kind").isin(*source_kinds)

    def on_path(p: Column) -> Column:
        kind = p["family"].isin(*path_kinds) if path_kinds is not None else F.lit(True)
        return kind & F.coalesce(p["chance"] >= min_drop_chance, F.lit(False)) if min_drop_chance is not None else kind

    hit = sources.filter(on_source & F.exists("paths", on_path))
    rows = items.join(templates, "item_id", "left").join(hit.groupBy("item_id").agg(F.count("*").alias("matching_sources")), "item_id", "left")
    if not (path_kinds is None and source_kinds is None and min_drop_chance is None and zone_id is None and map_id is None):
        asked.append(Asked("acquisition", ts.positive_only(F.col("matching_sources").isNotNull()), F.col("matching_sources"), "no known source shows it"))
    page = paged(rows, asked, wanted, ITEM_FIELDS, ["item_id"])
    shown = F.broadcast(page.rows.select("item_id"))  # a page's ids
    lists = hit.join(shown, "item_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("source_kind", "source_id", "zone_id", "map_id", "paths"))).alias("matching"))
    return Page(page.summary, page.rows.join(lists, "item_id", "left"))


ENTITY_FIELDS = ("entity_id", "name", "entity_kind")


def query_world_entities(
    entities: DataFrame, spawns: DataFrame, declared: DataFrame, selected: DataFrame, zones: DataFrame, *, entity_kind: str | None = None, entity_id: int | None = None, name_contains: str | None = None,
    zone_id: int | None = None, map_id: int | None = None, wanted: Wanted = Wanted(),
) -> Page:
    """``entities(kind, id, name)`` by kind, id, name and place.

    A place is a match by any of ``spawns(kind, id, spawn_key, zone_id)``. It is a non-match only where a set is
    ``declared(kind, id)`` whose members ``selected(kind, id, spawn_key)`` are exactly the stored spawns, and each of
    these says where it is; otherwise it is unknown. The predicate's reason is one of ``entities.GEOGRAPHY_REASONS``.
    """
    if entity_kind is not None and entity_kind not in ENTITY_KINDS:
        raise ValueError(f"entity_kind is one of {', '.join(ENTITY_KINDS)}")
    for name, value in (("entity_id", entity_id), ("zone_id", zone_id), ("map_id", map_id)):
        whole(name, value, 1 if name == "entity_id" else 0)
    name_contains = text("name_contains", name_contains)
    wanted.check(ENTITY_FIELDS)
    rows = entities.select(F.col("kind").alias("entity_kind"), F.col("id").alias("entity_id"), "name")
    asked = _equal("entity_kind", "entity_kind", entity_kind) + _equal("entity_id", "entity_id", entity_id) + _contains("name", "name", name_contains)
    if zone_id is not None or map_id is not None:
        where = spawns.join(zones.select("zone_id", "map_id"), "zone_id", "left")
        lacks = lambda c, v: F.lit(False) if v is None else F.col(c).isNull()
        known = en.geography(where, declared, selected, in_place(F.col("zone_id"), F.col("map_id"), zone_id, map_id), lacks("zone_id", zone_id), lacks("map_id", map_id))
        known = known.select(F.col("kind").alias("entity_kind"), F.col("id").alias("entity_id"), F.col("answer").alias("_answer"), F.col("reason").alias("_reason"), F.col("spawns").alias("_spawns"))
        rows = rows.join(known, ["entity_kind", "entity_id"], "left")
        label = ",".join(f"{k}={v}" for k, v in (("zone_id", zone_id), ("map_id", map_id)) if v is not None)
        asked.append(Asked(label, F.col("_answer"), F.coalesce("_spawns", F.lit(0)), F.coalesce("_reason", F.lit(en.GEOGRAPHY_REASONS[1]))))
    page = paged(rows, asked, wanted, ENTITY_FIELDS, ["entity_id", "entity_kind"])
    return Page(page.summary, page.rows.drop("_answer", "_reason", "_spawns"))


QUEST_FIELDS = ("quest_id", "title", "level", "minimum_level")
ROLES = {"giver": "given", "finisher": "finished", "objective": "objective"}


def places_by_role(ends: DataFrame, key: str) -> DataFrame:
    """``ends(key, role, zone_id, map_id)`` as one row per key with an array of places for each role that occurs."""
    per = lambda role: F.collect_set(F.when((F.col("role") == role), F.struct("zone_id", "map_id"))).alias(f"{role}_places")
    return ends.groupBy(key).agg(*[per(r) for r in ROLES.values()])


def query_quests(
    quests: DataFrame, ends: DataFrame, *, quest_id: int | None = None, title_contains: str | None = None, min_level: int | None = None, max_level: int | None = None,
    min_minimum_level: int | None = None, max_minimum_level: int | None = None, giver_zone_id: int | None = None, giver_map_id: int | None = None, finisher_zone_id: int | None = None,
    finisher_map_id: int | None = None, objective_zone_id: int | None = None, objective_map_id: int | None = None, wanted: Wanted = Wanted(),
) -> Page:
    """``quests(quest_id, title, level, minimum_level)`` by title, levels and the places of those who give, finish or are its goal.

    ``ends(quest_id, role, zone_id, map_id)`` holds the places; zone and map must be on one row, and
    places only prove a match.
    """
    places = {"giver": (giver_zone_id, giver_map_id), "finisher": (finisher_zone_id, finisher_map_id), "objective": (objective_zone_id, objective_map_id)}
    whole("quest_id", quest_id, 1)
    for role, (zone, map_) in places.items():
        whole(f"{role}_zone_id", zone)
        whole(f"{role}_map_id", map_)
    bounds("level", min_level, max_level)
    bounds("minimum_level", min_minimum_level, max_minimum_level)
    title_contains = text("title_contains", title_contains)
    wanted.check(QUEST_FIELDS)
    asked = _equal("quest_id", "quest_id", quest_id) + _contains("title", "title", title_contains) + _least("level", "level", min_level) + _most("level", "level", max_level)
    asked += _least("minimum_level", "minimum_level", min_minimum_level) + _most("minimum_level", "minimum_level", max_minimum_level)
    rows = quests
    if any(v is not None for pair in places.values() for v in pair):
        rows = rows.join(places_by_role(ends, "quest_id"), "quest_id", "left")
        for role, (zone, map_) in places.items():
            asked += _placed(role, zone, map_, f"{ROLES[role]}_places")
    return paged(rows, asked, wanted, QUEST_FIELDS, ["quest_id"])


RECIPE_FIELDS = ("recipe_id", "name")


def query_recipes(
    recipes: DataFrame, skills: DataFrame, outputs: DataFrame, reagents: DataFrame, learned: DataFrame, *, recipe_id: int | None = None, name_contains: str | None = None, skill: str | None = None, skill_line_id: int | None = None,
    min_required: int | None = None, max_required: int | None = None, output_item_id: int | None = None, reagent_item_id: int | None = None, learning_kinds: Sequence[str] | None = None,
    teaching_zone_id: int | None = None, teaching_map_id: int | None = None, trainer_zone_id: int | None = None, trainer_map_id: int | None = None, quest_giver_zone_id: int | None = None,
    quest_giver_map_id: int | None = None, quest_finisher_zone_id: int | None = None, quest_finisher_map_id: int | None = None, quest_objective_zone_id: int | None = None,
    quest_objective_map_id: int | None = None, wanted: Wanted = Wanted(),
) -> Page:
    """``recipes(recipe_id, name)`` by what they need and make, and where they are taught.

    One row of ``skills(recipe_id, skill_line_id, skill, required)`` must pass all of the skill's filters (``skill`` is a part of its name): it is a
    match, unknown if only rows without a skill's name could pass, and unknown without rows. ``outputs`` and ``reagents``
    ``(recipe_id, item_id)`` are known whole, so a recipe without the item is a non-match. ``learned(recipe_id, kind, role, zone_id, map_id)``
    tells ways to learn it and their places; like every place, they only prove a match.
    """
    places = {"teaching": (teaching_zone_id, teaching_map_id, "item", None), "trainer": (trainer_zone_id, trainer_map_id, "trainer", None)}
    places |= {f"quest_{r}": (z, m, "quest", ROLES[r]) for r, z, m in (("giver", quest_giver_zone_id, quest_giver_map_id), ("finisher", quest_finisher_zone_id, quest_finisher_map_id), ("objective", quest_objective_zone_id, quest_objective_map_id))}
    for name, value in (("recipe_id", recipe_id), ("skill_line_id", skill_line_id), ("output_item_id", output_item_id), ("reagent_item_id", reagent_item_id)):
        whole(name, value, 1)
    for role, (zone, map_, _, _) in places.items():
        whole(f"{role}_zone_id", zone)
        whole(f"{role}_map_id", map_)
    bounds("required", min_required, max_required)
    name_contains, skill = text("name_contains", name_contains), text("skill", skill)
    learning_kinds = some_of("learning_kinds", learning_kinds, LEARNING_KINDS)
    wanted.check(RECIPE_FIELDS)
    rows, asked = recipes, _equal("recipe_id", "recipe_id", recipe_id) + _contains("name", "name", name_contains)
    if skill is not None or skill_line_id is not None or min_required is not None or max_required is not None:
        named = F.lit(True) if skill is None else F.lower("skill").contains(skill.lower())
        if skill_line_id is not None:
            named = named & (F.col("skill_line_id") == skill_line_id)
        rest = F.lit(True) if min_required is None else F.col("required") >= min_required
        rest = rest if max_required is None else rest & (F.col("required") <= max_required)
        passes = named & rest
        per = skills.groupBy("recipe_id").agg(F.bool_or(F.coalesce(passes, F.lit(False))).alias("_hit"), F.bool_or(passes.isNull()).alias("_maybe"))
        rows = rows.join(per, "recipe_id", "left")
        label = ",".join(x for x in (skill_line_id is not None and f"skill_line_id={skill_line_id}", skill and f"skill~{skill}", min_required is not None and f"required>={min_required}", max_required is not None and f"required<={max_required}") if x)
        asked.append(Asked(label, F.when(F.col("_hit"), True).when(~F.col("_maybe"), False), F.col("_hit"), "no skill of a known name"))
    for name, item, of in (("output", output_item_id, outputs), ("reagent", reagent_item_id, reagents)):
        if item is not None:
            per = of.filter(F.col("item_id") == item).select("recipe_id").distinct().withColumn(f"_{name}", F.lit(True))
            rows = rows.join(per, "recipe_id", "left")
            known = F.coalesce(f"_{name}", F.lit(False))
            asked.append(Asked(f"{name}={item}", known, known))
    tests: list[tuple[str, Column, str]] = []
    if learning_kinds is not None:
        tests.append((f"learned_by={'|'.join(learning_kinds)}", F.col("kind").isin(*learning_kinds), "no way of this kind known"))
    for role, (zone, map_, kind, of_role) in places.items():
        if zone is not None or map_ is not None:
            here = (F.col("kind") == kind) & in_place(F.col("zone_id"), F.col("map_id"), zone, map_)
            label = ",".join(f"{role}_{k}={v}" for k, v in (("zone", zone), ("map", map_)) if v is not None)
            tests.append((label, here if of_role is None else here & (F.col("role") == of_role), "no location shows it"))
    if tests:
        per = learned.groupBy("recipe_id").agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(f"_t{k}") for k, (_, t, _) in enumerate(tests)])
        rows = rows.join(per, "recipe_id", "left")
        asked += [Asked(label, ts.positive_only(F.col(f"_t{k}")), F.col(f"_t{k}"), reason) for k, (label, _, reason) in enumerate(tests)]
    return paged(rows, asked, wanted, RECIPE_FIELDS, ["recipe_id"])


def find_world_locations(entities: DataFrame, spawns: DataFrame, zones: DataFrame, maps: DataFrame, name: str) -> DataFrame:
    """Where things whose name holds ``name`` (upper and lower case alike) are."""
    name = text("name", name)
    return en.located(entities.filter(F.lower("name").contains(name.lower())).join(spawns, ["kind", "id"]), zones, maps)


def predicates_text(predicates: Column) -> Column:
    return F.array_join(F.transform(predicates, lambda p: F.concat_ws(":", p["predicate"], p["state"])), ";")
