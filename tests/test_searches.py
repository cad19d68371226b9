"""Searches with parameters: what they refuse, and how each kind of filter answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factweave.operators import searches as s
from factweave.sources import tables

ALL = ("known_match", "known_non_match", "unknown")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Copper Ring"), (2, "iron RING"), (3, None), (4, "Cloak")], "item_id long, name string")


@pytest.fixture(scope="module")
def templates(spark):
    rest = ", ".join(f"{r}_resistance int" for r in s.RESISTANCES)
    schema = f"item_id long, quality int, class_id int, subclass_id int, inventory_type int, item_level int, required_level int, armor int, max_durability int, {rest}, stats array<struct<type: int, value: int>>"
    return spark.createDataFrame(
        [(1, 2, 4, 0, 11, 10, 5, 0, None, 0, 0, 0, 0, 0, 0, [(3, 7), (4, 1)]), (4, 3, 4, 1, 16, 40, None, 12, 30, 0, 5, 0, 0, 0, 0, [])], schema
    )


def states(page, key="item_id"):
    return {r[key]: r.state for r in page.rows.collect()}


def test_items_have_three_answers_and_are_counted_whole(items, templates):
    page = s.query_items(items, templates, name_contains=" ring ", quality=2, wanted=s.Wanted(ALL))
    assert states(page) == {1: "known_match", 2: "unknown", 3: "unknown", 4: "known_non_match"}
    assert {r.state: r.n for r in page.summary.collect()} == {"known_match": 1, "unknown": 2, "known_non_match": 1}
    first = page.rows.filter("item_id = 1").first()
    assert [(p.predicate, p.state, p.actual, p.reason) for p in first.predicates] == [("name~ring", "known_match", "Copper Ring", None), ("quality=2", "known_match", "2", None)]
    only = s.query_items(items, templates, name_contains="ring", quality=2)
    assert states(only) == {1: "known_match"} and only.summary.count() == 3


@pytest.mark.parametrize(
    "filters, matching",
    [
        ({"item_id": 4}, {4}), ({"class_id": 4}, {1, 4}), ({"subclass_id": 1}, {4}), ({"inventory_type": 11}, {1}), ({"min_item_level": 10, "max_item_level": 20}, {1}), ({"max_required_level": 9}, {1}),
        ({"min_required_level": 0}, {1}), ({"min_armor": 1}, {4}), ({"min_max_durability": 30}, {4}), ({"min_fire_resistance": 5}, {4}), ({"min_stats": {3: 7}}, {1}), ({"min_stats": {3: 7, 4: 2}}, set()), ({}, {1, 2, 3, 4}),
    ],
)
def test_each_item_filter(items, templates, filters, matching):
    assert set(states(s.query_items(items, templates, **filters))) == matching


def test_selected_facts_come_with_the_page_only(spark, items, templates):
    facts = spark.createDataFrame([(1, "b", 2, 0, "managed"), (1, "a", 1, 0, "custom"), (4, "a", 9, 1, "managed")], "item_id long, fact_key string, value long, source_key long, policy string")
    rows = s.query_items(items, templates, facts=facts, name_contains="ring", wanted=s.Wanted(ALL[:1] + ALL[2:])).rows.collect()
    assert {r.item_id: r.facts and [f.fact_key for f in r.facts] for r in rows} == {1: ["a", "b"], 2: None, 3: None}
    assert {r.item_id: r.coverage for r in rows} == {1: "complete", 2: "no_template", 3: "no_template"}


@pytest.mark.parametrize(
    "filters, error",
    [
        ({"quality": -1}, ValueError), ({"quality": True}, TypeError), ({"quality": "2"}, TypeError), ({"item_id": 0}, ValueError), ({"name_contains": "  "}, ValueError), ({"name_contains": 5}, TypeError),
        ({"min_item_level": 9, "max_item_level": 8}, ValueError), ({"min_stats": {-1: 2}}, ValueError), ({"min_stats": {1: "2"}}, TypeError), ({"no_such": 1}, TypeError),
        ({"wanted": s.Wanted(limit=0)}, ValueError), ({"wanted": s.Wanted(limit=1001)}, ValueError), ({"wanted": s.Wanted(limit=True)}, TypeError), ({"wanted": s.Wanted("known_match")}, TypeError),
        ({"wanted": s.Wanted(())}, ValueError), ({"wanted": s.Wanted(("maybe",))}, ValueError), ({"wanted": s.Wanted(sort_by="colour")}, ValueError), ({"wanted": s.Wanted(descending=1)}, TypeError),
    ],
)
def test_bad_filters_are_refused_before_any_job(items, templates, filters, error):
    with pytest.raises(error):
        s.query_items(items, templates, **filters)


def test_pages_put_unknown_keys_last_in_both_directions(items, templates):
    order = lambda down: [r.item_id for r in s.query_items(items, templates, wanted=s.Wanted(ALL, "required_level", down)).rows.orderBy("position").collect()]
    assert order(False) == [1, 2, 3, 4] and order(True) == [1, 2, 3, 4]
    assert [r.item_id for r in s.query_items(items, templates, wanted=s.Wanted(ALL, "item_level", True, 2)).rows.orderBy("position").collect()] == [4, 1]


def test_templates_need_every_bound(templates):
    found = lambda **k: [r.item_id for r in s.query_item_templates(templates, **k).collect()]
    assert found() == [4, 1] and found(max_required_level=5) == [1] and found(min_stats={3: 1, 4: 1}) == [1] and found(inventory_type=16, limit=1) == [4]
    with pytest.raises(ValueError):
        found(limit=0)


def test_acquisitions_need_one_source_and_one_path(spark, items, templates):
    path = "array<struct<family: string, reference_id: int, chance: double, max_count: long>>"
    sources = spark.createDataFrame(
        [(1, "creature", 7, 3, 1, [("direct", None, 5.0, None), ("vendor", None, None, 3)]), (1, "object", 8, 4, 1, [("reference", 2, 50.0, None)]), (2, "creature", 9, None, None, [("direct", None, 90.0, None)])],
        f"item_id long, source_kind string, source_id long, zone_id int, map_id int, paths {path}",
    )
    ask = lambda **k: states(s.query_item_acquisitions(items, templates, sources, **k))
    assert set(ask(path_kinds=["direct"])) == {1, 2} and set(ask(zone_id=3, min_drop_chance=4)) == {1} and ask(zone_id=3, min_drop_chance=10) == {}
    assert set(ask(source_kinds=["object"], path_kinds=["reference"], map_id=1)) == {1} and ask(source_kinds=["object"], path_kinds=["direct"]) == {}
    assert states(s.query_item_acquisitions(items, templates, sources, zone_id=4, wanted=s.Wanted(ALL))) == {1: "known_match", 2: "unknown", 3: "unknown", 4: "unknown"}
    for bad in ({"path_kinds": "direct"}, {"path_kinds": ["gift"]}, {"source_kinds": []}, {"min_drop_chance": 101}, {"zone_id": -1}):
        with pytest.raises((TypeError, ValueError)):
            ask(**bad)


def test_places_of_entities_may_prove_a_non_match(spark):
    entities = spark.createDataFrame([("creature", 1, "Wolf"), ("creature", 2, "Bear"), ("object", 1, "Chest"), ("object", 3, "Post")], "kind string, id long, name string")
    spawns = spark.createDataFrame([("creature", 1, "a", 5), ("creature", 1, "b", 6), ("creature", 2, "c", 6), ("object", 1, "d", None), ("object", 4, "e", 6), ("object", 5, "g", 6)], "kind string, id long, spawn_key string, zone_id int")
    entities = entities.unionByName(spark.createDataFrame([("object", 4, "Other"), ("object", 5, "Twice"), ("object", 6, "Empty")], entities.schema))
    declared = spark.createDataFrame([("creature", 1), ("creature", 2), ("object", 1), ("object", 4), ("object", 5), ("object", 6)], "kind string, id long")
    selected = spark.createDataFrame([("creature", 1, "a"), ("creature", 1, "b"), ("creature", 2, "c"), ("object", 1, "d"), ("object", 4, "f"), ("object", 5, "g"), ("object", 5, "g")], "kind string, id long, spawn_key string")
    zones = spark.createDataFrame([(5, 1), (6, None)], "zone_id int, map_id int")
    page = lambda **k: s.query_world_entities(entities, spawns, declared, selected, zones, wanted=s.Wanted(ALL), **k).rows.collect()
    ask = lambda **k: {(r.entity_kind, r.entity_id): r.state for r in page(**k)}
    assert ask(zone_id=5) == {("creature", 1): "known_match", ("creature", 2): "known_non_match", ("object", 1): "unknown", ("object", 3): "unknown", ("object", 4): "unknown", ("object", 5): "known_non_match", ("object", 6): "known_non_match"}
    why = lambda **k: {(r.entity_kind, r.entity_id): r.predicates[0].reason for r in page(**k)}
    assert why(zone_id=5) == {
        ("creature", 1): "known_matching_spawn", ("creature", 2): "complete_spawn_set_proves_no_match", ("object", 1): "spawn_with_unresolved_zone", ("object", 3): "no_selected_spawn_set",
        ("object", 4): "selected_spawn_set_differs_from_stored_spawns", ("object", 5): "complete_spawn_set_proves_no_match", ("object", 6): "complete_spawn_set_proves_no_match",
    }
    assert ask(map_id=2)[("creature", 2)] == "unknown" and ask(map_id=2)[("creature", 1)] == "unknown" and why(map_id=2)[("creature", 2)] == "spawn_with_unresolved_map"
    assert ask(entity_kind="object", zone_id=5)[("creature", 1)] == "known_non_match" and ask(name_contains="WOLF")[("creature", 1)] == "known_match"
    with pytest.raises(ValueError):
        ask(entity_kind="plant")


def test_quests_by_levels_and_places(spark):
    quests = spark.createDataFrame([(1, "Red", 10, 5), (2, "Blue", None, 5), (3, "Redder", 20, None)], "quest_id long, title string, level int, minimum_level int")
    ends = spark.createDataFrame([(1, "given", 5, 1), (1, "given", 6, 2), (1, "objective", 7, 2), (3, "finished", 5, 1)], "quest_id long, role string, zone_id int, map_id int")
    ask = lambda **k: states(s.query_quests(quests, ends, wanted=s.Wanted(ALL), **k), "quest_id")
    assert ask(min_level=10, max_level=15) == {1: "known_match", 2: "unknown", 3: "known_non_match"}
    assert ask(giver_zone_id=5, giver_map_id=1)[1] == "known_match" and ask(giver_zone_id=5, giver_map_id=2)[1] == "unknown"
    assert ask(finisher_zone_id=5) == {1: "unknown", 2: "unknown", 3: "known_match"} and ask(title_contains="red", min_minimum_level=1) == {1: "known_match", 2: "known_non_match", 3: "unknown"}
    assert ask(objective_map_id=2)[1] == "known_match" and ask(quest_id=2) == {1: "known_non_match", 2: "known_match", 3: "known_non_match"}


def test_recipes_by_skill_items_and_ways_to_learn(spark):
    recipes = spark.createDataFrame([(1, "Stew"), (2, None), (3, "Bread")], "recipe_id long, name string")
    skills = spark.createDataFrame([(1, 7, "Cooking", 10), (1, 8, "Baking", 90), (2, 9, None, 10)], "recipe_id long, skill_line_id int, skill string, required int")
    outputs, reagents = (spark.createDataFrame(d, "recipe_id long, item_id long") for d in ([(1, 50)], [(1, 7), (1, None), (3, None)]))
    learned = spark.createDataFrame([(1, "trainer", None, 5, 1), (1, "quest", "given", 6, 2), (3, "item", None, 5, None)], "recipe_id long, kind string, role string, zone_id int, map_id int")
    ask = lambda **k: states(s.query_recipes(recipes, skills, outputs, reagents, learned, wanted=s.Wanted(ALL), **k), "recipe_id")
    assert ask(skill="cooking", max_required=20) == {1: "known_match", 2: "unknown", 3: "unknown"} and ask(skill="cooking", min_required=50) == {1: "known_non_match", 2: "known_non_match", 3: "unknown"}
    assert ask(skill="OOK", max_required=20)[1] == "known_match" and ask(skill_line_id=8) == {1: "known_match", 2: "known_non_match", 3: "unknown"} and ask(skill_line_id=8, skill="cook")[1] == "known_non_match" and ask(skill_line_id=9, skill="cook")[2] == "unknown"
    assert ask(output_item_id=50) == {1: "known_match", 2: "known_non_match", 3: "known_non_match"} and ask(output_item_id=51)[1] == "known_non_match"
    assert ask(reagent_item_id=7)[1] == "known_match" and ask(reagent_item_id=8) == {1: "known_non_match", 2: "known_non_match", 3: "known_non_match"}
    assert ask(learning_kinds=["trainer"]) == {1: "known_match", 2: "unknown", 3: "unknown"} and ask(trainer_zone_id=5, trainer_map_id=1)[1] == "known_match"
    assert ask(quest_giver_zone_id=6)[1] == "known_match" and ask(quest_finisher_zone_id=6)[1] == "unknown" and ask(teaching_zone_id=5)[3] == "known_match" and ask(teaching_map_id=1)[3] == "unknown"
    assert ask(name_contains="st") == {1: "known_match", 2: "unknown", 3: "known_non_match"}
    with pytest.raises(ValueError):
        ask(learning_kinds=["luck"])


def test_zones_without_a_known_map(spark):
    zones = spark.createDataFrame([(1, "North", 9), (2, "South", 3), (3, "Nook", None)], "zone_id int, zone_name string, map_id int")
    maps = spark.createDataFrame([(3, "Old World")], "map_id int, map_name string")
    ask = lambda **k: states(s.query_zones(zones, maps, wanted=s.Wanted(ALL), **k), "zone_id")
    assert ask(map_id=3) == {1: "unknown", 2: "known_match", 3: "unknown"} and ask(name_contains="no", map_name_contains="WORLD") == {1: "unknown", 2: "known_non_match", 3: "unknown"}


def test_separators_are_plain_and_quotes_hold_them(spark):
    lines = spark.createDataFrame([('1|"a|b"|2|3|4',), ("1|a|2|3|4|5",), ('1|"say ""x"""|2|3|',), ("",), (None,)], "line string")
    out = tables.typed_lines(lines, "line", separator="|").collect()
    assert [(r.family, r.slot, r.reject) for r in out[:3]] == [("a|b", 4, None), (out[1].family, out[1].slot, "field_count"), ('say "x"', None, None)]
    assert [r.reject for r in out[3:]] == ["field_count", "field_count"]


def test_null_and_empty_identity_parts_are_two_statements(spark):
    from factweave.operators.evidence import ingest

    schema = "k string, raw string, seq long"
    new = spark.createDataFrame([("a", None, 2), ("a", "", 3), ("a", "", 4)], schema)
    first = ingest(spark.createDataFrame([], schema), new, ["k", "raw"], "seq")
    assert sorted((r.raw is None, r.seq) for r in first.collect()) == [(False, 3), (True, 2)]
    assert ingest(first, new, ["k", "raw"], "seq").count() == 0


def test_fallback_needs_agreeing_attributes(spark):
    from factweave.operators.selection import unique_fallback

    facts = spark.createDataFrame([(10, "x", "t", 1), (11, "y", "t", 2), (12, "z", "u", None)], "fact long, key string, target string, rank int")
    wanted = spark.createDataFrame([("x", "t", 1), ("q", "t", 2), ("q", "t", None), ("q", "u", 5), ("q", "v", 1)], "key string, target string, rank int")
    out = {(r.key, r.target, r["rank"]): (r.fact, r.how) for r in unique_fallback(wanted, facts, ["key"], ["target"], "fact", ("rank",)).collect()}
    assert out == {("x", "t", 1): (10, "exact"), ("q", "t", 2): (11, "unique_target"), ("q", "t", None): (None, "ambiguous"), ("q", "u", 5): (12, "unique_target"), ("q", "v", 1): (None, "none")}


def test_budget_and_open_ends_are_flagged(spark):
    from factweave.operators import graph as g

    edges = spark.createDataFrame([(1, 5), (1, 2), (1, 9), (2, 1)], "a long, b long")
    known = spark.createDataFrame([(1,), (2,), (5,)], "node long")
    nodes, links = g.traverse(edges, spark.createDataFrame([(1,)], "root long"), 3, 3)
    row = g.traversal_flags(nodes, links, edges, 3, known=known, partial=known.filter("node = 2")).first()
    assert (row.nodes, row.ambiguous, row.cycle, row.truncated_by_budget, row.truncated_by_depth, row.unresolved, row.incomplete) == (3, True, True, True, False, True, True)


@pytest.mark.parametrize("queued, retry, want", [(9, 3, {("retryable", 1), ("queued", 3)}), (9, 0, {("queued", 4)}), (0, 9, {("retryable", 4)}), (2, 1, {("retryable", 1), ("queued", 2)})])
def test_next_batch_spreads_by_state(spark, queued, retry, want):
    from factweave.operators.coverage import next_batch

    rows = [(k, "queued") for k in range(queued)] + [(100 + k, "retryable") for k in range(retry)] + [(500, "terminal")]
    out = next_batch(spark.createDataFrame(rows, "item long, state string"), "item", "state", 4)
    assert {(r.part, r.n) for r in out.groupBy("part").agg(F.count("*").alias("n")).collect()} == want
    if retry and queued:
        assert out.filter("part = 'retryable'").first().item == 100 + (retry - 1) // 2


def test_zone_inspection_limits_and_says_so(spark):
    from factweave.operators.details import inspect_zones

    zones = spark.createDataFrame([(1, "North"), (2, "South"), (3, "Empty")], "zone_id int, zone_name string")
    spawns = spark.createDataFrame([("creature", k, 1) for k in range(5)] + [("creature", 0, 1), ("object", 9, 2), ("creature", 4, None)], "kind string, id long, zone_id int")
    loot = spark.createDataFrame([(0, 50, "direct", None, 5, None), (0, 50, "vendor", None, None, 3), (1, 50, "vendor", None, None, 1), (4, 51, "direct", None, 1, None)], "source_id long, item_id long, family string, reference_id int, chance int, max_count int")
    ends = spark.createDataFrame([(7, "given", "creature", 0), (7, "given", "creature", 1), (8, "finished", "object", 9), (9, "given", "creature", 4)], "quest_id long, role string, kind string, id long")
    trainers = spark.createDataFrame([(0, 100, True), (1, 101, False), (1, 102, False)], "trainer_id long, recipe_id long, known boolean")
    evidence = spark.createDataFrame([(1, "creature", 0, 100, "trainer"), (1, "creature", 1, 100, "item"), (1, "creature", 1, 101, "item"), (1, "creature", 4, 103, "item")], "zone_id int, kind string, id long, recipe_id long, evidence string")
    found = inspect_zones(zones, spawns, loot, ends, trainers, evidence, entity_limit=2, recipe_limit=1)
    row = {r.zone_id: r for r in found.coverage.collect()}
    assert (row[1].entities_total, row[1].entities, row[1].items, row[1].quests, row[1].vendors, row[1].trainers, row[1].recipes_shown, row[1].entities_truncated, row[1].recipes_truncated) == (5, 2, 1, 1, 2, 2, 2, True, True)
    assert (row[3].entities, row[3].entities_truncated, row[3].recipes_truncated) == (0, False, False)
    assert [(p.source_id, p.family) for p in found.items.first().paths] == [(0, "direct"), (0, "vendor"), (1, "vendor")]
    assert {(r.trainer_id, r.state): r.recipes for r in found.trainers.collect()} == {(0, "known"): [100], (1, "unresolved"): [101, 102]}
    assert [(r.recipe_id, r.evidence) for r in found.recipes.collect()] == [(100, ["item", "trainer"])]
    bare = inspect_zones(zones.filter("zone_id = 2"), spawns, loot, ends, trainers, None)
    assert bare.recipes is None and [(r.zone_id, r.quests, r.recipes_truncated) for r in bare.coverage.collect()] == [(2, 1, None)]
    for limits in ({"entity_limit": 0}, {"recipe_limit": 1001}):
        with pytest.raises(ValueError):
            inspect_zones(zones, spawns, loot, ends, trainers, None, **limits)


def test_names_are_in_order_of_their_lower_case(spark):
    quests = spark.createDataFrame([(1, "b"), (2, "C"), (3, "A"), (4, None), (5, "B")], "quest_id long, title string").selectExpr("*", "1 as level", "1 as minimum_level")
    ends = spark.createDataFrame([], "quest_id long, role string, zone_id int, map_id int")
    order = lambda down: [r.quest_id for r in s.query_quests(quests, ends, wanted=s.Wanted(ALL, "title", down)).rows.orderBy("position").collect()]
    assert order(False) == [3, 1, 5, 2, 4] and order(True) == [2, 5, 1, 3, 4]


def test_unplaced_sources_of_an_item_stay_a_way_to_learn(spark, monkeypatch):
    from factweave.plans import searches as plans

    tables_of = {
        "teaching": spark.createDataFrame([("item", 7, 70), ("item", 8, 80), ("item", 9, 90)], "kind string, source_id long, recipe_id long"),
        "loot": spark.createDataFrame([(7, 1), (7, 2), (8, 1), (9, 2)], "item_id long, source_id long"),
    }
    for name, rows in tables_of.items():
        monkeypatch.setattr(plans.b, name, lambda *_, rows=rows: rows)
    monkeypatch.setattr(plans, "places", lambda *_: spark.createDataFrame([(1, 5, 3)], "source_id long, zone_id int, map_id int"))
    monkeypatch.setattr(plans, "ends_at", lambda *_: spark.createDataFrame([], "quest_id long, role string, zone_id int, map_id int"))
    found = {(r.recipe_id, r.zone_id, r.map_id) for r in plans.learned(spark, "").collect()}
    assert found == {(70, 5, 3), (70, None, None), (80, 5, 3), (90, None, None)}
