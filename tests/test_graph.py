from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import graph as g


def serial_components(edges):
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def reach(start, links):
        seen, todo = {start}, [start]
        while todo:
            for n in links.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    found = {}
    for n in {x for e in edges for x in e}:
        part = reach(n, out) & reach(n, back)
        if len(part) > 1:
            found[n] = min(part)
    return found


def test_strong_components_match_a_serial_form(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(16)}
    got = {r.node: r.component for r in g.strong_components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == serial_components(edges)


@pytest.mark.parametrize("seed", [2, 3])
def test_long_and_nested_cycles_match_a_serial_form(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(1000), 80)
    edges = set(zip(names[:40], names[1:40] + names[:1]))  # one long cycle in any order of ids
    edges |= {(rng.choice(names), rng.choice(names[40:])) for _ in range(60)} | {(names[50], names[3])}
    got = {r.node: r.component for r in g.strong_components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == serial_components(edges)


def test_no_cycle_no_component_and_self_loops_apart(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "a long, b long")
    assert g.strong_components(edges).count() == 0
    assert [r.node for r in g.self_loops(edges).collect()] == [3]


def test_traversal_lists_edges_to_seen_nodes_and_marks_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "a long, b long")
    nodes, links = g.traverse(edges, spark.createDataFrame([(1,)], "root long"), 5, 500)
    assert {(r.node, r.depth) for r in nodes.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {(r.a, r.b): r.cycle for r in links.collect()} == {(1, 2): False, (1, 3): False, (2, 4): False, (3, 4): False, (4, 1): True}


def test_node_budget_follows_visiting_order(spark):
    edges = spark.createDataFrame([(1, 5), (1, 2), (1, 9)], "a long, b long")
    nodes, _ = g.traverse(edges, spark.createDataFrame([(1,)], "root long"), 3, 3)
    assert {r.node for r in nodes.collect()} == {1, 2, 5}


def test_limits_are_checked(spark):
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(ValueError):
        g.traverse(edges, edges.selectExpr("a as root"), 21, 10)
    with pytest.raises(ValueError):
        g.traverse(edges, edges.selectExpr("a as root"), 2, 10, direction="sideways")


def serial_walk(edges, root, depth, budget, known=None):
    """Breadth-first with a queue: nodes by depth, and links with their depth and whether they close a cycle."""
    out = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    nodes, links, queue = {root: 0}, set(), [(root, 0, (root,))]
    while queue:
        a, d, path = queue.pop(0)
        if d == depth:
            continue
        for b in out.get(a, ()):
            links.add((a, b, d + 1, b in path))
            if b not in nodes and len(nodes) < budget and (known is None or b in known):
                nodes[b] = d + 1
                queue.append((b, d + 1, (*path, b)))
    return nodes, links


@pytest.mark.parametrize(("seed", "budget", "direction"), [(4, 500, "prerequisite"), (5, 9, "prerequisite"), (6, 12, "follow_up")])
def test_traversal_matches_a_serial_form(spark, seed, budget, direction):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(0, k) for k in range(30, 60)]  # with loops, repeats and a hub
    roots, known = list(range(0, 30, 3)), set(range(60)) - {7, 11, 35}
    table = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")
    for given in (None, known):
        some = None if given is None else spark.createDataFrame([(k,) for k in given], "node long")
        nodes, links = g.traverse(table, spark.createDataFrame([(r,) for r in [*roots, roots[0]]], "root long"), 4, budget, direction, some)
        ways = edges if direction == "prerequisite" else [(b, a) for a, b in edges]
        plain = {r: serial_walk(ways, r, 4, budget, given) for r in roots}
        assert sorted(map(tuple, nodes.collect())) == sorted((r, n, d) for r, (ns, _) in plain.items() for n, d in ns.items())
        assert sorted((x.root, x.a, x.b, x.depth, x.cycle) for x in links.collect()) == sorted((r, *x) for r, (_, ls) in plain.items() for x in ls)


def test_a_hub_hands_on_no_more_than_the_budget(spark):
    edges = spark.range(2, 200_002).selectExpr("1L as a", "id as b")
    nodes, _ = g.traverse(edges, spark.createDataFrame([(1,)], "root long"), 1, 50)
    assert {r.node for r in nodes.collect()} == set(range(1, 51))


@pytest.mark.parametrize("weak", [False, True])
def test_sets_are_told_apart_also_where_their_marks_are_alike(spark, monkeypatch, weak):
    if weak:
        monkeypatch.setattr(g, "_mark", lambda member: [F.count("*").alias("_n"), F.lit(0).alias("_h"), F.lit(0).alias("_g")])
    rng = random.Random(7)
    sets = {o: frozenset(rng.choices([*range(6), None], k=3)) for o in range(12)}
    rows = spark.createDataFrame([(o, m) for o, ms in sets.items() for m in ms] * 2, "o long, m long")
    named = {r.o: r["class"] for r in g.set_classes(rows, "o", "m").collect()}
    assert all((named[a] == named[b]) == (sets[a] == sets[b]) for a in sets for b in sets)
    want = {(min(o, m), max(o, m)) for o, ms in sets.items() for m in ms - {None} if o != m and sets[o] != sets[m]}
    assert sorted(map(tuple, g.group_consistency(rows, "o", "m").collect())) == sorted(want)


def test_large_sets_are_not_carried_by_the_pairs(spark):
    rows = spark.range(2_000).selectExpr("id % 20 as o", "id div 20 as m")
    found = g.group_consistency(rows.union(spark.range(1).selectExpr("7L as o", "999L as m")), "o", "m")
    assert "collect_set" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(min(7, o), max(7, o)) for o in range(20) if o != 7]


def test_components_send_no_sets_of_nodes_through_the_driver(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4)], "a long, b long")
    for found in (g.strong_components(edges), g.cyclic_core(edges)):
        assert found.count() == 2
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    asked = g.settle(edges)
    assert "Broadcast" not in asked.join(g._by_shuffle(g.settle(edges)), "a", "left_semi")._jdf.queryExecution().executedPlan().toString()


def test_links_need_one_join_and_walks_may_be_settled_in_between(spark, monkeypatch):
    monkeypatch.setattr(g, "AT_A_TIME", 2)
    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    for depth in (6, 5):
        nodes, links = g.traverse(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(r,) for r in range(5)], "root long"), depth, 500)
        assert links._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
        plain = {r: serial_walk(edges, r, depth, 500) for r in range(5)}
        assert sorted(map(tuple, nodes.collect())) == sorted((r, n, d) for r, (ns, _) in plain.items() for n, d in ns.items())
        assert sorted((x.root, x.a, x.b, x.depth, x.cycle) for x in links.collect()) == sorted((r, *x) for r, (_, ls) in plain.items() for x in ls)


@pytest.mark.parametrize(("seed", "budget", "direction"), [(9, 500, "prerequisite"), (10, 6, "prerequisite"), (11, 9, "follow_up")])
def test_flags_found_while_walking_are_those_of_nodes_and_links(spark, seed, budget, direction):
    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(40)] + [(0, k) for k in range(30, 45)] + [(40, 0)]  # a hub with a cycle beyond the budget
    edges, roots = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(r,) for r in range(0, 46, 3)], "root long")
    known, partial = (spark.createDataFrame([(k,) for k in range(50) if k % m], "node long") for m in (7, 2))
    got = g.walk_flags(edges, roots, 3, budget, known, partial, direction)
    want = g.traversal_flags(*g.traverse(edges, roots, 3, budget, direction), edges, 3, known, partial, direction)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
