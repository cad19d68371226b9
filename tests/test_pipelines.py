from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import pipelines


def test_member_sets_follow_their_owners_and_a_second_pass_does_nothing(spark):
    wanted = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (1, "b", 99), (1, "n", None), (2, "c", 10), (3, "d", 10), (None, "e", 10)], "k long, m string, t long")
    stored = spark.createDataFrame([(1, "a", False), (1, "x", False), (1, "y", True), (2, "z", False), (3, "d", False), (3, "v", True), (3, "v", False)], "k long, m string, custom boolean")
    owners, targets = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(10,), (10,)], "t long")
    step = lambda held: pipelines.reconcile_members(wanted, held, owners, targets, ["k", "m"], "t", F.col("k") != 2)
    members, did = step(stored)
    # b and n have no target, d and e no owner; 2's set is partial, so z stays; 3 is gone, and its custom member stays
    assert {(r.k, r.m, r.custom) for r in members.collect()} == {(1, "a", False), (1, "y", True), (2, "c", False), (2, "z", False), (3, "v", True)}
    assert {(r.step, r.action): r.n for r in did.collect()} == {
        ("resolve", "resolved"): 2, ("resolve", "no_target"): 2, ("resolve", "no_owner"): 2,
        ("members", "keep"): 1, ("members", "insert"): 1, ("members", "protected"): 2, ("members", "kept_partial"): 1, ("members", "delete"): 2,
    }
    again, did = step(members)
    assert not {r.action for r in did.filter("step = 'members'").collect()} & {"insert", "delete"} and again.exceptAll(members).count() == members.exceptAll(again).count() == 0
    empty = step(stored.limit(0))[0]
    assert {(r.k, r.m) for r in empty.collect()} == {(1, "a"), (2, "c")}


def test_dependants_hold_back_deletes_until_nothing_refers_to_them(spark):
    keys = lambda *k: spark.createDataFrame([(x, f"n{x}") for x in k], "k long, name string")
    member = "owner long, family string, target long"
    wanted = spark.createDataFrame([(1, "before", 2), (1, "before", 2), (1, "before", 1), (1, "before", 7), (1, "item", 50), (2, "other", 1), (9, "before", 1), (None, "item", 50), (2, "item", None), (2, "item", 50)], member)
    stored = [(1, "before", 7, True), (7, "before", 2, False), (8, "item", 51, True), (8, "item", 50, False), (2, "before", 1, False), (1, "item", 52, False)]
    stored = spark.createDataFrame(stored, member + ", custom boolean")
    states, gone = {"quests": keys(1, 2), "items": keys(50)}, {"quests": keys(7, 8, 10), "items": keys(51, 52)}
    step = lambda held, s=states, g=gone, whole=F.col("owner") != 2: pipelines.reconcile_dependants(
        s, g, "k", {"links": pipelines.Members(wanted, held, "quests", {"before": "quests", "item": "items"}, whole)}
    )
    once = step(stored)
    assert {tuple(r) for r in once.members["links"].collect()} == {
        (1, "before", 2, False), (1, "item", 50, False), (2, "item", 50, False), (1, "before", 7, True), (8, "item", 51, True), (2, "before", 1, False),
    }
    assert {(r.owner, r.family, r.target, r.reason) for r in once.unresolved.collect()} == {
        (1, "before", 1, "self"), (1, "before", 7, "no_target"), (2, "other", 1, "no_target"), (9, "before", 1, "no_owner"), (None, "item", 50, "no_owner"), (2, "item", None, "no_target"),
    }
    # a custom member refers to 7, and 8 has one that refers to item 51; nothing holds 10 and 52
    assert {n: {tuple(r) for r in d.collect()} for n, d in once.held.items()} == {"quests": {(7, "n7"), (8, "n8")}, "items": {(51, "n51")}}
    twice = step(once.members["links"], g=once.held)
    assert not {r.action for r in twice.summary.collect()} & {"insert", "delete", "deleted"}
    assert all(twice.held[n].exceptAll(once.held[n]).isEmpty() and once.held[n].exceptAll(twice.held[n]).isEmpty() for n in once.held)

    loops = pipelines.Members(wanted, stored.limit(0), "quests", {"before": "quests"}, F.lit(True), loops=True)
    assert not loops.wanted.isEmpty() and "self" not in {r.reason for r in pipelines.reconcile_dependants(states, gone, "k", {"links": loops}).unresolved.collect()}
    empty = step(stored.limit(0), {n: d.limit(0) for n, d in states.items()}, {n: d.limit(0) for n, d in gone.items()})
    assert empty.members["links"].isEmpty() and {r.reason for r in empty.unresolved.collect()} == {"no_owner"}


def test_the_state_alone_is_that_of_the_whole_pass_and_sets_are_read_once(spark, monkeypatch):
    from factweave.plans import domains

    first = domains.first_pass(spark, "/root/testdata/sf0.001", "items")
    args = (first.base, first.patch, "k", first.after, F.col("k") % 8 == 0)
    assert sorted(map(tuple, pipelines.domain_state(*args).collect())) == sorted(map(tuple, pipelines.reconcile_domain(*args)[0].state.collect()))
    _, _, stored = domains._steps(spark, "/root/testdata/sf0.001", ("quest_items",))
    assert all("round-" in f and "lineitem" not in f for rows in stored.values() for f in rows.inputFiles())
