from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from factweave.operators import compose, coverage, evidence, reconcile, selection, versions
from factweave.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlay_replaces_whole_entries_and_tombstones_delete(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id long, name string, v long")
    patch = spark.createDataFrame([(2, None, 21, False), (3, "x", 0, True), (4, "d", 40, None)], "id long, name string, v long, tombstone boolean")
    assert {r.id: (r.name, r.v) for r in compose.overlay(base, patch, "id").collect()} == {1: ("a", 10), 2: (None, 21), 4: ("d", 40)}


def test_reconcile_twice_changes_nothing_and_protects(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    patch = spark.createDataFrame([(2, "B", False), (3, "c", False)], "id long, name string, tombstone boolean")
    current = spark.createDataFrame([(2, "old"), (8, "mine"), (9, "gone")], "id long, name string")
    actions, state = reconcile.reconcile(base, patch, current, "id", F.col("id") == 8)
    assert rows(actions) == [(1, "insert"), (2, "update"), (3, "insert"), (8, "protected"), (9, "delete")]
    again, same = reconcile.reconcile(base, patch, state, "id", F.col("id") == 8)
    assert {r.action for r in again.collect()} == {"unchanged", "protected"} and rows(same) == rows(state)


def test_ingest_is_idempotent_with_null_identity_parts(spark):
    schema = "k string, raw string, seq long"
    stored = spark.createDataFrame([("a", None, 1)], schema)
    new = spark.createDataFrame([("a", None, 2), ("b", None, 4), ("b", None, 3), ("a", "x", 5)], schema)
    first = evidence.ingest(stored, new, ["k", "raw"], "seq")
    assert {(r.k, r.raw, r.seq) for r in first.collect()} == {("b", None, 3), ("a", "x", 5)}
    assert evidence.ingest(stored.unionByName(first), new, ["k", "raw"], "seq").count() == 0


def test_content_revision_ignores_order_but_not_values(spark):
    def revision(data):
        return evidence.content_revision(spark.createDataFrame(data, "k long, v string"), "k", ["k", "v"], per_bucket=2).first().revision

    a = [(1, "x"), (2, None), (3, "")]
    assert revision(a) == revision(a[::-1]) != revision([(1, "x"), (2, ""), (3, "")])


def test_content_revision_of_two_levels_does_not_depend_on_the_range_of_keys(spark):
    from hashlib import sha256

    sha = lambda text: sha256(text.encode()).hexdigest()
    keys = [-3, 0, 1, 5, 6, 40, 41]
    hashed = {k: sha(f"{k}|v{k}") for k in keys}
    buckets = {b: sha(",".join(f"{k}:{hashed[k]}" for k in keys if k // 2 == b)) for b in sorted({k // 2 for k in keys})}
    rows = spark.createDataFrame([(k, f"v{k}") for k in reversed(keys)] + [(None, "lost")], "k long, v string")
    found = evidence.content_revision(rows, "k", ["k", "v"], per_bucket=2, levels=2).first()
    assert (found.records, found.revision) == (8, sha(",".join(f"{b}:{h}" for b, h in buckets.items())))


def test_canonical_json_sorts_keys(spark):
    out = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": [1, 2]}}',)], "j string").select(evidence.canonical_json(F.col("j"))).first()[0]
    assert out == '{"a":{"c":[1,2],"d":2},"b":1}'


def test_ranked_resolution_has_no_winner_among_equals(spark):
    ev = spark.createDataFrame([(1, 3, 7), (1, 3, 8), (1, 2, 7), (2, 3, 5), (2, 1, 6), (3, 1, 4)], "k long, r int, v long")
    out = {r.k: (r.value, r.status, r.conflict) for r in selection.ranked_resolution(ev, ["k"], "v", F.col("r")).collect()}
    assert out == {1: (None, "ambiguous_same_priority", True), 2: (5, "resolved", True), 3: (4, "resolved", False)}


@pytest.mark.parametrize("text,want", [("5-10", (5, 10)), ("10-5", (5, 10)), ("7", (7, 7)), ("x", None), ("", None), (None, None), ("5-", None)])
def test_level_ranges(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(compose.level_range(F.col("t")).alias("r")).first().r
    assert (r and (r.low, r.high)) == want


def test_absent_and_empty_lists_differ(spark):
    out = spark.createDataFrame([(1, [3, 1, 3]), (2, []), (3, None)], "k long, a array<int>").select("k", compose.id_list(F.col("a")).alias("a")).collect()
    assert {r.k: r.a for r in out} == {1: [1, 3], 2: [], 3: None}


def test_replay_forms_differ_on_insert(spark):
    log = [(1, 1, "INSERT", 1, 1), (2, 1, "INSERT", 2, None), (3, 1, "UPDATE", 4, 9), (4, 1, "DELETE", 3, None), (5, 2, "UPDATE", 1, 1), (6, 2, "INSERT IGNORE", 5, 5), (7, 2, "INSERT IGNORE", 6, 6), (8, 2, "REPLACE", 7, None)]
    df = spark.createDataFrame(log, "seq long, key long, op string, a long, b long")
    out = lambda merging: {r.key: (r.live, r.errors, r.a, r.b) for r in compose.replay(df, "key", "seq", "op", ["a", "b"], "acc.a % 2 = x.a % 2", merging).collect()}
    assert out(False) == {1: (False, 1, None, None), 2: (True, 1, 7, None)}
    assert out(True) == {1: (True, 0, 4, 9), 2: (True, 1, 7, None)}


@pytest.mark.parametrize("n,want", [(1, [4]), (3, [0, 4, 9]), (4, [0, 3, 6, 9])])
def test_spread_sample_rounds_half_to_even(spark, n, want):
    ids = spark.range(10).select((F.col("id") * 7).alias("k"))
    assert sorted(r["rank"] for r in coverage.spread_sample(ids, "k", n).collect()) == want


def test_session_merge_counts_a_session_once(spark):
    p = [(1, "a", 1, "timeout"), (1, "a", 2, "timeout"), (1, "b", 3, "timeout"), (1, "c", 4, "timeout"), (2, "a", 5, "timeout"), (2, "b", 6, "refresh_proven"), (2, "c", 7, "timeout")]
    out = coverage.merge_sessions(spark.createDataFrame(p, "i long, s string, n long, o string"), "i", "s", "n", "o", 3)
    assert {r.i: (r.state, r.attempts) for r in out.collect()} == {1: ("terminal", 3), 2: ("refresh_proven", 2)}


def test_nearest_keeps_ties_and_mutual_pairs(spark):
    pts = lambda d: spark.createDataFrame(d, "p long, m long, x double, y double")
    pairs = versions.pair_distances(pts([(1, 10, 0.0, 0.0)]), pts([(1, 20, 3.0, 4.0), (1, 21, 4.0, 3.0), (1, 22, 9.0, 0.0), (2, 23, 0.0, 0.0)]), ["p"], "m")
    near = {(r.a, r.b): r.mutual for r in versions.nearest(pairs, ["p"]).collect()}
    assert near == {(10, 20): True, (10, 21): True, (10, 22): False}


def test_rejects_go_to_their_own_rows(spark, tmp_path):
    f = tmp_path / "e.csv"
    f.write_text("subject_key,family,item_id,value,slot\n1,A,2,3,\n1,A,x,3,1\n1,,2,3,1\n1,A,2,3\n")
    good, bad = tables.read_evidence(spark, str(f))
    assert rows(good.select("subject_key", "value")) == [(1, 3)] and good.first().slot is None
    assert {r.reject for r in bad.collect()} == {"type:item_id", "missing:family", "field_count"}


def test_record_digest_marks_missing(spark):
    out = spark.createDataFrame([("a", None)], "x string, y string").select(evidence.record_digest(["x", "y"])).first()[0]
    assert out == hashlib.sha256(b"a|~").hexdigest()


def test_items_of_zones_are_counted_without_copies_of_rows(spark):
    from factweave.plans import entities

    plan = entities.e15(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan
