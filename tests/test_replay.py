"""Replay in segments and chunks against a plain loop, and the merge of many sessions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import compose, coverage

OPS = ("INSERT", "INSERT IGNORE", "REPLACE", "UPDATE", "DELETE")


def plain(log, merging):
    rows = {}
    for key, _, op, a, b in sorted(log, key=lambda r: r[1]):
        live, errors, old = rows.get(key, (False, 0, (None, None)))
        merged = tuple(o if n is None else n for n, o in zip((a, b), old, strict=True))
        holds = live and old[0] is not None and a is not None and old[0] % 2 == a % 2
        if op == "INSERT" and live:
            live, errors, old = (True, errors, merged) if merging else (True, errors + 1, old)
        elif op == "REPLACE" or (op.startswith("INSERT") and not live):
            live, old = True, (a, b)
        elif op in ("UPDATE", "DELETE") and not live:
            errors, old = errors + 1, (None, None)
        elif op == "UPDATE" and holds:
            old = merged
        elif op == "DELETE" and holds:
            live, old = False, (None, None)
        rows[key] = (live, errors, old)
    return {k: (live, errors, *old) for k, (live, errors, old) in rows.items()}


@pytest.mark.parametrize("merging", [False, True])
def test_replay_in_chunks(spark, merging):
    rng = random.Random(3)
    seq = iter(rng.sample(range(10_000), 900))
    some = lambda: rng.choice([None, 1, 2, 3, 4])
    log = [(key, next(seq), rng.choices(OPS, [3, 3, key, 6, 2])[0], some(), some()) for key in (0, 0, 0, 1, 3, 9) for _ in range(150)]
    df = spark.createDataFrame(log, "key long, seq long, op string, a long, b long")
    for chunk in (7, 1000):
        got = compose.replay(df, "key", "seq", "op", ["a", "b"], "acc.a % 2 = x.a % 2", merging, chunk=chunk)
        assert {r.key: (r.live, r.errors, r.a, r.b) for r in got.collect()} == plain(log, merging)
    assert compose.replay(df.limit(0), "key", "seq", "op", ["a", "b"], "true", merging).count() == 0


def test_a_hot_key_of_many_changes(spark):
    n = 1_000_000
    log = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "INSERT").otherwise("UPDATE").alias("op"), F.lit(2).cast("long").alias("a"), F.col("id").alias("b"))
    (row,) = compose.replay(log, "key", "seq", "op", ["a", "b"], "acc.a = x.a", False, chunk=400_000).collect()
    assert (row.live, row.errors, row.a, row.b) == (True, 0, 2, n - 1)


def test_sessions_of_many_items(spark):
    rng = random.Random(4)
    probes = [(i, rng.randint(0, 9), k, rng.choices(["timeout", "session_only", "unknown", "refresh_proven", "historical", None], [8, 2, 2, 1, 1, 1])[0]) for k, i in enumerate(rng.choices(range(40), k=500))]
    want = {}
    for i in {p[0] for p in probes}:
        last = {}
        for _, session, at, o in sorted((p for p in probes if p[0] == i), key=lambda p: p[2]):
            # as an aggregate does, the last known outcome of a session counts
            last[session] = (at, o if o is not None or session not in last else last[session][1])
        state, attempts = "queued", 0
        for _, o in sorted(last.values(), key=lambda x: x[0]):
            if state in ("refresh_proven", "historical", "terminal"):
                break
            attempts += 1
            state = o if o != "timeout" else "terminal" if attempts >= 3 else "retryable"
        want[i] = (state, attempts)
    df = spark.createDataFrame(probes, "item int, session int, attempt int, o string")
    rows = lambda d: {r.item: (r.state, r.attempts) for r in coverage.merge_sessions(d, "item", "session", "attempt", "o", 3).collect()}
    got = rows(df)
    known = {i for i in want if all(p[3] is not None for p in probes if p[0] == i)}
    assert {i: got[i] for i in known} == {i: want[i] for i in known} and len(known) > 5
    assert set(got) == set(want) and rows(df.unionByName(df)) == got
