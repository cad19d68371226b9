from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators.coverage import merge_sessions
from factweave.streaming import ingest, probes

SCHEMA = "item_id long, session string, attempt long, o string"


def tracked(spark, folder, batches, delay=None):
    """Every row that the stream gives, with the number of its micro-batch; one file is one micro-batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = []
    found = probes.track(stream, "item_id", "session", "attempt", "o", 3, delay)
    run = found.writeStream.outputMode("update").foreachBatch(lambda batch, n: out.extend((n, *r) for r in batch.collect()))
    run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out


def last_states(rows):
    return {item: (state, attempts) for _, item, state, attempts, _, late in sorted(rows, key=lambda r: r[0]) if not late}


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_in_any_order_give_the_merged_states(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["timeout", "timeout", "session_only", "unknown", "unknown", "refresh_proven", "historical"]
    rows, at = [], 0
    for item in range(40):
        for s in range(rng.randint(1, 7)):
            for _ in range(rng.randint(1, 3)):
                at += 1
                rows.append((item, f"s{s}", at, rng.choice(kinds)))
    rows += rng.sample(rows, 20) + [(3, None, 1, "timeout"), (3, "x", None, "timeout"), (4, "y", 2, None)]
    want = merge_sessions(spark.createDataFrame(rows, SCHEMA).dropna(), "item_id", "session", "attempt", "o", 3)
    want = {r.item_id: (r.state, r.attempts) for r in want.collect()}
    rng.shuffle(rows)
    got = tracked(spark, tmp_path, [rows[k::5] for k in range(5)])
    assert last_states(got) == want and not any(r[-1] for r in got)


def test_a_session_behind_closed_ones_goes_to_the_side(spark, tmp_path):
    first = [(1, "a", 10, "timeout"), (1, "c", 30, "unknown"), (2, "a", 10, "historical"), (2, "z", 90, "timeout")]
    then = [(1, "b", 20, "timeout"), (1, "d", 99, "timeout"), (2, "b", 5, "timeout")]
    # item 1: a closes (30 - 15 > 10), b at 20 is in time; item 2 ended at a, which closes: 5 is behind it
    rows = tracked(spark, tmp_path, [first, then], delay=15)
    assert last_states(rows) == {1: ("terminal", 4), 2: ("historical", 1)}
    assert [(r[1], r[4]) for r in rows if r[-1]] == [(2, "b")]


def test_late_and_repeated_probes_of_closed_sessions_count_no_more(spark, tmp_path):
    one = [(1, "a", 10, "timeout"), (1, "b", 100, "session_only")]
    rows = tracked(spark, tmp_path, [one, [(1, "a", 10, "timeout"), (1, "old", 3, "historical")], [(1, "b", 101, "unknown")]], delay=20)
    assert last_states(rows) == {1: ("unknown", 2)}
    assert sorted(r[4] for r in rows if r[-1]) == ["a", "old"]


def test_limits_and_empty_streams(spark, tmp_path):
    assert tracked(spark, tmp_path, [[]]) == []
    with pytest.raises(ValueError):
        probes.track(spark.createDataFrame([], SCHEMA), "item_id", "session", "attempt", "o", 0)


def test_the_store_stays_small_and_a_batch_run_again_adds_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MERGE", 2)
    monkeypatch.setattr(ingest, "BUCKETS", 3)
    rng = random.Random(5)
    schema, store = "k long, v string, seq long", f"{tmp_path}/store"
    batches = [[(rng.choice([None, *range(12)]), rng.choice([None, "x", "y"]), 20 * n + i) for i in range(20)] for n in range(6)]
    batches[3] = []

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.continuous_ingest(stream, ["k", "v"], "seq", store, f"{tmp_path}/{checkpoint}").awaitTermination()
        return sorted((r.k is None, r.k or 0, r.v or "", r.v is None, r.seq) for r in ingest.stored_statements(spark, store, stream.schema).collect())

    assert ingest.stored_statements(spark, store, spark.createDataFrame([], schema).schema).count() == 0
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    first = {}
    for k, v, seq in (r for rows in batches for r in rows):
        first[k, v] = min(seq, first.get((k, v), seq))
    found = run("one")
    assert [r[:4] for r in found] == sorted((k is None, k or 0, v or "", v is None) for k, v in first)
    held = ingest.Store(spark, store, spark.createDataFrame([], schema).schema)
    numbers, tiers = held._numbers(), [t for t, _ in held.folders()]
    assert len(numbers) == 2 and len(tiers) == len(set(tiers)) <= 3  # one folder a tier at most
    named = {name for n in numbers for _, name in held._manifest(n)}
    assert set(held._names("data")) == named
    # the last batch again, after a crash that kept it from being noted as done
    last = numbers[-1]
    for done in (tmp_path / "one" / "commits").glob(f"*{last}*"):
        done.unlink()
    assert run("one") == found and held._numbers()[-1] == last
