from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factweave.functions import tristate as ts
from factweave.operators import search

ROWS = [(1, "Ring", 5), (2, "ring of x", None), (3, "Sword", None), (4, None, 9), (5, "Ring", 1)]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ROWS, "id long, name string, level int")


def test_any_non_match_decides_else_unknown_remains(items):
    judged = search.judge(items, [ts.contains(F.col("name"), "RING"), ts.at_least(F.col("level"), 3)])
    assert {r.id: r.state for r in judged.collect()} == {1: "known_match", 2: "unknown", 3: "known_non_match", 4: "unknown", 5: "known_non_match"}


def test_no_predicates_match(items):
    assert {r.state for r in search.judge(items, []).collect()} == {"known_match"}


def test_counts_precede_filters(items):
    judged = search.judge(items, [ts.at_least(F.col("level"), 3)])
    assert {r.state: r.n for r in search.summary(judged).collect()} == {"known_match": 2, "unknown": 2, "known_non_match": 1}


def test_unknown_keys_last_and_ascending_in_either_direction(items):
    down = [r.id for r in search.page(items, F.col("level"), F.col("id"), 10, descending=True).orderBy("position").collect()]
    up = [r.id for r in search.page(items, F.col("level"), F.col("id"), 10).orderBy("position").collect()]
    assert down == [4, 1, 5, 2, 3] and up == [5, 1, 4, 2, 3]


def test_known_ties_turn_with_the_direction(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, None)], "id long, level int")
    assert [r.id for r in search.page(rows, F.col("level"), F.col("id"), 10, descending=True).orderBy("position").collect()] == [2, 1, 3, 4]


def test_page_size_is_bounded(items):
    with pytest.raises(ValueError):
        search.page(items, F.col("level"), F.col("id"), 1001)


def test_array_predicate_is_unknown_only_without_array(spark):
    rows = spark.createDataFrame([(1, [3]), (2, []), (3, None)], "id long, a array<int>")
    out = rows.select("id", ts.any_element(F.col("a"), lambda x: x == 3).alias("ok")).collect()
    assert {r.id: r.ok for r in out} == {1: True, 2: False, 3: None}
