"""The stages of the corpus pipeline, each on its own input, and run() against them."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from factweave.llm import linededup, mixing, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {"documents": None}
    out["documents"] = docs
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_are_named_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mix", "pack"] and cp.ORACLE_SQL is None


def test_all_but_the_last_keep_the_columns(stages):
    assert all(stages[n].columns == cp.COLUMNS for n in list(stages)[:-1])


def test_toxic_documents_go_and_others_stay_whole(stages):
    before, after = ({r.doc_id: r for r in stages[n].collect()} for n in ("documents", "toxicity"))
    assert set(after) < set(before) and len(after) > 0.75 * len(before) and all(before[i] == r for i, r in after.items())


def test_line_dedup_keeps_rows(stages):
    found, want = stages["line_dedup"], linededup.dedup_lines(stages["toxicity"])
    assert {(r.doc_id, r.text) for r in found.collect()} == {(r.doc_id, r.text) for r in want.collect()}


def test_one_document_of_each_group_stays(stages):
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(stages["line_dedup"]).collect()}
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"].collect()) == sorted(set(groups.values()))


def test_the_mix_takes_its_copies(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages["simhash_near_dedup"]).collect()}
    found = {}
    for r in stages["mix"].collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}


def test_packing_covers_every_copy(stages):
    tokens = {}
    for r in stages["pack"].collect():
        tokens.setdefault(r.doc_id, [r.doc_tokens, 0])[1] += r.length
    copies = {}
    for r in stages["mix"].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert {i: t[1] for i, t in tokens.items()} == {i: tokens[i][0] * n for i, n in copies.items()}


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, stages["pack"].collect()))


def test_rows_without_or_with_repeated_ids_are_kept_apart(spark):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(None, words(1, 40), "en", "a", 1), (None, words(2, 30), "en", "b", 1), (None, None, "en", None, None), (1, words(3, 50), "en", "a", 1), (1, words(3, 50), "en", "a", 1), (1, words(4, 9), "en", "b", 1), (2, words(5, 60), None, "b", 1), (3, words(2, 30), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [tuple(r) for r in cp.drop_near_copies(spark, docs.withColumn("_key", F.lit("a clashing name")), SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]]))
    mixed = Counter(tuple(r) for r in cp.mix_sources(spark, docs, SF).collect())
    copies, found = Counter(), Counter()
    for r in mixing.mix(cp.keyed(docs), id_col="_key").collect():
        copies[r.source, r.size] += r.copies
    for r, n in mixed.items():
        assert r in rows
        found[r[3], len((r[1] or "").split())] += n
    assert +found == +copies


def test_stages_take_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [stage(spark, none, SF).count() for _, stage in cp.STAGES] == [0] * 5


def test_stages_take_nulls_repeats_odd_ids_and_clashing_names(spark):
    """Every stage keeps whole what it has no reason to drop, whatever else the table holds."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    big = (1 << 63) - 1
    rows = [(big, words(1, 60), None, None, None), (-5, words(2, 2000), "en", "a", 1), (-5, words(3, 40), "en", "a", 1), (None, None, None, "b", 0), (7, "", "de", "b", 0), (7, "", "de", "b", 0), (8, " \n\t", None, "c", 3)]
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key long, _score string, row long, size long")
    for name, stage in cp.STAGES[:2]:
        assert sorted(map(str, (tuple(r) for r in stage(spark, docs, SF).collect()))) == sorted(map(str, rows)), name
    kept = [tuple(r) for r in cp.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[1], rows[2], rows[4]]))  # all empty texts are one group, its least id stays
    assert set(cp.mix_sources(spark, docs, SF).collect()) <= set(rows)
    packed = cp.pack_windows(spark, docs, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 7) == 2 and sum(r.length for r in packed if r.doc_id is None) == 1


def test_a_copy_does_not_stand_in_for_another_text_of_its_id(spark):
    """Of id 1 one text is a copy of id 0's and the other is like no other: that one stays."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    for copied, own in ((1, 2), (2, 1)):
        rows = [(0, words(copied, 40), "en", "a", 1), (1, words(copied, 40), "en", "a", 1), (1, words(own, 40), "en", "b", 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(tuple(r) for r in cp.drop_near_copies(spark, docs, SF).collect()) == sorted([rows[0], rows[2]])


def test_a_row_that_a_third_of_the_table_repeats(spark, monkeypatch):
    """Its copies come from many tasks; unlike rows under one digest share copies out and none is lost."""
    monkeypatch.setattr(cp, "COPIES", 7)
    rows = [(None, "one two three four five six", "en", "a", 1)] * 200 + [(i, f"w{i} x{i} y{i} z{i}", "en", "b", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = Counter(tuple(r) for r in cp.drop_near_copies(spark, docs, SF).collect())
    assert kept[rows[0]] == 1 and max(kept.values()) == 1
    copies, found = Counter(), Counter(tuple(r) for r in cp.mix_sources(spark, docs, SF).collect())
    for r in mixing.mix(cp.keyed(docs), id_col="_key").collect():
        copies[r.source] += r.copies
    assert found[rows[0]] == copies["a"] and sum(n for r, n in found.items() if r[3] == "b") == copies["b"] and max(found[r] for r in set(rows[200:])) <= 3

    monkeypatch.setattr(cp, "keyed", lambda d: d.select(*cp.COLUMNS).withColumn("_key", F.when(F.col("doc_id") < 100, F.lit(5)).otherwise(F.xxhash64(*cp.COLUMNS))))
    again = Counter(tuple(r) for r in cp.mix_sources(spark, docs, SF).collect())
    assert set(again) <= set(rows) and max(again[r] for r in set(rows[200:])) <= 3
