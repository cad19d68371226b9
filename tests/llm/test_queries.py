"""The registered corpus queries as the driver calls them, and every operator on odd ids and names."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__
from factweave.llm import embeddings, media, packing, quality, queries, sharding, simhash, token_counts, toxicity
from factweave.llm.queries import tokenizer_path
from tests.compare import rows_of, spark_rows

SF = "/root/testdata/sf0.001"
LONG, INT, TEXT, FLAG, REAL = "bigint", "int", "string", "boolean", "double"
#: Columns that each contract names, and the table that has a row for each of theirs (none: several rows).
CONTRACTS = {
    "op1_nnpu_toxicity": ("documents", {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT}),
    "op2_karmarkar_karp_shards": ("documents", {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT}),
    "op3_simhash_pigeonring": ("documents", {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG}),
    "op4_token_counts": ("documents", {"doc_id": LONG, "n_bytes": LONG, "n_tokens": LONG, "over_limit": FLAG}),
    "op5_metric_range_join": ("embeddings", {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG}),
    "op6_retrieval_packing": (None, {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG}),
    "op7_interleaved_media": ("documents", {"doc_id": LONG, "n_bytes": LONG, "payload_bytes": LONG, "payload_sha256": TEXT, "tail_crc32": LONG, "media_bytes": LONG, "media_sha256": TEXT, "feature": TEXT}),
    "op8_boosted_gam_quality": ("documents", {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT}),
    "op9_patience_line_dedup": ("documents", {"doc_id": LONG, "text": TEXT}),
    "op11_link_trust_urls": ("pages", {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT}),
    "op12_refined_whitening": (None, {"vec_id": LONG, "component": INT, "n": LONG, "deviation": LONG, "whitened": REAL, "explained": REAL, "identity_error": REAL}),
    "op13_span_alignment": ("documents", {"doc_id": LONG, "n_a": LONG, "n_b": LONG, "n_groups": LONG, "n_links": LONG, "n_best": LONG, "count_sum": LONG, "groups_sha256": TEXT}),
    "op10_entropy_balanced_mix": ("documents", {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG}),
}


def test_all_are_registered():
    assert set(CONTRACTS) | {"pipeline"} == set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_rows_of_the_contract(spark, name):
    table, columns = CONTRACTS[name]
    found = __spark_entry__.queries()[name](spark, SF)
    assert columns.items() <= dict(found.dtypes).items()
    if table:
        key = next(iter(columns))
        assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_range_join_gives_the_rows_of_its_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    data = [(int(i), [float(np.float32(x)) for x in base[k % 40] + rng.normal(size=16) * rng.choice([0, 0.2, 0.5])], int(k % 3)) for k, i in enumerate(rng.permutation(300))]
    data += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, data[0][1], None), (1003, [1.0, float("nan")], 0), (1004, [], 0), (1005, data[0][1], data[0][2])]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.OP5_SQL)
    columns = [c[0] for c in want.description]
    rows = rows_of(columns, want.fetchall())
    assert spark_rows(queries.op5_metric_range_join(spark, str(tmp_path))) == rows and sum(r[columns.index("n_links")] != "0" for r in rows) > 50


ODD = [(1, "one text here"), (1, "another text here"), (1, "one text here"), (None, "one text here"), (None, None), ((1 << 63) - 1, "x " * 300), (1 << 62, "x " * 300), (-7, "")]
#: Names that the operators use inside.
NAMES = "id long, text_ string, fp long, rep long, n long, row long, key string, gid string, bucket long, part int, h long, hash long, range int, score double, y int, x double, items int, media string, digest string, label int, positive boolean, _id long, size long, cold int, sub long"


@pytest.fixture(scope="module")
def odd(spark):
    rest = [c.split() for c in NAMES.split(", ")]
    values = {"long": 5, "int": 6, "string": "s", "double": 0.5, "boolean": True}
    return spark.createDataFrame([(*r, *(values[k] for _, k in rest)) for r in ODD], f"doc_id long, text string, {NAMES}")


def test_operators_take_odd_ids_repeats_and_clashing_names(spark, odd):
    ids = sorted(str(i) for i, _ in ODD)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), ((1 << 63) - 1, 0, 1), (1 << 62, 1, 1), (-7, None, 0), (None, 1, 1), (1, 1, 7)], "doc_id long, toxic int, quality int")
    per_row = {
        "toxicity": toxicity.toxicity(odd, labels), "quality": quality.quality(odd, labels), "shards": sharding.shard_by_bytes(odd, shards=3), "simhash": simhash.near_duplicates(odd),
        "tokens": token_counts.count_tokens(odd, tokenizer_path("piece_bpe_32k.model")), "media": media.text_media(odd),
    }
    found = {name: df.collect() for name, df in per_row.items()}
    for name, rows in found.items():
        assert sorted(str(r.doc_id) for r in rows) == ids, name
    assert all(0 <= r.score <= 1 and r.held_out is not None for name in ("toxicity", "quality") for r in found[name])
    assert {(r.doc_id, r.component_id) for r in found["simhash"]} == {(1, 1), (None, 1), (None, -7), ((1 << 63) - 1, 1 << 62), (1 << 62, 1 << 62), (-7, -7)}
    pieces = packing.pack(odd, tokenizer_path("byte_bpe_50k.json"), window=64).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == ids
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1, 2), (None, None, None, 2), ((1 << 63) - 1, [1.0, 0.0], 1, 2), (3, [1.0, 0.01], 1, 2), (3, [1.0, 0.01], 1, 2)], "vec_id long, embedding array<double>, label int, cid long")
    linked = embeddings.near_vectors(vectors).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in linked) == sorted([("3", 2, "3", True), ("3", 2, "3", True), (str((1 << 63) - 1), 2, "3", False), ("None", 0, "None", True), ("None", 0, "None", True)])


def test_repeated_ids_do_not_tie_unlike_fingerprints(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(0, words(1)), (1, words(1)), (1, words(2)), (7, words(2))]
    found = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0), (1, 0), (1, 1), (7, 1)]


def test_the_sample_of_one_much_repeated_id_is_one_row(spark):
    rows = [(1, f"moronic row {k}") for k in range(500)] + [(k, f"plain words {k}") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 60)], "doc_id long, toxic int")
    seen = []
    held = toxicity.fit
    try:
        toxicity.fit = lambda positive, unlabelled, prior, p: seen.append((len(positive), len(unlabelled), prior)) or held(positive, unlabelled, prior, p)
        toxicity.train(docs, labels, "doc_id", "text", "toxic", 4, 2)
    finally:
        toxicity.fit = held
    in_training = [k for k in range(1, 60) if __import__("zlib").crc32(str(k).encode()) % 4 != 2]
    assert seen[0][0] == (1 in in_training) and seen[0][1] == len(in_training) and math.isclose(seen[0][2], (1 in in_training) / len(in_training))


@pytest.mark.parametrize("prior", [0.1, 0.8])
def test_nn_pu_direction_is_the_gradient_of_the_risk(prior):
    rng = np.random.default_rng(3)
    xp, xu = rng.integers(0, 2, (6, 3)).astype(float), rng.integers(0, 2, (9, 3)).astype(float)
    pp, pu = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(9))

    def parts(w, b):
        """The risk written out row by row."""
        loss = lambda z: math.log1p(math.exp(-z))
        plus = sum(s * loss(float(x @ w) + b) for x, s in zip(xp, pp, strict=True))
        minus_p = sum(s * loss(-(float(x @ w) + b)) for x, s in zip(xp, pp, strict=True))
        minus_u = sum(s * loss(-(float(x @ w) + b)) for x, s in zip(xu, pu, strict=True))
        return prior * plus, minus_u - prior * minus_p

    seen = set()
    for _ in range(30):
        w, b = rng.normal(size=3) * 3, float(rng.normal() * 3)
        positive, negative, direction = toxicity.nn_pu_gradient(xp, pp, xu, pu, w, b, prior)
        assert np.allclose((positive, negative), parts(w, b))
        value = (lambda w, b: -parts(w, b)[1]) if negative < 0 else (lambda w, b: sum(parts(w, b)))  # noqa: B023
        step = 1e-6
        slopes = [(value(w + step * e, b) - value(w - step * e, b)) / (2 * step) for e in np.eye(3)] + [(value(w, b + step) - value(w, b - step)) / (2 * step)]
        assert np.allclose(direction, slopes, atol=1e-6)
        seen.add(negative < 0)
    assert prior < 0.5 or seen == {True, False}


def test_trees_take_the_best_cut_of_all():
    rng = np.random.default_rng(4)
    p = quality.GamParams(leaves=2, least_leaf=0.0)
    for _ in range(50):
        g, h = rng.normal(size=7), rng.random(7) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + p.l2)  # noqa: B023, E731
        cut = max(range(1, 7), key=lambda k: gain(0, k) + gain(k, 7))
        if gain(0, cut) + gain(cut, 7) > gain(0, 7) + 1e-9:
            want = [g[:cut].sum() / (h[:cut].sum() + p.l2)] * cut + [g[cut:].sum() / (h[cut:].sum() + p.l2)] * (7 - cut)
            assert np.allclose(quality.shallow_tree(g, h, p), want)
        g2, h2 = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        quads = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
        total = lambda i, j: sum(g2[q].sum() ** 2 / (h2[q].sum() + p.l2) for q in quads(i, j))  # noqa: B023, E731
        i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: total(*c))
        want = np.empty((4, 5))
        for q in quads(i, j):
            want[q] = g2[q].sum() / (h2[q].sum() + p.l2)
        found = quality.pair_tree(g2, h2, p)
        assert np.allclose(found[1], want) and math.isclose(found[0], total(i, j) - g2.sum() ** 2 / (h2.sum() + p.l2))


def test_batch_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(9)
    x = rng.random((400, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.9).astype(float)
    model = quality.fit(x, y, quality.GamParams(rounds=15, pair_rounds=10, pairs=3))
    for row, z in zip(x, model.log_odds(x), strict=True):
        bin_of = lambda edges, v: sum(e <= v for e in edges)
        want = model.base + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))  # noqa: B023
        want += sum(t[bin_of(model.pair_edges[f], row[f]), bin_of(model.pair_edges[g], row[g])] for (f, g), t in model.pair_tables.items())
        assert math.isclose(z, want, rel_tol=1e-9)
    assert len(model.pair_tables) == 3


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>t</title><body><p>all of it</p>", ["all of it"]),
        ("<head><title>t</title><p>no body tag", ["no body tag"]),
        ("<figure><img src=a><figcaption>cap<div>after</div><p>more</p>", ["after", "more"]),
        ("<article><figure><img src=a><figcaption>cap</figure>tail", ["tail"]),
        ("<figcaption>alone</figcaption><p>x", ["alone", "x"]),
        ("<figure><img src=a><figcaption>cap <p>part</p> end</figcaption></figure>z", ["z"]),
        ("<script>no</script><style>no</style>yes", ["yes"]),
    ],
)
def test_pages_without_end_tags_lose_no_text(html, want):
    items = media.parse_sequence(html)
    assert [i["text"] for i in items if i["kind"] == "text"] == want
    captions = [i["caption"] for i in items if i["kind"] == "media"]
    assert all(c and c.startswith("cap") for c in captions)


def test_resolve_and_parse_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "<img src='sha256:aa'>x", 3, "f", 4)], "page_id long, html string, items int, found string, media long")
    store = spark.createDataFrame([("aa", 7, 1)], "digest string, size long, found int")
    out = media.resolve(media.parse_pages(pages), store, "page_id").collect()[0]
    assert out.found == "f" and out.media == 4 and out["items"][0].media.size == 7 and out["items"][0].media.found == 1


def test_the_commonest_pretokens_stay_within_their_bound(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(f"t{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(200))) for k in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = tokenizer_path("piece_bpe_32k.model")
    model = token_counts.load_model(path)
    for hot in (0, 1, 7, 60):
        found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, hot=hot).collect()}
        assert found == {k: len(model.encode(t)) for k, t in texts}
