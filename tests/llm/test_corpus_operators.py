"""Each corpus operator against a brute-force form, on small tables with nulls, empties, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import common, components, embeddings, linededup, media, mixing, packing, quality, sharding, simhash, token_counts, toxicity
from factweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, row string, key string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choice(("an", "the", "ber", "qui", "lo", "ñe", "ö")) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    """Odd texts first, then prose with copies and near copies; the last columns clash with names used inside."""
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "A  b\n", "a b", "x" * 5000, "tab\there  two   three\n\n end ", "<|endoftext|> not special? <s>", "▁ underscore ▁x", "né nb sp　x"]
    for _ in range(40):
        texts.append("\n".join(words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))))
    texts += [texts[20]] * 5 + [texts[21] + " more", texts[22].upper()]
    texts.append(words(rng, 4000))
    sources = ["b", "a", None, "Z", "é"]
    return [(i, t, "en", sources[i % 5] if i % 3 else "hot", len(t or ""), f"k{i}", i, "r", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components_of(ids, linked):
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_simhash(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in SPACE.findall(text or "")]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(grams)) if grams else 0


def test_simhash(spark, docs, rows, none):
    found = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("f"), "component_id").collect()
    want = {r[0]: brute_simhash(r[1]) for r in rows}
    assert {r.doc_id: r.f for r in found} == {i: f"{f:016x}" for i, f in want.items()}
    pairs = [(a, b) for a in want for b in want if a < b and bin(want[a] ^ want[b]).count("1") <= 2]
    assert {r.doc_id: r.component_id for r in found} == components_of(want, pairs)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("in_bucket", [128, 2])
def test_pigeonring_loses_no_link(spark, in_bucket):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    edges = simhash.near_pairs(spark.createDataFrame(signed, "rep long, fp long"), in_bucket=in_bucket)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = components_of(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    assert {i: got.get(i, i) for i in want} == want
    assert all(bin(fps[r.a] ^ fps[r.b]).count("1") <= 2 for r in edges.collect() if in_bucket == 128)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7)] + [(100, 101)] * 3
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {k: 100 for k in range(100, 140)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_differencing_is_tighter_than_the_largest_item():
    sizes = np.random.default_rng(1).integers(1, 1000, 400)
    shard = sharding.difference(sharding._singles(sizes, 7))[:, 0]
    sums = np.bincount(shard, sizes, 7)
    assert sums.max() - sums.min() <= 2 and set(shard) == set(range(7))
    parts = np.array([[5, 3, 1], [4, 4, 0]])
    labels = sharding.difference(parts)
    assert all(sorted(x) == [0, 1, 2] for x in labels.tolist())
    assert sharding.difference(np.zeros((0, 3), np.int64)).shape == (0, 3) and sharding.difference(parts[:1]).tolist() == [[0, 1, 2]]


@pytest.mark.parametrize("per_bucket", [20_000, 1])
def test_shards(docs, rows, none, per_bucket, monkeypatch):
    monkeypatch.setattr(sharding, "TOP_BUCKETS", 16 if per_bucket == 1 else 1024)
    monkeypatch.setattr(sharding, "GRAIN", 4 if per_bucket == 1 else 128)
    found = sharding.shard_by_bytes(docs, shards=4, per_bucket=per_bucket).collect()
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows]
    text = {r[0]: r[1] or "" for r in rows}
    for r in found:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    by_text = {}
    for r in found:
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(none, shards=4).count() == 0


@pytest.mark.parametrize("per_bucket", [20_000, 1])
def test_shards_are_near_equal(spark, per_bucket, monkeypatch):
    monkeypatch.setattr(sharding, "TOP_BUCKETS", 16 if per_bucket == 1 else 1024)
    monkeypatch.setattr(sharding, "GRAIN", 8 if per_bucket == 1 else 128)
    rng = random.Random(2)
    data = [(i, f"{i}:" + "y" * rng.randint(1, 300)) for i in range(300)] + [(1000 + i, "copy" * 10) for i in range(100)]
    found = sharding.shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string"), shards=5, per_bucket=per_bucket).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sums = [r.s for r in found]
    assert len(sums) == 5 and max(sums) - min(sums) <= (0.03 if per_bucket > 1 else 0.1) * sum(sums) / 5  # few coarse bundles where the levels are forced


def test_token_counts(docs, rows, none):
    path = tokenizer_path("piece_bpe_32k.model")
    model = token_counts.load_model(path)
    for hot in (100_000, 5):
        found = {r.doc_id: r for r in token_counts.count_tokens(docs, path, hot=hot, limit=50).collect()}
        for i, text, *_ in rows:
            n = len(model.encode(text or ""))
            assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((text or "").encode()), n, n > 50), text
    assert token_counts.count_tokens(none, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "\n\nx", "▁▁x", "a   \n  b ", "x\ny z\n"])
def test_pretokens_add_up(text):
    model = token_counts.load_model(tokenizer_path("piece_bpe_32k.model"))
    keys = token_counts.pretokens(text)
    assert sum(token_counts.piece_counts(model, keys)) == len(model.encode(text))


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for per_shard in (3000, 10):
        found = sorted(packing.pack(docs, path, window=64, per_shard=per_shard).collect(), key=lambda r: (r.doc_id, r.start))
        for i, text, *_ in rows:
            ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
            own = [r for r in found if r.doc_id == i]
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
            for r in own:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        by_sequence = {}
        for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
            at = by_sequence.setdefault(r.sequence_id, 0)
            assert r.offset == at
            by_sequence[r.sequence_id] += r.length
        assert max(by_sequence.values()) <= 64
        short = [n for n in by_sequence.values() if n < 64]
        assert len(short) <= packing.chunks_for(len(rows), per_shard)
    assert packing.pack(none, path).count() == 0


def test_packing_prefers_lexical_neighbours():
    idf, p = np.ones(50), packing.Bm25()
    terms = [np.array(t, np.uint16) for t in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5])]
    index = packing.ShardIndex(terms, [np.ones(3, np.uint16)] * 4, idf, 3.0, p)
    scores = index.scores(0)
    assert scores[2] > 0 == scores[1] == scores[3]
    pieces = packing.fill_windows(index, [0] * 4, [6, 5, 4, 4], 10)
    together = {}
    for doc, _, _, sequence, _ in pieces:
        together.setdefault(sequence, set()).add(doc)
    assert {0, 2} in together.values()


def test_bm25_scores_match_the_formula():
    rng = np.random.default_rng(0)
    terms = [np.unique(rng.integers(0, 30, 8)).astype(np.uint16) for _ in range(12)]
    counts = [rng.integers(1, 5, len(t)).astype(np.uint16) for t in terms]
    idf, p = rng.random(30), packing.Bm25()
    mean = float(np.mean([c.sum() for c in counts]))
    index = packing.ShardIndex(terms, counts, idf, mean, p)
    for seed in range(12):
        for doc in range(12):
            want = sum(idf[t] * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * counts[doc].sum() / mean)) for t, f in zip(terms[doc], counts[doc], strict=True) if t in terms[seed])
            assert math.isclose(index.scores(seed)[doc], want, rel_tol=1e-4, abs_tol=1e-6)


def brute_windows(terms, counts, idf, mean, lengths, window):
    """Every window's documents by the plain rule: the unused document of the best score that fits whole, again and again, then the best one cut."""
    p, left = packing.Bm25(), list(lengths)
    of = [dict(zip(t.tolist(), c.tolist(), strict=True)) for t, c in zip(terms, counts, strict=True)]

    def score(seed, doc):
        size = sum(of[doc].values())
        return sum(idf[t] * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * size / mean)) for t, f in of[doc].items() if t in of[seed])

    out = []
    for seed in sorted(range(len(left)), key=lambda d: (-left[d], d)):
        while left[seed]:
            n = min(left[seed], window)
            now, room = [(seed, n)], window - n
            left[seed] -= n
            order = sorted((d for d in range(len(left)) if left[d]), key=lambda d: (-round(score(seed, d), 4), d)) if room else []
            for d in order:
                if left[d] <= room:
                    now.append((d, left[d]))
                    room, left[d] = room - left[d], 0
            for d in [d for d in order if left[d]][: 1 if room else 0]:
                now.append((d, room))
                left[d], room = left[d] - room, 0
            out.append(now)
    return out


@pytest.mark.parametrize("dense", [1, 12, 10_000])
def test_windows_are_filled_by_the_plain_rule(dense):
    rng = np.random.default_rng(11)
    n = 70
    terms = [np.unique(rng.zipf(1.3, 40) % 300) for _ in range(n)]
    counts = [rng.integers(1, 70_000 if k == 3 else 5, len(t)) for k, t in enumerate(terms)]
    terms += [terms[0], np.empty(0, np.int64)]
    counts += [counts[0], np.empty(0, np.int64)]
    df = np.bincount(np.concatenate(terms), minlength=300)
    idf = np.log1p((n + 2 - df + 0.5) / (df + 0.5))
    lengths = [int(x) for x in rng.integers(1, 64, n + 2)]
    index = packing.ShardIndex(terms, counts, idf, 60.0, packing.Bm25(), dense=dense)
    found = {}
    for doc, _, length, sequence, _ in packing.fill_windows(index, [0] * (n + 2), lengths, 64):
        found.setdefault(sequence, []).append((doc, length))
    assert [found[k] for k in sorted(found)] == brute_windows(terms, counts, idf, 60.0, lengths, 64)


def test_fast_encoder_agrees_with_the_tokenizer():
    """By the vocabulary's own proof, and over every character between letters, digits and marks."""
    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.ranks_agree(path)
    encode = packing.WordTokenizer(path, True)
    texts = ["".join(f"a{chr(c)}1 {chr(c)}. b{chr(c)}\n" for c in range(start, min(start + 4096, 0x30000)) if not 0xD800 <= c < 0xE000) for start in range(0, 0x30000, 4096)]
    rng = random.Random(7)
    marks = ["a", "B", "7", " ", "  ", "\n", "'s", ".", "é", "\u00a0", "\u3000", "<|endoftext|>", "word", "\t", "x" * 50]
    texts += ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["z" * 150_000 + " y"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_content_keys_by_plain_sums():
    rng = np.random.default_rng(5)
    terms = [np.unique(rng.integers(0, 40, k)) for k in (0, 5, 9, 1, 30)]
    counts = [rng.integers(1, 6, len(t)) for t in terms]
    idf, to = rng.integers(1, 5, 40).astype(float), packing.directions(40)
    middle = rng.standard_normal((7, packing.WIDTH)).astype(np.float32)
    marks = rng.integers(0, 1 << 54, 5)
    keys = packing.content_keys(*packing.weighted(terms, counts, idf), marks, to, middle)
    for t, c, mark, key in zip(terms, counts, marks.tolist(), keys.tolist(), strict=True):
        v = ((idf[t] * c / (c + 1.2)).astype(np.float32)[:, None] * to[t]).sum(0)
        assert [key >> 54, key & (1 << 54) - 1] == [int(np.argmax(v @ middle.T)) if len(t) else 0, mark]


def test_near_copies_mostly_share_their_mark():
    rng = np.random.default_rng(8)
    same = 0
    for _ in range(200):
        ids = rng.integers(0, 50_000, 300).astype(np.uint32)
        other = ids.copy()
        other[rng.integers(0, 300, 3)] = 7
        same += packing.run_mark(ids) == packing.run_mark(other)
        assert 0 <= packing.run_mark(ids) < 1 << 54
    assert same > 170 and packing.run_mark(ids[:0]) == 0 and packing.run_mark(ids[:2]) == packing.run_mark(ids[:2].copy())


def test_metric_range_join(spark):
    rng = np.random.default_rng(4)
    data, n = [], 0
    centres = rng.normal(size=(30, 8))
    for _ in range(260):
        v = centres[rng.integers(30)] + rng.normal(size=8) * rng.choice([0, 0.15, 0.4])
        data.append((n, [float(x) for x in v * rng.choice([1, 3])], int(rng.integers(3))))
        n += 1
    data += [(n + k, data[0][1], data[0][2]) for k in range(4)]
    n += 4
    odd = [None, [], [0.0] * 8, [1.0] * 7 + [float("nan")], [1.0] * 7 + [None], [float("inf")] + [1.0] * 7, [1.0, 2.0]]
    data += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 50, data[0][1], None), (n + 51, [1.0, 2.0], 0)]
    usable = {i: (lab, np.array(v) / np.linalg.norm(v)) for i, v, lab in data if lab is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = [(a, b) for a in usable for b in usable if a != b and usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= 0.93]
    degree = {i: 0 for i, *_ in data}
    for a, _ in links:
        degree[a] += 1
    component = components_of(degree, links)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    for block in (2048, 16):
        found = embeddings.near_vectors(df, block=block).collect()
        assert {r.vec_id: r.n_links for r in found} == degree
        assert {r.vec_id: r.component_id for r in found} == component
        assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert len(links) > 100 and embeddings.near_vectors(df.limit(0)).count() == 0


def test_media_round_trip(docs, rows, none):
    found = {r.doc_id: r for r in media.text_media(docs).collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.encode_samples(payload)
        assert media.decode_samples(stored) == payload and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({(found[i].media_sha256, found[i].feature) for i in (20, 51, 52)}) == 1
    assert media.text_media(none).count() == 0


def test_sequences_keep_order_and_captions(spark):
    html = "<html><head><title>t</title></head><body><p>One <b>two</b></p><figure><img src='sha256:aa'><figcaption>First &amp; best</figcaption></figure>three<img src='x.png' alt='alt text'><script>no</script><p>four</p></body></html>"
    items = media.parse_sequence(html)
    assert [(i["position"], i["kind"], i["text"], i["caption"]) for i in items] == [(0, "text", "One two", None), (1, "media", None, "First & best"), (2, "text", "three", None), (3, "media", None, "alt text"), (4, "text", "four", None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>only text")], "page_id long, html string")
    store = spark.createDataFrame([("aa", 7)], "digest string, size long")
    out = {r.page_id: r["items"] for r in media.resolve(media.parse_pages(pages), store, "page_id").collect()}
    assert [i.media and i.media.size for i in out[1]] == [None, 7, None, None, None]
    assert out[2] == [] and [i.text for i in out[3]] == ["only text"]


def test_whole_pages_table_parses(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    parsed = media.parse_pages(pages)
    assert parsed.count() == pages.count()
    assert all([i.position for i in r["items"]] == list(range(len(r["items"]))) for r in parsed.select("items").collect())


def labelled(spark, toxic):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.2
        text = words(rng, rng.randint(20, 60))
        if toxic and bad:
            text += " " + rng.choice(("scumlike", "trashy", "moronic"))
        if not toxic and bad:
            text = " | ".join(text.upper().split()) + "!!" * 5
        data.append((i, text))
        if rng.random() < 0.8:
            labels.append((i, int(bad) if toxic else 1 - int(bad)))
    data += [(900, ""), (901, None), (902, "x" * 10000)]
    labels += [(900, None), (777777, 1)]
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int")


def auc(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark, toxic=True)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels, label_col="y").collect()}
    assert len(found) == 503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    known = [(r.y, found[r.doc_id].score) for r in labels.collect() if r.y is not None and r.doc_id in found and found[r.doc_id].held_out]
    assert auc(known) > 0.95
    flipped = labels.withColumn("y", F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, 1 - F.col("y")).otherwise(F.col("y")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped, label_col="y").collect()}
    assert again == {i: r.score for i, r in found.items()}
    bare = toxicity.toxicity(docs, labels.limit(0), label_col="y").collect()
    assert len({r.score for r in bare}) == 1 and toxicity.toxicity(docs.limit(0), labels, label_col="y").count() == 0


def test_nn_pu_risk_gradient_finds_the_marker():
    rng = np.random.default_rng(0)
    xp = np.c_[np.ones(80), rng.integers(0, 2, 80)].astype(np.int8)
    xu = np.r_[xp[:20], np.c_[np.zeros(180), rng.integers(0, 2, 180)].astype(np.int8)]
    w, b = toxicity.nn_pu(xp, xu, 0.1, toxicity.PuParams(), 0)
    assert w[0] > 2 and abs(w[1]) < 2 and 1 / (1 + np.exp(-b)) < 0.3


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, toxic=False)
    found = {r.doc_id: r for r in quality.quality(docs, labels, label_col="y").collect()}
    assert len(found) == 503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    known = [(r.y, found[r.doc_id].score) for r in labels.collect() if r.y is not None and r.doc_id in found and found[r.doc_id].held_out]
    assert auc(known) > 0.95
    bare = quality.quality(docs, labels.limit(0), label_col="y").collect()
    assert {r.score for r in bare} == {0.5} and quality.quality(docs.limit(0), labels, label_col="y").count() == 0


def test_gam_learns_a_pair_that_no_single_feature_shows():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, quality.GamParams(rounds=20))
    assert (0, 1) in model.pair_tables and ((model.log_odds(x) > 0) == y).mean() > 0.9
    alone = quality.fit(x, y, quality.GamParams(rounds=20, pairs=0))
    assert ((alone.log_odds(x) > 0) == y).mean() < 0.7


def brute_targets(sizes, most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark, docs, rows, none):
    found = mixing.mix(docs).collect()
    size = {r[0]: len(SPACE.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    totals = {}
    for i, n in size.items():
        totals[source[i]] = totals.get(source[i], 0) + n
    target = brute_targets(totals)
    taken = dict.fromkeys(totals, 0)
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == totals[source[r.doc_id]] and math.isclose(r.target, target[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(found) == len(rows)
    # whole copies can't come nearer where one document is larger than its source's target
    huge = source[len(rows) - 1]
    assert all(abs(taken[s] - target[s]) <= (4000 if s == huge else max(40, 0.05 * target[s])) for s in totals), (taken, target)
    assert sorted(mixing.mix(docs.repartition(2)).collect()) == sorted(found) and mixing.mix(none).count() == 0


def test_targets_stop_at_three_times_the_source(spark):
    data = [("a", 1), ("b", 10), ("c", 100), ("d", 1000), (None, 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(data, "source string, size long")).collect()}
    want = brute_targets(dict(data))
    assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want) and math.isclose(sum(got.values()), 1111)


def test_newton_meets_every_target(spark):
    cells = spark.createDataFrame([(0, 2, 1, 64, 192.0), (1, 2, 1, 12, 0.5)], "sid long, length int, lang int, words long, target double")
    rates = {r.sid: r.rate for r in mixing.balance(cells).collect()}
    assert rates[0] == 3.0 and math.isclose(rates[1], 0.5 / 12, rel_tol=1e-7)


@pytest.mark.parametrize("soft", [0.02, 0.5])
def test_balanced_rates_are_the_optimum(spark, soft):
    """Against the conditions of the optimum, and against plain coordinate descent on the dual."""
    rng = np.random.default_rng(int(soft * 100))
    cells, totals = [], {}
    for sid in range(9):
        for length, lang in {(int(x), int(y)) for x, y in zip(rng.integers(0, 5, 8), rng.integers(0, 3, 8), strict=True)}:
            n = int(rng.integers(1, 5000))
            cells.append((sid, length, lang, n))
            totals[sid] = totals.get(sid, 0) + n
    targets = {s: t for s, t in brute_targets({f"{s}": n for s, n in totals.items()}).items()}
    data = [(*c, float(targets[str(c[0])])) for c in cells]
    found = {(r.sid, r.length, r.lang): r.rate for r in mixing.balance(spark.createDataFrame(data, "sid long, length int, lang int, words long, target double"), soft=soft).collect()}
    for s in totals:
        taken = sum(c[3] * found[c[:3]] for c in cells if c[0] == s)
        assert math.isclose(taken, targets[str(s)], rel_tol=1e-6)
    total = sum(totals.values())
    kept = {("length", k): sum(c[3] for c in cells if c[1] == k) for k in range(5)} | {("lang", k): sum(c[3] for c in cells if c[2] == k) for k in range(3)}
    mu = dict.fromkeys(kept, 0.0)
    rates = {}
    for _ in range(400):  # exact in each source, then a damped step in each class
        for s in totals:
            own = [c for c in cells if c[0] == s]
            low, high = -60.0, 60.0
            for _ in range(80):
                mid = (low + high) / 2
                got = sum(c[3] * min(3.0, math.exp(mid + mu["length", c[1]] + mu["lang", c[2]])) for c in own)
                low, high = (mid, high) if got < targets[str(s)] else (low, mid)
            rates |= {c[:3]: min(3.0, math.exp(low + mu["length", c[1]] + mu["lang", c[2]])) for c in own}
        for key in mu:
            off = sum(c[3] * rates[c[:3]] for c in cells if (c[1] if key[0] == "length" else c[2]) == key[1]) - kept[key] + soft * total * mu[key]
            mu[key] -= 0.5 * off / (kept[key] + soft * total)
    assert all(math.isclose(rates[k], found[k], rel_tol=2e-4) for k in found), max(abs(rates[k] - found[k]) for k in found)
    assert len({round(r, 6) for r in found.values()}) > 9  # documents of one source differ


def test_rows_alike_stand_in_runs(spark):
    rows = [(1, "a")] * 7 + [(None, "a")] * 3 + [(2, None)]
    found = [tuple(r) for r in common.runs(spark.createDataFrame(rows, "id long, t string"), ["id", "t"], 3).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [(1, "a", 0, 3), (1, "a", 1, 3), (1, "a", 2, 1), (None, "a", 0, 3), (2, None, 0, 1)]))


def test_slots_and_copies_of_an_id_that_a_third_of_the_rows_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 4)
    rows = [(None, "same words here", "a", "en")] * 300 + [(7, f"w{i} same", "b", "en") for i in range(300)] + [(i, f"w{i} x y z", "b", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    found = sharding.shard_by_bytes(docs, shards=3, per_bucket=20).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(t) + 8) for i, t, *_ in rows)
    for shard in range(3):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    mixed = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == Counter((i, s, len(t.split())) for i, t, s, _ in rows)
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in mixed)
    by_cell = {}
    for r in mixed:
        by_cell.setdefault((r.source, r.size), set()).add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in by_cell.values())  # a cell's copies are spread evenly
    for source in "ab":
        taken, target = sum(r.taken for r in mixed if r.source == source), next(r.target for r in mixed if r.source == source)
        assert abs(taken - target) <= 4
    assert sorted(map(str, mixing.mix(docs.repartition(2)).collect())) == sorted(map(str, mixed))


def test_mix_of_repeated_huge_and_missing_ids_and_clashing_names(spark):
    rows = [(1, "a b c", "s", None), (1, "a b c", "s", "en"), (None, "d", None, "en"), ((1 << 63) - 1, "e f", "t", "de"), (2, None, "t", "de"), (3, "", None, None)]
    docs = spark.createDataFrame([(*r, 7, 8, 9, "x", "y", 1) for r in rows], "doc_id long, text string, source string, lang string, size long, sid int, n long, slice string, target string, copies int")
    found = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r.size, r.source or "") for r in found) == sorted((i or 0, len((t or "").split()), s or "") for i, t, s, _ in rows)
    assert found[0].asDict().keys() == {"doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"}


def test_patience_aligns_unique_anchors_and_blocks():
    a, b = [1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 8, 4, 5, 1]
    m = linededup.patience(a, b)
    assert m == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)] and linededup.blocks(m) == [[1, 2, 3], [5, 6]]
    assert linededup.patience([], [1]) == [] and linededup.patience([1, 1], [1, 1, 1]) == [(0, 0), (1, 1)]
    rng = random.Random(0)
    for _ in range(200):
        x, y = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        got = linededup.patience(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_line_dedup(spark, none):
    rng = random.Random(9)
    block = [words(rng, 20), words(rng, 15), words(rng, 30)]
    own = lambda n: [words(rng, 12) for _ in range(n)]
    a, b, c, d = own(2) + block + own(1), own(1) + block + own(2), own(3) + [block[0]] + own(1), own(2) + block[:2] + own(1) + block[2:]
    common = ["Short boilerplate line."]
    texts = {1: common + a, 2: common + b, 3: c, 4: d, 5: own(4) + common, 6: common + a}
    data = [(i, "\n".join(t), "x") for i, t in texts.items()] + [(7, "", "x"), (8, None, "x"), (9, "\n\n", "x")]
    found = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string, key string")).collect()}
    kept = lambda i: found[i].text.split("\n")
    assert kept(1) == texts[1] and kept(3) == texts[3] and kept(5) == texts[5]
    assert kept(2) == [x for x in texts[2] if x not in block] and kept(4) == [x for x in d if x not in block]
    assert found[6].removed_lines == len(texts[6]) and found[6].text == "" and found[6].key == "x"
    assert (found[7].text, found[8].text, found[9].text) == ("", None, "\n\n") and len(found) == 9
    assert linededup.dedup_lines(none).count() == 0


def test_a_line_in_very_many_documents_is_paired_with_its_first_holder_only(spark):
    rng = random.Random(1)
    shared = words(rng, 60)
    data = [(i, f"{words(rng, 9)}\n{shared}\n{words(rng, 9)}") for i in range(60)]
    out = {r.doc_id: r.removed_lines for r in linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out == {0: 0} | {i: 1 for i in range(1, 60)}


def test_no_run_of_lines_stays_in_two_documents(spark):
    """Short lines, blocks in any order and repeated, held by few or by very many documents."""
    rng = random.Random(4)
    shared = [[words(rng, rng.choice([3, 8, 12, 30])) for _ in range(6)] for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [[words(rng, 9)] for _ in range(3)] + rng.choices(shared, k=rng.choice([0, 1, 2, 3])) + [shared[0]] * (i % 2)
        rng.shuffle(parts)
        texts.append("\n".join(x for p in parts for x in p))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text.split("\n") for r in linededup.dedup_lines(rows).collect()}
    seen = {}
    for i, text in enumerate(texts):
        lines = text.split("\n")
        for k, end in linededup.runs([len(x.split()) for x in lines], 25):
            first = seen.setdefault(tuple(lines[k:end]), i)
            if first != i:
                assert not any("\n".join(found[i][j : j + end - k]) == "\n".join(lines[k:end]) for j in range(len(found[i]))), (i, first)
    held = {x for block in shared for x in block}
    for i, text in enumerate(texts):
        assert [x for x in found[i] if x not in held] == [x for x in text.split("\n") if x not in held]  # what is a document's own stays
    assert "\n".join(found[0]) == texts[0]


def windows(text, n):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_no_long_run_of_words_stays_in_two_documents(spark):
    """Short lines, blocks in any order and repeated, held by few or by very many documents, against every window of 50 words."""
    rng = random.Random(4)
    shared = [[words(rng, rng.choice([3, 8, 12, 30])) for _ in range(6)] for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [[words(rng, 9)] for _ in range(3)] + rng.choices(shared, k=rng.choice([0, 1, 2, 3])) + [shared[0]] * (i % 2)
        rng.shuffle(parts)
        texts.append("\n".join(x for p in parts for x in p))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in linededup.dedup_lines(rows).collect()}
    seen = set()
    for i, text in enumerate(texts):
        assert not windows(found[i], 50) & seen, i
        seen |= windows(text, 50)
    held = {x for block in shared for x in block}
    for i, text in enumerate(texts):
        own = [x for x in text.split("\n") if x not in held]
        assert [x for x in found[i].split("\n") if x in own] == own  # what is a document's own stays
    assert found[0] == texts[0]


def without_shared_blocks(texts: list[str], min_words: int) -> list[str]:
    """All pairs of documents, plainly: a line goes if it lies in equal lines in a row, of so many words, of an earlier document."""
    out = []
    for late, text in enumerate(texts):
        lines = text.split("\n")
        gone = set()
        for early in texts[:late]:
            other = early.split("\n")
            for i in range(len(other)):
                for j in range(len(lines)):
                    n = 0
                    while i + n < len(other) and j + n < len(lines) and other[i + n] == lines[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[j : j + n]) >= min_words:
                        gone.update(range(j, j + n))
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_final_texts_match_all_pairs_of_documents(spark, seed):
    """Passages of some lines in any order, repeated inside a document or held by a third of all, between lines of a document's own."""
    rng = random.Random(seed)
    passages = ["\n".join(words(rng, rng.randint(4, 30)) for _ in range(rng.randint(1, 5))) for _ in range(12)]
    texts = []
    for k in range(36):
        held = rng.choices(passages, k=rng.randint(0, 5)) + ([passages[0]] if k % 3 == 0 else [])
        rng.shuffle(held)
        parts = [words(rng, rng.randint(3, 50))]
        for passage in held:
            parts += [passage, words(rng, rng.randint(3, 50))]
        texts.append("\n".join(parts))
    want = without_shared_blocks(texts, 25)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.text for r in linededup.dedup_lines(rows).collect()}
    assert sum(x != y for x, y in zip(texts, want, strict=True)) > 15
    assert [found[k] for k in range(len(texts))] == want


def test_words_that_agree_in_half_of_their_hash_are_unlike():
    """Pieces are compared by all 64 bits, so 32 equal ones don't delete a line."""
    rng = random.Random(14)
    pieces = [np.frombuffer(linededup._marks_and_chunks([words(rng, 30).encode()], 25)[1][0].as_py()[0], linededup._PIECE) for _ in range(2)]
    assert pieces[0]["h"].dtype == np.int64 and (np.abs(pieces[0]["h"]) >> 32).any()
    low = pieces[0]["h"].tolist()
    high = [h ^ 1 << 40 for h in low]  # equal in their lower halves
    n = pieces[0]["n"].tolist()
    assert linededup.common_blocks(low, high, n, n, [], 25) == (set(), set())
    assert linededup.common_blocks(low, low, n, n, [], 25) == (set(range(len(low))), set())


def test_words_lines_and_pieces_of_odd_texts():
    rng = random.Random(2)
    texts = ["", " ", "a", "a\n\nb  c\t d\n", "x" * 3_000_000, words(rng, 5000), "\n".join(words(rng, 9) for _ in range(50)), "é\u00a0é ü", "same " * 3000]
    raws = [t.encode() for t in texts]
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    joined = b"\n".join([*raws, b""])
    w = linededup.scan(joined, starts[:-1])
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", joined)]
    assert list(zip(w.start.tolist(), w.end.tolist(), strict=True)) == at
    assert w.line.tolist() == [joined[:s].count(b"\n") for s, _ in at[:3000]] + w.line.tolist()[3000:]
    assert [joined[s:e] for s, e in at] and len({(h, joined[s:e]) for h, (s, e) in zip(w.hash.tolist(), at, strict=True)}) == len({joined[s:e] for s, e in at}) == len(set(w.hash.tolist()))
    marks, chunks = linededup._marks_and_chunks(raws, 25)
    for k, text in enumerate(texts):
        pieces = np.frombuffer(b"".join(chunks[k].as_py()), linededup._PIECE)
        assert (pieces["n"] // 2).sum() == len(text.encode().split()) and (pieces["n"] % 2).sum() == sum(bool(x.split()) for x in text.encode().split(b"\n")) and all(len(c) == linededup._PIECE.itemsize * linededup.CHUNK for c in chunks[k].as_py()[:-1])
        assert linededup.without(text, np.array([], int)) == (text, 0)
        assert linededup.without(text, np.arange(len(pieces)))[0].split() == []
    alone = linededup._marks_and_chunks([raws[5]], 25)
    assert alone[0][0] == marks[5] and alone[1][0] == chunks[5]


def test_winnowing_chooses_in_every_window():
    rng = np.random.default_rng(6)
    group = np.repeat(np.arange(40), rng.integers(0, 90, 40))
    h = rng.integers(0, 1 << 60, len(group)).astype(np.uint64)
    chosen = set(linededup.winnowed(h, group, 26).tolist())
    want = set()
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        for k in range(max(1, len(at) - 25)):
            want.add(int(at[k : k + 26][np.argmin(h[at[k : k + 26]])]))
    assert chosen == want


def test_line_dedup_of_repeated_huge_and_missing_ids_and_clashing_names(spark):
    rng = random.Random(17)
    text = lambda n: words(rng, n)
    passage, own = text(60), [text(40) for _ in range(6)]
    big = (1 << 63) - 1
    rows = [(5, f"{passage} {own[0]}"), (5, f"{own[1]} {passage}"), (5, f"{passage} {own[0]}"), (big, f"{own[2]} {passage} {own[3]}"), (None, f"{passage} {own[4]}"), (None, None), (-big, own[5])]
    names = "doc_id long, text string, _line_key int, _line_removed string, removed array<int>, row int, late long, id string, n_lines string, removed_lines string"
    docs = spark.createDataFrame([(i, t, k, "r", [1], k, 2, "x", "y", "z") for k, (i, t) in enumerate(rows)], names)
    out = linededup.dedup_lines(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    found = {r["_line_key"]: r for r in out.collect()}
    assert len(found) == len(rows) and all((r.doc_id, r["_line_removed"], r["removed"], r["row"], r["late"], r["id"]) == (rows[k][0], "r", [1], k, 2, "x") for k, r in found.items())
    assert found[0].text == found[2].text and {found[0].text == rows[0][1], found[1].text == rows[1][1]} == {True, False}  # the lesser content is the earlier
    assert found[5].text is None and found[5].n_lines == 0 and found[6].text == own[5]
    inside = windows(passage, 25)
    assert not windows(found[3].text, 25) & inside and not windows(found[4].text, 25) & inside
    assert found[3].text.split()[:30] == own[2].split()[:30] and found[3].text.split()[-30:] == own[3].split()[-30:]


def test_a_passage_glued_into_other_lines_goes(spark):
    rng = random.Random(12)
    shared = [words(rng, 30), words(rng, 24), words(rng, 30)]
    glued = lambda i: "\n".join([words(rng, 9), f"{words(rng, 12)} {shared[0]}", shared[1], f"{shared[2]} {words(rng, 12)}", words(rng, 9)])
    texts = [glued(i) for i in range(20)] + [f"{words(rng, 10)} {shared[0]} {words(rng, 10)}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in linededup.dedup_lines(rows).collect()}
    passage = " ".join(shared).split()
    windows = {tuple(passage[k : k + 25]) for k in range(len(passage) - 24)}
    assert found[0] == texts[0]
    for i in range(1, 21):
        left = found[i].split()
        assert not any(tuple(left[k : k + 25]) in windows for k in range(len(left))), i
        own = texts[i].split()
        assert left[:8] == own[:8] and left[-8:] == own[-8:]
    assert linededup.without("a b\n\nc", np.array([], int)) == ("a b\n\nc", 0)


def test_documents_of_one_topic_share_a_shard(spark):
    """Copies and topical neighbours meet, whatever their ids; one large topic is split."""
    rng = random.Random(3)
    topics = [[words(rng, 1) + str(t) + x for x in "abcdefghij"] for t in range(4)]
    data = [(i, " ".join(rng.choices(topics[i % 4], k=30))) for i in range(400)]
    rows = spark.createDataFrame(data, "doc_id long, text string")
    found = packing.pack(rows, tokenizer_path("byte_bpe_50k.json"), window=4096, per_shard=100).collect()
    mixed = {}
    for r in found:
        mixed.setdefault(r.sequence_id >> packing._SEQUENCE_BITS, []).append(r.doc_id % 4)
    same = sum(max(x.count(t) for t in range(4)) for x in mixed.values())
    assert len(mixed) <= 4 and same > 0.8 * len(found)
    alike = spark.createDataFrame([(i, "the same text") for i in range(400)], "doc_id long, text string")
    sizes = {}
    for r in packing.pack(alike, tokenizer_path("byte_bpe_50k.json"), window=64, per_shard=100).collect():
        sizes.setdefault(r.sequence_id >> packing._SEQUENCE_BITS, set()).add(r.doc_id)
    assert len(sizes) == 4 and max(map(len, sizes.values())) < 150
