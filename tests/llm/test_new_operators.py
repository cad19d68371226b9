"""URL trust, whitening and span alignment against their SQL, numpy and whole-text forms."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factweave.llm import packing, spans, urltrust, whitening
from factweave.llm.queries import tokenizer_path
from tests.compare import rows_of, spark_rows

PAGES = "page_id long, url string, html string, host string, rule string, trust double"


def page(url, links=(), i=0):
    return (i, url, "".join(f'<a class=x HREF="{x}">t</a>' for x in links) or None, "h", "r", 0.5)


def web():
    """Every rule and its borders, then hosts without rules that link to and from seeds; odd urls last."""
    found = [page(u) for u in ("http://a.org/x", "https://EXAMPLE.org/es/1?q=/en/1", "http://m.example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1#a", "http://x.com/es/", "http://org", "http://notorg/", "http://xexample.org/es/")]
    found += [page("http://good.net/1", ["http://a.org/", "/own", "//far.net/x"]), page("http://a.org/y", ["https://Liked.net/z?x", "//liked.net:80/", "http://hub.net"]), page("http://liked.net/a", ["http://deep.net/"] * 3)]
    found += [page("http://bad.net/", ["http://m.example.org/en/1", "http://x.com/de/9"]), page("http://worse.net/", ["http://bad.net/", "http://a.org/"]), page("http://deep.net/", ["http://liked.net/"]), page("http://both.net/", ["http://x.com/"])]
    found += [page("http://hub.net/1", [f"http://n{i}.net/" for i in range(40)]), *(page(f"http://n{i}.net/", ["http://bad.net/"] * (i % 3)) for i in range(40)), *[page("http://hub.net/1")] * 5]
    found += [page(None, ["http://a.org/"]), page(""), page("no scheme/org/", ["http://a.org/"]), page("http://"), page("://b.org/x"), page("a\nhttp://c.org/\n"), page("http://u@c.org:8/x"), page("http://é.ORG/É?")]
    return [(i, *r[1:]) for i, r in enumerate(found)] + [(3, *found[3][1:]), (None, *found[0][1:])]


def test_urls_as_their_sql(spark, tmp_path):
    spark.createDataFrame(web(), PAGES).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for more in ({"rounds": 9}, {"threshold": 0.2, "damping": 0.5, "rounds": 4, "least": 0.0}, {"rounds": 0}):
        want = con.execute(urltrust.sql(**more))
        columns = [c[0] for c in want.description]
        found = urltrust.judge_urls(spark.read.parquet(str(tmp_path / "pages.parquet")), **more)
        assert spark_rows(found) == rows_of(columns, want.fetchall())


def test_verdicts_of_rules_and_links(spark):
    data = web()
    found = {r.page_id: r for r in urltrust.judge_urls(spark.createDataFrame(data, PAGES), rounds=9).collect()}
    got = {data[i][1]: (r.host, r.path, r.rule, r.verdict) for i, r in found.items() if i is not None}
    assert got["http://a.org/x"] == ("a.org", "/x", "org/", "allow")
    assert got["https://EXAMPLE.org/es/1?q=/en/1"] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got["http://m.example.org/en/12"][2:] == ("example.org/en/1", "block") and got["http://example.org/en/2"][2:] == ("org/", "allow")
    assert got["http://x.com/fr/1"][2:] == ("com/fr/", "allow") and got["http://x.com/de/1#a"] == ("x.com", "/de/1", "com/de/", "block") and got["http://x.com/es/"][2] is None
    assert got["http://org"][1:3] == ("", None) and got["http://notorg/"][2] is None and got["http://xexample.org/es/"][2] == "org/"
    assert [got[u][3] for u in ("http://bad.net/", "http://worse.net/", "http://liked.net/a", "http://deep.net/", "http://n0.net/")] == ["block", "block", "allow", "allow", "allow"]
    assert found[10].trust == 0 < found[10].distrust  # linking to a trusted host earns no trust, leading to a blocked one some distrust
    assert all(got[u] == ("", "", None, "allow") for u in (None, "", "no scheme/org/", "http://")) and got["://b.org/x"][0] == "b.org" and got["http://é.ORG/É?"][:2] == ("é.org", "/É")
    assert urltrust.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_ranks_are_personalised_pagerank(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(12)]
    links = {(a, b): rng.randint(1, 5) for a in hosts for b in rng.sample(hosts, 3) if a != b}
    seeds = {"h0": (0.5, 0.0), "h1": (0.25, 0.1), "h5": (0.0, 0.15)}
    found = urltrust.spread(spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long"), damping=0.6, rounds=40)
    got = {r.host: (r.trust, r.distrust) for r in found.collect()}
    for k in (0, 1):
        m = np.zeros((12, 12))
        for (a, b), n in links.items():
            a, b = (hosts.index(a), hosts.index(b))[:: 1 - 2 * k]
            m[b, a] = n
        m /= np.maximum(m.sum(0), 1)
        want = np.linalg.solve(np.eye(12) - 0.6 * m, 0.4 * np.array([seeds.get(h, (0, 0))[k] for h in hosts]))
        assert np.allclose([got.get(h, (0, 0))[k] for h in hosts], want, atol=1e-8)


VECTORS = "vec_id long, embedding array<float>, n int, component string, id int"


def brute_whitening(data):
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in data]
    n, sums = len(x), [sum(c) for c in zip(*(v for _, v in x), strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for _, v in x]
    centred = np.array([v for _, v in x], np.float64) - np.array(sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, e[::-1], u[:, ::-1]


def test_whitening_as_by_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2
    good = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    good += [good[0]] * 40 + [(None, good[5][1])]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [])]
    other = [(800, [1.0, 2.0]), (801, [1.0, 2.0]), (802, [3.0])]
    rows = [(i, v, 7, "c", 1) for i, v in good + bad + other]
    rng.shuffle(rows)
    found = whitening.whiten(spark.createDataFrame([(i and int(i), v, 7, "c", 1) for i, v, *_ in rows], VECTORS).repartition(5)).collect()
    n, deviation, centred, e, u = brute_whitening(good)
    mine = [r for r in found if r.n == n]
    assert len(mine) == 8 * n and {r.component for r in mine} == set(range(1, 9))
    assert sorted(r.deviation for r in mine if r.component == 1) == sorted(deviation) and all(int(r.deviation_exact) == r.deviation for r in mine)
    for k in range(8):
        want = centred @ u[:, k] / math.sqrt(e[k])
        got = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in mine if r.component == k + 1)
        ids = sorted((-1 if i is None else i, w) for (i, _), w in zip(good, want, strict=True))
        sign = np.sign(got[3][1] * ids[3][1])
        assert [i for i, _ in got] == [i for i, _ in ids] and np.allclose([w * sign for _, w in got], [w for _, w in ids], atol=1e-9)
        assert all(math.isclose(r.explained, e[k] / e.sum(), rel_tol=1e-9) for r in mine if r.component == k + 1)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9
    rest = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in found if r.n != n)
    assert rest == [(800, 1, 2, 0, None, None), (800, 2, 2, 0, None, None), (801, 1, 2, 0, None, None), (801, 2, 2, 0, None, None), (802, 1, 1, 0, None, None)]
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_of_huge_entries_stays_exact(spark):
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[1e12, 0.0], [-1e12, 1.0], [5.0, 2.0], [3e38, 1.0]])]
    found = whitening.whiten(spark.createDataFrame([(i, v, 0, "", 0) for i, v in data], VECTORS)).collect()
    x = [[min(math.floor(1024 * c), 2**62 - 1) + 100_000 for c in v] for _, v in data]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: None if r.deviation_exact is None else int(r.deviation_exact) for r in found} == {i: w if w < 10**38 else None for i, w in want.items()}
    assert all(r.deviation is None for r in found if want[r.vec_id] >= 1 << 63)


@pytest.mark.parametrize("values", [[5, 3, 2, 1, 0.5], [1, 1, 1, 1, 1], [2 + 1e-9, 2, 2 - 1e-9, 1, 1e-12], [1e6, 1e6 - 1e-6, 1, 1, 0], [0, 0, 0, 0, 0]])
def test_refined_eigenvectors(values):
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(5, 5)))[0].astype(np.longdouble)
    v = np.array((q * np.array(values, np.longdouble)) @ q.T, np.float64)
    v = (v + v.T) / 2
    e, x = whitening.refined_eigen(v)
    top = max(values) or 1
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=4e-15 * top)
    assert np.abs(x.T @ x - np.eye(5)).max() < 1e-15 and np.abs(v.astype(np.longdouble) @ x - x * e).max() < 2e-15 * top


A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {i: t for t, i in packing.byte_ranks(a.get_vocab(with_added_tokens=False)).items()}
    return a, b, byte


def whole_tokens(both, text):
    """Ids and bytes of both tokenizers' tokens of a whole text; none where its bytes don't come back."""
    a, b, byte = both
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [byte[i] for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def brute_alignment(both, data):
    out, held = {}, Counter()
    links = {}
    for i, text in data:
        found = whole_tokens(both, text)
        if found is None:
            out[i] = (0,) * 4 + ("",)
            continue
        ids_a, bytes_a, ids_b, bytes_b = found
        ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (bytes_a, bytes_b))
        owner_a, owner_b = ([k for k, t in enumerate(x) for _ in t] for x in (bytes_a, bytes_b))
        links[i] = [(ids_a[p], ids_b[q]) for p, q in dict.fromkeys(zip(owner_a, owner_b, strict=True))]
        held.update(set(links[i]))
        groups, p, q = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            u, w = ends_a.index(cut, p) + 1, ends_b.index(cut, q) + 1
            groups.append(",".join(map(str, ids_a[p:u])) + "|" + ",".join(map(str, ids_b[q:w])))
            p, q = u, w
        out[i] = (len(ids_a), len(ids_b), len(groups), len(links[i]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return {i: (*x[:4], sum(held[k] == best[k[0]] for k in links.get(i, ())), sum(held[k] for k in links.get(i, ())), x[4]) for i, x in out.items()}


ODD = [
    None, "", " ", "\n", "  ", "\n\n", "a", " a", "a ", "a\n", "\na", "\n\na", " \na", "a  b", "a \n b", "a\n\n\nb", "a\t b\t\tc \t", "a  b 　c", "　", "x\r\ny\r\n\r\n z", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ a ▁b", "a▁b",
    "héllo wörld ñandú", "日本語 テキスト です", "🜁 🜁🜂 ①ﬁ 👩‍👩‍👧 é̂", "x" * 3000, "né nb\x1cc \x1c \x1d\nd", "\x00 a\x00\nb", "it's we'll ' s 's", "a   \n   b", "end with spaces   ", "  a \nb\x85 c", "1234567890 3.14 -- ...", "a﻿b ﻿ c", "\u0000", "½ ² ﷺ\n½",
]


@pytest.mark.parametrize("hot", [spans.HOT, 40, 0])
def test_alignment_as_of_whole_texts(spark, both, hot):
    rng = random.Random(2)
    made = ["".join(rng.choice(("an", " ", " the", "\n", "ü", "日", "🜁", " ber", "\t", "x1", "'s", "  ")) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    data = list(enumerate([*ODD, *made, made[0], made[0], "word " * 4000]))
    df = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in data], "doc_id long, text string, row int, pair string, n_a int").repartition(3)
    want = brute_alignment(both, data)
    got = {r[0]: tuple(r)[1:] for r in spans.align(df, A, B, hot=hot).collect()}
    assert {i for i in want if got[i] != want[i]} == set()
    assert spans.align(df.limit(0), A, B).count() == 0


def test_alignment_of_given_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_alignment(both, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r[0]: tuple(r)[1:] for r in spans.align(docs, A, B).collect()} == want
    twice = docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    assert sum(r.count_sum for r in spans.align(twice, A, B).collect()) == 4 * sum(x[5] for x in want.values())


def test_texts_in_small_parts(spark, both, monkeypatch):
    known = spans.Aligner(A, B)
    texts = [t or "" for t in ODD] * 2 + ["one two\nthree four"] * 3
    whole = list(known.texts(texts))
    for chars, linked in ((40, 7), (10**6, 3), (1, 1)):
        monkeypatch.setattr(spans, "_CHARS", chars)
        monkeypatch.setattr(spans, "_LINKED", linked)
        parts = list(known.texts(texts))
        assert np.concatenate([p[0] for p in parts]).tolist() == np.concatenate([p[0] for p in whole]).tolist()
        for k in (1, 2, 3):
            assert [x for p in parts for x in (p[k] if k == 1 else p[k].to_pylist())] == [x for p in whole for x in (p[k] if k == 1 else p[k].to_pylist())]


def test_packing_in_many_ranges(spark):
    docs = spark.range(11_000).selectExpr("id as doc_id", "concat('number ', id, ' of ', id % 97) as text")
    rows = packing.pack(docs, A, window=64, per_shard=1).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").toArrow().to_pandas()
    assert rows.groupby("doc_id").length.sum().eq(rows.groupby("doc_id").doc_tokens.first()).all() and rows.doc_id.nunique() == 11_000
    assert rows.sequence_id.min() >= 0 and (rows.sequence_id.max() >> packing._SHARD_BITS + packing._SEQUENCE_BITS) >= 5_000
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all() and rows.groupby("sequence_id").length.sum().max() <= 64


def test_long_pretokens_stay_out_of_the_driver(spark, monkeypatch):
    from factweave.llm import token_counts

    seen = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: seen.append(value) or broadcast(self, value))
    texts = [(i, f"{i:04d}" * 2000 + (" tail " + "é" * 40 + f"{i % 3}") * 2) for i in range(300)]
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), B).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    assert found == {i: len(model.encode(t)) for i, t in texts} and seen and all(len(k.encode()) <= token_counts.SHORT for k in seen[0])
