"""Packing documents into windows with the neighbours that a sharded BM25 index retrieves."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import chunks_for, map_rows, record, stash, text_of

#: White space other than space and line break.
_OTHER_SPACE = re.compile("[\\t\\x0b\\x0c\\r\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Characters of text that are encoded together, and of a text that is surely not one endless word.
_AT_ONCE, _SHORT = 4_000_000, 100_000


#: Numbers in a document's content vector.
WIDTH = 32


#: Documents whose vectors are made together.
_DOCS_AT_ONCE = 500


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The tokens of a byte-level vocabulary as bytes. Printable Latin-1 stands for itself, all other bytes for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranks_agree(path: str) -> bool:
    """Whether encoding by ranks is the same as by this file's merges: then a faster encoder may be used.

    It is if ids are in merge order, and every token's own text is encoded as that token: a pair of
    neighbours that ranks would join is then always a pair that some merge joins.
    """
    tokenizer = load_tokenizer(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = {t: i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
    ranks = byte_ranks(vocabulary)
    if len(ranks) != len(vocabulary) or sorted(ranks.values()) != list(range(len(ranks))):
        return False
    return all([x.id for x in tokenizer.model.tokenize(t)] == [i] for t, i in vocabulary.items())


class WordTokenizer:
    """Ids of whole texts from a byte-level BPE tokenizer file, each distinct space-led word of a batch encoded once.

    The tokenizer's own splitting never joins what stands on both sides of a single space between
    two other characters, so words can be encoded apart. Texts with other white space beside a
    space are encoded whole; those with one of the tokenizer's special strings or an endless word go
    to the tokenizer itself, as all do where ``ranks_agree`` doesn't hold.
    """

    def __init__(self, path: str, fast: bool):
        self.tokenizer = load_tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if fast:
            import public_tokenizers
            import tiktoken

            ranks = byte_ranks({t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special})
            self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(len(ranks), np.int64)
            self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text, in order; some four million characters are in hand at a time."""
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= _AT_ONCE:
                yield from self._some(texts[start : i + 1])
                start, size = i + 1, 0
        yield from self._some(texts[start:])

    def _slow(self, text: str) -> bool:
        return self.fast is None or any(s in text for s in self.special) or (len(text) > _SHORT and max(map(len, text.split()), default=0) > _SHORT)

    def _whole(self, text: str) -> bool:
        return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or not text or _OTHER_SPACE.search(text) is not None

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        split = []
        for i, text in enumerate(texts):
            if self._slow(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            elif self._whole(text):
                out[i] = np.array(self.fast.encode_ordinary(text), np.uint32)
            else:
                split.append(i)
        if split:
            # a space before each text makes its first word one like any other; its own ids come from the text's head
            words = pc.split_pattern(pa.array([texts[i] for i in split], pa.string()), " ")
            bounds = np.array(words.offsets)
            coded = words.values.dictionary_encode()
            ids, ends = self._words(coded.dictionary)
            at = np.array(coded.indices)
            starts = np.concatenate(([0], ends[:-1]))
            size = (ends - starts)[at]
            heads = [np.array(self.fast.encode_ordinary(texts[i].partition(" ")[0]), np.uint32) for i in split]
            size[bounds[:-1]] = 0
            total = np.concatenate(([0], np.cumsum(size)))
            flat = ids[np.repeat(starts[at] - total[:-1], size) + np.arange(total[-1])]
            cut = total[bounds]
            for i, head, a, b in zip(split, heads, cut.tolist(), cut[1:].tolist(), strict=False):
                out[i] = np.concatenate((head, flat[a:b]))
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words``, each with a space before it, and where each one's end."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.fast.encode_ordinary(" " + joined), np.uint32)
        reach = np.cumsum(np.array(pc.binary_length(words), np.int64) + 1)
        bytes_to = np.cumsum(self.bytes_of[ids])
        ends = np.searchsorted(bytes_to, reach)
        if not np.array_equal(bytes_to[ends], reach):
            raise ValueError("a token reaches across words")
        return ids, ends + 1


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


class ShardIndex:
    """Inverted index of one shard's documents: for each term the documents that hold it, with BM25 weights.

    The postings of a term that one document in ``dense`` holds are a row over all documents.
    """

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean_length: float, p: Bm25, dense: int = 12):
        self.n = len(terms)
        sizes = np.array([len(t) for t in terms], np.int64)
        doc = np.repeat(np.arange(self.n), sizes)
        term = np.concatenate(terms).astype(np.int64) if self.n else np.empty(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if self.n else np.empty(0)
        length = np.bincount(doc, tf, self.n)
        weight = idf[term] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length[doc] / max(mean_length, 1e-9)))
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.term = term
        held = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(held * dense > self.n)
        self.slot = np.full(len(idf), -1)
        self.slot[common] = np.arange(len(common))
        self.kept = np.arange(self.n)
        self.rows = np.zeros((len(common), self.n), np.float32)
        much = self.slot[term] >= 0
        self.rows[self.slot[term[much]], doc[much]] = weight[much]
        order = np.flatnonzero(~much)
        order = order[np.argsort(term[order], kind="stable")]
        self.docs, self.weights, self.ordered = doc[order], weight[order], term[order]
        self._starts(len(idf))

    def _starts(self, terms: int):
        self.starts = np.searchsorted(self.ordered, np.arange(terms + 1))

    def keep(self, wanted: np.ndarray):
        """Forget the postings of all other documents."""
        held = wanted[self.docs]
        self.docs, self.weights, self.ordered = self.docs[held], self.weights[held], self.ordered[held]
        self._starts(len(self.starts) - 1)
        self.rows, self.kept = np.ascontiguousarray(self.rows[:, wanted[self.kept]]), self.kept[wanted[self.kept]]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document that is kept for all terms of ``seed``."""
        term = self.term[self.bounds[seed] : self.bounds[seed + 1]]
        slot = self.slot[term]
        asked = np.zeros(len(self.rows), np.float32)
        asked[slot[slot >= 0]] = 1
        term = term[slot < 0]
        spans = [slice(a, b) for a, b in zip(self.starts[term].tolist(), self.starts[term + 1].tolist(), strict=True) if a < b]
        out = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n) if spans else np.zeros(self.n)
        out[self.kept] += asked @ self.rows
        return out


def fill_windows(index: ShardIndex, starts: list[int], lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """``(doc, start, length, sequence, offset)``: the shard's open pieces packed into windows.

    Seeds are taken longest piece first. All unused documents are tried best score first (ties by
    number, those without a common term last) and taken whole where they fit; once none fits, the best
    one left is cut and its rest stays unused. So only a shard's last window is padded.
    """
    left = np.array(lengths, np.int64)
    start = list(starts)
    kept = int(np.count_nonzero(left))
    out, sequence = [], -1
    for seed in np.argsort(-left, kind="stable").tolist():
        while left[seed] > 0:
            sequence += 1
            offset = 0

            def take(doc: int, most: int):
                nonlocal offset
                n = int(min(left[doc], most))
                out.append((doc, start[doc], n, sequence, offset))
                start[doc] += n
                left[doc] -= n
                offset += n

            take(seed, window)
            if offset == window:
                continue
            open_ = np.flatnonzero(left)
            if 2 * len(open_) < kept:
                index.keep(left > 0)
                kept = len(open_)
            near = open_[np.argsort(-index.scores(seed)[open_], kind="stable")]
            at = 0
            while offset < window and at < len(near):
                fits = left[near[at:]] <= window - offset
                step = int(fits.argmax())
                if not fits[step]:
                    break
                at += step
                take(int(near[at]), window - offset)
                at += 1
            for doc in near[left[near] > 0][:1].tolist() if offset < window else ():
                take(doc, window - offset)
    return out


def directions(terms: int, width: int = WIDTH) -> np.ndarray:
    """A fixed random direction for each vocabulary id."""
    return np.random.default_rng(7).standard_normal((terms, width)).astype(np.float32)


def centres(vectors: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` spherical k-means centres, each next to a similar one in order."""
    k = min(most, len(vectors))
    found = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(8):
        at = np.argmax(vectors @ found.T, axis=1)
        total = np.zeros_like(found)
        np.add.at(total, at, vectors)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        found = np.where(size > 1e-6, total / np.maximum(size, 1e-9), found)
    order, left = [0], set(range(1, k))
    while left:
        order.append(max(left, key=lambda c: (float(found[c] @ found[order[-1]]), -c)))
        left.remove(order[-1])
    return found[order]


def weighted(terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' terms in a row with their weights, and where each document's begin."""
    term = np.concatenate([np.empty(0, np.int64), *terms]).astype(np.int64)
    count = np.concatenate([np.empty(0), *counts])
    return term, (idf[term] * count / (count + 1.2)).astype(np.float32), np.cumsum([0, *map(len, terms)])


def content_vectors(term: np.ndarray, weight: np.ndarray, bounds: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The unit vector of each document's weighted terms, zero for none."""
    out = np.zeros((len(bounds) - 1, to.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(bounds))
    for at in range(0, len(some), _DOCS_AT_ONCE):  # each term of these has a row of its own for a moment
        own = some[at : at + _DOCS_AT_ONCE]
        first, last = bounds[own[0]], bounds[own[-1] + 1]
        out[own] = np.add.reduceat(weight[first:last, None] * to[term[first:last]], bounds[own] - first, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def run_mark(ids: np.ndarray, run: int = 4) -> int:
    """The least hash of a document's runs of ids, 54 bits: near copies mostly have the same one."""
    x = ids.astype(np.uint64) + np.uint64(1)
    h = x if len(x) < run else np.zeros(len(x) - run + 1, np.uint64)
    for k in range(run if len(x) >= run else 0):
        h = (h ^ x[k : len(x) - run + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return int(h.min()) >> 10 if len(h) else 0


def content_keys(term: np.ndarray, weight: np.ndarray, bounds: np.ndarray, mark: np.ndarray, to: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """A number for each document that puts like ones next to each other: its nearest centre, then its mark."""
    near = np.argmax(content_vectors(term, weight, bounds, to) @ middle.T, axis=1) if len(middle) else np.zeros(len(bounds) - 1, np.int64)
    return near << 54 | mark


#: Documents whose vectors the driver sees (about), centres, ranges of keys that are sorted apart, and keys of each that the driver sees (about).
_SAMPLE, _CENTRES, _RANGES, _SEEN = 20_000, 256, 1 << 17, 8
#: Bits of a sequence id for the shard in its range and for the sequence in its shard; the range has the 17 above.
_SHARD_BITS, _SEQUENCE_BITS = 19, 27


def deal(made: DataFrame, n_docs: int, per_range: int, shared, narrow: str) -> DataFrame:
    """``made`` with ``range`` and ``key``: ranges of like content with about ``per_range`` documents; beyond ``_RANGES`` of them they hold more.

    Samples by hash give the centres and the bounds of the ranges; the driver sees ``_SEEN`` keys of each range. Keys that are as common as
    several ranges (copies) are dealt among these by hash, so no range is much larger.
    """
    spark = made.sparkSession
    ranges = min(_RANGES, chunks_for(n_docs, per_range))

    def parts_of(batch: pa.RecordBatch):
        kinds = (("terms", narrow), ("counts", "<u4"))
        return [[np.frombuffer(x, kind) for x in batch.column(c).to_pylist()] for c, kind in kinds]

    def vectors():
        to = directions(len(shared.value))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = content_vectors(*weighted(*parts_of(batch), shared.value), to)
            return record(v=pa.array(found.tolist(), pa.list_(pa.float32())), hash=batch.column("hash"))

        return apply

    def keys(middle, with_bounds):
        def make():
            to = directions(len(shared.value))

            def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
                term, weight, bounds = weighted(*parts_of(batch), shared.value)
                key = content_keys(term, weight, bounds, np.array(batch.column("mark")), to, middle.value)
                if with_bounds is None:
                    return record(key=pa.array(key))
                least, most = (np.searchsorted(with_bounds.value, key, side=s) for s in ("left", "right"))
                at = least + (np.array(batch.column("hash")) & (1 << 40) - 1) % (most - least + 1)
                return pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(key)], [*batch.schema.names, "range", "key"])

            return apply

        return make

    some = lambda most: made.filter(F.pmod("hash", F.lit(1 << 40)) < F.lit(min(1.0, most / max(n_docs, 1)) * (1 << 40)))
    sample = some(_SAMPLE)  # about so many rows in all
    rows = sorted((r.hash, list(r.v)) for r in map_rows(sample.select("terms", "counts", "hash"), vectors, "v array<float>, hash long").collect())
    middle = spark.sparkContext.broadcast(centres(np.array([v for _, v in rows], np.float32).reshape(-1, WIDTH), min(_CENTRES, 4 * ranges)) if rows else np.empty((0, WIDTH), np.float32))
    seen = np.sort(np.array(map_rows(some(max(_SAMPLE, _SEEN * ranges)).select("terms", "counts", "mark"), keys(middle, None), "key long").toArrow()["key"]))
    cuts = spark.sparkContext.broadcast(seen[(np.arange(1, ranges) * len(seen)) // ranges] if len(seen) else np.empty(0, np.int64))
    return map_rows(made, keys(middle, cuts), ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in made.schema] + ["range int, key long"]))


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 3000, bm25: Bm25 = Bm25()
) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A document's ids and ``end_id`` are cut into full windows, each a sequence of its own, and a
    shorter last piece. Documents are put in order of content (nearest of k-means centres of a
    bounded sample, then the least hash of their runs of ids) and this order is cut into shards of about ``per_shard`` (one and a half times so many at most); copies that
    would fill more than a range of it are dealt out by hash. A seed asks its own shard only, with
    all its terms. Each shard builds an inverted index over the token ids of its whole documents, with
    document frequencies of the whole corpus (one row per vocabulary id), and fills its windows as
    ``fill_windows`` says. A third of all documents being alike makes no shard larger. A null or
    empty text has ``end_id`` alone; repeated rows are packed each; other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    fast = ranks_agree(tokenizer_path)
    narrow = "<u2" if max(load_tokenizer(tokenizer_path).get_vocab_size(), end_id) <= 65535 else "<u4"
    end = np.array([end_id], np.uint32)

    def make():
        tokenize = WordTokenizer(tokenizer_path, fast)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            full, tails, totals, terms, counts, marks = [], [], [], [], [], []
            for ids in tokenize(batch.column(1).to_pylist()):
                marks.append(run_mark(ids))
                ordered = np.sort(ids)
                first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
                terms.append(ordered[first].astype(narrow).tobytes())
                counts.append(np.diff(np.concatenate((first, [len(ordered)]))).astype("<u4").tobytes())
                ids = np.concatenate((ids, end))
                whole = len(ids) // window * window
                full.append([zlib.crc32(ids[i : i + window].astype("<u4").tobytes()) for i in range(0, whole, window)])
                tails.append(ids[whole:].astype(narrow).tobytes())
                totals.append(len(ids))
            binary = pa.binary()
            return record(id=batch.column(0), n=pa.array(totals, pa.int64()), full=pa.array(full, pa.list_(pa.int64())), tail=pa.array(tails, binary), terms=pa.array(terms, binary), counts=pa.array(counts, binary), mark=pa.array(marks, pa.int64()))

        return apply

    made = map_rows(rows, make, "id long, n long, full array<long>, tail binary, terms binary, counts binary, mark long")
    made = stash(made.withColumn("hash", F.xxhash64("id", "n", "tail")))

    def frequencies(batches):
        for batch in batches:
            term, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), narrow), return_counts=True)
            yield record(term=pa.array(term.astype(np.int64)), n=pa.array(n.astype(np.int64)))

    df = made.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per vocabulary id
    n_docs, n_terms = made.agg(F.count("*"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    mean_length = n_terms / max(n_docs, 1)
    idf = np.zeros(max((r.term for r in df), default=0) + 1)
    for r in df:
        idf[r.term] = np.log1p((n_docs - r.n + 0.5) / (r.n + 0.5))
    shared = spark.sparkContext.broadcast(idf)
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(rows: list[dict], first: int) -> pa.RecordBatch:
        """A shard's pieces in sequences from ``first`` on."""
        tails = [np.frombuffer(r["tail"], narrow) for r in rows]
        index = ShardIndex([np.frombuffer(r["terms"], narrow) for r in rows], [np.frombuffer(r["counts"], "<u4") for r in rows], shared.value, mean_length, bm25)
        out = []
        for r in rows:
            for k, crc in enumerate(r["full"]):
                out.append((r["id"], k * window, window, crc, r["n"], first + len(out), 0))
        first += len(out)
        for i, start, n, sequence, offset in fill_windows(index, [0] * len(tails), [len(t) for t in tails], window):
            crc = zlib.crc32(tails[i][start : start + n].astype("<u4").tobytes())
            out.append((rows[i]["id"], len(rows[i]["full"]) * window + start, n, crc, rows[i]["n"], first + sequence, offset))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=columns)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at, number = None, 0

        def shard(n: int) -> pa.RecordBatch:
            nonlocal held, number
            rows, held = held[:n], held[n:]
            number += 1
            if number > 1 << _SHARD_BITS:
                raise ValueError(f"range {at} has more shards than a sequence id can tell apart")
            return packed(rows, (at << _SHARD_BITS | number - 1) << _SEQUENCE_BITS)

        def rest() -> Iterator[pa.RecordBatch]:
            if 2 * len(held) > 3 * per_shard:
                yield shard(len(held) // 2)
            if held:
                yield shard(len(held))

        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != at:
                    yield from rest()
                    at, number = r["range"], 0
                held.append(r)
                if len(held) == 2 * per_shard:
                    yield shard(per_shard)
        yield from rest()

    dealt = deal(made, n_docs, 2 * per_shard, shared, narrow)
    dealt = dealt.repartition("range").sortWithinPartitions("range", "key", "hash", "id", "n", "tail", "terms", "counts")
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.select("range", "id", "n", "full", "tail", "terms", "counts").mapInArrow(shards, schema)
