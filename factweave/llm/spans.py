"""Cross-tokenizer alignment: the spans of two tokenizers over one text, cut into the groups on which both agree."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import record, stash, text_of
from factweave.llm.packing import byte_ranks, load_tokenizer
from factweave.llm.token_counts import load_model, splits_at_spaces

#: Pairs of ids whose counts travel with the tasks (24 bytes each); all others are joined.
HOT = 200_000
#: Characters of texts whose distinct units are aligned together, units that are encoded as one text, and units whose links are in hand at a time.
_CHARS, _UNITS, _LINKED = 9_000_000, 500, 500_000
#: Stands before a unit that is written out in full.
_FULL = "\0"
#: Where a text isn't simply cut at spaces and line breaks: white space follows one, or ``_FULL`` is a character of its own.
_HARD = re.compile("^\\s|[ \\n]\\s|\0")
#: Where a text may be cut: both tokenizers end there, whatever stands before and after.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def units(text: str) -> list[str]:
    """``" " + text`` cut before spaces and line breaks that follow other characters.

    Neither tokenizer has a token across such a cut, so units can be aligned apart and put together.
    A unit that starts with one space is written without it, one that starts with one line break as it
    is, any other one in full after ``_FULL``.
    """
    if _HARD.search(text):
        return [_FULL + p if p[1:2].isspace() or p[1:2] == _FULL else p[p[0] == " " :] for p in _CUT.split(" " + text)]
    return text.replace("\n", " \n").split(" ")


def written(unit: str) -> str:
    """A unit's own characters."""
    return unit[1:] if unit[:1] == _FULL else unit if unit[:1] == "\n" else " " + unit


@dataclass
class Units:
    """Aligned units: tokens of A and B, groups and links of each, whether its bytes don't come back, its groups as text; distinct pairs, and the links of all units in a row as numbers of these."""

    counts: np.ndarray
    unlike: np.ndarray
    groups: pa.StringArray
    pairs: np.ndarray
    links: np.ndarray
    ends: np.ndarray


class Aligner:
    """Spans of both tokenizers over units.

    Tokenizer A's spans are in characters and B's in bytes of what it was given. They are coarse where a
    character has several tokens: all of A's tokens in it claim the whole character, and of B's byte
    tokens the last one does. There the decoded bytes of the tokens give the cuts.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = load_tokenizer(path_a), load_model(path_b)
        self.a.encode_special_tokens = True
        ranks = byte_ranks(self.a.get_vocab(with_added_tokens=False))
        self.bytes_a = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.is_byte = np.array([byte for _, byte in pieces], bool)
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.space = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def _encode(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids and spans of A, ids and span ends of B for ``text``, which starts with a space or line break; none if its bytes don't come back."""
        found = self.a.encode(text, add_special_tokens=False)
        lead = int(text[0] == " ")  # the model puts a space before what it is given: the text's own, or one to leave out
        pieces = [(p.id, p.end + lead) for p in self.b.encode(text[lead:], return_type="proto").pieces]
        if not lead:
            pieces = pieces[1:] if pieces and pieces[0][0] == self.space else []
        elif text == " ":
            pieces = [(self.space, 1)]  # the model gives nothing for an empty text
        ids_a, ids_b = found.ids, [i for i, _ in pieces]
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) == text.encode() == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            return tuple(np.array(x, np.int32) for x in (ids_a, found.offsets, ids_b, [e for _, e in pieces]))
        return None

    def learn(self, new: list[str]) -> Units:
        """The alignments of distinct units. Units that may stand side by side are encoded as one text, which is taken apart again."""
        alone = [not u or u[0] == _FULL or u[-1].isspace() for u in new]
        easy = [i for i, x in enumerate(alone) if not x]
        chunks = [easy[k : k + _UNITS] for k in range(0, len(easy), _UNITS)] + [[i] for i, x in enumerate(alone) if x]
        full = list(map(written, new))
        unlike = np.zeros(len(new), bool)
        order, texts, found = [], [], []
        while chunks:
            own = chunks.pop()
            text = "".join([full[i] for i in own])
            coded = self._encode(text)
            if coded is not None:
                order += own
                texts.append(text)
                found.append(coded)
            elif len(own) > 1:
                chunks += [[i] for i in own]
            else:
                unlike[own[0]] = True
        return self._align(order, [full[i] for i in order], texts, found, unlike)

    def _align(self, order: list[int], full: list[str], texts: list[str], found: list, unlike: np.ndarray) -> Units:
        width = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        width = 1 + (width > 0x7F).astype(np.int64) + (width > 0x7FF) + (width > 0xFFFF)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        char0 = np.cumsum([0, *map(len, texts)])
        n_a, n_b = np.array([len(f[0]) for f in found], np.int64), np.array([len(f[2]) for f in found], np.int64)
        flat = lambda k: np.concatenate([np.empty((0, 2) if k == 1 else 0, np.int32), *(f[k].reshape(-1, 2) if k == 1 else f[k] for f in found)]).astype(np.int64)
        ids_a, ids_b = flat(0), flat(2)
        exact_a, exact_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        spans = flat(1) + np.repeat(char0[:-1], n_a)[:, None]
        inside = np.concatenate((spans[1:, 0] < spans[:-1, 1], [False]))[: len(spans)]  # the next token starts in the same character
        cut_a = np.where(inside, exact_a, byte_at[spans[:, 1]])
        cut_b = np.where(self.is_byte[ids_b], exact_b, flat(3) + np.repeat(byte_at[char0[:-1]], n_b))
        ends = byte_at[np.cumsum([0, *map(len, full)])]
        near = np.minimum(np.searchsorted(cut_b, cut_a), max(len(cut_b) - 1, 0))
        both = cut_a[cut_b[near] == cut_a] if len(cut_b) else cut_a[:0]
        if not (np.array_equal(cut_a, exact_a) and np.array_equal(cut_b, exact_b) and np.array_equal(both[np.minimum(np.searchsorted(both, ends[1:]), len(both) - 1)], ends[1:])):
            raise ValueError("the tokenizers' spans disagree with the bytes of their tokens or reach across units")
        cuts = np.sort(np.concatenate((cut_a, cut_b)), kind="stable")
        cuts = cuts[np.concatenate(([True], cuts[1:] != cuts[:-1]))[: len(cuts)]]
        pairs, codes = np.unique(ids_a[np.searchsorted(cut_a, cuts)] << 32 | ids_b[np.searchsorted(cut_b, cuts)], return_inverse=True)

        def joined(ids: np.ndarray, cut: np.ndarray) -> pa.Array:
            bounds = np.concatenate(([0], np.searchsorted(cut, both) + 1)).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids).cast(pa.string())), ",")

        group = pc.binary_join_element_wise(joined(ids_a, cut_a), joined(ids_b, cut_b), "|")
        upto = {k: np.searchsorted(x, ends, side="right") for k, x in (("a", cut_a), ("b", cut_b), ("g", both), ("l", cuts))}
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto["g"].astype(np.int32)), group), ";")
        # back from the order of encoding to the units' own; unlike units have nothing
        place = np.full(len(unlike), -1)
        place[order] = np.arange(len(order))
        counts = np.zeros((len(unlike), 4), np.int64)
        counts[order] = np.stack([np.diff(upto[k]) for k in "abgl"], axis=1)
        own = place[place >= 0]
        take = _spread(upto["l"][own], counts[place >= 0, 3])
        return Units(counts, unlike, text.take(pa.array(place, mask=place < 0)), pairs, codes[take], np.cumsum(counts[:, 3]))

    def cut_up(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units of all texts, the units of each as numbers, and where each text's end."""
        hard = [i for i, t in enumerate(texts) if _HARD.search(t)]
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        sizes = np.array(pc.list_value_length(split), np.int64)
        values = split.values
        if hard:
            parts = [units(texts[i]) for i in hard]
            easy = np.ones(len(texts), bool)
            easy[hard] = False
            kept = split.filter(pa.array(easy))
            values = pa.concat_arrays([kept.flatten(), pa.array([u for p in parts for u in p], pa.string())])
            sizes[hard] = [len(p) for p in parts]
            first = np.empty(len(texts), np.int64)
            by = np.concatenate((np.flatnonzero(easy), hard)).astype(np.int64)
            first[by] = np.cumsum(sizes[by]) - sizes[by]
        coded = values.dictionary_encode()
        numbers = np.array(coded.indices, np.int64)
        if hard:
            numbers = numbers[_spread(first, sizes)]
        return coded.dictionary.to_pylist(), numbers, np.cumsum(sizes)

    def texts(self, column: list[str]) -> Iterator[tuple[np.ndarray, list[str], pa.Array, pa.Array]]:
        """For some texts at a time: counts, digests of groups, and each text's distinct pairs with their numbers of links."""
        some, size = [], 0
        for i, text in enumerate(column):
            some.append(text if text and "▁" not in text else "")
            size += len(text)
            if size >= _CHARS or i == len(column) - 1:
                yield from self._some(some)
                some, size = [], 0

    def _some(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], pa.Array, pa.Array]]:
        names, numbers, ends = self.cut_up([t for t in texts if t])
        known = self.learn(names)
        sizes = np.zeros(len(texts), np.int64)
        sizes[[i for i, t in enumerate(texts) if t]] = np.diff(ends, prepend=0)
        ends = np.cumsum(sizes)
        bad = np.add.reduceat(np.append(known.unlike[numbers], False), np.minimum(ends - sizes, len(numbers))) * (sizes > 0)
        at = 0
        while at < len(texts):
            if bad[at]:
                # a unit's bytes don't come back: only those of the whole text decide
                whole = self.learn([_FULL + " " + texts[at]])
                yield self._summed(whole, np.zeros(1, np.int64), np.array([int(not whole.unlike[0])]))
                at += 1
                continue
            base = ends[at] - sizes[at]
            upto = max(at + 1, int(np.searchsorted(ends, base + _LINKED, side="right")))
            wrong = np.flatnonzero(bad[at:upto])
            upto = at + int(wrong[0]) if len(wrong) else upto
            yield self._summed(known, numbers[base : ends[upto - 1]], sizes[at:upto])
            at = upto

    def _summed(self, known: Units, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[str], pa.Array, pa.Array]:
        numbers = numbers[: sizes.sum()]
        text = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.stack([np.bincount(text, known.counts[numbers, k], len(sizes)).astype(np.int64) for k in range(4)], axis=1)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), known.groups.take(pa.array(numbers))), ";")
        digests = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(groups.to_pylist(), sizes.tolist(), strict=True)]
        each = known.counts[numbers, 3]
        held = np.sort(np.repeat(text, each) * max(len(known.pairs), 1) + known.links[_spread(known.ends[numbers] - each, each)])
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))[: len(held)])
        times = np.diff(np.append(first, len(held)))
        owner, pair = np.divmod(held[first], max(len(known.pairs), 1))
        bounds = pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32())
        return counts, digests, pa.ListArray.from_arrays(bounds, pa.array(known.pairs[pair])), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, as many as ``sizes[i]``, for all i in a row."""
    total = np.cumsum(sizes)
    return np.repeat(first - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for all tasks of a Python worker."""
    return Aligner(path_a, path_b)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        for batch in batches:
            at = 0
            for counts, digests, pairs, times in known.texts(batch.column(1).to_pylist()):
                numbers = {c: pa.array(counts[:, k]) for k, c in enumerate(_COUNTS)}
                yield record(id=batch.column(0).slice(at, len(counts)), **numbers, groups_sha256=pa.array(digests, pa.string()), pairs=pairs, times=times)
                at += len(counts)

    return texts.mapInArrow(run, f"id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, pairs array<long>, times array<int>")


def _scored(rows: DataFrame, shared) -> DataFrame:
    """``rows`` with sums over links by ``shared`` counts instead of the links, and ``cold``: those whose pairs it lacks."""
    kept = ["row", "id", *_COUNTS, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, n, best = shared.value
        for batch in batches:
            pairs = batch.column("pairs")
            bounds = np.array(pairs.offsets, np.int64)
            pair, times = np.array(pairs.flatten()), np.array(batch.column("times").flatten(), np.int64)
            owner = np.repeat(np.arange(len(batch)), np.diff(bounds))
            if len(hot):
                at = np.minimum(np.searchsorted(hot, pair), len(hot) - 1)
                held = hot[at] == pair
            else:
                at, held = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
            sums = np.zeros((2, len(batch)), np.int64)
            for k, value in enumerate((best, n)):
                np.add.at(sums[k], owner[held], times[held] * value[at[held]] if len(hot) else 0)
            cold = pa.StructArray.from_arrays([pa.array(pair[~held]), pa.array(times[~held])], ["pair", "times"])
            ends = pa.array(np.searchsorted(owner[~held], np.arange(len(batch) + 1)), pa.int32())
            own = {c: batch.column(c) for c in kept}
            yield record(**own, n_best=pa.array(sums[0]), count_sum=pa.array(sums[1]), cold=pa.ListArray.from_arrays(ends, cold))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, n_best long, count_sum long, cold array<struct<pair: long, times: long>>")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every whole text.

    Texts are cut into units where both tokenizers end, and the distinct units of a batch are aligned
    once. Each text is stored with its distinct pairs of linked ids (``a << 32 | b``) and how many links
    each has, so that texts are encoded once. Pairs are counted over all texts, with partial counts
    before the shuffle. Then links are summed: the commonest pairs, ``hot`` at most and of fixed size, go to every
    task, and links of all others are joined to their counts by pair and summed by row. An id of A
    has at most as many pairs as B has ids.

    Null and empty texts, and those whose tokens don't give back their bytes (U+2581 reads as a
    space), have zeros and ``''``. Rows that repeat an id or a text are texts of their own and count
    each; a very long text is one row like any other; an empty table gives no rows; other columns are ignored.
    """
    if not splits_at_spaces(path_b):
        raise ValueError("a piece of this model reaches across spaces or line breaks")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = stash(_aligned(texts, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counted = stash(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", 32).alias("a")
    most = counted.groupBy(a).agg(F.max("n").alias("most"))  # a row per id of A
    pairs = stash(counted.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))
    level = F.floor(F.log2("n") * 16).cast("int")
    least, taken = 0, 0
    for r in sorted(pairs.groupBy(level.alias("level")).agg(F.count("*").alias("n_pairs")).collect(), reverse=True):
        taken += r.n_pairs
        if taken > hot:
            least = r.level + 1
            break
    top = pairs.filter(level >= least).toArrow()  # hot rows at most
    order = np.argsort(np.array(top["pair"]), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(np.array(top[c])[order] for c in ("pair", "n", "best")))
    scored = stash(_scored(rows, shared))
    cold = scored.select("row", F.inline("cold")).join(pairs, "pair")
    cold = cold.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = scored.drop("cold").join(cold, "row", "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.select(F.col("id").alias(id_col), *_COUNTS, more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
