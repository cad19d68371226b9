"""Line deduplication by pairwise alignment of documents that share rare lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import map_rows, record, stash, text_of

#: One word of so many, by its hash, ends a piece of a line.
_CUT = 6
#: Removed words in a row that a line which keeps others must have; fewer may be equal by chance.
_LEAST_PART = 5
#: Words of a line that may pair documents; shorter ones do so as parts of runs.
_LEAST_LINE = 8
#: Pieces that are compared and sent together.
CHUNK = 64
#: Bytes of text that are hashed at a time.
_BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
#: Hash of a piece, and twice its words, plus one at the end of a line.
_PIECE = np.dtype([("h", "<i8"), ("n", "<i4")])
#: Bits of a mark's place for each of its three lengths.
_BITS = 10


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    values[_SPACE] = 0
    return values


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = pow(_ODD, -1, 1 << 64)
    return tuple(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64).cumprod(dtype=np.uint64))) for base in (_ODD, inverse))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each ``values[start:end]``, the same wherever the span stands: differences of one running sum."""
    size = 1 << max(10, int(len(values)).bit_length())
    up, down = _powers(size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return _mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    """The words of some texts in a row: hash, first byte, end byte, line number and text number of each."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    text: np.ndarray


def scan(raw: bytes, text_starts: np.ndarray) -> Words:
    """Words (runs of anything but ASCII white space) of texts that stand in ``raw`` one after the other, each followed by a line break."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    hashes = []
    at = 0
    while at < len(start):  # a word lies in one block however long it is
        upto = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK)))
        first = start[at]
        hashes.append(_spans(_byte_values()[data[first : end[upto - 1]]], start[at:upto] - first, end[at:upto] - first))
        at = upto
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    text = np.searchsorted(text_starts, start, side="right") - 1
    return Words(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), start, end, line, text)


def piece_ends(w: Words) -> np.ndarray:
    """Words after which a piece ends: chosen by their hash, or last of a line. A passage is cut alike wherever in a line it stands."""
    if not len(w.hash):
        return np.empty(0, np.int64)
    last = np.concatenate((w.line[1:] != w.line[:-1], [True]))
    return np.flatnonzero((w.hash % np.uint64(_CUT) == 0) | last) + 1


def _least_ahead(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least of ``x[i : i + width]`` for each i that has so many, by doubling."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return x if size == width else least(x[: len(x) - (width - size)], x[width - size :])


def winnowed(hashes: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some ``window`` neighbours of one group (of all, where a group has fewer).

    Any stretch of ``window`` hashes that two groups share has a chosen one in it, the same in both.
    """
    if not len(hashes):
        return np.empty(0, np.int64)
    counts = np.bincount(group)
    counts = counts[counts > 0]
    pad = window - 1
    starts = np.concatenate(([0], np.cumsum(counts + pad)))
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)) * pad, counts)
    padded = np.full(starts[-1] + pad, ~np.uint64(0))
    padded[at] = hashes
    least = _least_ahead(padded, window)
    own = np.zeros(len(padded) + pad, np.uint64)
    whole = np.repeat(np.maximum(counts - window, 0), counts)
    begins = at[np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) <= whole]
    own[begins + pad] = least[begins]
    return np.flatnonzero(_least_ahead(own, window, np.maximum)[at] == hashes)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of ``pairs`` (sorted by the first number) in which the second number increases too."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = last[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[at], last[at] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines of ``a`` and ``b``, increasing in both.

    Common ends are matched, lines that occur once on either side anchor what is left, and the
    stretches between anchors are treated alike until nothing more is found.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        where = {h: k for k, h in enumerate(b[j:n], j) if once_b[h] == 1}
        anchors = increasing([(k, where[h]) for k, h in enumerate(a[i:m], i) if once_a[h] == 1 and h in where])
        if anchors:
            for (i0, j0), (i1, j1) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
                todo.append((i0 + 1, i1, j0 + 1, j1))
            out += anchors
    return sorted(out)


def blocks(matches: list[tuple[int, int]]) -> list[list[int]]:
    """The later document's positions in ``matches``, by runs without a gap in either document."""
    out: list[list[int]] = []
    before = None
    for i, j in matches:
        if before == (i - 1, j - 1):
            out[-1].append(j)
        else:
            out.append([j])
        before = (i, j)
    return out


def runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """From each line on, the shortest run of lines with ``min_words`` words, as first line and end."""
    total = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(total, total[:-1] + min_words).tolist()
    return [(k, end) for k, end in enumerate(ends) if end < len(total)]


def both_runs(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The ``runs``, and the shortest ones up to each line: together they cover a shared block to its last line."""
    n = len(words)
    return runs(words, min_words) + [(n - end, n - k) for k, end in runs(words[::-1], min_words)]


def common_blocks(a: list[int], b: list[int], a_words: list[int], b_words: list[int], known: list[tuple[int, int]], min_words: int) -> tuple[set[int], set[int]]:
    """Positions of ``b`` to delete: those that alignment finds, and those that it can't order.

    ``a_words`` and ``b_words`` are twice the words of the pieces, plus one at the end of a line; ``known`` are spans of
    ``b`` that stand in ``a`` too. An aligned block counts if it has ``min_words`` words; at an end
    inside a line it may go on in the pieces that stand next to it, so half of the smaller counts too.
    Where a span is not in an aligned block, it stands in another order or more than once: then
    runs of ``min_words`` words that ``a`` holds anywhere are deleted too.
    """
    inside = lambda words, k: words[k] // 2 if 0 <= k < len(words) else 0
    open_ = lambda words, k: 0 <= k < len(words) and not words[k] % 2
    matches = patience(a, b)
    shift = {j: i for i, j in matches}
    aligned: set[int] = set()
    for run in blocks(matches):
        j, k = run[0], run[-1]
        i, m = shift[j], shift[k]
        size = 2 * sum(b_words[x] // 2 for x in run)
        if open_(a_words, i - 1) and open_(b_words, j - 1):
            size += min(inside(a_words, i - 1), inside(b_words, j - 1))
        if open_(a_words, m) and open_(b_words, k):
            size += min(inside(a_words, m + 1), inside(b_words, k + 1))
        if size >= 2 * min_words:
            aligned.update(run)
    if all(aligned.issuperset(range(s, e)) for s, e in known):
        return aligned, set()
    held = {tuple(a[i:end]) for i, end in both_runs([n // 2 for n in a_words], min_words)}
    crossed = {j for k, end in both_runs([n // 2 for n in b_words], min_words) if tuple(b[k:end]) in held for j in range(k, end)}
    return aligned, crossed - aligned


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``(row, id, doc, marks, chunks)``: what may pair a document, and its pieces of lines in chunks.

    A mark is the hash ``h`` of a line of some words, or a sure one, of a run of words: whole lines with
    ``min_words`` words, and three fifths of so many words chosen by winnowing, so that every stretch of eight
    fifths that two documents share has a run that is chosen in both. ``place`` bounds the pieces that lie
    inside it, by first piece, number of pieces and sureness.
    """
    if _run_words(min_words)[1] >= 1 << _BITS:
        raise ValueError("so long runs have no place")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends, rows = [0], []
            size = 0
            for text in batch.column(2).to_pylist():
                rows.append(text.encode("utf-8", "surrogatepass"))
                size += len(rows[-1])
                if size >= _BLOCK:
                    ends.append(len(rows))
                    size = 0
            if ends[-1] < len(rows):
                ends.append(len(rows))
            parts = [_marks_and_chunks(rows[i:j], min_words) for i, j in zip(ends, ends[1:], strict=False)]
            marks, chunks = (pa.concat_arrays([p[k] for p in parts]) for k in (0, 1))
            return record(id=batch.column(0), doc=batch.column(1), marks=marks, chunks=chunks)

        return apply

    rows = docs.select(F.col(id_col).cast("long").alias("id"), document_key(id_col, text_col).alias("doc"), text_of(text_col).alias("text"))
    made = map_rows(rows, make, "id long, doc long, marks array<struct<h: long, place: long>>, chunks array<binary>")
    return made.withColumn("row", F.monotonically_increasing_id())


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _marks_and_chunks(raws: list[bytes], min_words: int) -> tuple[pa.ListArray, pa.ListArray]:
    starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
    w = scan(b"\n".join([*raws, b""]), starts[:-1])
    n_words = len(w.hash)
    ends = piece_ends(w)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    pieces = np.empty(len(ends), _PIECE)
    pieces["h"] = _spans(w.hash, begins, ends).view(np.int64)
    pieces["n"] = 2 * (ends - begins) + (np.concatenate((w.line[1:] != w.line[:-1], [True]))[ends - 1] if n_words else 0)
    owner = w.text[begins] if len(ends) else np.empty(0, np.int64)
    first = np.searchsorted(owner, np.arange(len(raws)))  # each text's first piece

    position = np.arange(len(ends)) - first[owner]
    chunk_starts = np.flatnonzero(position % CHUNK == 0)
    offsets = (np.concatenate((chunk_starts, [len(ends)])) * _PIECE.itemsize).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(chunk_starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pieces.tobytes())])
    chunks = _lists(held, owner[chunk_starts], len(raws))

    line_starts = np.flatnonzero(np.concatenate(([True], w.line[1:] != w.line[:-1]))) if n_words else np.empty(0, np.int64)
    line_ends = np.concatenate((line_starts[1:], [n_words]))[: len(line_starts)]
    counts = np.bincount(w.text, minlength=len(raws))
    text_ends = np.repeat(np.cumsum(counts), counts)
    run, stretch = _run_words(min_words)

    size = line_ends - line_starts
    single = (size >= _LEAST_LINE) & (size < stretch)
    # the shortest run of whole lines with enough words; longer ones hold a whole stretch
    filled = np.searchsorted(line_ends, line_starts + min_words)
    upto = line_ends[np.minimum(filled, len(line_ends) - 1)] if n_words else line_ends
    several = (filled < len(line_ends)) & (upto <= text_ends[line_starts]) & (upto - line_starts < stretch)
    starts_of = [line_starts[single & ~several], line_starts[several]]
    ends_of = [line_ends[single & ~several], upto[several]]

    inside = np.flatnonzero(np.arange(n_words) + run <= text_ends)
    hashes = _spans(w.hash, inside, inside + run)
    chosen = winnowed(hashes, w.text[inside], stretch - run + 1)
    starts_of.append(inside[chosen])
    ends_of.append(inside[chosen] + run)

    start, end = np.concatenate(starts_of), np.concatenate(ends_of)
    h = _spans(w.hash, start, end)
    sure = np.repeat([False, True, True], [len(x) for x in starts_of])
    spread = np.where(np.repeat([False, False, True], [len(x) for x in starts_of]), start // run, 0)  # a line counts once, a run that a text repeats once in so many words
    text = w.text[start]
    order = np.lexsort((start, h, text))
    h, sure, start, end, text, spread = (x[order] for x in (h, sure, start, end, text, spread))
    at, upto = np.searchsorted(begins, start), np.searchsorted(ends, end, side="right")
    once = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (spread[1:] != spread[:-1])))[: len(h)] & (upto > at)
    h, sure, text, at, upto = (x[once] for x in (h, sure, text, at, upto))
    place = (at - first[text] << _BITS | upto - at) << 1 | sure
    return _lists(pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(place)], ["h", "place"]), text, len(raws)), chunks


def _run_words(min_words: int) -> tuple[int, int]:
    """Words of a chosen run, and of a stretch that is sure to have one."""
    return max(1, min_words * 3 // 5), max(2, min_words * 8 // 5)


def without(text: str, removed: np.ndarray) -> tuple[str, int]:
    """``text`` without the numbered pieces, and how many lines went whole; a line that keeps a part keeps its own white space."""
    raw = text.encode("utf-8", "surrogatepass")
    w = scan(raw + b"\n", np.zeros(1, np.int64))
    ends = piece_ends(w)
    gone = np.zeros(len(ends), bool)
    gone[removed[removed < len(ends)]] = True
    gone = np.repeat(gone, np.diff(np.concatenate(([0], ends))))
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10).tolist()
    line_starts, line_ends = [0, *(k + 1 for k in breaks)], [*breaks, len(raw)]
    touched = np.unique(w.line[gone])
    bounds = np.searchsorted(w.line, [touched, touched + 1])
    out, whole, at = [], 0, 0
    for line, i, j in zip(touched.tolist(), *bounds.tolist(), strict=True):
        out += [raw[s:e] for s, e in zip(line_starts[at:line], line_ends[at:line], strict=True)]
        at = line + 1
        if gone[i:j].all():
            whole += 1
            continue
        kept, start = [], line_starts[line]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone[i:j], [0])))).reshape(-1, 2) + i
        for first, end in edges.tolist():
            if end - first >= _LEAST_PART:
                kept.append(raw[start : w.start[first] if end < j else (w.end[first - 1] if first > i else start)])
                start = w.start[end] if end < j else line_ends[line]
        out.append(b"".join([*kept, raw[start : line_ends[line]]]))
    out += [raw[s:e] for s, e in zip(line_starts[at:], line_ends[at:], strict=True)]
    return b"\n".join(out).decode("utf-8", "surrogatepass"), whole


def document_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))


def shared_chunks(lines: DataFrame, rare: int) -> DataFrame:
    """``(late, early, id, shared, parts)``: pairs of documents with what they share and the chunks of both around it.

    A line pairs its documents if it is rare (in ``rare`` documents at most); chosen runs do so however
    many documents hold them. Each holder is paired with the earliest one only, so pairs grow
    with the text and not with the square of a group, and only chunks next to something shared
    are sent, so a long popular document is not copied into each of its pairs.
    """
    held = lines.select("id", "doc", F.inline("marks"))
    sure = F.bool_or(F.col("place") % 2 == 1)
    first = held.groupBy("h").agg(F.count("*").alias("n"), sure.alias("sure"), F.min(F.struct(F.col("id").isNull(), "id", "doc", "place")).alias("first"))
    first = stash(first.filter((F.col("n") > 1) & ((F.col("n") <= rare) | F.col("sure"))).select("h", F.col("first.doc").alias("early"), F.col("first.place").alias("there")))
    met = held.select("h", "id", F.col("doc").alias("late"), F.col("place").alias("here")).join(first, "h").filter("late != early")
    pairs = met.groupBy("late", "early").agg(F.min("id").alias("id"), F.collect_set(F.struct("here", "there")).alias("shared"))
    at = lambda s, c: F.shiftrightunsigned(s[c], _BITS + 1)
    upto = lambda s, c: at(s, c) + F.shiftrightunsigned(s[c], 1).bitwiseAND((1 << _BITS) - 1)
    chunk = lambda x: F.floor(x / CHUNK).cast("int")
    around = lambda c: F.array_distinct(F.flatten(F.transform("shared", lambda s: F.sequence(F.greatest(chunk(at(s, c)) - 1, F.lit(0)), chunk(upto(s, c) - 1) + 1))))
    pairs = stash(pairs.withColumns({"own": around("here"), "other": around("there")}))
    late = pairs.select("late", "early", "id", F.col("late").alias("doc"), F.lit(True).alias("own"), F.explode("own").alias("chunk"), F.when(F.col("chunk") == F.array_min("own"), F.col("shared")).alias("shared"))
    early = pairs.select("late", "early", "id", F.col("early").alias("doc"), F.lit(False).alias("own"), F.explode("other").alias("chunk"), F.lit(None).alias("shared"))
    # one row stands for all that repeat it, so that what they hold is sent once
    standing = stash(lines.groupBy("doc").agg(F.min("row").alias("row")))
    needed = stash(late.unionByName(early).join(standing, "doc"))
    parts = needed.join(lines.select("row", F.posexplode("chunks").alias("chunk", "pieces")), ["row", "chunk"])
    return parts.groupBy("late", "early", "id").agg(F.flatten(F.collect_list("shared")).alias("shared"), F.collect_list(F.struct("own", "chunk", "pieces")).alias("parts"))


def _joined(parts: dict[int, bytes], gap: int) -> tuple[list[int], list[int], dict[int, int], list[int]]:
    """Chunks in order as one list of hashes and one of words, where each chunk begins in it, and positions in the document; ``gap`` stands between chunks that are no neighbours."""
    hashes, words, begins, places, before = [], [], {}, [], None
    for chunk in sorted(parts):
        if before is not None and chunk != before + 1:
            hashes.append(gap)
            words.append(1)
            places.append(-1)
        begins[chunk] = len(hashes)
        pieces = np.frombuffer(parts[chunk], _PIECE)
        hashes += pieces["h"].tolist()
        words += pieces["n"].tolist()
        places += range(chunk * CHUNK, chunk * CHUNK + len(pieces))
        before = chunk
    return hashes, words, begins, places


def aligned_pieces(pairs: DataFrame, min_words: int) -> DataFrame:
    """``(late, id, aligned, crossed)``: numbers of a later document's pieces that the earlier one holds, by ``common_blocks``."""

    def make():
        def one(shared: list[dict], parts: list[dict]) -> tuple[list[int], list[int]]:
            own, other = ({p["chunk"]: p["pieces"] for p in parts if p["own"] == side} for side in (True, False))
            b, words, begins, places = _joined(own, -1 << 64)
            a, a_words, _, _ = _joined(other, -1 << 65)  # gaps are no 64-bit numbers, so they equal no hash
            known = []
            for place in {s["here"] for s in shared if s["here"] % 2}:
                at, n = place >> _BITS + 1, place >> 1 & (1 << _BITS) - 1
                start = begins[at // CHUNK] + at % CHUNK
                known.append((start, start + n))
            return tuple(sorted({places[j] for j in found}) for found in common_blocks(a, b, a_words, words, known, min_words))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [one(s, p) for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kind = pa.list_(pa.int32())
            return record(late=batch.column(0), id=batch.column(1), aligned=pa.array([f[0] for f in found], kind), crossed=pa.array([f[1] for f in found], kind))

        return apply

    return map_rows(pairs.select("late", "id", "shared", "parts"), make, "late long, id long, aligned array<int>, crossed array<int>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 8, min_words: int = 25) -> DataFrame:
    """``docs`` with the text of later documents cleared of aligned blocks, and ``n_lines`` and ``removed_lines``.

    Documents are ordered by id, those without one last, then by content; rows that repeat id and
    text are one document and treated alike. Lines are cut at words that their hash chooses
    and compared by 64-bit hashes of these pieces' words, so a block may begin and end inside lines; up to a piece of
    it stays at such an end. Every stretch of eight fifths of ``min_words`` words that an
    earlier document holds is compared with the earliest document that holds a run of it. ``removed_lines`` counts lines that went whole. Texts without a removed piece stay byte for
    byte; a document may end up empty but no row is dropped. A null text stays null; places in a text are
    32-bit numbers, which Spark's largest text fits; an empty table gives no rows; further columns are kept, but for any called ``n_lines`` or ``removed_lines``,
    whose places the counts take.
    """
    lines = stash(line_table(docs, id_col, text_col, min_words))
    removed = aligned_pieces(shared_chunks(lines, rare), min_words).select("late", "id", F.explode(F.array_union("aligned", "crossed")).alias("piece"))
    removed = stash(removed.groupBy("late", "id").agg(F.collect_set("piece").alias("removed")))
    # the same join at every size: small results would otherwise be broadcast and hide what large ones cost
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), document_key(id_col, text_col).alias("late"))
    known = removed.select("late", F.col("id").alias("late_id"), "removed").hint("merge")
    rows = rows.join(known, (rows["late"] == known["late"]) & rows["id"].eqNullSafe(known["late_id"]), "left").select("row", "removed")
    text = F.col("row")[text_col]

    @F.pandas_udf("text string, whole int")
    def cleared(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        found = [(None, 0) if r is None else without(t or "", np.asarray(r)) for t, r in zip(texts, removed, strict=True)]
        return pd.DataFrame(found, columns=["text", "whole"])

    gone = F.col("removed").isNotNull()
    rows = rows.withColumn("cleared", cleared(F.when(gone, text), "removed"))
    kept = [F.when(gone, F.col("cleared.text")).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "removed_lines")]
    return rows.select(*kept, F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).alias("n_lines"), F.col("cleared.whole").alias("removed_lines"))
