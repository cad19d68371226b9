"""SimHash near-duplicates, with candidates from pigeonring chains of segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import map_rows, record, stash, text_of
from factweave.llm.components import connected_components

BITS = 64
#: Row v holds the bits of byte v, lowest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``, repeats included.

    A-Z are lower-cased, words are split at ASCII white space; fewer words than a shingle make one
    shingle of all of them, no words make zero. A bit is set if it is set in over half the hashes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (np.concatenate(([0], ends[: -shingle])))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 4096:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(octets), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` with the signed fingerprint of every whole text; a null text counts as empty."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = [simhash(t, shingle) for t in batch.column(1).to_pylist()]
            return record(id=batch.column(0), fp=pa.array(fps, pa.int64()))

        return apply

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), make, "id long, fp long")


def rotated(fp: Column, by: Column) -> Column:
    """``fp`` as 64 bits turned left."""
    turned = F.call_function("shiftleft", fp, by).bitwiseOR(F.call_function("shiftrightunsigned", fp, F.lit(BITS) - by))
    return F.when(by == 0, fp).otherwise(turned)


def chain_holds(x: Column, segments: int, most: int) -> Column:
    """The pigeonring test on two rotated fingerprints' differences ``x``.

    Counted from the chain's start, the first ``l`` consecutive segments may hold at most
    ``l * most / segments`` differences, for every ``l``.
    """
    width, holds = BITS // segments, F.lit(True)
    for length in range(segments - 1, 0, -1):
        if length * most // segments != (length + 1) * most // segments or length == segments - 1:  # the longest of each budget implies the shorter
            holds = holds & (F.bit_count(F.shiftrightunsigned(x, BITS - width * length)) <= length * most // segments)
    return holds


def near_pairs(classes: DataFrame, most: int = 2, segments: int = 16, in_bucket: int = 128) -> DataFrame:
    """Links ``(a, b)`` between rows of ``classes(rep, fp)`` (fingerprints distinct) that join all whose fingerprints differ in at most ``most`` bits.

    Pigeonring principle: on the ring of segments, some start exists from which every prefix of
    consecutive segments stays within its proportional budget. All prefixes with a budget below one
    difference must be equal, so each row is dealt to one bucket per start by those segments
    (28 bits of 64 for 16 segments and 2 differences). In a bucket, pairs have to pass the chain's
    further budgets before the full Hamming check.

    A bucket with more than ``in_bucket`` rows isn't paired off, which would grow with its square. Its
    rows are tied through the values within one differing bit of them instead: two fingerprints
    differ in at most two bits just if they share such a value, and at most 65 fingerprints share
    one. That way is exact too, for ``most`` = 2, and yields the same components.
    """
    if most != 2:
        raise ValueError("the way for large buckets is exact for two differing bits")
    width = BITS // segments
    equal = max(length for length in range(1, segments + 1) if length * most < segments)
    start = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("start")
    keyed = classes.select("rep", "fp", start).withColumn("turned", rotated(F.col("fp"), F.col("start") * width))
    keyed = keyed.withColumn("key", F.shiftrightunsigned("turned", BITS - width * equal))
    full = stash(keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = stash(keyed.join(full, ["start", "key"]))
    few = rows.filter(F.col("n") <= in_bucket).select("start", "key", "rep", "turned")
    left, right = (few.select("start", "key", F.col("rep").alias(r), F.col("turned").alias(t)) for r, t in (("a", "ta"), ("b", "tb")))
    x = F.col("ta").bitwiseXOR(F.col("tb"))
    paired = left.join(right, ["start", "key"]).filter((F.col("a") < F.col("b")) & chain_holds(x, segments, most) & (F.bit_count(x) <= most))
    many = rows.filter(F.col("n") > in_bucket).select("rep", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    shared = many.select("rep", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("within"))
    tied = shared.groupBy("within").agg(F.sort_array(F.collect_set("rep")).alias("reps")).filter("size(reps) > 1")  # at most 65
    tied = tied.select(F.col("reps")[0].alias("a"), F.explode(F.slice("reps", 2, BITS)).alias("b"))
    return paired.select("a", "b").unionByName(tied).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """One row per document: ``(id_col, fp, component_id)``.

    Documents with fingerprints at ``most`` or fewer differing bits are linked, ``component_id`` is
    the smallest id reachable. Null, empty and white-space texts have fingerprint zero and link like
    any other; an empty table gives no rows; further columns are ignored. Equal fingerprints are one
    class from the start, so a large group of copies costs one candidate. Rows that repeat an id are
    judged each by its own text; a group without any id has a null component.
    """
    fps = stash(fingerprints(docs, id_col, text_col, shingle))
    classes = stash(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    linked = connected_components(near_pairs(classes.select(F.col("fp").alias("rep"), "fp"), most))
    placed = stash(classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("group")))
    least = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = stash(placed.join(least, "group").select("fp", "component_id"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
