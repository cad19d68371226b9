"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import chunks_for, runs, stash, text_of

#: A group with this part of an even shard's bytes or rows is placed by itself.
GRAIN = 128
#: At most so many buckets reach the last differencing, which runs on the driver.
TOP_BUCKETS = 1024


def difference(parts: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over ``parts``, whose rows are partial partitions of k sums.

    The two partial partitions with the largest spread are combined, one's largest sum with the
    other's smallest, until one is left. Returns labels of the same shape: the shard that gets
    ``parts[i, j]``. A row's columns always go to k different shards.
    """
    n, k = parts.shape
    labels = np.zeros((max(2 * n - 1, 0), k), np.int32)
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = [*np.take_along_axis(parts, order, axis=1)]
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        raw = sums[a] + sums[b][::-1]
        turn = np.argsort(-raw, kind="stable")
        sums[a] = sums[b] = None
        sums.append(raw[turn])
        made.append((a, b, turn))
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    if n:
        labels[-1] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        a, b, turn = made[at]
        labels[a][turn] = labels[n + at]
        labels[b][k - 1 - turn] = labels[n + at]
    out = np.empty((n, k), np.int32)
    np.put_along_axis(out, order, labels[:n], axis=1)
    return out


def _singles(sizes, k: int) -> np.ndarray:
    parts = np.zeros((len(sizes), k), np.int64)
    parts[:, 0] = sizes
    return parts


def _split_bucket(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gid"], ascending=False, kind="stable")
        return pdf[["gid", "bucket", "bytes"]].assign(part=difference(_singles(pdf["bytes"].to_numpy(), k))[:, 0])

    return run


def _merge_buckets(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="bucket", columns="part", values="bytes", fill_value=0).reindex(columns=range(k), fill_value=0)
        labels = difference(wide.to_numpy().astype(np.int64))
        at = np.repeat(wide.index.to_numpy(), k)
        return pd.DataFrame({"bucket": at, "part": np.tile(np.arange(k, dtype=np.int32), len(wide)), "parent": pdf["parent"].iloc[0], "merged": labels.ravel()})

    return run


def _numbered(df: DataFrame, shard: str, id_col: str, rows: int, each: int) -> DataFrame:
    """``slot``: the gapless number of each row in its shard.

    Rows alike in all columns count as runs. Runs are counted off inside buckets of a shard, and each bucket
    starts where those before it end, so a shard or an id that holds most rows is still numbered by many tasks.
    """
    columns = df.columns
    df = runs(df, columns, each)
    df = stash(df.withColumn("_sub", F.pmod(F.xxhash64(id_col, "text_crc32", "_run"), F.lit(chunks_for(rows, each))).cast("long")))
    counts = df.groupBy(shard, "_sub").agg(F.sum("_alike").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(counts.select(shard, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")))
    within = Window.partitionBy(shard, "_sub").orderBy(id_col, "text_crc32", "size", "_run").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_at", F.coalesce(F.sum("_alike").over(within), F.lit(0))).join(starts, [shard, "_sub"])
    first = F.col("_from") + F.col("_at")
    return df.select(*columns, F.explode(F.sequence(first, first + F.col("_alike") - 1)).alias("slot"))


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 20_000) -> DataFrame:
    """One row per document: ``(id, size, text_crc32, shard, slot)``; equal texts share a shard.

    Size is the text's UTF-8 bytes plus 8; a null text counts as empty and shares the empty texts'
    group. Documents are grouped by text digest (pre-aggregated where they are read) and the groups
    are dealt to buckets that one task each splits by differencing. The buckets' partial partitions
    are differenced again, level by level, until at most ``TOP_BUCKETS`` are left; their sums and the
    groups that are large by themselves (at most ``2 * GRAIN * shards``) meet in a last differencing
    on the driver. A group above an even share gets what else its shard must take: nothing. Large
    groups are found by a broadcast of that bounded list and never meet in one join key. Groups of
    equal size are taken in falling order of their digests. An empty table gives no rows; repeated ids and
    rows without one keep their rows; a very long text is a group like any other; other columns are ignored, whatever their names.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("gid")
    )
    groups = stash(rows.groupBy("gid").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    n_groups, n_bytes, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    grain = GRAIN * shards
    large = (F.col("bytes") * grain >= n_bytes) | (F.col("n") * grain >= n_rows)
    alone = groups.filter(large).select("gid", "bytes").collect()  # at most 2 * grain rows

    buckets = chunks_for(n_groups, per_bucket, least=GRAIN)
    small = groups.filter(~large).withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)).cast("long"))
    placed = stash(small.groupBy("bucket").applyInPandas(_split_bucket(shards), "gid string, bucket long, bytes long, part int"))
    sums = placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    while buckets > TOP_BUCKETS:
        buckets = chunks_for(buckets, TOP_BUCKETS // 2, least=GRAIN)
        up = sums.withColumn("parent", F.pmod("bucket", F.lit(buckets)))
        moved = stash(up.groupBy("parent").applyInPandas(_merge_buckets(shards), "bucket long, part int, parent long, merged int"))
        placed = placed.join(moved, ["bucket", "part"]).select("gid", F.col("parent").alias("bucket"), "bytes", F.col("merged").alias("part"))
        sums = stash(sums.join(moved, ["bucket", "part"]).groupBy(F.col("parent").alias("bucket"), F.col("merged").alias("part")).agg(F.sum("bytes").alias("bytes")))

    spark = docs.sparkSession
    bundles = sorted(((r.bytes, r.bucket, r.part) for r in sums.collect()), reverse=True)  # at most TOP_BUCKETS * shards
    alone = sorted(((r.bytes, r.gid) for r in alone), reverse=True)
    shard = difference(_singles([x[0] for x in alone] + [x[0] for x in bundles], shards))[:, 0].tolist()
    of_large = spark.createDataFrame([(gid, s) for (_, gid), s in zip(alone, shard, strict=False)], "gid string, large_shard int")
    of_bundle = spark.createDataFrame([(b, p, s) for (_, b, p), s in zip(bundles, shard[len(alone) :], strict=True)], "bucket long, part int, shard int")

    of_small = placed.join(F.broadcast(of_bundle), ["bucket", "part"]).select(F.col("gid").alias("key"), "shard")
    rows = rows.join(F.broadcast(of_large), "gid", "left")
    rows = rows.withColumn("key", F.when(F.col("large_shard").isNull(), F.col("gid")).otherwise(F.concat(F.lit("#"), F.col(id_col).cast("string"))))
    rows = rows.join(of_small, "key", "left").select(id_col, "size", "text_crc32", F.coalesce("large_shard", "shard").alias("shard"))
    return _numbered(rows, "shard", id_col, n_rows, per_bucket)
