"""Coverage, freshness, promotion and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_coverage(cached: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """Ids in both, in one only, their extremes, and the covered share, rounded to eight places or null for no ids."""
    c = cached.select(key).distinct().withColumn("_c", F.lit(True))
    j = c.join(canonical.select(key).distinct().withColumn("_k", F.lit(True)), key, "full_outer")
    both, only, missing = F.col("_c") & F.col("_k"), F.col("_k").isNull(), F.col("_c").isNull()
    counts = j.agg(F.count_if(both).alias("both"), F.count_if(only).alias("cache_only"), F.count_if(missing).alias("missing"), F.min(F.when(missing, F.col(key))).alias("lowest_missing"), F.max(F.when(missing, F.col(key))).alias("highest_missing"))
    known = F.col("both") + F.col("missing")
    return counts.withColumn("ratio", F.when(known > 0, F.bround(F.col("both") / known, 8)))


def spread_sample(ids: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` evenly spaced ranks of the sorted ids, rounded half to even; one takes the middle.

    Ids are numbered by range partitions: each counts its own and starts where those before end, so
    no task sorts all of them.
    """
    from factweave.sources.rounds import settle

    parts = settle(ids.select(key).distinct().repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    ranked = parts.withColumn("_r", at).join(F.broadcast(starts), "_p").select(key, (F.col("_r") + F.col("_from")).alias("rank"), F.col("_all").alias("_all"))
    if n == 1:
        return ranked.filter("rank = (_all - 1) div 2").select(key, "rank")
    k = F.col("_k")
    wanted = F.when(F.col("_all") <= n, F.col("rank")).otherwise(F.bround(k * (F.col("_all") - 1) / F.lit(n - 1)).cast("long"))
    near = F.floor(F.col("rank") * F.lit(n - 1) / F.greatest(F.col("_all") - 1, F.lit(1)))
    hit = ranked.withColumn("_k", F.explode(F.array(near, near + 1))).filter((k < n) & (wanted == F.col("rank")))
    return hit.select(key, "rank").distinct()


def probe_class(status: Column, before: Column, after: Column) -> Column:
    """What one probe shows: known before, proven new, seen in the session only, or nothing."""
    return F.when(before.isNotNull(), "historical").when((status == "loaded") & after.isNotNull(), "refresh_proven").when((status == "loaded") & after.isNull(), "session_only").otherwise("unknown")


def promotion_plan(proofs: DataFrame, current: DataFrame, key: str, proof: str, digest: str) -> DataFrame:
    """Eligible where some proof equals the current digest; drifted or gone otherwise, with the proven digests."""
    c = current.select(key, F.col(digest).alias("_now"))
    j = proofs.join(c, key, "left").groupBy(key).agg(F.bool_or(F.col(proof) == F.col("_now")).alias("_eq"), F.max("_now").alias("_now"), F.count_distinct(proof).alias("proofs"))
    return j.select(key, F.when(F.col("_now").isNull(), "gone").when(F.col("_eq"), "eligible").otherwise("drifted").alias("plan"), "proofs")


def incremental_plan(plan: DataFrame, promoted: DataFrame, key: str) -> DataFrame:
    """Eligible items that are already promoted become no-ops."""
    done = promoted.select(key).distinct().withColumn("_done", F.lit(True))
    return plan.join(done, key, "left").withColumn("plan", F.when((F.col("plan") == "eligible") & F.col("_done"), "already_current").otherwise(F.col("plan"))).drop("_done")


def merge_sessions(probes: DataFrame, key: str, session: str, order: str, outcome: str, limit: int) -> DataFrame:
    """State of every item after its sessions in order.

    A session counts once, by its last probe. Proven and historical are final; a timeout is
    retryable until ``limit`` attempts make it terminal; otherwise the last outcome stands. Repeating
    a session changes nothing. Every session before the end is one attempt, so its number alone tells whether it ends the
    item: the first one that does, or else the last one, gives the state. Sessions are numbered as
    they stream by in order, and nothing is gathered by item.
    """
    per = probes.groupBy(key, session).agg(F.max_by(outcome, order).alias("_o"), F.max(order).alias("_s"))
    numbered = per.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_s", "_o")))
    final = F.col("_o").isin("refresh_proven", "historical") | ((F.col("_o") == "timeout") & (F.col("_k") >= limit))
    at = F.struct("_k", "_o")
    r = F.coalesce(F.min(F.when(final, at)), F.max(at)).alias("_r")
    state = F.when(F.col("_r._o") != "timeout", F.col("_r._o")).when(F.col("_r._o").isNotNull(), F.when(F.col("_r._k") >= limit, "terminal").otherwise("retryable"))
    return numbered.groupBy(key).agg(r).select(key, state.alias("state"), F.col("_r._k").alias("attempts"))


def next_batch(items: DataFrame, key: str, state: str, limit: int) -> DataFrame:
    """``(key, part, rank)``: the items to probe next.

    One retryable item and a spread of queued ones for the rest; if there is only one kind, a spread of
    it. Ranks are those within the state's sorted ids.
    """
    if limit < 1:
        raise ValueError("a batch has at least one item")
    retry, queued = items.filter(F.col(state) == "retryable"), items.filter(F.col(state) == "queued")
    some_retry, some_queued = bool(retry.head(1)), bool(queued.head(1))
    part = lambda rows, n, name: spread_sample(rows, key, n).withColumn("part", F.lit(name))
    if some_retry and some_queued and limit >= 2:
        return part(retry, 1, "retryable").unionByName(part(queued, limit - 1, "queued"))
    return part(queued, limit, "queued") if some_queued else part(retry, limit, "retryable")


def campaign_report(items: DataFrame, state: str, attempts: str) -> DataFrame:
    """One row: how many items there are and were tried, how often again, and outcomes as shares of those tried, rounded to eight places or null for none."""
    s, n = F.col(state), F.coalesce(F.col(attempts), F.lit(0))
    unknown = s.isin("retryable", "terminal")
    counts = items.agg(
        F.count("*").alias("candidates"),
        F.count_if(n > 0).alias("attempted"),
        F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).cast("long").alias("retries"),
        F.count_if(s == "refresh_proven").alias("refresh_proven"),
        F.count_if(s == "session_only").alias("session_limited"),
        F.count_if(unknown).alias("unknown"),
        F.count_if(s == "terminal").alias("terminal"),
        F.count_if(s == "queued").alias("unattempted"),
        F.count_if(s.isin("queued", "retryable")).alias("eligible"),
    )
    rate = lambda c: F.when(F.col("attempted") > 0, F.bround(F.col(c) / F.col("attempted"), 8)).alias(f"{c}_rate")
    return counts.select("*", rate("refresh_proven"), rate("session_limited"), rate("unknown"))


def field_counts(items: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: all items, and how many pass each named test."""
    return items.agg(F.count("*").alias("items"), *[F.count_if(test).alias(name) for name, test in tests.items()])
