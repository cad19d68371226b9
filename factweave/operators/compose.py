"""Composing source views: overlays, comparisons, parsing, unpivoting and derivation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.rounds import settle


def overlay(base: DataFrame, patch: DataFrame, key: str, tombstone: str = "tombstone") -> DataFrame:
    """Patch over base by key: a tombstone deletes, anything else replaces the whole entry, fields are never merged."""
    fields = [c for c in base.columns if c != key]
    b = base.select(key, F.struct(*fields).alias("_base"))
    p = patch.select(key, F.struct(*fields).alias("_patch"), F.coalesce(F.col(tombstone), F.lit(False)).alias("_gone"))
    j = b.join(p, key, "full_outer").filter(~F.coalesce("_gone", F.lit(False)))
    pick = F.when(F.col("_patch").isNotNull(), F.col("_patch")).otherwise(F.col("_base"))
    return j.select(key, pick.alias("_row")).select(key, "_row.*")


def overwrite_paths(entries: DataFrame, writes: DataFrame, key: str, path: str, value: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Entries as (key, path, value) rows with ordered writes applied, the last per path; a null value removes.

    The second result lists writes to keys that no entry has.
    """
    last = writes.groupBy(key, path).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_w"))
    known = entries.select(key).distinct()
    orphans = last.join(known, key, "left_anti").select(key, path)
    j = entries.join(last.join(known, key, "left_semi"), [key, path], "full_outer")
    out = j.select(key, path, F.when(F.col("_w").isNotNull(), F.col("_w.v")).otherwise(F.col(value)).alias(value)).filter(F.col(value).isNotNull())
    return out, orphans


def compare_views(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys added, removed, changed or inherited between two views, with the names of changed fields."""
    fields = [c for c in left.columns if c != key]
    j = left.select(key, F.struct(*fields).alias("l")).join(right.select(key, F.struct(*fields).alias("r")), key, "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in fields])), ",")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(changed != "", "changed").otherwise("inherited")
    return j.select(key, change.alias("change"), F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), changed).alias("changed_fields"))


def level_range(text: Column) -> Column:
    """``"5-10"`` or ``"7"`` as a struct of bounds in order; null for any other text."""
    low = F.regexp_extract(text, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1)
    high = F.regexp_extract(text, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 2)
    a, z = low.try_cast("int"), F.coalesce(F.nullif(high, F.lit("")), low).try_cast("int")
    return F.when(low != "", F.struct(F.least(a, z).alias("low"), F.greatest(a, z).alias("high"), (a > z).alias("swapped")))


def id_list(ids: Column) -> Column:
    """Sorted distinct ids; an absent list stays null and differs from an empty one."""
    return F.array_sort(F.array_distinct(ids))


def signed_target(target: Column) -> Column:
    """Positive ids are one kind, negative ones the other."""
    return F.struct(F.when(target > 0, "creature").otherwise("object").alias("kind"), F.abs(target).alias("id"))


def slots(rows: DataFrame, keep: list[str], columns: list[list[Column]], names: list[str]) -> DataFrame:
    """Fixed slots to rows with their number; slots without a positive first value are empty."""
    entries = [F.struct(F.lit(i).alias("slot"), *[c.alias(n) for n, c in zip(names, cs, strict=True)]) for i, cs in enumerate(columns)]
    return rows.select(*keep, F.inline(F.array(*entries))).filter(F.col(names[0]) > 0)


def non_empty_stats(stats: Column) -> Column:
    return F.filter(stats, lambda s: (s["type"] != 0) | (s["value"] != 0))


def spawn_key(kind: Column, id_col: Column, zone: Column, x: Column, y: Column) -> Column:
    return F.format_string("%s:%d:zone_percent:%d:%.6f:%.6f", kind, id_col, zone, x, y)


def expand_templates(rows: DataFrame, carriers: DataFrame, template: str) -> tuple[DataFrame, DataFrame]:
    """Template rows once per carrier of the template, and templates that nothing carries."""
    return rows.join(carriers, template), rows.select(template).distinct().join(carriers, template, "left_anti")


def proven_links(first: DataFrame, second: DataFrame, pair: list[str], proof: str) -> DataFrame:
    """Pairs from two evidence sets: the first one's smallest proof counts, the second is kept beside it."""
    a = first.groupBy(*pair).agg(F.min(proof).alias("first_proof"))
    s = second.groupBy(*pair).agg(F.min(proof).alias("second_proof"))
    j = a.join(s, pair, "full_outer")
    return j.withColumn("proof", F.when(F.col("first_proof").isNotNull(), "first").otherwise("second"))


#: Changes that are folded as one array.
CHUNK = 50_000


def replay(log: DataFrame, key: str, order: str, op: str, fields: list[str], guard: str, merging: bool, chunk: int = CHUNK) -> DataFrame:
    """The latest row of every key after an ordered change log, and how many changes were errors.

    INSERT on a live row is an error, or merges its non-null fields when ``merging``. INSERT IGNORE
    keeps a live row; REPLACE takes the new row whole; UPDATE and DELETE apply where ``guard`` (over
    ``acc``, the live row, and ``x``, the change) holds, and are errors on a missing row.

    A REPLACE makes the row what it is whatever was before, so a key's log is cut there into segments
    that are folded apart: their errors add up and the last one's row stands. What is between two
    REPLACEs is folded ``chunk`` changes at a time, each chunk from the row that the one before left, so
    no row holds a key's whole log. Chunks after the first take a round each, and only long segments take part.
    """
    kind = "struct<live: boolean, errors: bigint, " + ", ".join(f"{f}: bigint" for f in fields) + ">"
    start = f"cast(named_struct('live', false, 'errors', 0L, {', '.join(f'{chr(39)}{f}{chr(39)}, null' for f in fields)}) as {kind})"

    def row(live: str, errors: str, values: list[str]) -> str:
        return f"cast(named_struct('live', {live}, 'errors', {errors}, {', '.join(f'{chr(39)}{f}{chr(39)}, {v}' for f, v in zip(fields, values, strict=True))}) as {kind})"

    new, old, none = [f"x.{f}" for f in fields], [f"acc.{f}" for f in fields], ["null"] * len(fields)
    merged = [f"coalesce(x.{f}, acc.{f})" for f in fields]
    on_live = row("true", "acc.errors", merged) if merging else row("true", "acc.errors + 1", old)
    step = f"""case
      when x.op = 'INSERT' then if(acc.live, {on_live}, {row("true", "acc.errors", new)})
      when x.op = 'INSERT IGNORE' then if(acc.live, acc, {row("true", "acc.errors", new)})
      when x.op = 'REPLACE' then {row("true", "acc.errors", new)}
      when not acc.live then {row("false", "acc.errors + 1", none)}
      when not coalesce({guard}, false) then acc
      when x.op = 'UPDATE' then {row("true", "acc.errors", merged)}
      else {row("false", "acc.errors", none)} end"""
    log = log.select(key, F.col(order).alias("_seq"), F.col(op).alias("_op"), *fields)
    in_order = Window.partitionBy(key).orderBy("_seq")
    cut = log.withColumn("_seg", F.count_if(F.col("_op") == "REPLACE").over(in_order))
    cut = cut.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(key, "_seg").orderBy("_seq")) - 1) / F.lit(chunk)))
    change = F.struct(F.col("_seq").alias("seq"), F.col("_op").alias("op"), *fields)
    chunks = settle(cut.groupBy(key, "_seg", "_chunk").agg(F.array_sort(F.collect_list(change)).alias("_changes")))
    fold = lambda rows, first: rows.select(key, "_seg", F.expr(f"aggregate(_changes, {first}, (acc, x) -> {step})").alias("_r"))
    last = chunks.agg(F.coalesce(F.max("_chunk"), F.lit(0))).first()[0]
    state = fold(chunks.filter("_chunk = 0"), start)
    ended = []
    for k in range(1, last + 1):
        state, more = settle(state), chunks.filter(F.col("_chunk") == k)
        ended.append(state.join(more, [key, "_seg"], "left_anti"))
        state = fold(more.join(state, [key, "_seg"]), "_r")
    segments = union_all([*ended, state])
    rows = segments.groupBy(key).agg(F.max_by("_r", "_seg").alias("_r"), F.sum("_r.errors").alias("_errors"))
    return rows.select(key, "_r.live", F.col("_errors").alias("errors"), *(f"_r.{f}" for f in fields))


def after_truncate(log: DataFrame, order: str, is_truncate: Column) -> DataFrame:
    """Changes behind the last TRUNCATE; one row is broadcast."""
    last = log.filter(is_truncate).agg(F.max(order).alias("_last"))
    return log.join(F.broadcast(last), F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")
