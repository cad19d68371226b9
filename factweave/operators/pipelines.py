"""Reconciling one domain from end to end: compose, record, select, sync, summarise."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import compose
from factweave.operators import evidence as ev
from factweave.operators.reconcile import sync_sets
from factweave.sources.rounds import settle


@dataclass(frozen=True)
class Domain:
    """Stored state of a domain: ``statements`` and ``selections`` of ``(key, field, value)``, the latter with ``policy``, and ``state(key, *fields)``."""

    statements: DataFrame
    selections: DataFrame
    state: DataFrame


def _facts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return ev.unpivot_facts(rows, key, fields).withColumnRenamed("fact_key", "field")


def _synced(base: DataFrame, patch: DataFrame, key: str, stored: Domain, protected: Column, policy: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(incoming, picks, chosen, both, state)``: the statements of an overlay, what is picked of them, and the rows made from the winners beside the stored ones."""
    fields = [c for c in base.columns if c != key]
    wanted = _facts(compose.overlay(base, patch, key), key, fields)
    incoming = settle(wanted.select(key, "field", "value").distinct())

    old = stored.selections.select(key, "field", F.col("value").alias("_old"), F.col("policy").alias("_policy"))
    action = F.when(F.col("_policy").isNull(), "selected").when(F.col("_policy") == "custom", "protected").when(F.col("_old") == F.col("value"), "unchanged").otherwise("replaced")
    picks = settle(incoming.join(old, [key, "field"], "left").withColumn("action", action))
    winner = F.when(F.col("action") == "protected", F.col("_old")).otherwise(F.col("value"))
    chosen = picks.select(key, "field", winner.alias("value"), F.coalesce("_policy", F.lit(policy)).alias("policy"), "action")

    rows = chosen.groupBy(key).pivot("field", fields).agg(F.first("value"))
    want, have = (df.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name)) for df, name in ((rows, "_want"), (stored.state, "_have")))
    both = want.join(have, key, "full_outer").withColumn("_protected", protected)
    synced = F.when(F.col("_have").isNull(), "insert").when(F.col("_want").eqNullSafe(F.col("_have")), "unchanged").when(F.col("_protected"), "protected").when(F.col("_want").isNull(), "delete").otherwise("update")
    both = settle(both.withColumn("action", synced))
    state = both.filter("action <> 'delete'").select(key, F.when(F.col("action").isin("insert", "update"), F.col("_want")).otherwise(F.col("_have")).alias("_r")).select(key, "_r.*")
    return incoming, picks, chosen, both, state


def domain_state(base: DataFrame, patch: DataFrame, key: str, stored: Domain, protected: Column, policy: str = "managed") -> DataFrame:
    """The rows alone that ``reconcile_domain`` leaves: for passes that neither store statements and selections nor count."""
    return settle(_synced(base, patch, key, stored, protected, policy)[-1])


def reconcile_domain(base: DataFrame, patch: DataFrame, key: str, stored: Domain, protected: Column, policy: str = "managed") -> tuple[Domain, DataFrame]:
    """The domain after an overlay, and ``(step, action, n)``: what each step did.

    The overlay's composed rows are recorded as statements that are new or known, and selected: a custom
    pick is protected, a managed one replaced if its value differs. Rows are made from the winners and
    synced with the state: stored rows that are not wanted are deleted unless ``protected``, which
    also keeps them from change. A second pass over the result does nothing.
    """
    incoming, picks, chosen, both, state = _synced(base, patch, key, stored, protected, policy)
    identity = [key, "field", "value"]
    new = settle(ev.ingest(stored.statements.select(*identity), incoming.withColumn("_seq", F.col(key)), identity, "_seq").drop("_seq"))
    kept = stored.selections.join(chosen.select(key, "field"), [key, "field"], "left_anti").select(key, "field", "value", "policy")

    count = lambda df, step: df.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "action", "n")
    known = incoming.join(new, identity, "left_semi").withColumn("action", F.lit("new")).unionByName(incoming.join(new, identity, "left_anti").withColumn("action", F.lit("known")))
    summary = reduce(DataFrame.unionByName, [count(known, "record"), count(picks, "select"), count(both, "sync")])
    return Domain(settle(stored.statements.select(*identity).unionByName(new)), settle(kept.unionByName(chosen.drop("action"))), settle(state)), summary


def reconcile_members(wanted: DataFrame, stored: DataFrame, owners: DataFrame, targets: DataFrame, keys: list[str], target: str, complete: Column) -> tuple[DataFrame, DataFrame]:
    """The member sets that depend on a domain, after it: ``(members, summary)``, the latter as ``reconcile_domain`` gives it.

    ``wanted(*keys, target)`` names members by their owner, the first of ``keys``, and what they refer to.
    A member whose owner isn't among ``owners`` or whose target isn't in ``targets`` is unresolved and not
    wanted. ``stored(*keys, custom)`` is kept where wanted or custom; else it is deleted if its owner's set is
    ``complete`` or the owner is gone. ``members`` is stored state for the next pass, which then does nothing.
    Repeated rows count once; null keys or targets never resolve.
    """
    owner = keys[0]
    here = owners.select(owner).distinct().withColumn("_here", F.lit(True))
    found = wanted.select(*keys, target).distinct().join(here, owner, "left").join(targets.select(target).distinct().withColumn("_there", F.lit(True)), target, "left")
    found = settle(found.withColumn("action", F.when(F.col("_here").isNull(), "no_owner").when(F.col("_there").isNull(), "no_target").otherwise("resolved")))
    want = found.filter("action = 'resolved'").select(*keys).distinct()
    have = stored.groupBy(*keys).agg(F.bool_or("custom").alias("custom")).join(here, owner, "left")
    gone = F.col("_here").isNull()
    synced = settle(sync_sets(want, have, keys, ~F.coalesce(F.col("custom"), F.lit(False)), complete=gone | complete).drop("_here"))
    members = synced.filter("action <> 'delete'").select(*keys, F.coalesce("custom", F.lit(False)).alias("custom"))
    count = lambda df, step: df.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "action", "n")
    return members, count(found, "resolve").unionByName(count(synced, "members"))


MEMBER = ["owner", "family", "target"]


@dataclass(frozen=True)
class Members:
    """Member sets by family that depend on domains: ``wanted(owner, family, target)`` and ``stored`` of the same with ``custom``.

    ``owners`` names the owners' domain and ``refers`` the domain of each family's targets. ``complete`` tells, over
    owner and family, whose wanted set is whole; of other sets nothing is deleted. Without ``loops`` no row may refer to itself.
    """

    wanted: DataFrame
    stored: DataFrame
    owners: str
    refers: dict[str, str]
    complete: Column
    loops: bool = False


@dataclass(frozen=True)
class Dependants:
    """What the dependants' pass leaves: sets by step, rows by domain that are kept for them, unresolved rows, counts."""

    members: dict[str, DataFrame]
    held: dict[str, DataFrame]
    unresolved: DataFrame
    summary: DataFrame


def reconcile_dependants(states: dict[str, DataFrame], gone: dict[str, DataFrame], key: str, steps: dict[str, Members]) -> Dependants:
    """Sync the sets that depend on domains after these, and then decide what the domains may delete.

    ``states`` are the domains' rows after their own pass and ``gone`` the stored rows that it would delete, by ``key``.
    A wanted member is unresolved with the first reason that holds: ``no_owner``, ``self`` (where loops are refused) or
    ``no_target``; a family without a domain has no targets. Stored members that aren't wanted go if their set is whole
    or their owner has gone, unless custom. A gone row that a member which stays belongs to or refers to is ``held``: it
    goes back to the domain's state, where the next pass finds it gone and holds it again, so that a second pass
    changes nothing. Repeated rows count once, null parts never resolve, and a hot owner or target is one row of the
    side that members are joined to.
    """
    members, unresolved, counts = {}, [], []
    uses: dict[str, list[DataFrame]] = {name: [] for name in states}
    for name, step in steps.items():
        here = states[step.owners].select(F.col(key).alias("owner")).distinct().withColumn("_here", F.lit(True))
        there = reduce(DataFrame.unionByName, [states[d].select(F.lit(f).alias("family"), F.col(key).alias("target")) for f, d in step.refers.items()])
        there = there.distinct().withColumn("_there", F.lit(True))
        inward = F.col("family").isin(*[f for f, d in step.refers.items() if d == step.owners])
        loop = (F.col("owner") == F.col("target")) & inward & F.lit(not step.loops)
        found = step.wanted.select(*MEMBER).distinct().join(here, "owner", "left").join(there, ["family", "target"], "left")
        action = F.when(F.col("_here").isNull(), "no_owner").when(loop, "self").when(F.col("_there").isNull(), "no_target").otherwise("resolved")
        found = settle(found.select(*MEMBER, action.alias("action")))
        have = step.stored.groupBy(*MEMBER).agg(F.bool_or("custom").alias("custom")).join(here, "owner", "left")
        whole = F.col("_here").isNull() | step.complete
        synced = settle(sync_sets(found.filter("action = 'resolved'"), have, MEMBER, ~F.coalesce("custom", F.lit(False)), complete=whole).drop("_here"))
        members[name] = synced.filter("action <> 'delete'").select(*MEMBER, F.coalesce("custom", F.lit(False)).alias("custom"))
        uses[step.owners].append(members[name].select(F.col("owner").alias(key)))
        for family, domain in step.refers.items():
            uses[domain].append(members[name].filter(F.col("family") == family).select(F.col("target").alias(key)))
        unresolved.append(found.filter("action <> 'resolved'").select(F.lit(name).alias("step"), *MEMBER, F.col("action").alias("reason")))
        for rows, part in ((found, "resolve"), (synced, "members")):
            counts.append(rows.groupBy("family", "action").agg(F.count("*").alias("n")).select(F.lit(f"{name}:{part}").alias("step"), "family", "action", "n"))

    held = {}
    for name, rows in gone.items():
        used = reduce(DataFrame.unionByName, uses[name]).distinct().withColumn("_used", F.lit(True)) if uses[name] else None
        guarded = rows.withColumn("_used", F.lit(None).cast("boolean")) if used is None else rows.join(used, key, "left")
        guarded = settle(guarded.withColumn("action", F.when(F.col("_used"), "held").otherwise("deleted")).drop("_used"))
        held[name] = guarded.filter("action = 'held'").drop("action")
        counts.append(guarded.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(f"{name}:guard").alias("step"), F.lit(None).cast("string").alias("family"), "action", "n"))
    return Dependants(members, held, reduce(DataFrame.unionByName, unresolved), reduce(DataFrame.unionByName, counts))
