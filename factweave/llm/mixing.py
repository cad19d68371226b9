"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import WORD, chunks_for, runs, stash, text_of

#: Rows of a cell that one task counts off, and rows alike that stay together.
CELL_ROWS, RUN_ROWS = 500, 5000
#: Classes whose share of the words the mix keeps: lengths by powers of two, and languages by hash.
LENGTHS, LANGS = 24, 16
CLASSES = LENGTHS + LANGS
#: Sources that one task ranks, and cells that one task balances.
SOURCES_PER_TASK, CELLS_PER_TASK = 100_000, 50_000


def ranked(per: DataFrame, sources: int) -> DataFrame:
    """``per`` with ``sid``, the rank of each source by code point, null last: counted off inside ranges of sources."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stash(per.repartitionByRange(chunks_for(sources, SOURCES_PER_TASK), *order).withColumn("part", F.spark_partition_id()))
    starts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("at", at).join(starts, "part").withColumn("sid", F.col("start") + F.col("at")).drop("part", "at", "start")


def source_targets(sized: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(sid, source, source_size, target)``: each source's share of all words, by weight and capped.

    Sources are ranked by code point, null last, and take the weights in turn. A target stops at
    ``most`` times its source's size and the excess is shared among the others by weight until none
    is above: the share per weight rises from round to round, each one aggregation, until no further
    source is full.
    """
    per = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources, words = per.agg(F.count("*"), F.sum("source_size")).first()
    per = stash(ranked(per, sources))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    room = F.col("source_size") * most
    full, level = -1, 0.0
    while True:
        n, filled, open_weight = per.agg(F.count_if(room <= weight * level), F.sum(F.when(room <= weight * level, room)), F.sum(F.when(room > weight * level, weight))).first()
        if n == full or not open_weight:
            break
        full, level = n, ((words or 0) - (filled or 0.0)) / open_weight
    return per.select("sid", "source", F.col("source_size").cast("long").alias("source_size"), F.least(room, weight * level).alias("target"))


def poured(words: np.ndarray, z: np.ndarray, target: float, most: float) -> tuple[float, np.ndarray]:
    """``(dual, rates)``: the multiplier for which the rates ``min(most, exp(dual + z))`` of one source's cells take ``target`` words.

    Cells reach the ceiling in falling order of ``z``; the first count of full cells that leaves the
    next one below the ceiling is the solution.
    """
    if target >= most * float(words.sum()):
        return math.inf, np.full(len(words), most)
    order = np.argsort(-z, kind="stable")
    w, tilted = words[order].astype(float), (words * np.exp(z))[order]
    full = most * np.concatenate(([0.0], np.cumsum(w)[:-1]))
    scale = (target - full) / np.maximum(np.cumsum(tilted[::-1])[::-1], 1e-300)
    at = int(np.argmax(scale * np.exp(z[order]) <= most))
    return math.log(max(scale[at], 1e-300)), np.minimum(most, scale[at] * np.exp(z))


def dual_terms(cells: pd.DataFrame, mu: np.ndarray, most: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and curvature in ``mu`` of the dual over whole sources, without the classes' own part.

    The sources' multipliers are solved for exactly, which adds the second part of the curvature.
    """
    value, slope, curve = 0.0, np.zeros(CLASSES), np.zeros((CLASSES, CLASSES))
    for _, own in cells.groupby("sid"):
        words, target = own["words"].to_numpy(float), float(own["target"].iloc[0])
        at = np.stack([own["length"].to_numpy(), LENGTHS + own["lang"].to_numpy()], axis=1)
        z = mu[at].sum(1)
        dual, rates = poured(words, z, target, most)
        taken = words * rates
        for column in at.T:
            np.add.at(slope, column, taken)
        if dual == math.inf:
            value += float(taken @ z)
            continue
        open_ = np.where(rates < most, taken, 0.0)
        value += float(np.where(rates < most, taken, most * words * (1 + dual + z - math.log(most))).sum()) - dual * target
        for a in at.T:
            for b in at.T:
                np.add.at(curve, (a, b), open_)
        own_slope = np.zeros(CLASSES)
        for column in at.T:
            np.add.at(own_slope, column, open_)
        if open_.sum() > 0:
            curve -= np.outer(own_slope, own_slope) / open_.sum()
    return value, slope, curve


def balance(cells: DataFrame, most: float = 3.0, soft: float = 0.02, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """``(sid, length, lang, rate)`` of ``cells(sid, length, lang, words, target)``: rates nearest to 1 in relative entropy.

    Minimises sum(words * (r log r - r)) over the cells under token constraints: each source takes
    its ``target``, no rate is above ``most``, and each class of length and each class of language,
    which cut across the sources, keeps its words. The classes' constraints can contradict the
    sources', so they are elastic: a class with multiplier m may miss by ``soft * |m|`` of all words.
    The dual's rates are exp(multiplier of the source + of the length + of the language). Each Newton step is
    one distributed aggregation: a group of sources is reduced to its part of the gradient and of
    the full curvature matrix over the classes (``CLASSES`` squared numbers per group reach the
    driver, added in the groups' order, so reruns agree); steps are halved while the dual gets worse.
    """
    n, words = cells.agg(F.count("*"), F.sum("words")).first()
    slices = chunks_for(n, CELLS_PER_TASK)
    cells = stash(cells.withColumn("slice", F.pmod(F.xxhash64("sid"), F.lit(slices)).cast("int")))
    total = float(words or 0)
    kept = np.zeros(CLASSES)
    for column, first in (("length", 0), ("lang", LENGTHS)):
        for k, n in cells.groupBy(column).agg(F.sum("words")).collect():  # one row per class
            kept[first + k] = n

    def terms(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            value, slope, curve = dual_terms(pdf.sort_values(["sid", "length", "lang"]), mu, most)
            return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "value": [value], "slope": [slope.tolist()], "curve": [curve.ravel().tolist()]})

        value, slope, curve = soft * total * float(mu @ mu) / 2 - float(mu @ kept), soft * total * mu - kept, soft * total * np.eye(CLASSES)
        for r in sorted(cells.groupBy("slice").applyInPandas(run, "slice int, value double, slope array<double>, curve array<double>").collect()):
            value, slope, curve = value + r.value, slope + np.array(r.slope), curve + np.array(r.curve).reshape(CLASSES, CLASSES)
        return value, slope, curve

    mu = np.zeros(CLASSES)
    if total:
        value, slope, curve = terms(mu)
        for _ in range(rounds):
            if np.abs(slope).max() <= tolerance * total:
                break
            step, size = np.linalg.solve(curve, slope), 1.0
            while True:
                tried = terms(mu - size * step)
                if tried[0] <= value - 1e-4 * size * float(step @ slope) or size < 1e-4:
                    break
                size /= 2
            mu, (value, slope, curve) = mu - size * step, tried

    def rates(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("sid"):
            z = mu[own["length"].to_numpy()] + mu[LENGTHS + own["lang"].to_numpy()]
            out.append(own[["sid", "length", "lang"]].assign(rate=poured(own["words"].to_numpy(float), z, float(own["target"].iloc[0]), most)[1].round(9)))
        return pd.concat(out)

    return cells.groupBy("slice").applyInPandas(rates, "sid long, length int, lang int, rate double")


def _round_cells(most: float):
    """Copies of each cell of one source, largest documents first; what rounding leaves goes on to the smaller ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "lang"], ascending=[False, True])
        left, copies = 0.0, []
        for n, size, rate in zip(pdf["n"].tolist(), pdf["size"].tolist(), pdf["rate"].tolist(), strict=True):
            want = n * rate + (left / size if size else 0.0)
            take = max(0, min(int(n * most), math.floor(want + 0.5)))
            left += (n * rate - take) * size
            copies.append(take)
        return pdf[["sid", "size", "lang", "n"]].assign(copies=copies)

    return run


def length_class(size):
    """Documents of 2^k to 2^(k+1) - 1 words; the last class has all longer ones."""
    return F.least(F.length(F.bin(F.greatest(size, F.lit(1)))) - 1, F.lit(LENGTHS - 1)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str | None = "lang", most: float = 3.0) -> DataFrame:
    """One row per document: ``(id, source, size, source_size, target, rate, copies, taken)``.

    Size counts the words of the whole text (null: none). The rates of ``balance`` are rounded into
    whole copies of 0 to ``most``: documents of one source, language class and size form a cell,
    cells are rounded from the largest size down with what is left carried over, and a cell's copies
    are spread evenly, the odd ones by hash order of the ids, so reruns agree. Rows that repeat an id are counted, so a hot id is spread over tasks. A source's taken words
    thus miss its target by little more than half its smallest documents' size. A task rounds the
    distinct sizes of one source, not its documents. A source without words takes none; a null source
    or language is one of its own; an empty table gives no rows; repeated rows are separate documents;
    other columns are ignored.
    """
    lang = F.pmod(F.xxhash64(lang_col), F.lit(LANGS)).cast("int") if lang_col else F.lit(0)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), lang.alias("lang"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    sized = stash(docs)
    alike = stash(runs(sized, ["id", "source", "lang", "size"], RUN_ROWS))
    targets = stash(source_targets(sized, most))
    own = sized.groupBy("source", "lang", "size").agg(F.count("*").alias("n"))
    known = targets.select("sid", F.col("source").alias("_s"), "target")
    cells = stash(own.join(known, own["source"].eqNullSafe(known["_s"])).withColumn("length", length_class(F.col("size"))).drop("_s"))
    rates = balance(cells.groupBy("sid", "length", "lang", "target").agg(F.sum(F.col("n") * F.col("size")).alias("words")).filter("target > 0"), most)
    rated = cells.join(stash(rates), ["sid", "length", "lang"], "left").select("sid", "source", "size", "lang", "n", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    rated = stash(rated)
    rounded = rated.groupBy("sid").applyInPandas(_round_cells(most), "sid long, size long, lang int, n long, copies long")
    plan = rounded.join(rated.select("sid", "size", "lang", "rate"), ["sid", "size", "lang"]).join(targets, "sid").select("source", "lang", "size", "n", "copies", "rate", "source_size", "target")
    plan = stash(plan.withColumn("subs", F.ceil(F.col("n") / CELL_ROWS).cast("long")))

    cell = ["source", "lang", "size"]
    p = plan.withColumnsRenamed({c: f"_{c}" for c in cell})
    same = lambda a, b: a["source"].eqNullSafe(b["_source"]) & (a["lang"] == b["_lang"]) & (a["size"] == b["_size"])
    rows = alike.join(p, same(alike, p)).drop("_source", "_lang", "_size")
    rows = stash(rows.withColumn("h", F.xxhash64("id", "_run")).withColumn("sub", F.pmod(F.col("h"), F.col("subs"))))
    before = Window.partitionBy(*cell).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cell, "sub").agg(F.sum("_alike").alias("_n"))
    starts = stash(starts.select(*[F.col(c).alias(f"_{c}") for c in cell], F.col("sub").alias("_sub"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("start")))
    within = Window.partitionBy(*cell, "sub").orderBy("h", "id", "_run").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("_alike").over(within), F.lit(0)))
    rows = rows.join(starts, same(rows, starts) & (rows["sub"] == starts["_sub"]))
    odd = F.col("copies") % F.col("n") - F.col("start") - F.col("at")  # so many of these rows alike take one copy more
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_alike"))))
    rows = rows.withColumn("copies", (F.floor(F.col("copies") / F.col("n")) + (F.col("_i") <= odd).cast("long")).cast("long"))
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
