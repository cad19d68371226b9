"""Distances between two point sets of one bucket without all their pairs: pairs of grid cells are narrowed down level by level.

Both sets are gridded over their bucket's box, each level halving the cells of the one before. A pair of cells knows
the least and the greatest distance that its points can have; it is kept only as far as a question needs
it, and is halved until few pairs of points are left in it, which are then made by an equi-join on both
cells. So a bucket of any size costs about as many rows as it has points, and no task holds a large bucket. Buckets
with few pairs need no cells: their spots are two short arrays in a row, measured by numpy inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.operators.versions import EPSILON, band
from factweave.sources.rounds import settle

#: Levels of the grid, and pairs of spots that a pair of cells may leave to a join.
DEPTH, AT_ONCE = 30, 1 << 16
#: Spots in one array, spots of a bucket that is measured in one row, and pairs that a task makes at a time from such rows.
ARRAY, IN_ROW, MADE = 8192, 1024, 1 << 18


def spots(points: DataFrame, bucket: list[str]) -> DataFrame:
    """Distinct places with how many points share each; points without both coordinates have no distance."""
    known = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return known.groupBy(*bucket, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).agg(F.count("*").alias("_n"))


@dataclass
class Grid:
    """Two sides' spots with their places on the finest grid. Only buckets that both sides share are held."""

    bucket: list[str]
    a: DataFrame
    b: DataFrame

    def side(self, name: str) -> DataFrame:
        return self.a if name == "a" else self.b

    def at(self, name: str, level: int, prefix: str) -> DataFrame:
        """A side's spots with their cell of a level."""
        cell = lambda c: F.shiftright(c, DEPTH - level)
        return self.side(name).withColumns({f"_{prefix}x": cell("_ix"), f"_{prefix}y": cell("_iy")})

    def cells(self, name: str, level: int, prefix: str) -> DataFrame:
        """Cells of a level with their number of points and spots and their tight box."""
        own = [*self.bucket, f"_{prefix}x", f"_{prefix}y"]
        named = {"n": F.sum("_n"), "s": F.count("*"), "x0": F.min("_x"), "x1": F.max("_x"), "y0": F.min("_y"), "y1": F.max("_y")}
        return self.at(name, level, prefix).groupBy(*own).agg(*[v.alias(f"_{prefix}{k}") for k, v in named.items()])


def _placed(left: DataFrame, right: DataFrame, bucket: list[str]) -> DataFrame:
    """Both sides' spots on the finest grid of their bucket's box, settled once, with their bucket's number of pairs and spots."""
    both = [spots(points, bucket).withColumn("_side", F.lit(side)) for side, points in (("a", left), ("b", right))]
    rows = both[0].unionByName(both[1])
    box = rows.groupBy(*bucket).agg(F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).alias("_span"), F.count_if(F.col("_side") == "a").alias("_a"), F.count("*").alias("_all"))
    place = lambda c, c0: F.least(F.floor((F.col(c) - F.col(c0)) / F.nullif("_span", F.lit(0.0)) * float(1 << DEPTH)), F.lit((1 << DEPTH) - 1))
    placed = rows.join(box.filter("_a > 0 and _a < _all"), bucket)
    held = [(F.col("_a") * (F.col("_all") - F.col("_a"))).alias("_held"), "_all"]
    return settle(placed.select(*bucket, "_side", "_x", "_y", "_n", *held, *(F.coalesce(place(c, f"{c}0"), F.lit(0)).cast("long").alias(i) for c, i in (("_x", "_ix"), ("_y", "_iy")))))


def grid(left: DataFrame, right: DataFrame, bucket: list[str]) -> Grid:
    return _grid(_placed(left, right, bucket), bucket)


def _grid(placed: DataFrame, bucket: list[str]) -> Grid:
    placed = placed.drop("_held", "_all")
    return Grid(bucket, *(placed.filter(F.col("_side") == side).drop("_side") for side in "ab"))


def both_ways(left: DataFrame, right: DataFrame, bucket: list[str]) -> Grid:
    """A grid from each side to the other one at once: ``_from`` tells which side asks, and is a part of the bucket."""
    return _both_ways(_placed(left, right, bucket), bucket)


def _both_ways(placed: DataFrame, bucket: list[str]) -> Grid:
    placed = placed.drop("_held", "_all")
    other = F.when(F.col("_side") == "a", "b").otherwise("a")
    return Grid([*bucket, "_from"], placed.withColumnRenamed("_side", "_from"), placed.withColumn("_from", other).drop("_side"))


def in_rows(placed: DataFrame, bucket: list[str], at_once: int) -> tuple[DataFrame, DataFrame | None]:
    """Buckets with few pairs and spots, each as one row of arrays, and the spots of the other buckets, if there are any."""
    small = (F.col("_held") <= at_once) & (F.col("_all") <= IN_ROW)
    of = lambda side: F.collect_list(F.when(F.col("_side") == side, F.struct("_x", "_y", "_n"))).alias(f"_{side}")
    rows = placed.filter(small).groupBy(*bucket).agg(of("a"), of("b"))
    large = placed.filter(~small)
    return rows.select(*bucket, *(F.col(f"_{side}{c}").alias(f"_{side}{c}") for side in "ab" for c in ("._x", "._y", "._n"))).toDF(*bucket, *_ARRAYS), None if large.isEmpty() else large


_ARRAYS = [f"_{side}_{c}" for side in "ab" for c in "xyn"]


def _measure(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    dx, dy = ax[:, None] - bx, ay[:, None] - by
    return np.sqrt(dx * dx + dy * dy)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("farthest", "closest")]))
def _extremes(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
    found = [(d.max(), d.min()) for d in map(_measure, ax, ay, bx, by)]
    return pd.DataFrame(found, columns=["farthest", "closest"], dtype="float64")


def _in_bands(limits: list[float]) -> Callable:
    """How many pairs lie up to each limit and above the one before, and above the last."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(ax: pd.Series, ay: pd.Series, an: pd.Series, bx: pd.Series, by: pd.Series, bn: pd.Series) -> pd.Series:
        out = []
        for x, y, n, u, v, m in zip(ax, ay, an, bx, by, bn):
            at, pairs = np.searchsorted(limits, _measure(x, y, u, v)), n[:, None] * m
            out.append([int(pairs[at == k].sum()) for k in range(len(limits) + 1)])
        return pd.Series(out, dtype=object)

    return count


def _mates(bucket: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of spots that are nearest from either side, of the rows of ``in_rows``."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, size = [], 0
            for *key, ax, ay, an, bx, by, bn in batch[[*bucket, *_ARRAYS]].itertuples(index=False, name=None):
                d = _measure(ax, ay, bx, by)
                near_a, near_b = d <= d.min(axis=1, keepdims=True) + EPSILON, d <= d.min(axis=0) + EPSILON
                i, j = np.nonzero(near_a | near_b)
                made.append((key, len(i), ax[i], ay[i], bx[j], by[j], d[i, j], near_a[i, j], near_b[i, j], np.full(len(i), bn.sum())))
                size += len(i)
                if size >= MADE:
                    yield _frame(bucket, made)
                    made, size = [], 0
            if made:
                yield _frame(bucket, made)

    return found


_MATE = ["_a_x", "_a_y", "_b_x", "_b_y", "distance", "nearest_a", "nearest_b", "candidates_a"]


def _frame(bucket: list[str], made: list[tuple]) -> pd.DataFrame:
    keys, sizes, *columns = zip(*made)
    owner = np.repeat(np.arange(len(keys)), sizes)
    named = pd.DataFrame(list(keys), columns=bucket).iloc[owner].reset_index(drop=True)
    return named.assign(**{name: np.concatenate(c) for name, c in zip(_MATE, columns)})


def _far(low: str, high: str, axis: str) -> tuple[Column, Column]:
    """Least and greatest difference along one axis of two cells' boxes."""
    q0, q1, t0, t1 = (F.col(f"_{s}{axis}{k}") for s in (low, high) for k in (0, 1))
    return F.greatest(q0 - t1, t0 - q1, F.lit(0.0)), F.greatest(q1 - t0, t1 - q0)


def _measured(pairs: DataFrame) -> DataFrame:
    (x0, x1), (y0, y1) = _far("q", "t", "x"), _far("q", "t", "y")
    return pairs.withColumns({"_least": F.sqrt(x0 * x0 + y0 * y0), "_most": F.sqrt(x1 * x1 + y1 * y1)})


#: Pairs of cells that are left at a level, and how many pairs of spots they hold.
Left = tuple[int, DataFrame, int]


def narrowed(g: Grid, keep: Callable[[DataFrame], DataFrame], at_once: int) -> list[Left]:
    """The pairs of cells of sides ``a`` and ``b`` that are left to be joined.

    ``keep`` drops the pairs that a question no longer needs. What it keeps of a level is halved on
    both sides if it holds more than ``at_once`` pairs of spots. There are at most ``DEPTH`` rounds,
    each of a few joins on the cells of one level, and as many as the densest part needs.
    """
    ids = [*g.bucket, "_qx", "_qy", "_tx", "_ty"]
    pairs = settle(keep(_measured(g.cells("a", 0, "q").join(g.cells("b", 0, "t"), g.bucket).withColumn("_bound", F.lit(None).cast("double")))))
    left: list[Left] = []
    held = F.col("_qs") * F.col("_ts")
    for level in range(DEPTH + 1):
        large = (held > at_once) if level < DEPTH else F.lit(False)
        size, more = pairs.agg(F.coalesce(F.sum(F.when(~large, held)), F.lit(0)), F.count_if(large)).first()
        if size:
            left.append((level, pairs.filter(~large).select(*ids), size))
        if not more:
            break
        halved = lambda name, p: g.cells(name, level + 1, p).withColumns({f"_{p}i": F.shiftright(f"_{p}x", 1), f"_{p}j": F.shiftright(f"_{p}y", 1)})  # noqa: B023, E731
        parents = pairs.filter(large).select(*g.bucket, F.col("_qx").alias("_qi"), F.col("_qy").alias("_qj"), F.col("_tx").alias("_ti"), F.col("_ty").alias("_tj"), "_bound")
        children = parents.join(halved("a", "q"), [*g.bucket, "_qi", "_qj"]).join(halved("b", "t"), [*g.bucket, "_ti", "_tj"])
        pairs = settle(keep(_measured(children)))
    return left


def faced(g: Grid, left: list[Left]) -> DataFrame | None:
    """Each spot of side ``a`` with the spots of side ``b`` that some cell left to it, as an array of bounded length; none if no cells are left.

    A pair of cells holds a bounded number of pairs, so rows are dealt to as many tasks as their pairs ask for.
    """
    made = []
    on = [*g.bucket, "_tx", "_ty"]
    for level, cells, size in left:
        tasks = chunks_of(size)
        q = g.at("a", level, "q").withColumnsRenamed({"_x": "_q_x", "_y": "_q_y", "_n": "_q_n"}).drop("_ix", "_iy")
        t = g.at("b", level, "t").join(g.cells("b", level, "t").select(*on, "_ts"), on)
        part = F.pmod(F.xxhash64("_x", "_y"), F.ceil(F.col("_ts") / F.lit(ARRAY)))  # one part but for crowded cells of the finest level
        t = t.groupBy(*on, part.alias("_part")).agg(F.collect_list(F.struct("_x", "_y", "_n")).alias("_spots"))
        made.append(cells.join(q, [*g.bucket, "_qx", "_qy"]).repartition(tasks, *on).join(t.repartition(tasks, *on), on).select(*g.bucket, "_q_x", "_q_y", "_q_n", "_spots"))
    return reduce(DataFrame.unionByName, made) if made else None


def _distances() -> Column:
    def distance(s: Column) -> Column:
        dx, dy = F.col("_q_x") - s["_x"], F.col("_q_y") - s["_y"]
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), s["_x"].alias("x"), s["_y"].alias("y"), s["_n"].alias("n"))

    return F.transform("_spots", distance)


def chunks_of(pairs: int, each: int = 1_000_000) -> int:
    return max(1, -(-int(pairs) // each))


def _slack(distance: Column) -> Column:
    """A little more than a distance: ties within epsilon, and what rounding of the boxes' distances may hide."""
    return distance * (1 + 1e-12) + EPSILON


def _nearest_cells(bucket: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Cells that may hold a nearest partner: not farther than the greatest distance to some other cell."""
    of = Window.partitionBy(*bucket, "_qx", "_qy")

    def keep(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("_bound", F.least("_bound", F.min("_most").over(of)))
        return pairs.filter(F.col("_least") <= _slack(F.col("_bound")))

    return keep


def nearest_partners(left: DataFrame, right: DataFrame, bucket: list[str], member: str, at_once: int = AT_ONCE) -> DataFrame:
    """Pairs of ``left`` and ``right`` members of a bucket that are nearest from either side, with ties within epsilon.

    ``(*bucket, a, b, distance, nearest_a, nearest_b, mutual, candidates_a)``; a member without both coordinates has no
    partner and is no candidate. Members that share a place are searched once and share its partners.
    """
    placed = _placed(left, right, bucket)
    rows, large = in_rows(placed, bucket, at_once)
    kinds = dict.fromkeys(_MATE, T.DoubleType()) | {"nearest_a": T.BooleanType(), "nearest_b": T.BooleanType(), "candidates_a": T.LongType()}
    found = rows.mapInPandas(_mates(bucket), T.StructType([*(rows.schema[c] for c in bucket), *(T.StructField(c, kind) for c, kind in kinds.items())]))
    if large is not None:
        among = _among_cells(_both_ways(large, bucket), bucket, at_once)
        found = found if among is None else found.unionByName(among)
    members = lambda points, p: points.select(*bucket, F.col(member).alias(p), F.col("x").cast("double").alias(f"_{p}_x"), F.col("y").cast("double").alias(f"_{p}_y"))
    rows = found.join(members(left, "a"), [*bucket, "_a_x", "_a_y"]).join(members(right, "b"), [*bucket, "_b_x", "_b_y"])
    return rows.select(*bucket, "a", "b", "distance", "nearest_a", "nearest_b", (F.col("nearest_a") & F.col("nearest_b")).alias("mutual"), "candidates_a")


def _among_cells(g: Grid, bucket: list[str], at_once: int) -> DataFrame | None:
    """The pairs of spots of ``_mates`` for buckets of any size, narrowed down by cells."""
    rows = faced(g, narrowed(g, _nearest_cells(g.bucket), at_once))
    if rows is None:
        return None
    near = rows.select(*g.bucket, "_q_x", "_q_y", _distances().alias("_d")).withColumn("_own", F.array_min("_d")["distance"])
    near = near.withColumn("_d", F.filter("_d", lambda d: d["distance"] <= F.col("_own") + EPSILON))
    best = F.min("_own").over(Window.partitionBy(*g.bucket, "_q_x", "_q_y"))
    near = near.withColumn("_best", best).filter(F.col("_own") <= F.col("_best") + EPSILON).select("*", F.inline("_d").alias("distance", "_t_x", "_t_y", "_t_n")).filter(F.col("distance") <= F.col("_best") + EPSILON)
    asks = F.col("_from") == "a"
    turned = [F.when(asks, F.col(f"_{q}_{c}")).otherwise(F.col(f"_{t}_{c}")).alias(f"_{p}_{c}") for q, t, p in (("q", "t", "a"), ("t", "q", "b")) for c in "xy"]
    found = near.select(*bucket, *turned, "distance", "_from")
    found = found.groupBy(*bucket, "_a_x", "_a_y", "_b_x", "_b_y").agg(F.min("distance").alias("distance"), F.bool_or(asks).alias("nearest_a"), F.bool_or(~asks).alias("nearest_b"))
    candidates = g.b.filter(asks).groupBy(*bucket).agg(F.sum("_n").alias("candidates_a"))
    return found.join(candidates, bucket).select(*bucket, *_MATE)


def distance_bands(left: DataFrame, right: DataFrame, bucket: list[str], by: list[str], edges: tuple[float, ...], at_once: int = AT_ONCE) -> DataFrame:
    """``(*by, band, pairs)``: how many pairs of a bucket's points lie in each distance band.

    Two cells whose least and greatest distance are in one band add the product of their numbers of
    points; only cells across a band's edge are halved, and those with few spots are paired off.
    """
    placed = _placed(left, right, bucket)
    rows, large = in_rows(placed, bucket, at_once)
    limits = [EPSILON, *(edge + EPSILON for edge in edges)]
    names = F.array(*(band(F.lit(float(d)), edges) for d in (0, *edges, np.inf)))
    counted = rows.select(*by, F.explode(F.arrays_zip(names.alias("band"), _in_bands(limits)(*_ARRAYS).alias("pairs"))).alias("_c"))
    whole = [counted.select(*by, "_c.band", "_c.pairs").filter("pairs > 0")]
    if large is not None:
        whole += _bands_of_cells(_grid(large, bucket), by, edges, at_once)
    return reduce(DataFrame.unionByName, whole).groupBy(*by, "band").agg(F.sum("pairs").alias("pairs"))


def _bands_of_cells(g: Grid, by: list[str], edges: tuple[float, ...], at_once: int) -> list[DataFrame]:
    whole: list[DataFrame] = []

    def keep(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.withColumns({"_low": band(F.col("_least") * (1 - 1e-12), edges), "_high": band(F.col("_most") * (1 + 1e-12), edges)}))
        whole.append(pairs.filter("_low = _high").groupBy(*by, F.col("_low").alias("band")).agg(F.sum(F.col("_qn") * F.col("_tn")).alias("pairs")))
        return pairs.filter("_low <> _high").drop("_low", "_high")

    rows = faced(g, narrowed(g, keep, at_once))
    if rows is not None:
        edge = rows.select(*by, "_q_n", F.inline(_distances()).alias("distance", "_t_x", "_t_y", "_t_n"))
        whole.append(edge.groupBy(*by, band(F.col("distance"), edges).alias("band")).agg(F.sum(F.col("_q_n") * F.col("_t_n")).alias("pairs")))
    return whole


def distance_extremes(left: DataFrame, right: DataFrame, bucket: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """``(*bucket, pairs, farthest, closest)``: the number of pairs, and their greatest and least distance."""
    rows, large = in_rows(_placed(left, right, bucket), bucket, at_once)
    total = lambda side: F.aggregate(f"_{side}_n", F.lit(0).cast("long"), lambda n, k: n + k)
    few = rows.withColumn("_d", _extremes("_a_x", "_a_y", "_b_x", "_b_y")).select(*bucket, (total("a") * total("b")).alias("pairs"), "_d.farthest", "_d.closest")
    return few if large is None else few.unionByName(_extremes_of_cells(_grid(large, bucket), bucket, at_once))


def _extremes_of_cells(g: Grid, bucket: list[str], at_once: int) -> DataFrame:
    of = Window.partitionBy(*bucket)

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("_bound", F.least("_bound", F.min("_most").over(of))).filter(F.col("_least") <= _slack(F.col("_bound")))

    def far(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("_bound", F.greatest("_bound", F.max("_least").over(of))).filter(_slack(F.col("_most")) >= F.col("_bound"))

    found = []
    for keep, f, name in ((near, F.min, "closest"), (far, F.max, "farthest")):
        rows = faced(g, narrowed(g, keep, at_once))
        of_none = g.a.select(*bucket, F.lit(0.0).alias("_own")).filter(F.lit(False))
        one = F.array_min if f is F.min else F.array_max
        found.append((of_none if rows is None else rows.select(*bucket, one(_distances())["distance"].alias("_own"))).groupBy(*bucket).agg(f("_own").alias(name)))
    counts = g.a.groupBy(*bucket).agg(F.sum("_n").alias("_a")).join(g.b.groupBy(*bucket).agg(F.sum("_n").alias("_b")), bucket)
    return counts.join(found[0], bucket).join(found[1], bucket).select(*bucket, (F.col("_a") * F.col("_b")).alias("pairs"), "farthest", "closest")
