"""Embedding whitening: a distributed covariance, its float32 eigenvectors, and their refinement in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import record

#: Entries beyond this, after scaling, stand for it; sums of such entries are still exact.
_MOST = 1 << 62
#: Rows whose products are made together, and groups in which tasks' sums are added up first.
_ROWS, _SALTS = 2048, 32


def entries(column: pa.ListArray, scale: int = 1024, shift: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)`` for each vector length in a batch: the places of usable vectors, and ``floor(scale * c) + shift`` of their entries."""
    sizes = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # a null entry becomes NaN
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        c = flat[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(c).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(c[good] * scale), -_MOST, _MOST - 1)
            yield rows[good], np.minimum(whole.astype(np.int64), _MOST - 1) + shift


def _added_up(parts: DataFrame, of: str = "dim int, at int", salted: bool = True) -> DataFrame:
    """Elementwise sums of ``row`` by ``dim`` and ``at``, at first within salted groups of tasks."""
    schema = f"{of}, salt int, row array<double>"

    def add(group: pa.Table) -> pa.Table:
        rows = group["row"].combine_chunks()
        total = np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1).sum(axis=0)
        return group.slice(0, 1).set_column(group.schema.get_field_index("row"), "row", pa.array([total.tolist()], pa.list_(pa.float64())))

    for salt in (F.col("salt"), F.lit(0).cast("int")):
        parts = parts.withColumn("salt", salt).groupBy("dim", "at", "salt").applyInArrow(add, schema)
    return parts.select("dim", "at", "row")


def _per_task(vectors: DataFrame, fold, schema: str) -> DataFrame:
    """``fold(dim)`` makes an object with ``add(x)`` and ``rows()`` for each length that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for _, x in entries(batch.column(0)):
                d = x.shape[1]
                if d not in held:
                    held[d] = fold(d)
                for at in range(0, len(x), _ROWS):
                    held[d].add(x[at : at + _ROWS])
        for d, f in held.items():
            yield f.batch(d)

    return vectors.select("v").mapInArrow(run, schema)


class _Sums:
    """Exact sums by dimension, in two halves that can't overflow for fewer than 2**31 rows a task."""

    def __init__(self, d: int):
        self.n, self.high, self.low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)

    def add(self, x: np.ndarray):
        self.n += len(x)
        self.high += (x >> 31).sum(axis=0)
        self.low += (x & ((1 << 31) - 1)).sum(axis=0)

    def batch(self, d: int) -> pa.RecordBatch:
        at = np.arange(d, dtype=np.int32)
        return record(dim=pa.array(np.full(d, d, np.int32)), at=pa.array(at), n=pa.array(np.full(d, self.n, np.int64)), high=pa.array(self.high), low=pa.array(self.low))


class _Products:
    """Sums of products of centred entries, one row per dimension. Exact while they are whole numbers below 2**53."""

    def __init__(self, width: int, centred):
        self.total, self.centred = np.zeros((width, width)), centred

    def add(self, x: np.ndarray):
        y = self.centred(x)
        self.total += y.T @ y

    def batch(self, d: int) -> pa.RecordBatch:
        k = len(self.total)
        salt = np.random.default_rng().integers(_SALTS)  # which group adds it first changes no whole number
        return record(dim=pa.array(np.full(k, d, np.int32)), at=pa.array(np.arange(k, dtype=np.int32)), salt=pa.array(np.full(k, salt, np.int32)), row=pa.array(self.total.tolist(), pa.list_(pa.float64())))


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of eigenvalues that are not ``apart`` from their neighbours in order, in groups of two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined_eigen(v: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Float32 eigenvectors are corrected by Ogita and Aishima's iteration: with R = I - X'X and
    S = X'AX, X becomes X + XE, where E divides S + R * value by the gap of two eigenvalues if that is
    wider than the error of S, and is R / 2 otherwise. It converges quadratically. Products are made in numpy's extended
    precision. Eigenvalues that are not apart form clusters: each is solved by itself, as the small
    matrix of A - mean on the cluster's own vectors, whose gaps are wide beside its own size; then
    the vectors are made orthonormal again (X + XR / 2) and the iteration goes on.
    Exactly equal eigenvalues keep some orthonormal basis. Each vector's largest entry is positive.
    """
    size = len(v)
    scale = float(np.abs(v).max(initial=0.0))
    if not scale > 0:
        return np.zeros(size), np.eye(size)
    a = v.astype(np.longdouble) / np.longdouble(scale)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(size, dtype=np.longdouble)
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    whole = norm(a)
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        apart = 2 * (norm(s - np.diag(values)) + whole * norm(r)) + 8 * float(np.finfo(np.longdouble).eps) * whole
        gap = values[None, :] - values[:, None]
        wide = np.abs(gap) > apart
        e = np.where(wide, (s + r * values[None, :]) / np.where(wide, gap, 1), r / 2)
        x = x + x @ e
        for own in _clusters(values, apart):
            part = x[:, own]
            mean = values[own].mean()
            small = part.T @ (a @ part - mean * part)
            small = (small + small.T) / 2
            top = np.abs(small).max()
            if top > 0:
                x[:, own] = part @ np.linalg.eigh((small / top).astype(np.float64))[1].astype(np.longdouble)
        for _ in range(2):  # what is left of R would be divided by the gaps
            x = x + x @ (eye - x.T @ x) / 2
        if float(np.abs(e).max()) < 1e-18:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(size)] < 0, -1, 1)
    return (values * np.longdouble(scale)).astype(np.float64), x.astype(np.float64)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error, deviation_exact)``: a row per usable vector and component.

    1. Entries become whole numbers x (see ``entries``); n and the sums S are added up exactly.
    2. Products of x less the rounded mean are whole numbers too, so their sums don't depend on the
       order of tasks; what rounding the mean left out is taken off afterwards.
    3. The driver holds one matrix of products (a row per dimension) and refines its eigenvectors.
    4. Rows are projected; a pass over them before gives ``identity_error``.

    Null vectors, those with null or non-finite entries, and empty ones give no row. Vectors of unlike
    length are whitened apart, each length with an n of its own; ``identity_error`` is the largest of
    all. Components without variance (an eigenvalue below rounding, as for one row or equal rows)
    have a null ``whitened``, and ``explained`` is null if nothing varies. ``deviation`` is null where it needs more than 64 bits (from about
    three million rows of 64 entries on), ``deviation_exact`` from 38 digits on. Rows without an id
    or with a repeated one are vectors like others; an empty table gives no rows; other columns are
    ignored. Entries beyond 2**62 / 1024 count as that.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    summed = _per_task(rows, _Sums, "dim int, at int, n long, high long, low long").groupBy("dim", "at")
    summed = summed.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()  # one row per length and dimension
    count, totals = {}, {}
    for r in sorted(summed, key=lambda r: (r.dim, r.at)):
        count[r.dim] = r.n
        totals.setdefault(r.dim, []).append((int(r.high) << 31) + int(r.low))
    middle = {d: np.array([(2 * s + count[d]) // (2 * count[d]) for s in sums], np.int64) for d, sums in totals.items()}
    rest = {d: [s - count[d] * int(m) for s, m in zip(totals[d], middle[d], strict=True)] for d in totals}
    centre = spark.sparkContext.broadcast(middle)
    products = _per_task(rows, lambda d: _Products(d, lambda x: (x - centre.value[d]).astype(np.float64)), "dim int, at int, salt int, row array<double>")
    square: dict = {d: np.zeros((d, d)) for d in totals}
    for r in _added_up(products).collect():  # a row per length and dimension
        square[r.dim][r.at] = r.row
    model = {}
    for d, total in square.items():
        n = count[d]
        over = np.array([x / n for x in rest[d]])
        covariance = total / n - np.outer(over, over)
        values, basis = refined_eigen(covariance)
        k = min(components, d)
        alive = values[:k] > d * np.finfo(np.float64).eps * max(values[0], 0)
        spread = np.trace(covariance)
        model[d] = {
            "n": n, "middle": middle[d], "over": over, "rest": rest[d], "alive": alive, "basis": basis[:, :k] / np.sqrt(np.where(alive, values[:k], np.inf)),
            "explained": [float(x) / float(spread) if spread > 0 else None for x in values[:k]],
        }
    shared = spark.sparkContext.broadcast(model)

    def projected(x: np.ndarray) -> np.ndarray:
        m = shared.value[x.shape[1]]
        return ((x - m["middle"]).astype(np.float64) - m["over"]) @ m["basis"]

    ones = lambda x: np.hstack((projected(x), np.ones((len(x), 1))))
    checked = _per_task(rows, lambda d: _Products(len(shared.value[d]["alive"]) + 1, ones), "dim int, at int, salt int, row array<double>")
    seen: dict = {d: np.zeros((len(m["alive"]) + 1,) * 2) for d, m in model.items()}
    for r in _added_up(checked).collect():
        seen[r.dim][r.at] = r.row
    error = 0.0
    for d, total in seen.items():
        mean = total[:-1, -1] / count[d]
        off = total[:-1, :-1] / count[d] - np.outer(mean, mean) - np.eye(len(mean))
        alive = model[d]["alive"]
        error = max(error, float(np.abs(off[np.ix_(alive, alive)]).max(initial=0.0)))

    def deviations(x: np.ndarray) -> list[int]:
        m = shared.value[x.shape[1]]
        y, rest_ = x - m["middle"], m["rest"]
        if (float(np.abs(y).max()) + 1) ** 2 * float(m["n"]) ** 2 * x.shape[1] < 2.0**62:
            t = y * m["n"] - np.array(rest_, np.int64)
            return (t * t).sum(axis=1).tolist()
        t = y.astype(object) * m["n"] - np.array(rest_, object)
        return (t * t).sum(axis=1).tolist()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in entries(batch.column(1)):
                m = shared.value[x.shape[1]]
                k = len(m["alive"])
                w = projected(x)
                far = [Decimal(s) if s < 10**38 else None for s in deviations(x)]
                yield record(
                    id=batch.column(0).take(pa.array(np.repeat(at, k))), component=pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), n=pa.array(np.full(len(at) * k, m["n"], np.int64)),
                    deviation_exact=pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k))), whitened=pa.array(w.ravel(), pa.float64(), mask=np.tile(~m["alive"], len(at))),
                    explained=pa.array(m["explained"] * len(at), pa.float64()),
                )

    id_type = dict(rows.dtypes)["id"]
    made = rows.mapInArrow(out, f"id {id_type}, component int, n long, deviation_exact decimal(38,0), whitened double, explained double")
    small = F.col("deviation_exact").try_cast("long")
    return made.select(F.col("id").alias(id_col), "component", "n", small.alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"), "deviation_exact")
