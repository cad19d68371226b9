"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import chunks_for, hashed_share, map_rows, record, stash
from factweave.llm.components import connected_components

#: The pivots of all labels together; they go to every task.
MOST_PIVOTS = 4096


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, label, dim, unit, key)``: each usable vector at length one in double precision, and its digest; null where it links with nothing."""

    def make():
        def unit(v: list | None) -> bytes | None:
            if not v or None in v:
                return None
            x = np.array(v, np.float64)
            if not np.isfinite(x).all() or not (top := np.abs(x).max()) > 0:
                return None
            x = x / top
            return (x / math.sqrt(float(x @ x))).astype("<f8").tobytes()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, labels = batch.column(0), batch.column(1)
            linkable = [i is not None and x is not None for i, x in zip(ids.to_pylist(), labels.to_pylist(), strict=True)]
            units = [unit(v) if ok else None for ok, v in zip(linkable, batch.column(2).to_pylist(), strict=True)]
            keys = [None if u is None else hashlib.sha256(u).digest() for u in units]
            dims = [None if u is None else len(u) // 8 for u in units]
            return record(id=ids, label=labels, dim=pa.array(dims, pa.int32()), unit=pa.array(units, pa.binary()), key=pa.array(keys, pa.binary()))

        return apply

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return map_rows(rows, make, "id long, label string, dim int, unit binary, key binary")


def _matrix(units: pa.Array | list) -> np.ndarray:
    return np.frombuffer(b"".join(units if isinstance(units, list) else units.to_pylist()), "<f8").reshape(len(units), -1)


def assign_cells(classes: DataFrame, pivots: dict[tuple[str, int], np.ndarray], radius: float) -> DataFrame:
    """``(label, dim, cell, home, cid, rep, n, unit)``: each vector in its nearest pivot's cell and in those that its radius may reach.

    Let d be a vector's distance to its home pivot and e that to another one. By the triangle
    inequality no vector of the other cell is within ``radius`` if e - d > 2 * radius; nor is one if
    the plane between both pivots is farther than ``radius``, which is the sharper bound for
    Euclidean distance. Vectors of a label without pivots share one cell.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    reach = radius + 1e-9

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            at, cells, homes = [], [], []
            groups: dict = {}
            for i, k in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(k, []).append(i)
            units = batch.column("unit")
            for k, own in groups.items():
                p = shared.value.get(k)
                if p is None:
                    at += own
                    cells += [0] * len(own)
                    homes += [True] * len(own)
                    continue
                square = np.maximum(2 - 2 * (_matrix(units.take(pa.array(own))) @ p.T), 0)
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
                home = square.argmin(1)
                rows = np.arange(len(own))
                nearest = square[rows, home][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (square - nearest) / (2 * apart[home])
                near = (np.sqrt(square) - np.sqrt(nearest) <= 2 * reach) & ~(plane > reach)
                near[rows, home] = True
                r, c = np.nonzero(near)
                at += np.array(own)[r].tolist()
                cells += c.tolist()
                homes += (home[r] == c).tolist()
            taken = pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at, pa.int64())) for c in ("label", "dim", "cid", "rep", "n", "unit")], ["label", "dim", "cid", "rep", "n", "unit"])
            return record(label=taken["label"], dim=taken["dim"], cell=pa.array(cells, pa.int32()), home=pa.array(homes, pa.bool_()), cid=taken["cid"], rep=taken["rep"], n=taken["n"], unit=taken["unit"])

        return apply

    return map_rows(classes.select("cid", "rep", "n", "label", "dim", "unit"), make, "label string, dim int, cell int, home boolean, cid long, rep long, n long, unit binary")


def _join_blocks(least: float):
    """Links between one block of a cell's own vectors and one of all its members: counts, and a spanning forest instead of the pairs."""

    def run(block: pa.Table) -> pa.Table:
        home = np.array(block["side"].to_pylist()) == 0
        cid, rep, n = (block[c].to_numpy() for c in ("cid", "rep", "n"))
        unit = _matrix(block["unit"].combine_chunks())
        h, m = np.flatnonzero(home), np.flatnonzero(~home)
        linked = unit[h] @ unit[m].T >= least
        linked &= cid[h][:, None] != cid[m][None, :]
        links = linked.astype(np.float64) @ n[m].astype(np.float64)
        a, b = np.nonzero(linked)
        nodes, number = np.unique(rep, return_inverse=True)
        a, b = number[h[a]], number[m[b]]
        low = np.arange(len(nodes))
        while True:
            small = np.minimum(low[a], low[b])
            new = low.copy()
            np.minimum.at(new, a, small)
            np.minimum.at(new, b, small)
            new = new[new]
            if (new == low).all():
                break
            low = new
        counted = np.flatnonzero(links > 0)
        moved = np.flatnonzero(low != np.arange(len(nodes)))
        none = [None] * len(counted)
        return pa.table(
            {
                "cid": pa.array([*cid[h[counted]].tolist(), *[None] * len(moved)], pa.int64()),
                "links": pa.array([*links[counted].astype(np.int64).tolist(), *[0] * len(moved)], pa.int64()),
                "a": pa.array([*none, *nodes[moved].tolist()], pa.int64()),
                "b": pa.array([*none, *nodes[low[moved]].tolist()], pa.int64()),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, block: int = 2048
) -> DataFrame:
    """One row per vector: ``(id, n_links, component_id, kept)``.

    Links are pairs of equal label (and equal length) with cosine of at least ``least`` in double
    precision. Null, zero or non-finite vectors, and those without label or id, link with nothing
    and are their own component (kept, also without an id). Equal unit vectors are one class with a count, so copies are
    compared once. Pivots are a hash sample of the classes, about one per ``block`` of them and
    ``MOST_PIVOTS`` at most. Cells are joined independently, and a cell larger than ``block`` is dealt
    out as pairs of blocks, so that no task holds more than two blocks however large a cell is. An
    empty table gives no rows; repeated rows count as separate vectors.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    rows = stash(unit_vectors(vectors, id_col, vec_col, label_col))
    own = ["label", "dim", "key"]
    classes = rows.filter("key is not null").groupBy(own).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("unit").alias("unit"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()))
    n_classes = classes.count()
    wanted = min(MOST_PIVOTS, chunks_for(n_classes, block))
    found: dict = {}
    sample = classes.filter(hashed_share(F.col("key"), wanted, n_classes)).select("label", "dim", "key", "unit")
    for r in sorted(sample.collect(), key=lambda r: (r.label, r.dim, bytes(r.key))):  # about MOST_PIVOTS at most
        found.setdefault((r.label, r.dim), []).append(bytes(r.unit))
    cells = stash(assign_cells(classes, {k: _matrix(v) for k, v in found.items()}, radius))

    cell = ["label", "dim", "cell"]
    sizes = cells.groupBy(cell).agg(F.count_if("home").alias("own"), F.count("*").alias("all"))
    sizes = stash(sizes.select(*cell, F.ceil(F.col("own") / block).cast("int").alias("own_blocks"), F.ceil(F.col("all") / block).cast("int").alias("all_blocks")))
    dealt = cells.join(sizes, cell)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    carried = [*cell, "cid", "rep", "n", "unit"]
    homes = dealt.filter("home").select(*carried, F.lit(0).alias("side"), place("own_blocks").alias("hb"), upto("all_blocks").alias("mb"))
    members = dealt.filter("own_blocks > 0").select(*carried, F.lit(1).alias("side"), upto("own_blocks").alias("hb"), place("all_blocks").alias("mb"))
    tied = homes.unionByName(members).groupBy(*cell, "hb", "mb").applyInArrow(_join_blocks(least), "cid long, links long, a long, b long")
    tied = stash(tied)
    links = tied.filter("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(tied.filter("a is not null").select("a", "b"))
    known = classes.select(*own, "cid", "rep", "n").join(links, "cid", "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = stash(known.select(*own, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("id", *own).join(known, own, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
