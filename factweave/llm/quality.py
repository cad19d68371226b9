"""Quality by a generalised additive model with pairwise interactions, boosted in cycles."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import hashed_share, map_rows, record, text_of
from factweave.llm.toxicity import held_out, known_labels

_LOWER, _UPPER, _DIGIT, _SPACE, _MARK = (np.zeros(256, bool) for _ in range(5))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[33:127] = True
_MARK &= ~(_LOWER | _UPPER | _DIGIT)
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'-\"()"]] = True
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "newline", "plain_mark", "odd_mark", "bar", "bang", "high", "entropy",
    "log_words", "mean_word", "sd_word", "distinct_words", "top_word", "markless_words", "bare_words", "log_lines", "repeated_lines", "mean_line", "longest_line", "capital_starts", "pair_repeats",
)


def text_stats(text: str) -> list[float]:
    """The model's inputs for one whole text: shares of byte classes, and figures on its words and lines."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    marks = counts[_MARK].sum()
    plain = counts[_PLAIN].sum()
    words = text.split()
    w = len(words) or 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = text.split("\n")
    line_counts = Counter(lines)
    line_words = len(words) / len(lines)
    distinct = list(seen)
    bare = sum(seen[x] for x in distinct if not any(map(str.isalnum, x)))
    clean = sum(seen[x] for x in distinct if x.isalpha())
    capital = sum(seen[x] for x in distinct if x[0].isupper() and not x.isupper())
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(len(raw)), counts[_LOWER].sum() / n, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_SPACE].sum() / n, counts[10] / n, plain / n, (marks - plain) / n,
        counts[124] / n, counts[33] / n, counts[128:].sum() / n, float(-(share * np.log2(share)).sum()),
        math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(seen) / w, max(seen.values(), default=0) / w, clean / w, bare / w,
        math.log(len(lines)), 1 - len(line_counts) / len(lines), line_words, max(map(len, lines)) / n, capital / w, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


@dataclass(frozen=True)
class GamParams:
    #: The sample is bounded: about so many labelled documents at most.
    most_rows: int = 20_000
    bins: int = 64
    pair_bins: int = 12
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 80
    rate: float = 0.1
    leaves: int = 4
    least_leaf: float = 4.0
    l2: float = 1.0


@dataclass
class GamModel:
    """A base log-odds, a lookup table per feature, and a table per chosen pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += values[np.searchsorted(edges, x[:, f], side="right")]
        if self.pair_tables:
            coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in {g for pair in self.pair_tables for g in pair}}
            for (f, g), values in self.pair_tables.items():
                z += values[coarse[f], coarse[g]]
        return z


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def _leaf(g, h, p: GamParams):
    return g / (h + p.l2)


def _gain(g, h, p: GamParams):
    return g * g / (h + p.l2)


def shallow_tree(g: np.ndarray, h: np.ndarray, p: GamParams) -> np.ndarray:
    """Values per bin of a tree with ``leaves`` leaves over ordered bins, each split the best there is."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    leaves = [(0, len(g))]
    while len(leaves) < p.leaves:
        best = (1e-9, None, None)
        for a, b in leaves:
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gl, hl = cg[at] - cg[a], ch[at] - ch[a]
            gr, hr = cg[b] - cg[at], ch[b] - ch[at]
            gain = np.where((hl >= p.least_leaf / 4) & (hr >= p.least_leaf / 4), _gain(gl, hl, p) + _gain(gr, hr, p) - _gain(cg[b] - cg[a], ch[b] - ch[a], p), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.empty(len(g))
    for a, b in leaves:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], p)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, p: GamParams) -> tuple[float, np.ndarray]:
    """The best cut of both features into four quadrants: its gain, and its values on the grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, np.zeros_like(g)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    top_g, top_h, left_g, left_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    parts = [(a_g, a_h), (top_g - a_g, top_h - a_h), (left_g - a_g, left_h - a_h), (tg - top_g - left_g + a_g, th - top_h - left_h + a_h)]
    gain = sum(_gain(x, y, p) for x, y in parts) - _gain(tg, th, p)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = np.empty_like(g)
    v = [float(_leaf(x[i, j] if x.shape == gain.shape else x, y[i, j] if y.shape == gain.shape else y, p)) for x, y in parts]
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), values


def fit(x: np.ndarray, y: np.ndarray, p: GamParams = GamParams()) -> GamModel:
    """Cyclic boosting: each round gives every feature one small step on its own residual; then the pairs with most left to gain get theirs."""
    n, k = x.shape
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    base = math.log(share / (1 - share))
    edges = [_edges(x[:, f], p.bins) for f in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = GamModel(base, edges, tables, [_edges(x[:, f], p.pair_bins) for f in range(k)])
    if n < 2 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    z = np.full(n, base)
    prob = lambda: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(p.rounds):
        for f in range(k):
            q = prob()
            size = len(tables[f])
            step = p.rate * shallow_tree(np.bincount(at[f], y - q, size), np.bincount(at[f], q * (1 - q), size), p)
            tables[f] += step
            z += step[at[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]

    def grid(f: int, g: int, q: np.ndarray):
        shape = len(model.pair_edges[f]) + 1, len(model.pair_edges[g]) + 1
        cell = coarse[f] * shape[1] + coarse[g]
        return cell, np.bincount(cell, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(cell, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    q = prob()
    gains = [(pair_tree(*grid(f, g, q)[1:], p)[0], f, g) for f in range(k) for g in range(f + 1, k)]
    for _, f, g in sorted(gains, reverse=True)[: p.pairs]:
        model.pair_tables[f, g] = np.zeros((len(model.pair_edges[f]) + 1, len(model.pair_edges[g]) + 1))
    for _ in range(p.pair_rounds):
        for (f, g), values in model.pair_tables.items():
            cell, sg, sh = grid(f, g, prob())
            step = p.rate * pair_tree(sg, sh, p)[1]
            values += step
            z += step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, fold: int, p: GamParams = GamParams()) -> GamModel:
    """Fit on the figures of about ``most_rows`` labelled ids by hash, one row of each (the one whose figures come first in order)."""
    known = known_labels(labels, id_col, label_col, folds, fold)
    known = known.filter(hashed_share(F.col("_id").cast("string"), p.most_rows, known.count()))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(known), "_id")  # about ``most_rows``

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return record(_id=batch.column(0), y=batch.column(1), x=pa.array([text_stats(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64())))

        return apply

    rows = map_rows(texts.select("_id", "y", "text"), make, "_id long, y int, x array<double>").groupBy("_id", "y").agg(F.min("x").alias("x"))
    rows = sorted(rows.collect(), key=lambda r: r._id)
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in rows], np.float64), p)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1, threshold: float = 0.5, p: GamParams = GamParams()) -> DataFrame:
    """One row per document: ``(id, held_out, score, predicted)``.

    The model is fitted on the driver from at most ``most_rows`` labelled rows' figures (not texts)
    outside the fold, and scored where texts are read by adding table entries for whole batches.
    Null and empty texts are scored like any, as are rows that repeat an id; rows without an id are
    held out; without labels every score is one half; an empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, folds, fold, p))

    def make():
        model = shared.value

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([text_stats(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            return record(id=batch.column(0), score=pa.array(1 / (1 + np.exp(-np.clip(model.log_odds(x), -30, 30)))))

        return apply

    rows = map_rows(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), make, "id long, score double")
    out = rows.select(F.col("id").alias(id_col), "score")
    return out.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
