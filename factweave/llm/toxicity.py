"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import hashed_share, map_rows, record, text_of

#: Hash buckets of the features.
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class PuParams:
    #: The sample is bounded: about so many confirmed toxic and so many unlabelled documents at most.
    most_positive: int = 2000
    most_unlabelled: int = 6000
    features: int = 512
    classifiers: int = 3
    steps: int = 400
    rate: float = 0.05
    l2: float = 5e-4
    #: A feature counts if it is in this share of the positives and, by the prior, so likely toxic where it stands.
    least_share: float = 0.01
    least_precision: float = 0.5


def word_features(word: str) -> set[int]:
    """Buckets of a lower-cased word and its prefixes, so that inflected and joined forms meet."""
    forms = {word, *(word[:k] for k in PREFIXES)}
    return {zlib.crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for f in forms}


def text_features(text: str) -> np.ndarray:
    found: set[int] = set()
    for word in set(text.lower().split()):
        found |= word_features(word)
    return np.array(sorted(found), np.int32)


@dataclass
class PuModel:
    """Averaged linear classifiers on the presence of chosen features."""

    chosen: dict[int, int]
    weights: np.ndarray  # classifiers x features
    bias: np.ndarray

    def score(self, hits: set[int]) -> float:
        z = self.bias + self.weights[:, sorted(hits)].sum(1) if hits else self.bias
        return float(np.mean(1 / (1 + np.exp(-np.clip(z, -30, 30)))))


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: PuParams) -> np.ndarray:
    """Features whose document frequency among the positives stands out from the unlabelled.

    By a two-sample z score, among those that are toxic often enough: prior * P(f | toxic) / P(f).
    """
    keys, c = np.unique(np.concatenate([np.empty(0, np.int32), *positive]), return_counts=True)  # no other can be chosen
    u = np.zeros(len(keys), np.int64)
    for row in unlabelled if len(keys) else ():
        at = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
        u[at[keys[at] == row]] += 1
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    pooled = (c + u + 1) / (n + m + 2)
    z = (c / n - u / m) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    z[(c < max(3, p.least_share * n)) | (prior * c / n < p.least_precision * (u + 0.5) / m)] = 0
    best = np.argsort(-z, kind="stable")[: p.features]
    return keys[best[z[best] > 4]]


def nn_pu_gradient(xp: np.ndarray, pp: np.ndarray, xu: np.ndarray, pu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray]:
    """``(positive part, negative part, direction)`` of the risk at ``w`` and ``b`` for rows with shares ``pp`` and ``pu``.

    risk = prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with logistic loss. Where
    the second part falls below zero, which only overfitting can do, the direction is its gradient
    turned round, so it rises again.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    grad = lambda x, s: np.append(s @ x, s.sum())
    zp, zu = xp @ w + b, xu @ w + b
    positive = prior * float(pp @ soft(-zp))
    negative = float(pu @ soft(zu) - prior * (pp @ soft(zp)))
    g_negative = grad(xu, pu * sig(zu)) - prior * grad(xp, pp * sig(zp))
    return positive, negative, -g_negative if negative < 0 else g_negative + prior * grad(xp, pp * (sig(zp) - 1))


def nn_pu(xp: np.ndarray, xu: np.ndarray, prior: float, p: PuParams, seed: int) -> tuple[np.ndarray, float]:
    """Linear weights and bias that minimise the non-negative positive-unlabelled risk over a bootstrap sample.

    The bias stays at or below the prior's log-odds: all features speak for toxicity, so a document
    without any can't be likelier toxic than one not looked at.
    """
    rng = np.random.default_rng(seed)

    def drawn(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A bootstrap sample, equal rows once with their share."""
        rows, n = np.unique(x[rng.integers(0, len(x), len(x))], axis=0, return_counts=True)
        return rows.astype(np.float64), n / len(x)

    (xp, pp), (xu, pu) = drawn(xp), drawn(xu)
    w, b = np.zeros(xp.shape[1]), math.log(prior / (1 - prior))
    most = b
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, p.steps + 1):
        g = nn_pu_gradient(xp, pp, xu, pu, w, b, prior)[2]
        g[:-1] += p.l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], min(b - move[-1], most)
    return w, b


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: PuParams = PuParams()) -> PuModel:
    prior = min(max(prior, 1e-4), 0.9)
    chosen = choose(positive, unlabelled, prior, p)
    at = {int(f): i for i, f in enumerate(chosen)}
    if not positive or not unlabelled or not at:
        return PuModel({}, np.zeros((1, 0)), np.array([math.log(prior / (1 - prior))]))

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(at)), np.int8)
        for i, r in enumerate(rows):
            x[i, [at[f] for f in r[np.isin(r, chosen)].tolist()]] = 1
        return x

    xp, xu = dense(positive), dense(unlabelled)
    fits = [nn_pu(xp, xu, prior, p, seed) for seed in range(p.classifiers)]
    return PuModel(at, np.array([w for w, _ in fits]), np.array([b for _, b in fits]))


def held_out(id_col: str, folds: int, fold: int):
    """Documents kept out of training: by the CRC-32 of the id as text. A null id is held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == fold, F.lit(True))


def known_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, fold: int) -> DataFrame:
    """``(_id, y)``: one label of each id outside the fold; where rows of one id differ, what most say, 1 in a tie. Other values and nulls are no labels."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).filter((~held_out("_id", folds, fold)) & F.col("y").isin(0, 1))
    return known.groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, fold: int, p: PuParams = PuParams()) -> PuModel:
    """Fit on a sample of bounded size, by hash of the ids: labelled toxic documents, and any documents as unlabelled.

    Both are drawn in one pass over the texts, one row of each id (the one whose features come first in
    order), so an id that many rows repeat counts once. The class prior is the toxic share of all
    labelled ids outside the fold.
    """
    known = known_labels(labels, id_col, label_col, folds, fold)
    prior, n_positive = known.agg(F.avg("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("text")).filter(~held_out("_id", folds, fold))
    n_ids = texts.agg(F.approx_count_distinct("_id")).first()[0]
    key = F.concat(F.lit("u"), F.col("_id").cast("string"))
    chosen = known.filter((F.col("y") == 1) & hashed_share(F.col("_id").cast("string"), p.most_positive, n_positive)).select("_id", F.lit(True).alias("positive"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            features = pa.array([text_features(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary())
            return record(_id=batch.column(0), positive=batch.column(1), unlabelled=batch.column(2), f=features)

        return apply

    rows = texts.join(F.broadcast(chosen), "_id", "left").withColumn("unlabelled", hashed_share(key, p.most_unlabelled, n_ids))  # about ``most_positive`` ids
    rows = rows.select("_id", F.coalesce("positive", F.lit(False)).alias("positive"), "unlabelled", "text").filter("positive or unlabelled")
    found = map_rows(rows, make, "_id long, positive boolean, unlabelled boolean, f binary").groupBy("_id", "positive", "unlabelled").agg(F.min("f").alias("f"))
    found = sorted(found.collect(), key=lambda r: r._id)
    of = lambda column: [np.frombuffer(r.f, np.int32) for r in found if r[column]]
    return fit(of("positive"), of("unlabelled"), prior if prior is not None else 0.1, p)


def scorer(spark: SparkSession, model: PuModel, remember: int = 400_000):
    """A column function from whole texts to scores between 0 and 1; empty and null texts get the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = shared.value, {}
        chosen, get = model.chosen, known.get

        def hits_of(word: str) -> tuple:
            hits = tuple(chosen[f] for f in word_features(word) if f in chosen)
            if len(known) < remember:
                known[word] = hits
            return hits

        def one(text: str) -> float:
            hits: set[int] = set()
            for word in set(text.lower().split()):
                got = get(word)
                if got is None:
                    got = hits_of(word)
                if got:
                    hits.update(got)
            return model.score(hits)

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=float)

    return lambda column: of(text_of(column))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = 0.3, p: PuParams = PuParams()) -> DataFrame:
    """One row per document: ``(id, held_out, score, predicted)``.

    Labels inside the fold are never read. Rows repeated by id are scored each, those without an id
    are held out; an empty table gives no rows; without labelled positives every score is the prior;
    other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col, folds, fold, p)
    of = scorer(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), of(text_col).alias("score"))
    return rows.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
