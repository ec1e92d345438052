"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text; the class prior is estimated
from how much of the unlabelled text scores like positives, and a small network
minimises the non-negative unbiased risk

    prior * R_P(+)  +  max(0, R_U(-) - prior * R_P(-)).

Labels of class 0 are never used to learn. Fitting uses two bounded, documented
samples; every row is scored from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import quality_rules as rules

#: Rows of each fitting sample (positives; unlabelled), at most.
FIT_ROWS = 15_000
#: Hashed byte-trigram frequencies beside the document statistics.
TRIGRAMS = 64
#: Rows whose crc32(doc_id) modulo this is 0 are held out of learning.
FOLDS = 5
PREDICT_AT = 0.3
#: Share of trusted positives, set aside from the fit, that may score below PREDICT_AT; scores are shifted up until no more do.
SPARED = 0.01
#: The estimated class prior is held within these bounds.
PRIORS = (0.05, 0.98)

WIDTH = len(rules.FEATURES) + TRIGRAMS


def features(texts: pa.Array) -> np.ndarray:
    s = rules.statistics(texts)
    raw, offs = c.buffers(texts)
    x = raw.astype(np.uint32)
    n, docs = len(raw), len(texts)
    tri = np.zeros((docs, TRIGRAMS), np.float32)
    if n >= 3:
        h = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(26)
        doc = np.repeat(np.arange(docs), np.diff(offs))
        inside = doc[:-2] == doc[2:]
        tri = np.bincount(doc[:-2][inside] * TRIGRAMS + h[inside], minlength=docs * TRIGRAMS).reshape(docs, TRIGRAMS).astype(np.float32)
        tri = np.sqrt(tri / np.maximum(np.diff(offs), 1)[:, None])
    return np.concatenate([s.features, tri], axis=1)


@dataclass
class Net:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.5

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -30, 30)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, seed: int = 7, hidden: int = 16, batch: int = 2048, rate: float = 3e-3, decay: float = 1e-4) -> Net:
    """With a prior: non-negative PU risk. Without one: plain positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    net = Net(both.mean(axis=0), both.std(axis=0) + 1e-3, None, None, None, None)
    d = both.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), np.zeros(1, np.float32)]
    net.w1, net.b1, net.w2, net.b2 = w
    p, u = net.inputs(p), net.inputs(u)
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        x = np.concatenate([xp, xu])
        a = np.tanh(x @ w[0] + w[1])
        z = a @ w[2] + w[3][0]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.zeros(len(z), np.float32)
        if prior is None:
            g[:batch], g[batch:] = (s[:batch] - 1) / batch, s[batch:] / batch
        else:
            # sigmoid loss: it is bounded, so the estimate of the negative risk is steady
            negative = s[batch:].mean() - prior * s[:batch].mean()
            slope = s * (1 - s)
            # gradient of R_U(-) - prior * R_P(-), ascended where the estimate went below zero
            turn = 1.0 if negative >= 0 else -1.0
            g[batch:] = turn * slope[batch:] / batch
            g[:batch] = -turn * prior * slope[:batch] / batch
            if negative >= 0:
                g[:batch] -= prior * slope[:batch] / batch
        da = np.outer(g, w[2]) * (1 - a * a)
        grads = [x.T @ da + decay * w[0], da.sum(axis=0), a.T @ g + decay * w[2], np.array([g.sum()])]
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, dw in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * dw
            v[k] = 0.999 * v[k] + 0.001 * dw * dw
            w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores on rows not fitted on.

    For a threshold t, q_U(t) >= prior * q_P(t), with equality where no negative
    scores above t; so the smallest ratio of upper tails bounds the prior from
    above. It is read where its bound with three standard errors is least, which is
    not where the ratio is low by chance.
    """
    grid = np.quantile(positive, np.linspace(0.0, 0.95, 60))
    qp = np.array([(positive >= t).mean() for t in grid])
    qu = np.array([(unlabelled >= t).mean() for t in grid])
    ratio = qu / np.maximum(qp, 1e-9)
    upper = (qu + 3 * np.sqrt(qu * (1 - qu) / len(unlabelled) + ratio**2 * qp * (1 - qp) / len(positive))) / np.maximum(qp, 1e-9)
    return float(np.clip(ratio[int(np.argmin(upper))], *PRIORS))


def fit(p: np.ndarray, u: np.ndarray, seed: int = 7) -> Net:
    """Estimate the class prior on held-back halves, then minimise the non-negative PU risk.

    Without positives or without unlabelled text there is nothing to learn from: every score is one half.
    """
    if not len(p) or not len(u):
        z = np.zeros
        return Net(z(WIDTH), np.ones(WIDTH), z((WIDTH, 1), np.float32), z(1, np.float32), z(1, np.float32), z(1, np.float32), 0.5)
    order = np.lexsort(p.T[::-1])
    p = p[order]
    u = u[np.lexsort(u.T[::-1])]
    first = _fit(p[::2], u[::2], None, 400, seed)
    prior = estimate_prior(first.logit(p[1::2] if len(p) > 1 else p), first.logit(u[1::2] if len(u) > 1 else u))
    aside = np.arange(len(p)) % 5 == 0 if len(p) >= 5 else np.zeros(len(p), bool)
    net = _fit(p[~aside], u, prior, 5000, seed)
    # trusted positives that were set aside are let through: where hardly a negative is left, the risk alone would cut into their like
    low = float(np.quantile(net.logit(p[aside] if aside.any() else p), SPARED))
    net.b2 = net.b2 + np.float32(max(0.0, np.log(PREDICT_AT / (1 - PREDICT_AT)) + 1e-3 - low))
    net.prior = prior
    return net


def _held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def sample(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most ``rows`` trusted positives and ``rows`` unlabelled texts, on the driver.

    Both samples are the ids with the smallest hashes outside the held-out fold.
    """
    positive = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().where(~_held_out(F.col("doc_id")))
    positive = positive.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.lit(1).alias("p"))
    web = documents.where("doc_id is not null").select("doc_id").where(~_held_out(F.col("doc_id")))
    web = web.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(rows).select("doc_id", F.lit(1).alias("u"))
    ids = positive.join(web.distinct(), "doc_id", "full")
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                x = features(c.text_column(part, "text")).astype(np.float32)
                yield pa.record_batch({"p": part.column("p"), "u": part.column("u"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = chosen.mapInArrow(run, "p int, u int, x binary").collect()
    take = lambda k: np.frombuffer(b"".join(bytes(r.x) for r in got if r[k]), np.float32).reshape(-1, WIDTH)
    return take("p"), take("u")


def fit_classifier(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Net:
    """A net fitted on at most ``rows`` trusted positives and ``rows`` unlabelled texts, neither from the held-out fold.

    Labels of documents that are not there, null labels and repeated labels do no harm; without positives every score is one half.
    """
    return fit(*sample(documents, labels, rows))


def classify(documents: DataFrame, net: Net, at: float = PREDICT_AT) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted, from its whole text (null: empty).

    Every row gives a row, repeated ones too, each scored on its own; a null doc_id
    is not held out. An empty or very long text is scored like any other. A score of
    exactly ``at`` predicts 1. An empty table gives no row; other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                s = net.score(features(c.text_column(part, "text")))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": s, "predicted": (s >= at).astype(np.int32)})

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(documents: DataFrame, net: Net, at: float = PREDICT_AT) -> DataFrame:
    """The rows predicted to be of good quality, with all their columns (needs ``text``).

    A null text counts as empty; a score of exactly ``at`` is kept; repeated rows are
    judged alike; rows without a doc_id are judged by their text. An empty table
    gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.tidy(batches):
            for part in c.slices(batch):
                yield part.filter(pa.array(net.score(features(c.text_column(part, "text"))) >= at))

    return documents.mapInArrow(run, documents.schema)
