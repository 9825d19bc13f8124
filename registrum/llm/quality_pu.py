"""Quality from trusted positives and unlabelled web text: non-negative PU learning.

Texts labelled good, and a sample of all texts whatever their label, are used to fit. With class prior
``p`` the risk of calling an unlabelled text bad is known without bad examples:
``p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])``, where l is the sigmoid
loss and f linear in standardised features. The inner difference estimates the risk on
bad texts, which can't be below zero; where a batch makes it negative, its gradient is
reversed, so that the model unlearns what it fitted too closely.

The class prior is the share of good texts among the labelled training rows (the labels
are a sample of the web text). What is fitted on the driver is a sample of at most about
``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, drawn by a hash of the id; all counts are
over all rows, and every text is scored in one pass without a shuffle.

The weight decay is the one of least risk in cross-validation over the same rows; rows held out by the caller have no part in it.

Defined cases: a null text counts as empty; empty texts get a score like others. Very long texts are scored whole, in slices of
few. Equal texts get equal scores. An empty table gives no rows. Without
positives or unlabelled rows every score is the prior (0.5 without labels). Several
labels of one id each count as a row. Columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import slices, texts_of
from registrum.llm.quality_rules import MEASURES, measures

MAX_POSITIVE, MAX_UNLABELLED = 20_000, 40_000
BUCKETS = 128
SEED = 7
STEPS, BATCH, RATE = 600, 2048, 0.02
#: Weight decays to choose from, divided by the number of unlabelled rows; parts of the rows that take turns in judging them, and steps of such a fit.
DECAYS, FOLDS, TRIAL_STEPS = (1.0, 3.0, 10.0, 30.0), 2, 200


def features(text: str) -> np.ndarray:
    """Rates of what is counted in the text, and the shares of hashed byte pairs."""
    m = dict(zip(MEASURES, measures(text), strict=True))
    raw = text.encode("utf-8", "surrogatepass")
    words, letters = max(m["n_words"], 1), max(m["n_upper"] + m["n_lower"], 1)
    rate = lambda n, of: min(n / of, 3.0) ** 0.5
    dense = [
        np.log1p(m["n_words"]),
        min(m["word_chars"] / words, 30.0),
        rate(m["n_symbols"], words),
        rate(m["n_dup_lines"], max(m["n_lines"], 1)),
        rate(m["n_repeat_words"], words),
        rate(m["n_echo_words"], words),
        rate(m["n_upper"], letters),
        rate(raw.count(b"!") + raw.count(b"?"), words),
        rate(sum(map(raw.count, b"0123456789")), words),
        rate(len(raw) - len(text), max(len(text), 1)),
    ]
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    pairs = np.bincount((b[:-1] * 37 + b[1:] * 101 >> 2) % BUCKETS, minlength=BUCKETS) if len(b) > 1 else np.zeros(BUCKETS)
    return np.concatenate([dense, np.sqrt(pairs / max(len(b) - 1, 1))])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    spread: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The non-negative unbiased risk."""
    pos, unl = model.score(positive), model.score(unlabelled)
    return float(model.prior * (1 - pos).mean() + max(0.0, unl.mean() - model.prior * pos.mean()))


def chosen_decay(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The decay of least risk on rows that a fit has not seen. Only rows that the model may learn from take part."""
    if min(len(positive), len(unlabelled)) < 2 * FOLDS:
        return DECAYS[-1]
    found = []
    for decay in DECAYS:
        total = 0.0
        for fold in range(FOLDS):
            (pos, pos_out), (unl, unl_out) = ((x[np.arange(len(x)) % FOLDS != fold], x[np.arange(len(x)) % FOLDS == fold]) for x in (positive, unlabelled))
            total += risk(fit(pos, unl, prior, decay, TRIAL_STEPS), pos_out, unl_out)
        found.append((total, -decay))
    return -min(found)[1]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = DECAYS[-1], steps: int = STEPS) -> Model:
    """Minimise the non-negative unbiased risk by Adam over batches."""
    width = positive.shape[1] if len(positive) else len(features(""))
    if not len(positive) or not len(unlabelled) or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(width), float(np.log(p / (1 - p))), np.zeros(width), np.ones(width), prior)
    mean, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    pos, unl = (np.hstack([np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    rng = np.random.default_rng(SEED)
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        u, p = (x[rng.integers(0, len(x), min(BATCH, len(x)))] for x in (unl, pos))
        su, sp = sigmoid(u @ w), sigmoid(p @ w)  # the loss of calling it bad; 1 - s that of calling it good
        du, dp = (u * (su * (1 - su))[:, None]).mean(0), (p * (sp * (1 - sp))[:, None]).mean(0)
        bad = su.mean() - prior * sp.mean()
        gradient = -prior * dp + (du - prior * dp) if bad >= 0 else prior * dp - du
        gradient[:-1] += decay / len(unl) * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(w[:-1], float(w[-1]), mean, spread, prior)


def featured(docs: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            x = [features(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], ["x"])

    return docs.select("text").mapInArrow(run, "x array<double>")


def sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` of the rows, all if there are fewer, by a hash of ``doc_id``."""
    n = rows.count()
    share = min(1.0, most / n) if n else 1.0
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, label (1 good, 0 not, else ignored)."""
    texts = docs.select("doc_id", "text")
    marks = labels.where("label IN (0, 1)").select("doc_id", "label")
    good, n = marks.agg(F.sum("label"), F.count("label")).first()
    prior = good / n if n else 0.5
    chosen = sampled(marks.where("label = 1").select("doc_id"), MAX_POSITIVE, SEED)
    # About MAX_POSITIVE ids, however many labels there are: small enough to broadcast.
    positive = _matrix(featured(texts.join(F.broadcast(chosen), "doc_id")))
    unlabelled = _matrix(featured(sampled(texts, MAX_UNLABELLED, SEED + 1)))
    return fit(positive, unlabelled, prior, chosen_decay(positive, unlabelled, prior))


def _matrix(df: DataFrame) -> np.ndarray:
    rows = df.toArrow().column("x").to_pylist()
    return np.array(rows, float) if rows else np.zeros((0, len(features(""))))


def scored(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """``keep`` and score of every document."""
    frame = docs.select(*keep, F.col("text").alias("_text"))
    kept = frame.columns[:-1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "_text"):
            x = np.array([features(t) for t in texts_of(batch.column("_text"))]).reshape(batch.num_rows, -1)
            s = model.score(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(s)], [*kept, "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{types}, score double")
