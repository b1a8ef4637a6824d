"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score is linear weights plus low-rank interactions of all pairs of features, summed in time
linear in the features by  sum_{i<j} <v_i,v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2.
Training runs AdaGrad on a bounded sample of labelled rows; a part of it that is not trained on
sets the scale of the score, whose threshold of the best F1 lies at 0.3.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common, labelled
from facejobs.llm.toxicity import best_cut

THRESHOLD = 0.3
BUCKETS, RANK = 1 << 14, 8
#: Bound of the labelled rows fitted on, per label.
SAMPLE = {0: 2400, 1: 3600}
STRUCTURE = (
    "words", "word_length", "distinct", "lines", "line_length", "repeated_lines", "capitals", "digits",
    "symbols", "bars", "marks", "repeats", "not_ascii",
)
_CACHE_MOST = 500_000
_buckets: dict[bytes, int] = {}


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    """Ratios and logarithms of a text's make-up, in the order of STRUCTURE; zeros if it is empty."""
    n, size = len(words) or 1, len(raw) or 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper, lower = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"abcdefghijklmnopqrstuvwxyz")
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(words)), size / n / 10, len(set(words)) / n, np.log1p(len(lines)), np.log1p(size / (len(lines) or 1)), 1 - len(set(lines)) / (len(lines) or 1),
        upper / (upper + lower or 1), count(b"0123456789") / size, count(b"#*$%&<>") / n, count(b"|") / n, count(b"!?") / n, repeats / n, count(bytes(range(128, 256))) / size,
    ]


def sparse(text: str, metadata: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a row: hashed words of unit length together, then dense features."""
    raw = text.encode()
    words = raw.split()
    common.trim(_buckets, _CACHE_MOST)
    bag: dict[int, int] = {}
    for w, k in Counter(words).items():
        if (b := _buckets.get(w)) is None:
            b = _buckets[w] = zlib.crc32(w) % BUCKETS
        bag[b] = bag.get(b, 0) + k
    index = np.fromiter(bag.keys(), np.int64, len(bag))
    value = np.log1p(np.fromiter(bag.values(), np.float64, len(bag)))
    dense = np.array(structure(raw, words) + metadata)
    norm = np.sqrt((value**2).sum()) or 1
    return np.concatenate([index, BUCKETS + np.arange(len(dense))]), np.concatenate([value / norm, dense])


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    shift: float

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        """Raw output of the machine for one row; linear in its number of features."""
        value = value.copy()
        d = len(self.mean)
        value[-d:] = np.clip((value[-d:] - self.mean) / self.scale, -5, 5)
        vx = self.factors[index] * value[:, None]
        total = vx.sum(0)
        return float(self.bias + self.linear[index] @ value + ((total**2).sum() - (vx**2).sum()) / 2)


def _train(rows: list, y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.05, ridge: float = 1e-4, batch: int = 64) -> tuple:
    d = len(rows[0][0]) - np.count_nonzero(rows[0][0] < BUCKETS)
    dense = np.array([v[-d:] for _, v in rows])
    mean, scale = dense.mean(0), dense.std(0) + 1e-6
    rows = [(i, np.concatenate([v[:-d], np.clip((v[-d:] - mean) / scale, -5, 5)])) for i, v in rows]
    rng = np.random.default_rng(0)
    bias, linear, factors = 0.0, np.zeros(BUCKETS + d), rng.normal(0, 0.01, (BUCKETS + d, RANK))
    g_linear, g_factors, g_bias = np.full(BUCKETS + d, 1e-6), np.full((BUCKETS + d, RANK), 1e-6), 1e-6
    weight = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = np.array([len(rows[k][0]) for k in chosen])
            index, value = (np.concatenate([rows[k][j] for k in chosen]) for j in (0, 1))
            starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(chosen)), sizes)
            vx = factors[index] * value[:, None]
            total = np.add.reduceat(vx, starts)
            out = bias + np.add.reduceat(linear[index] * value, starts) + ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts)) / 2
            slope = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[chosen]) * weight[chosen] / len(chosen)
            s = slope[owner]
            used, where = np.unique(index, return_inverse=True)
            by_linear = np.bincount(where, s * value, len(used)) + ridge * linear[used]
            by_factor = ridge * factors[used]
            np.add.at(by_factor, where, (s * value)[:, None] * (total[owner] - vx))
            g_linear[used] += by_linear**2
            g_factors[used] += by_factor**2
            g_bias += slope.sum() ** 2
            linear[used] -= rate * by_linear / np.sqrt(g_linear[used])
            factors[used] -= rate * by_factor / np.sqrt(g_factors[used])
            bias -= rate * slope.sum() / np.sqrt(g_bias)
    return bias, linear, factors, mean, scale


def fit(sample: labelled.Sample, metadata: list[list[float]] | None = None) -> Model | None:
    """None where one of the labels is missing. A fifth of the rows, not trained on, sets the scale."""
    if len(set(sample.y)) < 2:
        return None
    metadata = metadata or [[] for _ in sample.y]
    rows = [sparse(t, m) for t, m in zip(sample.texts, metadata)]
    y = np.array(sample.y, float)
    weight = np.array([sample.weight[int(v)] for v in y])
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = True
        fitted = np.arange(len(y))
    else:
        fitted = np.flatnonzero(~apart)
    parts = _train([rows[k] for k in fitted], y[fitted], weight[fitted])
    raw = Model(*parts, 1.0, 0.0)
    out = np.array([raw.logit(*rows[k]) for k in np.flatnonzero(apart)])
    spread = max(1.0, float(np.std(out)))
    cut = best_cut(out, y[apart], weight[apart])
    return Model(*parts, 2 / spread, float(np.log(THRESHOLD / (1 - THRESHOLD)) - 2 / spread * cut))


def _metadata(columns: list) -> list[list[float]]:
    return [[float(np.log1p(max(0, v or 0))) for v in row] for row in zip(*columns)] if columns else []


def score(docs: DataFrame, model: Model | None, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), out: str = common.RESULT) -> DataFrame:
    """Adds double ``out``, 0 to 1. Null text counts as empty and null metadata as 0; an empty text
    scores by its zero structure. Without a model (no labels of one kind) every score is 0. Equal
    rows score alike, repeated ones stay, an empty table stays empty, and a text of any length is
    one sparse vector. Other columns pass unchanged, unless one is called ``out``."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))

    @F.arrow_udf("double")
    def scored(column: pa.Array, *more: pa.Array) -> pa.Array:
        texts = common.texts(column)
        extra = _metadata([m.to_pylist() for m in more]) or [[] for _ in texts]
        logit = np.array([model.logit(*sparse(t, m)) for t, m in zip(texts, extra)], float)
        return pa.array(1 / (1 + np.exp(-np.clip(model.slope * logit + model.shift, -30, 30))), pa.float64())

    return docs.withColumn(out, scored(F.col(text), *(F.col(c).cast("double") for c in metadata)))


def learn(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), text: str = "text", doc_id: str = "doc_id") -> Model | None:
    """Fits on a bounded sample (:data:`SAMPLE`) of rows whose remainder is not the held-out one."""
    sample = labelled.sample(docs, labels, "quality", 5, 0, SAMPLE, metadata, text, doc_id)
    return fit(sample, _metadata(list(map(list, zip(*sample.more)))) or None)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the score of every document."""
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    scored = score(docs, learn(docs, common.labels(spark, sf_dir)))
    return scored.select(
        "doc_id", (labelled.remainder("doc_id", 5) == 0).alias("held_out"), F.col(common.RESULT).alias("score"), (F.col(common.RESULT) >= THRESHOLD).cast("int").alias("predicted")
    )
