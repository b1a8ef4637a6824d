"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A text is cut into windows of a few words. A window's gain is how many bytes shorter it
compresses with the toxic dictionary than with the ordinary one; before it stands a fixed carrier
that both hold, so that even short windows are compressed rather than stored.

The toxic dictionary starts as one that zstandard trains on windows of toxic text, most of which are
ordinary. So its words are tried again one by one: each is put before the ordinary dictionary, and
the windows of labelled text that then compress to fewer bytes are counted. Words that shorten
far more windows of toxic text than of ordinary text, by the likelihood ratio, stay, each cut to the
beginning that does so best. The ordinary dictionary is trained on windows of ordinary text, less
those that these words shorten, and the toxic one goes on with it, so that what toxic texts share
with others costs the same in both.

A logistic calibration of the gains' distribution over a text's windows, fitted on rows that the
dictionaries did not see, gives the score; its threshold, of the best F1 there, lies at 0.7.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common, labelled

THRESHOLD = 0.7
#: Bytes of the ordinary dictionary, and of the toxic one before its words are tried.
ORDINARY, TOXIC = 16384, 8192
#: Words of a window in a score, and of one in which words of the toxic dictionary are tried.
WINDOW, TRIED = 4, 2
#: Bytes of the carrier before a window.
CARRIER = 32
#: Bytes of a word of the toxic dictionary: it is tried from the first number on, cut to the second.
SHORTEST, LONGEST_WORD = 5, 12
#: A word stays if its likelihood ratio (2 log L) and its share of toxic over its share of ordinary
#: windows are no less, and if it shortens windows of so many toxic texts.
LEAST_RATIO, LEAST_SHARE, LEAST_TEXTS = 20, 8, 3
#: Words that are tried together before their windows are tried with each of them.
FAN = 16
#: Length of the pieces that zstandard puts together to a dictionary, and of the sequences it counts.
TOXIC_PIECES, ORDINARY_PIECES, COUNTED = 16, 64, 6
#: Of the bounded sample of rows: windows that a dictionary is trained on, and windows of either
#: kind of text that words are tried in, at most.
TRAINED_ON, TRIED_ON = 60_000, 100_000
#: Parts of the sample; each is calibrated on with dictionaries of the others.
FOLDS = 3
#: Bound of the labelled rows fitted on, per label.
SAMPLE = {0: 2500, 1: 1500}
_LEVELS = (1, 2, 3, 4, 5)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    shift: float


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The words in lower case, ``size`` at a time, with a space on either side."""
    words = text.encode().lower().split()
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(0, len(words), size)]


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple:
    params = zstandard.ZstdCompressionParameters.from_level(
        9, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, window_log=17
    )
    return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress for x in (ordinary, toxic))


def gains(text: str, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, per window; [0] without words."""
    a, b = _compressors(ordinary, toxic)
    carrier = ordinary[-CARRIER:]
    return np.array([len(a(w)) - len(b(w)) for w in (carrier + x for x in windows(text))] or [0])


def _trained(samples: list[bytes], size: int, piece: int) -> bytes:
    """Content of a dictionary trained on ``samples``; their joined bytes where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=piece, d=COUNTED).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _lengths(among: list[bytes], ordinary: bytes) -> np.ndarray:
    """Compressed lengths of the windows with the ordinary dictionary."""
    plain, carrier = _compressors(ordinary, b"")[0], ordinary[-CARRIER:]
    return np.array([len(plain(carrier + w)) for w in among], np.int64)


def _shortened(words: list[bytes], among: list[bytes], lengths: np.ndarray, ordinary: bytes, which: np.ndarray | None = None) -> dict[bytes, np.ndarray]:
    """For each word, the places in ``among`` of windows that it saves bytes of. What a group of
    words saves nothing of is not tried with its members."""
    which = np.arange(len(among)) if which is None else which
    more, carrier = _compressors(ordinary, b"".join(words) + ordinary)[1], ordinary[-CARRIER:]
    which = which[np.array([len(more(carrier + among[k])) for k in which], np.int64) < lengths[which]]
    if len(words) == 1 or not len(which):
        return dict.fromkeys(words, which)
    size = -(-len(words) // FAN)
    found = {}
    for k in range(0, len(words), size):
        found |= _shortened(words[k : k + size], among, lengths, ordinary, which)
    return found


def _best(shortened: dict[bytes, np.ndarray], of_text: np.ndarray, total: tuple[int, int]) -> list[bytes]:
    """Words by falling likelihood ratio, each over the windows that no word before it shortens.
    ``of_text`` numbers a window's toxic text, -1 for ordinary ones; ``total`` counts the windows
    of toxic and of ordinary text."""
    words = sorted(shortened)
    any_of = np.unique(np.concatenate(list(shortened.values())))
    of_text = of_text[any_of]
    hits = np.zeros((len(words), len(of_text)), bool)
    for k, w in enumerate(words):
        hits[k, np.searchsorted(any_of, shortened[w])] = True
    left, toxic, kept = np.ones(len(of_text), bool), of_text >= 0, []
    share = total[0] / max(1, sum(total))
    while words:
        n1, n0 = hits[:, left & toxic].sum(1), hits[:, left & ~toxic].sum(1)
        mean1, mean0 = np.maximum((n1 + n0) * share, 1e-9), np.maximum((n1 + n0) * (1 - share), 1e-9)
        ratio = 2 * (n1 * np.log(np.maximum(n1, 1) / mean1) + n0 * np.log(np.maximum(n0, 1) / mean0))
        ratio[n1 * total[1] < LEAST_SHARE * (n0 + 1) * total[0]] = 0
        for k in np.argsort(-ratio, kind="stable"):
            if ratio[k] < LEAST_RATIO or len(set(of_text[hits[k] & left & toxic])) >= LEAST_TEXTS:
                break
        if ratio[k] < LEAST_RATIO:
            break
        kept.append(words[k])
        left &= ~hits[k]
    return kept


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary; the latter ends in the former."""
    toxic, ordinary, order = sorted(set(toxic)), sorted(set(ordinary)), random.Random(0)

    def dealt(texts: list[str], size: int) -> list[tuple[bytes, int]]:
        found = [(w, k) for k, t in enumerate(texts) for w in windows(t, size)]
        order.shuffle(found)
        return found

    short = [dealt(texts, TRIED)[:TRIED_ON] for texts in (toxic, ordinary)]
    among, of_text = [w for part in short for w, _ in part], np.array([k for _, k in short[0]] + [-1] * len(short[1]), np.int64)
    total = len(short[0]), len(short[1])
    first = _trained([w for w, _ in short[1]][:TRAINED_ON], ORDINARY, ORDINARY_PIECES)
    start = _trained([w for w, _ in short[0]][:TRAINED_ON], TOXIC, TOXIC_PIECES)
    words = sorted({w[:LONGEST_WORD] for w in re.findall(rb" ?[^ \x00-\x1f]+", start) if len(w) >= SHORTEST})
    if words:
        lengths = _lengths(among, first)
        found = _shortened(words, among, lengths, first)
        words = _best(found, of_text, total)
        which = np.unique(np.concatenate([found[w] for w in words] or [np.zeros(0, np.int64)]))
    if words:
        words = sorted({w[:n] for w in words for n in range(SHORTEST, len(w) + 1)})
        words = _best(_shortened(words, among, lengths, first, which), of_text, total)
    usual = [w for w, _ in dealt(ordinary, WINDOW)][:TRAINED_ON]
    if words:
        joined = b"".join(words)
        held = set(_shortened([joined], usual, _lengths(usual, first), first)[joined].tolist())
        usual = [w for k, w in enumerate(usual) if k not in held]
    of_ordinary = _trained(usual, ORDINARY, ORDINARY_PIECES)
    # the likeliest words last, next to the text
    return of_ordinary, b"".join(reversed(words)) + of_ordinary


def _features(gain: np.ndarray) -> np.ndarray:
    over = np.array([(gain >= q).sum() for q in _LEVELS])
    return np.concatenate([np.log1p(over), over / len(gain), [np.log(len(gain)), gain.max(), gain.mean(), (gain < 0).mean()]])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2e-2) -> tuple:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    weight = weight / weight.mean()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * len(y) * np.eye(len(w))
        w = w - np.linalg.solve(hessian, a.T @ (weight * (p - y)) + ridge * len(y) * w)
    return mean, scale, w


def best_cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: float = 1.0) -> float:
    """Logit halfway between the neighbours where predicting from there on has the best weighted F-beta."""
    order = np.argsort(-logit, kind="stable")
    hit, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f = (1 + beta**2) * hit / (taken + beta**2 * (weight * y).sum())
    k = int(np.argmax(f))
    below = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 1
    return float((logit[order[k]] + below) / 2)


def fit(sample: labelled.Sample) -> Model | None:
    """None where one of the labels is missing. The rows are dealt by a hash of their text, so
    that their order is of no account: dictionaries of all parts but one give the gains of
    that one for the calibration and its threshold; then all rows make the dictionaries."""
    if len(set(sample.y)) < 2:
        return None
    rows = sorted(zip(sample.texts, sample.y), key=lambda r: (zlib.crc32(r[0].encode()), r))
    of = lambda part, y: [t for t, label in part if label == y]
    made = lambda part: dictionaries(of(part, 1), of(part, 0))
    parts = [[(t, y) for y in (0, 1) for t in of(rows, y)[k::FOLDS]] for k in range(FOLDS)]
    others = [[r for j, part in enumerate(parts) if j != k for r in part] for k in range(FOLDS)]
    if any(len({y for _, y in part}) < 2 for part in others):
        others = [rows] * FOLDS
    seen = [(_features(gains(t, *pair)), label) for pair, part in zip(map(made, others), parts) for t, label in part]
    x, y = np.array([f for f, _ in seen]), np.array([float(label) for _, label in seen])
    weight = np.array([sample.weight[int(v)] for v in y])
    mean, scale, w = _logistic(x, y, weight)
    cut = best_cut(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, y, weight)
    ordinary, toxic = made(rows)
    return Model(ordinary, toxic, tuple(mean), tuple(scale), tuple(w), float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut))


def score_text(text: str, model: Model) -> float:
    x = (_features(gains(text, model.ordinary, model.toxic)) - np.array(model.mean)) / np.array(model.scale)
    logit = float(x @ np.array(model.weights[:-1])) + model.weights[-1] + model.shift
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = common.RESULT) -> DataFrame:
    """Adds double ``out``, 0 to 1. Null and empty texts score as one window without gain;
    without a model (no labels of one kind) every score is 0. Equal texts score alike, repeated
    rows stay, an empty table stays empty, and a long text is cut into windows like any other.
    Other columns pass unchanged, unless one is called ``out``."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array((score_text(t, model) for t in common.texts(column)), pa.float64())

    return docs.withColumn(out, scored(F.col(text)))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model | None:
    """Fits on a bounded sample (:data:`SAMPLE`) of rows whose remainder is not the held-out one."""
    return fit(labelled.sample(docs, labels, "toxic", 3, 1, SAMPLE, text=text, doc_id=doc_id))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score under the threshold, columns as they were."""
    return score(docs, learn(docs, labels)).where(F.col(common.RESULT) < THRESHOLD).drop(common.RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the score of every document."""
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, learn(docs, common.labels(spark, sf_dir)))
    return scored.select(
        "doc_id", (labelled.remainder("doc_id", 3) == 1).alias("held_out"), F.col(common.RESULT).alias("score"), (F.col(common.RESULT) >= THRESHOLD).cast("int").alias("predicted")
    )
