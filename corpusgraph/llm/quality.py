"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are runs of word characters and runs of punctuation, case kept, alone and in pairs; a token
that repeats its predecessor counts as the pair <again>. A feature seen c times in a text of n
features has the value c / sqrt(n). A score is the sparse dot product with the weights, through
the logistic function. Nothing but the text is an input.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from .text import U64, WORDS_AND_MARKS, gram_starts, grams, strings, words

BITS = 20
#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 6_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.001
CUT = 0.7
_AGAIN = U64(0xA6A1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, one text after the other, and the number of each text's."""
    w = words(strings(texts, lower=False), WORDS_AND_MARKS)
    pairs = grams(w.hash, 2)
    pairs[w.hash[:-1] == w.hash[1:]] = _AGAIN << U64(40)
    at = gram_starts(w, 2)
    all_ = np.concatenate([w.hash, pairs[at]])
    of = np.concatenate([w.text, w.text[at]])
    order = np.argsort(of, kind="stable")
    return (all_[order] >> U64(64 - BITS)).astype(np.int64), np.bincount(of, minlength=len(w.first) - 1)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: pa.Array, labels: np.ndarray):
    """Weights and bias. Without labels all scores are 0.5."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
    for _ in range(EPOCHS):
        for begin in range(0, len(texts), 256):
            index, count = features(texts.slice(begin, 256))
            ends = np.cumsum(count)
            for k, y in enumerate(labels[begin:begin + 256]):
                mine = index[ends[k] - count[k]:ends[k]]
                at, times = np.unique(mine, return_counts=True)
                at, x = np.append(at, bias), np.append(times / np.sqrt(max(count[k], 1)), 1.0)
                w = weights(at)
                g = (_logistic(w @ x) - y) * x
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
                n[at] += g * g
    return [weights(np.arange((1 << BITS) + 1))]


def score(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    index, count = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(model.take(index), dtype=np.float64)])
    ends = np.cumsum(count)
    return _logistic((sums[ends] - sums[ends - count]) / np.sqrt(np.maximum(count, 1)) + model[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled documents (``labels``: doc_id, ``label`` 0 or 1)."""
    return labelled.fitted(labelled.sample(docs, labels, label, sample), fit)[0]


def scored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, higher: better). Null and empty texts get the score of no
    features (the bias); repeated rows get equal scores; a column named ``score`` is replaced."""
    return labelled.scored(docs, model, score)
