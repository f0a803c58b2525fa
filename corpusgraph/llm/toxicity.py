"""Toxicity classifier: subword embeddings averaged into a linear softmax, trained jointly.

Each word gives its character n-grams (3 to 6, with marks at both ends) and itself; each is hashed to
a row of an embedding table. A text is the mean of its distinct rows, two linear outputs and a softmax judge it.
Embeddings and outputs are learnt together, so a misspelling that was never seen shares most n-gram
vectors with what it misspells. As everything behind the mean is linear, a trained model is one number
a row: the row's embedding times the difference of the outputs. Nothing but the text is an input.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled
from .text import U64, mix, strings

BITS, DIM = 20, 8
SIZES = (3, 4, 5, 6)
#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 8_000
EPOCHS, BATCH, RATE = 2, 32, 0.1
#: Texts whose subwords are held at once while the model is fitted.
PART = 64
#: Rows of the table that are drawn at once; it has a multiple of them.
ROWS = 1 << 14
#: Fixed factor of the mean: a toxic text may hold one toxic word in fifty.
SCALE = 50
#: Rows of features in fewer sample texts stay zero; a floor keeps rarely updated rows from large steps.
SEEN, DAMP = 5, 1e-7
CUT = 0.5
_STEP = U64(0xD6E8FEB86659FD93)
_SEPARATES = np.ones(128, bool)
_SEPARATES[[c for c in b"0123456789abcdefghijklmnopqrstuvwxyz"]] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all texts, one text after the other, and the number of each text's."""
    whole = strings(texts).to_pylist()
    lengths = np.array([len(x) + 1 for x in whole])
    code = np.frombuffer(("\n" + "\n".join(whole) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if whole else np.zeros(1, np.uint32)
    separates = _SEPARATES.take(code, mode="clip") & (code < 128)
    symbol = np.where(separates, U64(1), code.astype(U64) + U64(2))
    blocked = np.concatenate([[0], np.cumsum(separates)])
    at, found = [], []
    h = symbol.copy()
    for n in range(2, max(SIZES) + 1):
        if len(symbol) < n:
            break
        h = h[:len(symbol) - n + 1] * _STEP + symbol[n - 1:]
        if n in SIZES:
            inner = blocked[n - 1:len(blocked) - 1] - blocked[1:len(blocked) - n + 1]
            i = np.flatnonzero(inner == 0)
            at.append(i)
            found.append(mix(h[i]))
    starts = np.flatnonzero(~separates & np.concatenate([[True], separates[:-1]]))
    if len(starts):
        ends = np.flatnonzero(~separates & np.concatenate([separates[1:], [True]])) + 1
        place = np.arange(len(symbol)) - np.repeat(starts, np.diff(np.append(starts, len(symbol))))[np.maximum(np.arange(len(symbol)) - starts[0], 0)]
        spread = mix(symbol * _STEP + place.astype(U64))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(spread)])
        at.append(starts)
        found.append(mix(sums[ends] - sums[starts]))
    at, found = np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, U64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    of = np.clip(np.searchsorted(begins, at, side="right") - 1, 0, max(len(whole) - 1, 0))
    order = np.argsort(of, kind="stable")
    return (found[order] >> U64(64 - BITS)).astype(np.int64), np.bincount(of, minlength=len(whole)) if whole else np.zeros(0, np.int64)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts, one text after the other, and the number of each text's."""
    index, count = features(texts)
    keys = np.repeat(np.arange(len(count)) << BITS, count) | index
    keys.sort()
    keys = keys[np.diff(keys, prepend=-1) != 0]
    return keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=len(count))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins of texts that were held back (Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(max(a, 1e-3)), float(b)


def fit(texts: pa.Array, labels: np.ndarray):
    """A number for each embedding row, and the bias; every fifth text is held back to calibrate the
    curve of the scores. Without labels all scores are 0.5."""
    back = np.arange(len(labels)) % 5 == 4
    row, bias = _fit(texts.filter(pa.array(~back)), labels[~back])
    if back.any():
        held = texts.filter(pa.array(back))
        margins = np.concatenate([_margins(held.slice(begin, PART), [row, bias]) for begin in range(0, len(held), PART)])
        a, b = _calibrated(margins, labels[back])
        row, bias = row * a, [bias[0] * a + b]
    return [row, bias]


def _fit(texts: pa.Array, labels: np.ndarray):
    parts = []
    for begin in range(0, len(texts), PART):
        index, count = bags(texts.slice(begin, PART))
        parts += np.split(index.astype(np.int32), np.cumsum(count)[:-1])
    seen = np.zeros(1 << BITS, np.int32)
    for rows in parts:
        seen[rows] += 1
    known = seen >= SEEN
    sizes = np.array([max(len(rows), 1) for rows in parts])
    for n, rows in enumerate(parts):  # in place: what is not known is freed before the table is made
        parts[n] = rows[known[rows]]
    rng = np.random.default_rng(5)
    table = np.empty((1 << BITS, DIM), np.float32)
    for begin in range(0, len(table), ROWS):  # drawn as doubles, so a part at a time
        table[begin:begin + ROWS] = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM))
    table[~known] = 0
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    table_sq, out_sq, bias_sq = np.full(1 << BITS, DAMP, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for begin in range(0, len(parts), BATCH):
            part, y, size = parts[begin:begin + BATCH], labels[begin:begin + BATCH], sizes[begin:begin + BATCH]
            # the batch's rows once each, and a small dense matrix of shares
            rows, place = np.unique(np.concatenate(part), return_inverse=True)
            shares = np.zeros((len(part), len(rows)), np.float32)
            of = np.repeat(np.arange(len(part)), [len(x) for x in part])
            shares[of, place] = np.float32(SCALE) / size[of]
            old = table[rows]
            mean = shares @ old
            logits = mean @ out + bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            error = (e / e.sum(1, keepdims=True) - np.eye(2, dtype=np.float32)[y]) / np.float32(len(y))
            back = shares.T @ (error @ out.T)
            g = mean.T @ error
            out_sq += g * g
            out -= rate * g / np.sqrt(out_sq)
            g = error.sum(0)
            bias_sq += g * g
            bias -= rate * g / np.sqrt(bias_sq)
            table_sq[rows] += (back * back).mean(1)
            table[rows] = old - rate * back / np.sqrt(table_sq[rows])[:, None]
    return [SCALE * (table @ (out[:, 1] - out[:, 0])), [bias[1] - bias[0]]]


def _margins(texts: pa.Array, model) -> np.ndarray:
    index, count = bags(texts)
    sums = np.concatenate([[0.0], np.cumsum(model[0].take(index), dtype=np.float64)])
    ends = np.cumsum(count)
    return (sums[ends] - sums[ends - count]) / np.maximum(count, 1) + float(model[1][0])


def score(texts: pa.Array, model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_margins(texts, model), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> list[np.ndarray]:
    """Model learnt from at most ``sample`` labelled documents (``labels``: doc_id, ``label`` 0 or 1)."""
    return labelled.fitted(labelled.sample(docs, labels, label, sample), fit)


def scored(docs: DataFrame, model) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, higher: more toxic). Null and empty texts get the score of
    no words (the bias); repeated rows get equal scores; a column named ``score`` is replaced."""
    return labelled.scored(docs, model, score)
