"""Mixing by iterative proportional fitting: token weights raked to source, language and topic marginals.

Tokens are summed in cells (source, language, topic); each round scales the cells of every value of one
dimension to that value's target, dimension by dimension. A cell cannot give more tokens than it has, so
its amount is capped there and the others make up for it. A cell's probability is fitted / present tokens,
and a document is kept if a uniform number hashed from its id is below that.

Values outside the targets fall together as ``OTHER``, so the number of cells is bounded by the parameters.
Unless the targets name it, ``OTHER`` aims at its share of the corpus and the named values share the rest.
"""

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import small, strings, words

OTHER = "other"
ROUNDS = 50
TOPICS = 4
#: Words with fewer letters do not make a topic.
TOPIC_LETTERS = 6


def described(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, lang, text, ...) -> doc_id, source, lang, tokens, topic; one row for each row."""
    return labelled(docs.select("doc_id", "source", "lang", "text")).drop("text")


def labelled(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus tokens (words of the text) and the topic of its dominant term; columns of
    these names are replaced.

    The term is the most frequent word of ``TOPIC_LETTERS`` bytes or more, the alphabetically first of ties;
    its md5 modulo ``TOPICS`` names the topic, so the label needs no model and no second pass. Texts without
    such a word have the topic ``OTHER``.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("tokens", "topic")], F.lit(0).cast("long").alias("tokens"), F.lit("").alias("topic"))

    def run(batches):
        for part in small(batches):
            w = words(strings(part.column("text")))
            long_ = np.flatnonzero(w.end - w.start >= TOPIC_LETTERS)
            of = w.text[long_]
            order = np.lexsort((w.hash[long_], of))
            of, h, at = of[order], w.hash[long_][order], long_[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])])) if len(of) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(of)))
            most = np.zeros(part.num_rows, np.int64)
            np.maximum.at(most, of[first], times)
            terms: dict[int, bytes] = {}
            for k in np.flatnonzero(times == most[of[first]]):
                text, word = int(of[first[k]]), w.data[w.start[at[first[k]]]:w.end[at[first[k]]]].tobytes()
                terms[text] = min(terms.get(text, word), word)
            topics = [f"topic{int(hashlib.md5(terms[k]).hexdigest()[:8], 16) % TOPICS}" if k in terms else OTHER for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(w.count, pa.int64()), pa.array(topics, pa.string())], names=part.schema.names)
    return kept.mapInArrow(run, kept.schema)


def uniform(doc_id: str, seed: int = 1) -> Column:
    """A number in [0, 1) from the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16 ** 12)


def _value(dimension: str, targets: dict) -> Column:
    return F.when(F.col(dimension).isin(list(targets)), F.col(dimension)).otherwise(F.lit(OTHER))


def rake(present: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = ROUNDS) -> np.ndarray:
    """Fitted tokens of an array of cells, one axis per dimension; ``targets`` are shares along each axis.

    Shares of values without any tokens go to the others in proportion; an axis where no value with tokens has a
    share is left as it is. No cell exceeds what is present.
    """
    x = present.astype(float) * (budget / max(present.sum(), 1))
    for _ in range(rounds):
        for axis, share in enumerate(targets):
            rest = tuple(a for a in range(x.ndim) if a != axis)
            there = present.sum(rest) > 0
            goal = np.where(there, share, 0)
            if not goal.sum() > 0:
                continue
            goal = goal / goal.sum() * budget
            now = x.sum(rest)
            factor = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            shape = [1] * x.ndim
            shape[axis] = -1
            x = np.minimum(x * factor.reshape(shape), present)
    return x


def shares(named: dict[str, float], values: list[str], tokens: np.ndarray) -> np.ndarray:
    """Target share of each of ``values``, which hold ``tokens``; an ``OTHER`` that is not named keeps its share of the tokens."""
    out = np.array([named.get(v, 0.0) for v in values])
    if OTHER not in named and tokens.sum() > 0:
        own = tokens[values.index(OTHER)] / tokens.sum()
        out = out / max(out.sum(), 1e-300) * (1 - own)
        out[values.index(OTHER)] = own
    return out


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]], keep: float) -> DataFrame:
    """One row for each cell: its value in each dimension (prefixed ``_``) and ``probability``."""
    dims = list(targets)
    values = [[*targets[d], *([] if OTHER in targets[d] else [OTHER])] for d in dims]
    cells = rows.groupBy(*[_value(d, targets[d]).alias(d) for d in dims]).agg(F.sum("tokens").alias("tokens"))
    present = np.zeros([len(v) for v in values])
    for r in cells.collect():  # at most the product of the targets' lengths
        present[tuple(v.index(r[d]) for d, v in zip(dims, values))] = r["tokens"] or 0
    along = [present.sum(tuple(a for a in range(present.ndim) if a != axis)) for axis in range(present.ndim)]
    fitted = rake(present, [shares(targets[d], v, n) for d, v, n in zip(dims, values, along)], keep * present.sum())
    share = np.divide(fitted, present, out=np.full_like(fitted, keep), where=present > 0)
    out = [(*names, float(share[at])) for names, at in zip(itertools.product(*values), np.ndindex(*share.shape))]
    return rows.sparkSession.createDataFrame(out, ", ".join(f"_{d} string" for d in dims) + ", probability double")


def mixed(docs: DataFrame, rows: DataFrame, targets: dict[str, dict[str, float]], keep: float, seed: int = 1) -> DataFrame:
    """``rows`` (``described`` or ``labelled``) plus weight, probability and kept; ``docs`` gives the token counts.

    ``targets``: dimension -> value -> share of the kept tokens, ``OTHER`` for values not named (if absent, their
    share of all tokens, and the named values share the rest);
    ``keep``: the share of all tokens that the sample is to have. weight = probability / ``keep``. Nulls count
    as ``OTHER``; documents without tokens take the probability of their cell (``keep`` in a cell without tokens).
    Equal ids are kept or left together. An empty table gives no rows.
    """
    cells = F.broadcast(probabilities(described(docs), targets, keep))
    keys = [f"_{d}" for d in targets]
    out = rows.drop("probability").withColumns({k: _value(d, targets[d]) for k, d in zip(keys, targets)}).join(cells, keys).drop(*keys)
    return out.withColumns({"weight": F.col("probability") / keep, "kept": uniform("doc_id", seed) < F.col("probability")})
