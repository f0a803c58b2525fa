"""Importance resampling to a target distribution: documents drawn by how much likelier their hashed word runs are in the target.

The hash of a feature is the CRC-32 of its UTF-8 bytes. A batch's distinct features are grouped by length into matrices of
bytes; the CRCs of all rows of a matrix advance together, one column at a time, and are scattered back to the features.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusgraph.functions.ordered import numbered
from corpusgraph.functions.tables import written

from .plainwords import PlainWords, plain_words
from .text import small

BUCKETS, RUN, LEAST, SALT = 10_000, 2, 20, 7
#: Bytes of texts worked on at once, and bytes of one matrix.
_TEXT, _MATRIX = 2 << 20, 4 << 20


def _crc_table() -> np.ndarray:
    """CRC-32 of each single byte, from the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice ``data[start:start + size]``; slices may overlap, size 0 gives 0."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, begins = np.unique(size[order], return_index=True)
    for length, a, b in zip(lengths.tolist(), begins, np.append(begins[1:], len(order))):
        rows = max(1, _MATRIX // max(1, length))
        for at in range(a, b, rows):
            which = order[at:min(b, at + rows)]
            crc = np.full(len(which), 0xFFFFFFFF, np.uint32)
            # very long slices: some columns at a time, so that the matrix keeps its size
            for left in range(0, length, _MATRIX):
                columns = np.arange(left, min(length, left + _MATRIX))
                matrix = data[(start[which][:, None] + columns).T] if len(which) > 1 else data[start[which] + columns][:, None]
                for column in matrix:
                    crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
            out[which] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _first_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Index of the first entry with each code."""
    out = np.empty(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out


def features(w: PlainWords, run: int = RUN):
    """Per run length from 1: (word that begins each feature, its code, CRC-32 by code). Equal bytes have one code."""
    text, code, n = w.text, None, len(w.start) - 1
    for k in range(1, run + 1):
        begin = np.arange(max(0, n - k + 1))
        begin = begin[text[begin] == text[begin + k - 1]]
        if k == 1:
            # words with the space after them lie end to end
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(w.start.astype(np.int64)), pa.py_buffer(w.data)])
            got = pc.dictionary_encode(whole)
            word = got.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            code = word
        else:
            # a run is a shorter run, by its code, and one word more
            got = pc.dictionary_encode(pa.array((code[np.searchsorted(last, begin)] << 32) | word[begin + k - 1]))
            code = got.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = begin[_first_places(code, len(got.dictionary))]
        yield begin, code, crcs(w.data, w.start[place], w.start[place + k] - 1 - w.start[place])
        last = begin


def counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features of all ``texts`` (text, ...) per bucket. A task sends one row per bucket, whatever it read."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for part in small(batches, limit=_TEXT, rows=1 << 16):
            for _, code, crc in features(plain_words(part.column("text")), run):
                total += np.bincount(crc[code] % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])
    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in target and source, in thousandths, rounded down."""
    n = len(source)
    up = (target + 1.0) * (float(source.sum()) + n)
    down = (source + 1.0) * (float(target.sum()) + n)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_words, n_features, weight: the mean gain of a document's features, rounded down."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def weigh(batches):
        for part in small(batches, limit=_TEXT, rows=1 << 16):
            w = plain_words(part.column("text"))
            total, n = np.zeros(len(w.count), np.int64), np.zeros(len(w.count), np.int64)
            for begin, code, crc in features(w, run):
                sums = np.append(0, np.cumsum(shared.value[crc % len(shared.value)][code]))
                at = np.searchsorted(begin, w.first)
                total += sums[at[1:]] - sums[at[:-1]]
                n += np.diff(at)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.count), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = LEAST, salt: int = SALT,
          buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least`` words, like the texts of ``target`` (text, ...).

    One row per row of ``docs`` (doc_id, text, ...): doc_id, n_words, n_features, weight, score, rank (from 1 in the order of
    the draw; null: not drawn). ``score`` is the weight plus noise from a hash of the id, so that the highest scores are a
    sample without replacement. Null and empty texts have no features and weight 0; a null id hashes as an empty one and
    ranks before the others of its score; rows that repeat an id share its noise and are drawn each by itself. An empty
    target weighs by rarity alone; no documents give no rows. Texts of any length are counted whole. Other columns of
    either table are ignored.
    """
    gain = gains(counts(docs, buckets, run), counts(target, buckets, run))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = written(weighted(docs, gain, run).withColumn("score", F.col("weight") + noise), "resampling")
    able = F.col("n_words") >= least
    quota = scored.where(able).count() * percent // 100
    # not able, not drawn: only able documents are sorted and numbered, without a one-task group
    ranked = numbered(scored.where(able), [], [F.desc("score"), F.col("doc_id"), F.col("n_features")], "rank")
    return (ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
            .unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))))
