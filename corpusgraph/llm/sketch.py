"""Document frequencies of hashed features over the whole corpus, in bounded memory.

A count-min sketch: ``ROWS`` rows of ``WIDTH`` counters; a feature's estimate is its smallest
counter and never too small. With about 600 features a document, an estimate exceeds the truth by
about 0.05 % of the documents, whatever the size of the corpus, so relative frequencies above
``RARE`` are close to exact at every size and everything rarer counts as equally rare.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, ROWS, SLICES = 1 << 20, 2, 64
#: Documents' share below which features are equally rare.
RARE = 1e-3

_SCHEMA = pa.schema([("slice", pa.int32()), ("docs", pa.int64()), ("counts", pa.binary())])


def places(keys: np.ndarray) -> list[np.ndarray]:
    """Counter of each 50-bit feature in each row."""
    return [(keys & np.uint64(WIDTH - 1)).astype(np.int64), ((keys >> np.uint64(24)) & np.uint64(WIDTH - 1)).astype(np.int64)]


def _packed(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64
    return bytes([kind(0).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), {1: np.uint8, 2: np.uint16, 8: np.int64}[packed[0]]).astype(np.int64)


def _rows(total: np.ndarray, docs: int):
    parts = total.reshape(ROWS, SLICES, -1).transpose(1, 0, 2).reshape(SLICES, -1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([docs] + [0] * (SLICES - 1), pa.int64()),
                                       pa.array([_packed(x) for x in parts], pa.binary())], schema=_SCHEMA)


def document_counts(docs: DataFrame, features) -> tuple[int, np.ndarray]:
    """(documents, counters of shape (ROWS, WIDTH)) for ``features``: Arrow batch -> arrays of the
    distinct features of each document, one after the other. The counters have a fixed size, also at the driver."""
    def count(batches):
        total, seen = np.zeros((ROWS, WIDTH), np.int64), 0
        held, size = [], 0

        def add():
            keys = np.concatenate(held)
            for row, at in enumerate(places(keys)):
                total[row] += np.bincount(at, minlength=WIDTH)
        for batch in batches:
            seen += batch.num_rows
            for keys in features(batch):
                held.append(keys)
                size += len(keys)
                if size > 2 * WIDTH:
                    add()
                    held, size = [], 0
        if held:
            add()
        if seen:
            yield _rows(total, seen)

    def merge(batches):
        sums, docs = {}, {}
        for batch in batches:
            for at, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                sums[at] = sums.get(at, 0) + _unpacked(packed)
                docs[at] = docs.get(at, 0) + n
        for at, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([docs[at]], pa.int64()), pa.array([_packed(counts)], pa.binary())], schema=_SCHEMA)

    kind = "slice int, docs long, counts binary"
    got = docs.mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(merge, kind).collect()
    total = np.zeros((SLICES, ROWS, WIDTH // SLICES), np.int64)
    for row in got:
        total[row["slice"]] = _unpacked(bytes(row["counts"])).reshape(ROWS, -1)
    return sum(r["docs"] for r in got), total.transpose(1, 0, 2).reshape(ROWS, WIDTH)


def idf(keys: np.ndarray, docs: int, counts: np.ndarray) -> np.ndarray:
    """1 (in every document) to 2 (in no more than ``RARE`` of them), logarithmic between."""
    a, b = places(keys)
    share = np.minimum(counts[0].take(a), counts[1].take(b)) / max(docs, 1)
    return 1 + np.clip(np.log(np.maximum(share, 1e-300)) / np.log(RARE), 0, 1)
