"""Memory of the toxicity model's one task."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corpusgraph.llm import toxicity


def test_embedding_table_is_drawn_in_parts():
    """While the model is fitted, little is held beside its table (32 MB); the table's doubles (64 MB) never are."""
    texts = pa.array([f"word{i % 7} other{i % 3} text{i}" for i in range(200)])
    labels = (np.arange(200) % 7 == 0).astype(np.int64)
    tracemalloc.start()
    row, bias = toxicity._fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20
    drawn = np.random.default_rng(5).uniform(-1 / toxicity.DIM, 1 / toxicity.DIM, (1 << toxicity.BITS, toxicity.DIM)).astype(np.float32)
    parts = np.random.default_rng(5)
    again = np.concatenate([parts.uniform(-1 / toxicity.DIM, 1 / toxicity.DIM, (toxicity.ROWS, toxicity.DIM)).astype(np.float32) for _ in range((1 << toxicity.BITS) // toxicity.ROWS)])
    assert (drawn == again).all() and row.any()
