"""Folds and bounded samples of labelled documents, models of bounded size, and scores by them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import small


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an id that is null falls into no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, size: int, seed: int = 1) -> DataFrame:
    """(text, label, place) of at most ``size`` labelled documents, chosen by a hash of their id.

    The ids are chosen on the narrow label table first; ``size`` bounds what is broadcast.
    Labels other than 0 and 1 are ignored; ids without a document give no row.
    """
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
              .select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("place"))
              .orderBy("place", "doc_id", "label").limit(size))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "place")


def fitted(rows: DataFrame, fit) -> list[np.ndarray]:
    """Arrays that ``fit`` (texts, labels) learns in one task from a bounded sample.

    Rows come in the order of their hash, so a run that is repeated learns the same.
    """
    def learn(batches):
        got = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(got) if got else None
        texts = table.column("text").combine_chunks() if got else pa.array([], pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        labels = table.column("label").to_numpy() if got else np.zeros(0, np.int64)
        for n, x in enumerate(fit(texts, labels)):
            x = np.asarray(x, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([x.tobytes()], pa.binary())], names=["n", "values"])
    got = rows.repartition(1).sortWithinPartitions("place", "label", "text").select("text", "label").mapInArrow(learn, "n long, values binary").collect()
    if not got:  # no labelled rows, no task
        return [np.asarray(x, np.float32) for x in fit(pa.array([], pa.string()), np.zeros(0, np.int64))]
    return [np.frombuffer(bytes(r["values"]), np.float32) for r in sorted(got, key=lambda r: r["n"])]


def shielded(docs: DataFrame, needed: list[str]):
    """``docs`` with only ``needed`` columns under their own names, and a function that selects all columns
    and gives their names back: extra columns never clash with an operator's own."""
    names = [c if c in needed else f"_x{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def scored(docs: DataFrame, model, score) -> DataFrame:
    """``docs`` (any columns with ``text``) plus ``score`` double: ``score`` (Arrow strings, model) -> array."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in docs.columns if c != "score"], F.lit(0.0).alias("score"))

    def run(batches):
        for part in small(batches, limit=1 << 18):
            got = score(part.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.float64())], names=part.schema.names)
    return kept.mapInArrow(run, kept.schema)
