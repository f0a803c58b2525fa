"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, components.

Each table cuts space by ``bits`` random hyperplanes; vectors with equal signs meet in a bucket, and
buckets are compared in full in blocks (``blocks.tiled``), one matrix product each, in double precision.
A pair that several tables show is counted by the first one only, so blocks emit counts and spanning
stars, never pairs. The number of bits grows with the logarithm of the number of vectors, the number of
tables so that a pair at exactly the threshold is missed with probability ``MISS`` at most.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusgraph.functions.tables import written

from .blocks import groups, stars, tiled
from .components import components

THRESHOLD, MISS = 0.9, 1e-3
#: Vectors a bucket holds on average if they were spread evenly.
BUCKET = 128


def tables(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for a number of vectors."""
    bits = max(4, math.ceil(math.log2(max(vectors, 1) / BUCKET + 1)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def _planes(bits: int, count: int, width: int) -> np.ndarray:
    return np.random.default_rng([bits, count, width]).standard_normal((width, bits * count))


def _signed(rows: DataFrame, bits: int, count: int) -> DataFrame:
    """(node, vec, codes): the valid vectors as bytes of doubles of length one, and a code for each table."""
    schema = pa.schema([("vector", rows_type := pa.list_(pa.float64())), ("vec", pa.binary()), ("codes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            whole, vecs, codes = batch.column(0), [], []
            for v in whole.to_pylist():
                x = np.array([np.nan if y is None else y for y in v], np.float64) if v else np.zeros(0)
                size = np.abs(x).max(initial=0)
                ok = bool(size > 0) and bool(np.isfinite(x).all())
                x = x / size if ok else x
                vecs.append((x / np.linalg.norm(x)) if ok else None)
            for x in vecs:
                if x is None:
                    codes.append(None)
                    continue
                signs = (x @ _cached(bits, count, len(x)) > 0).reshape(count, bits)
                codes.append((signs @ (1 << np.arange(bits))).tolist())
            yield pa.RecordBatch.from_arrays([whole.cast(rows_type), pa.array([None if x is None else x.tobytes() for x in vecs], pa.binary()), pa.array(codes, pa.list_(pa.int64()))], schema=schema)
    return rows.mapInArrow(run, "vector array<double>, vec binary, codes array<long>")


_KEPT = {}


def _cached(bits, count, width):
    if (bits, count, width) not in _KEPT:
        _KEPT[bits, count, width] = _planes(bits, count, width)
    return _KEPT[bits, count, width]


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept; one row per vec_id.

    Vectors link where their cosine is ``threshold`` or more; null, empty, zero vectors, and those with null
    or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors are
    compared once and counted as often as they occur. Rows that repeat an id count once, with their
    smallest vector. component_id is the smallest vec_id that links reach, kept marks it.
    """
    ids = written(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
                  .groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    bits, count = tables(ids.count(), threshold)
    same = ids.where("vector is not null and vec_id is not null").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    same = written(same, "same")
    codes = _signed(same.select("vector"), bits, count).where("codes is not null")
    nodes = written(same.join(codes, "vector").select("node", "copies", "vec", "codes"), "signed")

    entries = nodes.select("node", "copies", "vec", "codes", F.posexplode("codes").alias("t", "code"))
    entries = entries.select("node", "copies", "vec", "codes", F.struct("t", "code", F.length("vec").alias("w")).alias("b")).select(
        "node", "copies", "vec", "codes", F.col("b.t").alias("table"), F.xxhash64("b").alias("bucket"))
    sizes = written(nodes.select(F.posexplode("codes").alias("t", "code"), F.length("vec").alias("w"))
                    .groupBy(F.xxhash64(F.struct("t", "code", "w")).alias("bucket")).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    found = written(_compared(tiled(entries, sizes, "bucket", "node"), threshold), "links")

    reach = components(found.where("root is not null").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    valid = nodes.select("node", "copies").join(links, "node", "left").join(reach, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    members = ids.join(same.select("vector", "node"), "vector", "left").select("vec_id", "node")
    out = members.join(valid, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): links of each node that its block is the first to show, and star edges."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    keys = ["bucket", "lo", "hi"]

    def block(node, copies, vec, codes, table, tiles, across):
        near = vec @ vec.T >= threshold
        np.fill_diagonal(near, False)
        if across:
            near &= tiles[:, None] != tiles[None, :]
        for t in range(table):
            if not near.any():
                return
            near &= codes[:, t, None] != codes[None, :, t]
        for i in np.flatnonzero(near.any(1)):
            yield node[i], int(copies[near[i]].sum()), None
        for j, i in stars(near):
            yield node[j], 0, node[i]

    def run(batches):
        for table, cuts in groups(batches, keys):
            n = table.num_rows
            node, copies, of, tiles, lo, hi = (table.column(c).to_numpy() for c in ("node", "copies", "table", "tile", "lo", "hi"))
            vec, codes = table.column("vec").to_pylist(), np.array(table.column("codes").to_pylist())
            out = [r for a, b in zip(cuts, cuts[1:]) if b - a > 1 and n
                   for r in block(node[a:b], copies[a:b], np.stack([np.frombuffer(x) for x in vec[a:b]]), codes[a:b], of[a], tiles[a:b], lo[a] != hi[a])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=schema)
    cols = [*keys, "tile", "table", "node", "copies", "vec", "codes"]
    return rows.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "node long, links long, root long")
