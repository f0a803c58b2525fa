"""Groups of sorted Arrow batches, and links within one block."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Rows of a bucket that meet in one block, about; larger buckets become pairs of tiles.
TILE = 256


def tiled(rows: DataFrame, sizes: DataFrame, bucket: str, member: str) -> DataFrame:
    """``rows`` x the tile pairs they belong to: columns ``tile``, ``lo``, ``hi`` are added.

    ``sizes``: (bucket, n). A bucket of n rows has n / TILE tiles by a hash of the member; a row
    meets each tile of its bucket once, so any two rows of a bucket share exactly one (lo, hi).
    """
    tiles = sizes.select(bucket, F.ceil(F.col("n") / TILE).cast("int").alias("_g"))
    return (rows.join(tiles, bucket).withColumn("tile", F.pmod(F.xxhash64(member), F.col("_g")).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
            .withColumn("lo", F.least("tile", "_o")).withColumn("hi", F.greatest("tile", "_o")).drop("_g", "_o"))


def groups(batches, keys: list[str]):
    """Sorted Arrow batches -> (batch of whole groups, cut positions): groups are never split."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cuts = _cuts(table, keys)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
        held = table.slice(cuts[-2])
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        a, b = table.column(k).slice(1), table.column(k).slice(0, table.num_rows - 1)
        new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy()
    return np.append(np.flatnonzero(new), table.num_rows)


def stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """Symmetric boolean matrix -> (row, first row of its component) for all rows but the first ones."""
    out, free = [], linked.any(1)
    for i in range(len(linked)):
        if not free[i]:
            continue
        free[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & free)
            free[front] = False
            out += [(int(j), i) for j in front]
    return out
