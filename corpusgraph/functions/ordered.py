"""Order-dependent work over groups of any size.

A plain window over one hot key would put the whole key into one task. Here rows
are range-partitioned by (key, order) instead, so a hot key spreads over many
blocks; each block is worked on alone and only one row per (key, block) travels
between blocks.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .tables import written

BLOCK = "_block"


def into_blocks(df: DataFrame, by: list, order: list) -> DataFrame:
    """Range-partition by (by, order) and record the block number.

    The result is written: a block number comes from sampled range bounds and must
    not change when a lost task runs again.
    """
    ranged = df.repartitionByRange(*by, *order).withColumn(BLOCK, F.spark_partition_id())
    return written(ranged, "blocks")


def numbered(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """Row number (1-based) within ``by`` in ``order``, without a one-task group."""
    blocks = into_blocks(df, by, order)
    sizes = blocks.groupBy(*by, BLOCK).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, BLOCK).orderBy(*order)
    return (
        blocks.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*by, BLOCK])
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("bigint"))
        .drop(BLOCK, "_row", "_offset")
    )


def latest_before(df: DataFrame, by: list, order: list, value: str, name: str) -> DataFrame:
    """As-of fill: last non-null ``value`` at or before each row within ``by``."""
    blocks = into_blocks(df, by, order)
    key = F.struct(*[F.col(c) for c in order])
    tails = blocks.groupBy(*by, BLOCK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), key)).alias("_tail"))
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*by, BLOCK, F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.withColumn("_seen", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*by, BLOCK])
        .withColumn(name, F.coalesce("_seen", "_carried"))
        .drop(BLOCK, "_seen", "_carried")
    )


def first_rows(df: DataFrame, by: list, order: list, limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per group. The rank filter is applied before the exchange
    too (window group limit), so at most ``limit`` rows per group and task move."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)
