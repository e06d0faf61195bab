"""Partitioning and layout of a relation over workers, blocks and radix partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.position import even_part, with_position

#: Rows that a block holds at most.
BLOCK_ROWS = 32_758


def partition_by_key(df: DataFrame, key: str, radix: int) -> DataFrame:
    """Co-locates equal keys in 2**radix partitions; a join on the key needs no further exchange."""
    return df.repartition(1 << radix, key)


def histogram(df: DataFrame, part: Column, *by: str) -> DataFrame:
    """Rows of each partition, for each group of `by`: (*by, h, n)."""
    return df.groupBy(*by, part.alias("h")).agg(F.count(F.lit(1)).alias("n"))


def offsets(counts: DataFrame, *by: str) -> DataFrame:
    """Adds each partition's start: the rows of the partitions before, within the group. A group has one row a partition."""
    before = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before.orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def slices(df: DataFrame, order: str, workers: int) -> DataFrame:
    """Adds pos, worker, and pos_in, the row's number within its worker's contiguous slice."""
    rows = with_position(df, order)
    total = rows.count()
    placed = rows.withColumn("worker", even_part(F.col("pos"), total, workers))
    small, larger = divmod(total, workers)
    start = F.col("worker") * small + F.least(F.col("worker"), F.lit(larger))
    return placed.withColumn("slice_rows", F.lit(small) + (F.col("worker") < larger).cast("int")).withColumn("pos_in", F.col("pos") - start)


def blocks(sliced: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds block: each slice is cut into near-equal blocks of block_rows at most."""
    count = F.ceil(F.col("slice_rows") / block_rows)
    return sliced.withColumn("block", even_part(F.col("pos_in"), F.col("slice_rows"), count))


def stable_scatter(blocked: DataFrame, part: Column) -> DataFrame:
    """Adds h and target: the row's place in its block, by partition and then by its old place. A block is one bounded window."""
    order = W.partitionBy("worker", "block").orderBy("h", "pos")
    return blocked.withColumn("h", part).withColumn("target", F.row_number().over(order) - 1)


def sub_blocks(blocked: DataFrame, part: Column, fanout: int, groups: int) -> DataFrame:
    """(worker, block, sub_block, start, end): where the partitions of each group lie in each block.

    Each group takes fanout / groups consecutive partitions.
    """
    if fanout % groups:
        raise ValueError("the fanout must be a multiple of the groups")
    starts = histogram(blocked, part, "worker", "block").withColumn("sub_block", F.floor(F.col("h") / (fanout // groups)))
    counts = starts.groupBy("worker", "block", "sub_block").agg(F.sum("n").alias("n"))
    # A group whose partitions have no row is an empty stretch.
    all_groups = counts.select("worker", "block").distinct().withColumn("sub_block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    full = all_groups.join(counts, ["worker", "block", "sub_block"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    end = F.sum("n").over(W.partitionBy("worker", "block").orderBy("sub_block").rowsBetween(W.unboundedPreceding, 0))
    return full.withColumn("end", end).select("worker", "block", "sub_block", (F.col("end") - F.col("n")).alias("start"), "end")
