"""Skew of a foreign-key relation, seen by its partitions in a sample: the first block of every worker's slice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.position import even_part
from ..functions.radix import low_radix
from .layout import BLOCK_ROWS, histogram

#: The two largest of over 4 partitions are skewed with more than this share of a sample, in percent.
TOP_TWO_PERCENT = 35
#: Up to 4 partitions: the largest must be over half the sample by so many rows.
HALF_MARGIN = 10


def first_blocks(s: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, worker): the first block of each partition of S, which are its workers' slices. What follows isn't read."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, left = TaskContext.get().partitionId(), block_rows
        for b in batches:
            part = b.slice(0, left)
            yield part.append_column("worker", pa.array([worker] * part.num_rows, pa.int64()))
            left -= part.num_rows
            if not left:
                return

    return s.select(F.col("key").cast("long").alias("key")).mapInArrow(head, "key long, worker long")


def blocks_by_position(s: DataFrame, pos: str, rows: int, workers: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, worker): the first block of each of the equal slices of S that `workers` have by a gapless position from 0."""
    small, larger = divmod(rows, workers)
    worker = even_part(F.col(pos), rows, workers)
    start = worker * small + F.least(worker, F.lit(larger))
    return s.withColumn("worker", worker).where(F.col(pos) - start < block_rows).select("key", "worker")


def sampled(sample: DataFrame, radix: int) -> bool:
    """Whether every worker's block is skewed over 2**radix partitions."""
    return unanimous(top_two(sample, low_radix(F.col("key"), radix)), 1 << radix).first()["skewed"]


def top_two(sample: DataFrame, part: Column) -> DataFrame:
    """(worker, first, second, rows): each worker's two largest partition counts in its sample."""
    counts = histogram(sample, part, "worker")
    order = W.partitionBy("worker").orderBy(F.desc("n"), "h")
    ranked = counts.withColumn("r", F.row_number().over(order))
    return ranked.groupBy("worker").agg(F.max(F.when(F.col("r") == 1, F.col("n"))).alias("first"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("second"), F.sum("n").alias("rows"))


def is_skewed(fanout: int) -> Column:
    """Over a row of top_two."""
    if fanout > 4:
        return F.col("first") + F.col("second") > F.floor(F.col("rows") * TOP_TWO_PERCENT / 100)
    return F.col("first") > F.floor(F.col("rows") / 2) + HALF_MARGIN


def unanimous(votes: DataFrame, fanout: int) -> DataFrame:
    """(workers, skewed): skewed if every worker's sample is; false without a worker."""
    return votes.agg(F.count(F.lit(1)).alias("workers"), F.coalesce(F.every(is_skewed(fanout)), F.lit(False)).alias("skewed"))
