"""Global row numbers and even splits, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Used only by local masters whose session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, else the one that setCheckpointDir() was given.

    Where there is neither, a local master gets FALLBACK_DIR; a cluster is refused, since no
    machine's own folder is right there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which keeps rows in their partitions when tasks run again."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def with_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Adds each row's number, from 0, in the given order.

    Rows are range-sorted; a row's number is its number within its partition plus the rows
    of the partitions before. One count a partition is all that is summed in one place.
    """
    cells = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__cell", F.monotonically_increasing_id()))
    part = F.shiftright("__cell", 33)
    counts = cells.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    # One row a partition.
    placed = cells.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__cell").bitwiseAND(F.lit((1 << 33) - 1))).drop("__cell", "__part", "__before")


def even_part(pos: Column, rows: Column | int, parts: Column | int) -> Column:
    """The part of a row when `rows` are cut into near-equal parts and the first rows % parts get one more."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    parts = F.lit(parts) if isinstance(parts, int) else parts
    small = F.floor(rows / parts)
    larger = rows % parts
    edge = larger * (small + 1)
    return F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(larger + F.floor((pos - edge) / F.greatest(small, F.lit(1)))).cast("long")


def running_total(df: DataFrame, rank: str, value: str, name: str, cell: int = 65_536) -> DataFrame:
    """Adds the inclusive running sum of value by a dense rank from 1: sums within cells of ranks, and over the cells' totals."""
    cells = df.withColumn("__cell", F.floor((F.col(rank) - 1) / cell))
    totals = cells.groupBy("__cell").agg(F.sum(value).alias("__t"))
    before = totals.select("__cell", F.coalesce(F.sum("__t").over(W.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(W.partitionBy("__cell").orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn("__inside", inside).join(before, "__cell").withColumn(name, F.col("__before") + F.col("__inside")).drop("__cell", "__inside", "__before")
