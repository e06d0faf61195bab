"""Joins of a primary-key relation R with a foreign-key relation S, and their summary.

R has columns key and payload with unique keys; S has key. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.chooser import BROADCAST_LIMIT, DEFAULT_BUDGET, HEAP_A_BYTE, ROW_BYTES, Decision, choose, worth_sampling
from . import skew
from .layout import partition_by_key

#: Copies of a hot key's row of R; its rows of S are dealt over them.
SALTS = 32
#: A key is hot with over this share of S's rows: so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Part of S's rows in which hot keys are looked for, and the rows of a key that make it hot there at least.
HOT_SAMPLE, HOT_ROWS = 0.02, 8
#: Partitions, in bits, over which skew shows: as many as the join would have, and at least so many.
SKEW_RADIX = 3


def as_relation(df: DataFrame, key: str, payload: str | None = None) -> DataFrame:
    columns = [F.col(key).cast("long").alias("key")]
    return df.select(*columns, *([F.col(payload).cast("long").alias("payload")] if payload else []))


def broadcast_join(r: DataFrame, s: DataFrame) -> DataFrame:
    """Neither side is exchanged; R, whose size decide() has checked, goes to every executor."""
    return s.join(F.broadcast(r), "key")


def partitioned_join(r: DataFrame, s: DataFrame, radix: int) -> DataFrame:
    """Both sides are dealt alike by key; each partition builds R's table and probes it with S."""
    return partition_by_key(s, "key", radix).join(partition_by_key(r, "key", radix).hint("shuffle_hash"), "key")


def merge_join(r: DataFrame, s: DataFrame) -> DataFrame:
    return s.join(r.hint("merge"), "key")


def skew_join(r: DataFrame, s: DataFrame) -> DataFrame:
    """The exchanges are Spark's own, so adaptive execution can split S's large partitions and repeat R's for them."""
    return s.join(r.hint("shuffle_hash"), "key")


def salted_join(r: DataFrame, s: DataFrame, salts: int = SALTS, hot_share: float = HOT_SHARE) -> DataFrame:
    """Hot keys of S are dealt over salts; only their rows of R are repeated. Does not rely on adaptive execution.

    Which keys count as hot comes from a sample and changes the load of tasks, not the result.
    """
    counts = s.sample(HOT_SAMPLE, seed=1).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # Under 1 / hot_share rows, against one row.
    hot = counts.join(F.broadcast(total), F.col("n") > hot_share * F.col("total")).where((F.col("n") >= HOT_ROWS) & F.col("key").isNotNull()).select("key", F.lit(True).alias("hot"))
    mark = lambda df: df.join(F.broadcast(hot), "key", "left")
    dealt = mark(s).withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0))
    copies = mark(r).withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("hot").join(copies.drop("hot"), ["key", "salt"]).drop("salt")


def join(r: DataFrame, s: DataFrame, decision: Decision) -> DataFrame:
    if decision.strategy == "broadcast":
        return broadcast_join(r, s)
    if decision.strategy == "shuffle_hash":
        return partitioned_join(r, s, decision.radix) if decision.radix else skew_join(r, s)
    return {"merge": merge_join, "skew": skew_join, "salt": salted_join}[decision.strategy](r, s)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes of a primary side that the driver, which builds a broadcast, and the executors, which hold it, have the memory for."""
    sc = spark.sparkContext
    heap = sc._jvm.java.lang.Runtime.getRuntime().maxMemory()
    if not sc.master.startswith("local["):
        heap = min(heap, sc._jsc.sc().executorMemory() << 20)
    return min(BROADCAST_LIMIT, heap // HEAP_A_BYTE)


def decide(r: DataFrame, s: DataFrame, primary_rows: int, foreign_rows: int, budget: int = DEFAULT_BUDGET, strategy: str = "auto", radix: int | None = None, sample: DataFrame | None = None) -> Decision:
    """The strategy for a join, from sizes and, where it matters, from S's skew in a sample (key, worker).

    Skew matters if the join would be partitioned, its partitioning isn't given, and S is large
    against R. The sample is the first block of each partition of S unless one is given.

    A primary side that memory can't carry is not broadcast, not even on request: `auto` decides then.
    """
    limit = broadcast_limit(r.sparkSession)
    if strategy == "broadcast" and primary_rows * ROW_BYTES > limit:
        strategy = "auto"
    first = choose(primary_rows, foreign_rows, budget, False, strategy, limit=limit, radix=radix)
    if strategy != "auto" or radix is not None or first.radix == 0 or not worth_sampling(primary_rows, foreign_rows):
        return first
    found = skew.sampled(skew.first_blocks(s) if sample is None else sample, max(SKEW_RADIX, first.radix))
    return choose(primary_rows, foreign_rows, budget, found, strategy, limit=limit)


def checked(r: DataFrame) -> DataFrame:
    """r, if its keys are unique; else the input contract is broken and its duplicates are refused."""
    if not duplicate_keys(r).where("key is not null").isEmpty():
        raise ValueError("the primary-key relation has a key twice")
    return r


def summary(r: DataFrame, joined: DataFrame, verify: bool = False) -> DataFrame:
    """One row (matches, checksum): the matches, and all keys of R plus the payload (verify: the key) of each match.

    Two aggregates meet as two rows; sums are decimals, which don't overflow.
    """
    wide = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    matched = joined.agg(F.count(F.lit(1)).alias("matches"), wide("key" if verify else "payload").alias("checksum"))
    built = r.agg(F.lit(0).cast("long").alias("matches"), wide("key").alias("checksum"))
    return matched.unionByName(built).agg(F.sum("matches").alias("matches"), F.sum("checksum").cast("long").alias("checksum"))


def duplicate_keys(r: DataFrame) -> DataFrame:
    """Keys of R that are not unique: the input contract holds if there are none."""
    return r.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphan_keys(r: DataFrame, s: DataFrame) -> DataFrame:
    """Rows of S that match nothing."""
    return s.join(r.select("key"), "key", "left_anti")


def per_partition(joined: DataFrame, part) -> DataFrame:
    """(h, matches, checksum) for each radix partition of the key."""
    return joined.groupBy(part.alias("h")).agg(F.count(F.lit(1)).alias("matches"), F.sum("payload").alias("checksum"))
