"""Key relations: shuffled primary keys, uniform and Zipf foreign keys.

Rows come from spark.range and expressions of the row number and a seed alone, so a
relation is the same whatever the number of partitions, and any part can be made again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.position import running_total

#: Draws are made of so many random bits, and weights are cut to integers of at most 2**WEIGHT_BITS. As long as the
#: weights' sum is below 2**DRAW_BITS, which it is up to 2**DRAW_BITS / 2**WEIGHT_BITS ranks for any exponent and up to
#: 2**48 ranks for exponents of 1 and more, every rank can be drawn.
DRAW_BITS = 60
WEIGHT_BITS = 40
#: A rank that covers more buckets than this is listed by several tasks.
BUCKETS_A_TASK = 65_536


@dataclass(frozen=True)
class RelationConfig:
    rows: int
    seed: int
    skew: float = 0.0
    role: str = "R"


def payload(key: Column) -> Column:
    """Never 0, so that a checksum shows wrong matches."""
    return key * 3 + 1


def primary_keys(spark: SparkSession, rows: int, seed: int = 12_345, ordered: bool = False) -> DataFrame:
    """key 1 to rows, each once, and payload. ordered: rows come in an order shuffled by the seed."""
    keys = spark.range(1, rows + 1).select(F.col("id").alias("key"), payload(F.col("id")).alias("payload"))
    return keys.orderBy(F.xxhash64("key", F.lit(seed)), "key") if ordered else keys


def uniform_foreign_keys(spark: SparkSession, rows: int, primary: int, seed: int = 54_321, ordered: bool = False) -> DataFrame:
    """rows // primary rounds of the keys 1 to primary, and then the keys 1 to rows % primary."""
    if primary < 1:
        raise ValueError("there are no primary keys to refer to")
    keys = spark.range(rows).select((F.col("id") % primary + 1).alias("key"), "id")
    keys = keys.orderBy(F.xxhash64("id", F.lit(seed)), "id") if ordered else keys
    return keys.select("key", payload(F.col("key")).alias("payload"))


def zipf_weight(rank: Column, skew: float) -> Column:
    """An integer in proportion to 1 / rank ** skew, at least 1, so that engines agree on its sums."""
    power = rank if skew == 1 else F.pow(rank.cast("double"), F.lit(float(skew)))
    return F.greatest(F.lit(1), F.floor(F.lit(float(1 << WEIGHT_BITS)) / power)).cast("long")


def zipf_cdf(spark: SparkSession, ranks: int, skew: float) -> DataFrame:
    """rank, weight, cdf: running sum of the weights."""
    rows = spark.range(1, ranks + 1).select(F.col("id").alias("rank"), zipf_weight(F.col("id"), skew).alias("weight"))
    return running_total(rows, "rank", "weight", "cdf")


def hash_draw(row: Column, seed: int) -> Column:
    """DRAW_BITS random bits of a row number and a seed."""
    text = F.concat_ws(":", row.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def inverse_cdf(draws: DataFrame, cdf: DataFrame, total: int, ranks: int) -> DataFrame:
    """Adds to draws (column draw, 0 to total - 1) the smallest rank whose cdf is over it.

    The range of draws is cut into about as many equal buckets as there are ranks. A rank is
    listed in each bucket that it covers (ranks + buckets rows at most), and a draw meets the
    few ranks of its own bucket by an equi-join.
    """
    width = max(1, total // max(1, ranks))
    low = F.col("cdf") - F.col("weight")
    ranks_in = cdf.select("rank", low.alias("low"), F.col("cdf").alias("high"), F.floor(low / width).alias("b0"), F.floor((F.col("cdf") - 1) / width).alias("b1"))
    wide = F.col("b1") - F.col("b0") >= BUCKETS_A_TASK
    # The few ranks that cover many buckets: their stretches of buckets are dealt out before they are listed.
    starts = ranks_in.where(wide).withColumn("b0", F.explode(F.sequence("b0", "b1", F.lit(BUCKETS_A_TASK))))
    stretches = starts.withColumn("b1", F.least("b1", F.col("b0") + BUCKETS_A_TASK - 1)).repartition("rank", "b0")
    listed = ranks_in.where(~wide).unionByName(stretches).withColumn("bucket", F.explode(F.sequence("b0", "b1"))).drop("b0", "b1")
    keyed = draws.withColumn("bucket", F.floor(F.col("draw") / width))
    return keyed.join(listed, "bucket").where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high"))).drop("bucket", "low", "high")


def rank_to_key(rank: Column, primary: int, seed: int) -> Column:
    """A permutation of 1 to primary, so that frequent keys are not the small ones."""
    step = max(1, int(primary * 0.618) + seed % 97) % primary or 1
    while math.gcd(step, primary) != 1:
        step += 1
    return ((rank - 1) * step + seed) % primary + 1


def zipf_ranks(spark: SparkSession, rows: int, primary: int, skew: float, seed: int = 54_321) -> DataFrame:
    """id, rank of each drawn row."""
    cdf = zipf_cdf(spark, primary, skew)
    total = cdf.agg(F.sum("weight")).first()[0]
    # The product has up to 37 digits.
    scaled = F.call_function("div", hash_draw(F.col("id"), seed).cast("decimal(19,0)") * F.lit(total).cast("decimal(18,0)"), F.lit(1 << DRAW_BITS).cast("decimal(19,0)"))
    return inverse_cdf(spark.range(rows).withColumn("draw", scaled), cdf, total, primary).select("id", "rank")


def zipf_foreign_keys(spark: SparkSession, rows: int, primary: int, skew: float, seed: int = 54_321) -> DataFrame:
    key = rank_to_key(F.col("rank"), primary, seed)
    return zipf_ranks(spark, rows, primary, skew, seed).select(key.alias("key")).select("key", payload(F.col("key")).alias("payload"))


def foreign_keys(spark: SparkSession, config: RelationConfig, primary: int) -> DataFrame:
    """Zipf keys for a skew over 0, else uniform ones."""
    if config.skew > 0:
        return zipf_foreign_keys(spark, config.rows, primary, config.skew, config.seed)
    return uniform_foreign_keys(spark, config.rows, primary, config.seed)
