"""Sharding: global byte-size prefix sums, cut at equal targets into contiguous shards.

Documents are put in one global order, by text hash and then id, so the order is well mixed
and equal texts stand together. Every partition of that order reports its totals and the
hash and start of its first and last group of equal texts: one small row a partition is
all that the driver gathers. Running sums over those rows give each partition its offset,
and a second pass adds it to the sizes within the partition. A group of equal texts goes to
the shard in which its middle byte falls, so copies stay together and a shard is off its
target by half a group at each end at most. A group over max_group of a shard's target is
cut at the targets like other rows: at 1, only groups that would overfill a shard by
themselves are.

Defined results: a null text has no bytes, so it weighs `overhead` alone, and groups with
empty texts; null ids come first within their group; repeated rows get a slot each. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.position import pinned
from .common import table

OVERHEAD = 16
MAX_GROUP = 1.0


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
    """A partition's rows, which are a few dozen bytes each, its hashes and sizes."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return None
    rows = pa.Table.from_batches(found)
    return rows, rows["text_hash"].to_numpy(), rows["size"].to_numpy()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a partition with rows: part, bytes, first and last hash, bytes of the first and of the last group."""
    if got := _arrays(batches):
        rows, h, size = got
        ends = {"first": int(h[0]), "last": int(h[-1]), "head": int(size[h == h[0]].sum()), "tail": int(size[h == h[-1]].sum())}
        yield pa.RecordBatch.from_pylist([{"part": rows["part"][0].as_py(), "bytes": int(size.sum()), **ends}], schema=pa.schema([("part", pa.int32()), *[(k, pa.int64()) for k in ("bytes", "first", "last", "head", "tail")]]))


def _offsets(totals: list) -> tuple[dict[int, tuple], int]:
    """By partition: its offset and the byte span of the groups that its first and last rows are in; and all bytes."""
    totals = sorted(totals, key=lambda r: r["part"])
    at, starts, spans = 0, {}, {}
    for r in totals:
        starts[r["part"]] = at
        for h, begin, n in ((r["first"], at, r["head"]), (r["last"], at + r["bytes"] - r["tail"], r["tail"])):
            low, high = spans.get(h, (begin, begin + n))
            spans[h] = (min(low, begin), max(high, begin + n))
        at += r["bytes"]
    return {r["part"]: (starts[r["part"]], spans[r["first"]], spans[r["last"]]) for r in totals}, at


def _place(h: np.ndarray, size: np.ndarray, offset: int, head: tuple[int, int], tail: tuple[int, int], target: float, shards: int, max_group: float) -> np.ndarray:
    """Shard of each row of one partition."""
    ends = offset + np.cumsum(size)
    begins = ends - size
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    last = np.concatenate((first[1:], [len(h)])) - 1
    low, high = begins[first], ends[last]
    low[0], high[0] = head
    low[-1], high[-1] = tail
    of = np.repeat(np.arange(len(first)), last - first + 1)
    whole = (high - low <= max_group * target)[of]
    middle = np.where(whole, (low + high)[of] / 2, (begins + ends) / 2)
    return np.minimum(shards - 1, middle // target).astype(np.int32)


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = OVERHEAD, max_group: float = MAX_GROUP) -> DataFrame:
    """doc_id, size long, text_crc32 long, shard int, slot long: every row once; slots count from 0 in each shard."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash"))
    # Rows without their texts. The checkpoint pins them to partitions, also for a task that runs again.
    ordered = rows.repartitionByRange("text_hash", "doc_id", "size").sortWithinPartitions("text_hash", "doc_id", "size")
    ordered = pinned(ordered.select("*", F.spark_partition_id().alias("part")))
    totals = ordered.select("text_hash", "size", "part").mapInArrow(_totals, "part int, bytes long, first long, last long, head long, tail long").collect()
    offsets, total = _offsets(totals)
    target = max(1.0, total / shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := _arrays(batches):
            table, h, size = got
            shard = _place(h, size, *offsets[table["part"][0].as_py()], target, shards, max_group)
            # Shards ascend within a partition, so the rank restarts where the shard changes.
            at = np.arange(len(shard))
            rank = at - np.maximum.accumulate(np.where(np.concatenate(([True], shard[1:] != shard[:-1])), at, 0))
            yield from table.drop_columns(["text_hash"]).append_column("shard", pa.array(shard)).append_column("rank", pa.array(rank.astype(np.int64))).to_batches()

    placed = ordered.mapInArrow(place, "doc_id long, size long, text_crc32 long, part int, shard int, rank long")
    # One row for each shard of each partition: shards are contiguous, so at most partitions + shards rows.
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(starts), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot"))


def op2_byte_shards(spark, sf_dir):
    rows = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
