"""Mixing sources to target weights by a Pfair schedule.

Main path: DataFrame functions only.

Source i with integer weight a_i of P = sum(a) gets block j (from 0) no earlier than slot
floor(j * P / a_i), its release, and before slot ceil((j + 1) * P / a_i), its deadline.
Earliest-deadline-first over the released blocks fills every slot of a period of P slots,
and at every slot each source has had less than one block more or less than its share. The
schedule repeats with the period, so one period is worked out once, from the weights alone,
and block j of source i stands at slot (j div a_i) * P + the slot of its block j mod a_i.

A source's documents are taken in the order of md5(doc_id, md5(text)); block j holds those
that start in its j-th block_bytes bytes. A very long document leaves the blocks that it spans
empty, so the balance is one of bytes. Where a source has run out, its slots fall away and the
others go on: no row is dropped or repeated. `balanced` marks slots before the first end
of a source, over which the less-than-one-block bound holds.

Defined results: a null source is a source of its own; a null text has no bytes (each
document counts at least 1); rows with the same id and text are ordered by file and row
number. Weights missing for a source are default_weight. Over MAX_SOURCES sources or
MAX_PERIOD slots a period are refused, as one period is worked out on the driver.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.position import running_total
from .common import dealt_in_order, materialise, null_safe, place, stored, table

#: Target weights of the query: the large source is held to a tenth, the others share the rest by quality tier.
TARGETS = {"src0": 10, **{f"src{k}": (6, 4, 5, 4)[k % 4] for k in range(1, 20)}}
DEFAULT_WEIGHT = 1
BLOCK_BYTES = 65_536
#: Rows that one (source, cell) window takes on average.
CELL_ROWS = 2_000
#: Slots of one window of the running count of rows.
CELL_SLOTS = 256
#: Hexadecimal digits of a cell: beyond a million cells they grow instead of their number, which one window takes for each source.
MAX_CELL_DIGITS = 5
#: Sources that may be mixed; their weights and one period of the schedule are all that reaches the driver.
MAX_SOURCES = 10_000
MAX_PERIOD = 1_000_000


def pfair_period(weights: list[int]) -> list[tuple[int, int, int]]:
    """(slot, source, block) of one period; source and block count from 0."""
    period = sum(weights)
    if period > MAX_PERIOD:
        raise ValueError(f"the weights add up to {period}; at most {MAX_PERIOD} slots are scheduled")
    waiting = [(0, -(-period // a), i, 0) for i, a in enumerate(weights)]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, deadline, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, j))
        deadline, i, j = heapq.heappop(ready)
        assert slot < deadline
        out.append((slot, i, j))
        if j + 1 < weights[i]:
            heapq.heappush(waiting, ((j + 1) * period // weights[i], -(-(j + 2) * period // weights[i]), i, j + 1))
    return out


def schedule(docs: DataFrame, targets: Mapping[str, int], default_weight: int = DEFAULT_WEIGHT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, source, size, block, slot, slot_rank, position long (from 0, gapless), balanced boolean, place.

    place is the row's file and number where docs are rows of files, else in a stored copy.
    """
    if default_weight < 1 or any(w < 1 for w in targets.values()):
        raise ValueError("weights are positive integers")
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.lit(1), F.octet_length(text)).cast("long")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    docs = stored(docs, "mix-input")
    small = materialise(docs.select("doc_id", "source", size.alias("size"), order.alias("ord"), place().alias("place")), "mix-rows")

    by_source = small.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [targets.get(r["source"], default_weight) for r in by_source]
    common = gcd(*weights) or 1
    weights = [w // common for w in weights]
    period = sum(weights)
    plan = pfair_period(weights)
    at = {(i, j): s for s, i, j in plan}
    # Slot after the last block of the source that ends first.
    last = [max(0, (r["bytes"] - 1) // block_bytes) for r in by_source]
    end = min((b // w * period + at[i, b % w] + 1 for i, (b, w) in enumerate(zip(last, weights))), default=0)
    literal = lambda rows, schema: docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
    sources = literal([{"source": r["source"], "number": i, "weight": w, "period": period} for i, (r, w) in enumerate(zip(by_source, weights))], "array<struct<source:string,number:int,weight:long,period:long>>")
    period_rows = literal([{"slot_in": s, "number": i, "block_in": j} for s, i, j in plan], "array<struct<slot_in:long,number:int,block_in:long>>")

    # Offsets by cells of the order, so that a source of any size is dealt over many tasks.
    cells = max(1, sum(r["n"] for r in by_source) // CELL_ROWS)
    digits = max(1, min(MAX_CELL_DIGITS, len(f"{cells - 1:x}")))
    small = small.withColumn("cell", F.substring("ord", 1, digits))
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = small.groupBy("source", "cell").agg(F.sum("size").alias("bytes")).select("source", "cell", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "cell").orderBy("ord", "place").rowsBetween(W.unboundedPreceding, -1)
    rows = null_safe(small.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))), starts, ["source", "cell"], "inner")
    rows = rows.select("doc_id", "source", "size", "place", (F.col("before") + F.col("inside")).alias("start"))
    rows = rows.withColumn("block", F.floor(F.col("start") / block_bytes))
    # Both tables have a fixed bound: MAX_SOURCES and MAX_PERIOD rows.
    rows = null_safe(rows, F.broadcast(sources), ["source"], "inner").withColumn("block_in", F.col("block") % F.col("weight"))
    rows = rows.join(F.broadcast(period_rows), ["number", "block_in"])
    rows = rows.withColumn("slot", F.floor(F.col("block") / F.col("weight")) * F.col("period") + F.col("slot_in"))
    # A slot is one block, so under block_bytes rows of one source; starts differ within it.
    rows = rows.withColumn("slot_rank", F.row_number().over(W.partitionBy("slot").orderBy("start")))
    filled = running_total(rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")), "slot", "n", "upto", CELL_SLOTS).select("slot", (F.col("upto") - F.col("n")).alias("ahead"))
    rows = rows.join(filled, "slot")
    return rows.select("doc_id", "source", "size", "block", "slot", "slot_rank", (F.col("ahead") + F.col("slot_rank") - 1).alias("position"), (F.col("slot") < end).alias("balanced"), "place")


def mix(docs: DataFrame, targets: Mapping[str, int] = TARGETS, default_weight: int = DEFAULT_WEIGHT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of docs with their columns, in the order of the schedule over partitions and files."""
    docs = stored(docs, "mix-docs")
    placed = materialise(schedule(docs, targets, default_weight, block_bytes).select(F.col("place").alias("__place"), F.col("position").alias("__position")), "mix-places")
    # The schedule has a row a document, so it is never small where that matters; small tables get the same plan.
    mixed = docs.withColumn("__place", place()).join(placed.hint("merge"), "__place")
    return dealt_in_order(mixed, "__position", placed.count()).select(*docs.columns)


def op6_pfair_mixing(spark, sf_dir):
    return schedule(table(spark, sf_dir, "documents"), TARGETS).drop("place")


def oracle() -> str:
    """The period's slots come from a recursive search of the SQL's own."""
    named = " ".join(f"WHEN '{s}' THEN {w}" for s, w in sorted(TARGETS.items()))
    return f"""
WITH RECURSIVE u AS (SELECT DISTINCT source, CAST(CASE source {named} ELSE {DEFAULT_WEIGHT} END AS BIGINT) AS raw FROM documents),
w AS (SELECT row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, source, raw // (SELECT list_reduce(list(raw), lambda x, y: gcd(x, y)) FROM u) AS a FROM u),
t AS (SELECT CAST(sum(a) AS BIGINT) AS total FROM w),
b AS (SELECT i, j, j * total // a AS release, ((j + 1) * total + a - 1) // a AS deadline FROM w, t, LATERAL (SELECT unnest(range(0, a)) AS j)),
bs AS (SELECT list({{'deadline': deadline, 'i': i, 'j': j, 'release': release}} ORDER BY deadline, i, j) AS all_b FROM b),
run(slot, pick, rest) AS (
  SELECT -1::BIGINT, NULL::STRUCT(deadline BIGINT, i BIGINT, j BIGINT, release BIGINT), all_b FROM bs
  UNION ALL
  SELECT slot + 1, list_filter(rest, lambda x: x.release <= slot + 1)[1],
    list_filter(rest, lambda x: x != list_filter(rest, lambda y: y.release <= slot + 1)[1]) FROM run WHERE len(rest) > 0),
p AS (SELECT slot AS slot_in, pick.i AS i, pick.j AS j FROM run WHERE slot >= 0),
d AS (SELECT doc_id, source, greatest(1, strlen(coalesce(text, ''))) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
k AS (SELECT s.*, CAST(start AS BIGINT) // {BLOCK_BYTES} AS block, w.i, w.a FROM s JOIN w ON s.source IS NOT DISTINCT FROM w.source),
o AS (SELECT k.*, block // a * total + slot_in AS slot FROM k JOIN p ON p.i = k.i AND p.j = k.block % k.a, t),
l AS (SELECT i, a, greatest(0, (CAST(sum(size) AS BIGINT) - 1) // {BLOCK_BYTES}) AS last FROM k GROUP BY 1, 2),
e AS (SELECT min(last // a * total + slot_in + 1) AS first_end FROM l JOIN p ON p.i = l.i AND p.j = l.last % l.a, t)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
  CAST(row_number() OVER (PARTITION BY slot ORDER BY start) AS INTEGER) AS slot_rank,
  row_number() OVER (ORDER BY slot, start) - 1 AS position, slot < first_end AS balanced FROM o, e"""
