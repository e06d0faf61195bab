"""Queries of the join and layout operators on the driver's tables, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.radix import fanout, low_radix, mask, shifted_radix, stripe_shift
from .operators import joins, layout, skew
from .plans.chooser import choose
from .sources import generators as gen
from .sources.tables import PRIMARY, read

WORKERS = 4
#: Rows a block holds in the layout queries, so that small tables have several blocks.
BLOCK = 1_024
RADIX = 3
GROUPS = 2
ZIPF = 1.0
#: An exponent at which one key has most rows.
STEEP = 2.0
SEED = 54_321


def _relations(spark: SparkSession, sf_dir: str, foreign: str, key: str, primary: str) -> tuple[DataFrame, DataFrame]:
    r_key, r_payload = PRIMARY[primary]
    r = joins.as_relation(read(spark, sf_dir, primary, r_key, r_payload), r_key, r_payload)
    return r, joins.as_relation(read(spark, sf_dir, foreign, key), key)


def _pkfk(spark, sf_dir, foreign="lineitem", key="l_orderkey", primary="orders", strategy="auto", verify=False) -> DataFrame:
    r, s = _relations(spark, sf_dir, foreign, key, primary)
    # Parquet's own row counts: no data is read for them.
    decision = joins.decide(r, s, r.count(), s.count(), strategy=strategy)
    if strategy == "shuffle_hash":
        decision = type(decision)(strategy, RADIX, decision.primary_bytes, False)
    return joins.summary(r, joins.join(r, s, decision), verify)


def _pkfk_sql(foreign="lineitem", key="l_orderkey", primary="orders", verify=False) -> str:
    r_key, r_payload = PRIMARY[primary]
    value = r_key if verify else r_payload
    return f"""SELECT CAST((SELECT count(*) FROM {foreign} JOIN {primary} ON {key} = {r_key}) AS BIGINT) AS matches,
CAST((SELECT coalesce(sum({value}), 0) FROM {foreign} JOIN {primary} ON {key} = {r_key}) + (SELECT coalesce(sum({r_key}), 0) FROM {primary}) AS BIGINT) AS checksum"""


def _orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("key"))


def _events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events", "event_id", "user_id")


def gen_primary_keys(spark, sf_dir):
    return gen.primary_keys(spark, _orders(spark, sf_dir).count())


def gen_permutation(spark, sf_dir):
    """Moments of the shuffled order: it holds each key once."""
    keys = gen.primary_keys(spark, _orders(spark, sf_dir).count(), ordered=True)
    return keys.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.min("key").alias("low"), F.max("key").alias("high"), F.sum("payload").alias("payload"))


def gen_uniform_fk(spark, sf_dir):
    n, primary = read(spark, sf_dir, "events").count(), read(spark, sf_dir, "customer").count()
    return gen.uniform_foreign_keys(spark, n, primary).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def gen_zipf_cdf(spark, sf_dir):
    return gen.zipf_cdf(spark, read(spark, sf_dir, "part").count(), ZIPF)


def gen_zipf_fk(spark, sf_dir):
    n, primary = read(spark, sf_dir, "lineitem").count(), read(spark, sf_dir, "part").count()
    return gen.zipf_ranks(spark, n, primary, ZIPF, SEED).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def gen_zipf_keys(spark, sf_dir):
    """The hot ranks mapped to keys: each key of the relation with its frequency."""
    n, primary = read(spark, sf_dir, "lineitem").count(), read(spark, sf_dir, "part").count()
    config = gen.RelationConfig(n, SEED, ZIPF, "S")
    return gen.foreign_keys(spark, config, primary).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("payload").alias("payload"))


def _radix_counts(part, spark, sf_dir):
    return _orders(spark, sf_dir).groupBy(part.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


def radix_low(spark, sf_dir):
    return _radix_counts(low_radix(F.col("key"), RADIX), spark, sf_dir)


def radix_high(spark, sf_dir):
    shift = stripe_shift(_orders(spark, sf_dir).count(), RADIX)
    return _radix_counts(shifted_radix(F.col("key"), RADIX, shift), spark, sf_dir)


def radix_histogram(spark, sf_dir):
    return layout.histogram(_events(spark, sf_dir), low_radix(F.col("user_id"), RADIX))


def radix_offsets(spark, sf_dir):
    return layout.offsets(radix_histogram(spark, sf_dir)).select("h", "n", "start")


def _sliced(spark, sf_dir):
    return layout.slices(_events(spark, sf_dir), "event_id", WORKERS)


def _blocked(spark, sf_dir):
    return layout.blocks(_sliced(spark, sf_dir), BLOCK)


def slices(spark, sf_dir):
    return _sliced(spark, sf_dir).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"), F.max("pos").alias("last"))


def blocks(spark, sf_dir):
    return _blocked(spark, sf_dir).groupBy("worker", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"))


def block_histogram(spark, sf_dir):
    return layout.offsets(layout.histogram(_blocked(spark, sf_dir), low_radix(F.col("user_id"), RADIX), "worker", "block"), "worker", "block").select("worker", "block", "h", "n", "start")


def subblock_bounds(spark, sf_dir):
    return layout.sub_blocks(_blocked(spark, sf_dir), low_radix(F.col("user_id"), RADIX), fanout(RADIX), GROUPS)


def stable_scatter(spark, sf_dir):
    return layout.stable_scatter(_blocked(spark, sf_dir), low_radix(F.col("user_id"), RADIX)).select("event_id", "worker", "block", "h", F.col("target").cast("long").alias("target"))


def partitioned_join(spark, sf_dir):
    r, s = _relations(spark, sf_dir, "lineitem", "l_orderkey", "orders")
    return joins.per_partition(joins.partitioned_join(r, s, RADIX), low_radix(F.col("key"), RADIX))


def _sample(spark, sf_dir):
    return _blocked(spark, sf_dir).where("block = 0")


def skew_top2(spark, sf_dir):
    votes = skew.top_two(_sample(spark, sf_dir), low_radix(F.col("user_id"), RADIX))
    return votes.withColumn("skewed", skew.is_skewed(fanout(RADIX)))


def skew_vote(spark, sf_dir):
    return skew.unanimous(skew.top_two(_sample(spark, sf_dir), low_radix(F.col("user_id"), RADIX)), fanout(RADIX))


def _auto(exponent, spark, sf_dir):
    """A generated S, a sample of it, the decision that follows under a budget of 4 KB, and the join's result."""
    primary, rows = read(spark, sf_dir, "part").count(), read(spark, sf_dir, "lineitem").count()
    r = gen.primary_keys(spark, primary)
    if exponent:
        s = gen.zipf_ranks(spark, rows, primary, exponent, SEED).select("id", gen.rank_to_key(F.col("rank"), primary, SEED).alias("key"))
    else:
        s = spark.range(rows).select("id", (F.col("id") % primary + 1).alias("key"))
    sample = skew.blocks_by_position(s, "id", rows, WORKERS, BLOCK)
    d = joins.decide(r, s, primary, rows, budget=4_096, sample=sample)
    return joins.summary(r, joins.join(r, s.select("key"), d)).select(F.lit(d.skewed).alias("skewed"), F.lit(d.strategy).alias("strategy"), F.lit(d.radix).alias("radix"), "matches", "checksum")


def plan_choice(spark, sf_dir):
    """The chooser's decision for each pair of tables under a budget of 64 KB."""
    rows = []
    for foreign, primary in (("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer")):
        n, m = read(spark, sf_dir, primary).count(), read(spark, sf_dir, foreign).count()
        for skewed in (False, True):
            d = choose(n, m, budget=65_536, skewed=skewed)
            rows.append((primary, foreign, skewed, d.strategy, d.radix, d.primary_bytes))
    return spark.createDataFrame(rows, "primary_table string, foreign_table string, skewed boolean, strategy string, radix int, primary_bytes long")


def duplicate_keys(spark, sf_dir):
    r, _ = _relations(spark, sf_dir, "lineitem", "l_orderkey", "orders")
    return joins.duplicate_keys(r).agg(F.count(F.lit(1)).alias("n"))


def orphan_keys(spark, sf_dir):
    """Lines of orders that aren't urgent have no match among the urgent ones."""
    urgent = joins.as_relation(read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").where(F.col("o_orderpriority") == "1-URGENT"), "o_orderkey")
    s = joins.as_relation(read(spark, sf_dir, "lineitem", "l_orderkey"), "l_orderkey")
    return joins.orphan_keys(urgent, s).agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


#: Foreign table, its key, and the primary table.
PAIRS = {"pkfk_part": ("lineitem", "l_partkey", "part"), "pkfk_supplier": ("lineitem", "l_suppkey", "supplier"), "pkfk_customer": ("orders", "o_custkey", "customer"), "pkfk_events": ("events", "user_id", "customer")}


def queries() -> dict:
    out = {"pkfk_count_checksum": _pkfk}
    out |= {f"pkfk_{s}": partial(_pkfk, strategy=s) for s in ("broadcast", "shuffle_hash", "merge", "skew", "salt")}
    out["pkfk_verified"] = partial(_pkfk, verify=True)
    out |= {name: partial(_pkfk, foreign=f, key=k, primary=p) for name, (f, k, p) in PAIRS.items()}
    for f in (gen_primary_keys, gen_permutation, gen_uniform_fk, gen_zipf_cdf, gen_zipf_fk, gen_zipf_keys, radix_low, radix_high, radix_histogram, radix_offsets, slices, blocks, block_histogram, subblock_bounds, stable_scatter, partitioned_join, skew_top2, skew_vote, plan_choice, duplicate_keys, orphan_keys):
        out[f.__name__] = f
    out["auto_zipf"], out["auto_uniform"] = partial(_auto, STEEP), partial(_auto, 0.0)
    return out


_PLACED = f"""p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, ntile({WORKERS}) OVER (ORDER BY event_id) - 1 AS worker FROM events),
q AS (SELECT *, pos - min(pos) OVER (PARTITION BY worker) AS pos_in, count(*) OVER (PARTITION BY worker) AS m FROM p),
c AS (SELECT *, CAST(ceil(m / {BLOCK}) AS BIGINT) AS nb FROM q),
b AS (SELECT event_id, pos, worker, user_id & {mask(RADIX)} AS h,
  CASE WHEN pos_in < (m % nb) * (m // nb + 1) THEN pos_in // (m // nb + 1) ELSE (m % nb) + (pos_in - (m % nb) * (m // nb + 1)) // (m // nb) END AS block FROM c)"""
_CDF = f"""w AS (SELECT r AS rank, greatest(1, CAST(floor({float(1 << gen.WEIGHT_BITS)}::DOUBLE / r) AS BIGINT)) AS weight FROM range(1, (SELECT count(*) FROM part) + 1) AS t(r)),
f AS (SELECT rank, weight, CAST(sum(weight) OVER (ORDER BY rank) AS BIGINT) AS cdf FROM w)"""
_DRAWS = f"""t AS (SELECT max(cdf) AS total FROM f),
d AS (SELECT i AS id, CAST(('0x' || substr(md5(i || ':{SEED}'), 1, {gen.DRAW_BITS // 4})) AS BIGINT) AS u FROM range(0, (SELECT count(*) FROM lineitem)) AS x(i)),
e AS (SELECT id, CAST((CAST(u AS HUGEINT) * total) // {1 << gen.DRAW_BITS} AS BIGINT) AS draw FROM d, t),
z AS (SELECT e.id, f.rank FROM e ASOF JOIN (SELECT rank, cdf - weight AS low FROM f) AS f ON e.draw >= f.low)"""
_VOTES = f"""WITH {_PLACED}, n AS (SELECT worker, h, count(*) AS n FROM b WHERE block = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY n DESC, h) AS r FROM n),
v AS (SELECT CAST(worker AS BIGINT) AS worker, max(CASE WHEN r = 1 THEN n END) AS first, coalesce(max(CASE WHEN r = 2 THEN n END), 0) AS second, CAST(sum(n) AS BIGINT) AS rows FROM r GROUP BY 1),
k AS (SELECT *, first + second > rows * {skew.TOP_TWO_PERCENT} // 100 AS skewed FROM v)"""


#: From s(id, key): the sample's vote, the decision and the result. R is 1 to the number of parts, with payload 3 * key + 1.
_AUTO = f"""n AS (SELECT (SELECT count(*) FROM part) AS r, (SELECT count(*) FROM lineitem) AS s),
base AS (SELECT r, s, r * 16 AS bytes, CASE WHEN r * 16 * 5 < 4096 * 6 THEN 0 ELSE CAST(ceil(log2(greatest(1, r * 16 * 3 // 8192))) AS INTEGER) END AS radix FROM n),
pos AS (SELECT id, key, ntile({WORKERS}) OVER (ORDER BY id) AS worker FROM s),
sample AS (SELECT worker, key FROM (SELECT *, id - min(id) OVER (PARTITION BY worker) AS place FROM pos) WHERE place < {BLOCK}),
parts AS (SELECT worker, key % CAST(pow(2, greatest(3, radix)) AS BIGINT) AS h, count(*) AS m FROM sample, base GROUP BY 1, 2),
sorted AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY m DESC) AS place FROM parts),
votes AS (SELECT worker, sum(m) FILTER (WHERE place <= 2) > sum(m) * {skew.TOP_TWO_PERCENT} // 100 AS hot FROM sorted GROUP BY 1),
said AS (SELECT radix > 0 AND s // r >= 3 AND (SELECT coalesce(bool_and(hot), false) FROM votes) AS skewed, radix, bytes, r FROM base)
SELECT skewed, CASE WHEN radix = 0 THEN 'broadcast' WHEN skewed THEN CASE WHEN bytes <= 16384 THEN 'broadcast' ELSE 'skew' END ELSE 'shuffle_hash' END AS strategy,
  CAST(CASE WHEN skewed THEN radix + 1 ELSE radix END AS INTEGER) AS radix,
  (SELECT count(*) FROM s) AS matches, CAST((SELECT sum(3 * key + 1) FROM s) + r * (r + 1) // 2 AS BIGINT) AS checksum FROM said"""


def _choice_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT '{p}' AS primary_table, '{f}' AS foreign_table, (SELECT count(*) FROM {p}) AS n, (SELECT count(*) FROM {f}) AS m" for f, p in (("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer")))
    return f"""WITH s AS ({pairs}), x AS (SELECT *, n * 16 AS bytes, s2.skewed FROM s, (VALUES (false), (true)) AS s2(skewed)),
y AS (SELECT *, CASE WHEN bytes * 5 < 65536 * 6 THEN 0 ELSE CAST(ceil(log2(greatest(1, bytes * 3 // 131072))) AS INTEGER) END AS base FROM x)
SELECT primary_table, foreign_table, skewed,
  CASE WHEN base = 0 THEN 'broadcast' WHEN skewed AND m // n >= 3 THEN CASE WHEN bytes <= 262144 THEN 'broadcast' ELSE 'skew' END ELSE 'shuffle_hash' END AS strategy,
  CAST(CASE WHEN base > 0 AND skewed AND m // n >= 3 THEN base + 1 ELSE base END AS INTEGER) AS radix, bytes AS primary_bytes FROM y"""


def oracle_sql() -> dict[str, str]:
    out = {name: _pkfk_sql() for name in ("pkfk_count_checksum", "pkfk_broadcast", "pkfk_shuffle_hash", "pkfk_merge", "pkfk_skew", "pkfk_salt")}
    out["pkfk_verified"] = _pkfk_sql(verify=True)
    out |= {name: _pkfk_sql(*pair) for name, pair in PAIRS.items()}
    keys = "SELECT k AS key, 3 * k + 1 AS payload FROM range(1, (SELECT count(*) FROM orders) + 1) AS t(k)"
    out["gen_primary_keys"] = keys
    out["gen_permutation"] = f"SELECT count(*) AS n, count(DISTINCT key) AS n_keys, min(key) AS low, max(key) AS high, CAST(sum(payload) AS BIGINT) AS payload FROM ({keys})"
    out["gen_uniform_fk"] = """WITH c AS (SELECT (SELECT count(*) FROM events) AS s, (SELECT count(*) FROM customer) AS r)
SELECT k AS key, s // r + CASE WHEN k <= s % r THEN 1 ELSE 0 END AS n FROM c, LATERAL (SELECT unnest(range(1, r + 1)) AS k) WHERE s // r + CASE WHEN k <= s % r THEN 1 ELSE 0 END > 0"""
    out["gen_zipf_cdf"] = f"WITH {_CDF} SELECT rank, weight, cdf FROM f"
    out["gen_zipf_fk"] = f"WITH {_CDF}, {_DRAWS} SELECT rank, count(*) AS n FROM z GROUP BY 1"
    out["gen_zipf_keys"] = f"""WITH {_CDF}, {_DRAWS}, n AS (SELECT rank, count(*) AS n FROM z GROUP BY 1), p AS (SELECT count(*) AS p FROM part),
g AS (SELECT p, step FROM (SELECT p, CASE WHEN raw % p = 0 THEN 1 ELSE raw % p END AS base FROM (SELECT p, greatest(1, CAST(trunc(p * 0.618::DOUBLE) AS BIGINT) + {SEED} % 97) AS raw FROM p)), LATERAL (SELECT min(x) AS step FROM range(base, base + 1000) AS t(x) WHERE gcd(x, p) = 1))
SELECT ((rank - 1) * step + {SEED}) % p + 1 AS key, n, 3 * (((rank - 1) * step + {SEED}) % p + 1) + 1 AS payload FROM n, g"""
    counts = "SELECT {} AS h, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders{} GROUP BY 1"
    out["radix_low"] = counts.format(f"o_orderkey & {mask(RADIX)}", "")
    out["radix_high"] = counts.format(f"(o_orderkey >> s) & {mask(RADIX)}", f", (SELECT CAST(greatest(0, ceil(log2(count(*))) - {RADIX} - 1) AS INTEGER) AS s FROM orders)")
    hist = f"SELECT user_id & {mask(RADIX)} AS h, count(*) AS n FROM events GROUP BY 1"
    out["radix_histogram"] = hist
    out["radix_offsets"] = f"SELECT h, n, CAST(coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({hist})"
    out["slices"] = f"WITH {_PLACED} SELECT CAST(worker AS BIGINT) AS worker, count(*) AS n, min(pos) AS start, max(pos) AS last FROM p GROUP BY 1"
    out["blocks"] = f"WITH {_PLACED} SELECT CAST(worker AS BIGINT) AS worker, CAST(block AS BIGINT) AS block, count(*) AS n, min(pos) AS start FROM b GROUP BY 1, 2"
    out["block_histogram"] = f"""WITH {_PLACED}, n AS (SELECT CAST(worker AS BIGINT) AS worker, CAST(block AS BIGINT) AS block, h, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY worker, block ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n"""
    out["subblock_bounds"] = f"""WITH {_PLACED}, k AS (SELECT DISTINCT worker, block FROM b), g AS (SELECT worker, block, s FROM k, range({GROUPS}) AS t(s))
SELECT CAST(g.worker AS BIGINT) AS worker, CAST(g.block AS BIGINT) AS block, s AS sub_block,
  count(b.h) FILTER (WHERE b.h // {fanout(RADIX) // GROUPS} < s) AS start, count(b.h) FILTER (WHERE b.h // {fanout(RADIX) // GROUPS} <= s) AS "end"
FROM g JOIN b ON b.worker = g.worker AND b.block = g.block GROUP BY 1, 2, 3"""
    out["stable_scatter"] = f"""WITH {_PLACED} SELECT event_id, CAST(worker AS BIGINT) AS worker, CAST(block AS BIGINT) AS block, h,
  row_number() OVER (PARTITION BY worker, block ORDER BY h, pos) - 1 AS target FROM b"""
    out["partitioned_join"] = f"SELECT o_orderkey & {mask(RADIX)} AS h, count(*) AS matches, CAST(sum(o_custkey) AS BIGINT) AS checksum FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
    out["skew_top2"] = f"{_VOTES} SELECT worker, first, second, rows, skewed FROM k"
    out["skew_vote"] = f"{_VOTES} SELECT count(*) AS workers, coalesce(bool_and(skewed), false) AS skewed FROM k"
    out["plan_choice"] = _choice_sql()
    steps = f"""p AS (SELECT count(*) AS p FROM part),
g AS (SELECT p, step FROM (SELECT p, CASE WHEN raw % p = 0 THEN 1 ELSE raw % p END AS base FROM (SELECT p, greatest(1, CAST(trunc(p * 0.618::DOUBLE) AS BIGINT) + {SEED} % 97) AS raw FROM p)), LATERAL (SELECT min(x) AS step FROM range(base, base + 1000) AS t(x) WHERE gcd(x, p) = 1))"""
    cdf = _CDF.replace("/ r)", f"/ pow(r, {STEEP}))")
    out["auto_zipf"] = f"WITH {cdf}, {_DRAWS}, {steps}, s AS (SELECT id, ((rank - 1) * step + {SEED}) % p + 1 AS key FROM z, g), {_AUTO}"
    out["auto_uniform"] = f"WITH s AS (SELECT i AS id, i % (SELECT count(*) FROM part) + 1 AS key FROM range(0, (SELECT count(*) FROM lineitem)) AS x(i)), {_AUTO}"
    out["duplicate_keys"] = "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)"
    out["orphan_keys"] = "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"
    return out
