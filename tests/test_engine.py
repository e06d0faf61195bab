import math
from types import SimpleNamespace

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions import radix
from keelson.functions.position import shared_dir, with_position
from keelson.operators import joins, layout, skew
from keelson.plans.chooser import Decision, choose, size_radix
from keelson.plans.cli import main, parse, phases
from keelson.sources import generators as gen
from keelson.streaming.state import drain

STRATEGIES = ["broadcast", "shuffle_hash", "merge", "skew", "salt"]


@given(st.integers(1, 1 << 40))
def test_logarithms(n):
    assert 1 << radix.lg_floor(n) <= n < 1 << (radix.lg_floor(n) + 1)
    assert radix.lg_ceil(n) == math.ceil(math.log2(n)) or (1 << radix.lg_ceil(n)) >= n > (1 << radix.lg_ceil(n)) // 2
    assert radix.div_ceil(n, 7) == (n + 6) // 7


def test_logarithms_refuse_zero():
    for f in (radix.lg_floor, radix.lg_ceil):
        with pytest.raises(ValueError):
            f(0)


@pytest.mark.parametrize("primary,foreign", [(1, 1), (8, 8), (8, 20), (8, 3), (1000, 3000)])
@pytest.mark.parametrize("strategy", STRATEGIES)
def test_closed_forms(spark, primary, foreign, strategy):
    r, s = gen.primary_keys(spark, primary), gen.uniform_foreign_keys(spark, foreign, primary)
    decision = Decision(strategy, 2, 0, False)
    triangle = lambda n: n * (n + 1) // 2
    q, m = divmod(foreign, primary)
    keys = q * triangle(primary) + triangle(m)
    joined = joins.join(r, s.select("key"), decision)
    assert joins.summary(r, joined).collect() == [(foreign, triangle(primary) + 3 * keys + foreign)]
    assert joins.summary(r, joined, verify=True).collect() == [(foreign, triangle(primary) + keys)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_nulls_orphans_duplicates_and_empty_sides(spark, strategy):
    decision = Decision(strategy, 1, 0, False)
    r = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "key long, payload long")
    s = spark.createDataFrame([(1,), (1,), (7,), (None,)], "key long")
    assert joins.summary(r, joins.join(r, s, decision)).collect() == [(2, 3 + 20)]
    assert joins.orphan_keys(r, s.where("key is not null")).collect() == [(7,)]
    twice = r.union(r)
    assert {x["key"] for x in joins.duplicate_keys(twice).collect()} == {1, 2, None}
    none = s.where("false")
    assert joins.summary(r, joins.join(r, none, decision)).collect() == [(0, 3)]
    empty = r.where("false")
    assert joins.summary(empty, joins.join(empty, s, decision)).collect() == [(0, 0)]


def test_plans_hold_the_join_that_was_chosen(spark):
    r, s = gen.primary_keys(spark, 100), gen.uniform_foreign_keys(spark, 1000, 100).select("key")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.broadcast_join(r, s))
    partitioned = plan(joins.partitioned_join(r, s, 2))
    assert "ShuffledHashJoin" in partitioned and partitioned.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in plan(joins.merge_join(r, s))


def test_hot_key_is_dealt_over_salts(spark):
    r = gen.primary_keys(spark, 50)
    s = spark.range(6000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50 + 1).cast("long").alias("key"))
    got = joins.salted_join(r, s)
    assert got.count() == 6000 and got.where("key = 7").count() == s.where("key = 7").count()


def test_zipf_heads(spark):
    n, rows, z = 1000, 20_000, 1.0
    counts = {r["rank"]: r["n"] for r in gen.zipf_ranks(spark, rows, n, z).groupBy("rank").agg(F.count("*").alias("n")).collect()}
    harmonic = sum(k**-z for k in range(1, n + 1))
    assert sum(counts.values()) == rows
    for k in (1, 2, 3, 10):
        want = rows * k**-z / harmonic
        assert abs(counts[k] - want) < 5 * math.sqrt(want)


@pytest.mark.parametrize("z", [0.25, 0.75, 1.25])
def test_zipf_relation_for_other_exponents(spark, z):
    s = gen.foreign_keys(spark, gen.RelationConfig(500, 9, z, "S"), 40)
    assert s.count() == 500
    assert s.agg(F.min("key"), F.max("key")).first()[0] >= 1
    assert s.where("key > 40").isEmpty()


def test_rank_to_key_is_a_permutation(spark):
    for n in (1, 2, 10, 97, 1000):
        keys = [r[0] for r in spark.range(1, n + 1).select(gen.rank_to_key(F.col("id"), n, 54_321)).collect()]
        assert sorted(keys) == list(range(1, n + 1))


def test_skew_of_zero_or_less_is_uniform(spark):
    got = gen.foreign_keys(spark, gen.RelationConfig(20, 1, -1.0, "S"), 8).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {k: 2 + (k <= 4) for k in range(1, 9)}
    with pytest.raises(ValueError):
        gen.uniform_foreign_keys(spark, 1, 0)


@pytest.mark.parametrize("n,blocks", [(32_758, [32_758]), (32_759, [16_380, 16_379])])
def test_block_edges(spark, n, blocks):
    rows = layout.blocks(layout.slices(spark.range(n), "id", 1))
    assert [r["count"] for r in rows.groupBy("block").count().orderBy("block").collect()] == blocks


def test_positions_and_scatter(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"))
    placed = with_position(rows, "k").orderBy("k").collect()
    assert [r["pos"] for r in placed] == list(range(1000))
    blocked = layout.blocks(layout.slices(rows, "k", 3), 100)
    out = layout.stable_scatter(blocked, radix.low_radix(F.col("k"), 2)).collect()
    by = {}
    for r in out:
        by.setdefault((r["worker"], r["block"]), []).append(r)
    assert all(len(x) <= 100 for x in by.values())
    for x in by.values():
        x.sort(key=lambda r: r["target"])
        assert [r["target"] for r in x] == list(range(len(x)))
        assert [(r["h"], r["pos"]) for r in x] == sorted((r["h"], r["pos"]) for r in x)
    with pytest.raises(ValueError):
        layout.sub_blocks(blocked, radix.low_radix(F.col("k"), 2), 4, 3)


def test_folder_of_intermediate_tables():
    def session(master, conf=None, given=None):
        own = {"spark.checkpoint.dir": conf} if conf else {}
        context = SimpleNamespace(master=master, getConf=lambda: own, getCheckpointDir=lambda: given)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: own.get(key, default)))

    assert shared_dir(session("spark://h:7077", "s3://b/c/", "hdfs://x")) == "s3://b/c"
    assert shared_dir(session("local-cluster[1,1,1024]", None, "hdfs://x/y")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")) == "/tmp/checkpoints"
    for master in ("spark://h:7077", "yarn", "local-cluster[1,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_state_of_a_stream_goes_on(spark, tmp_path):
    rows = lambda n: spark.range(n).select((F.col("id") % 3).alias("k"))
    rows(10).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long").parquet(f"{tmp_path}/in").groupBy("k").count()
    state = lambda out: {r["key"]["k"]: r["value"][0] for r in drain(stream, f"{tmp_path}/state", f"{tmp_path}/{out}").collect()}
    assert state("a") == {0: 4, 1: 3, 2: 3}
    rows(2).write.mode("append").parquet(f"{tmp_path}/in")
    assert state("b") == {0: 5, 1: 4, 2: 3}


def test_more_workers_than_rows(spark):
    rows = layout.slices(spark.range(3), "id", 5).orderBy("pos").collect()
    assert [r["worker"] for r in rows] == [0, 1, 2]


def test_skew_votes(spark):
    hot = spark.range(1000).select((F.col("id") % 2).alias("worker"), F.when(F.col("id") % 4 < 2, F.lit(8)).otherwise(F.floor(F.col("id") / 4) % 8).alias("key"))
    even = hot.withColumn("key", F.col("key") * 0 + F.xxhash64(F.rand(3)) % 1024)
    part = radix.low_radix(F.col("key"), 3)
    assert skew.unanimous(skew.top_two(hot, part), 8).first()["skewed"]
    assert not skew.unanimous(skew.top_two(even, part), 8).first()["skewed"]
    half_hot = hot.where("worker = 0").union(even.where("worker = 1"))
    assert not skew.unanimous(skew.top_two(half_hot, part), 8).first()["skewed"]
    assert not skew.unanimous(skew.top_two(hot.where("false"), part), 8).first()["skewed"]
    assert skew.unanimous(skew.top_two(hot, radix.low_radix(F.col("key"), 1)), 2).first()["workers"] == 2


def test_every_worker_s_first_block_is_sampled(spark):
    s = spark.range(0, 4000, 1, 4).select((F.col("id") * 10).alias("key"))
    got = skew.first_blocks(s, 100).collect()
    assert sorted((r["worker"], r["key"]) for r in got) == [(w, (w * 1000 + k) * 10) for w in range(4) for k in range(100)]
    by_place = skew.blocks_by_position(s.withColumn("pos", F.col("key") / 10), "pos", 4000, 3, 5).collect()
    assert sorted((r["worker"], r["key"]) for r in by_place) == [(w, (start + k) * 10) for w, start in ((0, 0), (1, 1334), (2, 2667)) for k in range(5)]
    assert skew.first_blocks(s.where("false"), 100).collect() == []


def test_skew_is_sampled_where_it_matters(spark, monkeypatch):
    r = gen.primary_keys(spark, 1000)
    hot = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 2 == 0, 8).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).cast("long").alias("key"))
    even = spark.range(0, 20_000, 1, 4).select((F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("key"))
    # Sorted by key, S's head has few keys but its slices don't all.
    ordered = spark.range(0, 20_000, 1, 4).select((F.floor(F.col("id") / 20) + 1).alias("key"))
    late = hot.withColumn("key", F.when(F.spark_partition_id() == 0, F.monotonically_increasing_id() % 1000 + 1).otherwise(F.col("key")))
    decide = lambda s, **more: joins.decide(r, s, 1000, 20_000, budget=1_000, **more)
    assert (decide(hot).strategy, decide(hot).skewed, decide(hot).radix) == ("skew", True, decide(even).radix + 1)
    for s in (even, ordered, late):
        assert (decide(s).strategy, decide(s).skewed) == ("shuffle_hash", False)
    assert decide(hot, radix=2) == Decision("shuffle_hash", 2, 16_000, False)
    assert decide(hot, strategy="merge").strategy == "merge"
    # No sample is taken where it can't change the plan.
    monkeypatch.setattr(skew, "first_blocks", None)
    assert joins.decide(r, hot, 1000, 20_000).strategy == "broadcast" and joins.decide(r, hot, 1000, 2_999, budget=1_000).strategy == "shuffle_hash"


def test_a_broadcast_over_the_memory_is_partitioned(spark, monkeypatch):
    r, s = gen.primary_keys(spark, 1000), spark.range(20_000).select((F.col("id") % 1000 + 1).alias("key"))
    assert joins.decide(r, s, 1000, 20_000, strategy="broadcast").strategy == "broadcast"
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    for rows in (heap // 256 + 1, 10**9):
        assert joins.decide(r, s, rows, rows, strategy="broadcast").strategy == "shuffle_hash"
    monkeypatch.setattr(joins, "broadcast_limit", lambda spark: 1000 * 16 - 1)
    for strategy in ("auto", "broadcast"):
        decision = joins.decide(r, s, 1000, 20_000, strategy=strategy)
        assert decision.strategy == "shuffle_hash"
        row = joins.summary(r, joins.join(r, s, decision)).first()
        assert (row["matches"], row["checksum"]) == (20_000, 20 * sum(3 * k + 1 for k in range(1, 1001)) + 500_500)


def test_a_skewed_partition_is_split(spark):
    """The plan that ran over a Zipf relation, chosen on the automatic path, has a skew join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        r = gen.primary_keys(spark, 2000)
        s = gen.zipf_ranks(spark, 60_000, 2000, 2.0).select(gen.rank_to_key(F.col("rank"), 2000, 54_321).alias("key"), F.xxhash64("id").alias("other")).repartition(8)
        decision = joins.decide(r, s, 2000, 60_000, budget=4_096)
        assert (decision.strategy, decision.skewed) == ("skew", True)
        joined = joins.join(r, s, decision)
        assert len(joined.collect()) == 60_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "skew=true" in plan
        assert joins.summary(r, joined).first()["matches"] == 60_000
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_a_primary_key_that_stands_twice_is_refused(spark):
    r = gen.primary_keys(spark, 10)
    assert joins.checked(r).count() == 10
    with pytest.raises(ValueError):
        joins.checked(r.union(r))


def test_a_rank_that_covers_many_buckets(spark, monkeypatch):
    want = gen.zipf_ranks(spark, 3000, 500, 1.0).groupBy("rank").count().collect()
    monkeypatch.setattr(gen, "BUCKETS_A_TASK", 7)
    assert sorted(gen.zipf_ranks(spark, 3000, 500, 1.0).groupBy("rank").count().collect()) == sorted(want)


def test_phases_of_a_join(spark):
    r, s = gen.primary_keys(spark, 100), gen.uniform_foreign_keys(spark, 300, 100).select("key")
    assert list(phases(r, s, Decision("broadcast", 0, 0, False))) == ["Building", "Probing"]
    assert list(phases(r, s, Decision("skew", 2, 0, False))) == ["Partitioning", "Build/Probe"]


def test_permutation_is_in_the_order_of_the_seed(spark):
    keys = [r["key"] for r in gen.primary_keys(spark, 500, ordered=True).collect()]
    other = [r["key"] for r in gen.primary_keys(spark, 500, seed=6, ordered=True).collect()]
    assert sorted(keys) == sorted(other) == list(range(1, 501)) and keys != other and keys != sorted(keys)
    assert keys == [r["id"] for r in spark.range(1, 501).orderBy(F.xxhash64("id", F.lit(12_345)), "id").collect()]


def test_choices():
    assert choose(1000, 10_000).strategy == "broadcast"
    assert choose(10**9, 10**9).strategy == "shuffle_hash"
    assert choose(10**9, 3 * 10**9, skewed=True).strategy == "skew"
    assert choose(10**9, 2 * 10**9, skewed=True).strategy == "shuffle_hash"
    assert choose(10**7, 10**8, skewed=True).strategy == "broadcast"
    assert choose(10**9, 10, strategy="merge").strategy == "merge"
    assert choose(0, 0).strategy == "broadcast"
    for bad in (dict(strategy="none"), dict(strategy="broadcast")):
        with pytest.raises(ValueError):
            choose(10**10, 10, **bad)
    # 4/3 of the budget is where partitioning starts.
    assert size_radix(100, 100) == size_radix(132, 100) == 0 and size_radix(134, 100) == 1


def test_command_line(spark, capsys):
    assert parse(["--r=5", "--s=9"]).skew == 0
    assert main(["--r=100", "--s=1000", "--skew=1.0", "--strategy=salt"], spark) == {"matches": 1000, "checksum": main(["--r=100", "--s=1000", "--skew=1.0"], spark)["checksum"]}
    assert "strategy=" in capsys.readouterr().out
    main(["--r=100", "--s=1000", "--radix=3", "--check-keys", "--phases"], spark)
    said = capsys.readouterr().out
    assert "strategy=shuffle_hash partitions=8" in said and "Partitioning=" in said and "Build/Probe=" in said
    with pytest.raises(SystemExit):
        parse(["--unknown=1"])
