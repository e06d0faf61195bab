"""Stored copies, places of rows, the order of files, and the map of members."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import common, language_id


def test_rows_of_files_are_used_as_they_are(spark, sf, tmp_path):
    path = f"{sf}/documents.parquet"
    docs = spark.read.parquet(path)
    docs.select("doc_id").write.orc(f"{tmp_path}/orc")
    docs.createOrReplaceTempView("some_docs")
    plain = [docs, docs.select("doc_id", "text"), docs.where("doc_id > 3"), docs.alias("d"), spark.table("some_docs")]
    others = [spark.read.parquet(path, path), docs.union(docs), docs.withColumn("r", F.rand()), docs.where(F.rand() > 0.5), docs.join(docs.select("doc_id"), "doc_id"), docs.select(F.explode(F.split("text", " "))), spark.range(3), spark.read.orc(f"{tmp_path}/orc"), docs.limit(3)]
    for d in plain:
        assert common.stored(d, "x") is d
    for d in others:
        kept = common.stored(d, "x")
        assert kept is not d and kept.columns == d.columns
        places = kept.select(common.place().alias("p")).collect()
        assert len(places) == len(set(places)) and len(places) > 0
    assert common.stored(plain[2], "x", filters=False) is not plain[2]


def test_numbers_follow_the_order_of_writing(spark, tmp_path):
    spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("k")).write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t").select("k", common.place().alias("place"))
    starts = common.file_starts(spark.read.parquet(f"{tmp_path}/t"))
    rows = docs.withColumn("file", F.col("place.file")).join(starts, "file").select("k", (F.col("before") + F.col("place.row")).alias("n"))
    assert sorted((r["n"], r["k"]) for r in rows.collect()) == [(n, 3 * n) for n in range(1000)]
    dealt = common.dealt_in_order(rows, "n", 1000)
    assert [r["n"] for r in dealt.collect()] == list(range(1000))
    assert common.dealt_in_order(rows.where("false"), "n", 0).collect() == []


@pytest.mark.parametrize("bits", [common.MAP_BITS, 16])
def test_members_are_always_flagged(spark, bits, monkeypatch):
    """With a small map, others are flagged by chance; members always are."""
    monkeypatch.setattr(common, "MAP_BITS", bits)
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("x").alias("bits"))
    members = spark.range(20_000).where("id % 3 = 0").select(F.when(F.col("id") > 0, F.col("id")).alias("m"))
    got = common.flagged(rows, F.col("id"), members, F.col("m"))
    assert got.columns == ["id", "bits", "__maybe"] and got.count() == 20_000
    false = {r["id"] for r in got.where("not __maybe").collect()}
    assert not {i or None for i in range(0, 20_000, 3)} & false
    assert len(false) > (13_300 if bits > 20 else 10_000)
    assert common.flagged(rows, F.col("id"), members.where("false"), F.col("m")).where("__maybe").isEmpty()


def test_a_workers_memory_for_language_id_is_a_small_slices():
    """Over one batch of 12 MB, as Spark hands it to a worker."""
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "te") for b in ("ra", "no", "sti", "vel") for c in ("s", "n", "", "ing")]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 400)) for _ in range(5000)]
    model = language_id.fit(texts[:8], ["a", "b", "c", "d"] * 2, steps=2)
    docs = SimpleNamespace(schema=None, mapInArrow=lambda run, schema: run, sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))))
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    run = language_id.keep_identified(docs, model, 0.0)
    tracemalloc.start()
    try:
        rows = sum(part.num_rows for part in run(iter([batch])))
        assert rows == len(texts) and tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
