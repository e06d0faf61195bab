"""Exact deduplication by a stateful stream.

Main path: DataFrame functions and Structured Streaming only.

The stream keeps one row of state for each digest, on disk (RocksDB) and without expiry:
the stable identifier of the earliest row, its content locator (file and row number, or
row number of the stored copy) and how many rows had the digest. Rows whose digest was there
already are hits; their full bytes are compared with the content that the locator names.
Where bytes differ although the digests are equal, the rows are told apart by their whole
text.

A later call with the same checkpoint goes on from the state: its rows are held against those
of all calls before. The checkpoint keeps each call's digests and, of rows that come from no
Parquet file, their texts; the files that earlier calls read must still be there.

Defined results: a null text counts as empty. Of equal texts the row with the smallest
doc_id stays; null ids come last; among rows with the same id the first by file and row
number stays, so of repeated rows exactly one is kept, also where a file is read twice. Extra
columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.state import drain
from .common import flagged, materialise, place, scratch_path, stored, table

SPACES = r"[\x20\x09-\x0D]+"
#: A keeper is repeated once for each so many of its hits, so that no task compares more of them.
HITS_A_TASK = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _earliest() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")).alias("first")


def update_state(digests: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs the stream over the digest files in folder that it hasn't seen yet; returns its whole state.

    (digest, first struct<no_id, doc_id, place>, group_size long)
    """
    stream = digests.sparkSession.readStream.schema(digests.schema).parquet(folder)
    state = drain(stream.groupBy("digest").agg(_earliest(), F.count(F.lit(1)).alias("group_size")), checkpoint, scratch_path(digests.sparkSession, "dedup-state"))
    first, size = [F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields]
    return state.select("key.digest", first.alias("first"), size.alias("group_size"))


def _differing(content: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of hits whose bytes are not those of their keeper. hits: (digest, place, first, group_size)."""
    salts = F.ceil(F.col("group_size") / HITS_A_TASK)
    # One shuffle, of the texts that have an equal digest elsewhere.
    some = flagged(content, F.col("place"), hits, F.col("place")).where("__maybe").drop("__maybe")
    bodies = materialise(some.join(hits.select("digest", "place", "group_size", F.col("first.place").alias("kept")), "place"), "dedup-hits")
    mine = bodies.where(F.col("place") != F.col("kept")).select("digest", "kept", F.pmod(F.xxhash64("place"), salts).alias("salt"), F.col("body").alias("own"))
    keepers = bodies.where(F.col("place") == F.col("kept"))
    keepers = keepers.select("kept", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("body").alias("theirs"))
    return mine.join(keepers, ["kept", "salt"]).where(F.col("own") != F.col("theirs")).select("digest").distinct()


def find_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, all_runs: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, place, keep_id, group_size long, kept boolean, text_sha256 string.

    digest: from the normalised text to binary; only its speed matters for right results.
    checkpoint: folder of the state, in a store that all executors share; groups then take in the
    rows of earlier calls, one call at a time. all_runs: a row for each row of those too, as one
    call over all would give them, since a later row may have a smaller doc_id.
    """
    spark: SparkSession = docs.sparkSession
    base, run = checkpoint or scratch_path(spark, "dedup"), uuid.uuid4().hex
    docs = stored(docs.select("doc_id", "text"), "dedup-content", f"{base}/content-{run}" if checkpoint else None)
    content = docs.select(place().alias("place"), normalised(F.col("text")).alias("body"))
    seen = docs.select("doc_id", place().alias("place"), normalised(F.col("text")).alias("body")).select("doc_id", "place", digest(F.col("body")).alias("digest"), F.sha2("body", 256).alias("text_sha256"), F.lit(run).alias("run"))
    same = digest is sha256
    seen = seen.drop("text_sha256") if same else seen
    seen.write.mode("append").option("compression", "zstd").parquet(f"{base}/digests")
    digests = spark.read.schema(seen.schema).parquet(f"{base}/digests")
    state = update_state(digests, f"{base}/digests", f"{base}/stream")
    found = digests.join(state, "digest")

    hits = found.where("group_size > 1")
    scope = F.lit(True) if all_runs or not checkpoint else F.col("run") == run
    if checkpoint:
        hits = materialise(hits.join(hits.where(scope).select("digest").distinct(), "digest", "left_semi"), "dedup-pending")
        # Names of files, of which the earlier calls' tables have so many.
        files = [unquote(r[0]) for r in hits.where(F.col("run") != run).select("place.file").distinct().collect()]
        if files:
            content = content.union(spark.read.parquet(*files).select(place().alias("place"), normalised(F.col("text")).alias("body")))
    differing = materialise(_differing(content, hits), "dedup-differing")
    if not differing.isEmpty():
        found = _by_bytes(found, content, differing)
    return found.where(scope).select(
        "doc_id", "place", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("first.place")).alias("kept"),
        (F.lower(F.hex("digest")) if same else F.col("text_sha256")).alias("text_sha256"),
    )


def _by_bytes(found: DataFrame, content: DataFrame, differing: DataFrame) -> DataFrame:
    """Rows under a digest of several texts are grouped by the text itself."""
    rows = found.join(differing, "digest", "left_semi").drop("first", "group_size").join(content, "place")
    groups = rows.groupBy("digest", "body").agg(_earliest(), F.count(F.lit(1)).alias("group_size"))
    told = rows.join(groups, ["digest", "body"]).drop("body")
    return found.join(differing, "digest", "left_anti").unionByName(told)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = stored(docs, "dedup-input")
    dropped = materialise(find_duplicates(docs).where(~F.col("kept")).select(F.col("place").alias("__place")), "dedup-dropped")
    # Rows that surely stay are not shuffled.
    placed = flagged(docs.withColumn("__place", place()), F.col("__place"), dropped, F.col("__place"))
    rest = placed.where("__maybe").join(dropped, "__place", "left_anti")
    return placed.where("not __maybe").select(*docs.columns).unionByName(rest.select(*docs.columns))


def op8_stream_dedup(spark, sf_dir):
    return find_duplicates(table(spark, sf_dir, "documents")).drop("place")


def oracle() -> str:
    return r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.body) AS text_sha256 FROM d JOIN g ON d.body = g.body"""
