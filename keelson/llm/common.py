"""Shared plumbing of the corpus operators: scratch tables, folds, safe joins."""

from __future__ import annotations

import atexit
import shutil
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.position import FALLBACK_DIR, shared_dir

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that every executor and the driver can reach."""
    path = f"{shared_dir(spark)}/keelson/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files outlive any executor, so later stages restart from them instead of
    recomputing; they go when the driver ends, or earlier through discard(). At a path that
    the caller names they stay.
    """
    spark = df.sparkSession
    mode = "overwrite" if path else "error"
    path = path or scratch_path(spark, name)
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ended(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to path to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def discard(df: DataFrame) -> None:
    """Delete the scratch files behind a materialised table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/keelson/" in file:
            _delete(df.sparkSession, file)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        if path.startswith(FALLBACK_DIR):
            shutil.rmtree(path, ignore_errors=True)
        if spark.sparkContext._jsc is None:
            continue
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the files then stay for the cluster's own cleaning
            return


def _own_rows(docs: DataFrame, filters: bool) -> bool:
    """Whether docs are the rows of Parquet files, each listed once, under columns (and filters) alone."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "SubqueryAlias", "View", *["Filter"] * filters):
        if not plan.deterministic():
            return False
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    paths = list(plan.relation().location().inputFiles())
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and len(set(paths)) == len(paths)


def stored(docs: DataFrame, name: str, path: str | None = None, filters: bool = True) -> DataFrame:
    """docs, or a stored copy where a task that runs again might see other rows or another order, or files repeat."""
    return docs if _own_rows(docs, filters) else materialise(docs, name, path)


def place() -> Column:
    """File and row number of a row of stored(): no two rows have the same."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def file_starts(docs: DataFrame) -> DataFrame:
    """(file, before): the rows of the files that were written before, by part, of docs as stored(filters=False) gives them.

    A row's number in the order in which docs were written is before + place.row. One row a file.
    """
    files = docs.select(place().alias("place")).groupBy("place.file").agg((F.max("place.row") + 1).alias("n"))
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = F.sum("n").over(W.orderBy(part, "file").rowsBetween(W.unboundedPreceding, -1))
    return files.select("file", F.coalesce(before, F.lit(0)).alias("before"))


def dealt_in_order(rows: DataFrame, position: str, n: int) -> DataFrame:
    """rows in the order of their position, 0 to n - 1, over partitions. As it has no gap, equal lanes need no sample."""
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(lanes, F.floor(F.col(position) * lanes / max(1, n)).cast("int")).sortWithinPartitions(position)


#: Bits of flagged()'s map: 8 MB, whatever the input. A chunk is what bitmap_construct_agg makes.
MAP_BITS, CHUNK_BITS = 26, 15


def flagged(rows: DataFrame, key: Column, members: DataFrame, member_key: Column) -> DataFrame:
    """rows with __maybe: false where the key is none of the members', so that only the others need a join.

    A map of 2**MAP_BITS bits, which is all that is broadcast, marks the members' hashes. With
    more members than bits nearly all rows are flagged; nothing else changes.
    """
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << MAP_BITS))
    marked = members.select(slot(member_key).alias("__slot"))
    chunk, inside = F.shiftright("__slot", CHUNK_BITS), F.col("__slot").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))
    every = rows.sparkSession.range(1 << MAP_BITS - CHUNK_BITS).select(F.col("id").alias("__chunk"), F.lit(None).cast("long").alias("__at"))
    marked = marked.select(chunk.alias("__chunk"), inside.alias("__at")).union(every)
    chunks = materialise(marked.groupBy("__chunk").agg(F.bitmap_construct_agg("__at").alias("__bits")), "member-map")
    rows = rows.withColumn("__slot", slot(key)).withColumn("__chunk", chunk).join(F.broadcast(chunks), "__chunk")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("bit_get", byte, inside.bitwiseAND(F.lit(7)).cast("int"))
    return rows.withColumn("__maybe", bit == 1).drop("__slot", "__chunk", "__bits")


def held_out(doc_id: Column) -> Column:
    """The fold that no model sees: crc32 of the id's decimal text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; right's keys are dropped. The names must not clash otherwise."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__r_{k}"), keys, right)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])
