"""Parquet tables and the one-row result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Relations as (table, key, payload): the primary-key side.
PRIMARY = {
    "orders": ("o_orderkey", "o_custkey"),
    "part": ("p_partkey", "p_size"),
    "supplier": ("s_suppkey", "s_nationkey"),
    "customer": ("c_custkey", "c_nationkey"),
}


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def report(result: DataFrame) -> dict:
    """The single row of a join's summary, as the command line prints it."""
    row = result.first()
    return {"checksum": row["checksum"], "matches": row["matches"]}
