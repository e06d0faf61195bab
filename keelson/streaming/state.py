"""Aggregations whose state outlives a run: keyed, on disk, without expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Every state partition would reserve some megabytes of disk ahead of need.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def drain(aggregated: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Runs a streaming aggregation over what its source holds by now; returns its whole state.

    The rows are (key, value), structs of the grouping columns and of the aggregates' buffers in
    their order, read out once into Parquet at path, since every reader would load the state's
    files anew. checkpoint: a folder that all executors share; a later call with it goes on from
    the state that this one leaves.
    """
    spark = aggregated.sparkSession
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        query = aggregated.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint).select("key", "value")
        state.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(state.schema).parquet(path)
