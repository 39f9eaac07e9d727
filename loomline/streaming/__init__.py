"""Results that arrive bit by bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def append_results(spark: SparkSession, source: str, target: str, checkpoint: str, schema, key: str) -> DataFrame:
    """Appends what is new in a folder of result files to a table, each key once, and returns the table when all is read.

    Keys that have been appended are kept as the stream's state, on disk, so no batch reads an earlier one again.
    The checkpoint remembers which files are done, and the file sink which batches are whole, so a batch that
    is tried again replaces itself. Of rows with one key in a batch any one stays.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source).dropDuplicates([key])
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).parquet(target)
