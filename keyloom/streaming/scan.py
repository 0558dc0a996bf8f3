"""The scan has no state, so new files can be scanned as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.detect import scan


def watch_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over a folder of parquet files with ``file_id``, ``path`` and ``content``."""
    return spark.readStream.schema(schema).parquet(path)


def start_scan(files: DataFrame, output: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Append findings of every new file to a parquet folder, exactly once."""
    writer = scan(files, **options).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", output).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
