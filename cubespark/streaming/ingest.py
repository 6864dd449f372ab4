"""Incremental ingest of sensor rows into a cube's chunks, and windows over a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import REFERENCE, grid_index


def ingest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, chunk: timedelta, time: str = "ts", ref: datetime = REFERENCE) -> StreamingQuery:
    """New Parquet files of ``source`` appended to ``out`` by chunk; each file is taken once, then the query ends."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("chunk_id", grid_index(time, chunk, ref))
    return rows.writeStream.format("parquet").partitionBy("chunk_id").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_max(stream: DataFrame, keys: list[str], width: str, late: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Maxima of tumbling windows of a stream; windows close once the watermark has passed them."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(*keys, F.window(time, width)).agg(F.max(value).alias("value")).select(*keys, F.col("window.start").alias("ts"), "value")
