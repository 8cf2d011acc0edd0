"""The relational operators over streams: filters, projections and aggregates take streaming frames as they are.

The batch surface has no stream operators of its own, so these only add what Structured Streaming asks for: a source, a
watermark and event-time windows, and a sink with its checkpoint in a shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def windowed(df: DataFrame, time: str, length: str, late: str, by: list[str] | None = None, slide: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates over tumbling or sliding windows of event time; rows later than ``late`` are dropped by the watermark."""
    named = [c.alias(n) for n, c in aggs.items()]
    moment = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = moment.groupBy(F.window(time, length, slide), *(by or [])).agg(*named)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), *aggs)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Appends finished rows as Parquet, exactly once by the checkpoint; ``once`` takes what is there and ends."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()
