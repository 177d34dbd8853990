"""Structured Streaming over event files. The reference has polling and journals only; event-time windows are additions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import registry

QUERIES, SQL, query = registry()


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per type and window; later rows than the watermark allows are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def drained(df: DataFrame) -> DataFrame:
    """Run a stream over what is there now, in append mode, and read what it wrote: windows that the watermark has closed."""
    from ..operators.retrieval import scratch

    spark = df.sparkSession
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("st_tumbling", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2")
def st_tumbling(spark, sf_dir):
    """Closed windows; the last one stays in the state until later events come."""
    found = drained(tumbling(stream(spark, sf_dir)))
    return found.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
