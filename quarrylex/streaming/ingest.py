"""Growth of an index from a stream, and statistics over event time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylex.operators.index import Config, append, build


def ingest(docs: DataFrame, path: str, checkpoint: str, config: Config = Config(), available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of a stream of documents becomes a segment of a virtual index; a repeated batch replaces its segment."""

    def write(batch: DataFrame, number: int) -> None:
        segment = build(batch, replace(config, name=f"{config.name}-{number:06d}"))
        spark = batch.sparkSession
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            for name in ("documents", "postings", "terms"):
                getattr(segment, name).write.mode("overwrite").partitionBy("index_name").parquet(f"{path}/{name}")
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums by event time; works on streams and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def alerts(events: DataFrame, least: float, ts: str = "ts") -> DataFrame:
    """Slow events as they arrive, each once within the watermark."""
    return events.withWatermark(ts, "10 minutes").where(F.col("value") >= least).dropDuplicatesWithinWatermark(["event_id"])


__all__ = ["alerts", "append", "ingest", "windowed"]
