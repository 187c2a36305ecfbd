"""Structured Streaming over append-only events: windowed counts with late data, and growth of logs per key.

The batch queries re-scan; these keep state instead, bounded by a watermark or by one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str, at: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, key, n per tumbling or sliding window; rows later than the watermark fall out."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, key, n per run of events no further apart than ``gap``."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def marker_counts(lines: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Debt-marker lines per window."""
    from gneiss.operators.text import MARKER

    hit = lines.where(F.col("text").rlike(MARKER)).withColumn("marker", F.upper(F.regexp_extract("text", MARKER, 1)))
    return windowed_counts(hit, "marker", at, width, late=late)


def shrinks(events: DataFrame, key: str, value: str, sink: str, checkpoint: str):
    """Starts a stream that appends to ``sink`` each row whose value is below the largest of its key so far: key, value, previous.

    Each micro-batch is compared with a table of the keys' maxima, which is written anew under the batch's number,
    so a batch that is run again after a failure gives the same rows.
    """
    spark = events.sparkSession
    state = f"{checkpoint}/maxima"

    def step(batch: DataFrame, n: int) -> None:
        now = batch.groupBy(key).agg(F.max(value).alias("top"), F.min(value).alias("low"))
        try:
            old = spark.read.parquet(f"{state}/{n - 1}")
        except Exception:
            if n > 0:
                raise
            old = now.select(key, F.lit(None).cast(dict(now.dtypes)["top"]).alias("previous")).limit(0)
        both = now.join(old, key, "full_outer")
        both.where("low < previous").select(key, F.col("low").alias(value), "previous").write.mode("overwrite").parquet(f"{sink}/batch={n}")
        both.select(key, F.greatest("previous", "top").alias("previous")).write.mode("overwrite").parquet(f"{state}/{n}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
