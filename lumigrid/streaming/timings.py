"""Windowed timing figures of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.operators.logs import parse_log

# Rows later than this are dropped from streams.
WATERMARK = "10 minutes"


def log_timing(log_lines: DataFrame, window: str = "1 hour",
               watermark: str | None = None) -> DataFrame:
    """T5: per window and op, number, extremes, mean and sum of ``ms``, and pixels.

    Works on batches and, with ``watermark``, on streams.  Lines without a timing are dropped only
    after counting: a filter before it would be moved below the watermark, which then would follow the
    timings alone and not every line.
    """
    source = log_lines.withWatermark("ts", watermark) if watermark else log_lines
    return (parse_log(source).groupBy(F.window("ts", window).alias("w"), "op")
            .agg(F.count("ms").alias("n_timings"), F.min("ms").alias("min_ms"),
                 F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"),
                 F.sum("ms").alias("sum_ms"),
                 F.sum(F.when(F.col("ms").isNotNull(), F.col("pixels"))).alias("pixels"))
            .filter("n_timings > 0")
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "op", "n_timings", "min_ms", "avg_ms", "max_ms", "sum_ms", "pixels"))
