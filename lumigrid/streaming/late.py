"""Rows behind the watermark, kept apart instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.streaming.runs import Keyed
from lumigrid.streaming.timings import WATERMARK


def marked_late(events: DataFrame, window: str, watermark: str = WATERMARK) -> Keyed:
    """The rows of a stream with ``late``: whether the window of the row had closed before its micro-batch began,
    that is, ended ``watermark`` or more before the latest ``ts`` of all earlier batches.

    No row goes missing: those in time go into the windows of T1 or T5, late ones into a table of their own, and
    ``late_counts`` tells how many there are.  A row without ``ts`` has no window and isn't late.  The state is a
    single row.
    """

    def step(batch: DataFrame, before: DataFrame) -> DataFrame:
        latest = before.agg(F.unix_micros(F.max("latest"))).first()[0]
        if latest is None:
            return batch.withColumn("late", F.lit(False))
        closed = F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {watermark}")
        # ``F.window`` drops rows without a time; these stand in the window of the epoch until their null is seen.
        timed = F.coalesce("ts", F.timestamp_micros(F.lit(0)))
        return (batch.withColumn("_window", F.window(timed, window))
                .withColumn("late", F.col("ts").isNotNull() & (F.col("_window.end") <= closed)).drop("_window"))

    def after(rows: DataFrame, before: DataFrame) -> DataFrame:
        return before.unionByName(rows.select(F.col("ts").alias("latest"))).agg(F.max("latest").alias("latest"))

    return Keyed(events, "latest TIMESTAMP", step, after)


def late_counts(marked: DataFrame) -> DataFrame:
    """Rows in time and late rows of each micro-batch, from the table that ``run_keyed`` gives."""
    return marked.groupBy("_batch").agg(F.count_if(~F.col("late")).alias("n_kept"), F.count_if("late").alias("n_late"))
