"""Parquet tables of the engine.

Pixel and sample tables are laid out for pruning: a directory per hash bucket of the image, files
range-partitioned by (image, y), rows in (y, x) order.  A huge image spreads over many files of its
bucket, and Parquet statistics on ``y`` skip the files a region does not touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid import schemas

BUCKETS = 256
BUCKET = "bucket"
# The column that identifies an image, and the order inside it.
LAYOUT = {
    "pixels": ("image_id", ["y", "x"]),
    "pixels8": ("image_id", ["y", "x"]),
    "samples": ("file_id", ["part_idx", "channel_idx", "y", "x"]),
    "scanlines": ("file_id", ["part_idx", "channel_idx", "y"]),
}


def bucket_of(image: Column) -> Column:
    """The directory that holds an image's rows."""
    return F.pmod(F.xxhash64(image.cast("bigint")), F.lit(BUCKETS)).cast("int")


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of ``table``, cast to its types."""
    fields = [f.split(" ", 1) for f in schemas.TABLES[table].split(", ")]
    return df.select(*[F.col(name).cast(dtype).alias(name) for name, dtype in fields])


def write_table(df: DataFrame, path: str, table: str, mode: str = "errorifexists") -> None:
    rows = conform(df, table)
    if table not in LAYOUT:
        rows.write.mode(mode).parquet(path)
        return
    image, order = LAYOUT[table]
    keys = [BUCKET, image, *order]
    (rows.withColumn(BUCKET, bucket_of(F.col(image)))
     .repartitionByRange(*keys[:-1] if order[-1] == "x" else keys)
     .sortWithinPartitions(*keys)
     .write.mode(mode).partitionBy(BUCKET).parquet(path))


def read_table(spark: SparkSession, path: str, table: str,
               images: Sequence[int] | None = None, keep_bucket: bool = False) -> DataFrame:
    """A table with its fixed schema; ``images`` reads only their directories and row groups.

    With ``keep_bucket`` the directory stays a column.  The operators that look up few images join on it,
    too, so that the scan reads only the directories of these (dynamic partition pruning).
    """
    schema = schemas.TABLES[table]
    if table not in LAYOUT:
        return spark.read.schema(schema).parquet(path)
    rows = spark.read.schema(f"{schema}, {BUCKET} INT").parquet(path)
    if images is not None:
        image = LAYOUT[table][0]
        wanted = spark.range(1).select(F.array(*[bucket_of(F.lit(i)) for i in images])).first()[0]
        rows = rows.filter(F.col(BUCKET).isin(*set(wanted)) & F.col(image).isin(*images))
    return rows if keep_bucket else rows.drop(BUCKET)


def save_lines(scanlines: DataFrame, name: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Scan lines as the catalog table ``name``, bucketed by (file, y) and sorted by these: lines of one
    place lie in one bucket, and a huge file in all of them, so lines are put together without an exchange."""
    rows = conform(scanlines, "scanlines")
    (rows.repartition(buckets, "file_id", "y").write.bucketBy(buckets, "file_id", "y").sortBy("file_id", "y")
     .format("parquet").options(**({"path": path} if path else {})).saveAsTable(name))
    return scanlines.sparkSession.table(name)


def to_scanlines(samples: DataFrame) -> DataFrame:
    """One row per line of a channel, from x = 0 to its last sample; places without one hold NULL."""
    cells = F.map_from_entries(F.collect_list(F.struct("x", "v")))
    return (samples.groupBy("file_id", "part_idx", "channel_idx", "y")
            .agg(cells.alias("_cells"), F.max("x").alias("_last"))
            .select("file_id", "part_idx", "channel_idx", "y", F.transform(
                F.sequence(F.lit(0), F.col("_last")), lambda x: F.try_element_at("_cells", x)).alias("line")))


def from_scanlines(scanlines: DataFrame, *more: str) -> DataFrame:
    """Back to one row per sample, with the columns of ``more``; NULL stands for none.  Narrow."""
    return scanlines.select("file_id", "part_idx", "channel_idx", *more, "y",
                            F.posexplode("line").alias("x", "v")).filter("v IS NOT NULL")
