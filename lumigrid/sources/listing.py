"""Folder listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.functions import names

# The extension of image files.
EXTENSION = "exr"


def image_files(manifest: DataFrame) -> DataFrame:
    """J01 on a table of files: those with the extension in any case.  A name that is nothing but
    a dot and the extension has no extension."""
    name = names.file_name(F.col("path"))
    return manifest.filter(F.lower(name).rlike(rf".\.{EXTENSION}$"))


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """J01 on a folder, not recursive: path, name, size.  File contents are not read."""
    wildcard = "".join(f"[{c}{c.upper()}]" for c in EXTENSION)
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{wildcard}")
              .load(folder).select("path", F.col("length").alias("size_bytes")))
    return image_files(listed).select(
        "path", names.file_name(F.col("path")).alias("file_name"), "size_bytes")
