"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label): at most ``rows`` labelled ids of each value 0 and 1 of ``label``.

    The ids with the least hashes are taken, so the choice is fixed and even.  Rows without id or
    label are passed over; an id labelled twice counts with its larger label.
    """
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .dropna().groupBy("doc_id").agg(F.max("label").alias("label")))
    parts = [one.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
    return parts[0].unionByName(parts[1])
