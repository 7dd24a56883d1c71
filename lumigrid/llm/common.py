"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.scale import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{scratch_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = path or scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more, and lets the driver's JVM collect plans that
    nobody holds, so that their shuffle files go, too."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    jvm.System.gc()


#: Words of a row set that are broadcast, some 40 bytes each; more are joined.
WORDS = 1 << 20


def with_numbers(rows: DataFrame, number: str, wanted: DataFrame, words: int | None = None) -> DataFrame:
    """The ``rows`` whose ``number`` (a long, different in each row) is in ``wanted``, a table of that one column.

    Wanted numbers become a bit each, 64 to a word, so wide rows are filtered where they are and not shuffled.
    More than ``words`` words are too many to broadcast; then it is a plain join.  Runs a job.
    """
    key, bits, n = free_name(rows.columns, "word"), free_name(rows.columns, "bits"), F.col(number)
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    word, bit = F.shiftright(n, 6), F.pmod(n, F.lit(64)).cast("int")
    wanted = wanted.withColumnRenamed(wanted.columns[0], number)
    table = written(wanted.groupBy(word.alias(key)).agg(F.bit_or(one(bit)).alias(bits)), "numbers")
    if table.count() > (WORDS if words is None else words):
        return rows.join(wanted, number, "left_semi")
    return (rows.withColumn(key, word).join(F.broadcast(table), key)
            .filter(F.col(bits).bitwiseAND(one(bit)) != 0).select(*rows.columns))


def free_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, with underscores put before it until no column has that name (in any case)."""
    names = {n.lower() for n in taken}
    while wish.lower() in names:
        wish = "_" + wish
    return wish


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
