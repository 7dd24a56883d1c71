"""Building blocks that keep jobs safe when one key holds a large share of all rows.

Plain ``Window.partitionBy(key)`` puts a whole key into one task.  The helpers here work on *blocks*
of a key (a coarse, monotone prefix of the ordering) and carry only one summary row per block
across the blocks, so no task ever sees a whole hot key.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Buckets per octave of the value histogram; a bucket of 32-bit floats holds 2**23 / 256 values.
BUCKETS_PER_OCTAVE = 256
FIXED_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8,
                "timestamp": 8, "timestamp_ntz": 8}
_ABOVE_ALL = 1 << 29
_OFFSET = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a local session, which is one machine anyway, may fall back to a scratch folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lumigrid-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/lumigrid-{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes everything that this application has written there.  Results that were built on it can't
    be computed any more, so write them out first."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, *directories: str) -> DataFrame:
    """Write ``df`` to the shared folder, with a directory for each value of ``directories``, and read it back.

    Cuts the lineage, survives lost executors, and lets the optimizer plan by the *true* size of the
    table: it broadcasts the table if it is below ``spark.sql.autoBroadcastJoinThreshold`` and
    plans a shuffle join with skew handling otherwise.  Spark itself goes by the bytes of the files, where a million
    rows of few different values may take next to nothing; so a table that is above the threshold when decoded
    carries the hint for a shuffle join.
    """
    table = _rewritten(df, *directories)
    return table.hint("merge") if decoded_bytes(table) > _broadcast_threshold(df.sparkSession) else table


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's JVM collect plans that nobody holds, as those of written tables, so that their shuffle files go.
    These stay on the executors' disks until then, and a driver with room in its heap may take hours."""
    spark.sparkContext._jvm.System.gc()


def _rewritten(df: DataFrame, *directories: str) -> DataFrame:
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*directories).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.select(*df.columns) if directories else table  # directories come last


def _broadcast_threshold(spark: SparkSession) -> int:
    """The session's limit in bytes, however it was spelled."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def decoded_bytes(table: DataFrame) -> int:
    """Estimated size of a written table in memory: its rows times the width of their columns, where
    text and the like count by their mean length."""
    fixed = [c for c, t in table.dtypes if t in FIXED_WIDTHS]
    other = [c for c, _ in table.dtypes if c not in fixed]
    row = table.agg(F.count(F.lit(1)), *[F.sum(F.octet_length(F.col(c).cast("string"))) for c in other]).first()
    return row[0] * (16 + sum(FIXED_WIDTHS[t] for c, t in table.dtypes if c in fixed)) + sum(x or 0 for x in row[1:])


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                salts: int = 16, how: str = "inner", limit: int | None = None,
                directory: str | None = None) -> DataFrame:
    """Equi join of a table with hot keys and one with few rows per key.

    ``small`` is written first and its decoded size is measured.  Up to ``limit`` bytes (by default those of
    ``spark.sql.autoBroadcastJoinThreshold``, as the driver's memory has to bear them) it is broadcast
    as it is, and ``big`` is not shuffled.  Beyond, both sides are shuffled, every key of ``big`` is
    spread over ``salts`` partitions and every row of ``small`` repeated once per salt; ``spread`` are
    columns of ``big`` that vary inside a key.

    ``directory`` is the key column that partitions the files of ``big``: of these only the directories that
    ``small`` names are read.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    known = _rewritten(small)
    if directory and how == "inner":
        # True for every row; the optimizer prunes by the keys of a filtered side only.
        known = known.filter(F.col(directory) >= 0)
    if decoded_bytes(known) <= (_broadcast_threshold(big.sparkSession) if limit is None else limit):
        return big.join(F.broadcast(known), list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def grouped_index(df: DataFrame, group: Sequence[str], order: Sequence[str],
                  block: Mapping[str, Column], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row inside its group.

    ``block`` names coarse columns that never decrease along ``order``.  Rows are ranked inside a
    block; block offsets are running sums over one count per block.  Group columns must not be null.
    """
    blocked = df.withColumns(dict(block))
    keys = [*group, *block]
    before = (Window.partitionBy(*group).orderBy(*block)
              .rowsBetween(Window.unboundedPreceding, -1))
    heads = (blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(_head_first(), *order))
    offset = F.max("_before").over(Window.partitionBy(*keys))
    return _without_heads(_with_heads(blocked, heads)
                          .withColumn(name, (offset + inside - 2).cast("int"))
                          .drop("_before", *block))


# A block's head row brings what the block needs to know of the blocks before it.  It travels in the
# same shuffle as the rows of the block, where a join would need one shuffle per side.
def _head_first() -> Column:
    return F.col("_head").desc()


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    return rows.withColumn("_head", F.lit(False)).unionByName(
        heads.withColumn("_head", F.lit(True)), allowMissingColumns=True)


def _without_heads(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("_head")).drop("_head")


def value_bucket(v: Column) -> Column:
    """Monotone coarse bucket of a number: sign and ``1/256`` octaves of the magnitude."""
    octave = lambda m: F.floor(F.log2(m) * BUCKETS_PER_OCTAVE) + _OFFSET
    d = v.cast("double")
    infinite = F.lit(float("inf"))
    return (F.when(F.isnan(d), F.lit(_ABOVE_ALL + 1))
            .when(d == infinite, F.lit(_ABOVE_ALL))
            .when(d == -infinite, F.lit(-_ABOVE_ALL))
            .when(d > 0, octave(d))
            .when(d < 0, -octave(-d))
            .otherwise(F.lit(0)).cast("int"))


def ordered_bits(v: Column) -> Column:
    """A number as a BIGINT of the same order: the bits of its magnitude as a DOUBLE, with its sign.  NaN is last."""
    d = v.cast("double")
    m = F.abs(d)
    power = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(m))  # off by one at most, next to a power of two
    e = near + F.when(power(near) > m, -1).when(power(near + 1) <= m, 1).otherwise(0)
    # All steps are exact: a quotient by a power of two, a difference in 1..2, a product with a power of two.
    normal = (e + 1023) * (1 << 52) + ((m / power(e) - 1) * float(1 << 52)).cast("bigint")
    bits = F.when(m < 2.0 ** -1022, (m / F.lit(2.0 ** -1074)).cast("bigint")).otherwise(normal)
    return (F.when(F.isnan(d), F.lit(2047 * (1 << 52) + 1)).when(d == 0, F.lit(0).cast("bigint"))
            .when(m == float("inf"), F.signum(d).cast("bigint") * (2047 * (1 << 52)))
            .when(d < 0, -bits).otherwise(bits))


def _fine_cells(kind: str, v: Column) -> list[Column]:
    """Finer and finer cells for the values of one coarse bucket, the last of one value each; a cell has at most some
    2**16 of the next ones."""
    if kind in ("tinyint", "smallint", "float"):  # at most 2**15 values to a bucket
        return [v]
    if kind == "int":
        return [F.shiftright(v, 14), v]
    if kind == "bigint":
        return [*[F.shiftright(v, k) for k in (44, 29, 14)], v]
    if kind == "double":
        return [*[F.shiftright(ordered_bits(v), k) for k in (29, 14)], v]
    raise TypeError(f"order statistics of {kind}")


def order_statistics(df: DataFrame, group: Sequence[str], value: str,
                     positions: Mapping[str, Column], weight: Column | None = None,
                     minima: Mapping[str, Column] | None = None,
                     maxima: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact order statistics per group, without sorting or shuffling the rows of a group.

    ``positions`` maps output names to 0-based indexes written in terms of the column ``n`` (rows
    of the group, or total ``weight``); ``minima`` and ``maxima`` are taken along.  ``value`` is a FLOAT, a DOUBLE or an
    integer.  A first scan counts coarse buckets, which shrink map-side to a few thousand rows per group, and locates
    the bucket of every index.  Further scans count finer cells inside the located ones only, until a located cell
    holds one value: one scan for FLOAT, up to three for DOUBLE and four for BIGINT, so that no cell has more than some
    2**16 counts however many values lie close together.  NaN sorts last, as in Spark; NULL is no value and takes no
    part, so a group of nothing else has no row.  Runs a job for each scan.
    """
    group = list(group)
    df = df.filter(F.col(value).isNotNull())
    kind = dict(df.dtypes)[value]
    weighted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    extremes = [*[(n, c, F.min) for n, c in (minima or {}).items()],
                *[(n, c, F.max) for n, c in (maxima or {}).items()]]
    taken = [n for n, _, _ in extremes]
    counted = [weighted.alias("_c"), F.min(value).alias("_least"), F.max(value).alias("_most")]
    cells = df.withColumn("_c0", value_bucket(F.col(value)))
    per_group = Window.partitionBy(*group)
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), idx.cast("bigint").alias("_idx"))
                       for name, idx in positions.items()])
    coarse = cells.groupBy(*group, "_c0").agg(*counted, *[f(c).alias(n) for n, c, f in extremes])
    asked = coarse.withColumns({"n": F.sum("_c").over(per_group), **{n: f(n).over(per_group) for n, _, f in extremes}}) \
        .withColumn("_upto", F.sum("_c").over(_running(per_group, "_c0"))).select("*", F.inline(wanted))
    known, place, found = [*group, "n", *taken, "_name"], ["_c0"], []
    fine = _fine_cells(kind, F.col(value))
    for step in range(len(fine) + 1):
        start = F.col("_upto") - F.col("_c")
        located = materialize(asked.filter((F.col("_idx") >= start) & (F.col("_idx") < F.col("_upto")))
                              .select(*known, *place, (F.col("_idx") - start).alias("_idx"), "_least", "_most"))
        settled = F.col("_least") == F.col("_most")
        found.append(located.filter(settled).select(*known, F.col("_least").alias("_v")))
        # An empty cell of the last scan is not asked for, and every other is of one value.
        if step == len(fine) or located.filter(~settled).isEmpty():
            break
        rest = located.filter(~settled).drop("_least", "_most")
        cells = cells.join(rest.select(*group, *place).distinct(), [*group, *place]).withColumn(f"_c{step + 1}", fine[step])
        finer = [*place, f"_c{step + 1}"]
        counts = cells.groupBy(*group, *finer).agg(*counted)
        in_cell = _running(Window.partitionBy(*group, *place, "_name"), finer[-1])
        asked = counts.join(rest, [*group, *place]).withColumn("_upto", F.sum("_c").over(in_cell))
        place = finer
    hits = functools.reduce(DataFrame.unionByName, found)
    return hits.groupBy(*group).agg(
        F.max("n").alias("n"), *[F.max(n).alias(n) for n in taken],
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in positions])


def _running(window: WindowSpec, order: str) -> WindowSpec:
    return window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def event_order(micros: Column, event_id: Column) -> Column:
    """(time, id) as one number.  Like other fixed-width values it can be an ordering inside a hash
    aggregate, where a struct forces a sort of all rows."""
    place = micros.cast("decimal(19,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return (place + event_id).cast("decimal(38,0)")


def carry_last(df: DataFrame, group: Sequence[str], order: Sequence[str],
               block: Mapping[str, Column], carried: Mapping[str, str]) -> DataFrame:
    """Add, for each ``carried[new] = old``, the last non-null ``old`` up to and including the row.

    Works inside blocks and passes one summary row per block on to the next blocks.
    """
    blocked = df.withColumns(dict(block))
    keys = [*group, *block]
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    ends = blocked.groupBy(*keys).agg(
        *[F.max_by(old, F.when(F.col(old).isNotNull(), position)).alias(f"_end_{new}")
          for new, old in carried.items()])
    before = (Window.partitionBy(*group).orderBy(*block)
              .rowsBetween(Window.unboundedPreceding, -1))
    heads = ends.select(*keys, *[F.last(f"_end_{new}", ignorenulls=True).over(before)
                                 .alias(f"_at_{new}") for new in carried])
    rows = blocked.withColumns({f"_at_{new}": F.col(old) for new, old in carried.items()})
    upto = (Window.partitionBy(*keys).orderBy(_head_first(), *order)
            .rowsBetween(Window.unboundedPreceding, 0))
    return _without_heads(
        _with_heads(rows, heads)
        .withColumns({new: F.last(f"_at_{new}", ignorenulls=True).over(upto) for new in carried})
        .drop(*[f"_at_{new}" for new in carried], *block))
