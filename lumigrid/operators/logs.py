"""The half-structured log: JSON events, tagged text, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.scale import materialize, order_statistics

# Shapes of log lines.
EVENT_SCHEMA = "event STRING, type STRING, op STRING, pixels BIGINT, ms BIGINT"
PATH_PATTERN = r'"path":"(.*)"\}$'
TAG_PATTERN = r"^\[([^\]]*)\]"
SECOND_TAG_PATTERN = r"^\[[^\]]*\]\[([^\]]*)\]"
MESSAGE_PATTERN = r"^(?:\[[^\]]*\]){1,2} ?(.*)$"
FOLDER_PATTERN = r"^\[folder\] (\d+) EXR files \| thumbnails in (\d+) ms$"
COUNT_PATTERN = r"^  • (.*) \(channels: (\d+)\)$"
FOLDER_OP = "folder.thumbnails"
MODE_PATTERN = r"^\[(?:layer|channel|preview)\] .*→ mode: (RGB|Depth|Grayscale)\b"
GENERATED_PATTERN = r"^\[preview\] image generated: (\d+) pixels \(exp: (-?[\d.]+), gamma: (-?[\d.]+)\)$"
PARAMS_PATTERN = r"^\[preview\] updated → params: exp=(-?[\d.]+), gamma=(-?[\d.]+)$"
LAYERS_PATTERN = r"^\[(?:layers\] count|meta\] layers): (\d+)$"
SHOWN_CHANNEL_PATTERN = r"^\[channel\] (.*)@([^@]*) → mode: "
PREVIEW_CHANNEL_PATTERN = r"^\[preview\] updated → mode: .*, (.*)::(.*)$"
SHOWN_LAYER_PATTERN = r"^\[layer\] (.*) → mode: "
PREVIEW_LAYER_PATTERN = r"^\[preview\] updated → mode: .*, layer: (.*)$"
CLICKED_PATTERN = r"^\[layer\] clicked: .* \(real='(.*)'\)$"


def _found(line: Column, pattern: str, group: int = 1) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def parse_log(log_lines: DataFrame) -> DataFrame:
    """Fields of every line; what a line does not have is null.

    JSON lines do not escape the path, so the path is cut out as text and backslashes are hidden
    from the JSON parser.  Folder timings are text and become an ``op`` of their own.
    """
    line = F.col("line")
    is_json = line.startswith("{")
    parsed = log_lines.withColumn("_j", F.when(is_json, F.from_json(
        F.translate(line, "\\", "/"), EVENT_SCHEMA)))
    folder_ms = _found(line, FOLDER_PATTERN, 2).cast("bigint")
    return parsed.withColumns({
        "event": F.col("_j.event"), "type": F.col("_j.type"),
        "op": F.coalesce(F.col("_j.op"), F.when(folder_ms.isNotNull(), F.lit(FOLDER_OP))),
        "path": F.when(is_json, _found(line, PATH_PATTERN)),
        "pixels": F.col("_j.pixels"), "ms": F.coalesce(F.col("_j.ms"), folder_ms),
        "files": _found(line, FOLDER_PATTERN, 1).cast("bigint"),
        "tag": _found(line, TAG_PATTERN), "subtag": _found(line, SECOND_TAG_PATTERN),
        "message": F.when(line.rlike(TAG_PATTERN), _found(line, MESSAGE_PATTERN)),
        "layer": _found(line, COUNT_PATTERN, 1),
        "n_channels": _found(line, COUNT_PATTERN, 2).cast("bigint"),
    }).drop("_j")


def tagged_values(log_lines: DataFrame) -> DataFrame:
    """J22, values inside tagged lines: what was shown (``mode``, ``shown_layer``, ``shown_channel``), with which
    ``exposure`` and ``gamma``, how many pixels were made and how many layers were counted.

    What a line does not have is null; a number beyond its type is null, too.  The layer of a channel is what
    follows the last ``@`` (or stands before the last ``::``), as names of channels may hold the sign.
    """
    line = F.col("line")
    cast = lambda pattern, group, kind: _found(line, pattern, group).try_cast(kind)
    return log_lines.withColumns({
        "mode": _found(line, MODE_PATTERN),
        "shown_layer": F.coalesce(_found(line, SHOWN_CHANNEL_PATTERN, 2), _found(line, PREVIEW_LAYER_PATTERN),
                                  _found(line, PREVIEW_CHANNEL_PATTERN, 1), _found(line, SHOWN_LAYER_PATTERN),
                                  _found(line, CLICKED_PATTERN)),
        "shown_channel": F.coalesce(_found(line, SHOWN_CHANNEL_PATTERN, 1), _found(line, PREVIEW_CHANNEL_PATTERN, 2)),
        "exposure": F.coalesce(cast(GENERATED_PATTERN, 2, "double"), cast(PARAMS_PATTERN, 1, "double")),
        "gamma": F.coalesce(cast(GENERATED_PATTERN, 3, "double"), cast(PARAMS_PATTERN, 2, "double")),
        "n_pixels": cast(GENERATED_PATTERN, 1, "bigint"), "n_layers": cast(LAYERS_PATTERN, 1, "bigint")})


def _percentile(lower: str, upper: str, percent: int) -> Column:
    """Linear interpolation between two neighbours; the weight is exact integer arithmetic."""
    weight = F.pmod((F.col("n") - 1) * percent, F.lit(100)) / 100.0
    return F.col(lower) + (F.col(upper) - F.col(lower)) * weight


def timing_summary(parsed: DataFrame) -> DataFrame:
    """Per op, count, extremes, mean and percentiles of ``ms``, and pixels per second.

    Lines shrink map-side to counts of distinct (op, ms), which are written once; everything else
    starts from these, so lines are parsed once and a hot op does not gather in one task.
    """
    timed = materialize(
        parsed.filter("op IS NOT NULL AND ms IS NOT NULL").groupBy("op", "ms")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("pixels").alias("pixels"),
             F.sum(F.when(F.col("pixels").isNotNull(), F.col("ms"))).alias("pixel_ms")))
    totals = timed.groupBy("op").agg(
        F.sum("c").alias("n_timings"), F.min("ms").alias("min_ms"),
        (F.sum(F.col("ms") * F.col("c")) / F.sum("c")).alias("avg_ms"), F.max("ms").alias("max_ms"),
        F.sum("pixels").alias("pixels"), F.sum("pixel_ms").alias("_pixel_ms"))
    last = F.col("n") - 1
    at = lambda percent: F.expr(f"(n - 1) * {percent} div 100")
    stats = order_statistics(timed, ["op"], "ms", {
        "_50": at(50), "_50_next": F.least(at(50) + 1, last),
        "_95": at(95), "_95_next": F.least(at(95) + 1, last)}, weight=F.col("c"))
    return totals.join(stats, "op").select(
        "op", "n_timings", "min_ms", "avg_ms", "max_ms",
        _percentile("_50", "_50_next", 50).alias("p50_ms"),
        _percentile("_95", "_95_next", 95).alias("p95_ms"), "pixels",
        (F.col("pixels") * 1000.0 / F.when(F.col("_pixel_ms") > 0, F.col("_pixel_ms")))
        .alias("pixels_per_second"))
