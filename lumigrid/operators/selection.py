"""Clicks in the layer tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.functions import labels, names

# Display modes.
RGB, DEPTH, GRAYSCALE = "RGB", "Depth", "Grayscale"


def _second_word(c: Column) -> Column:
    words = F.split(names.trimmed(c), r"(?U)\s+")
    return F.coalesce(F.get(words, F.lit(1)), F.lit(""))


def parse_selections(selections: DataFrame) -> DataFrame:
    """Kind, shown layer and channel text of each line; lines that are neither are dropped."""
    line = F.col("line")
    t = names.trimmed(line)
    dotted = t.startswith(f"{labels.BULLET} ")
    marked = F.lit(False)
    for mark in labels.MARKS.values():
        marked = marked | t.startswith(mark)
    kind = (F.when(line.startswith(labels.FOLDER), F.lit("layer"))
            .when(dotted | marked, F.lit("channel")))
    at = t.contains("@")
    suffix = F.substring_index(t, "@", -1)
    left = F.when(at, names.trimmed(F.substring(t, F.lit(1), F.length(t) - F.length(suffix) - 1))) \
        .otherwise(t)
    # Before a suffix any run of bullets goes; without one only runs of bullet and space.
    bare = F.when(at, F.regexp_replace(left, f"^{labels.BULLET}+", "")) \
        .otherwise(F.regexp_replace(left, f"^({labels.BULLET} )+", ""))
    shown = (F.when(kind == "layer", names.trimmed(
                F.regexp_replace(line, f"^({labels.FOLDER})+", "")))
             .when(at, names.trimmed(suffix)))
    channel = F.when(kind == "channel", names.display_to_short(
        F.when(dotted, names.trimmed(bare)).otherwise(_second_word(left))))
    tail = F.regexp_replace(line, r"(?U)\s+$", "")
    return selections.withColumns({"kind": kind, "display": shown, "channel": channel,
                                   "lookup": F.when((kind == "channel") & ~at, tail)}) \
        .filter("kind IS NOT NULL")


def resolve_selection(selections: DataFrame, display_map: DataFrame, line_map: DataFrame,
                      current: DataFrame) -> DataFrame:
    """What each line selects: kind, real layer, channel and display mode.

    ``display_map`` (file_id, display, layer) and ``line_map`` (file_id, line, layer) come from the
    tree; ``current`` (file_id, layer) is the layer shown before the click.
    """
    by_display = display_map.select("file_id", "display", F.col("layer").alias("_display_layer"))
    by_line = line_map.select("file_id", F.col("line").alias("lookup"),
                              F.col("layer").alias("_line_layer"))
    now = current.select("file_id", F.col("layer").alias("_current"))
    layer = (F.when(F.col("display").isNotNull(), F.coalesce("_display_layer", "display"))
             .otherwise(F.coalesce("_line_layer", "_current")))
    mode = (F.when(F.col("kind") == "layer", F.lit(RGB))
            .when(names.is_depth_name(F.col("channel")), F.lit(DEPTH)).otherwise(GRAYSCALE))
    return (parse_selections(selections)
            .join(by_display, ["file_id", "display"], "left")
            .join(by_line, ["file_id", "lookup"], "left")
            .join(now, "file_id", "left")
            .select("sel_id", "file_id", "kind", layer.alias("layer"), "channel",
                    mode.alias("mode")))
