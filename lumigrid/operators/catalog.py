"""Catalog of archives: layers, channels, groups, display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.functions import grid, names
from lumigrid.scale import grouped_index

# Channels of one part that are ranked or joined into text together.
CHANNEL_BLOCK = 1024


def channel_layers(channels: DataFrame) -> DataFrame:
    """Add the logical ``layer`` and the ``short`` name to every channel.  Narrow."""
    full = F.col("full_name")
    return channels.withColumns({"layer": names.layer_name(full, F.col("part_name")),
                                 "short": names.short_name(full)})


def _found_layers(channels: DataFrame) -> DataFrame:
    place = grid.pack_position(F.col("part_idx"), F.col("channel_idx"))
    return channel_layers(channels).groupBy("file_id", "layer").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n_channels"),
        names.has_rgb(F.col("short")).alias("has_rgb"))


def layers(channels: DataFrame) -> DataFrame:
    """One row per (file, layer), in order of first appearance: ``layer_order``, the position of
    the first channel, ``n_channels`` and ``has_rgb``."""
    first_part, first_channel = grid.unpack_position(F.col("first"))
    placed = _found_layers(channels).select(
        "file_id", "layer", first_part.alias("first_part"), first_channel.alias("first_channel"),
        "n_channels", "has_rgb")
    block = {"_part": F.col("first_part"),
             "_block": F.floor(F.col("first_channel") / CHANNEL_BLOCK)}
    return grouped_index(placed, ["file_id"], ["first_part", "first_channel"], block,
                         "layer_order")


def logical_layers(channels: DataFrame) -> DataFrame:
    """The channels of every layer, one row each.

    Sort by (file_id, layer_order, part_idx, channel_idx) to read layers in order of first
    appearance and channels in file order.
    """
    return (channel_layers(channels)
            .join(layers(channels).select("file_id", "layer", "layer_order"), ["file_id", "layer"])
            .select("file_id", "layer_order", "layer", "part_idx", "channel_idx", "short"))


def best_layer(channels: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One layer name per file, found by a single minimum over (plan, priority, position).

    Plan 0: the unnamed layer with R, G, B.  Plan 1: a name containing a priority word, the word
    counting before the position.  Plan 2: any layer with R, G, B.  Plan 3: the first layer.
    With ``files``, files without any layer get a stand-in name.
    """
    # One row per layer; its minimum over files needs no window and shrinks map-side.  It is a number, so it
    # aggregates by hashing; the name is that of the channel at the position found.
    lower = F.lower("layer")
    priority = F.lit(None).cast("int")
    for i, word in reversed(list(enumerate(names.PRIORITY_LAYERS))):
        priority = F.when(lower.contains(word), F.lit(i)).otherwise(priority)
    words = len(names.PRIORITY_LAYERS)
    step = (F.when((F.col("layer") == "") & F.col("has_rgb"), 0).when(priority.isNotNull(), priority + 1)
            .when(F.col("has_rgb"), words + 1).otherwise(words + 2))
    at_step = [F.min(F.when(step == i, F.col("first"))).alias(f"_{i}") for i in range(words + 3)]
    least = F.col("step")
    plan = F.when(least == 0, 0).when(least <= words, 1).when(least == words + 1, 2).otherwise(3)
    chosen = (_found_layers(channels).groupBy("file_id").agg(F.min(step).alias("step"), *at_step)
              .select("file_id", plan.alias("plan"), F.coalesce(*[f"_{i}" for i in range(words + 3)]).alias("first")))
    named = channel_layers(channels).select(
        "file_id", grid.pack_position(F.col("part_idx"), F.col("channel_idx")).alias("first"),
        F.col("layer").alias("best_layer"))
    # One row per file, whose estimated size is that of the bytes in the catalog's own files.
    best = chosen.hint("merge").join(named, ["file_id", "first"]).select("file_id", "best_layer", "plan")
    if files is None:
        return best
    return (files.select("file_id").join(best, "file_id", "left")
            .withColumn("best_layer", F.coalesce("best_layer", F.lit(names.NO_LAYER))))


def channel_groups(channels: DataFrame) -> DataFrame:
    """Channels by kind.  Every part has all seven groups; an empty group has one row with a
    null channel.

    Sort by (file_id, part_idx, group_pos, sort_name, channel_idx) to read them in order.
    """
    groups = F.array(*[F.struct(F.lit(i).alias("group_pos"), F.lit(g).alias("group_name"))
                       for i, g in enumerate(names.CHANNEL_GROUPS)])
    parts = (channels.select("file_id", "part_idx").distinct()
             .select("file_id", "part_idx", F.inline(groups)))
    kinds = channel_layers(channels).select(
        "file_id", "part_idx", "channel_idx", "short", F.lower("short").alias("sort_name"),
        names.channel_group(names.ascii_upper(F.col("short"))).alias("group_name"))
    return parts.join(kinds, ["file_id", "part_idx", "group_name"], "left").select(
        "file_id", "part_idx", "group_pos", "group_name", "sort_name", "channel_idx", "short")


def layer_display(layer: Column) -> Column:
    """Shown name of a layer."""
    return F.when(layer == "", F.lit(names.BASE_LAYER_LABEL)).otherwise(layer)


def layer_display_map(layers_: DataFrame) -> DataFrame:
    """Shown name to real name per file.  The last layer wins if two show the same name."""
    return (layers_.withColumn("display", layer_display(F.col("layer")))
            .groupBy("file_id", "display")
            .agg(F.max_by("layer", "layer_order").alias("layer")))


def layer_channel_text(channels: DataFrame) -> DataFrame:
    """Channel names of every layer, joined by commas, with their number.

    Names are joined block by block first, so only finished pieces of text meet in one task.
    """
    named = channel_layers(channels).withColumn(
        "_block", F.floor(F.col("channel_idx") / CHANNEL_BLOCK))

    def text(pos: list[str], piece: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(*pos, piece)))
        return F.array_join(F.transform(ordered, lambda s: s[piece]), ", ")

    pieces = named.groupBy("file_id", "layer", "part_idx", "_block").agg(
        text(["channel_idx"], "short").alias("piece"), F.count(F.lit(1)).alias("n"))
    return pieces.groupBy("file_id", "layer").agg(
        text(["part_idx", "_block"], "piece").alias("channels"), F.sum("n").alias("n_channels"))


def layer_status(channels: DataFrame, requests: DataFrame) -> DataFrame:
    """For requested (file_id, layer): the layer's channels as text, "?" if there is no such
    layer, and how many there are."""
    return (requests.join(layer_channel_text(channels), ["file_id", "layer"], "left")
            .withColumns({"channels": F.coalesce("channels", F.lit("?")),
                          "n_channels": F.coalesce("n_channels", F.lit(0).cast("bigint"))}))
