"""Reports: metadata rows and lines, layer metadata, channel tree, gallery.

Report rows carry their sort keys instead of positions, so ordering is one distributed sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.functions import grid, labels, names, text
from lumigrid.operators import catalog

# Report labels, as emitted.
GENERAL, HEADER = "Ogólne", "Nagłówek"
PATH_KEY, SIZE_KEY, PARTS_KEY = "Ścieżka", "Rozmiar pliku", "Warstwy"
PART_TITLE, DIMS_KEY, UNNAMED_PART, UNNAMED_ATTR = "Warstwa: ", "Wymiary", "(domyślna)", "Atrybut"

REPORT_ORDER = ["file_id", "section", "named", "sort_name", "part_idx", "ord"]


def parts(channels: DataFrame) -> DataFrame:
    """One row per physical part; sort by (named, sort_name, part_idx): unnamed first."""
    found = channels.groupBy("file_id", "part_idx").agg(
        F.coalesce(F.max("part_name"), F.lit("")).alias("name"),
        F.max("width").alias("width"), F.max("height").alias("height"))
    return found.withColumns({"named": (F.col("name") != "").cast("int"),
                              "sort_name": F.lower("name")})


def layer_metadata(channels: DataFrame, attrs: DataFrame) -> DataFrame:
    """Per part its size, attributes and channel groups, in long form.

    ``section`` is ``attribute`` or ``group``.  Sort by (file_id, named, sort_name, part_idx,
    section, pos, sort_value, channel_idx).
    """
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    attributes = attrs.filter("part_idx IS NOT NULL").select(
        "file_id", "part_idx", F.lit("attribute").alias("section"), F.col("ord").alias("pos"),
        F.col("name").alias("key"), "value", none_text.alias("sort_value"),
        none_int.alias("channel_idx"))
    groups = catalog.channel_groups(channels).select(
        "file_id", "part_idx", F.lit("group").alias("section"), F.col("group_pos").alias("pos"),
        F.col("group_name").alias("key"), F.col("short").alias("value"),
        F.col("sort_name").alias("sort_value"), "channel_idx")
    return parts(channels).join(attributes.unionByName(groups), ["file_id", "part_idx"])


def _keyed(df: DataFrame, section: int, ord_: Column, key: Column, value: Column,
           kind: str) -> DataFrame:
    """Report entries of one section.  Sections without parts leave the part keys at zero."""
    has = set(df.columns)
    pick = lambda c, default: F.col(c) if c in has else default
    return df.select("file_id", F.lit(section).alias("section"),
                     pick("named", F.lit(0)).alias("named"),
                     pick("sort_name", F.lit("")).alias("sort_name"),
                     (F.col("part_idx") if "named" in has else F.lit(0)).alias("part_idx"),
                     ord_.alias("ord"), key.alias("key"), value.alias("value"),
                     F.lit(kind).alias("kind"))


def _entries(files: DataFrame, channels: DataFrame, attrs: DataFrame) -> DataFrame:
    """Unformatted entries of both metadata reports, for files that have channels."""
    part_rows = parts(channels)
    readable = files.join(part_rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_parts")),
                          "file_id")
    blank = F.lit("")
    # Every file's fixed rows at once: (section, ord, key, value, kind).
    fixed = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(o).alias("ord"), F.lit(k).alias("key"),
                 v.alias("value"), F.lit(kind).alias("kind"))
        for s, o, k, v, kind in [
            (0, -1, GENERAL, blank, "title"),
            (0, 0, PATH_KEY, F.col("path"), "item"),
            (0, 1, SIZE_KEY, text.human_size(F.col("size_bytes")), "item"),
            (0, 2, PARTS_KEY, F.col("n_parts").cast("string"), "item"),
            (1, -1, HEADER, blank, "title")]])
    general = (readable.select("file_id", F.inline(fixed))
               .select("file_id", "section", F.lit(0).alias("named"), blank.alias("sort_name"),
                       F.lit(0).alias("part_idx"), "ord", "key", "value", "kind"))
    header = _keyed(attrs.filter("part_idx IS NULL").drop("part_idx")
                    .join(readable.select("file_id"), "file_id"),
                    1, F.col("ord"), F.col("name"), F.col("value"), "header")
    known = part_rows.join(readable.select("file_id"), "file_id")
    label = F.when(F.col("name") == "", F.lit(UNNAMED_PART)).otherwise(F.col("name"))
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    titles = _keyed(known, 2, F.lit(-2), label, size, "part")
    part_attrs = attrs.filter("part_idx IS NOT NULL").join(
        known.select("file_id", "part_idx", "named", "sort_name"), ["file_id", "part_idx"])
    of_parts = _keyed(part_attrs, 2, F.col("ord"), F.col("name"), F.col("value"), "attr")
    return general.unionByName(header).unionByName(titles).unionByName(of_parts)


def metadata_rows(files: DataFrame, channels: DataFrame, attrs: DataFrame) -> DataFrame:
    """The two-column metadata table.  Sort by ``REPORT_ORDER``."""
    key, value, kind = F.col("key"), F.col("value"), F.col("kind")
    trimmed = names.trimmed(key)
    row = lambda ord_, k, v: F.struct(ord_.alias("ord"), k.alias("key"), v.alias("value"))
    header_key = text.header_key(key)
    one = F.array(row(
        F.col("ord"),
        F.when(kind == "header", header_key)
        .when((kind == "attr") & (trimmed == ""), F.lit(UNNAMED_ATTR))
        .when(kind == "attr", trimmed).otherwise(key),
        F.when(kind == "header", text.header_value(header_key, value)).otherwise(value)))
    two = F.array(row(F.lit(-2), F.concat(F.lit(PART_TITLE), key), F.lit("")),
                  row(F.lit(-1), F.lit(DIMS_KEY), value))
    return _entries(files, channels, attrs).select(
        "file_id", "section", "named", "sort_name", "part_idx",
        F.inline(F.when(kind == "part", two).otherwise(one)))


def metadata_lines(files: DataFrame, channels: DataFrame, attrs: DataFrame) -> DataFrame:
    """The same report as text lines.  Sort by ``REPORT_ORDER``."""
    key, value, kind = F.col("key"), F.col("value"), F.col("kind")
    pair = F.when(key == "", value).otherwise(F.concat(key, F.lit(": "), value))
    line = (F.when(kind == "title", F.concat(F.lit("["), key, F.lit("]")))
            .when(kind == "part", F.concat(F.lit(PART_TITLE), key, F.lit("  — "), value))
            .when(kind == "attr", F.concat(F.lit("  "), pair))
            .otherwise(pair))
    return _entries(files, channels, attrs).select(*REPORT_ORDER, line.alias("line"))


TREE_ORDER = ["file_id", "layer_order", "slot", "sort_name", "part_idx", "channel_idx"]


def channel_tree(channels: DataFrame) -> DataFrame:
    """The layer tree.  Sort by ``TREE_ORDER``.

    ``slot`` is -1 for the layer row, 0 to 3 for the first channel starting with R, G, B, A, and 4
    for the others, which are alphabetical.
    """
    layer_rows = catalog.layers(channels)
    letters = list(names.ROLE_NAMES)
    named = catalog.channel_layers(channels).withColumn(
        "letter", names.ascii_upper(F.substring("short", 1, 1)))
    # Position of the first channel per letter: four minima per layer, made next to the layer rows.
    at = grid.pack_position(F.col("part_idx"), F.col("channel_idx"))
    firsts = named.groupBy("file_id", "layer").agg(*[
        F.min(F.when(F.col("letter") == c, at)).alias(f"_{c}") for c in letters])
    slot = F.lit(len(letters))
    for i, c in enumerate(letters):
        slot = F.when(at == F.col(f"_{c}"), F.lit(i)).otherwise(slot)
    display = catalog.layer_display(F.col("layer"))
    channel_rows = (
        named.join(layer_rows.select("file_id", "layer", "layer_order")
                   .join(firsts, ["file_id", "layer"]), ["file_id", "layer"])
        .withColumn("slot", slot)
        .select("file_id", "layer", "layer_order", "slot",
                F.when(F.col("slot") < len(letters), F.lit("")).otherwise(F.lower("short"))
                .alias("sort_name"),
                "part_idx", "channel_idx",
                labels.channel_line(F.col("short"), display).alias("line"),
                labels.colour_class(labels.channel_label(F.col("short"))).alias("colour"),
                F.lit(labels.CHANNEL_FONT_SIZE).alias("font_size")))
    headings = layer_rows.select(
        "file_id", "layer", "layer_order", F.lit(-1).alias("slot"), F.lit("").alias("sort_name"),
        F.col("first_part").alias("part_idx"), F.col("first_channel").alias("channel_idx"),
        labels.layer_line(display).alias("line"), F.lit(labels.DEFAULT_COLOUR).alias("colour"),
        F.lit(labels.LAYER_FONT_SIZE).alias("font_size"))
    return headings.unionByName(channel_rows)


def line_layers(tree: DataFrame) -> DataFrame:
    """J19, second half: channel line to layer per file; the last line wins."""
    place = F.struct("layer_order", "slot", "sort_name", "part_idx", "channel_idx")
    return (tree.filter("slot >= 0").groupBy("file_id", "line")
            .agg(F.max_by("layer", place).alias("layer")))


def gallery(files: DataFrame, channels: DataFrame, thumbs: DataFrame) -> DataFrame:
    """One row per readable file, sorted by name in any case, then path.

    ``thumbs`` has (file_id, t_width, t_height).  What is missing there is in ``unreadable_files``.
    """
    counted = (catalog.channel_layers(channels).select("file_id", "layer").distinct()
               .groupBy("file_id").agg(F.count(F.lit(1)).alias("n_layers")))
    # A file list of repeating paths takes so few bytes that Spark would broadcast a million of them.
    return (files.hint("merge").join(thumbs, "file_id").join(counted.hint("merge"), "file_id")
            .select(names.file_name(F.col("path")).alias("name"),
                    text.human_size(F.coalesce("size_bytes", F.lit(0).cast("bigint")))
                    .alias("size"),
                    F.concat(F.col("n_layers").cast("string"), F.lit(" layers")).alias("layers"),
                    "path", F.col("t_width").alias("width"), F.col("t_height").alias("height"))
            .orderBy(F.lower("name"), "path"))


def unreadable_files(files: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Files the gallery leaves out."""
    return files.join(thumbs.hint("merge"), "file_id", "left_anti")


def filter_names(files: DataFrame, needle: str) -> DataFrame:
    """Files whose name contains ``needle``, any case."""
    return files.filter(F.lower("file_name").contains(needle.lower()))
