"""What the layer tree shows for a layer or channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumigrid.functions.names import ROLE_NAMES, ascii_upper

# Marks, labels and font sizes of tree rows.
FOLDER = "📁"
BULLET = "•"
MARKS = {"R": "🔴", "G": "🟢", "B": "🔵", "A": "⚪"}
LABELS = {"R": "Red", "G": "Green", "B": "Blue", "A": "Alpha"}
COLOUR_LETTERS = ["R", "G", "B"]
DEFAULT_COLOUR = "default"
LAYER_FONT_SIZE, CHANNEL_FONT_SIZE = 12, 10
INDENT = "    "


def _by_letter(short: Column, values: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for role in ROLE_NAMES:
        out = F.when(short.isin(role, role.lower()), F.lit(values[role])).otherwise(out)
    return out


def channel_label(short: Column) -> Column:
    """A colour word for the single letters, else the name itself."""
    return _by_letter(short, LABELS, short)


def channel_mark(short: Column) -> Column:
    return _by_letter(short, MARKS, F.lit(BULLET))


def colour_class(label: Column) -> Column:
    """Text colour by the first letter of the label."""
    first = ascii_upper(F.substring(label, 1, 1))
    return F.when(first.isin(*COLOUR_LETTERS), first).otherwise(F.lit(DEFAULT_COLOUR))


def layer_line(display: Column) -> Column:
    return F.concat(F.lit(f"{FOLDER} "), display)


def channel_line(short: Column, display: Column) -> Column:
    return F.concat(F.lit(INDENT), channel_mark(short), F.lit(" "), channel_label(short),
                    F.lit(" @"), display)


def selected_line(short: Column, display: Column) -> Column:
    """How a chosen channel is shown: marked for the single letters, else bare."""
    single = short.isin(*[c for r in ROLE_NAMES for c in (r, r.lower())])
    return F.when(single, channel_line(short, display)).otherwise(
        F.concat(short, F.lit(" @"), display))
