"""Layer, channel and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, aliases and patterns that the results depend on.
WHITESPACE = (" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROLE_NAMES = {"R": "RED", "G": "GREEN", "B": "BLUE", "A": "ALPHA"}
PRIORITY_LAYERS = ["beauty", "rgba", "default", "combined"]
NO_LAYER = "Layer 1"
BASE_LAYER_LABEL = "Beauty"
CHANNEL_GROUPS = ["RGB", "Alpha", "Depth", "Cryptomatte", "Normals", "Motion", "Inne"]
GROUP_PATTERNS = {
    "RGB": "^[RGB]$",
    "Alpha": "^(A$|ALPHA)",
    "Depth": "^Z$|DEPTH|^DISTANCE$",
    "Cryptomatte": "CRYPT|MATTE",
    "Normals": "^N|NORMAL",
    "Motion": "V[XYZ]$|MOTION|SPEED",
}


def trimmed(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(WHITESPACE))


def ascii_upper(c: Column) -> Column:
    """Upper case of the ASCII letters only."""
    return F.translate(c, LOWER_ASCII, UPPER_ASCII)


def short_name(full: Column) -> Column:
    """E01, second half: the text after the last dot."""
    return F.substring_index(full, ".", -1)


def layer_name(full: Column, part_name: Column) -> Column:
    """E01, first half: the part's own name if it has one, else the text before the last dot."""
    prefix = F.length(full) - F.length(short_name(full)) - 1
    return F.coalesce(part_name, F.substring(full, F.lit(1), F.greatest(prefix, F.lit(0))))


def file_name(path: Column, fallback: str = "?") -> Column:
    """Last segment of a path, slashes and ``/.`` at its end aside; ``fallback`` where there is none."""
    last = F.element_at(F.split(F.regexp_replace(path, r"(?:/\.?)++$", ""), "/"), -1)
    return F.when(last.isNull() | last.isin("", "..", "."), F.lit(fallback)).otherwise(last)


def channel_alias(name: Column) -> Column:
    """Canonical short name; words that merely begin with a colour name count too."""
    t = trimmed(name)
    u = ascii_upper(t)
    out = t
    for role, word in ROLE_NAMES.items():
        out = F.when((u == role) | u.startswith(word), F.lit(role)).otherwise(out)
    return out


def display_to_short(name: Column) -> Column:
    """R/G/B/A for the exact letters and words, anything else untouched (not even trimmed)."""
    u = ascii_upper(trimmed(name))
    out = name
    for role, word in ROLE_NAMES.items():
        out = F.when(u.isin(role, word), F.lit(role)).otherwise(out)
    return out


def channel_group(upper_short: Column) -> Column:
    """Group of a channel; the first matching pattern decides."""
    first, *rest = GROUP_PATTERNS.items()
    out = F.when(upper_short.rlike(first[1]), F.lit(first[0]))
    for group, pattern in rest:
        out = out.when(upper_short.rlike(pattern), F.lit(group))
    return out.otherwise(F.lit(CHANNEL_GROUPS[-1]))


def _both_or_neither_empty(lo: Column, wa: Column, unless_empty: Column) -> Column:
    return F.when((lo == "") | (wa == ""), lo == wa).otherwise(unless_empty)


def layer_match_rgba(layer: Column, wanted: Column) -> Column:
    """One name contains the other, any case; an empty name only matches an empty one."""
    lo, wa = F.lower(layer), F.lower(wanted)
    return _both_or_neither_empty(lo, wa, lo.contains(wa) | wa.contains(lo))


def layer_match_channel(layer: Column, wanted: Column) -> Column:
    """The layer contains the wanted name or is a prefix of it; empty as in E07."""
    lo, wa = F.lower(layer), F.lower(wanted)
    return _both_or_neither_empty(lo, wa, lo.contains(wa) | wa.startswith(lo))


def is_role(short: Column, role: str) -> Column:
    """The trimmed short name is exactly the letter, any case."""
    return ascii_upper(trimmed(short)) == role


def has_rgb(short: Column) -> Column:
    """E09, an aggregate: R, G and B are all present among the short names."""
    return (F.bool_or(is_role(short, "R")) & F.bool_or(is_role(short, "G"))
            & F.bool_or(is_role(short, "B")))


def is_depth_name(channel: Column) -> Column:
    """The channel is shown as depth."""
    u = ascii_upper(channel)
    return (u == "Z") | u.contains("DEPTH")


def is_depth_variant(short: Column) -> Column:
    """Channels that a request for ``Z`` may fall back to."""
    return is_depth_name(short) | (ascii_upper(short) == "DISTANCE")
