"""Name resolution: layer name to R/G/B/A channels, (layer, channel) name to one channel.

Fuzzy matches ("one name contains the other") are not computed by comparing all pairs of names.
An inverted index of short substrings proposes pairs, which are then compared; the result is exact.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.functions import grid, names
from lumigrid.operators.catalog import CHANNEL_BLOCK, channel_layers
from lumigrid.scale import materialize, salted_join
from lumigrid.sources import tables

ROLES = ("r", "g", "b", "a")
# Longest substrings that names are indexed by.
GRAM = 3
LAYER, WANTED = "layer", "wanted"


def _with_grams(names_: DataFrame) -> DataFrame:
    """Add ``own``, the substrings of ``GRAM`` characters (of a shorter text itself), and ``shorter``, those of fewer.
    A substring is one number, 21 bits a character; an empty text has 0."""
    text = F.col("text")
    point = lambda i: F.ascii(F.substring(text, i, 1)).cast("bigint") + 1
    points = F.when(text != "", F.transform(F.sequence(F.lit(1), F.length(text)), point))
    spelled = names_.withColumn("points", points)
    def grams(n: int) -> Column:
        at = lambda i: sum((F.shiftleft(F.get("points", i + k), 21 * k) for k in range(1, n)), F.get("points", i))
        return F.array_distinct(F.when(F.size("points") >= n, F.transform(F.sequence(F.lit(0), F.size("points") - n), at))
                                .otherwise(F.array().cast("array<bigint>")))
    by_size = [grams(n) for n in range(1, GRAM + 1)]
    shorter = [F.when(F.size("points") > n, g).otherwise(F.array().cast("array<bigint>"))
               for n, g in enumerate(by_size[:-1], 1)]
    own = F.when(text == "", F.array(F.lit(0).cast("bigint")))
    for n, g in enumerate(by_size[:-1], 1):
        own = own.when(F.size("points") == n, g)
    return spelled.withColumns({"own": own.otherwise(by_size[-1]), "shorter": F.flatten(F.array(*shorter))}) \
        .withColumn("shorter", F.coalesce("shorter", F.array().cast("array<bigint>"))).drop("points")


def _candidates(sides: DataFrame) -> DataFrame:
    """(file_id, side, inner, outer): keys of names of this side that share the rarest gram of one of the other side.

    Names are indexed by their grams, O(length) keys a name.  A name asks the other side's index for a single one of
    its grams, that with the fewest names behind it; if one of its grams is in no name there, neither is the name.
    Names travel as digests, so a long name isn't copied once per gram.
    """
    at = ["file_id", "side", "gram"]
    index = sides.select("file_id", "side", F.col("key").alias("outer"), F.explode(F.concat("own", "shorter")).alias("gram"))
    sizes = index.groupBy(*at).agg(F.count(F.lit(1)).alias("n_names"))
    other = F.when(F.col("side") == LAYER, F.lit(WANTED)).otherwise(F.lit(LAYER)).alias("side")
    asked = sides.select("file_id", other, F.col("key").alias("inner"), F.size("own").alias("n_grams"),
                         F.explode("own").alias("gram"))
    rarest = (asked.join(sizes, at).groupBy("file_id", "side", "inner", "n_grams")
              .agg(F.count(F.lit(1)).alias("found"), F.min_by("gram", "n_names").alias("gram"))
              .filter(F.col("found") == F.col("n_grams")))
    return rarest.join(index, at).select("file_id", "side", "inner", "outer")


def matching_layers(named: DataFrame, requests: DataFrame, rule: str) -> DataFrame:
    """Distinct (file_id, lo, wanted): lower-cased layer names and the requested names they match.

    ``rule='rgba'``: either contains the other.  ``rule='channel'``: the layer contains the wanted
    name or is a prefix of it.  The empty name matches only itself.  Runs a job that writes the names.
    """
    name = F.lower("layer")
    # Written once: the index, its questions and the comparison start from it.
    sides = materialize(_with_grams(
        named.select("file_id", F.lit(LAYER).alias("side"), name.alias("text")).distinct()
             .unionByName(requests.select("file_id", F.lit(WANTED).alias("side"), name.alias("text")).distinct())
             .filter("text IS NOT NULL").withColumn("key", F.md5("text"))))
    pairs = materialize(_candidates(sides))
    texts = lambda side, key, text: sides.filter(F.col("side") == side).select(
        "file_id", F.col("key").alias(key), F.col("text").alias(text))
    lo, text = F.col("lo"), F.col("text")
    # Equal names are found from both sides.
    matches = F.when(F.col("side") == LAYER, lo.contains(text)).otherwise(
        (lo != text) & (text.contains(lo) if rule == "rgba" else text.startswith(lo)))
    keyed = pairs.select("file_id", "side", F.when(F.col("side") == LAYER, F.col("outer")).otherwise(F.col("inner")).alias("have"),
                         F.when(F.col("side") == LAYER, F.col("inner")).otherwise(F.col("outer")).alias("want"))
    # A row per request: as a broadcast it would take the driver several times its written size.
    spelled = requests.select("file_id", F.col("layer").alias("wanted"), name.alias("text")).distinct()
    return (keyed.join(texts(LAYER, "have", "lo"), ["file_id", "have"]).join(texts(WANTED, "want", "text"), ["file_id", "want"])
            .filter(matches).join(spelled.hint("merge"), ["file_id", "text"]).select("file_id", "lo", "wanted"))


def _written(channels: DataFrame) -> DataFrame:
    """The channels with their layers, written once for the several looks at them."""
    return materialize(channel_layers(channels.select("file_id", "part_idx", "part_name", "channel_idx", "full_name",
                                                      "width", "height")).withColumn("lo", F.lower("layer")))


def _distinct(requests: DataFrame, *columns: str) -> DataFrame:
    """The requests, written once, as both the match of names and the answer start from them."""
    return materialize(requests.select("file_id", *columns).distinct())


def resolve_rgba(channels: DataFrame, requests: DataFrame) -> DataFrame:
    """For requested (file_id, layer): the part and the channels that serve as R, G, B, A.

    ``source`` says how they were found: ``'layer'``, ``'first_rgba'`` (no layer matched, first
    part with plain R, G, B) or null (nothing to show).  Size columns are those of the part.
    """
    named = _written(channels)
    requests = _distinct(requests, "layer")
    pairs = matching_layers(named, requests, "rgba")
    upper = names.ascii_upper(F.col("short"))
    matched = (named.select("file_id", "lo", "part_idx", "channel_idx", "width", "height",
                            upper.alias("su"))
               .join(pairs, ["file_id", "lo"]))
    position, su = F.col("channel_idx"), F.col("su")
    full_words = [*names.ROLE_NAMES, *names.ROLE_NAMES.values()]
    # The last exact name wins, else the first that begins with the letter; alpha has no such rule.
    exact = {r: F.max(F.when(su.isin(r, w), position)) for r, w in names.ROLE_NAMES.items()}
    begins = {r: F.min(F.when(su.startswith(r) & ~su.isin(*full_words), position)) for r in "RGB"}
    # A part is aggregated block by block; three leading channels per block are enough.
    leading = lambda indexes: F.slice(F.array_sort(indexes), 1, 3)
    blocks = matched.groupBy("file_id", "wanted", "part_idx",
                             F.floor(position / CHANNEL_BLOCK).alias("_block")).agg(
        *[e.alias(f"exact_{r}") for r, e in exact.items()],
        *[b.alias(f"begins_{r}") for r, b in begins.items()],
        leading(F.collect_list("channel_idx")).alias("lead"),
        F.max("width").alias("width"), F.max("height").alias("height"))
    parts = blocks.groupBy("file_id", "wanted", "part_idx").agg(
        *[F.coalesce(F.max(f"exact_{r}"), F.min(f"begins_{r}")).alias(r.lower()) for r in "RGB"],
        F.max("exact_A").alias("a"), leading(F.flatten(F.collect_list("lead"))).alias("lead"),
        F.max("width").alias("width"), F.max("height").alias("height"))
    # What is missing is filled from the leading channels, then from the role before.
    r = F.coalesce("r", F.get("lead", F.lit(0)))
    g = F.coalesce("g", F.get("lead", F.lit(1)), r)
    b = F.coalesce("b", F.get("lead", F.lit(2)), g)
    found = parts.select("file_id", F.col("wanted").alias("layer"), "part_idx", r.alias("r"), g.alias("g"),
                         b.alias("b"), "a", "width", "height")
    view = lambda kind: F.when(F.col("part_idx").isNotNull(), F.struct("part_idx", *ROLES, "width", "height")).alias(kind)
    first_part = _first_parts(found, "file_id", "layer").select("file_id", "layer", view("by_layer"))
    plain = first_rgba(named).select("file_id", view("plain"))
    # One row per request or file, as a broadcast several times their written size.
    return (requests.join(first_part.hint("merge"), ["file_id", "layer"], "left").join(plain.hint("merge"), "file_id", "left")
            .select("file_id", "layer", F.coalesce("by_layer", "plain").alias("v"),
                    F.when(F.col("by_layer").isNotNull(), F.lit("layer"))
                    .when(F.col("plain").isNotNull(), F.lit("first_rgba")).alias("source"))
            .select("file_id", "layer", "v.*", "source"))


def _first_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of its first part.  Column by column, as numbers aggregate by hashing and a struct
    only by sorting."""
    return parts.groupBy(*keys).agg(
        *[F.min_by(c, "part_idx").alias(c) for c in (*ROLES, "width", "height")],
        F.min("part_idx").alias("part_idx"))


def first_rgba(channels: DataFrame) -> DataFrame:
    """Per file the first part that has channels named exactly R, G and B; A is optional."""
    role = lambda r: F.max(F.when(F.col("full_name") == r.upper(), F.col("channel_idx"))).alias(r)
    parts = (channels.filter(F.col("full_name").isin(*names.ROLE_NAMES))
             .groupBy("file_id", "part_idx")
             .agg(*map(role, ROLES), F.first("width").alias("width"),
                  F.first("height").alias("height"))
             .filter("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL"))
    return _first_parts(parts, "file_id").select("file_id", "part_idx", *ROLES, "width", "height")


def resolve_channel(channels: DataFrame, requests: DataFrame) -> DataFrame:
    """J06, names only: for requested (file_id, layer, channel) the one channel that is meant.

    The first part decides, then the pass (named channel before depth variant), then the order of
    channels.  Requests without an answer are in ``unresolved_channels``.
    """
    named = _written(channels)
    requests = _distinct(requests, "layer", "channel")
    pairs = matching_layers(named, requests, "channel")

    def key(kind: str, value: Column, step: int, when: Column | None = None) -> Column:
        made = F.struct(F.lit(kind).alias("kind"), value.alias("key"), F.lit(step).alias("step"))
        return made if when is None else F.when(when, made)

    # Equal short names have equal aliases, so two keys and the depth variant cover all cases.
    short, full, wanted = F.col("short"), F.col("full_name"), F.col("channel")
    offered = F.array_compact(F.array(
        key("alias", names.channel_alias(short), 1), key("full", full, 1),
        key("depth", F.lit("Z"), 2, names.is_depth_variant(short))))
    asked = F.array_compact(F.array(
        key("alias", names.channel_alias(wanted), 1), key("full", wanted, 1),
        key("depth", F.lit("Z"), 2, names.ascii_upper(wanted) == "Z")))
    have = named.select("file_id", "lo", "part_idx", "channel_idx", "width", "height",
                        F.inline(offered))
    want = (requests
            .join(pairs.withColumnRenamed("wanted", "layer"), ["file_id", "layer"])
            .select("file_id", "layer", "channel", "lo", F.inline(asked)))
    # Part, pass and channel as one number, the pass in the bit above the channel.
    rank = grid.pack_position(F.col("part_idx"), F.col("channel_idx")) + F.shiftleft(F.col("step").cast("bigint") - 1, 31)
    best = [F.min(rank).alias("best"), *[F.min_by(c, rank).alias(c) for c in ("width", "height")]]
    part = grid.unpack_position(F.col("best"))[0]
    step = F.shiftright(F.col("best").bitwiseAND(F.lit(1 << 31)), 31)
    return (have.join(want.drop("step"), ["file_id", "lo", "kind", "key"])
            .groupBy("file_id", "layer", "channel").agg(*best)
            .select("file_id", "layer", "channel", part.alias("part_idx"),
                    F.col("best").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("channel_idx"),
                    (step + 1).cast("int").alias("step"), "width", "height"))


def unresolved_channels(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests that name no channel."""
    return requests.join(resolved, ["file_id", "layer", "channel"], "left_anti")


def used_rows(table: DataFrame, **views: DataFrame) -> dict[str, DataFrame]:
    """Of ``table`` (samples or scan lines) the rows of the channels that each of ``views`` uses: results of
    ``resolve_rgba`` or of ``resolve_channel``.

    One scan serves all of them: rows that any view uses are written once, in a directory for each combination of views,
    and a view reads its directories.
    """
    key = ["file_id", "part_idx", "channel_idx"]
    bit = {name: 1 << i for i, name in enumerate(views)}

    def channels_of(name: str, view: DataFrame) -> DataFrame:
        indexes = F.array("channel_idx") if "channel_idx" in view.columns else F.array_compact(F.array(*ROLES))
        return view.select("file_id", "part_idx", F.explode(indexes).alias("channel_idx"), F.lit(bit[name]).alias("uses"))

    uses = functools.reduce(DataFrame.unionByName, [channels_of(*v) for v in views.items()])
    wanted = uses.groupBy(*key).agg(F.bit_or("uses").alias("uses"))
    picked = materialize(_looked_up(table, wanted), "uses")
    return {name: picked.filter(F.col("uses").isin([u for u in range(1 << len(bit)) if u & b])).drop("uses")
            for name, b in bit.items()}


def _looked_up(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``table`` (samples or scan lines) of the channels in ``wanted``.  If the directory of the rows
    is a column, only the directories of wanted files are read."""
    spread = ["y"] if "line" in table.columns else ["y", "x"]
    key = ["file_id", "part_idx", "channel_idx"]
    if tables.BUCKET not in table.columns:
        return salted_join(table, wanted, key, spread)
    placed = wanted.withColumn(tables.BUCKET, tables.bucket_of(F.col("file_id")))
    return salted_join(table, placed, [tables.BUCKET, *key], spread, directory=tables.BUCKET)


def extract_channel(samples: DataFrame, resolved: DataFrame) -> DataFrame:
    """J06, values: one gray image per resolved request, from samples or from scan lines."""
    v = F.col("v").cast("float")
    found = _looked_up(samples, resolved.select("file_id", "part_idx", "channel_idx", "layer", "channel"))
    if "line" in samples.columns:
        found = tables.from_scanlines(found, "layer", "channel")
    return found.select(
        "file_id", "layer", "channel", "y", "x", v.alias("r"), v.alias("g"), v.alias("b"),
        F.lit(1.0).cast("float").alias("a"))


def _roles(resolved: DataFrame, alpha_part: Column) -> DataFrame:
    """(file, part, channel) to the roles it plays, one row per layer request."""
    each = F.array(*[F.struct(
        (alpha_part if r == "a" else F.col("part_idx")).alias("part_idx"),
        F.col(r).alias("channel_idx"), F.lit(r).alias("role")) for r in ROLES])
    return (resolved.select("file_id", "layer", F.explode(each).alias("e"))
            .select("file_id", "layer", "e.*").filter("channel_idx IS NOT NULL")
            .groupBy("file_id", "layer", "part_idx", "channel_idx")
            .agg(*[F.max(F.col("role") == r).alias(f"is_{r}") for r in ROLES]))


def assemble_pixels(samples: DataFrame, resolved: DataFrame,
                    alpha_part: str = "part_idx") -> DataFrame:
    """Gather the resolved channels into r, g, b, a; alpha is 1 where there is none.

    ``samples`` may be scan lines: then whole lines are put together and split into pixels in place, so an
    exchange carries a row per line, and none is needed where the table is bucketed (``tables.save_lines``).
    A sample or line is sent on once per request, whatever number of roles it plays, and grouped by its
    position, so neither a big image nor a hot file gathers in one task.
    """
    used = _looked_up(samples, _roles(resolved, F.col(alpha_part)))
    if "line" in samples.columns:
        return _pixels_of_lines(used)
    value = lambda r: F.max(F.when(F.col(f"is_{r}"), F.col("v"))).cast("float")
    return used.groupBy("file_id", "layer", "y", "x").agg(
        *[value(r).alias(r) for r in "rgb"],
        F.coalesce(value("a"), F.lit(1.0).cast("float")).alias("a"))


def _pixels_of_lines(used: DataFrame) -> DataFrame:
    """Pixels from the lines of (file, layer, y) and the roles these play."""
    line = lambda r: F.first(F.when(F.col(f"is_{r}"), F.col("line")), ignorenulls=True)
    together = used.groupBy("file_id", "layer", "y").agg(*[line(r).alias(r) for r in ROLES])
    # Lines may be missing or shorter than others: such places are null, as are those of no sample at all.
    none = F.array().cast("array<float>")
    cells = F.arrays_zip(*[F.coalesce(r, none).alias(r) for r in ROLES])
    return (together.select("file_id", "layer", "y", F.posexplode(cells).alias("x", "c"))
            .filter(F.coalesce(*[F.col(f"c.{r}") for r in ROLES]).isNotNull())
            .select("file_id", "layer", "y", "x", *[F.col(f"c.{r}").alias(r) for r in "rgb"],
                    F.coalesce("c.a", F.lit(1.0).cast("float")).alias("a")))


def id_to_alpha(samples: DataFrame, resolved: DataFrame, ids: DataFrame) -> DataFrame:
    """Colour of one layer with an object-id channel as alpha.

    ``resolved`` from ``resolve_rgba``, ``ids`` from ``resolve_channel``, one row per file.  Files
    whose two parts differ in size are left out; ``mismatched_sizes`` lists them.
    """
    chosen = ids.select("file_id", F.col("part_idx").alias("id_part"), F.col("channel_idx")
                        .alias("id_channel"), "width", "height")
    merged = (resolved.join(chosen, ["file_id", "width", "height"])
              .withColumn("a", F.col("id_channel")))
    return assemble_pixels(samples, merged, "id_part")


def mismatched_sizes(resolved: DataFrame, ids: DataFrame) -> DataFrame:
    """Files whose colour part has no id channel of equal size."""
    return resolved.join(ids.select("file_id", "width", "height"),
                         ["file_id", "width", "height"], "left_anti").select("file_id", "layer")
