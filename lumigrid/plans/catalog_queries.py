"""Checked queries on the catalog: name expressions, jobs J01-J06, J13-J21, variants D6, D7."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumigrid.functions import labels, names, text
from lumigrid.operators import catalog, reports, resample, resolve, selection
from lumigrid.plans.oracle_fixtures import (alias, group_of, human, match_channel, match_rgba,
                                            trim, upper, with_ctes)
from lumigrid.plans.registry import checked
from lumigrid.sources import fixtures, listing

AT = "file_id, part_idx, channel_idx"


def _named(spark, sf):
    return catalog.channel_layers(fixtures.channels(spark, sf))


def _of_channels(spark, sf, **columns):
    return _named(spark, sf).select("file_id", "part_idx", "channel_idx",
                                    *[c.alias(n) for n, c in columns.items()])


# Name expressions --------------------------------------------------------------------------------

@checked("E01_split_layer_short", with_ctes(f"SELECT {AT}, layer, short FROM lc"))
def _(spark, sf):
    return _of_channels(spark, sf, layer=F.col("layer"), short=F.col("short"))


@checked("E02_human_size", with_ctes(f"SELECT file_id, {human('size_bytes')} AS size FROM files"))
def _(spark, sf):
    return fixtures.files(spark, sf).select(
        "file_id", text.human_size(F.col("size_bytes")).alias("size"))


@checked("E03_file_name", with_ctes(
    "SELECT file_id, CASE WHEN file_id % 6 IN (4, 5) THEN '?' ELSE file_name END AS name FROM files"))
def _(spark, sf):
    ends = F.array(*[F.lit(e) for e in ("", "/", "/.", "//./", "/..", "/../")])
    path = F.concat("path", F.get(ends, (F.col("file_id") % 6).cast("int")))
    return fixtures.files(spark, sf).select("file_id", names.file_name(path).alias("name"))


@checked("E04_channel_alias", with_ctes(f"SELECT {AT}, {alias('short')} AS canon FROM lc"))
def _(spark, sf):
    return _of_channels(spark, sf, canon=names.channel_alias(F.col("short")))


_EXACT = " ".join(f"WHEN {upper(trim('short'))} IN ('{r}', '{w}') THEN '{r}'"
                  for r, w in [("R", "RED"), ("G", "GREEN"), ("B", "BLUE"), ("A", "ALPHA")])


@checked("E05_display_to_short",
         with_ctes(f"SELECT {AT}, CASE {_EXACT} ELSE short END AS chosen FROM lc"))
def _(spark, sf):
    return _of_channels(spark, sf, chosen=names.display_to_short(F.col("short")))


@checked("E06_channel_group",
         with_ctes(f"SELECT {AT}, {group_of(upper('short'))} AS kind FROM lc"))
def _(spark, sf):
    return _of_channels(spark, sf, kind=names.channel_group(names.ascii_upper(F.col("short"))))


def _against_best(spark, sf, rule):
    found = _named(spark, sf).join(catalog.best_layer(fixtures.channels(spark, sf)), "file_id")
    return found.select("file_id", "part_idx", "channel_idx",
                        rule(F.col("layer"), F.col("best_layer")).alias("matches"))


def _against_best_sql(rule) -> str:
    return with_ctes(f"SELECT {AT}, {rule('lower(layer)', 'lower(best_layer)')} AS matches "
                     "FROM lc JOIN best USING (file_id)")


@checked("E07_layer_match_rgba", _against_best_sql(match_rgba))
def _(spark, sf):
    return _against_best(spark, sf, names.layer_match_rgba)


@checked("E08_layer_match_channel", _against_best_sql(match_channel))
def _(spark, sf):
    return _against_best(spark, sf, names.layer_match_channel)


@checked("E09_has_rgb", with_ctes("SELECT file_id, layer, has_rgb FROM lay"))
def _(spark, sf):
    return _named(spark, sf).groupBy("file_id", "layer").agg(
        names.has_rgb(F.col("short")).alias("has_rgb"))


def _pretty(v: str) -> str:
    return (f"CASE WHEN try_cast(trim({v}) AS DOUBLE) IS NOT NULL "
            f"THEN format('{{:.3f}}', try_cast(trim({v}) AS DOUBLE)) ELSE {v} END")


def _mined(v: str, pattern: str, dtype: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({v}, '{pattern}'), "
            f"lambda t: try_cast(t AS {dtype})), lambda n: n IS NOT NULL)")


def _window(v: str) -> str:
    n = _mined(v, "[0-9-]+", "BIGINT")
    at = lambda i, need: f"CASE WHEN len({n}) >= {need} THEN ({n})[{i}] ELSE 0 END"
    return (f"'position: (' || {at(1, 2)} || ', ' || {at(2, 2)} || '); size: ' || {at(3, 4)} "
            f"|| 'x' || {at(4, 4)}")


def _chroma(v: str) -> str:
    n = _mined(v, "[0-9.-]+", "DOUBLE")
    at = lambda i, need: (f"format('{{:.3f}}', CASE WHEN len({n}) >= {need} THEN ({n})[{i}] "
                          "ELSE 0::DOUBLE END)")
    return " || '  ' || ".join(
        f"'{c}: (' || {at(2 * k + 1, 2 * k + 2)} || ',' || {at(2 * k + 2, 2 * k + 2)} || ')'"
        for k, c in enumerate("RGBW"))


def _code(v: str) -> str:
    return f"replace(replace(replace({v}, '{{', ''), '}}', ''), ',', ' ')"


_HEADER_KEY = ("CASE WHEN lower(trim(name)) IN ('pixel_aspect', 'pixel_aspect_ratio') "
               "THEN 'pixel_aspect' WHEN lower(trim(name)) IN ('display_window', "
               "'chromaticities', 'time_code') THEN lower(trim(name)) ELSE trim(name) END")
_HEADER_VALUE = (f"CASE {_HEADER_KEY} WHEN 'display_window' THEN {_window('value')} "
                 f"WHEN 'pixel_aspect' THEN {_pretty('value')} "
                 f"WHEN 'chromaticities' THEN {_chroma('value')} "
                 f"WHEN 'time_code' THEN {_code('value')} ELSE value END")


def _of_attrs(spark, sf, column):
    return fixtures.header_attrs(spark, sf).select("file_id", "ord", column.alias("shown"))


def _of_attrs_sql(expression: str) -> str:
    return with_ctes(f"SELECT file_id, ord, {expression} AS shown FROM hattrs")


@checked("E17_pretty_number", _of_attrs_sql(_pretty("value")))
def _(spark, sf):
    return _of_attrs(spark, sf, text.pretty_number(F.col("value"), 3))


@checked("E18_ints_in_text",
         _of_attrs_sql(f"array_to_string({_mined('value', '[0-9-]+', 'BIGINT')}, ' ')"))
def _(spark, sf):
    return _of_attrs(spark, sf, F.array_join(
        text.ints_in_text(F.col("value")).cast("array<string>"), " "))


@checked("E19_pretty_display_window", _of_attrs_sql(_window("value")))
def _(spark, sf):
    return _of_attrs(spark, sf, text.pretty_display_window(F.col("value")))


@checked("E20_pretty_chromaticities", _of_attrs_sql(_chroma("value")))
def _(spark, sf):
    return _of_attrs(spark, sf, text.pretty_chromaticities(F.col("value")))


@checked("E21_pretty_time_code", _of_attrs_sql(_code("value")))
def _(spark, sf):
    return _of_attrs(spark, sf, text.pretty_time_code(F.col("value")))


@checked("E22_header_key", _of_attrs_sql(_HEADER_KEY))
def _(spark, sf):
    return _of_attrs(spark, sf, text.header_key(F.col("name")))


@checked("E23_is_depth_name", with_ctes(
    f"SELECT {AT}, {upper('short')} = 'Z' OR contains({upper('short')}, 'DEPTH') AS depth FROM lc"))
def _(spark, sf):
    return _of_channels(spark, sf, depth=names.is_depth_name(F.col("short")))


def _label(c: str, values: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {c} IN ('{r}', '{r.lower()}') THEN '{values[r]}'" for r in "RGBA")
    return f"CASE {whens} ELSE {otherwise} END"


_LABEL = _label("short", {"R": "Red", "G": "Green", "B": "Blue", "A": "Alpha"}, "short")
_COLOUR = (f"CASE WHEN upper(({_LABEL})[1]) IN ('R', 'G', 'B') THEN upper(({_LABEL})[1]) "
           "ELSE 'default' END")


@checked("E24_channel_label", with_ctes(
    f"SELECT {AT}, {_LABEL} AS label, {_COLOUR} AS colour FROM lc"))
def _(spark, sf):
    label = labels.channel_label(F.col("short"))
    return _of_channels(spark, sf, label=label, colour=labels.colour_class(label))


# Files and layers --------------------------------------------------------------------------------

_EXR = "regexp_matches(lower(file_name), '.\\.exr$')"


@checked("J01_file_inventory", with_ctes(
    f"SELECT file_id, path, file_name, size_bytes FROM files WHERE {_EXR}"))
def _(spark, sf):
    return listing.image_files(fixtures.files(spark, sf))


@checked("J02_logical_layers", with_ctes(
    "SELECT file_id, layer_order, layer, part_idx, channel_idx, short FROM lc JOIN lay "
    "USING (file_id, layer)"))
def logical_layers(spark, sf):
    return catalog.logical_layers(fixtures.channels(spark, sf))


@checked("J03_best_layer", with_ctes("SELECT file_id, best_layer, plan FROM best"))
def best_layer(spark, sf):
    return catalog.best_layer(fixtures.channels(spark, sf))


@checked("J03_best_layer_all_files", with_ctes(
    "SELECT file_id, coalesce(best_layer, 'Layer 1') AS best_layer, plan "
    "FROM files LEFT JOIN best USING (file_id)"))
def _(spark, sf):
    return catalog.best_layer(fixtures.channels(spark, sf), fixtures.files(spark, sf))


# Resolution --------------------------------------------------------------------------------------

UNKNOWN = "no such layer"


def layer_requests(spark, sf):
    """Every layer by name, the best one, part of a name, and a name that matches nothing."""
    named = _named(spark, sf).select("file_id", "layer")
    best = catalog.best_layer(fixtures.channels(spark, sf)).select(
        "file_id", F.col("best_layer").alias("layer"))
    other = named.select("file_id", F.explode(F.array(F.lit("DIFF"), F.lit(UNKNOWN))).alias("layer"))
    return named.unionByName(best).unionByName(other).distinct()


_RESOLVE = {
    "reqs": "SELECT file_id, layer FROM lc UNION SELECT file_id, best_layer FROM best UNION "
            f"SELECT file_id, 'DIFF' FROM lc UNION SELECT file_id, '{UNKNOWN}' FROM lc",
    "matched": f"""SELECT q.file_id, q.layer, c.part_idx, c.channel_idx, {upper('c.short')} AS su,
        c.width, c.height, min(c.part_idx) OVER (PARTITION BY q.file_id, q.layer) AS first_part
        FROM reqs q JOIN lc c ON c.file_id = q.file_id
        AND {match_rgba('lower(c.layer)', 'lower(q.layer)')}""",
    "slots": """SELECT file_id, layer, part_idx,
        coalesce(max(channel_idx) FILTER (su IN ('R', 'RED')),
            min(channel_idx) FILTER (su[1] = 'R' AND su <> 'R' AND su <> 'RED')) AS r,
        coalesce(max(channel_idx) FILTER (su IN ('G', 'GREEN')),
            min(channel_idx) FILTER (su[1] = 'G' AND su <> 'G' AND su <> 'GREEN')) AS g,
        coalesce(max(channel_idx) FILTER (su IN ('B', 'BLUE')),
            min(channel_idx) FILTER (su[1] = 'B' AND su <> 'B' AND su <> 'BLUE')) AS b,
        max(channel_idx) FILTER (su IN ('A', 'ALPHA')) AS a,
        list(channel_idx ORDER BY channel_idx) AS grp, max(width) AS width, max(height) AS height
        FROM matched WHERE part_idx = first_part GROUP BY file_id, layer, part_idx""",
    "withr": "SELECT * EXCLUDE (r), coalesce(r, grp[1]) AS r FROM slots",
    "withg": "SELECT * EXCLUDE (g), coalesce(g, grp[2], r) AS g FROM withr",
    "filled": "SELECT * EXCLUDE (b, grp), coalesce(b, grp[3], g) AS b FROM withg",
    "plain": """SELECT * FROM (SELECT file_id, part_idx, max(CASE full_name WHEN 'R' THEN
        channel_idx END) AS r, max(CASE full_name WHEN 'G' THEN channel_idx END) AS g,
        max(CASE full_name WHEN 'B' THEN channel_idx END) AS b,
        max(CASE full_name WHEN 'A' THEN channel_idx END) AS a, max(width) AS width,
        max(height) AS height FROM channels GROUP BY file_id, part_idx)
        WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY part_idx) = 1""",
    "resolved": """SELECT file_id, layer, part_idx, r, g, b, a, width, height, 'layer' AS source
        FROM filled UNION ALL SELECT q.file_id, q.layer, part_idx, r, g, b, a, width, height,
        CASE WHEN part_idx IS NOT NULL THEN 'first_rgba' END FROM reqs q LEFT JOIN plain p USING
        (file_id) WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.file_id = q.file_id
        AND f.layer = q.layer)""",
    "bestres": "SELECT r.* FROM resolved r JOIN best b ON b.file_id = r.file_id AND "
               "b.best_layer = r.layer",
    "assembled": """SELECT q.file_id, q.layer, s.y, s.x,
        max(v) FILTER (s.channel_idx = r AND s.part_idx = q.part_idx) AS r,
        max(v) FILTER (s.channel_idx = g AND s.part_idx = q.part_idx) AS g,
        max(v) FILTER (s.channel_idx = b AND s.part_idx = q.part_idx) AS b,
        coalesce(max(v) FILTER (s.channel_idx = a AND s.part_idx = q.part_idx), 1::FLOAT) AS a
        FROM bestres q JOIN samples s ON s.file_id = q.file_id
        GROUP BY q.file_id, q.layer, s.y, s.x""",
}


@checked("J04_resolve_rgba", with_ctes(
    "SELECT file_id, layer, part_idx, r, g, b, a, width, height, source FROM resolved", _RESOLVE))
def resolve_rgba(spark, sf):
    return resolve.resolve_rgba(fixtures.channels(spark, sf), layer_requests(spark, sf))


def best_requests(spark, sf):
    return catalog.best_layer(fixtures.channels(spark, sf)).select(
        "file_id", F.col("best_layer").alias("layer"))


def assembled(spark, sf):
    resolved = resolve.resolve_rgba(fixtures.channels(spark, sf), best_requests(spark, sf))
    return resolve.assemble_pixels(fixtures.scanlines(spark, sf), resolved)


_ASSEMBLED = with_ctes("SELECT file_id, layer, y, x, r, g, b, a FROM assembled", _RESOLVE)


@checked("J05_assemble_pixels", _ASSEMBLED)
def assemble_pixels(spark, sf):
    return assembled(spark, sf)


@checked("J05_assemble_samples", _ASSEMBLED)
def assemble_samples(spark, sf):
    resolved = resolve.resolve_rgba(fixtures.channels(spark, sf), best_requests(spark, sf))
    return resolve.assemble_pixels(fixtures.samples(spark, sf), resolved)


def channel_requests(spark, sf):
    """Every channel by its short name, and the unnamed layer's Z."""
    named = _named(spark, sf)
    return (named.select("file_id", "layer", F.col("short").alias("channel"))
            .unionByName(named.select("file_id", F.lit("").alias("layer"),
                                      F.lit("Z").alias("channel")))
            .unionByName(named.select("file_id", F.lit("diffuse_dir").alias("layer"),
                                      F.lit(" red").alias("channel")))
            .distinct())


_CHANNEL = {
    "asked": "SELECT file_id, layer, short AS channel FROM lc UNION SELECT file_id, '', 'Z' FROM lc "
             "UNION SELECT file_id, 'diffuse_dir', ' red' FROM lc",
    "hits": f"""SELECT q.file_id, q.layer, q.channel, c.part_idx, c.channel_idx, c.width, c.height,
        CASE WHEN c.short = q.channel OR c.full_name = q.channel
            OR {alias('c.short')} = {alias('q.channel')} THEN 1
        WHEN {upper('q.channel')} = 'Z' AND ({upper('c.short')} IN ('Z', 'DISTANCE')
            OR contains({upper('c.short')}, 'DEPTH')) THEN 2 END AS step
        FROM asked q JOIN lc c ON c.file_id = q.file_id
        AND {match_channel('lower(c.layer)', 'lower(q.layer)')}""",
    "one": """SELECT file_id, layer, channel, part_idx, channel_idx, step, width, height FROM hits
        WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, layer, channel
        ORDER BY part_idx, step, channel_idx) = 1""",
}


@checked("J06_resolve_channel", with_ctes(
    "SELECT file_id, layer, channel, part_idx, channel_idx, step, width, height FROM one", _CHANNEL))
def resolve_channel(spark, sf):
    return resolve.resolve_channel(fixtures.channels(spark, sf), channel_requests(spark, sf))


@checked("J06_unresolved_channels", with_ctes(
    "SELECT file_id, layer, channel FROM asked q WHERE NOT EXISTS (SELECT 1 FROM one WHERE "
    "one.file_id = q.file_id AND one.layer = q.layer AND one.channel = q.channel)",
    _CHANNEL))
def _(spark, sf):
    asked = channel_requests(spark, sf)
    return resolve.unresolved_channels(
        asked, resolve.resolve_channel(fixtures.channels(spark, sf), asked))


_EXTRACTED = with_ctes(
    "SELECT file_id, layer, channel, s.y, s.x, s.v AS r, s.v AS g, s.v AS b, 1::FLOAT AS a "
    "FROM one JOIN samples s USING (file_id, part_idx, channel_idx)", _CHANNEL)


@checked("J06_extract_channel", _EXTRACTED)
def extract_channel(spark, sf):
    resolved = resolve.resolve_channel(fixtures.channels(spark, sf), channel_requests(spark, sf))
    return resolve.extract_channel(fixtures.samples(spark, sf), resolved)


@checked("J06_extract_lines", _EXTRACTED)
def extract_lines(spark, sf):
    resolved = resolve.resolve_channel(fixtures.channels(spark, sf), channel_requests(spark, sf))
    return resolve.extract_channel(fixtures.scanlines(spark, sf), resolved)


_ID_SQL = {**_RESOLVE, **{k: v for k, v in _CHANNEL.items() if k != "asked"},
           "asked": "SELECT DISTINCT file_id, '' AS layer, 'Z' AS channel FROM lc",
           "merged": "SELECT q.*, o.part_idx AS id_part, o.channel_idx AS id_channel FROM bestres q "
                     "JOIN one o USING (file_id, width, height)"}


@checked("D6_id_to_alpha", with_ctes(
    """SELECT q.file_id, q.layer, s.y, s.x,
        max(v) FILTER (s.channel_idx = r AND s.part_idx = q.part_idx) AS r,
        max(v) FILTER (s.channel_idx = g AND s.part_idx = q.part_idx) AS g,
        max(v) FILTER (s.channel_idx = b AND s.part_idx = q.part_idx) AS b,
        coalesce(max(v) FILTER (s.channel_idx = id_channel AND s.part_idx = id_part), 1::FLOAT) AS a
        FROM merged q JOIN samples s ON s.file_id = q.file_id
        GROUP BY q.file_id, q.layer, s.y, s.x""", _ID_SQL))
def _(spark, sf):
    channels = fixtures.channels(spark, sf)
    asked = channels.select("file_id", F.lit("").alias("layer"), F.lit("Z").alias("channel")).distinct()
    return resolve.id_to_alpha(
        fixtures.scanlines(spark, sf), resolve.resolve_rgba(channels, best_requests(spark, sf)),
        resolve.resolve_channel(channels, asked))


# The id part of every third file is declared one line higher.
@checked("D6_mismatched_sizes", with_ctes(
    """SELECT q.file_id, q.layer FROM bestres q WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.file_id = q.file_id
        AND o.width = q.width AND o.height + CASE WHEN o.file_id % 3 = 0 THEN 1 ELSE 0 END = q.height)""", _ID_SQL))
def _(spark, sf):
    channels = fixtures.channels(spark, sf)
    asked = channels.select("file_id", F.lit("").alias("layer"), F.lit("Z").alias("channel")).distinct()
    ids = resolve.resolve_channel(channels, asked).withColumn(
        "height", F.col("height") + F.when(F.col("file_id") % 3 == 0, 1).otherwise(0))
    return resolve.mismatched_sizes(resolve.resolve_rgba(channels, best_requests(spark, sf)), ids)


# Reports -----------------------------------------------------------------------------------------

_THUMBS = """SELECT file_id, cast(floor((width::FLOAT * (150::FLOAT / height::FLOAT)::FLOAT)::FLOAT)
    AS INTEGER) AS tw FROM bestres WHERE part_idx IS NOT NULL"""


def _thumb_sizes(spark, sf):
    resolved = resolve.resolve_rgba(fixtures.channels(spark, sf), best_requests(spark, sf))
    return resample.thumb_dims(resolved.filter("part_idx IS NOT NULL")
                               .select("file_id", "width", "height"))


@checked("J13_gallery", with_ctes(
    f"SELECT file_name AS name, {human('size_bytes')} AS size, n || ' layers' AS layers, path, "
    f"tw AS width, 150 AS height FROM files JOIN thumbs USING (file_id) JOIN (SELECT file_id, "
    f"count(DISTINCT layer) AS n FROM lc GROUP BY file_id) USING (file_id) WHERE {_EXR}",
    {**_RESOLVE, "thumbs": _THUMBS}))
def gallery(spark, sf):
    return reports.gallery(listing.image_files(fixtures.files(spark, sf)),
                           fixtures.channels(spark, sf), _thumb_sizes(spark, sf))


@checked("J13_unreadable_files", with_ctes(
    f"SELECT file_id, path, file_name, size_bytes FROM files WHERE {_EXR} AND file_id NOT IN "
    "(SELECT file_id FROM thumbs)", {**_RESOLVE, "thumbs": _THUMBS}))
def _(spark, sf):
    return reports.unreadable_files(listing.image_files(fixtures.files(spark, sf)),
                                    _thumb_sizes(spark, sf))


_GROUPS = {
    "kinds": f"SELECT *, {group_of(upper('short'))} AS group_name FROM lc",
    "groupdim": "SELECT unnest(range(7))::INTEGER AS group_pos, unnest(["
                + "'RGB', 'Alpha', 'Depth', 'Cryptomatte', 'Normals', 'Motion', 'Inne']) AS group_name",
    "allgroups": """SELECT p.file_id, p.part_idx, group_pos, d.group_name, lower(k.short) AS
        sort_name, k.channel_idx, k.short FROM (SELECT DISTINCT file_id, part_idx FROM channels) p
        CROSS JOIN groupdim d LEFT JOIN kinds k ON k.file_id = p.file_id AND
        k.part_idx = p.part_idx AND k.group_name = d.group_name""",
}


@checked("J14_channel_groups", with_ctes(
    "SELECT file_id, part_idx, group_pos, group_name, sort_name, channel_idx, short FROM allgroups",
    _GROUPS))
def channel_groups(spark, sf):
    return catalog.channel_groups(fixtures.channels(spark, sf))


_PARTS = {
    "parts": "SELECT *, CASE WHEN name <> '' THEN 1 ELSE 0 END AS named, lower(name) AS sort_name "
             "FROM (SELECT DISTINCT file_id, part_idx, coalesce(part_name, '') AS name, width, "
             "height FROM channels)",
}


@checked("J15_layer_metadata", with_ctes(
    "SELECT p.file_id, p.part_idx, p.name, width, height, named, p.sort_name, section, pos, key, "
    "value, sort_value, channel_idx FROM parts p JOIN detail d ON d.file_id = p.file_id AND "
    "d.part_idx = p.part_idx", {
        **_GROUPS, **_PARTS,
        "detail": "SELECT file_id, part_idx, 'attribute' AS section, ord AS pos, name AS key, value, "
                  "NULL::VARCHAR AS sort_value, NULL::INTEGER AS channel_idx FROM pattrs UNION ALL "
                  "SELECT file_id, part_idx, 'group', group_pos, group_name, short, sort_name, "
                  "channel_idx FROM allgroups"}))
def layer_metadata(spark, sf):
    return reports.layer_metadata(fixtures.channels(spark, sf), fixtures.attrs(spark, sf))


_ENTRIES = {
    **_PARTS,
    "known": "SELECT f.*, n_parts FROM files f JOIN (SELECT file_id, count(*) AS n_parts FROM parts "
             "GROUP BY file_id) USING (file_id)",
    "fixedrows": f"""SELECT file_id, 0 AS section, -1 AS ord, 'Ogólne' AS key, '' AS value, 'title' AS
        kind FROM known UNION ALL SELECT file_id, 0, 0, 'Ścieżka', path, 'item' FROM known
        UNION ALL SELECT file_id, 0, 1, 'Rozmiar pliku', {human('size_bytes')}, 'item' FROM known
        UNION ALL SELECT file_id, 0, 2, 'Warstwy', n_parts::VARCHAR, 'item' FROM known
        UNION ALL SELECT file_id, 1, -1, 'Nagłówek', '', 'title' FROM known
        UNION ALL SELECT h.file_id, 1, h.ord, h.name, h.value, 'header' FROM hattrs h
            JOIN known k ON k.file_id = h.file_id""",
    "partrows": """SELECT p.file_id, 2 AS section, named, sort_name, p.part_idx, -2 AS ord,
        CASE WHEN name = '' THEN '(domyślna)' ELSE name END AS key, width || 'x' || height AS value,
        'part' AS kind FROM parts p JOIN known k ON k.file_id = p.file_id UNION ALL
        SELECT a.file_id, 2, named, sort_name, a.part_idx, a.ord, a.name, a.value, 'attr' FROM pattrs a
        JOIN parts p ON p.file_id = a.file_id AND p.part_idx = a.part_idx
        JOIN known k ON k.file_id = a.file_id""",
    "entries": "SELECT file_id, section, 0 AS named, '' AS sort_name, 0 AS part_idx, ord, key, value, "
               "kind FROM fixedrows UNION ALL SELECT * FROM partrows",
}
_KEYS = "file_id, section, named, sort_name, part_idx"


@checked("J16_metadata_rows", with_ctes(
    f"""SELECT {_KEYS}, ord, CASE WHEN kind = 'header' THEN {_HEADER_KEY.replace('name', 'key')}
        WHEN kind = 'attr' THEN CASE WHEN trim(key) = '' THEN 'Atrybut' ELSE trim(key) END
        WHEN kind = 'part' THEN 'Warstwa: ' || key ELSE key END AS key,
        CASE WHEN kind = 'header' THEN {_HEADER_VALUE.replace('name', 'key')}
        WHEN kind = 'part' THEN '' ELSE value END AS value FROM entries
        UNION ALL SELECT {_KEYS}, -1, 'Wymiary', value FROM entries WHERE kind = 'part'""", _ENTRIES))
def metadata_rows(spark, sf):
    return reports.metadata_rows(fixtures.files(spark, sf), fixtures.channels(spark, sf),
                                 fixtures.attrs(spark, sf))


@checked("J17_metadata_lines", with_ctes(
    f"""SELECT {_KEYS}, ord, CASE kind WHEN 'title' THEN '[' || key || ']'
        WHEN 'part' THEN 'Warstwa: ' || key || '  — ' || value
        ELSE CASE WHEN kind = 'attr' THEN '  ' ELSE '' END
            || CASE WHEN key = '' THEN value ELSE key || ': ' || value END END AS line
        FROM entries""", _ENTRIES))
def metadata_lines(spark, sf):
    return reports.metadata_lines(fixtures.files(spark, sf), fixtures.channels(spark, sf),
                                  fixtures.attrs(spark, sf))


_MARK = _label("short", {"R": "🔴", "G": "🟢", "B": "🔵", "A": "⚪"}, "'•'")
_SHOWN = "CASE WHEN layer = '' THEN 'Beauty' ELSE layer END"
_TREE = {
    "lettered": f"SELECT lc.*, layer_order, {upper('short[1]')} AS letter FROM lc JOIN lay USING "
                "(file_id, layer)",
    "placed": "SELECT *, CASE WHEN letter IN ('R', 'G', 'B', 'A') AND row_number() OVER (PARTITION "
              "BY file_id, layer, letter ORDER BY part_idx, channel_idx) = 1 "
              "THEN position(letter IN 'RGBA')::INTEGER - 1 ELSE 4 END AS slot FROM lettered",
    "tree": f"""SELECT file_id, layer, layer_order, slot, CASE WHEN slot < 4 THEN '' ELSE
        lower(short) END AS sort_name, part_idx, channel_idx, '    ' || {_MARK} || ' ' || {_LABEL}
        || ' @' || {_SHOWN} AS line, {_COLOUR} AS colour, 10 AS font_size FROM placed UNION ALL
        SELECT file_id, layer, layer_order, -1, '', (pos // 1000)::INTEGER, (pos % 1000)::INTEGER,
        '📁 ' || {_SHOWN}, 'default', 12 FROM lay""",
    "shown": f"SELECT file_id, {_SHOWN} AS display, arg_max(layer, layer_order) AS layer FROM lay "
             "GROUP BY ALL",
    "linemap": "SELECT file_id, line, layer FROM tree WHERE slot >= 0 QUALIFY row_number() OVER "
               "(PARTITION BY file_id, line ORDER BY layer_order DESC, slot DESC, sort_name DESC, "
               "part_idx DESC, channel_idx DESC) = 1",
}


@checked("J18_channel_tree", with_ctes(
    "SELECT file_id, layer, layer_order, slot, sort_name, part_idx, channel_idx, line, colour, "
    "font_size FROM tree", _TREE))
def channel_tree(spark, sf):
    return reports.channel_tree(fixtures.channels(spark, sf))


@checked("J19_layer_display_map", with_ctes("SELECT file_id, display, layer FROM shown", _TREE))
def layer_display_map(spark, sf):
    return catalog.layer_display_map(catalog.layers(fixtures.channels(spark, sf)))


@checked("J19_line_layers", with_ctes("SELECT file_id, line, layer FROM linemap", _TREE))
def _(spark, sf):
    return reports.line_layers(reports.channel_tree(fixtures.channels(spark, sf)))


def selections(tree):
    """Every tree line, for odd files also without its layer suffix, and one line of neither kind."""
    place = F.col("file_id") * 10000 + F.col("part_idx") * 1000 + F.col("channel_idx") * 10
    kind = F.when(F.col("slot") < 0, 0).otherwise(1)
    pick = lambda n, line: F.struct((place + n).alias("sel_id"), "file_id", line.alias("line"))
    odd = (F.col("file_id") % 2 == 1) & (F.col("slot") >= 0)
    first = (F.col("slot") < 0) & (F.col("layer_order") == 0)
    lines = F.array_compact(F.array(
        pick(kind, F.col("line")),
        F.when(odd, pick(F.lit(2), F.regexp_replace("line", " @[^@]*$", ""))),
        F.when(first, pick(F.lit(3), F.lit("Loading layer: Beauty")))))
    return tree.select(F.inline(lines))


_CLICKED = {
    **_TREE,
    "sels": "SELECT file_id * 10000 + part_idx * 1000 + channel_idx * 10 + CASE WHEN slot < 0 THEN 0 "
            "ELSE 1 END AS sel_id, file_id, line FROM tree UNION ALL SELECT file_id * 10000 + "
            "part_idx * 1000 + channel_idx * 10 + 2, file_id, regexp_replace(line, ' @[^@]*$', '') "
            "FROM tree WHERE file_id % 2 = 1 AND slot >= 0 UNION ALL SELECT file_id * 10000 + "
            "part_idx * 1000 + channel_idx * 10 + 3, file_id, 'Loading layer: Beauty' FROM tree "
            "WHERE slot < 0 AND layer_order = 0",
    "kinded": "SELECT *, trim(line) AS t, CASE WHEN starts_with(line, '📁') THEN 'layer' WHEN "
              "starts_with(trim(line), '• ') OR trim(line)[1] IN ('🔴', '🟢', '🔵', '⚪') THEN "
              "'channel' END AS kind FROM sels",
    "cut": "SELECT *, CASE WHEN kind = 'layer' THEN trim(replace(line, '📁', '')) WHEN "
           "contains(t, '@') THEN trim(regexp_extract(t, '@([^@]*)$', 1)) END AS display, "
           "trim(regexp_replace(t, '@[^@]*$', '')) AS bare FROM kinded WHERE kind IS NOT NULL",
    "spelled": "SELECT *, CASE WHEN kind = 'channel' THEN CASE WHEN starts_with(t, '• ') THEN "
               "trim(bare[2:]) ELSE coalesce(string_split_regex(bare, '\\s+')[2], '') END END AS short "
               "FROM cut",
    "picked": f"SELECT *, CASE {_EXACT} ELSE short END AS channel FROM spelled",
    "clicked": f"""SELECT p.sel_id, p.file_id, p.kind, CASE WHEN p.display IS NOT NULL THEN
        coalesce(d.layer, p.display) ELSE coalesce(l.layer, best_layer) END AS layer, p.channel,
        CASE WHEN p.kind = 'layer' THEN 'RGB' WHEN {upper('p.channel')} = 'Z' OR
        contains({upper('p.channel')}, 'DEPTH') THEN 'Depth' ELSE 'Grayscale' END AS mode
        FROM picked p LEFT JOIN shown d ON d.file_id = p.file_id AND d.display = p.display
        LEFT JOIN linemap l ON l.file_id = p.file_id AND l.line = rtrim(p.line)
        LEFT JOIN best b ON b.file_id = p.file_id""",
}


def clicked(spark, sf):
    channels = fixtures.channels(spark, sf)
    tree = reports.channel_tree(channels)
    return selection.resolve_selection(
        selections(tree), catalog.layer_display_map(catalog.layers(channels)),
        reports.line_layers(tree), best_requests(spark, sf))


@checked("J20_resolve_selection", with_ctes(
    "SELECT sel_id, file_id, kind, layer, channel, mode FROM clicked", _CLICKED))
def resolve_selection(spark, sf):
    return clicked(spark, sf)


@checked("J21_layer_status", with_ctes(
    "SELECT file_id, layer, coalesce(channels_text, '?') AS channels, coalesce(n_channels, 0) AS "
    "n_channels FROM (SELECT file_id, layer FROM lay UNION SELECT file_id, coalesce(best_layer, "
    "'Layer 1') FROM files LEFT JOIN best USING (file_id)) LEFT JOIN lay USING (file_id, layer)"))
def layer_status(spark, sf):
    channels = fixtures.channels(spark, sf)
    best = catalog.best_layer(channels, fixtures.files(spark, sf)).select(
        "file_id", F.col("best_layer").alias("layer"))
    every = catalog.channel_layers(channels).select("file_id", "layer")
    return catalog.layer_status(channels, every.unionByName(best).distinct())


@checked("D7_filter_names", with_ctes(
    "SELECT file_id, path, file_name, size_bytes FROM files WHERE contains(lower(file_name), 'ring')"))
def _(spark, sf):
    return reports.filter_names(fixtures.files(spark, sf), "RING")
