"""The test tables of ``sources.fixtures`` and shared expressions, in DuckDB's SQL.

Each entry is the body of one common table expression; ``with_ctes`` puts the ones a query needs in
front of it.
"""

from __future__ import annotations

import re

from lumigrid.functions import names
from lumigrid.sources.fixtures import CHANNEL_NAMES, EXTENSIONS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


UP = "translate({0}, '%s', '%s')" % (names.LOWER_ASCII, names.UPPER_ASCII)


def upper(c: str) -> str:
    return UP.format(c)


def trim(c: str) -> str:
    """Unicode white space, given as code points."""
    spaces = " || ".join(f"chr({ord(w)})" for w in names.WHITESPACE)
    return f"trim({c}, {spaces})"


def alias(c: str) -> str:
    """Canonical short channel name."""
    t = trim(c)
    u = upper(t)
    whens = " ".join(f"WHEN {u} = '{r}' OR starts_with({u}, '{w}') THEN '{r}'"
                     for r, w in [("R", "RED"), ("G", "GREEN"), ("B", "BLUE"), ("A", "ALPHA")])
    return f"CASE {whens} ELSE {t} END"


def group_of(u: str) -> str:
    return (f"CASE WHEN {u} IN ('R', 'G', 'B') THEN 'RGB' WHEN {u} = 'A' OR starts_with({u}, 'ALPHA') THEN 'Alpha' "
            f"WHEN {u} = 'Z' OR contains({u}, 'DEPTH') OR {u} = 'DISTANCE' THEN 'Depth' "
            f"WHEN contains({u}, 'CRYPT') OR contains({u}, 'MATTE') THEN 'Cryptomatte' "
            f"WHEN starts_with({u}, 'N') OR contains({u}, 'NORMAL') THEN 'Normals' "
            f"WHEN ends_with({u}, 'VX') OR ends_with({u}, 'VY') OR ends_with({u}, 'VZ') OR contains({u}, 'MOTION') "
            f"OR contains({u}, 'SPEED') THEN 'Motion' ELSE 'Inne' END")


def match_rgba(lo: str, wa: str) -> str:
    return (f"CASE WHEN {lo} = '' OR {wa} = '' THEN {lo} = {wa} "
            f"ELSE contains({lo}, {wa}) OR contains({wa}, {lo}) END")


def match_channel(lo: str, wa: str) -> str:
    return (f"CASE WHEN {lo} = '' OR {wa} = '' THEN {lo} = {wa} "
            f"ELSE contains({lo}, {wa}) OR starts_with({wa}, {lo}) END")


def human(b: str) -> str:
    whens = " ".join(
        f"WHEN {b} < {1024 ** (k + 1)} THEN format('{{:.2f}} {u}', {b} / {1024 ** k}.0::DOUBLE)"
        for k, u in list(enumerate(["B", "KiB", "MiB", "GiB", "TiB"]))[1:])
    return (f"CASE WHEN {b} < 1024 THEN {b} || ' B' {whens} "
            f"ELSE format('{{:.2f}} PiB', {b} / {1024 ** 5}.0::DOUBLE) END")


def curve(x: str, kind: str = "aces") -> str:
    if kind == "reinhard":
        return f"({x}) / (({x}) + 1)"
    if kind == "clamp":
        return f"greatest(least({x}, 1::DOUBLE), 0::DOUBLE)"
    return (f"greatest(least((({x}) * (({x}) * 2.51::DOUBLE + 0.03::DOUBLE)) / "
            f"(({x}) * (({x}) * 2.43::DOUBLE + 0.59::DOUBLE) + 0.14::DOUBLE), 1::DOUBLE), 0::DOUBLE)")


def gamma(t: str, g: float, mode: str = "reference") -> str:
    inverse = 1.0 / max(g, 1e-4)
    if mode == "reference":
        if abs(inverse - 0.45454545) < 0.001:
            return f"sqrt({t}) * sqrt(sqrt({t}))"
        if abs(inverse - 0.5) < 0.001:
            return f"sqrt({t})"
        if abs(inverse - 1.0) < 0.001:
            return t
    return f"pow({t}, {inverse!r}::DOUBLE)"


def colour(c: str, ev: float, g: float, kind: str = "aces", mode: str = "reference") -> str:
    """Encoded 0..1 value of a finite colour channel."""
    x = f"(greatest({c}::DOUBLE, 0::DOUBLE) * {2.0 ** ev!r}::DOUBLE)"
    return gamma(f"({curve(x, kind)})", g, mode)


def q8(t: str, levels: int = 255) -> str:
    return f"cast(round({t} * {levels}) AS INTEGER)"


def alpha(a: str) -> str:
    return f"greatest(least({a}::DOUBLE, 1::DOUBLE), 0::DOUBLE)"


def rgba8(ev: float, g: float, kind: str = "aces", mode: str = "reference",
          levels: int = 255, suffix: str = "8") -> str:
    parts = [f"{q8(colour(c, ev, g, kind, mode), levels)} AS {c}{suffix}" for c in "rgb"]
    return ", ".join([*parts, f"{q8(alpha('a'), levels)} AS a{suffix}"])


_LAST_DOT = "regexp_extract({0}, '([^.]*)$', 1)"

CTES = {
    "files": f"""SELECT p_partkey AS file_id, path, regexp_extract(path, '([^/]*)$', 1) AS file_name,
        size_bytes FROM (SELECT p_partkey, '/shots/' || p_type || '/' || p_name || '_' || p_partkey
        || {_list(EXTENSIONS)}[p_partkey % 5 + 1] AS path,
        p_partkey * p_partkey * p_size * 1000 AS size_bytes FROM part)""",
    "channels": f"""SELECT file_id, part_idx,
        CASE WHEN file_id % 7 = 0 AND part_idx = 1 THEN 'beauty' END AS part_name,
        16 AS width, 50 AS height,
        cast(row_number() OVER (PARTITION BY file_id, part_idx ORDER BY full_name) - 1 AS INTEGER)
            AS channel_idx, full_name
        FROM (SELECT p_partkey // 12 AS file_id, cast(p_partkey % 12 // 6 AS INTEGER) AS part_idx,
              {_list(CHANNEL_NAMES)}[(p_partkey // 12 * 5 + p_partkey % 12) % 41 + 1] AS full_name
              FROM part)""",
    "lc": f"""SELECT *, coalesce(part_name, CASE WHEN contains(full_name, '.')
            THEN full_name[:length(full_name) - length(short) - 1] ELSE '' END) AS layer
        FROM (SELECT *, {_LAST_DOT.format('full_name')} AS short FROM channels)""",
    "lay": f"""SELECT *, cast(row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS INTEGER)
            AS layer_order
        FROM (SELECT file_id, layer, min(part_idx * 1000 + channel_idx) AS pos,
              bool_or({upper(trim('short'))} = 'R') AND bool_or({upper(trim('short'))} = 'G')
                AND bool_or({upper(trim('short'))} = 'B') AS has_rgb,
              count(*) AS n_channels,
              string_agg(short, ', ' ORDER BY part_idx, channel_idx) AS channels_text
              FROM lc GROUP BY file_id, layer)""",
    "ranked": f"""SELECT *, CASE WHEN layer = '' AND has_rgb THEN 0
            WHEN prio IS NOT NULL THEN 1 WHEN has_rgb THEN 2 ELSE 3 END AS plan
        FROM (SELECT *, CASE {' '.join(f"WHEN contains(lower(layer), '{p}') THEN {i}"
                                       for i, p in enumerate(["beauty", "rgba", "default", "combined"]))} END AS prio
              FROM lay)""",
    "best": """SELECT file_id, layer AS best_layer, plan FROM ranked QUALIFY row_number() OVER
        (PARTITION BY file_id ORDER BY plan, CASE WHEN plan = 1 THEN prio END, layer_order) = 1""",
    "hattrs": """SELECT p_partkey // 5 AS file_id, NULL::INTEGER AS part_idx,
            cast(p_partkey % 5 AS INTEGER) AS ord,
            ['display_window', ' Pixel_Aspect_Ratio', 'chromaticities', 'TIME_CODE', 'owner ']
                [p_partkey % 5 + 1] AS name,
            CASE p_partkey % 5
                WHEN 0 THEN 'Vec2( 0 0 size: Vec2( ' || p_size * 40 || ' ' || p_size * 20 || ')'
                WHEN 1 THEN format('{:.5f}', p_retailprice / 1000)
                WHEN 2 THEN CASE WHEN p_partkey // 5 % 2 = 0
                    THEN 'red: (0.64, 0.33), green: (0.3, 0.6), blue: (0.15, 0.06), white: (0.3127, 0.329)'
                    ELSE 'red: (0.64, 0.33), green: (0.3, 0.6)' END
                WHEN 3 THEN '{1,2,' || p_size || '}'
                ELSE p_brand END AS value
        FROM part""",
    "pattrs": """SELECT p_partkey // 12 AS file_id, cast(p_partkey % 12 // 6 AS INTEGER) AS part_idx,
            cast(p_partkey % 6 AS INTEGER) AS ord,
            CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' comment '
                ELSE 'attr' || p_partkey % 6 END AS name, p_brand AS value
        FROM part""",
    "vecs": """SELECT label::BIGINT AS image_id, embedding AS e,
            cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS y
        FROM embeddings""",
    "pixels": """SELECT image_id, y, x, e[4 * x + 1] AS r, e[4 * x + 2] AS g, e[4 * x + 3] AS b,
            e[4 * x + 4] AS a
        FROM vecs, (SELECT cast(range AS INTEGER) AS x FROM range(16))""",
    "dims": """SELECT label::BIGINT AS image_id, 16 AS width, cast(count(*) AS INTEGER) AS height
        FROM embeddings GROUP BY label""",
    "samples": """SELECT image_id AS file_id, y, cast(pc // 6 AS INTEGER) AS part_idx,
            cast(pc % 6 AS INTEGER) AS channel_idx, x, e[(4 * x + pc) % 64 + 1] AS v
        FROM vecs, (SELECT cast(range AS INTEGER) AS x FROM range(16)),
             (SELECT range AS pc FROM range(12))""",
    "hdr": """SELECT l_suppkey AS image_id, l_extendedprice::FLOAT AS depth,
            (l_extendedprice / 10000)::FLOAT AS r, (l_quantity / 10)::FLOAT AS g,
            (l_discount * 10)::FLOAT AS b, (1 - l_tax)::FLOAT AS a FROM lineitem""",
    "pev": """SELECT * FROM (SELECT user_id AS session, event_id, epoch_us(ts) AS us,
            CASE WHEN event_id % 2 = 0 THEN value % 10 - 5 END AS exposure,
            CASE WHEN event_id % 3 = 0 THEN value % 4 + 0.5 END AS gamma FROM events)
        WHERE exposure IS NOT NULL OR gamma IS NOT NULL""",
    "prog": """SELECT user_id AS session, event_id, epoch_us(ts) AS us,
            CASE WHEN event_id % 17 = 0 THEN 'start' WHEN event_id % 19 = 0 THEN 'finish'
                ELSE 'set' END AS kind,
                CASE WHEN event_id % 23 = 0 THEN 'nan'::DOUBLE ELSE value / 500 END AS p,
            CASE WHEN event_id % 5 = 0 THEN event_type END AS message FROM events""",
    "loglines": r"""SELECT user_id AS session, event_id, epoch_us(ts) AS us, CASE event_id % 6
            WHEN 0 THEN '{"type":"timing","op":"' || event_type || '","pixels":' || event_id
                || ',"ms":' || cast(floor(value) AS BIGINT) || '}'
            WHEN 1 THEN '{"event":"file.open","path":"C:\new\' || event_id || '.exr"}'
            WHEN 2 THEN '[error][meta] ' || event_type
            WHEN 3 THEN '[layer] clicked: ' || event_type
            WHEN 4 THEN '[folder] ' || event_id || ' EXR files | thumbnails in '
                || cast(floor(value) AS BIGINT) || ' ms'
            ELSE '  • ' || event_type || ' (channels: ' || cast(floor(value) AS BIGINT) || ')' END
            AS line FROM events""",
}


def needed(sql: str, ctes: dict[str, str]) -> list[str]:
    """Names of the expressions that ``sql`` uses, directly or not, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, body in ctes.items():
            if name not in seen and re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", text):
                seen.add(name)
                visit(body)
                order.append(name)

    visit(sql)
    return order


def with_ctes(sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    ctes = {**CTES, **(extra or {})}
    used = needed(sql, ctes)
    if not used:
        return sql
    head = ",\n".join(f"{name} AS ({ctes[name]})" for name in used)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{sql}"
