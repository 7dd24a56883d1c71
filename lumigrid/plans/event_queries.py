"""Checked queries on logs and events: J22, J23, T1-T5, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumigrid.operators import events, logs
from lumigrid.plans.oracle_fixtures import with_ctes
from lumigrid.plans.registry import checked
from lumigrid.sources import fixtures
from lumigrid.streaming import late, rates, runs, timings

DAY_MS = 24 * 3600 * 1000
DAY_US = DAY_MS * 1000
HOUR_US = 3600 * 1_000_000


def _micros(df, *columns):
    """Times as whole microseconds."""
    return df.withColumns({c: F.unix_micros(c) for c in columns})


# Logs --------------------------------------------------------------------------------------------

_PARSED = {
    "fields": r"""SELECT *, CASE WHEN starts_with(line, '{') THEN replace(line, '\', '/') END AS j
        FROM loglines""",
    "parsed": r"""SELECT session, event_id, us, line, json_extract_string(j, '$.event') AS event,
        json_extract_string(j, '$.type') AS type, coalesce(json_extract_string(j, '$.op'),
            CASE WHEN contains(line, 'EXR files | thumbnails in') THEN 'folder.thumbnails' END) AS op,
        CASE WHEN j IS NOT NULL AND contains(line, '"path":"') THEN
            regexp_extract(line, '"path":"(.*)"\}$', 1) END AS path,
        cast(json_extract_string(j, '$.pixels') AS BIGINT) AS pixels,
        coalesce(cast(json_extract_string(j, '$.ms') AS BIGINT),
            try_cast(regexp_extract(line, 'thumbnails in (\d+) ms$', 1) AS BIGINT)) AS ms,
        try_cast(regexp_extract(line, '^\[folder\] (\d+) EXR files', 1) AS BIGINT) AS files,
        CASE WHEN line[1] = '[' THEN regexp_extract(line, '^\[([^\]]*)\]', 1) END AS tag,
        CASE WHEN regexp_matches(line, '^\[[^\]]*\]\[') THEN
            regexp_extract(line, '^\[[^\]]*\]\[([^\]]*)\]', 1) END AS subtag,
        CASE WHEN line[1] = '[' THEN regexp_extract(line, '^(?:\[[^\]]*\])+ (.*)$', 1) END AS message,
        CASE WHEN starts_with(line, '  • ') THEN regexp_extract(line, '• (.*) \(ch', 1) END AS layer,
        try_cast(regexp_extract(line, '\(channels: (\d+)\)$', 1) AS BIGINT) AS n_channels
        FROM fields""",
}
_FIELDS = "event, type, op, path, pixels, ms, files, tag, subtag, message, layer, n_channels"


_LAYER_OF = "CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END"


# Shapes 0 to 9 of the tagged lines by event_id % 10, and what each of them tells.
@checked("J22_tagged_values", f"""
WITH e AS (SELECT *, event_id % 10 AS k, {_LAYER_OF} AS layer, 'c@' || CAST(event_id % 5 AS VARCHAR) AS channel,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS whole FROM events)
SELECT user_id AS session, event_id, epoch_us(ts) AS ts,
  CASE WHEN k IN (1, 2) THEN 'RGB' WHEN k IN (3, 4) THEN 'Depth' WHEN k = 5 THEN 'Grayscale' END AS mode,
  CASE WHEN k <= 5 THEN layer END AS shown_layer, CASE WHEN k IN (3, 4, 5) THEN channel END AS shown_channel,
  CASE k WHEN 7 THEN CAST('-' || whole || '.25' AS DOUBLE) WHEN 9 THEN CAST(whole || '.50' AS DOUBLE) END AS exposure,
  CASE k WHEN 7 THEN 2.2::DOUBLE WHEN 9 THEN 0.75::DOUBLE END AS gamma,
  CASE WHEN k = 7 THEN event_id END AS n_pixels,
  CASE k WHEN 6 THEN event_id WHEN 8 THEN CAST(whole AS BIGINT) END AS n_layers FROM e""")
def tagged_values(spark, sf):
    return _micros(logs.tagged_values(fixtures.tagged_lines(spark, sf)).drop("line"), "ts")


@checked("J22_parse_log", with_ctes(
    f"SELECT session, event_id, us AS ts, line, {_FIELDS} FROM parsed", _PARSED))
def parse_log(spark, sf):
    return _micros(logs.parse_log(fixtures.log_lines(spark, sf)), "ts")


@checked("J23_timing_summary", with_ctes(
    """SELECT op, count(*) AS n_timings, min(ms) AS min_ms, avg(ms) AS avg_ms, max(ms) AS max_ms,
    quantile_cont(ms::DOUBLE, 0.5) AS p50_ms, quantile_cont(ms::DOUBLE, 0.95) AS p95_ms,
    cast(sum(pixels) AS BIGINT) AS pixels, cast(sum(pixels) AS DOUBLE) * 1000
        / cast(sum(CASE WHEN pixels IS NOT NULL THEN ms END) AS DOUBLE) AS pixels_per_second
    FROM parsed WHERE op IS NOT NULL AND ms IS NOT NULL GROUP BY op""", _PARSED))
def timing_summary(spark, sf):
    return logs.timing_summary(logs.parse_log(fixtures.log_lines(spark, sf)))


def _timing_sql(condition: str) -> str:
    return with_ctes(
        f"""SELECT us // {HOUR_US} * {HOUR_US} AS window_start,
        us // {HOUR_US} * {HOUR_US} + {HOUR_US} AS window_end, op, count(*) AS n_timings,
        min(ms) AS min_ms, avg(ms) AS avg_ms, max(ms) AS max_ms, cast(sum(ms) AS BIGINT) AS sum_ms,
        cast(sum(pixels) AS BIGINT) AS pixels FROM parsed
        WHERE op IS NOT NULL AND ms IS NOT NULL AND {condition} GROUP BY us // {HOUR_US}, op""",
        _PARSED)


@checked("T5_log_timing", _timing_sql("true"))
def _(spark, sf):
    return _micros(timings.log_timing(fixtures.log_lines(spark, sf)),
                   "window_start", "window_end")


def _event_stream(spark, sf):
    return runs.stream_table(spark, sf, "events").withColumns(
        {"ts": F.col("ts").cast("timestamp"), "session": F.col("user_id")})


@checked("T5_log_timing_stream", _timing_sql("true"))
def _(spark, sf):
    lines = fixtures.log_lines(spark, sf, _event_stream(spark, sf))
    result = runs.run_with_open_windows(timings.log_timing(lines, watermark=timings.WATERMARK),
                                        ["window_start", "op"])
    return _micros(result, "window_start", "window_end")


# Parameters --------------------------------------------------------------------------------------

def _ticks(length: int, condition: str = "true") -> str:
    latest = lambda c: f"arg_max({c}, us::HUGEINT * 1000000000 + event_id) " \
                       f"FILTER ({c} IS NOT NULL) AS {c}"
    return (f"SELECT session, us // {length} * {length} AS tick_start, us // {length} * {length} + "
            f"{length} AS tick_end, {latest('exposure')}, {latest('gamma')} FROM pev "
            f"WHERE {condition} GROUP BY session, us // {length}")


def _conflated_sql(length: int, condition: str = "true") -> str:
    return with_ctes("SELECT session, tick_start, tick_end, exposure, gamma FROM ticks",
                     {"ticks": _ticks(length, condition)})


@checked("T1_conflate", _conflated_sql(DAY_US))
def conflate(spark, sf):
    return _micros(events.conflate(fixtures.param_events(spark, sf), "1 day"),
                   "tick_start", "tick_end")


# Times pressed together by this factor, so that events meet within milliseconds.
SQUEEZE = 2_000_000
_SQUEEZED = f"(SELECT * REPLACE (us // {SQUEEZE} AS us) FROM pev)"


def _squeezed(spark, sf):
    return fixtures.param_events(spark, sf).withColumn(
        "ts", F.timestamp_micros(F.expr(f"unix_micros(ts) div {SQUEEZE}")))


@checked("T1_conflate_16ms", _conflated_sql(16000).replace("FROM pev WHERE", f"FROM {_SQUEEZED} WHERE"))
def _(spark, sf):
    return _micros(events.conflate(_squeezed(spark, sf)), "tick_start", "tick_end")


def _tick_table(spark, sf):
    source = fixtures.param_events(spark, sf, _event_stream(spark, sf))
    return runs.run_with_open_windows(events.conflate(source, "1 hour", timings.WATERMARK),
                                      ["session", "tick_start"])


@checked("T1_conflate_stream", _conflated_sql(HOUR_US))
def _(spark, sf):
    return _micros(_tick_table(spark, sf), "tick_start", "tick_end")


# Three arrivals, each from the whole span of time; what the ones before have closed is late.
@checked("T1_late_rows_stream", with_ctes(
    f"""SELECT session, event_id, us AS ts, exposure, gamma, coalesce(us // {HOUR_US} * {HOUR_US} + {HOUR_US} <=
        (SELECT max(b.us) FROM pev b WHERE b.event_id % 3 < 1) - 600000000, false) AND event_id % 3 = 1
        OR coalesce(us // {HOUR_US} * {HOUR_US} + {HOUR_US} <=
        (SELECT max(b.us) FROM pev b WHERE b.event_id % 3 < 2) - 600000000, false) AND event_id % 3 = 2 AS late
        FROM pev""", {}))
def _(spark, sf):
    params = fixtures.param_events(spark, sf)
    arrivals = (params.filter(F.col("event_id") % 3 == k) for k in range(3))
    marked = runs.run_in_turn(arrivals, lambda stream: late.marked_late(stream, "1 hour"))
    return _micros(marked.drop("_batch"), "ts")


_TICKS_CARRIED = """SELECT session, tick_start,
            coalesce(last_value(exposure IGNORE NULLS) OVER w, 0) AS exposure_now,
            coalesce(last_value(gamma IGNORE NULLS) OVER w, 2.2) AS gamma_now,
            CASE WHEN exposure IS NOT NULL AND gamma IS NOT NULL THEN 'both'
                WHEN exposure IS NOT NULL THEN 'exposure' ELSE 'gamma' END AS change
            FROM ticks WINDOW w AS (PARTITION BY session ORDER BY tick_start
            ROWS UNBOUNDED PRECEDING)"""
_CARRIED = with_ctes(
    """SELECT session, tick_start, exposure_now, gamma_now, change, '🔄 ' || CASE change
        WHEN 'both' THEN format('Exposure: {:.2f} EV, Gamma: {:.2f}', exposure_now, gamma_now)
        WHEN 'exposure' THEN format('Exposure: {:.2f} EV', exposure_now)
        ELSE format('Gamma: {:.2f}', gamma_now) END AS status FROM carried""", {
        "ticks": _ticks(HOUR_US),
        "carried": _TICKS_CARRIED})


@checked("T2_carry_forward", _CARRIED)
def carry_forward(spark, sf):
    ticks = events.conflate(fixtures.param_events(spark, sf), "1 hour")
    return _micros(events.carry_forward(ticks), "tick_start")


@checked("T2_carry_forward_stream", _CARRIED)
def _(spark, sf):
    ticks = _tick_table(spark, sf)
    carried = runs.run_keyed(rates.carry_forward_stream(runs.table_stream(ticks)))
    return _micros(carried.drop("_batch"), "tick_start")


# Rate limits -------------------------------------------------------------------------------------

def _spaced_sql(source: str, select: str, restart: str, free: str, gap: int,
                first: dict[str, str] | None = None) -> str:
    """One event after the other, by recursion over the position in the session."""
    return with_ctes(
        f"SELECT {select} FROM walked w JOIN numbered n ON n.session = w.session AND n.i = w.i "
        "WHERE w.keep", {
            **(first or {}),
            "numbered": f"SELECT *, {restart} AS restart, {free} AS free, row_number() OVER "
                        f"(PARTITION BY session ORDER BY us, event_id) AS i FROM {source}",
            "walked": f"""SELECT session, 0::BIGINT AS i, NULL::BIGINT AS clock, false AS keep
                FROM (SELECT DISTINCT session FROM {source}) UNION ALL
                SELECT n.session, n.i, CASE WHEN NOT n.free AND (n.restart OR w.clock IS NULL OR
                    n.us - w.clock >= {gap}) THEN n.us ELSE w.clock END,
                n.free OR n.restart OR w.clock IS NULL OR n.us - w.clock >= {gap}
                FROM walked w JOIN numbered n ON n.session = w.session AND n.i = w.i + 1"""},
        recursive=True)


_SPACED_PARAMS = _spaced_sql("pev", "n.session, n.event_id, n.us AS ts, n.exposure, n.gamma",
                             "false", "false", DAY_US)


@checked("T3_min_gap", _SPACED_PARAMS)
def min_gap(spark, sf):
    return _micros(events.min_gap(fixtures.param_events(spark, sf), DAY_MS,
                                  block_gaps=2, fan=3), "ts")


@checked("T3_min_gap_300ms", _spaced_sql(
    _SQUEEZED, "n.session, n.event_id, n.us AS ts, n.exposure, n.gamma", "false", "false", 300000))
def _(spark, sf):
    return _micros(events.min_gap(_squeezed(spark, sf)), "ts")


@checked("T3_min_gap_stream", _SPACED_PARAMS)
def _(spark, sf):
    source = fixtures.param_events(spark, sf, _event_stream(spark, sf))
    return _micros(runs.run_keyed(rates.min_gap_stream(source, DAY_MS)).drop("_batch"), "ts")


_CLAMPED = "CASE WHEN isnan(p) THEN p ELSE greatest(least(p, 1::DOUBLE), 0::DOUBLE) END"
_NOT_SHOWN = -9.0  # written for NaN, so that results can be compared


_FORCED = _spaced_sql(
    "prog", f"n.session, n.event_id, n.us AS ts, n.kind, CASE WHEN isnan(n.p) THEN {_NOT_SHOWN}::DOUBLE ELSE n.p END "
    "AS p, n.message, CASE WHEN n.kind = 'start' THEN -1::DOUBLE WHEN n.kind = 'finish' THEN 1::DOUBLE "
    f"WHEN isnan(n.p) THEN {_NOT_SHOWN}::DOUBLE ELSE {_CLAMPED} END AS shown",
    "kind = 'start' OR (kind = 'set' AND (message IS NOT NULL OR (NOT isnan(p) AND (p >= 0.99 OR p <= 0.01))))",
    "kind = 'finish'", DAY_US)


def _compared(shown):
    return _micros(shown.withColumns({c: F.nanvl(c, F.lit(_NOT_SHOWN)) for c in ("p", "shown")}), "ts")


@checked("T4_min_gap_forced", _FORCED)
def min_gap_forced(spark, sf):
    return _compared(events.min_gap_forced(fixtures.progress_updates(spark, sf), DAY_MS,
                                           block_gaps=2, fan=3))


@checked("T4_min_gap_forced_stream", _FORCED)
def _(spark, sf):
    updates = fixtures.progress_updates(spark, sf, _event_stream(spark, sf))
    return _compared(runs.run_keyed(rates.min_gap_forced_stream(updates, DAY_MS)).drop("_batch"))


@checked("T123_chain_stream", _spaced_sql(
    "carried", "n.session, n.us AS tick_start, n.exposure_now, n.gamma_now, n.change", "false", "false", DAY_US,
    {"ticks": _ticks(HOUR_US), "carried": _TICKS_CARRIED.replace("tick_start,", "tick_start AS us, tick_start // 1000 AS event_id,", 1)}))
def _(spark, sf):
    """Conflated, carried forward, then reported at most once a day: each link a stream over the table
    that the one before has written."""
    carried = runs.run_keyed(rates.carry_forward_stream(runs.table_stream(_tick_table(spark, sf))))
    ticks = runs.table_stream(carried).select(
        "session", F.expr("unix_millis(tick_start)").alias("event_id"), F.col("tick_start").alias("ts"),
        "exposure_now", "gamma_now", "change")
    kept = runs.run_keyed(rates.min_gap_stream(ticks, DAY_MS)).withColumnRenamed("ts", "tick_start")
    return _micros(kept.drop("event_id", "_batch"), "tick_start")
