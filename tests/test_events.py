"""Event jobs against loops, batch and stream."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumigrid.operators import events, logs
from lumigrid.scale import carry_last, grouped_index
from lumigrid.streaming import rates, runs, timings

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
PARAMS = "session BIGINT, event_id BIGINT, ts TIMESTAMP, exposure DOUBLE, gamma DOUBLE"
UPDATES = "session BIGINT, event_id BIGINT, ts TIMESTAMP, kind STRING, p DOUBLE, message STRING"


def at(ms):
    return START + timedelta(milliseconds=ms)


def loop_spaced(rows, gap):
    """rows: (session, ms, event_id, restart, free); ids of kept rows."""
    kept, clock = set(), {}
    for session, ms, event_id, restart, free in sorted(rows):
        last = clock.get(session)
        if free or restart or last is None or ms - last >= gap:
            kept.add(event_id)
            if not free:
                clock[session] = ms
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_min_gap_against_loop(spark, seed):
    rng = random.Random(seed)
    rows, ms = [], {s: 0 for s in range(3)}
    for i in range(600):
        s = rng.choice([0, 0, 0, 1, 2])
        ms[s] += rng.choice([0, 1, 5, 40, 100, 299, 300, 301, 5000 if rng.random() < 0.1 else 7])
        rows.append((s, ms[s], i))
    df = spark.createDataFrame([(s, i, at(m), 1.0, None) for s, m, i in rows], PARAMS)
    want = loop_spaced([(s, m, i, False, False) for s, m, i in rows], 300)
    for block_gaps, fan in [(1, 2), (2, 3), (64, 256)]:
        got = {r.event_id for r in events.min_gap(df, 300, block_gaps=block_gaps, fan=fan).collect()}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_min_gap_forced_against_loop(spark, seed):
    rng = random.Random(100 + seed)
    rows, ms = [], 0
    for i in range(500):
        ms += rng.choice([0, 1, 10, 79, 80, 81, 200])
        rows.append((rng.choice([0, 0, 1]), i, ms, rng.choice(["set"] * 8 + ["start", "finish", "reset"]),
                     rng.choice([0.0, 0.5, 0.5, 0.5, 0.5, 0.7, 0.995, 1.7, -3.0]),
                     "m" if rng.random() < 0.05 else None))
    df = spark.createDataFrame([(s, i, at(m), k, p, t) for s, i, m, k, p, t in rows], UPDATES)
    restart = lambda k, p, t: k == "start" or (k == "set" and (
        t is not None or min(max(p, 0), 1) >= 0.99 or min(max(p, 0), 1) <= 0.01))
    want = loop_spaced([(s, m, i, restart(k, p, t), k in ("finish", "reset"))
                        for s, i, m, k, p, t in rows], 80)
    for block_gaps, fan in [(1, 2), (3, 4), (64, 256)]:
        got = events.min_gap_forced(df, 80, block_gaps=block_gaps, fan=fan).collect()
        assert {r.event_id for r in got} == want
    shown = {"start": -1.0, "finish": 1.0, "reset": 0.0}
    assert all(r.shown == shown.get(r.kind, min(max(r.p, 0.0), 1.0)) for r in got)


def test_min_gap_edges(spark):
    rows = [(1, 0), (1, 299), (1, 300), (1, 300), (1, 600)]
    df = spark.createDataFrame([(s, i, at(m), 1.0, None) for i, (s, m) in enumerate(rows)], PARAMS)
    assert {r.event_id for r in events.min_gap(df).collect()} == {0, 2, 4}


def test_conflate_16ms(spark):
    rows = [(1, 0, 0, 1.0, None), (1, 1, 3, 2.0, None), (1, 2, 3, 3.0, None), (1, 3, 15, None, 1.5),
            (1, 4, 16, None, 2.5), (1, 5, 40, None, None)]
    df = spark.createDataFrame([(s, i, at(m), e, g) for s, i, m, e, g in rows], PARAMS)
    got = [(r.tick_start.microsecond // 1000, r.exposure, r.gamma)
           for r in events.conflate(df).orderBy("tick_start").collect()]
    assert got == [(0, 3.0, 1.5), (16, None, 2.5)]


def test_carry_forward(spark):
    day = 86_400_000
    rows = [(1, 0, None, 1.0), (1, 10, 2.0, None), (1, 2 * day, None, 3.0), (1, 5 * day, 4.0, 5.0)]
    df = spark.createDataFrame([(s, at(m), e, g) for s, m, e, g in rows],
                               "session BIGINT, tick_start TIMESTAMP, exposure DOUBLE, gamma DOUBLE")
    got = [(r.exposure_now, r.gamma_now, r.change, r.status)
           for r in events.carry_forward(df).orderBy("tick_start").collect()]
    assert got == [(0.0, 1.0, "gamma", "🔄 Gamma: 1.00"),
                   (2.0, 1.0, "exposure", "🔄 Exposure: 2.00 EV"),
                   (2.0, 3.0, "gamma", "🔄 Gamma: 3.00"),
                   (4.0, 5.0, "both", "🔄 Exposure: 4.00 EV, Gamma: 5.00")]


def test_blocked_helpers(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b"]), i, rng.choice([None, None, float(i)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g STRING, i INT, v DOUBLE")
    block = {"_b": F.expr("i div 7")}
    got = {r.i: (r.place, r.last) for r in carry_last(
        grouped_index(df, ["g"], ["i"], block, "place"), ["g"], ["i"], block, {"last": "v"}).collect()}
    place, last = {}, {}
    for g, i, v in rows:
        place[g] = place.get(g, -1) + 1
        last[g] = v if v is not None else last.get(g)
        assert got[i] == (place[g], last[g])


LINES = [
    ('{"event":"file.open","path":"C:\\x\\y "z".exr"}', dict(path='C:\\x\\y "z".exr')),
    ('{"event":"file.open","path":"/a/b.exr"}', dict(event="file.open", path="/a/b.exr")),
    ('{"event":"file.open","path":"C:\\new\\tmp.exr"}', dict(event="file.open", path="C:\\new\\tmp.exr")),
    ('{"type":"timing","op":"ImageCache.new","ms":12}', dict(type="timing", op="ImageCache.new", ms=12)),
    ('{"type":"timing","op":"process_to_image","pixels":9,"ms":1}',
     dict(type="timing", op="process_to_image", pixels=9, ms=1)),
    ("[folder] 12 EXR files | thumbnails in 34 ms",
     dict(op="folder.thumbnails", files=12, ms=34, tag="folder",
          message="12 EXR files | thumbnails in 34 ms")),
    ("[folder] selection canceled", dict(tag="folder", message="selection canceled")),
    ("[error][meta] bad [x] header", dict(tag="error", subtag="meta", message="bad [x] header")),
    ("  • beauty.v2 (channels: 4)", dict(layer="beauty.v2", n_channels=4)),
    ("  •  (channels: 3)", dict(layer="", n_channels=3)),
    ("plain", {}), ("", {}),
]


def test_parse_log(spark):
    df = spark.createDataFrame([(1, at(i), line) for i, (line, _) in enumerate(LINES)],
                               "session BIGINT, ts TIMESTAMP, line STRING")
    rows = logs.parse_log(df).orderBy("ts").collect()
    for row, (line, want) in zip(rows, LINES):
        got = {k: v for k, v in row.asDict().items()
               if v is not None and k not in ("session", "ts", "line")}
        assert got == want, line


def run_stream(spark, tmp_path, df, form, files=1):
    df.repartition(files).write.parquet(str(tmp_path / "in.parquet"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1) \
        .parquet(str(tmp_path / "in.parquet"))
    return runs.run_keyed(form(stream)).collect()


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(9)
    rows, ms = [], 0
    for i in range(300):
        ms += rng.choice([1, 50, 100, 400])
        rows.append((i % 2, i, at(ms), rng.choice(["set", "set", "set", "start", "finish"]), 0.5, None))
    updates = spark.createDataFrame(rows, UPDATES)
    batch = {(r.event_id, r.shown) for r in events.min_gap_forced(updates).collect()}
    assert {(r.event_id, r.shown) for r in run_stream(
        spark, tmp_path / "t4", updates, rates.min_gap_forced_stream)} == batch
    ticks = updates.select("session", F.col("ts").alias("tick_start"),
                           F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("double")).alias("exposure"),
                           F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("double")).alias("gamma"))
    carried = {tuple(r[c] for c in ("session", "tick_start", "exposure_now", "gamma_now", "status"))
               for r in events.carry_forward(ticks).collect()}
    assert {tuple(r[c] for c in ("session", "tick_start", "exposure_now", "gamma_now", "status"))
            for r in run_stream(spark, tmp_path / "t2", ticks, rates.carry_forward_stream)} == carried


def test_state_survives_micro_batches(spark, tmp_path):
    """Three files, one micro-batch each, in the order they were written."""
    folder = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(1, 10 * k + i, at(1000 * k + 100 * i), 1.0, None) for i in range(10)],
                              PARAMS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema) \
        .option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = {r.event_id for r in runs.run_keyed(rates.min_gap_stream(stream)).collect()}
    assert got == {0, 3, 6, 9, 12, 15, 18, 21, 24, 27}


def test_timing_windows(spark):
    lines = [(1, at(0), '{"type":"timing","op":"a","ms":4}'), (1, at(10), '{"type":"timing","op":"a","ms":6}'),
             (1, at(3_600_000), '{"type":"timing","op":"a","ms":8}'), (1, at(5), "[layer] x")]
    df = spark.createDataFrame(lines, "session BIGINT, ts TIMESTAMP, line STRING")
    got = [(r.n_timings, r.min_ms, r.avg_ms, r.max_ms)
           for r in timings.log_timing(df).orderBy("window_start").collect()]
    assert got == [(2, 4, 5.0, 6), (1, 8, 8.0, 8)]


def test_values_of_tagged_lines(spark):
    from lumigrid.operators import logs

    lines = [
        ("[channel] a@b@diffuse → mode: Depth (auto-normalized, inverted)", ("Depth", "diffuse", "a@b", None, None, None, None)),
        ("[preview] updated → mode: Grayscale, x::y::Z", ("Grayscale", "x::y", "Z", None, None, None, None)),
        ("[preview] image generated: 99999999999999999999 pixels (exp: 0.50, gamma: 2.20)",
         (None, None, None, 0.5, 2.2, None, None)),
        ("[preview] updated → params: exp=-1.25, gamma=4.50", (None, None, None, -1.25, 4.5, None, None)),
        ("[layers] count: 12", (None, None, None, None, None, None, 12)),
        ("[layers] count: many", (None,) * 7), ("", (None,) * 7), (None, (None,) * 7),
        ("[layer] clicked: a (real='it's (real='b')')", (None, "b')", None, None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "n int, line string")
    got = logs.tagged_values(df).orderBy("n").drop("n", "line").collect()
    assert [tuple(r) for r in got] == [w for _, w in lines]
