"""Layer choice and name resolution on hand-made files, against loops over the rules."""

import random

import pytest
from pyspark.sql import functions as F

from lumigrid.operators import catalog, reports, resolve, selection


def channel_table(spark, files):
    """files: {file_id: [(part_name, [channel names]), ...]}"""
    rows = [(f, p, attr, 4, 2 + p, c, name) for f, parts in files.items()
            for p, (attr, listed) in enumerate(parts) for c, name in enumerate(listed)]
    return spark.createDataFrame(rows, "file_id BIGINT, part_idx INT, part_name STRING, width INT, "
                                       "height INT, channel_idx INT, full_name STRING")


def best(spark, *parts):
    return catalog.best_layer(channel_table(spark, {1: list(parts)})).first().best_layer


def test_best_layer(spark):
    rgb = ["R", "G", "B"]
    prefixed = lambda p: [f"{p}.{c}" for c in rgb]
    assert best(spark, (None, [*prefixed("beauty"), *rgb])) == ""
    assert best(spark, (None, ["R", "G", *prefixed("x"), "mybeauty.Z"])) == "mybeauty"
    assert best(spark, (None, ["RGBA.x", "my_Beauty.x"])) == "my_Beauty"  # the word outranks order
    assert best(spark, (None, ["a.x", "thedefault.x", "combined.y"])) == "thedefault"
    assert best(spark, (None, ["a.x", "COMBINED.y"])) == "COMBINED"
    assert best(spark, (None, ["a.x", *prefixed("b"), *prefixed("c")])) == "b"
    assert best(spark, (None, ["a.x", "b.r", "b. g ", "b.B"])) == "b"
    assert best(spark, (None, ["a.x", "b.y"])) == "a"
    assert best(spark, ("left", ["R", "G", "B"]), (None, rgb)) == ""
    files = spark.createDataFrame([(1,), (2,)], "file_id BIGINT")
    chosen = catalog.best_layer(channel_table(spark, {1: [(None, ["q.x"])]}), files)
    assert {r.file_id: r.best_layer for r in chosen.collect()} == {1: "q", 2: "Layer 1"}


def loop_rgba(parts, wanted):
    w = wanted.lower()
    for p, (attr, listed) in enumerate(parts):
        group, slots = [], {}
        for c, name in enumerate(listed):
            layer = (attr if attr is not None else name.rpartition(".")[0]).lower()
            if (layer == w) if not layer or not w else (w in layer or layer in w):
                group.append((c, name.rpartition(".")[2].upper()))
        if not group:
            continue
        for role, word in {"R": "RED", "G": "GREEN", "B": "BLUE", "A": "ALPHA"}.items():
            same = [c for c, s in group if s in (role, word)]
            like = [c for c, s in group if s.startswith(role) and role != "A"]
            slots[role] = same[-1] if same else (like[0] if like else None)
        order = [c for c, _ in group]
        r = slots["R"] if slots["R"] is not None else order[0]
        g = slots["G"] if slots["G"] is not None else (order[1] if len(order) > 1 else r)
        b = slots["B"] if slots["B"] is not None else (order[2] if len(order) > 2 else g)
        return p, r, g, b, slots["A"], "layer"
    for p, (_, listed) in enumerate(parts):
        if {"R", "G", "B"} <= set(listed):
            at = lambda n: listed.index(n) if n in listed else None
            return p, at("R"), at("G"), at("B"), at("A"), "first_rgba"
    return None, None, None, None, None, None


def loop_channel(parts, wanted_layer, wanted):
    w = wanted_layer.lower()

    def alias(s):
        t = s.strip()
        for role, word in {"R": "RED", "G": "GREEN", "B": "BLUE", "A": "ALPHA"}.items():
            if t.upper() == role or t.upper().startswith(word):
                return role
        return t

    for p, (attr, listed) in enumerate(parts):
        found = []
        for c, name in enumerate(listed):
            layer = (attr if attr is not None else name.rpartition(".")[0]).lower()
            short = name.rpartition(".")[2]
            if (layer == w) if not layer or not w else (w in layer or w.startswith(layer)):
                named = short == wanted or name == wanted or alias(short) == alias(wanted)
                deep = wanted.upper() == "Z" and (
                    short.upper() in ("Z", "DISTANCE") or "DEPTH" in short.upper())
                if named or deep:
                    found.append((1 if named else 2, c))
        if found:
            step, c = min(found)
            return p, c, step
    return None


LAYERS = ["", "beauty", "Beauty2", "diffuse", "diffuse_direct", "direct", "N", "a", "ab", "b.a"]
SHORTS = ["R", "r", "RED", "Reduction", "G", "green", "Gx", "B", "blue", "Bump", "A", "alpha", "Z",
          "depth", "Distance", "id", "x.y"]


def random_files(seed, n):
    rng = random.Random(seed)
    files = {}
    for f in range(n):
        parts = []
        for _ in range(rng.randint(1, 3)):
            listed = list({(f"{layer}." if layer else "") + rng.choice(SHORTS)
                           for layer in rng.choices(LAYERS, k=rng.randint(1, 9))})
            parts.append((rng.choice([None, None, "beauty", "Direct", ""]), listed))
        files[f] = parts
    return files


def test_resolve_rgba_against_loops(spark):
    files = random_files(1, 40)
    asked = [(f, w) for f in files for w in [*LAYERS, "DIFF", "Diffuse_Direct_more", "nothing"]]
    got = resolve.resolve_rgba(channel_table(spark, files),
                               spark.createDataFrame(asked, "file_id BIGINT, layer STRING"))
    got = {(r.file_id, r.layer): (r.part_idx, r.r, r.g, r.b, r.a, r.source) for r in got.collect()}
    assert got == {(f, w): loop_rgba(files[f], w) for f, w in asked}


def test_resolve_channel_against_loops(spark):
    files = random_files(2, 40)
    asked = [(f, w, c) for f in files for w in ["", "diffuse", "DIRECT", "beauty2x", "b", "none"]
             for c in ["R", " red", "Z", "z", "depth", "Beauty2.R", "id", "y"]]
    wanted = spark.createDataFrame(asked, "file_id BIGINT, layer STRING, channel STRING")
    resolved = resolve.resolve_channel(channel_table(spark, files), wanted)
    got = {(r.file_id, r.layer, r.channel): (r.part_idx, r.channel_idx, r.step)
           for r in resolved.collect()}
    expected = {q: loop_channel(files[q[0]], q[1], q[2]) for q in asked}
    assert got == {q: v for q, v in expected.items() if v}
    missing = {tuple(r) for r in resolve.unresolved_channels(wanted, resolved).collect()}
    assert missing == {q for q, v in expected.items() if not v}


def test_assemble_and_id_to_alpha(spark):
    channels = channel_table(spark, {1: [(None, ["B", "G", "R"]), (None, ["id.Y"])]})
    samples = spark.createDataFrame(
        [(1, p, c, y, x, float(100 * p + 10 * c + 2 * y + x)) for p, c in [(0, 0), (0, 1), (0, 2), (1, 0)]
         for y in range(2) for x in range(2)],
        "file_id BIGINT, part_idx INT, channel_idx INT, y INT, x INT, v FLOAT")
    view = resolve.resolve_rgba(channels, spark.createDataFrame([(1, "")], "file_id BIGINT, layer STRING"))
    rows = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in resolve.assemble_pixels(samples, view).collect()}
    assert rows == {(y, x): (20 + 2 * y + x, 10 + 2 * y + x, 2 * y + x, 1.0)
                    for y in range(2) for x in range(2)}
    ids = resolve.resolve_channel(channels, spark.createDataFrame(
        [(1, "id", "Y")], "file_id BIGINT, layer STRING, channel STRING"))
    # The parts of this file differ in height.
    assert resolve.id_to_alpha(samples, view, ids).count() == 0
    assert resolve.mismatched_sizes(view, ids).count() == 1
    same = ids.withColumn("height", F.lit(2))
    merged = resolve.id_to_alpha(samples, view, same).filter("y = 1 AND x = 1").first()
    assert (merged.r, merged.a) == (23.0, 103.0)


def test_tree_and_clicks(spark):
    channels = channel_table(spark, {1: [(None, ["Z", "alpha", "B", "G", "R", "Red2", "id"]),
                                         (None, ["Beauty.x", "deep.Depth"])]})
    tree = reports.channel_tree(channels)
    lines = [r.line for r in tree.orderBy(*reports.TREE_ORDER).collect()]
    assert lines == ["📁 Beauty", "    🔴 Red @Beauty", "    🟢 Green @Beauty", "    🔵 Blue @Beauty",
                     "    • alpha @Beauty", "    • id @Beauty", "    • Red2 @Beauty", "    • Z @Beauty",
                     "📁 Beauty", "    • x @Beauty", "📁 deep", "    • Depth @deep"]
    shown = catalog.layer_display_map(catalog.layers(channels))
    assert {r.display: r.layer for r in shown.collect()} == {"Beauty": "Beauty", "deep": "deep"}
    clicks = ["📁 Beauty", "    • Depth @deep", " ⚪ Alpha @other@x", "• Z", "🔴", "noise", "📁📁  q ",
              "    • • id @deep", "🟢  Green  rest @ deep "]
    table = spark.createDataFrame(list(enumerate([*clicks])), "sel_id BIGINT, line STRING") \
        .withColumn("file_id", F.lit(1).cast("bigint"))
    current = spark.createDataFrame([(1, "now")], "file_id BIGINT, layer STRING")
    done = selection.resolve_selection(table, shown, reports.line_layers(tree), current)
    assert {r.sel_id: (r.kind, r.layer, r.channel, r.mode) for r in done.collect()} == {
        0: ("layer", "Beauty", None, "RGB"), 1: ("channel", "deep", "Depth", "Depth"),
        2: ("channel", "x", "A", "Grayscale"), 3: ("channel", "now", "Z", "Depth"),
        4: ("channel", "now", "", "Grayscale"), 6: ("layer", "q", None, "RGB"),
        7: ("channel", "deep", "• id", "Grayscale"), 8: ("channel", "deep", "G", "Grayscale")}


def test_layer_order_and_status(spark):
    channels = channel_table(spark, {1: [(None, ["b.x", "a.x"]), ("b", ["y"]), (None, ["c.z"])]})
    order = {r.layer: r.layer_order for r in catalog.layers(channels).collect()}
    assert order == {"b": 0, "a": 1, "c": 2}
    asked = spark.createDataFrame([(1, "b"), (1, "q")], "file_id BIGINT, layer STRING")
    got = {r.layer: (r.channels, r.n_channels) for r in catalog.layer_status(channels, asked).collect()}
    assert got == {"b": ("x, y", 2), "q": ("?", 0)}


@pytest.mark.parametrize("order", [[1, 0], [0, 1]])
def test_metadata_order(spark, order):
    names = ["Zeta", None]
    channels = channel_table(spark, {1: [(names[i], ["R"]) for i in order]})
    files = spark.createDataFrame([(1, "/x/a.exr", "a.exr", 2048)],
                                  "file_id BIGINT, path STRING, file_name STRING, size_bytes BIGINT")
    attrs = spark.createDataFrame(
        [(1, None, 0, " Time_Code ", "{1,2}"), (1, order.index(0), 0, "", "v")],
        "file_id BIGINT, part_idx INT, ord INT, name STRING, value STRING")
    rows = reports.metadata_rows(files, channels, attrs).orderBy(*reports.REPORT_ORDER).collect()
    size = {0: "4x2", 1: "4x3"}
    assert [(r.key, r.value) for r in rows] == [
        ("Ogólne", ""), ("Ścieżka", "/x/a.exr"), ("Rozmiar pliku", "2.00 KiB"), ("Warstwy", "2"),
        ("Nagłówek", ""), ("time_code", "1 2"), ("Warstwa: (domyślna)", ""),
        ("Wymiary", size[order.index(1)]), ("Warstwa: Zeta", ""), ("Wymiary", size[order.index(0)]),
        ("Atrybut", "v")]
    lines = reports.metadata_lines(files, channels, attrs).orderBy(*reports.REPORT_ORDER).collect()
    assert [r.line for r in lines] == [
        "[Ogólne]", "Ścieżka: /x/a.exr", "Rozmiar pliku: 2.00 KiB", "Warstwy: 2", "[Nagłówek]",
        " Time_Code : {1,2}", f"Warstwa: (domyślna)  — {size[order.index(1)]}",
        f"Warstwa: Zeta  — {size[order.index(0)]}", "  v"]


def test_match_very_long_names(spark):
    """10,000 characters each; all their pieces would be 50 million characters a name."""
    long = "".join(chr(97 + (i * i) % 23) for i in range(10_000))
    layers = [long + "end", long[5000:], "ab" * 5000, "", "x", "é1", "a%_b"]
    wanted = [long.upper(), long[6000:9000], "ba" * 10, "", "y", "é", "%_", "Xy", long[:50] + "?" + long[50:]]
    named = spark.createDataFrame([(1, x) for x in layers], "file_id BIGINT, layer STRING")
    asked = spark.createDataFrame([(1, x) for x in wanted] + [(2, "x"), (1, "y")], "file_id BIGINT, layer STRING")
    for rule in ("rgba", "channel"):
        got = [tuple(r) for r in resolve.matching_layers(named, asked, rule).collect()]
        lower = [(lo.lower(), w) for lo in layers for w in wanted]
        backward = lambda lo, w: lo in w if rule == "rgba" else w.startswith(lo)
        want = {(1, lo, w) for lo, w in lower
                if (lo == w == "" if "" in (lo, w) else w.lower() in lo or backward(lo, w.lower()))}
        assert set(got) == want and len(got) == len(want)


def test_minima_do_not_sort(spark):
    channels = channel_table(spark, random_files(3, 4))
    views = resolve.resolve_rgba(channels, spark.createDataFrame([(1, "")], "file_id BIGINT, layer STRING"))
    one = resolve.resolve_channel(channels, spark.createDataFrame([(1, "", "R")], "file_id BIGINT, layer STRING, channel STRING"))
    for df in (views, one):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_best_layer_aggregates_by_hashing(spark):
    table = channel_table(spark, {1: [(None, ["R", "G", "B"])], 2: [("x.beauty", ["q"]), ("rgba", ["q"])]})
    best = catalog.best_layer(table)
    got = {r.file_id: (r.best_layer, r.plan) for r in best.collect()}
    assert got == {1: ("", 0), 2: ("x.beauty", 1)}
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
