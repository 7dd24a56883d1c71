import pytest
from pyspark.sql import functions as F

from lumigrid.functions import labels, names


def column(spark, values, expression, schema="c STRING"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(expression).collect()]


@pytest.mark.parametrize("full, attr, expected", [
    ("R", None, ("", "R")), ("diffuse.R", None, ("diffuse", "R")),
    ("a.b.c", None, ("a.b", "c")), (".x", None, ("", "x")), ("x.", None, ("x", "")),
    ("", None, ("", "")), ("a.b.c", "beauty", ("beauty", "c")), ("R", "", ("", "R")),
])
def test_split(spark, full, attr, expected):
    df = spark.createDataFrame([(full, attr)], "full STRING, attr STRING")
    row = df.select(names.layer_name(F.col("full"), F.col("attr")),
                    names.short_name(F.col("full"))).first()
    assert tuple(row) == expected


def test_alias(spark):
    given = ["R", " r ", "Red", "REDUCTION", "R8", "green2", "B", "blue", "alphaMask", "A1", "Z",
             " Z ", "", "ｒ"]
    assert column(spark, given, names.channel_alias(F.col("c"))) == [
        "R", "R", "R", "R", "R8", "G", "B", "B", "A", "A1", "Z", "Z", "", "ｒ"]


def test_display_to_short(spark):
    given = ["red", " RED ", "Reduction", "g", "Blue", "alpha", " id ", "Z"]
    assert column(spark, given, names.display_to_short(F.col("c"))) == [
        "R", "R", "Reduction", "G", "B", "A", " id ", "Z"]


def test_groups(spark):
    given = ["R", "RED", "A", "ALPHAX", "AB", "Z", "XDEPTHX", "DISTANCE", "DISTANCES", "CRYPTO",
             "MATTE", "N", "NOISE", "X", "MYNORMAL", "FORWARDVX", "VXY", "MOTION", "SPEEDY", "Y", ""]
    assert column(spark, given, names.channel_group(F.col("c"))) == [
        "RGB", "Inne", "Alpha", "Alpha", "Inne", "Depth", "Depth", "Depth", "Inne", "Cryptomatte",
        "Cryptomatte", "Normals", "Normals", "Inne", "Normals", "Motion", "Inne", "Motion", "Motion",
        "Inne", "Inne"]


@pytest.mark.parametrize("layer, wanted, rgba, channel", [
    ("", "", True, True), ("", "x", False, False), ("x", "", False, False),
    ("Diffuse", "diffuse", True, True), ("diffuse_direct", "Diffuse", True, True),
    ("diff", "diffuse", True, True),      # prefix of the wanted name
    ("fuse", "diffuse", True, False),     # inside the wanted name, but no prefix
    ("my_diffuse", "diffuse", True, True), ("a", "b", False, False),
])
def test_layer_matches(spark, layer, wanted, rgba, channel):
    df = spark.createDataFrame([(layer, wanted)], "l STRING, w STRING")
    row = df.select(names.layer_match_rgba(F.col("l"), F.col("w")),
                    names.layer_match_channel(F.col("l"), F.col("w"))).first()
    assert tuple(row) == (rgba, channel)


def test_file_name(spark):
    given = ["/a/b.exr", "b.exr", "/a/", "/a/b/.", "/a/.b", "a//./", "/", "..", "/a/..", ".", "./", None]
    assert column(spark, given, names.file_name(F.col("c"))) == [
        "b.exr", "b.exr", "a", "b", ".b", "a", "?", "?", "?", "?", "?", "?"]


def test_labels(spark):
    given = ["R", "g", "b", "A", "RED", "id"]
    assert column(spark, given, labels.channel_line(F.col("c"), F.lit("Beauty"))) == [
        "    🔴 Red @Beauty", "    🟢 Green @Beauty", "    🔵 Blue @Beauty", "    ⚪ Alpha @Beauty",
        "    • RED @Beauty", "    • id @Beauty"]
    assert column(spark, given, labels.colour_class(labels.channel_label(F.col("c")))) == [
        "R", "G", "B", "default", "R", "default"]
    assert column(spark, given, labels.selected_line(F.col("c"), F.lit("L")))[-2:] == [
        "RED @L", "id @L"]
