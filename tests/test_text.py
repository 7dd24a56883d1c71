import pytest
from pyspark.sql import functions as F

from lumigrid.functions import text


def one(spark, value, expression, dtype="STRING"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(expression).first()[0]


@pytest.mark.parametrize("size, shown", [
    (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KiB"), (1048576, "1.00 MiB"), (1536, "1.50 KiB"),
    (2 ** 50, "1.00 PiB"), (2 ** 60, "1024.00 PiB"), (2 ** 40 - 1, "1024.00 GiB")])
def test_human_size(spark, size, shown):
    assert one(spark, size, text.human_size(F.col("c")), "BIGINT") == shown


@pytest.mark.parametrize("given, shown", [
    (" 1.5 ", "1.500"), ("1.", "1.000"), (".5", "0.500"), ("1e2", "100.000"), ("x", "x"), ("", ""),
    ("1.5f", "1.5f"), ("0x10", "0x10"), ("-2", "-2.000"), ("inf", "inf"), ("-Infinity", "-inf"),
    ("nan", "NaN"), (" y ", " y "), ("1234567.0005", "1234567.001"), ("0.0625", "0.062"), ("1.0005", "1.000"), ("+3", "3.000")])
def test_pretty_number(spark, given, shown):
    assert one(spark, given, text.pretty_number(F.col("c"), 3)) == shown
    assert one(spark, "2.345678", text.pretty_number(F.col("c"), 7)) == "2.346"
    assert one(spark, "2.5", text.pretty_number(F.col("c"), 0)) == "2"


@pytest.mark.parametrize("given, found", [
    ("1-2", []), ("--5", []), ("-5", [-5]), ("a1b22-c3", [1, 3]), ("", []),
    ("12345678901234567890", []), ("Vec2( 0 0 size: Vec2( 2200 1237)", [2, 0, 0, 2, 2200, 1237])])
def test_ints(spark, given, found):
    assert one(spark, given, text.ints_in_text(F.col("c"))) == found


@pytest.mark.parametrize("given, found", [
    ("1.", [1.0]), (".5", [0.5]), (".", []), ("-.5 x 2", [-0.5, 2.0]), ("1.2.3", []), ("1-2", [])])
def test_floats(spark, given, found):
    assert one(spark, given, text.floats_in_text(F.col("c"))) == found


def test_window(spark):
    window = lambda v: one(spark, v, text.pretty_display_window(F.col("c")))
    assert window("(1, -2) 30 x 40") == "position: (1, -2); size: 30x40"
    assert window("Vec2( 0 0 size: Vec2( 2200 1237)") == "position: (2, 0); size: 0x2"
    assert window("5 6 7") == "position: (5, 6); size: 0x0"
    assert window("5") == "position: (0, 0); size: 0x0"


def test_chromaticities(spark):
    shown = one(spark, "0.64 0.33 / 0.3", text.pretty_chromaticities(F.col("c")))
    assert shown == "R: (0.640,0.330)  G: (0.000,0.000)  B: (0.000,0.000)  W: (0.000,0.000)"


def test_header(spark):
    assert one(spark, "{1,2,3}", text.pretty_time_code(F.col("c"))) == "1 2 3"
    keys = {" Display_Window ": "display_window", "PIXEL_ASPECT_RATIO": "pixel_aspect",
            "Owner ": "Owner", "Time_Code": "time_code"}
    for given, key in keys.items():
        assert one(spark, given, text.header_key(F.col("c"))) == key
