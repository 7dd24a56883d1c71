"""Image tables derived from the TPC-H-like test tables.

The derivations are deterministic and use only arithmetic and joins, so the same tables can be
derived by another SQL engine for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.scale import grouped_index

# Channel names and file extensions the test tables cycle through.
CHANNEL_NAMES = (
    "R, G, B, A, Z, beauty.R, beauty.G, beauty.B, beauty.A, diffuse.R, diffuse.G, diffuse.B, "
    "diffuse_direct.R, diffuse_direct.G, diffuse_direct.B, Specular.red, Specular.green, "
    "Specular.blue, N.X, N.Y, N.Z, normal, motion.VX, motion.VY, speed, depth, DepthMask, "
    "distance, Crypto00.R, crypto.matteID, alpha, AlphaMask, RED, Reduction, albedo.R, albedo.G, "
    "albedo.B, noise, id.Y, rgba.R, default.Z").split(", ")
EXTENSIONS = [".exr", ".EXR", ".png", "", ".exr.bak"]
WIDTH, HEIGHT = 16, 50
VECTOR_LENGTH = 64
PARTS, PART_CHANNELS = 2, 6
# Vectors ranked together; longer runs of one label are ranked block by block.
VECTOR_BLOCK = 1 << 16


# Known schemas save a look at the files before every job.
SOURCE_SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(F.lit("/shots/"), "p_type", F.lit("/"), "p_name", F.lit("_"),
                    key.cast("string"), _pick(EXTENSIONS, F.pmod(key, F.lit(5))))
    return table(spark, sf_dir, "part").select(
        key.alias("file_id"), path.alias("path"),
        F.element_at(F.split(path, "/"), -1).alias("file_name"),
        (key * key * F.col("p_size") * 1000).alias("size_bytes"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve channels per file in two parts of six.  Names in a part are in binary order, so the
    index of a channel is the number of smaller names, found among the six by array functions."""
    key = F.col("p_partkey")
    file_id = F.expr("p_partkey div 12")
    k = F.pmod(key, F.lit(12)).cast("int")
    part_idx = F.expr("cast(p_partkey % 12 div 6 as int)")
    named = table(spark, sf_dir, "part").select(
        file_id.alias("file_id"), part_idx.alias("part_idx"),
        _pick(CHANNEL_NAMES, F.pmod(file_id * 5 + k, F.lit(len(CHANNEL_NAMES)))).alias("full_name"))
    parts = named.groupBy("file_id", "part_idx").agg(
        F.sort_array(F.collect_list("full_name")).alias("names"))  # six names at most
    named_part = (F.pmod("file_id", F.lit(7)) == 0) & (F.col("part_idx") == 1)
    return parts.select(
        "file_id", "part_idx",
        F.when(named_part, F.lit("beauty")).alias("part_name"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
        F.posexplode("names").alias("channel_idx", "full_name"))


def header_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five header attributes per file."""
    key, size = F.col("p_partkey"), F.col("p_size")
    ord_ = F.pmod(key, F.lit(5)).cast("int")
    window = F.concat(F.lit("Vec2( 0 0 size: Vec2( "), (size * 40).cast("string"), F.lit(" "),
                      (size * 20).cast("string"), F.lit(")"))
    pairs = [F.lit("red: (0.64, 0.33)"), F.lit(", green: (0.3, 0.6)")]
    rest = [F.lit(", blue: (0.15, 0.06)"), F.lit(", white: (0.3127, 0.329)")]
    even = F.expr("p_partkey div 5 % 2") == 0
    chroma = F.when(even, F.concat(*pairs, *rest)).otherwise(F.concat(*pairs))
    code = F.concat(F.lit("{1,2,"), size.cast("string"), F.lit("}"))
    aspect = F.call_function("format_number", F.col("p_retailprice") / 1000, F.lit("0.00000"))
    value = (F.when(ord_ == 0, window).when(ord_ == 1, aspect).when(ord_ == 2, chroma)
             .when(ord_ == 3, code).otherwise(F.col("p_brand")))
    names = ["display_window", " Pixel_Aspect_Ratio", "chromaticities", "TIME_CODE", "owner "]
    return table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 5").alias("file_id"), F.lit(None).cast("int").alias("part_idx"),
        ord_.alias("ord"), _pick(names, ord_).alias("name"), value.alias("value"))


def part_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six attributes per part, the first without a name."""
    ord_ = F.expr("cast(p_partkey % 6 as int)")
    return table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 12").alias("file_id"),
        F.expr("cast(p_partkey % 12 div 6 as int)").alias("part_idx"), ord_.alias("ord"),
        F.when(ord_ == 0, F.lit("")).when(ord_ == 1, F.lit(" comment "))
        .otherwise(F.concat(F.lit("attr"), ord_.cast("string"))).alias("name"),
        F.col("p_brand").alias("value"))


def attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_attrs(spark, sf_dir).unionByName(part_attrs(spark, sf_dir))


def _scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is one scan line of the image of its label."""
    return grouped_index(
        table(spark, sf_dir, "embeddings").select(
            F.col("label").cast("bigint").alias("image_id"), "vec_id", "embedding"),
        ["image_id"], ["vec_id"], {"_block": F.expr(f"vec_id div {VECTOR_BLOCK}")}, "y")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LDR images, 16 wide, from the embedding vectors: 64 floats are 16 pixels of four channels."""
    fours = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda x: F.struct(
        x.alias("x"), *[F.get("embedding", x * 4 + i).alias(c) for i, c in enumerate("rgba")]))
    return _scan_lines(spark, sf_dir).select("image_id", "y", F.inline(fours))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "embeddings")
            .groupBy(F.col("label").cast("bigint").alias("image_id"))
            .agg(F.lit(WIDTH).alias("width"), F.count(F.lit(1)).cast("int").alias("height")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every channel of the files whose id is a label; channel c of part p at x is the
    vector element ``(4x + 6p + c) mod 64``, which for part 0, c < 4 is the value in ``pixels``."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PARTS * PART_CHANNELS - 1)),
                                  lambda pc: F.transform(
        F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda x: F.struct(
            F.floor(pc / PART_CHANNELS).cast("int").alias("part_idx"),
            F.pmod(pc, F.lit(PART_CHANNELS)).alias("channel_idx"), x.alias("x"),
            F.get("embedding", F.pmod(x * 4 + pc, F.lit(VECTOR_LENGTH))).alias("v")))))
    return _scan_lines(spark, sf_dir).select(F.col("image_id").alias("file_id"), "y",
                                             F.inline(cells))


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples, a row per line of a channel."""
    lines = F.transform(F.sequence(F.lit(0), F.lit(PARTS * PART_CHANNELS - 1)), lambda pc: F.struct(
        F.floor(pc / PART_CHANNELS).cast("int").alias("part_idx"), F.pmod(pc, F.lit(PART_CHANNELS)).alias("channel_idx"),
        F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)),
                    lambda x: F.get("embedding", F.pmod(x * 4 + pc, F.lit(VECTOR_LENGTH)))).alias("line")))
    return _scan_lines(spark, sf_dir).select(F.col("image_id").alias("file_id"), "y", F.inline(lines))


def hdr_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HDR values from line items: depth, colour and alpha.  No positions."""
    f = lambda e: F.expr(e).cast("float")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), f("l_extendedprice").alias("depth"),
        f("l_extendedprice / 10000").alias("r"), f("l_quantity / 10").alias("g"),
        f("l_discount * 10").alias("b"), f("1 - l_tax").alias("a"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns(
        {"ts": F.col("ts").cast("timestamp"), "session": F.col("user_id")})


def param_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    source = _events(spark, sf_dir) if events is None else events
    exposure = F.when(F.col("event_id") % 2 == 0, F.col("value") % 10 - 5)
    gamma = F.when(F.col("event_id") % 3 == 0, F.col("value") % 4 + 0.5)
    return (source.select("session", "event_id", "ts", exposure.alias("exposure"),
                          gamma.alias("gamma"))
            .filter(F.col("exposure").isNotNull() | F.col("gamma").isNotNull()))


def progress_updates(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Every 23rd update has a progress of NaN."""
    kind = (F.when(F.col("event_id") % 17 == 0, "start")
            .when(F.col("event_id") % 19 == 0, "finish").otherwise("set"))
    source = _events(spark, sf_dir) if events is None else events
    p = F.when(F.col("event_id") % 23 == 0, float("nan")).otherwise(F.col("value") / 500)
    return source.select(
        "session", "event_id", "ts", kind.alias("kind"), p.alias("p"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("message"))


def log_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Timing JSON, file JSON, and tagged and untagged text, in turn."""
    source = _events(spark, sf_dir) if events is None else events
    number, whole = F.col("event_id").cast("string"), F.floor("value").cast("string")
    kind = F.col("event_type")
    shapes = [
        F.concat(F.lit('{"type":"timing","op":"'), kind, F.lit('","pixels":'), number,
                 F.lit(',"ms":'), whole, F.lit("}")),
        F.concat(F.lit('{"event":"file.open","path":"C:\\new\\'), number, F.lit('.exr"}')),
        F.concat(F.lit("[error][meta] "), kind),
        F.concat(F.lit("[layer] clicked: "), kind),
        F.concat(F.lit("[folder] "), number, F.lit(" EXR files | thumbnails in "), whole,
                 F.lit(" ms")),
        F.concat(F.lit("  • "), kind, F.lit(" (channels: "), whole, F.lit(")")),
    ]
    line = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        line = F.when(F.col("event_id") % 6 == i, shape).otherwise(line)
    return source.select("session", "event_id", "ts", line.alias("line"))


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged lines with values in them, ten shapes in turn; the layer of every seventh is the unnamed one."""
    number, whole = F.col("event_id").cast("string"), F.floor("value").cast("string")
    layer = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("event_type"))
    channel = F.concat(F.lit("c@"), F.expr("cast(event_id % 5 as string)"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [
        text("[layer] clicked: Beauty (real='", layer, "')"),
        text("[layer] ", layer, " → mode: RGB (composite)"),
        text("[preview] updated → mode: RGB (composite), layer: ", layer),
        text("[channel] ", channel, "@", layer, " → mode: Depth (auto-normalized, inverted)"),
        text("[preview] updated → mode: Depth (auto-normalized, inverted), ", layer, "::", channel),
        text("[channel] ", channel, "@", layer, " → mode: Grayscale"),
        text("[meta] layers: ", number),
        text("[preview] image generated: ", number, " pixels (exp: -", whole, ".25, gamma: 2.20)"),
        text("[layers] count: ", whole),
        text("[preview] updated → params: exp=", whole, ".50, gamma=0.75"),
    ]
    line = F.get(F.array(*shapes), F.expr("cast(event_id % 10 as int)"))
    return _events(spark, sf_dir).select("session", "event_id", "ts", line.alias("line"))
