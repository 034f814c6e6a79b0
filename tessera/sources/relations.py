"""Image relations from tables: a row for each texel, with its surface and place.

``texels(surface_id, z, y, x, r, g, b, a)`` is the one schema that the operators take. Channels are doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")
PLACE = ("surface_id", "z", "y", "x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def level(c: Column) -> Column:
    """A vector's value moved by a half and clamped to 0..1; what is null or missing is 1, as in the SQL."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c + 0.5))


def grid(surfaces: DataFrame) -> DataFrame:
    """A zero texel for each place of surfaces (surface_id, width, height, depth)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = surfaces.select("surface_id", "width", "height", every("depth").alias("z"))
    rows = rows.select("surface_id", "width", "z", every("height").alias("y")).select("surface_id", "z", "y", every("width").alias("x"))
    return rows.select("*", *[F.lit(0.0).alias(c) for c in CHANNELS])


def interleaved(rows: DataFrame, surface: str, data: str, width: int, height: int, order: Sequence[str] = CHANNELS) -> DataFrame:
    """Texels of arrays that hold width x height texels one after another, the channels of each in ``order``."""
    n = len(order)
    at = rows.select(F.col(surface).alias("surface_id"), F.col(data).alias("_data"), F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("_t"))
    value = {c: F.get("_data", F.col("_t") * n + i).cast("double") for i, c in enumerate(order)}
    return at.select("surface_id", F.lit(0).alias("z"), F.expr(f"_t div {width}").cast("int").alias("y"), (F.col("_t") % width).alias("x"), *[value.get(c, F.lit(0.0)).alias(c) for c in CHANNELS])


def planar(rows: DataFrame, surface: str, planes: dict[str, str], width: int) -> DataFrame:
    """Texels of one array for each channel."""
    zipped = F.arrays_zip(*[F.col(p).alias(c) for c, p in planes.items()])
    at = rows.select(F.col(surface).alias("surface_id"), F.posexplode(zipped).alias("_t", "_v"))
    place = [F.lit(0).alias("z"), F.expr(f"_t div {width}").cast("int").alias("y"), (F.col("_t") % width).alias("x")]
    return at.select("surface_id", *place, *[(F.col("_v")[c].cast("double") if c in planes else F.lit(0.0)).alias(c) for c in CHANNELS])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a 4 x 4 surface: values moved by a half and clamped to 0..1."""
    rows = interleaved(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 4)
    return rows.select(*PLACE, *[level(F.col(c)).alias(c) for c in CHANNELS])


def atlas(spark: SparkSession, sf_dir: str, across: int = 20) -> DataFrame:
    """All vectors side by side on one surface, ``across`` blocks to a row."""
    rows = blocks(spark, sf_dir)
    x = (F.pmod("surface_id", F.lit(across)) * 4 + F.col("x")).cast("int")
    y = (F.floor(F.col("surface_id") / across) * 4 + F.col("y")).cast("int")
    return rows.select(F.lit(0).alias("surface_id"), "z", y.alias("y"), x.alias("x"), *CHANNELS)


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 surface of one channel, in all four."""
    rows = interleaved(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, ("r",))
    return rows.select(*PLACE, *[level(F.col("r")).alias(c) for c in CHANNELS])


#: Extents of ragged(), by vec_id.
RAGGED = ((8, 8), (10, 7), (5, 13), (32, 16))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a surface of one of four extents, repeated as often as it takes, darker the smaller vec_id % 7 is."""
    e = table(spark, sf_dir, "embeddings")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in RAGGED]), (F.col("vec_id") % len(RAGGED) + 1).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = e.select(F.col("vec_id").alias("surface_id"), "embedding", pick(0).alias("w"), every(pick(1)).alias("y"))
    rows = rows.select("surface_id", "embedding", "w", "y", every(F.col("w")).alias("x"))
    v = level(F.get("embedding", (F.col("y") * F.col("w") + F.col("x")) % 64).cast("double")) * (F.col("surface_id") % 7 + 1) / 7
    return rows.select("surface_id", F.lit(0).alias("z"), "y", "x", v.alias("v")).select(*PLACE, *[F.col("v").alias(c) for c in CHANNELS])


def hdr(spark: SparkSession, sf_dir: str, width: int = 50) -> DataFrame:
    """The events as one surface of high range: red is the value over 100."""
    e = table(spark, sf_dir, "events")
    r = F.coalesce(F.col("value"), F.lit(0.0)) / 100
    y = F.floor(F.col("event_id") / width).cast("int")
    return e.select(F.lit(0).alias("surface_id"), F.lit(0).alias("z"), y.alias("y"), F.pmod("event_id", F.lit(width)).cast("int").alias("x"), r.alias("r"), (r / 2).alias("g"), (r / 4).alias("b"), F.lit(1.0).alias("a"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a 4 x 4 x 4 volume of one channel, in all four."""
    rows = gray(spark, sf_dir)
    at = F.col("y") * 8 + F.col("x")
    place = [F.floor(at / 16).cast("int").alias("z"), F.floor(at % 16 / 4).cast("int").alias("y"), (at % 4).cast("int").alias("x")]
    return rows.select("surface_id", *place, *CHANNELS)


def _line_texels(lines: DataFrame, width: Column) -> DataFrame:
    """lines (with _line, the bytes of a line of texels, and _n, bytes a texel) with x and _word, the bytes of each texel
    as a number, the first highest."""
    rows = lines.withColumn("x", F.explode(F.sequence(F.lit(0), width - 1)))
    return rows.withColumn("_word", F.conv(F.hex(F.call_function("substring", F.col("_line"), F.col("x") * F.col("_n") + 1, F.col("_n"))), 16, 10).cast("long")).drop("_line")


def from_bytes(rows: DataFrame, surface: str, data: str, width: int, height: int, order: Sequence[str] = ("b", "g", "r", "a")) -> DataFrame:
    """Texels of binary values with one byte for each channel of a texel, 0..1; blue is first where nothing else is said.
    Bytes are cut to lines and lines to texels, so that the work grows with the number of texels."""
    n = len(order)
    lines = rows.select(F.col(surface).alias("surface_id"), F.col(data).alias("_data"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    lines = lines.select("surface_id", F.lit(0).alias("z"), "y", F.lit(n).alias("_n"), F.call_function("substring", F.col("_data"), F.col("y") * (width * n) + 1, F.lit(width * n)).alias("_line"))
    value = {c: F.shiftright("_word", 8 * (n - 1 - i)).bitwiseAND(255) / 255 for i, c in enumerate(order)}
    return _line_texels(lines, F.lit(width)).select("surface_id", "z", "y", "x", *[value.get(c, F.lit(0.0)).alias(c) for c in CHANNELS])


def from_halves(rows: DataFrame, surface: str, data: str, width: int, height: int, order: Sequence[str] = CHANNELS) -> DataFrame:
    """Texels of arrays of 16-bit half floats, given as unsigned integers."""
    from tessera.functions.packing import from_half

    texels = interleaved(rows, surface, data, width, height, order)
    return texels.select(*PLACE, *[(from_half(F.col(c).cast("int")) if c in order else F.lit(0.0)).alias(c) for c in CHANNELS])


def from_image_source(images: DataFrame) -> DataFrame:
    """Texels of what spark.read.format("image") gives: JPEG, PNG and others, 8 bits, blue first, one, three or four
    channels; without alpha there is 0, as of other files. surface_id is the origin."""
    i = images.select(F.col("image.origin").alias("surface_id"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("_n"), F.col("image.data").alias("_data"))
    lines = i.where("w > 0 AND h > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    size = F.col("w") * F.col("_n")
    lines = lines.select("surface_id", F.lit(0).alias("z"), "y", "w", "_n", F.call_function("substring", F.col("_data"), F.col("y") * size + 1, size).alias("_line"))
    byte = lambda k: F.call_function("shiftright", F.col("_word"), (F.col("_n") - 1 - k) * 8).bitwiseAND(255) / 255
    grey = lambda k: F.when(F.col("_n") == 1, byte(0)).otherwise(byte(k))
    return _line_texels(lines, F.col("w")).select("surface_id", "z", "y", "x", grey(2).alias("r"), grey(1).alias("g"), byte(0).alias("b"), F.when(F.col("_n") == 4, byte(3)).otherwise(0.0).alias("a"))
