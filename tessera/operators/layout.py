"""Layout of textures: extents, sizes and offsets of mip levels, and the codes of formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: For each format the DXGI code, the FourCC ('' if none), bytes of a block or texel, and whether blocks.
FORMATS = {
    "rgba": (28, "", 4, False),
    "bgra": (87, "", 4, False),
    "bc1": (71, "DXT1", 8, True),
    "bc2": (74, "DXT3", 16, True),
    "bc3": (77, "DXT5", 16, True),
    "bc4": (80, "ATI1", 8, True),
    "bc5": (83, "ATI2", 16, True),
    "bc6": (95, "", 16, True),
    "bc7": (98, "", 16, True),
}


def format_table(spark: SparkSession) -> DataFrame:
    """(format, dxgi, fourcc, unit_bytes, is_block): a row for each format, small enough to broadcast."""
    rows = ", ".join(f"('{n}', {f[0]}, '{f[1]}', {f[2]}, {str(f[3]).lower()})" for n, f in FORMATS.items())
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS f(format, dxgi, fourcc, unit_bytes, is_block)"))


def levels(surfaces: DataFrame) -> DataFrame:
    """(surface_id, format, mip, width, height, depth, size, offset) of full chains of surfaces (surface_id, width,
    height, depth, format): offsets are within the surface. Extents below one count as one."""
    w, h, d = (F.greatest(F.col(c), F.lit(1)) for c in ("width", "height", "depth"))
    mips = F.floor(F.log2(F.greatest(w, h, d).cast("double")) + 1e-9).cast("int")
    rows = surfaces.select("surface_id", "format", w.alias("w"), h.alias("h"), d.alias("d"), F.explode(F.sequence(F.lit(0), mips)).alias("mip"))
    at = lambda c: F.greatest(F.lit(1), F.call_function("shiftright", F.col(c), F.col("mip")))
    rows = rows.select("surface_id", "format", "mip", at("w").alias("width"), at("h").alias("height"), at("d").alias("depth"))
    rows = rows.join(format_table(surfaces.sparkSession), "format")
    quads = lambda c: F.floor((F.col(c) + 3) / 4)
    units = F.when(F.col("is_block"), quads("width") * quads("height")).otherwise(F.col("width").cast("long") * F.col("height")) * F.col("depth")
    rows = rows.withColumn("size", (units * F.col("unit_bytes")).cast("long"))
    before = Window.partitionBy("surface_id").orderBy("mip").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def sizes(surfaces: DataFrame) -> DataFrame:
    """(surface_id, format, mips, bytes) of full chains."""
    return levels(surfaces).groupBy("surface_id", "format").agg(F.count(F.lit(1)).alias("mips"), F.sum("size").alias("bytes"))


def target_extent(width: int, height: int, limit: int = 0, rounding: str = "none", kind: str = "2d") -> tuple[int, int]:
    """The extents of the base level. A limit is first lowered to a power of two if there is any rounding."""

    def previous(n: int) -> int:
        return 1 << (max(1, n).bit_length() - 1)

    def following(n: int) -> int:
        return 1 << (max(1, n) - 1).bit_length()

    if limit and rounding != "none":
        limit = previous(limit)
    top = max(width, height)
    if limit and top > limit:
        width, height = max(1, width * limit // top), max(1, height * limit // top)
    if kind == "cube":
        width = height = (width + height) // 2
    rule = {
        "none": lambda n: n,
        "next_power": following,
        "previous_power": previous,
        "nearest_power": lambda n: following(n) if following(n) - n <= n - previous(n) else previous(n),
        "next_four": lambda n: (n + 3) // 4 * 4,
        "previous_four": lambda n: max(4, n // 4 * 4),
        "nearest_four": lambda n: n,  # doesn't round, as in the engine whose results are matched
    }[rounding]
    return max(1, rule(width)), max(1, rule(height))
