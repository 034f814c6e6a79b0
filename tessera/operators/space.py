"""Operators that move texels: flips, borders, crops, copies between surfaces. Coordinates are mapped, nothing is
gathered, and images meet by equi-joins on the place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.sources.relations import CHANNELS, PLACE, clamp


def flip(texels: DataFrame, axis: str, extent: int) -> DataFrame:
    return texels.withColumn(axis, extent - 1 - F.col(axis))


def border(texels: DataFrame, width: int, height: int, colour) -> DataFrame:
    """The outermost texels filled."""
    return _filled(texels, F.col("x").isin(0, width - 1) | F.col("y").isin(0, height - 1), colour)


def atlas_border(texels: DataFrame, tile_width: int, tile_height: int, colour) -> DataFrame:
    """The outermost texels of each tile filled."""
    x, y = F.col("x") % tile_width, F.col("y") % tile_height
    return _filled(texels, x.isin(0, tile_width - 1) | y.isin(0, tile_height - 1), colour)


def _filled(texels, where, colour):
    return T.changed(texels, **{c: F.when(where, F.lit(float(k))).otherwise(F.col(c)) for c, k in zip(CHANNELS, colour, strict=True)})


def sub_image(texels: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The rectangle with both ends, moved to the origin."""
    part = texels.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return part.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def canvas(texels: DataFrame, grid: DataFrame) -> DataFrame:
    """texels on another grid (zero texels): cropped, and zero where there are none."""
    own = texels.select(*PLACE, *[F.col(c).alias(f"_{c}") for c in CHANNELS])
    return grid.select(*PLACE).join(own, list(PLACE), "left").select(*PLACE, *[F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in CHANNELS])


def _beside(texels: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    return texels.join(other.select(*PLACE, *[F.col(c).alias(f"_{c}") for c in CHANNELS]), list(PLACE), how)


def copy_channel(texels: DataFrame, source: DataFrame, source_channel: str, channel: str) -> DataFrame:
    rows = _beside(texels, source)
    return T.changed(rows, **{channel: F.coalesce(F.col(f"_{source_channel}"), F.col(channel))}).select(texels.columns)


def add_channel(texels: DataFrame, source: DataFrame, source_channel: str, channel: str, scale: float) -> DataFrame:
    rows = _beside(texels, source)
    return T.changed(rows, **{channel: F.col(channel) + F.coalesce(F.col(f"_{source_channel}"), F.lit(0.0)) * scale}).select(texels.columns)


def copy_box(texels: DataFrame, source: DataFrame, at: tuple, size: tuple, to: tuple) -> DataFrame:
    """The box of source at ``at`` of ``size`` (x, y) over texels at ``to``."""
    box = source.where(F.col("x").between(at[0], at[0] + size[0] - 1) & F.col("y").between(at[1], at[1] + size[1] - 1))
    moved = box.withColumns({"x": F.col("x") + (to[0] - at[0]), "y": F.col("y") + (to[1] - at[1])})
    rows = _beside(texels, moved)
    return T.changed(rows, **{c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in CHANNELS}).select(texels.columns)


def difference(reference: DataFrame, image: DataFrame, scale: float = 1.0, transparent: bool = False) -> DataFrame:
    """(image - reference) * scale, times the reference's alpha if that is transparency; with the reference's alpha."""
    rows = _beside(image, reference, "inner")
    weight = F.col("_a") * scale if transparent else F.lit(scale)
    return T.changed(rows, **{c: (F.col(c) - F.col(f"_{c}")) * weight for c in T.RGB}, a=F.col("_a")).select(image.columns)


def warped(texels: DataFrame, grid: DataFrame, of, width: int, height: int) -> DataFrame:
    """For each place of grid the bilinear sample at (fx, fy) = of(x, y), columns in texels of the source, clamped."""
    fx, fy = of(F.col("x"), F.col("y"))
    rows = grid.select(*PLACE, fx.alias("_fx"), fy.alias("_fy"))
    x0, y0 = F.floor("_fx"), F.floor("_fy")
    tap = lambda dx, dy: F.struct(clamp(x0 + dx, 0, width - 1).cast("int").alias("x"), clamp(y0 + dy, 0, height - 1).cast("int").alias("y"), ((F.col("_fx") - x0 if dx else 1 - F.col("_fx") + x0) * (F.col("_fy") - y0 if dy else 1 - F.col("_fy") + y0)).alias("w"))
    taps = rows.select(*PLACE, F.explode(F.array(*[tap(dx, dy) for dx in (0, 1) for dy in (0, 1)])).alias("t"))
    taps = taps.select("surface_id", "z", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), "t.w")
    sums = taps.join(texels, list(PLACE)).groupBy("surface_id", "z", "_y", "_x").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in CHANNELS])
    return sums.select("surface_id", "z", F.col("_y").alias("y"), F.col("_x").alias("x"), *CHANNELS)
