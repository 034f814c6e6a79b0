"""Sampling at real coordinates: nearest and linear, for each wrap, in two and three dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.wraps import wrapped
from tessera.sources.relations import CHANNELS


def _axes(extents: tuple[int, ...]) -> list[tuple[str, str, int]]:
    return list(zip("uvw", "xyz", extents, strict=False))


def sample_nearest(points: DataFrame, texels: DataFrame, width: int, height: int, mode: str = "clamp", depth: int | None = None) -> DataFrame:
    """points (surface_id, id, u, v, and w of volumes) with the texel nearest to (u width, v height, w depth), rounded
    half up; coordinates of 0..1 without a half-texel shift. Without a depth slice 0 is sampled."""
    axes = _axes((width, height) if depth is None else (width, height, depth))
    rows = points.select("surface_id", "id", *[wrapped(F.floor(F.col(c) * n + 0.5), n, mode).cast("int").alias(axis) for c, axis, n in axes])
    source = texels.where("z = 0") if depth is None else texels
    return rows.join(source, ["surface_id", *[axis for _, axis, _ in axes]]).select("surface_id", "id", *CHANNELS)


def sample_linear(points: DataFrame, texels: DataFrame, width: int, height: int, mode: str = "clamp", depth: int | None = None, corrected: bool = False) -> DataFrame:
    """points with the linear mean of the two texels below and above the place on each axis, each wrapped. Mirrored
    sampling begins at the rounded place, as in the engine whose results are matched, and at the place below, as the
    other modes do, if corrected."""
    axes = _axes((width, height) if depth is None else (width, height, depth))
    taps = [([], F.lit(1.0))]
    for c, axis, n in axes:
        at = F.col(c) * n
        below = F.floor(at)
        start = F.floor(at + 0.5) if mode == "mirror" and not corrected else below
        taps = [([*fields, wrapped(start + d, n, mode).cast("int").alias(axis)], w * (at - below if d else 1 - (at - below))) for fields, w in taps for d in (0, 1)]
    rows = points.select("surface_id", "id", F.explode(F.array(*[F.struct(*fields, w.alias("weight")) for fields, w in taps])).alias("t"))
    rows = rows.select("surface_id", "id", "t.*").join(texels.where("z = 0") if depth is None else texels, ["surface_id", *[axis for _, axis, _ in axes]])
    return rows.groupBy("surface_id", "id").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in CHANNELS])


def bilinear_rms(texels: DataFrame, size: tuple[int, int], image: DataFrame, image_size: tuple[int, int], legacy: bool = True) -> DataFrame:
    """(surface_id, rms): each texel against the bilinear sample of an image of another extent at its corner. The
    legacy form compares alpha with the sample's blue."""
    points = texels.select("surface_id", (F.col("y") * size[0] + F.col("x")).alias("id"), (F.col("x") / float(size[0])).alias("u"), (F.col("y") / float(size[1])).alias("v"))
    other = sample_linear(points, image, *image_size).withColumnsRenamed({c: f"{c}2" for c in CHANNELS})
    rows = texels.withColumn("id", F.col("y") * size[0] + F.col("x")).join(other, ["surface_id", "id"])
    parts = [(c, f"{c}2") for c in "rgb"] + [("a", "b2" if legacy else "a2")]
    return rows.groupBy("surface_id").agg(F.sqrt(F.avg(sum((F.pow(F.col(p) - F.col(q), 2) for p, q in parts), F.lit(0.0)))).alias("rms"))
