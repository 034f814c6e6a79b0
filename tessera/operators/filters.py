"""Neighbourhoods: convolution, resampling, mip levels and normal maps.

Filter weights are a relation (dst, src, w), made by Spark from the filter's formula, so that it grows with the extent
and not in the driver. An axis is resampled by an equi-join of texels and weights on the source index and a sum for
each destination: separable filters are two such steps, and partial sums are folded before they are exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.operators.tiles import Extents, convolved
from tessera.operators.wraps import wrapped
from tessera.sources.relations import CHANNELS, clamp

Filter = tuple[float, Callable[[Column], Column]]


def _sinc(x: Column) -> Column:
    x = x * math.pi
    small = F.abs(x) < 1e-4
    return F.when(small, 1 - x * x / 6).otherwise(F.sin(x) / F.when(small, 1.0).otherwise(x))


def _bessel0(x: Column, terms: int = 24) -> Column:
    """The modified Bessel function of order 0 by its power series, by Horner's rule."""
    falling = F.array(*[F.lit(1.0 / math.factorial(k) ** 2) for k in reversed(range(terms))])
    return F.aggregate(falling, F.lit(0.0), lambda total, c: total * (x * x / 4) + c)


def box(width: float = 0.5) -> Filter:
    return width, lambda x: F.when(F.abs(x) <= width, 1.0).otherwise(0.0)


def triangle(width: float = 1.0) -> Filter:
    return width, lambda x: F.greatest(width - F.abs(x), F.lit(0.0))


def quadratic() -> Filter:
    def f(x):
        x = F.abs(x)
        return F.when(x < 0.5, 0.75 - x * x).when(x < 1.5, (x - 1.5) * (x - 1.5) * 0.5).otherwise(0.0)

    return 1.5, f


def cubic() -> Filter:
    return 1.0, lambda x: F.when(F.abs(x) < 1, (F.abs(x) * 2 - 3) * x * x + 1).otherwise(0.0)


def mitchell(b: float = 1 / 3, c: float = 1 / 3) -> Filter:
    """The two-parameter family of cubic filters."""

    def f(x):
        x = F.abs(x)
        inner = (x * (12 - 9 * b - 6 * c) + (12 * b + 6 * c - 18)) * x * x + (6 - 2 * b)
        outer = ((x * (-b - 6 * c) + (6 * b + 30 * c)) * x - (12 * b + 48 * c)) * x + (8 * b + 24 * c)
        return F.when(x < 1, inner / 6).when(x < 2, outer / 6).otherwise(0.0)

    return 2.0, f


def bspline() -> Filter:
    return 2.0, mitchell(1.0, 0.0)[1]


def lanczos() -> Filter:
    return 3.0, lambda x: F.when(F.abs(x) < 3, _sinc(x) * _sinc(x / 3)).otherwise(0.0)


def sinc(width: float = 3.0) -> Filter:
    return width, _sinc


def kaiser(width: float = 3.0, alpha: float = 4.0, stretch: float = 1.0) -> Filter:
    def f(x):
        inside = 1 - x * x / (width * width)
        window = _bessel0(F.sqrt(F.greatest(inside, F.lit(0.0))) * alpha) / _bessel0(F.lit(alpha))
        return F.when(inside >= 0, _sinc(x * stretch) * window).otherwise(0.0)

    return width, f


def gaussian(variance: float = 1.0, width: float = 3.0) -> Filter:
    return width, lambda x: F.exp(-x * x / (2 * variance)) / math.sqrt(2 * math.pi * variance)


def polyphase(spark: SparkSession, shape: Filter, src: int, dst: int, mode: str = "mirror", samples: int = 32) -> DataFrame:
    """(dst, src, w): the weights of a resampling, of sum 1 for each destination; equal sources are added up."""
    width, f = shape
    scale, step = dst / src, src / dst
    if scale > 1:
        scale, samples = 1.0, 1
    reach = width * step
    taps = math.ceil(reach * 2) + 1
    centre = (F.col("dst") + 0.5) * step
    rows = spark.range(dst).select(F.col("id").cast("int").alias("dst"))
    rows = rows.select("dst", centre.alias("centre"), F.floor(centre - reach).alias("left"))
    rows = rows.select("dst", "centre", F.explode(F.sequence(F.col("left"), F.col("left") + (taps - 1))).alias("at"))
    rows = rows.select("dst", "at", "centre", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    rows = rows.select("dst", "at", ((F.col("at") - F.col("centre") + (F.col("k") + 0.5) / samples) * scale).alias("u"))
    rows = rows.groupBy("dst", "at").agg(F.avg(f(F.col("u"))).alias("w"))
    rows = rows.select("dst", wrapped(F.col("at"), src, mode).cast("int").alias("src"), "w")
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("dst")))
    return rows.groupBy("dst", "src").agg(F.sum("w").alias("w")).where("w <> 0")


def kernel1(spark: SparkSession, shape: Filter, scale: int, samples: int = 32) -> DataFrame:
    """(i, w): a filter widened ``scale`` times as weights of sum 1 of whole offsets, each the mean of ``samples`` values
    of the filter within its texel; offset 0 is at i = window / 2."""
    width, f = shape
    window = math.ceil(2 * width * scale)
    rows = spark.range(window).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    at = (F.col("i") - window / 2 + (F.col("k") + 0.5) / samples) / scale
    rows = rows.groupBy("i").agg(F.avg(f(at)).alias("w"))
    return rows.select("i", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("w"))  # window rows, a parameter


def resample_axis(texels: DataFrame, weights: DataFrame, axis: str) -> DataFrame:
    rest = [c for c in ("surface_id", "z", "y", "x") if c != axis]
    rows = texels.join(weights, F.col(axis) == F.col("src"))
    out = rows.groupBy(*rest, "dst").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in CHANNELS])
    return out.withColumnRenamed("dst", axis).select("surface_id", "z", "y", "x", *CHANNELS)


def resize(texels: DataFrame, size: tuple[int, ...], to: tuple[int, ...], shape: Filter | None = None, mode: str = "mirror") -> DataFrame:
    """Surfaces of extent ``size`` (width, height and, of volumes, depth) at the extent ``to``; an axis that keeps its
    extent isn't touched."""
    shape, spark = shape or box(), texels.sparkSession
    for axis, src, dst in zip("xyz", size, to, strict=False):
        if src != dst:
            texels = resample_axis(texels, polyphase(spark, shape, src, dst, mode), axis)
    return texels


def solid_mip(texels: DataFrame, colour) -> DataFrame:
    """The next mip level of each surface (slice 0), of one colour; none of a surface of one texel."""
    extents = texels.groupBy("surface_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), (F.max("z") + 1).alias("d")).where("w > 1 OR h > 1 OR d > 1")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.col(c) / 2).cast("int")) - 1))
    rows = extents.select("surface_id", "w", F.lit(0).alias("z"), every("h").alias("y")).select("surface_id", "z", "y", every("w").alias("x"))
    return rows.select("*", *[F.lit(float(v)).alias(c) for c, v in zip(CHANNELS, colour, strict=True)])


def halving(spark: SparkSession, extent: int) -> DataFrame:
    """(dst, src, w) of the fast down-sampling: pairs, or for odd extents three texels that overlap."""
    half = extent // 2
    if extent == 1:
        return spark.range(1).select(F.lit(0).alias("dst"), F.lit(0).alias("src"), F.lit(1.0).alias("w"))
    rows = spark.range(half).select(F.col("id").cast("int").alias("dst"))
    w = [F.lit(0.5), F.lit(0.5)] if extent % 2 == 0 else [(half - F.col("dst")) / float(extent), F.lit(half / extent), (F.col("dst") + 1) / float(extent)]
    taps = F.explode(F.array(*[F.struct((F.col("dst") * 2 + i).alias("src"), x.alias("w")) for i, x in enumerate(w)]))
    return rows.select("dst", taps.alias("t")).select("dst", "t.src", "t.w")


def fast_down_sample(texels: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The next mip level by the box filter. For even extents it is one grouped mean."""
    if size[0] % 2 == 0 and size[1] % 2 == 0:
        key = ["surface_id", "z", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")]
        return texels.groupBy(*key).agg(*[F.avg(c).alias(c) for c in CHANNELS])
    across = resample_axis(texels, halving(texels.sparkSession, size[0]), "x")
    return resample_axis(across, halving(texels.sparkSession, size[1]), "y")


def next_extent(size: tuple[int, int]) -> tuple[int, int]:
    return max(1, size[0] // 2), max(1, size[1] // 2)


def mip_extents(size: tuple[int, int]) -> list[tuple[int, int]]:
    out = [size]
    while max(out[-1]) > 1:
        out.append(next_extent(out[-1]))
    return out


def mip_chain(texels: DataFrame, size: tuple[int, int], shape: Filter | None = None, levels: int | None = None) -> DataFrame:
    """texels with a column mip: the surface and its levels. The box filter halves level by level; with another filter
    each level is made from the one above."""
    out, level, at = texels.withColumn("mip", F.lit(0)), texels, size
    for n, to in enumerate(mip_extents(size)[1:levels], 1):
        level = fast_down_sample(level, at) if shape is None else resize(level, at, to, shape)
        out, at = out.unionByName(level.withColumn("mip", F.lit(n))), to
    return out


def kernel(name: str) -> list[list[float]]:
    """Square kernels by name: laplacian, edge, prewitt3, prewitt5, sobel3, sobel5, sobel7, sobel9."""
    if name == "laplacian":
        return [[0, -1, 0], [-1, 4, -1], [0, -1, 0]]
    if name == "edge":
        return [[0, 0, 0], [-1, 0, 1], [0, 0, 0]]
    if name == "prewitt3":  # both outer columns, as in the engine whose results are matched
        return [[-1, 0, -1]] * 3
    if name == "prewitt5":
        return [[-2, -1, 0, 1, 2]] * 5
    n = int(name.removeprefix("sobel"))
    h = (n - 1) // 2
    return [[math.copysign(2 * h + 1 - abs(c - h) - abs(r - h), c - h) if c != h else 0.0 for c in range(n)] for r in range(n)]


def blended_sobel(small: float = 1.0, medium: float = 0.5, large: float = 0.25, huge: float = 0.125) -> list[list[float]]:
    """9 x 9: the four Sobel sizes about one centre."""
    out = [[0.0] * 9 for _ in range(9)]
    for weight, n in ((small, 3), (medium, 5), (large, 7), (huge, 9)):
        k, off = kernel(f"sobel{n}"), (9 - n) // 2
        for r in range(n):
            for c in range(n):
                out[r + off][c + off] += weight * k[r][c]
    return out


def normalized(k: list[list[float]]) -> list[list[float]]:
    total = sum(abs(v) for row in k for v in row)
    return [[v / total for v in row] for row in k]


def convolve(texels: DataFrame, k: list[list[float]], size: Extents, channel: str, mode: str = "mirror") -> DataFrame:
    rows = convolved(texels, {"_sum": k}, size, channel, mode)
    return T.changed(rows, **{channel: F.col("_sum")}).select(texels.columns)


def to_normal_map(texels: DataFrame, size: Extents, weights=(1 / 1.875, 0.5 / 1.875, 0.25 / 1.875, 0.125 / 1.875), mode: str = "mirror") -> DataFrame:
    """Normals of the height in alpha; alpha stays. size: of all surfaces, or a relation of their extents."""
    du = normalized(blended_sobel(*weights))
    dv = [list(row) for row in zip(*du, strict=True)]
    rows = convolved(texels, {"_du": du, "_dv": dv}, size, "a", mode)
    return T.normalize(T.changed(rows, r=F.col("_du"), g=F.col("_dv"), b=F.lit(1 / 16))).select(texels.columns)


def scale_to_coverage(texels: DataFrame, size: tuple[int, int], wanted: float, reference: float, channel: str = "a", steps: int = 10) -> tuple[DataFrame, float]:
    """One surface with ``channel`` scaled so that its alpha-test coverage comes nearest to wanted, and the scale: a
    bisection of [0, 4], one aggregate a step over quads that are gathered once and kept until the end."""
    from tessera.operators.stats import quads, quad_coverage

    low, high, scale, best, least = 0.0, 4.0, 1.0, 1.0, math.inf
    kept = quads(texels, *size, channel).persist()
    for _ in range(steps):
        row = quad_coverage(kept, *size, reference, scale).first()
        got = row["coverage"] if row else 0.0
        if abs(got - wanted) < least:
            best, least = scale, abs(got - wanted)
        if got == wanted:
            break
        low, high = (scale, high) if got < wanted else (low, scale)
        scale = (low + high) / 2
    kept.unpersist()
    return T.each(texels, lambda c: clamp(c * best), (channel,)), best


def bytes_to_normal_map(texels: DataFrame, size: Extents, height=(0.0, 0.0, 0.0, 1.0), sobel: int | tuple = 3, mode: str = "mirror") -> DataFrame:
    """Packed normals (0..1) of texels of 0..255: the height is a weighted sum of the channels, and goes to alpha. sobel
    is the size of the kernel, or the four weights of a blended one."""
    weighted = sum((F.col(c) / 255 * w for c, w in zip(CHANNELS, height, strict=True)), F.lit(0.0))
    rows = T.changed(texels, a=weighted)
    du = normalized(kernel(f"sobel{sobel}") if isinstance(sobel, int) else blended_sobel(*sobel))
    rows = convolved(rows, {"_du": du, "_dv": [list(row) for row in zip(*du, strict=True)]}, size, "a", mode)
    return T.pack_normals(T.normalize(T.changed(rows, r=F.col("_du"), g=F.col("_dv"), b=F.lit(1 / 16)))).select(texels.columns)
