"""Per-texel maps: each takes texels and returns texels, as one projection of column expressions.

Channels that a map doesn't name pass through. All stay in the JVM, and Catalyst fuses chains of them into one stage.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.relations import CHANNELS, clamp



class _Channels:
    """C.r is the column r, made when it is asked for."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


C = _Channels()
RGB = ("r", "g", "b")
NEWTON_STEPS = 12


def changed(texels: DataFrame, **channels: Column) -> DataFrame:
    """texels with these channels replaced, all from the old values."""
    return texels.select([channels[c].cast("double").alias(c) if c in channels else c for c in texels.columns])


def each(texels: DataFrame, of, channels=RGB) -> DataFrame:
    return changed(texels, **{c: of(F.col(c)) for c in channels})


def highest(*columns: Column) -> Column:
    return F.greatest(*columns)


def half_even(c: Column) -> Column:
    return F.rint(c)


# colour spaces


def to_linear(texels, gamma: float = 2.2, channels=RGB):
    return texels if gamma == 1 else each(texels, lambda c: F.pow(F.greatest(c, F.lit(0.0)), F.lit(gamma)), channels)


def to_gamma(texels, gamma: float = 2.2, channels=RGB):
    return texels if gamma == 1 else each(texels, lambda c: F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / gamma)), channels)


def srgb_encode(c: Column) -> Column:
    ladder = F.when(F.isnan(c) | (c <= 0), 0.0).when(c <= 0.0031308, c * 12.92)
    return ladder.when(c <= 1, F.pow(c, F.lit(0.41666)) * 1.055 - 0.055).otherwise(1.0)


def srgb_decode(c: Column) -> Column:
    ladder = F.when(c < 0, 0.0).when(c < 0.04045, c / 12.92)
    return ladder.when(c <= 1, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(1.0)


def to_srgb(texels):
    return each(texels, srgb_encode)


def from_srgb(texels):
    return each(texels, srgb_decode)


def _srgb_roots(c: Column) -> Column:
    s = clamp(c)
    roots = [F.sqrt(s), F.sqrt(F.sqrt(s)), F.sqrt(F.sqrt(F.sqrt(s))), s]
    # fixed values: the fit of the encoding by square roots
    return reduce(lambda t, kr: t + kr[0] * kr[1], zip((F.lit(x) for x in (0.662002687, 0.684122060, -0.323583601, -0.0225411470)), roots, strict=True), F.lit(0.0))


def to_srgb_fast(texels):
    return each(texels, _srgb_roots)


def from_srgb_fast(texels):
    # fixed values: the cubic fit of the decoding
    return each(texels, lambda c: clamp(c) * (clamp(c) * (clamp(c) * 0.305306011 + 0.682171111) + 0.012522878))


def to_console_srgb(texels):
    """Five straight pieces: slopes 4, 2, 1 and a half between the knots, then 1."""

    def pieces(c: Column) -> Column:
        out = F.when(c < 0, 0.0)
        for end, base, slope, start in ((1 / 16, 0.0, 4.0, 0.0), (1 / 8, 0.25, 2.0, 1 / 16), (0.5, 0.375, 1.0, 1 / 8), (1.0, 0.75, 0.5, 0.5)):
            out = out.when(c < end, (c - start) * slope + base)
        return out.otherwise(1.0)

    return each(texels, pieces)


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE XYZ of gamma-2.2 colours."""
    lin = [F.pow(F.greatest(c, F.lit(0.0)), F.lit(2.2)) for c in (r, g, b)]
    # fixed values: the matrix from linear RGB
    rows = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
    return tuple(lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2] for m in rows)


def lab(r: Column, g: Column, b: Column, strict: bool = False) -> tuple[Column, Column, Column]:
    """CIE Lab. Lightness is taken from X, as in the engine whose results are matched; from Y if strict."""
    white = (0.950456, 1.0, 1.088754)
    part = [F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * ((29 / 6) ** 2 / 3) + 4 / 29) for t in (c / w for c, w in zip(xyz(r, g, b), white, strict=True))]
    return part[1 if strict else 0] * 116 - 16, (part[0] - part[1]) * 500, (part[1] - part[2]) * 200


def to_lab(texels, strict: bool = False):
    return changed(texels, **dict(zip(RGB, lab(C.r, C.g, C.b, strict), strict=True)))


def lch(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lightness, chroma and hue of Lab; the hue angle is that of (b, a), as in the engine whose results are matched."""
    return lightness, F.sqrt(a * a + b * b), F.atan2(a, b)


def to_lch(texels, strict: bool = False):
    rows = to_lab(texels, strict)
    return changed(rows, **dict(zip(RGB, lch(C.r, C.g, C.b), strict=True)))


def to_xyz(texels):
    return changed(texels, **dict(zip(RGB, xyz(C.r, C.g, C.b), strict=True)))


def from_xyz(texels):
    """Gamma-2.2 colours of CIE XYZ; what is below zero is zero."""
    # fixed values: the matrix to linear RGB
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    out = [F.pow(F.greatest(C.r * m[0] + C.g * m[1] + C.b * m[2], F.lit(0.0)), F.lit(1 / 2.2)) for m in rows]
    return changed(texels, **dict(zip(RGB, out, strict=True)))


def from_lab(texels):
    """CIE XYZ colours of true Lab (lightness from Y) through from_xyz."""
    fy = (C.r + 16) / 116
    part = lambda t: F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) * (3 * (6 / 29) ** 2))
    white = (0.950456, 1.0, 1.088754)
    back = [part(t) * w for t, w in zip((fy + C.g / 500, fy, fy - C.b / 200), white, strict=True)]
    return from_xyz(changed(texels, **dict(zip(RGB, back, strict=True))))


def to_ycocg(texels):
    return changed(texels, r=C.r - C.b, g=(C.g * 2 - C.r - C.b) / 2, b=F.lit(1.0), a=(C.g * 2 + C.r + C.b) / 4)


def from_ycocg(texels):
    co, cg = C.r * C.b / 2, C.g * C.b / 2
    return changed(texels, r=C.a + co - cg, g=C.a + cg, b=C.a - co - cg, a=F.lit(1.0))


# linear maps


def transform(texels, columns, offset=(0.0, 0.0, 0.0, 0.0)):
    """out_i = r columns[0][i] + g columns[1][i] + b columns[2][i] + a columns[3][i] + offset[i]"""
    out = [reduce(lambda s, x: s + x, [v * w[i] for v, w in zip((C.r, C.g, C.b, C.a), columns, strict=True)]) + offset[i] for i in range(4)]
    return changed(texels, **dict(zip(CHANNELS, out, strict=True)))


def swizzle(texels, order):
    """Selectors 0-3 are channels, 4 is one, 5 zero and 6 minus one."""
    if tuple(order) == (0, 1, 2, 3):
        return texels
    choice = [C.r, C.g, C.b, C.a, F.lit(1.0), F.lit(0.0), F.lit(-1.0)]
    return changed(texels, **dict(zip(CHANNELS, (choice[i] for i in order), strict=True)))


def scale_bias(texels, scale: float, bias: float, channels=CHANNELS):
    return texels if (scale, bias) == (1, 0) else each(texels, lambda c: c * scale + bias, channels)


def clamped(texels, low: float = 0.0, high: float = 1.0, channels=CHANNELS):
    return each(texels, lambda c: clamp(c, low, high), channels)


def blend(texels, colour, t: float):
    return changed(texels, **{c: F.col(c) + (F.lit(float(k)) - F.col(c)) * t for c, k in zip(CHANNELS, colour, strict=True)})


def premultiply(texels):
    return each(texels, lambda c: c * C.a)


def greyscale(texels, weights=(2.0, 5.0, 1.0, 0.0)):
    total = sum(weights)
    grey = reduce(lambda s, x: s + x, [c * (w / total) for c, w in zip((C.r, C.g, C.b, C.a), weights, strict=True)])
    return changed(texels, **dict.fromkeys(CHANNELS, grey))


def fill(texels, colour):
    return changed(texels, **{c: F.lit(float(k)) for c, k in zip(CHANNELS, colour, strict=True)})


def absolute(texels, channels=CHANNELS):
    return each(texels, F.abs, channels)


def to_log(texels, base: float, channels=RGB):
    """Zero becomes minus infinity, less than zero NaN."""
    log = lambda c: F.when(c > 0, F.log2(c) / math.log2(base)).when(c == 0, float("-inf")).otherwise(float("nan"))
    return each(texels, log, channels)


def from_log(texels, base: float, channels=RGB):
    return each(texels, lambda c: F.pow(F.lit(2.0), c * math.log2(base)), channels)


# tone maps and packings of high range


def tone_linear(texels):
    top = highest(C.r, C.g, C.b)
    return each(texels, lambda c: F.when(top > 1, c / F.greatest(top, F.lit(1.0))).otherwise(c))


def tone_reinhard(texels):
    return each(texels, lambda c: F.try_divide(c, c + 1))


def tone_halo(texels):
    return each(texels, lambda c: 1 - F.pow(F.lit(2.0), -c))


def to_rgbm(texels, threshold: float = 0.25):
    """Colour over M, and M in alpha: of the 8-bit values of M near the largest channel the one of least error, the
    lower one of equals. Colours are clamped to 0..1 first."""
    t = min(max(threshold, 1e-6), 1.0)
    r, g, b = (clamp(c) for c in (C.r, C.g, C.b))
    steps = F.ceil((F.greatest(r, g, b, F.lit(t)) - t) / (1 - t if t < 1 else 1.0) * 255)
    levels = F.sequence(F.greatest(steps - 16, F.lit(0)), F.least(steps + 16, F.lit(256)) - 1)
    scale = lambda m: m / 255.0 * (1 - t) + t

    def error(m: Column) -> Column:
        off = [c - half_even(clamp(c / scale(m)) * 255) / 255 * scale(m) for c in (F.col("_r"), F.col("_g"), F.col("_b"))]
        return F.struct((off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("e"), m.alias("m"))

    rows = texels.withColumns({"_r": r, "_g": g, "_b": b, "_levels": levels})
    best = scale(F.array_min(F.transform("_levels", error))["m"])
    rows = rows.withColumn("_m", best)
    m = F.col("_m")
    out = changed(rows, r=clamp(F.col("_r") / m), g=clamp(F.col("_g") / m), b=clamp(F.col("_b") / m), a=(m - t) / (1 - t if t < 1 else 1.0))
    return out.select(texels.columns)


def from_rgbm(texels, range_: float = 1.0, threshold: float = 0.25):
    t = min(max(threshold, 1e-6), 1.0)
    m = C.a * (range_ - t) + t
    return changed(texels, r=C.r * m, g=C.g * m, b=C.b * m, a=F.lit(1.0))


def to_lm(texels, threshold: float = 0.25):
    """Grey over M in all colours, and M in alpha: M is the largest channel of the colour clamped to 0..1. There is no
    range: the engine whose results are matched takes one and leaves it out. A threshold of 1 makes alpha NaN."""
    t = min(max(threshold, 1e-6), 1.0)
    r, g, b = (clamp(c) for c in (C.r, C.g, C.b))
    m = F.greatest(r, g, b, F.lit(t))
    light = (r + g + b) / 3 / m
    return changed(texels, r=light, g=light, b=light, a=(m - t) / (1 - t) if t < 1 else F.lit(float("nan")))


def to_rgbe(texels, mantissa: int = 9, exponent: int = 5):
    """Shared exponents of up to 7 bits: integers over their largest value in all four channels."""
    bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1
    most = top / 2.0**exponent * 2.0 ** (top - bias)
    r, g, b = (clamp(c, 0.0, most) for c in (C.r, C.g, C.b))
    high = F.greatest(r, g, b)
    e0 = F.greatest(F.lit(-bias - 1.0), F.when(high > 0, F.floor(F.log2(high)).cast("double")).otherwise(-bias - 1.0)) + 1 + bias
    unit0 = F.pow(F.lit(2.0), e0 - bias - mantissa)
    carry = half_even(high / unit0) == 2**mantissa
    e, unit = F.when(carry, e0 + 1).otherwise(e0), F.when(carry, unit0 * 2).otherwise(unit0)
    put = lambda c: F.floor(c / unit + 0.5) / (2.0**mantissa - 1)
    return changed(texels, r=put(r), g=put(g), b=put(b), a=e / float(top))


def from_rgbe(texels, mantissa: int = 9, exponent: int = 5):
    bias = 2 ** (exponent - 1) - 1
    unit = F.pow(F.lit(2.0), half_even(C.a * (2.0**exponent - 1)) - bias - mantissa)
    return changed(texels, **{c: half_even(F.col(c) * (2.0**mantissa - 1)) * unit for c in RGB}, a=F.lit(1.0))


def to_luvw(texels, range_: float = 1.0):
    r, g, b = (clamp(c / range_) for c in (C.r, C.g, C.b))
    length = F.greatest(F.sqrt(r * r + g * g + b * b), F.lit(1e-6))
    return changed(texels, r=r / length, g=g / length, b=b / length, a=length / math.sqrt(3))


def from_luvw(texels, range_: float = 1.0):
    return from_rgbm(texels, range_ * math.sqrt(3))


# quantisation


def binarize(texels, threshold: float = 0.5, channels=CHANNELS):
    return each(texels, lambda c: (c > threshold).cast("double"), channels)


def quantized(c: Column, bits: int, exact: bool = True) -> Column:
    scale, before, after = (2**bits - 1, 0.5, 0.0) if exact else (2**bits, 0.0, 0.5)
    return clamp((F.floor(c * scale + before) + after) / scale)


def quantize(texels, bits: int, exact: bool = True, channels=RGB):
    return each(texels, lambda c: quantized(c, bits, exact), channels)


def quantize_sizes(texels, sizes=(5, 6, 5)):
    return changed(texels, **{c: quantized(F.col(c), n) for c, n in zip(RGB, sizes, strict=True)})


def to_bytes(texels):
    """Integers 0..255, truncated."""
    return texels.select(*[c for c in texels.columns if c not in CHANNELS], *[clamp((F.col(c) * 255).cast("int"), 0, 255).cast("int").alias(c) for c in CHANNELS])


def replicate(c: Column, bits: int, out: int) -> Column:
    """An integer of ``bits`` bits as one of ``out`` bits, its bits repeated below."""
    if bits == 0:
        return F.lit(0)
    if bits >= out:
        return F.shiftright(c, bits - out)
    return F.shiftleft(c, out - bits).bitwiseOR(replicate(c, bits, out - bits))


def to_565(r: Column, g: Column, b: Column) -> Column:
    """Bytes to 5-6-5 bits, the upper ones kept."""
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def from_565(c: Column) -> tuple[Column, Column, Column]:
    field = lambda shift, bits: replicate(F.shiftright(c, shift).bitwiseAND(2**bits - 1), bits, 8)
    return field(11, 5), field(5, 6), field(0, 5)


def colour_distance(a: tuple, b: tuple) -> Column:
    """Perceptual distance of two colours, weighted by their mean red."""
    dr, dg, db = (x - y for x, y in zip(a, b, strict=True))
    mean = (a[0] + b[0]) / 2
    return F.sqrt((mean + 2) * dr * dr + dg * dg * 4 + (3 - mean) * db * db)


# normals


def normalize(texels):
    """Unit vectors; zero stays zero."""
    length = F.sqrt(C.r * C.r + C.g * C.g + C.b * C.b)
    return each(texels, lambda c: F.when(length > 0, c / F.when(length > 0, length)).otherwise(c))


def pack_normals(texels):
    return scale_bias(texels, 0.5, 0.5, RGB)


def expand_normals(texels):
    return scale_bias(texels, 2.0, -1.0, RGB)


def transform_normals(texels, kind: str):
    """To a plane: orthographic, stereographic, paraboloid or quartic; normals are made unit vectors first. The quartic
    surface z = (1 - x x)(1 - y y) is met by Newton steps from the paraboloid."""
    n = normalize(texels)
    if kind == "orthographic":
        return changed(n, b=F.lit(0.0))
    if kind == "stereographic":
        return changed(n, r=F.try_divide(C.r, C.b + 1), g=F.try_divide(C.g, C.b + 1), b=F.lit(0.0))
    square = C.r * C.r + C.g * C.g
    t = F.try_divide(F.sqrt(C.b * C.b + square * 4) - C.b, square * 2)
    if kind == "quartic":
        both = C.r * C.r * C.g * C.g

        def step(t, _):
            value = 1 - C.b * t - square * t * t + both * t * t * t * t
            return t - F.try_divide(value, both * t * t * t * 4 - square * t * 2 - C.b)

        t = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), t, step)
    # a column of its own: a fold that two columns of one projection share isn't evaluated twice alike
    return changed(n.withColumn("_t", t), r=C.r * C._t, g=C.g * C._t, b=F.lit(0.0)).drop("_t")


def reconstruct_normals(texels, kind: str):
    s = clamp(C.r * C.r + C.g * C.g)
    if kind == "orthographic":
        return changed(texels, b=F.sqrt(1 - s))
    if kind == "stereographic":
        d = F.lit(2.0) / (s + 1)
        return changed(texels, r=C.r * d, g=C.g * d, b=d - 1)
    if kind == "paraboloid":
        return normalize(changed(texels, b=1 - s))
    return normalize(changed(texels, b=clamp((1 - C.r * C.r) * (1 - C.g * C.g))))


def clean_normals(texels):
    return changed(texels, b=C.r * C.r + C.g * C.g)


def harmonics(x: Column, y: Column, z: Column) -> list[Column]:
    """The nine real spherical harmonics up to order 2 of a direction."""
    # fixed values: the normalisation of each order
    k0, k1, k2, k3, k4 = 0.2820948, 0.4886025, 1.0925484, 0.9461747, 0.5462742
    return [F.lit(k0), y * -k1, z * k1, x * -k1, x * y * k2, y * z * -k2, z * z * k3 - 0.3153916, x * z * -k2, (x * x - y * y) * k4]


def harmonics_to(order: int, x: Column, y: Column, z: Column) -> dict[tuple[int, int], Column]:
    """The real spherical harmonics of a direction by (band, argument), up to band ``order``: associated Legendre functions
    by their recurrences over bands, without the power of the sine, which is with the powers of x + iy."""
    powers = [(F.lit(1.0), F.lit(0.0))]
    for _ in range(order):
        re, im = powers[-1]
        powers.append((re * x - im * y, re * y + im * x))
    out, before = {}, {}
    for m in range(order + 1):
        double = math.prod(range(2 * m - 1, 0, -2)) * (-1) ** m
        for band in range(m, order + 1):
            if band == m:
                value = F.lit(float(double))
            elif band == m + 1:
                value = z * (2 * m + 1) * before[m]
            else:
                value = (z * (2 * band - 1) * before[band - 1] - before[band - 2] * (band + m - 1)) / (band - m)
            before[band] = value
            size = math.sqrt((2 * band + 1) * math.factorial(band - m) / (4 * math.pi * math.factorial(band + m)))
            if m == 0:
                out[band, 0] = value * size
            else:
                out[band, m], out[band, -m] = (value * part * (size * math.sqrt(2)) for part in powers[m])
    return out
