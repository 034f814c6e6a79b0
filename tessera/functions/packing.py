"""Numbers in few bits: half, 11- and 10-bit floats, shared exponents, bit fields, and texels packed to rows of bytes.

All are column expressions on doubles and longs; a packed value is a long that holds an unsigned integer.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.texel import replicate
from tessera.sources.relations import CHANNELS, clamp


def exponent(x: Column) -> Column:
    """floor(log2(x)) of x > 0, exactly."""
    e = F.floor(F.log2(x))
    return F.when(F.pow(F.lit(2.0), e) > x, e - 1).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)


def two_to(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def to_half(c: Column) -> Column:
    """The 16 bits of the nearest half, halves up in magnitude, of a value that is taken as a 32-bit float first. Too
    large is infinite; below the normal range the mantissa is rounded as a normal one and then cut off."""
    x = c.cast("float").cast("double")
    size = F.abs(x)
    endless = size == float("inf")
    e = exponent(F.when((size > 0) & ~endless, size))
    mantissa = F.floor(size / two_to(e - 10) + 0.5)
    normal = ((e + 14) * 1024 + mantissa).cast("long")
    tiny = F.floor(F.when(mantissa == 2048, 1024).otherwise(mantissa) * two_to(e + 14)).cast("long")
    bits = F.when(F.isnan(x), 0x7E00).when(size == 0, 0).when(endless | (e > 15), 0x7C00).when(e >= -14, F.least(normal, F.lit(0x7C00))).otherwise(tiny)
    return bits.cast("long") + F.when(x < 0, 0x8000).otherwise(0)


def from_half(bits: Column) -> Column:
    e, m = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    sign = F.when(bits >= 0x8000, -1.0).otherwise(1.0)
    size = F.when(e == 0, m * 2.0**-24).when(e < 31, (m + 1024) * two_to(e - 25)).when(m == 0, float("inf")).otherwise(float("nan"))
    return F.when(bits.isNotNull(), sign * size)


def to_small_float(c: Column, mantissa: int) -> Column:
    """An unsigned float of 5 exponent bits and ``mantissa`` bits, cut off: 6 make 11 bits, 5 make 10. Less than zero is
    zero, more than the largest value is the largest. Below 2^-14 there is zero."""
    top = 65024.0 if mantissa == 6 else 64512.0
    x = clamp(c.cast("float").cast("double"), 0.0, top)
    e = exponent(F.when(x >= 2.0**-14, x))
    return F.coalesce(((e + 14) * 2**mantissa + F.floor(x / two_to(e - mantissa))).cast("long"), F.lit(0).cast("long"))


def from_small_float(bits: Column, mantissa: int) -> Column:
    e, m = F.shiftright(bits, mantissa), bits.bitwiseAND(2**mantissa - 1)
    whole = (m + 2**mantissa) * two_to(e - 15 - mantissa)
    return F.when(e == 0, m * 2.0 ** (-14 - mantissa)).when(e < 31, whole).when(m == 0, float("inf")).otherwise(float("nan"))


def to_9995(r: Column, g: Column, b: Column) -> Column:
    """Three mantissas of 9 bits, red lowest, below a shared exponent of 5 bits."""
    r, g, b = (clamp(c, 0.0, 65408.0) for c in (r, g, b))
    high = F.greatest(r, g, b)
    e = F.when(high > 0, F.greatest(exponent(F.when(high > 0, high)), F.lit(-16))).otherwise(-16) + 16
    e = F.when(F.floor(high / two_to(e - 24) + 0.5) == 512, e + 1).otherwise(e)
    put = lambda c: F.floor(c / two_to(e - 24) + 0.5).cast("long")
    return put(r) + put(g) * 2**9 + put(b) * 2**18 + e.cast("long") * 2**27


def from_9995(bits: Column) -> tuple[Column, Column, Column]:
    unit = two_to(F.shiftright(bits, 27) - 24)
    return tuple(F.shiftright(bits, s).bitwiseAND(511) * unit for s in (0, 9, 18))


def to_rgbe8(r: Column, g: Column, b: Column) -> Column:
    """Bytes r, g, b, exponent + 128, red lowest."""
    high = F.greatest(r, g, b)
    e = exponent(F.when(high >= 1e-32, high)) + 1
    put = lambda c: F.least(F.floor(c * two_to(8 - e) + 0.5), F.lit(255)).cast("long")
    return F.coalesce(put(r) + put(g) * 2**8 + put(b) * 2**16 + (e + 128).cast("long") * 2**24, F.lit(0).cast("long"))


def from_rgbe8(bits: Column) -> tuple[Column, Column, Column]:
    e = F.shiftright(bits, 24)
    return tuple(F.when(e != 0, F.shiftright(bits, s).bitwiseAND(255) * two_to(e - 136)).otherwise(0.0) for s in (0, 8, 16))


def mask_field(mask: int) -> tuple[int, int]:
    """(shift, size) of the lowest run of ones of a mask; (0, 0) of 0."""
    if not mask:
        return 0, 0
    shift = (mask & -mask).bit_length() - 1
    rest = mask >> shift
    return shift, ((rest ^ (rest + 1)).bit_length() - 1)


def size_masks(sizes: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The masks of channels of so many bits: alpha lowest, red highest."""
    out, shift = [], 0
    for size in reversed(sizes):
        out.append(((1 << size) - 1) << shift)
        shift += size
    return tuple(reversed(out))


def pack_unorm(values: tuple, masks: tuple, scale: float = 65535.0) -> Column:
    """Channels of 0..1 (or of 0..65535 with a scale of 1) rounded to 16 bits, converted to the sizes of the masks, and
    put there."""
    total = F.lit(0).cast("long")
    for c, mask in zip(values, masks, strict=True):
        shift, size = mask_field(mask)
        if size:
            wide = F.floor(clamp(c * scale, 0.0, 65535.0) + 0.5).cast("long")
            total = total + replicate(wide, 16, size) * 2**shift
    return total


def unpack_unorm(bits: Column, masks: tuple) -> list[Column]:
    """8-bit channels of packed values; a channel without a mask is 0, alpha 255."""
    out = []
    for i, mask in enumerate(masks):
        shift, size = mask_field(mask)
        out.append(replicate(F.shiftright(bits, shift).bitwiseAND(2**size - 1), size, 8).cast("int") if size else F.lit(255 if i == 3 else 0))
    return out


def put_float(c: Column, size: int) -> Column:
    """A channel as a float of 32, 16, 11 or 10 bits; other sizes are filled with zeros. 32 bits by way of exponent and
    mantissa, without denormal numbers."""
    if size == 16:
        return to_half(c)
    if size in (10, 11):
        return to_small_float(c, size - 5)
    if size != 32:
        return F.lit(0).cast("long")
    x = c.cast("float").cast("double")
    endless = F.abs(x) == float("inf")
    e = exponent(F.when((F.abs(x) >= 2.0**-126) & ~endless & ~F.isnan(x), F.abs(x)))
    bits = F.coalesce(((e + 126) * 2**23 + F.abs(x) / two_to(e - 23)).cast("long"), F.lit(0).cast("long"))
    return F.when(F.isnan(x), 0x7FC00000).when(endless, 0x7F800000).otherwise(bits) + F.when(x < 0, F.lit(2**31)).otherwise(0)


def byte_pitch(width: int, bits: int, alignment: int = 1) -> int:
    """Bytes of a row of texels, up to a multiple of ``alignment`` bytes."""
    return -(-(-(-width * bits // 8)) // alignment) * alignment


def field_bytes(fields: list[tuple[Column, int]]) -> list[Column]:
    """The bytes of fields (unsigned values and their bits) that follow each other from the lowest bit on."""
    places, at = [], 0
    for value, size in fields:
        if size:
            places.append((value.cast("long"), at, size))
            at += size
    out = []
    for low in range(0, at, 8):
        parts = [F.shiftright(v, low - start) if start <= low else F.shiftleft(v, start - low) for v, start, size in places if start < low + 8 and low < start + size]
        # a field that ends inside the byte has no bits above its size
        out.append(reduce(lambda x, y: x.bitwiseOR(y), parts).bitwiseAND(255))
    return out


def hex_digits(values: list[Column]) -> Column:
    """The digits of bytes, seven at a time."""
    words = []
    for at in range(0, len(values), 7):
        part = values[at : at + 7]
        word = sum((F.shiftleft(v, 8 * (len(part) - 1 - i)) for i, v in enumerate(part[:-1])), part[-1])
        words.append(F.lpad(F.hex(word), 2 * len(part), "0"))
    return F.concat(*words) if len(words) > 1 else words[0]


def packed_rows(texels: DataFrame, fields: list[tuple[Column, int]], width: int, alignment: int = 1) -> DataFrame:
    """(surface_id, z, y, data): each row of texels as bytes. fields: unsigned values and their bits, the first in the
    lowest bits; texels follow each other without gaps, and rows are filled with zeros up to their pitch. A row of texels
    is one value; with a width of 0 it is as long as its texels. Texels that share a byte are added up by byte first."""
    total = sum(size for _, size in fields)
    line, sizes = ["surface_id", "z", "y"], [size for _, size in fields]
    # columns of their own: the plan works each value out once, not for each of its bytes
    texels = texels.select(*line, "x", *[value.cast("long").alias(f"_{i}") for i, (value, size) in enumerate(fields) if size])
    parts = field_bytes([(F.col(f"_{i}"), size) for i, size in enumerate(sizes)])
    if total % 8 == 0:
        pieces = texels.select(*line, F.col("x").cast("long").alias("i"), hex_digits(parts).alias("p"))
    else:
        shift = (F.col("x") * total % 8).cast("int")
        left, right = (lambda v: F.call_function("shiftleft", v, shift).bitwiseAND(255)), (lambda v: F.call_function("shiftright", v, 8 - shift))
        moved = [left(parts[0]), *[left(v).bitwiseOR(right(u)) for u, v in pairwise(parts)], right(parts[-1])]
        first = F.floor(F.col("x") * total / 8)
        pieces = texels.select(*line, first.alias("first"), F.posexplode(F.array(*moved)).alias("k", "v")).groupBy(*line, (F.col("first") + F.col("k")).alias("i")).agg(F.sum("v").alias("v"))
        pieces = pieces.where(F.col("i") < byte_pitch(width, total)).select(*line, "i", hex_digits([F.col("v")]).alias("p"))
    rows = pieces.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("t"))
    digits = F.array_join(F.transform("t", lambda t: t["p"]), "")
    if not width:
        return rows.select(*line, F.unhex(digits).alias("data"))
    return rows.select(*line, F.unhex(F.rpad(digits, 2 * byte_pitch(width, total, alignment), "0")).alias("data"))


def uncompressed(texels: DataFrame, width: int, sizes=(8, 8, 8, 8), masks=None, bits: int = 0, kind: str = "unorm", alignment: int = 1) -> DataFrame:
    """packed_rows of plain formats. kind: unorm (0..1), uint (0..65535), float (red first; 32, 16, 11 or 10 bits a
    channel) or shared (9, 9, 9 and 5 bits). Masks and bits a texel go before sizes."""
    values = tuple(F.col(c) for c in CHANNELS)
    if kind == "float":
        return packed_rows(texels, [(put_float(c, n), n) for c, n in zip(values, sizes, strict=True)], width, alignment)
    if kind == "shared":
        if tuple(sizes) != (9, 9, 9, 5):
            raise ValueError(f"unsupported sizes of a shared exponent: {sizes}")
        return packed_rows(texels, [(to_9995(*values[:3]), 32)], width, alignment)
    if kind not in ("unorm", "uint"):
        raise ValueError(f"unsupported type: {kind}")
    total = bits or sum(sizes)
    if total > 32:
        raise ValueError("a texel of integers has 32 bits at most")
    return packed_rows(texels, [(pack_unorm(values, masks or size_masks(tuple(sizes)), 65535.0 if kind == "unorm" else 1.0), total)], width, alignment)


def truncated(texels: DataFrame, sizes=(5, 6, 5, 8)) -> DataFrame:
    """8-bit channels cut to so many bits and expanded again; 0 bits make 0."""
    there = lambda c, n: replicate(replicate(F.col(c), 8, n), n, 8) if n else F.lit(0)
    return texels.withColumns({c: there(c, n).cast("int") for c, n in zip(CHANNELS, sizes, strict=True)})


def binary_alpha(texels: DataFrame, threshold: int = 127) -> DataFrame:
    return texels.withColumn("a", F.when(F.col("a") > threshold, 255).otherwise(0))


def hue(r: Column, g: Column, b: Column) -> Column:
    """The angle of a colour about the grey axis, 0..1."""
    return F.atan2((g - b) * math.sqrt(3), r * 2 - g - b) / (2 * math.pi) + 0.5
