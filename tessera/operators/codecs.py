"""Block codecs: 4 x 4 texels to and from codes of 8 or 16 bytes, as bit arithmetic on columns.

Decoding parses a code once, makes its palette, and then gives sixteen texels that look themselves up. Encoding gathers
a block's texels in one row (a bounded group) and stays in that row: bounds, fits and nearest palette entries are array
expressions of whole numbers; only the refinement of single channels is done in numpy, many blocks at once. Texels have
8-bit channels, 0..255.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from tessera.functions.texel import from_565, replicate
from tessera.sources.relations import clamp

#: Bytes of a block.
SIZES = {"bc1": 8, "bc2": 16, "bc3": 16, "bc4": 8, "bc5": 16}
#: Formats whose blocks are those of another one; what differs is how texels are put into channels.
SAME = {"bc1a": "bc1", "bc3n": "bc3", "bc3_rgbm": "bc3", "etc1": "etc2_rgb"}
ETC_SIZES = {"etc2_rgb": 8, "etc2_rgba": 16, "eac_r": 8, "eac_rg": 16}
# fixed values: the steps of ETC's intensity tables, the distances of its T and H modes, and the modifiers of EAC
ETC_STEPS = ((2, 8), (5, 17), (9, 29), (13, 42), (18, 60), (24, 80), (33, 106), (47, 183))
ETC_DISTANCES = (3, 6, 11, 16, 23, 32, 41, 64)
EAC_MODIFIERS = (
    (-3, -6, -9, -15, 2, 5, 8, 14), (-3, -7, -10, -13, 2, 6, 9, 12), (-2, -5, -8, -13, 1, 4, 7, 12), (-2, -4, -6, -13, 1, 3, 5, 12),
    (-3, -6, -8, -12, 2, 5, 7, 11), (-3, -7, -9, -11, 2, 6, 8, 10), (-4, -7, -8, -11, 3, 6, 7, 10), (-3, -5, -8, -11, 2, 4, 7, 10),
    (-2, -6, -8, -10, 1, 5, 7, 9), (-2, -5, -8, -10, 1, 4, 7, 9), (-2, -4, -8, -10, 1, 3, 7, 9), (-2, -5, -7, -10, 1, 4, 6, 9),
    (-3, -4, -7, -10, 2, 3, 6, 9), (-1, -2, -3, -10, 0, 1, 2, 9), (-4, -6, -8, -9, 3, 5, 7, 8), (-3, -5, -7, -9, 2, 4, 6, 8),
)


def little(code: Column, first: int, count: int) -> Column:
    """The unsigned integer of up to 7 bytes of a code, the lowest byte first; ``first`` counts from 0."""
    return _number(F.hex(F.substring(code, first + 1, count)), range(count - 1, -1, -1))


def _number(digits: Column, order) -> Column:
    """The integer of some bytes of a hexadecimal text, the highest first."""
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in order]), 16, 10).cast("long")


def code_bytes(value: Column, count: int) -> Column:
    """An integer as ``count`` bytes, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(count)]))


def _bits(c: Column, shift: Column | int, mask: int) -> Column:
    moved = F.shiftright(c, shift) if isinstance(shift, int) else F.call_function("shiftright", c, shift)
    return moved.bitwiseAND(mask)


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def _packed(r: Column, g: Column, b: Column, a: Column) -> Column:
    """A colour of four bytes as one number."""
    r, g, b, a = (c.cast("long") for c in (r, g, b, a))
    return r + g * 2**8 + b * 2**16 + a * 2**24


def _texels(blocks: DataFrame, colour: Column, alpha: Column | None = None, rgb: tuple[Column, ...] | None = None) -> DataFrame:
    """Sixteen texels of each block; colour is a packed one of the texel t."""
    rows = blocks.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("_c", colour)
    channels = list(rgb) if rgb else [_bits(F.col("_c"), 8 * i, 255) for i in range(3)]
    channels.append(_bits(F.col("_c"), 24, 255) if alpha is None else alpha)
    y = (F.col("by") * 4 + F.floor(F.col("t") / 4)).cast("int").alias("y")
    x = (F.col("bx") * 4 + F.col("t") % 4).cast("int").alias("x")
    return rows.select("surface_id", F.lit(0).alias("z"), y, x, *[c.cast("int").alias(n) for c, n in zip(channels, "rgba", strict=True)])


def colour_palette(c0: Column, c1: Column, decoder: str = "d3d10", bias: bool = False) -> Column:
    """The four packed colours of a BC1 block. bias rounds thirds up as one decoder does; nv5x is that of another."""
    four = c0 > c1
    if decoder == "nv5x":
        r, g, b = (tuple(_bits(c, shift, mask) for c in (c0, c1)) for shift, mask in ((11, 31), (5, 63), (0, 31)))
        ends = [replicate(g[0], 6, 8), replicate(g[1], 6, 8)]
        diff = ends[1] - ends[0]
        quarter = (diff / 4).cast("int")  # towards zero
        thin = lambda p, q: _whole((p * 2 + q) * 22 / 8)
        half = lambda p: _whole((p[0] + p[1]) * 33 / 8)
        step = lambda at, sign, n: _whole((at * 256 + (quarter + diff * n) * sign + 128) / 256)
        first = [(_whole(r[i] * 66 / 8), ends[i], _whole(b[i] * 66 / 8)) for i in (0, 1)]
        thirds = [(thin(r[0], r[1]), step(ends[0], 1, 80), thin(b[0], b[1])), (thin(r[1], r[0]), step(ends[1], -1, 80), thin(b[1], b[0]))]
        middle = (half(r), step(ends[0], 1, 128), half(b))
    else:
        first = [from_565(c0), from_565(c1)]
        third = lambda p, q: tuple(_whole((x * 2 + y + int(bias)) / 3) for x, y in zip(p, q, strict=True))
        thirds = [third(first[0], first[1]), third(first[1], first[0])]
        middle = tuple(_whole((x + y) / 2) for x, y in zip(*first, strict=True))
    full, none = F.lit(255), F.lit(0)
    third_entry = F.when(four, _packed(*thirds[0], full)).otherwise(_packed(*middle, full))
    last = F.when(four, _packed(*thirds[1], full)).otherwise(_packed(none, none, none, none))
    return F.array(_packed(*first[0], full), _packed(*first[1], full), third_entry, last)


def ramp_palette(a: Column, b: Column, bias: bool = False) -> Column:
    """The palette of eight values between a and b, or of six and 0 and 255 if a isn't above b."""
    eight = [a, b, *[F.floor(((8 - k) * a + (k - 1) * b + (3 if bias else 0)) / 7) for k in range(2, 8)]]
    six = [a, b, *[F.floor(((6 - k) * a + (k - 1) * b + (2 if bias else 0)) / 5) for k in range(2, 6)], F.lit(0), F.lit(255)]
    return F.array(*[F.when(a > b, p.cast("int")).otherwise(q.cast("int")) for p, q in zip(eight, six, strict=True)])


def _colour_fields(digits: Column, first: int, decoder: str, bias: bool) -> dict[str, Column]:
    c0, c1 = (_number(digits, (first + i + 1, first + i)).cast("int") for i in (0, 2))
    return {"palette": colour_palette(c0, c1, decoder, bias), "bits": _number(digits, range(first + 7, first + 3, -1))}


def _ramp_fields(digits: Column, first: int, n: int, bias: bool = False) -> dict[str, Column]:
    a, b = (_number(digits, (first + i,)).cast("int") for i in (0, 1))
    return {f"ramp{n}": ramp_palette(a, b, bias), f"k{n}": _number(digits, range(first + 7, first + 1, -1))}


def _pick(palette: str, bits: str, size: int) -> Column:
    return F.element_at(palette, _bits(F.col(bits), (F.col("t") * size).cast("int"), 2**size - 1).cast("int") + 1)


def decode(encoded: DataFrame, fmt: str, decoder: str = "d3d10", bias: bool = False, width: int | None = None, height: int | None = None) -> DataFrame:
    """Texels (surface_id, z, y, x, r, g, b, a) of blocks (surface_id, by, bx, code), inside of width and height if given.

    decoder: d3d10, d3d9 (which rounds the ramps of bc4 and bc5 up) or nv5x (other colours of bc1 to bc3). bias rounds all
    thirds, fifths and sevenths up. eac_r and eac_rg give values of 16 bits, the others bytes."""
    fmt = SAME.get(fmt, fmt)
    if decoder not in ("d3d10", "d3d9", "nv5x"):
        raise ValueError(f"unknown decoder: {decoder}")
    digits = F.hex("code")
    fields, colour, alpha = {}, F.lit(255 * 2**24).cast("long"), None
    if fmt in ("bc1", "bc2", "bc3"):
        fields, colour = _colour_fields(digits, 0 if fmt == "bc1" else 8, decoder, bias), _pick("palette", "bits", 2)
    if fmt == "bc1":
        rgb = None
    elif fmt == "bc2":
        fields |= {"low": _number(digits, range(3, -1, -1)), "high": _number(digits, range(7, 3, -1))}
        half = F.when(F.col("t") < 8, F.col("low")).otherwise(F.col("high"))
        alpha, rgb = _bits(half, ((F.col("t") % 8) * 4).cast("int"), 15) * 17, None
    elif fmt == "bc3":
        fields |= _ramp_fields(digits, 0, 0, bias)
        alpha, rgb = _pick("ramp0", "k0", 3), None
    elif fmt == "bc4":
        fields, v = _ramp_fields(digits, 0, 0, bias or decoder == "d3d9"), _pick("ramp0", "k0", 3)
        rgb = (v, v, v)
    elif fmt == "bc5":
        rounded = bias or decoder == "d3d9"
        fields = _ramp_fields(digits, 0, 0, rounded) | _ramp_fields(digits, 8, 1, rounded)
        rgb = (_pick("ramp0", "k0", 3), _pick("ramp1", "k1", 3), F.lit(0))
    elif fmt in ETC_SIZES:
        return _inside(_decode_etc(encoded, fmt), width, height)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    blocks = encoded.select("surface_id", "by", "bx", *[c.alias(n) for n, c in fields.items()])
    return _inside(_texels(blocks, colour, alpha, rgb), width, height)


def _inside(texels: DataFrame, width: int | None, height: int | None) -> DataFrame:
    return texels if width is None else texels.where((F.col("x") < width) & (F.col("y") < height))


def _byte(c: Column) -> Column:
    return clamp(c, 0, 255)


def _etc_palettes(blocks: DataFrame) -> DataFrame:
    """blocks (with hi) with palette: the eight packed colours, four of each half, by index bits; null in the planar
    mode. The T and H modes have the same four twice. A sum that leaves its five bits marks a mode: red T, green H, blue
    the planar one. An entry is a colour and what is added to all of its parts."""
    f = lambda low, n: _bits(F.col("hi"), low, 2**n - 1).cast("int")
    signed = lambda c: F.when(c >= 4, c - 8).otherwise(c)
    rows = blocks.withColumns({f"_v{c}": f(27 - 8 * i, 5) + signed(f(24 - 8 * i, 3)) for i, c in enumerate("rgb")})
    diff = f(1, 1) == 1
    mode = F.when(diff & ~F.col("_vr").between(0, 31), 1).when(diff & ~F.col("_vg").between(0, 31), 2).when(diff & ~F.col("_vb").between(0, 31), 3).otherwise(0)
    one = F.array(*[F.when(diff, replicate(f(27 - 8 * i, 5), 5, 8)).otherwise(f(28 - 8 * i, 4) * 17) for i in range(3)])
    two = F.array(*[F.when(diff, replicate(F.col(f"_v{c}"), 5, 8)).otherwise(f(24 - 8 * i, 4) * 17) for i, c in enumerate("rgb")])
    steps = F.array(*[F.array(*map(F.lit, (a, b, -a, -b))) for a, b in ETC_STEPS])
    distances = F.array(*map(F.lit, ETC_DISTANCES))
    t = [F.array((f(27, 2) * 4 + f(24, 2)) * 17, f(20, 4) * 17, f(16, 4) * 17), F.array(*[f(12 - 4 * i, 4) * 17 for i in range(3)])]
    h = [(f(27, 4), f(24, 3) * 2 + f(20, 1), f(19, 1) * 8 + f(15, 3)), (f(11, 4), f(7, 4), f(3, 4))]
    above = (h[0][0] * 256 + h[0][1] * 16 + h[0][2] >= h[1][0] * 256 + h[1][1] * 16 + h[1][2]).cast("int")
    rows = rows.select(*blocks.columns, mode.alias("_mode"), one.alias("_e0"), two.alias("_e1"), F.element_at(steps, f(5, 3) + 1).alias("_s0"), F.element_at(steps, f(2, 3) + 1).alias("_s1"), t[0].alias("_t0"), t[1].alias("_t1"),
                       F.element_at(distances, f(2, 2) * 2 + f(0, 1) + 1).alias("_dt"), *[F.array(*[x * 17 for x in c]).alias(f"_h{i}") for i, c in enumerate(h)], F.element_at(distances, f(2, 1) * 4 + f(0, 1) * 2 + above + 1).alias("_dh"))
    entry = lambda colour, d: F.struct(F.col(colour).alias("c"), d.cast("int").alias("d"))
    half = lambda i: F.transform(f"_s{i}", lambda d: entry(f"_e{i}", d))
    halves = [half(0), half(1)]
    t_mode = F.array(entry("_t0", F.lit(0)), entry("_t1", F.col("_dt")), entry("_t1", F.lit(0)), entry("_t1", -F.col("_dt")))
    h_mode = F.array(*[entry(f"_h{i}", d) for i in (0, 1) for d in (F.col("_dh"), -F.col("_dh"))])
    entries = F.when(F.col("_mode") == 0, F.concat(*halves)).when(F.col("_mode") == 1, F.concat(t_mode, t_mode)).when(F.col("_mode") == 2, F.concat(h_mode, h_mode))
    packed = F.transform(entries, lambda e: _packed(*[_byte(F.element_at(e["c"], i + 1) + e["d"]) for i in range(3)], F.lit(255)))
    return rows.select(*blocks.columns, packed.alias("palette"))


def _etc_plane(hi: Column, lo: Column) -> list[list[Column]]:
    """For red, green and blue of the planar mode: the value at the origin, to the right and below."""
    f = lambda c, low, n: _bits(c, low, 2**n - 1).cast("int")
    six, seven = (lambda c: replicate(c, 6, 8)), (lambda c: replicate(c, 7, 8))
    origin = [six(f(hi, 25, 6)), seven(f(hi, 24, 1) * 64 + f(hi, 17, 6)), six(f(hi, 16, 1) * 32 + f(hi, 11, 2) * 8 + f(hi, 7, 3))]
    right = [six(f(hi, 2, 5) * 2 + f(hi, 0, 1)), seven(f(lo, 25, 7)), six(f(lo, 19, 6))]
    below = [six(f(lo, 13, 6)), seven(f(lo, 6, 7)), six(f(lo, 0, 6))]
    return [list(x) for x in zip(origin, right, below, strict=True)]


def _eac_fields(digits: Column, first: int, n: int, wide: bool) -> dict[str, Column]:
    """ramp: the eight values of a block, of 8 bits, or of 11 bits spread over 16; and its index bits, highest first."""
    base, other = _number(digits, (first,)), _number(digits, (first + 1,))
    row = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in EAC_MODIFIERS]), other.bitwiseAND(15).cast("int") + 1)
    # what is parsed is bound once: inside the lambda it would be parsed again for each of the eight
    parsed = F.array(F.struct(base.alias("base"), F.shiftright(other, 4).alias("times"), row.alias("row")))
    if wide:
        eleven = lambda p, m: clamp(p["base"] * 8 + 4 + F.when(p["times"] != 0, m * p["times"] * 8).otherwise(m), 0, 2047)
        values = lambda p: F.transform(F.transform(p["row"], lambda m: eleven(p, m)), lambda v: v * 32 + F.floor(v / 64))
    else:
        values = lambda p: F.transform(p["row"], lambda m: _byte(p["base"] + m * p["times"]))
    ramp = F.get(F.transform(parsed, values), 0)
    return {f"ramp{n}": ramp, f"k{n}": _number(digits, range(first + 2, first + 8))}


def _decode_etc(encoded: DataFrame, fmt: str) -> DataFrame:
    """Texels lie in columns: texel (x, y) has the index 4 x + y."""
    digits, place = F.hex("code"), (F.col("t") % 4 * 4 + F.floor(F.col("t") / 4)).cast("int")
    eac = lambda n: F.element_at(f"ramp{n}", _bits(F.col(f"k{n}"), 45 - place * 3, 7).cast("int") + 1)
    if fmt in ("eac_r", "eac_rg"):
        fields = _eac_fields(digits, 0, 0, True) | (_eac_fields(digits, 8, 1, True) if fmt == "eac_rg" else {})
        blocks = encoded.select("surface_id", "by", "bx", *[c.alias(n) for n, c in fields.items()])
        return _texels(blocks, F.lit(0).cast("long"), F.lit(65535), (eac(0), eac(1) if fmt == "eac_rg" else F.lit(0), F.lit(0)))
    first = 8 if fmt == "etc2_rgba" else 0
    numbers = encoded.select("surface_id", "by", "bx", _number(digits, range(first, first + 4)).alias("hi"), _number(digits, range(first + 4, first + 8)).alias("lo"), *[c.alias(n) for n, c in (_eac_fields(digits, 0, 0, False) if first else {}).items()])
    plane = F.array(*[F.array(*c) for c in _etc_plane(F.col("hi"), F.col("lo"))])
    blocks = _etc_palettes(numbers.select("*", plane.alias("plane"), (_bits(F.col("hi"), 0, 1) == 1).alias("flip")))
    x, y = F.col("t") % 4, F.floor(F.col("t") / 4)
    half = F.when(F.col("flip"), y >= 2).otherwise(x >= 2).cast("int")
    index = _bits(F.col("lo"), place + 16, 1) * 2 + _bits(F.col("lo"), place, 1)
    colour = F.element_at("palette", (half * 4 + index).cast("int") + 1)
    at = lambda c, i: F.element_at(F.element_at("plane", c + 1), i + 1)
    flat = [_byte(F.floor((at(c, 0) * 4 + x * (at(c, 1) - at(c, 0)) + y * (at(c, 2) - at(c, 0)) + 2) / 4)) for c in range(3)]
    rgb = tuple(F.when(F.col("palette").isNull(), p).otherwise(_bits(F.col("_c"), 8 * i, 255)) for i, p in enumerate(flat))
    return _texels(blocks, colour, eac(0) if first else F.lit(255), rgb)


def gather(texels: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """(surface_id, by, bx, t): the sixteen texels of each block in order, as structs. With the extents given, blocks
    over the edge repeat their texels modulo the part inside."""
    by, bx = F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx")
    place = ((F.col("y") % 4) * 4 + F.col("x") % 4).alias("i")
    rows = texels.where("z = 0").select("surface_id", by, bx, place, "r", "g", "b", "a")
    out = rows.groupBy("surface_id", "by", "bx").agg(F.sort_array(F.collect_list(F.struct("i", "r", "g", "b", "a"))).alias("t"))
    if width is None or (width % 4 == 0 and height % 4 == 0):
        return out
    w, h = F.least(F.lit(4), width - F.col("bx") * 4), F.least(F.lit(4), height - F.col("by") * 4)
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("t", ((F.floor(i / 4) % h) * w + (i % 4) % w).cast("int")))
    return out.withColumn("t", at)


def _channel(c: str) -> Column:
    return F.transform("t", lambda x: x[c].cast("int"))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)


def nearest_level(v: Column, bits: int) -> Column:
    """The level of ``bits`` bits whose expanded byte is nearest to v, the lower one of equals."""
    top = 2**bits - 1
    low = F.floor(clamp(v * (top / 255), 0.0, float(top))).cast("int")
    # the level above the top one has the byte that the same bits would make
    byte = lambda i: F.shiftleft(i, 8 - bits).bitwiseOR(F.shiftright(i, 2 * bits - 8))
    return F.when(F.abs(v - byte(low + 1)) < F.abs(v - byte(low)), F.least(low + 1, F.lit(top))).otherwise(low)


def _nearest_565(r: Column, g: Column, b: Column) -> Column:
    return nearest_level(r, 5) * 2048 + nearest_level(g, 6) * 32 + nearest_level(b, 5)


def single_colours(bits: int, halves: bool = False) -> np.ndarray:
    """For each byte the two levels whose mixture, two parts of the first and one of the second (or one of each), is
    nearest; of equals those that are closer together, then those of the least second and first level."""
    level = np.arange(2**bits)
    byte = (level << (8 - bits)) | (level >> (2 * bits - 8))
    second, first = np.meshgrid(level, level, indexing="ij")
    mixed = (byte[first] + byte[second]) // 2 if halves else (2 * byte[first] + byte[second]) // 3
    cost = np.abs(mixed[None] - np.arange(256)[:, None, None]) * 100 + np.abs(first - second) * 3
    best = cost.reshape(256, -1).argmin(axis=1)
    return np.stack([first.ravel()[best], second.ravel()[best]], 1)


def _single_565(r: Column, g: Column, b: Column, which: int, halves: bool = False) -> Column:
    tables = {bits: F.array(*[F.lit(int(x)) for x in single_colours(bits, halves)[:, which]]) for bits in (5, 6)}
    look = lambda c, bits: F.element_at(tables[bits], c + 1)
    return look(r, 5) * 2048 + look(g, 6) * 32 + look(b, 5)


def _with_indices(rows: DataFrame, three: bool = False) -> DataFrame:
    """rows with k: the nearest entry of each texel in the palette of c0 and c1 before rounding; distances are compared
    in whole numbers. Of equally near entries the choice is that of comparing the ends with the mixtures first. With
    three colours transparent texels have entry 3."""
    p, q = (F.array(*from_565(F.col(c))) for c in ("c0", "c1"))
    times = 2 if three else 3
    rows = rows.withColumns({"_p": p, "_q": q})
    ends = [F.col("_p"), F.col("_q")]
    mixes = [(1, 1)] if three else [(2, 1), (1, 2)]
    mixed = lambda wa, wb: F.zip_with("_p", "_q", lambda a, b: a * wa + b * wb)
    palette = [F.transform(e, lambda v: v * times) for e in ends] + [mixed(*w) for w in mixes]
    rows = rows.withColumn("_e", F.array(*palette))

    def nearest(x: Column) -> Column:
        def far(i: int) -> Column:
            parts = [x[c].cast("int") * times - F.element_at(F.element_at("_e", i + 1), n + 1) for n, c in enumerate("rgb")]
            return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]

        if three:
            d0, d1, d2 = (far(i) for i in range(3))
            return F.when(x["a"] < 128, 3).when((d0 < d1) & (d0 < d2), 0).when(d1 < d2, 1).otherwise(2)
        d0, d1, d2, d3 = (far(i) for i in range(4))
        mixed = ((d1 > d2) & (d0 > d2)) | ((d0 > d3) & (d1 > d3))
        return F.when(mixed, 2).otherwise(0) + F.when((d0 > d3) & (d2 > d3), 1).otherwise(0)

    return rows.withColumn("k", F.transform("t", nearest)).drop("_p", "_q", "_e")


def _ends(rows: DataFrame, one: tuple, two: tuple) -> DataFrame:
    """rows with c0 >= c1, the nearest levels of two colours."""
    rows = rows.withColumns({"_c0": _nearest_565(*one), "_c1": _nearest_565(*two)})
    return rows.withColumns({"c0": F.greatest("_c0", "_c1"), "c1": F.least("_c0", "_c1")}).drop("_c0", "_c1")


def _diagonal(rows: DataFrame, used: Column | None = None) -> DataFrame:
    """rows with c0 and c1 from the bounding box of the colours (of those of ``used``): along the diagonal that they
    follow, drawn in by a sixteenth."""
    part = F.col("t") if used is None else F.filter("t", lambda x: x["a"] > 127)
    rows = rows.withColumn("_u", part)
    column = lambda c: F.transform("_u", lambda x: x[c].cast("int"))
    rows = rows.withColumns({f"_{n}{c}": F.coalesce(f(column(c)), F.lit(0)) for c in "rgb" for n, f in (("lo", F.array_min), ("hi", F.array_max))})
    mid = {c: F.col(f"_lo{c}") + F.col(f"_hi{c}") for c in "rgb"}
    follows = lambda c: F.transform("_u", lambda x: (x[c].cast("long") * 2 - mid[c]) * (x["b"].cast("long") * 2 - mid["b"]))
    turn = {c: _sum(follows(c)) < 0 for c in "rg"}
    rows = rows.withColumns({f"_turn{c}": t for c, t in turn.items()})
    high = {c: F.when(F.col(f"_turn{c}"), F.col(f"_lo{c}")).otherwise(F.col(f"_hi{c}")) if c in turn else F.col(f"_hi{c}") for c in "rgb"}
    low = {c: F.when(F.col(f"_turn{c}"), F.col(f"_hi{c}")).otherwise(F.col(f"_lo{c}")) if c in turn else F.col(f"_lo{c}") for c in "rgb"}
    inset = {c: (high[c] - low[c]) / 16 - 8 / 255 / 16 for c in "rgb"}
    one = tuple(clamp(high[c] - inset[c], 0.0, 255.0) for c in "rgb")
    two = tuple(clamp(low[c] + inset[c], 0.0, 255.0) for c in "rgb")
    return _ends(rows, one, two)


def _code(c0: Column, c1: Column, k: Column) -> Column:
    bits = F.aggregate(F.transform(k, lambda k, i: F.call_function("shiftleft", k.cast("long"), i * 2)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.concat(code_bytes(c0, 2), code_bytes(c1, 2), code_bytes(bits, 4))


def colour_codes(blocks: DataFrame, refine: bool = True) -> DataFrame:
    """blocks (as from gather) with ``colour``: the 8-byte BC1 code. A block of one colour gets the best pair of levels
    for it. Else the ends lie on the diagonal of the bounding box, drawn in, and if ``refine`` are replaced by the
    least-squares fit to the indices that they give, where there is one."""
    keep = blocks.columns
    first = F.element_at("t", 1)
    alone = F.forall("t", lambda x: (x["r"] == first["r"]) & (x["g"] == first["g"]) & (x["b"] == first["b"]))
    rows = _with_indices(_diagonal(blocks.withColumn("_alone", alone)).select(*keep, "_alone", "c0", "c1"))
    if refine:  # shares of c0 in thirds by index: 3, 0, 2, 1
        rows = rows.withColumn("_w", F.transform("k", lambda i: F.element_at(F.array(*map(F.lit, (3, 0, 2, 1))), i + 1)))
        sums = {"_aa": _sum(F.transform("_w", lambda w: w * w)), "_ab": _sum(F.transform("_w", lambda w: w * (3 - w))), "_bb": _sum(F.transform("_w", lambda w: (3 - w) * (3 - w)))}
        for c in "rgb":
            sums[f"_x{c}"] = _sum(F.zip_with("_w", _channel(c), lambda w, v: w * v))
            sums[f"_y{c}"] = _sum(F.zip_with("_w", _channel(c), lambda w, v: (3 - w) * v))
        rows = rows.withColumns(sums)
        det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
        solve = lambda a, p, b, q: clamp(F.try_divide((F.col(a) * F.col(p) - F.col(b) * F.col(q)) * 3.0, det.cast("double")), 0.0, 255.0)
        one, two = tuple(solve(f"_x{c}", "_bb", f"_y{c}", "_ab") for c in "rgb"), tuple(solve(f"_y{c}", "_aa", f"_x{c}", "_ab") for c in "rgb")
        rows = rows.withColumnsRenamed({"c0": "_old0", "c1": "_old1", "k": "_oldk"}).withColumn("_none", det == 0)
        rows = _with_indices(_ends(rows, one, two))
        rows = rows.withColumns({"c0": F.when(F.col("_none"), F.col("_old0")).otherwise(F.col("c0")), "c1": F.when(F.col("_none"), F.col("_old1")).otherwise(F.col("c1")), "k": F.when(F.col("_none"), F.col("_oldk")).otherwise(F.col("k"))})
    s0, s1 = (_single_565(*[first[c].cast("int") for c in "rgb"], which) for which in (0, 1))
    single = _code(F.greatest(s0, s1), F.least(s0, s1), F.transform("t", lambda x: F.when(s0 < s1, 3).otherwise(2)))
    return rows.select(*keep, F.when(F.col("_alone"), single).otherwise(_code(F.col("c0"), F.col("c1"), F.col("k"))).alias("colour"))


def clear_codes(blocks: DataFrame) -> DataFrame:
    """blocks with ``colour``: as colour_codes where no texel has alpha 0, else of three colours and transparent black
    for alpha below 128. The ends come from the other texels alone."""
    keep = blocks.columns
    rows = _diagonal(blocks, used=F.lit(True)).select(*keep, F.col("c1").alias("c0"), F.col("c0").alias("c1"))  # c0 <= c1: three colours
    three = _with_indices(rows, three=True).withColumn("_three", _code(F.col("c0"), F.col("c1"), F.col("k"))).drop("c0", "c1", "k")
    both = colour_codes(three)
    return both.select(*keep, F.when(F.exists("t", lambda x: x["a"] == 0), F.col("_three")).otherwise(F.col("colour")).alias("colour"))


def ramp_blocks(v: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The codes (n, 8) of single channels (n, 16) of bytes. The ends are the bounds, drawn in by a 34th; up to
    ``rounds`` times they are fitted to the indices by least squares, as long as the error falls."""
    v = v.astype(np.int64)
    high, low = v.max(axis=1), v.min(axis=1)
    inset = (high - low) // 34
    best_a, best_b = high - inset, low + inset
    best_k, best_e = _ramp_indices(v, best_a, best_b)
    a, b, k, live = best_a.copy(), best_b.copy(), best_k.copy(), np.ones(len(v), bool)
    share = np.array([7, 0, 6, 5, 4, 3, 2, 1])
    for _ in range(rounds):
        w = share[k]
        aa, ab, bb = (w * w).sum(1), (w * (7 - w)).sum(1), ((7 - w) * (7 - w)).sum(1)
        ax, bx, det = (w * v).sum(1), ((7 - w) * v).sum(1), aa * bb - ab * ab
        live &= det != 0
        safe = np.where(det == 0, 1, det)
        fit = [np.clip(7 * n // safe, 0, 255) for n in (ax * bb - bx * ab, bx * aa - ax * ab)]
        a, b = np.where(live, np.maximum(*fit), a), np.where(live, np.minimum(*fit), b)
        k, e = _ramp_indices(v, a, b)
        live &= e < best_e
        best_a, best_b, best_e = np.where(live, a, best_a), np.where(live, b, best_b), np.where(live, e, best_e)
        best_k = np.where(live[:, None], k, best_k)
        if not live.any():
            break
    out = np.zeros((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = best_a, best_b
    bits = (best_k.astype(np.uint64) << (3 * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
    for i in range(6):
        out[:, 2 + i] = (bits >> np.uint64(8 * i)) & np.uint64(255)
    return out


def _ramp_indices(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest palette entry of each value, the first of equals, and the sum of squares of the distances."""
    a, b = a[:, None], b[:, None]
    i = np.arange(2, 8)
    eight = np.concatenate([a, b, ((8 - i) * a + (i - 1) * b) // 7], 1)
    j = np.arange(2, 6)
    six = np.concatenate([a, b, ((6 - j) * a + (j - 1) * b) // 5, np.zeros_like(a), np.full_like(a, 255)], 1)
    far = (v[:, :, None] - np.where(a > b, eight, six)[:, None, :]) ** 2
    k = far.argmin(axis=2)
    return k, np.take_along_axis(far, k[:, :, None], 2).sum((1, 2))


@F.pandas_udf(BinaryType())
def _ramp_code(values: pd.Series) -> pd.Series:
    return pd.Series([bytes(x) for x in ramp_blocks(np.stack(values.to_numpy()))] if len(values) else [], dtype=object)


def ramp_codes(blocks: DataFrame, channel: str, name: str) -> DataFrame:
    """blocks with ``name``: the 8-byte code of one channel."""
    return blocks.withColumn(name, _ramp_code(_channel(channel)))


def explicit_alpha(blocks: DataFrame, name: str) -> DataFrame:
    """blocks with ``name``: the 8-byte code of alpha at 4 bits, each the nearest."""
    digit = F.transform("t", lambda x: F.floor(x["a"] / 17 + 0.5).cast("int"))
    rows = blocks.withColumn("_k", digit)
    pair = [F.element_at("_k", 2 * i + 1) + F.element_at("_k", 2 * i + 2) * 16 for i in range(8)]
    return rows.select(*blocks.columns, F.concat(*[code_bytes(p, 1) for p in pair]).alias(name))


def rgbm_codes(blocks: DataFrame, least: float = 0.25) -> DataFrame:
    """blocks with ``code``: colours over their largest channel (not below ``least``) as BC1, and as alpha the M that
    brings each decoded colour nearest to its texel."""
    keep = blocks.columns
    byte = lambda c: F.floor(clamp(c, 0.0, 1.0) * 255 + 0.5).cast("int")

    def over(x: Column) -> Column:
        m = F.greatest(x["r"], x["g"], x["b"], F.lit(least * 255))
        return F.struct(x["i"].alias("i"), *[byte(x[c] / m).alias(c) for c in "rgb"], F.lit(255).alias("a"))

    rows = blocks.withColumn("_of", F.col("t")).withColumn("t", F.transform("t", over))
    rows = colour_codes(rows)
    digits = F.hex("colour")
    fields = _colour_fields(digits, 0, "d3d10", False)
    rows = rows.withColumns({"_palette": fields["palette"], "_bits": fields["bits"]})

    def m_of(x: Column, i: Column) -> Column:
        c = F.element_at("_palette", _bits(F.col("_bits"), (i * 2).cast("int"), 3).cast("int") + 1)
        rgb = [_bits(c, 8 * n, 255) for n in range(3)]
        dot = sum((a * x[n] for a, n in zip(rgb, "rgb", strict=True)), F.lit(0))
        m = F.coalesce(F.try_divide(dot.cast("double"), sum((a * a for a in rgb), F.lit(0)).cast("double")), F.lit(0.0))
        return byte((m - least) / (1 - least))

    rows = rows.withColumn("_m", F.transform("_of", m_of))
    return rows.select(*[F.col("_of").alias("t") if c == "t" else c for c in keep], F.concat(_ramp_code("_m"), "colour").alias("code"))


def encode(texels: DataFrame, fmt: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Blocks (surface_id, by, bx, code) of texels with 8-bit channels. bc3n puts red into alpha and keeps green."""
    if fmt == "bc3n":
        texels = texels.select(*[c for c in texels.columns if c not in "rgba"], F.lit(255).alias("r"), "g", F.lit(0).alias("b"), F.col("r").alias("a"))
    blocks = gather(texels, width, height)
    if fmt in ("bc1", "bc1a"):
        code, rows = F.col("colour"), colour_codes(blocks) if fmt == "bc1" else clear_codes(blocks)
    elif fmt in ("bc2", "bc3", "bc3n"):
        rows = explicit_alpha(blocks, "alpha") if fmt == "bc2" else ramp_codes(blocks, "a", "alpha")
        code, rows = F.concat("alpha", "colour"), colour_codes(rows)
    elif fmt == "bc3_rgbm":
        code, rows = F.col("code"), rgbm_codes(blocks)
    elif fmt == "bc4":
        code, rows = F.col("red"), ramp_codes(blocks, "r", "red")
    elif fmt == "bc5":
        code, rows = F.concat("red", "green"), ramp_codes(ramp_codes(blocks, "r", "red"), "g", "green")
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return rows.select("surface_id", "by", "bx", code.alias("code"))


def four_clusters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """points (n, k, 3) to (n, 4, 3) means and how many of them have points. The first means lie on the principal axis
    through the centroid: at the least projection, at the last one that wasn't less when it came, and at their thirds.
    After each round the means are ordered by their number of points; it ends when no mean moves. A mean without points
    is zero."""
    centre = points.mean(axis=1, keepdims=True)
    off = points - centre
    matrix = np.einsum("nki,nkj->nij", off, off)
    v = np.take_along_axis(matrix, np.einsum("nii->ni", matrix).argmax(1)[:, None, None], 1)[:, 0]
    for _ in range(8):
        size = np.abs(v).max(1, keepdims=True)
        v = np.einsum("nij,nj->ni", matrix, np.divide(v, size, out=np.zeros_like(v), where=size > 0))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    along = np.einsum("nki,ni->nk", off, v)
    least, last = along[:, 0].copy(), along[:, 0].copy()
    for k in range(1, points.shape[1]):
        less = along[:, k] < least
        least, last = np.where(less, along[:, k], least), np.where(less, last, along[:, k])
    one, two = (centre[:, 0] + d[:, None] * v for d in (least, last))
    means = np.stack([one, two, (2 * one + two) / 3, (2 * two + one) / 3], 1)
    count, live = np.zeros((len(points), 4)), np.ones(len(points), bool)
    for _ in range(100):
        nearest = ((points[:, :, None] - means[:, None]) ** 2).sum(3).argmin(2)
        member = (nearest[:, :, None] == np.arange(4)).astype(float)
        total = member.sum(1)
        sums = np.einsum("nkc,nki->nci", member, points)
        new = np.divide(sums, total[:, :, None], out=np.zeros_like(sums), where=total[:, :, None] > 0)
        count = np.where(live[:, None], total, count)
        moved = live & (np.abs(new - means).max((1, 2)) > 1e-4)
        if not moved.any():
            break
        order = np.argsort(-total, axis=1, kind="stable")
        means = np.where(moved[:, None, None], np.take_along_axis(new, order[:, :, None], 1), means)
        count = np.where(moved[:, None], np.take_along_axis(total, order, 1), count)
        live = moved
    return means, (count > 0).sum(1)


def four_means(blocks: DataFrame) -> DataFrame:
    """blocks (as from gather) with means, the four colours r, g, b one after another that the block's texels gather
    about, and clusters, how many of them have texels."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(flat: pd.Series) -> pd.Series:
        if not len(flat):
            return pd.Series([], dtype=object)
        means, n = four_clusters(np.stack(flat.to_numpy()).astype(float).reshape(len(flat), 16, 3))
        return pd.Series(list(np.concatenate([means.reshape(-1, 12), n[:, None]], 1)))

    flat = F.flatten(F.transform("t", lambda x: F.array(*[x[c].cast("double") for c in "rgb"])))
    rows = blocks.withColumn("_m", run(flat))
    return rows.withColumns({"means": F.slice("_m", 1, 12), "clusters": F.element_at("_m", 13).cast("int")}).drop("_m")
