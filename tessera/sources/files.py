"""Image files: containers of block codes as binary columns, and readers of small raster formats.

A container is one binary value for a texture. Headers are read and written by column expressions; the blocks of a
container become rows by exploding its payload, so decoding is spread over tasks by block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.packing import from_half, uncompressed
from tessera.operators.codecs import SAME, SIZES, code_bytes, decode, little
from tessera.operators.layout import format_table
from tessera.sources.png import png

#: Fixed values of the container format: magic number, header size, flags, and the offset of the payload.
MAGIC, HEADER = b"DDS ".hex().upper(), 124
CAPS, PITCH, LINEAR_SIZE, MIPS, DEPTH = 0x1007, 0x8, 0x80000, 0x20000, 0x800000
FOURCC, ALPHA_PIXELS, ALPHA_ONLY, RGB, LUMINANCE = 0x4, 0x1, 0x2, 0x40, 0x20000
TEXTURE, COMPLEX, MIPMAP, CUBE, VOLUME = 0x1000, 0x8, 0x400000, 0xFE00, 0x200000
PAYLOAD, EXTENSION = 128, 20
WORDS = (12, 16, 24, 28, 80, 84, 88, 92, 96, 100, 104, 112)  # where the words of a header are that are read
EXTENSION_WORDS = (128, 140)  # and, of an extension, those
HALF_CODE, FLOAT_CODE = 113, 114  # four halves; one float
SRGB = (72, 75, 78, 99)  # codes one above those of the same blocks
KINDS = ("2d", "cube", "3d", "array")
DEPTHS = {"2d": 3, "cube": 3, "array": 3, "3d": 4}


def _word(c: Column | int) -> Column:
    return code_bytes((F.lit(c) if isinstance(c, int) else c).cast("long"), 4)


def pixel_format(bits: int, masks: tuple[int, int, int, int]) -> list[int]:
    """The flags, code, bits and masks of plain texels."""
    r, g, b, a = masks
    kind = (LUMINANCE if not (g or b) else RGB) if r or g or b else 0
    return [kind | (ALPHA_PIXELS if a and kind else ALPHA_ONLY if a else 0), 0, bits, *masks]


def dds_header(width: Column, height: Column, mips: Column, size: Column, pixels: list, kind: str = "2d", depth: int = 1, dxgi: Column | None = None, images: int = 1, pitch: bool = False) -> Column:
    """The bytes before the payload. size: of the base level, or of a row of texels if ``pitch``; pixels: flags, code (a
    column of four bytes, or a number), bits and masks; with a dxgi code the extension follows, which alone can tell of
    arrays."""
    if kind not in KINDS or (kind == "array" and dxgi is None):
        raise ValueError(f"unsupported kind of texture: {kind}")
    zeros = lambda n: F.unhex(F.lit("00" * n))
    flags = F.lit(CAPS | (PITCH if pitch else LINEAR_SIZE) | (DEPTH if kind == "3d" else 0)) + F.when(mips > 1, F.lit(MIPS)).otherwise(0)
    caps2 = {"cube": CUBE, "3d": VOLUME}.get(kind, 0)
    caps = F.lit(TEXTURE | (COMPLEX if caps2 else 0)).bitwiseOR(F.when(mips > 1, F.lit(COMPLEX | MIPMAP)).otherwise(0))
    code = pixels[1].cast("binary") if isinstance(pixels[1], Column) else _word(pixels[1])
    parts = [
        F.unhex(F.lit(MAGIC)), _word(HEADER), _word(flags), _word(height), _word(width), _word(size), _word(depth if kind == "3d" else 0), _word(mips), zeros(44),
        _word(32), _word(pixels[0]), code, *[_word(p) for p in pixels[2:]], _word(caps), _word(caps2), zeros(12),
    ]
    if dxgi is not None:
        parts += [_word(dxgi), _word(DEPTHS[kind]), _word(4 if kind == "cube" else 0), _word(images if kind == "array" else 1), _word(0)]
    return F.concat(*parts)


def _payload(rows: DataFrame, data: str, place: list[str]) -> DataFrame:
    """(surface_id, payload, base): the pieces of each surface in the order of their places; base is the size of the
    pieces of the first face and level. A container is one value, so it has the size of its texture."""
    for c in ("face", "mip", "z"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(0))
    keys = ["face", "mip", "z", *place]
    out = rows.groupBy("surface_id").agg(F.sort_array(F.collect_list(F.struct(*keys, F.hex(data).alias("_data")))).alias("p"), F.max("mip").alias("top"), F.sum(F.when((F.col("face") == 0) & (F.col("mip") == 0), F.length(data))).alias("base"))
    return out.select("surface_id", "base", (F.col("top") + 1).alias("mips"), F.unhex(F.array_join(F.transform("p", lambda x: x["_data"]), "")).alias("payload"))


def to_dds(encoded: DataFrame, fmt: str, extents: DataFrame, kind: str = "2d", dx10: bool = False, depth: int = 1, images: int = 1, srgb: bool = False) -> DataFrame:
    """(surface_id, content): a container for each surface of blocks (surface_id, by, bx, code, and face, mip and z where
    there are several); extents are (surface_id, width, height) of the base level. Faces follow each other with their
    levels."""
    blocks = _payload(encoded, "code", ["by", "bx"]).join(extents, "surface_id").withColumn("format", F.lit(SAME.get(fmt, fmt))).join(format_table(encoded.sparkSession), "format")
    dxgi = F.col("dxgi") + (1 if srgb else 0) if dx10 else None
    head = dds_header(F.col("width"), F.col("height"), F.col("mips"), F.col("base"), [FOURCC, F.lit("DX10") if dx10 else F.col("fourcc"), 0, 0, 0, 0, 0], kind, depth, dxgi, images)
    return blocks.select("surface_id", F.concat(head, "payload").alias("content"))


def plain_dds(rows: DataFrame, extents: DataFrame, bits: int = 32, masks: tuple[int, int, int, int] = (0xFF0000, 0xFF00, 0xFF, 0xFF000000), code: int = 0, alignment: int = 1, kind: str = "2d", depth: int = 1) -> DataFrame:
    """(surface_id, content): a container of packed rows of texels (surface_id, z, y, data, and face and mip), with masks
    or, for floats, a code; kind 3d with the depth of the base level is a volume with its levels."""
    body = _payload(rows, "data", ["y"]).join(extents, "surface_id")
    line = F.floor((F.floor((F.col("width") * bits + 7) / 8) + alignment - 1) / alignment) * alignment
    pixels = [FOURCC, code, 0, 0, 0, 0, 0] if code else pixel_format(bits, masks)
    head = dds_header(F.col("width"), F.col("height"), F.col("mips"), line, pixels, kind, depth, pitch=True)
    return body.select("surface_id", F.concat(head, "payload").alias("content"))


def half_dds(texels: DataFrame, extents: DataFrame, width: int) -> DataFrame:
    """Containers of four halves a texel."""
    return plain_dds(uncompressed(texels, width, (16, 16, 16, 16), kind="float"), extents, 64, code=HALF_CODE)


def dds_info(files: DataFrame) -> DataFrame:
    """files (with content) and what their headers say (only of files that begin like one): valid, width, height, depth, mips, faces, fourcc, dxgi, payload
    (where it begins), and the flags, code, bits and masks of plain texels."""
    c, places = F.col("content"), (*WORDS, *EXTENSION_WORDS)
    digits = lambda text: F.unhex(F.lit(text))
    magic = F.coalesce(F.substring(c, 1, 4) == digits(MAGIC), F.lit(False))
    array = lambda ks: F.array(*[F.lit(k) for k in ks])

    def word(k: Column) -> Column:
        """The word at k, the first byte highest. Most are zero, and conv is dear."""
        four = F.call_function("substring", c, k + 1, F.lit(4))
        return F.when(F.length(c) >= k + 4, F.when(four == digits("00" * 4), F.lit(0).cast("long")).otherwise(F.conv(F.hex(four), 16, 10).cast("long")))

    def swapped(v: Column) -> Column:
        return F.shiftleft(v.bitwiseAND(255), 24).bitwiseOR(F.shiftleft(v.bitwiseAND(0xFF00), 8)).bitwiseOR(F.shiftright(v, 8).bitwiseAND(0xFF00)).bitwiseOR(F.shiftright(v, 24))

    read = F.when(F.substring(c, 85, 4) == digits(b"DX10".hex()), array(places)).otherwise(array(WORDS))
    words = F.transform(F.transform(read, word), swapped)  # each is parsed once, in code that stays small
    out = files.withColumn("_words", F.explode(F.array(F.when(magic, words))))  # one row each: the plan keeps the words instead of parsing them for each field
    at = lambda k: F.get("_words", F.lit(places.index(k)))
    out = out.withColumns({"fourcc": F.substring(c, 85, 4).cast("string"), "valid": magic & F.coalesce(F.substring(c, 5, 4) == digits(f"{HEADER:02X}000000"), F.lit(False))})
    dx10, caps2 = F.col("fourcc") == "DX10", at(112)
    faces = F.when(caps2.bitwiseAND(0x200) != 0, 6).when(dx10, F.greatest(at(140), F.lit(1))).otherwise(1)
    fields = {
        "width": at(16), "height": at(12), "depth": F.when(caps2.bitwiseAND(VOLUME) != 0, F.greatest(at(24), F.lit(1))).otherwise(1), "mips": F.greatest(at(28), F.lit(1)), "faces": faces,
        "dxgi": F.when(dx10, at(128)).otherwise(0), "payload": F.when(dx10, PAYLOAD + EXTENSION).otherwise(PAYLOAD), "pixel_flags": at(80), "code": at(84), "bits": at(88),
    }
    return out.withColumns({n: v.cast("int") for n, v in fields.items()} | {n: at(92 + 4 * i) for i, n in enumerate(("r_mask", "g_mask", "b_mask", "a_mask"))}).drop("_words")


def _levels(rows: DataFrame, size: Column) -> DataFrame:
    """rows for each face and level: face, mip, w, h, d (its extents) and offset, where it begins; size: bytes of a level
    of extents _w, _h and _d of the struct that it is given."""
    extent = lambda c, m: F.greatest(F.call_function("shiftright", F.col(c), m), F.lit(1))
    sizes = F.transform(F.sequence(F.lit(0), F.col("mips") - 1), lambda m: size(extent("width", m), extent("height", m), extent("depth", m)).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("_sizes", sizes).withColumn("_chain", total(F.col("_sizes")))
    rows = rows.withColumn("face", F.explode(F.sequence(F.lit(0), F.col("faces") - 1))).withColumn("mip", F.explode(F.sequence(F.lit(0), F.col("mips") - 1)))
    offset = F.col("payload") + F.col("face") * F.col("_chain") + total(F.slice("_sizes", F.lit(1), F.col("mip")))
    return rows.withColumns({"offset": offset, "w": extent("width", F.col("mip")), "h": extent("height", F.col("mip")), "d": extent("depth", F.col("mip"))}).drop("_sizes", "_chain")


def from_dds(files: DataFrame) -> DataFrame:
    """The blocks (surface_id, face, mip, z, by, bx, format, code) of valid containers (surface_id, content) of a block
    format, of every face and level. A block beyond the end of a file has a null code."""
    table = format_table(files.sparkSession).where("is_block")
    rows = dds_info(files).where("valid")
    plain = F.when(F.col("dxgi").isin(*SRGB), F.col("dxgi") - 1).otherwise(F.col("dxgi"))
    rows = rows.withColumn("_code", F.when(F.col("dxgi") != 0, plain).otherwise(0)).withColumn("_four", F.when(F.col("dxgi") != 0, "").otherwise(F.col("fourcc")))
    named = table.where("fourcc <> ''").select(F.lit(0).alias("_code"), F.col("fourcc").alias("_four"), "format", "unit_bytes").union(table.select("dxgi", F.lit(""), "format", "unit_bytes"))
    rows = rows.join(F.broadcast(named), ["_code", "_four"])
    quads = lambda c: F.floor((c + 3) / 4)
    rows = _levels(rows, lambda w, h, d: quads(w) * quads(h) * d * F.col("unit_bytes"))
    rows = rows.withColumns({"_across": quads(F.col("w")), "_down": quads(F.col("h"))})
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_across") * F.col("_down") * F.col("d") - 1)))
    at = (F.col("offset") + F.col("_i") * F.col("unit_bytes") + 1).cast("int")
    code = F.when(at + F.col("unit_bytes") - 1 <= F.length("content"), F.call_function("substring", F.col("content"), at, F.col("unit_bytes")))
    inside = F.col("_i") % (F.col("_across") * F.col("_down"))
    place = {"z": F.floor(F.col("_i") / (F.col("_across") * F.col("_down"))), "by": F.floor(inside / F.col("_across")), "bx": inside % F.col("_across")}
    return rows.select("surface_id", "face", "mip", *[v.cast("int").alias(n) for n, v in place.items()], "format", code.alias("code"))


def decode_dds(files: DataFrame) -> DataFrame:
    """Texels of 0..255 of the base level of containers of any of the block formats."""
    blocks, out = from_dds(files).where("face = 0 AND mip = 0 AND z = 0"), None
    for fmt in SIZES:
        part = decode(blocks.where(F.col("format") == fmt), fmt)
        out = part if out is None else out.unionByName(part)
    return out


def _expanded(v: Column, size: Column) -> Column:
    """An integer of so many bits (a column) as a byte, its bits repeated below; longer ones are cut."""
    def term(k: Column) -> Column:
        left = (8 - size * (k + 1)).cast("int")
        return F.when(left >= 0, F.call_function("shiftleft", v, left)).when(left > -size, F.call_function("shiftright", v, -left)).otherwise(0).cast("long")

    short = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda total, k: total + term(k))
    return F.when(size > 8, F.call_function("shiftright", v, (size - 8).cast("int"))).when(size > 0, short).otherwise(0)


def plain_texels(files: DataFrame) -> DataFrame:
    """Texels (surface_id, face, mip, z, y, x, r, g, b, a) of containers without blocks: 8-bit channels (0..255) of masks,
    where luminance is grey and a missing alpha 255; halves and floats (code 113 and 114) as they are, a missing channel 0
    and alpha 1. Rows of texels aren't padded."""
    rows = dds_info(files).where("valid AND dxgi = 0")
    size = F.when(F.col("code") == HALF_CODE, 64).when(F.col("code") == FLOAT_CODE, 32).when(F.col("pixel_flags").bitwiseAND(FOURCC) == 0, F.col("bits"))
    rows = rows.withColumn("_bits", size.cast("int")).where("_bits > 0 AND _bits % 8 = 0")
    rows = _levels(rows, lambda w, h, d: w * h * d * F.col("_bits") / 8)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") * F.col("d") - 1)))
    data = F.call_function("substring", F.col("content"), (F.col("offset") + F.col("_i") * F.col("_bits") / 8 + 1).cast("int"), (F.col("_bits") / 8).cast("int"))
    rows = rows.withColumn("_d", data)
    value = F.when(F.col("_bits") == 8, little(F.col("_d"), 0, 1)).when(F.col("_bits") == 16, little(F.col("_d"), 0, 2)).when(F.col("_bits") == 24, little(F.col("_d"), 0, 3)).otherwise(little(F.col("_d"), 0, 4))
    rows = rows.withColumn("_v", value)

    def masked(c: str) -> Column:
        mask = F.col(f"{c}_mask")
        shift = F.bit_count(mask.bitwiseAND(-mask) - 1).cast("int")
        return _expanded(F.call_function("shiftright", F.col("_v").bitwiseAND(mask), shift), F.bit_count(mask))

    single = F.when(F.shiftright("_v", 31) == 1, -1.0).otherwise(1.0) * F.when(F.col("_v").bitwiseAND(2**31 - 1) == 0, 0.0).otherwise((F.col("_v").bitwiseAND(2**23 - 1) + 2**23) * F.pow(F.lit(2.0), F.shiftright("_v", 23).bitwiseAND(255) - 150))
    grey = F.col("pixel_flags").bitwiseAND(LUMINANCE) != 0
    channels = []
    for i, c in enumerate("rgba"):
        plain = F.when(F.col("a_mask") == 0, 255).otherwise(masked("a")) if c == "a" else F.when(grey, masked("r")).otherwise(masked(c))
        alone = single if c == "r" else F.lit(1.0 if c == "a" else 0.0)
        channels.append(F.when(F.col("code") == HALF_CODE, from_half(little(F.col("_d"), 2 * i, 2))).when(F.col("code") == FLOAT_CODE, alone).otherwise(plain.cast("double")).alias(c))
    inside = F.col("_i") % (F.col("w") * F.col("h"))
    place = {"z": F.floor(F.col("_i") / (F.col("w") * F.col("h"))), "y": F.floor(inside / F.col("w")), "x": inside % F.col("w")}
    return rows.select("surface_id", "face", "mip", *[v.cast("int").alias(n) for n, v in place.items()], *channels)


def to_ppm(texels: DataFrame, extents: DataFrame) -> DataFrame:
    """(surface_id, content): binary portable pixmaps of texels of 0..255, without alpha."""
    pixel = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in ("r", "g", "b")]).alias("p")
    rows = texels.where("z = 0").select("surface_id", "y", "x", pixel).groupBy("surface_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "p"))).alias("t"))
    head = F.concat(F.lit("P6\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary")
    return rows.join(extents, "surface_id").select("surface_id", F.concat(head, F.unhex(F.array_join(F.transform("t", lambda x: x["p"]), ""))).alias("content"))


def to_tga(texels: DataFrame, extents: DataFrame) -> DataFrame:
    """(surface_id, content): uncompressed 32-bit TGA of texels of 0..255, from the top."""
    pixel = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in ("b", "g", "r", "a")]).alias("p")
    rows = texels.where("z = 0").select("surface_id", "y", "x", pixel).groupBy("surface_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "p"))).alias("t"))
    head = F.concat(F.unhex(F.lit("000002" + "00" * 9)), code_bytes(F.col("width").cast("long"), 2), code_bytes(F.col("height").cast("long"), 2), F.unhex(F.lit("2028")))
    return rows.join(extents, "surface_id").select("surface_id", F.concat(head, F.unhex(F.array_join(F.transform("t", lambda x: x["p"]), ""))).alias("content"))


#: What the number of a TGA's kind says, and what is added to it if texels are coded by runs.
INDEXED, COLOURS, GREY, BY_RUNS = 1, 2, 3, 8


def _by_runs(data: bytes, at: int, count: int, size: int) -> np.ndarray:
    """The bytes of count texels that are coded by packets: one texel and how often, or so many texels."""
    places, left = [], count
    while left > 0:
        n = min((data[at] & 127) + 1, left)
        if data[at] & 128:
            places.append(np.full(n, at + 1))
            at += 1 + size
        else:
            places.append(at + 1 + size * np.arange(n))
            at += 1 + size * n
        left -= n
    if at > len(data):
        raise ValueError("the file ends early")
    return np.frombuffer(data, np.uint8)[np.concatenate(places)[:, None] + np.arange(size)]


def tga(data: bytes) -> np.ndarray:
    """The texels (height, width, 4), 0..1, of a TGA: colours of 16, 24 or 32 bits, indexed colours of 24 bits, or grey,
    which is also its alpha; plain or by runs. A missing alpha is 0."""
    skip, mapped, kind, entries, entry, width, height, bits, flags = struct.unpack_from("<BBB2xHB4xHHBB", data)
    runs, kind = kind >= BY_RUNS, kind % BY_RUNS
    if kind not in (INDEXED, COLOURS, GREY) or (kind == COLOURS and bits not in (16, 24, 32)) or (kind != COLOURS and bits != 8) or (kind == INDEXED and (mapped != 1 or entry != 24 or entries > 256)):
        raise ValueError("unsupported TGA")
    at, n, count = 18 + skip, bits // 8, width * height
    if kind == INDEXED:
        palette = np.frombuffer(data, np.uint8, entries * 3, at).reshape(entries, 3)
        at += entries * 3
    v = (_by_runs(data, at, count, n) if runs else np.frombuffer(data, np.uint8, count * n, at)).reshape(height, width, n)
    v = v if flags & 0x20 else v[::-1]
    if kind == GREY:
        return np.repeat(v, 4, 2) / 255.0
    if kind == INDEXED:
        v = palette[v[..., 0]]
    elif bits == 16:
        word = v[..., 0].astype(np.uint16) + v[..., 1].astype(np.uint16) * 256
        v = np.stack([(c << 3) | (c >> 2) for c in (word & 31, word >> 5 & 31, word >> 10 & 31)], 2)
    alpha = v[..., 3:] if v.shape[2] == 4 else np.zeros((height, width, 1), np.uint8)
    return np.concatenate([v[..., 2::-1], alpha], 2) / 255.0


def radiance(data: bytes) -> np.ndarray:
    """The texels of a Radiance picture with flat or run-length coded lines; alpha is 1."""
    head, rest = data.split(b"\n\n", 1)
    line, body = rest.split(b"\n", 1)
    _, height, _, width = line.split()
    height, width, at = int(height), int(width), 0
    out = np.zeros((height, width, 4), np.uint8)
    for y in range(height):
        if not (8 <= width < 32768 and body[at] == 2 and body[at + 1] == 2):
            out[y] = np.frombuffer(body, np.uint8, width * 4, at).reshape(width, 4)
            at += width * 4
            continue
        at += 4
        for c in range(4):
            x = 0
            while x < width:
                count = body[at]
                if count > 128:
                    out[y, x : x + count - 128, c] = body[at + 1]
                    x, at = x + count - 128, at + 2
                else:
                    out[y, x : x + count, c] = np.frombuffer(body, np.uint8, count, at + 1)
                    x, at = x + count, at + 1 + count
    scale = np.where(out[..., 3:] > 0, np.exp2(out[..., 3:].astype(float) - 136), 0.0)
    return np.concatenate([out[..., :3] * scale, np.ones((height, width, 1))], 2)


READERS = {"tga": tga, "png": png, "hdr": radiance}
TEXELS = "surface_id string, z int, y int, x int, r double, g double, b double, a double"


def read_images(files: DataFrame) -> DataFrame:
    """Texels of files as Spark's binaryFile source reads them (path, content), by extension. A file that can't be read
    fails the job; tessera.sources.folders goes by content and tells of such files in rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                v = READERS[path.rsplit(".", 1)[-1].lower()](bytes(content))
                y, x = np.mgrid[: v.shape[0], : v.shape[1]]
                yield pd.DataFrame({"surface_id": path, "z": 0, "y": y.ravel(), "x": x.ravel(), **{c: v[..., i].ravel() for i, c in enumerate("rgba")}})

    return files.select("path", "content").mapInPandas(run, TEXELS)
