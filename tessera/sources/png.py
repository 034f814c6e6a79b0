"""PNG files: a reader of all depths, colours and both orders of lines, and a writer by bands.

Reading is numpy on whole lines, or on the diagonals of an image where a filter needs the texel to the left: never on single
bytes. Writing is a Spark job: lines are packed and gathered to bands, each band is deflated by itself and flushed to a
whole byte, and the checksum of the file is folded from those of its bands, so that no task holds an image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.packing import packed_rows

#: Fixed values of the format: the signature; channels by colour type; the seven passes (first line and column, steps).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS_OF = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
ADLER = 65521
LAST = 1 << 40  # the number of the piece after all bands


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines (height, bytes) of raw lines that begin with the number of their filter; step: bytes of a texel."""
    kinds, height, size = raw[:, 0], len(raw), raw.shape[1] - 1
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    if not (kinds > 2).any():  # none, left and above: whole lines
        out, above = np.empty((height, size), np.uint8), np.zeros(size, np.uint8)
        for y in range(height):
            line = raw[y, 1:]
            above = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel() if kinds[y] == 1 else line + above if kinds[y] == 2 else line
            out[y] = above
        return out
    width = size // step
    values = np.zeros((height + 1, width + 1, step), np.int16)  # a line above and a texel to the left of zeros
    coded, kinds = raw[:, 1:].reshape(height, width, step).astype(np.int16), kinds.astype(np.int16)[:, None]
    for wave in range(width + height - 1):
        y = np.arange(max(0, wave - width + 1), min(height - 1, wave) + 1)
        x = wave - y
        left, above, corner, kind = values[y + 1, x], values[y, x + 1], values[y, x], kinds[y]
        a, b, c = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = np.where(kind == 1, left, np.where(kind == 2, above, np.where(kind == 3, (left + above) >> 1, np.where(kind == 4, nearest, 0))))
        values[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return values[1:, 1:].reshape(height, size).astype(np.uint8)


def _samples(lines: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    """(height, width, n) of packed lines."""
    if depth == 16:
        return lines.reshape(len(lines), width, n, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return lines.reshape(len(lines), width, n)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, 1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)


def png(data: bytes, exact: bool = False) -> np.ndarray:
    """The texels (height, width, 4), 0..1, of a PNG; a missing alpha is 0, a transparent colour has alpha 0 among ones.
    16 bits are cut to 8, as in the engine whose results are matched, but if exact."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, idat, palette, clear, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the file ends early")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + size
    if head is None or not idat:
        raise ValueError("no image")
    width, height, depth, colour, _, _, interlace = head
    if colour not in CHANNELS_OF or depth not in (1, 2, 4, 8, 16) or not width or not height:
        raise ValueError("unsupported PNG")
    n = CHANNELS_OF[colour]
    raw, step = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8), max(1, n * depth // 8)
    out, place = np.zeros((height, width, n), np.uint16), 0
    for top, left, down, right in PASSES if interlace else ((0, 0, 1, 1),):
        h, w = -(-(height - top) // down), -(-(width - left) // right)
        if h <= 0 or w <= 0:
            continue
        size = -(-w * n * depth // 8)
        lines = unfiltered(raw[place : place + h * (size + 1)].reshape(h, size + 1), step)
        out[top::down, left::right] = _samples(lines, w, n, depth)
        place += h * (size + 1)
    full = (1 << depth) - 1
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint16)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        index = out[..., 0]
        return np.concatenate([palette[index], alpha[index][..., None] if clear is not None else np.zeros((height, width, 1), np.uint16)], 2) / 255.0
    seen = None
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")[:n]
        seen = np.where((out == key).all(axis=2), 0.0, 1.0)
    values = out / float(full) if exact or depth < 16 else (out >> 8) / 255.0
    rgb = values[..., :3] if n >= 3 else np.repeat(values[..., :1], 3, 2)
    alpha = values[..., -1] if n in (2, 4) else seen if seen is not None else np.zeros((height, width))
    return np.concatenate([rgb, alpha[..., None]], 2)


def _filtered(lines: np.ndarray, step: int) -> np.ndarray:
    """Lines with the filter, of none, left and above, whose bytes are nearest to zero; the first line has none above."""
    left = lines.copy()
    left[:, step:] -= lines[:, :-step]
    above = lines.copy()
    above[1:] -= lines[:-1]
    choices = np.stack([lines, left, above])
    cost = np.abs(choices.view(np.int8).astype(np.int32)).sum(axis=2)
    cost[2, 0] = np.iinfo(np.int32).max
    kind = cost.argmin(axis=0)
    return np.concatenate([kind.astype(np.uint8)[:, None], choices[kind, np.arange(len(lines))]], axis=1)


def _deflated(step: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sums, sizes = [], [], []
            for lines, first, last in zip(batch.column("lines").to_pylist(), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
                body = _filtered(np.array([np.frombuffer(x, np.uint8) for x in lines]), step).tobytes()
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                data = packer.compress(body) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
                out.append((b"\x78\x9c" if first else b"") + data)
                sums.append(zlib.adler32(body))
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column("surface_id"), batch.column("band"), pa.array(out, pa.binary()), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64())], names=["surface_id", "band", "data", "adler", "size"])

    return run


def _word(c: Column) -> Column:
    """Four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))


def _chunk(kind: str, body: Column) -> Column:
    named = F.concat(F.lit(kind).cast("binary"), body)
    return F.concat(_word(F.length(body)), named, _word(F.crc32(named)))


def png_pieces(texels: DataFrame, extents: DataFrame, alpha: bool = True, band: int = 64) -> DataFrame:
    """(surface_id, piece, data): PNG files of 8 bits a channel of texels of 0..255 (slice 0), in pieces; those of a file,
    in the order of piece, are its bytes. extents are (surface_id, width, height)."""
    channels = "rgba" if alpha else "rgb"
    value = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(255)).cast("long")
    lines = packed_rows(texels.where("z = 0"), [(value(c), 8) for c in channels], 0).withColumn("band", F.floor(F.col("y") / band))
    bands = lines.groupBy("surface_id", "band").agg(F.sort_array(F.collect_list(F.struct("y", "data")))["data"].alias("lines"))
    bands = bands.join(extents.select("surface_id", "height"), "surface_id")
    bands = bands.select("surface_id", "band", "lines", (F.col("band") == 0).alias("first"), (F.col("band") == F.floor((F.col("height") - 1) / band)).alias("last"))
    kind = dict(texels.dtypes)["surface_id"]
    packed = bands.mapInArrow(_deflated(len(channels)), f"surface_id {kind}, band long, data binary, adler long, size long")
    body = packed.select("surface_id", (F.col("band") + 1).alias("piece"), _chunk("IDAT", F.col("data")).alias("data"), "adler", "size")
    # two sums of a band: all bytes, and these sums added up; they are joined as if the bytes followed each other
    sums = F.sort_array(F.collect_list(F.struct("piece", "adler", "size")))

    def joined(total: Column, x: Column) -> Column:
        low, high = x["adler"] % 65536, F.floor(x["adler"] / 65536)
        return F.struct(((total["a"] + low + ADLER - 1) % ADLER).alias("a"), ((total["b"] + high + x["size"] % ADLER * (total["a"] + ADLER - 1)) % ADLER).alias("b"))

    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    total = body.groupBy("surface_id").agg(F.aggregate(sums, start, joined).alias("t"))
    end = F.concat(_chunk("IDAT", _word(F.col("t.b") * 65536 + F.col("t.a"))), _chunk("IEND", F.lit(b"")))
    head = F.concat(_word(F.col("width")), _word(F.col("height")), F.lit(bytes([8, 6 if alpha else 2, 0, 0, 0])))
    first = extents.select("surface_id", F.lit(0).cast("long").alias("piece"), F.concat(F.lit(SIGNATURE), _chunk("IHDR", head)).alias("data"))
    return first.unionByName(body.drop("adler", "size")).unionByName(total.select("surface_id", F.lit(LAST).alias("piece"), end.alias("data")))
