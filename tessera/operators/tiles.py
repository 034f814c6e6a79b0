"""Rasters of tiles with a halo, for images of any size.

A tile has ``side`` x ``side`` texels and, around them, as many lines and columns as a kernel reaches, wrapped at the
image's edges. Texels inside a tile go there alone, those near a border also to the tiles that have them in their halo: the
halo is exchanged once, in the one shuffle that brings tiles together. A task takes the tiles of its partition from a sorted
stream, small ones of one shape together, so it holds some 32,768 rows or one tile, whatever the size of the image.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.operators.wraps import wrapped
from tessera.sources.relations import CHANNELS

SIDE = 64
PARTITION_ROWS = 1 << 20  # of texels that are brought together by tile
CHUNK_ROWS, CHUNK_CELLS = 1 << 15, 1 << 19  # of tiles that are worked on at once; a larger tile is alone
TILE = ("surface_id", "z", "ty", "tx")
Extents = DataFrame | tuple[int, int]


def with_extents(texels: DataFrame, extents: Extents) -> DataFrame:
    """texels with width and height: of all surfaces, or from a relation (surface_id, width, height)."""
    if isinstance(extents, tuple):
        return texels.withColumns({"width": F.lit(extents[0]), "height": F.lit(extents[1])})
    return texels.join(extents.select("surface_id", "width", "height"), "surface_id")


def _spots(axis: str, extent: Column, halo: int, side: int, mode: str) -> Column:
    """Structs (p, t) for each place p of the padded axis that shows the texel at axis, and each tile t that has p."""
    at, last = F.col(axis), F.floor((extent - 1) / side).cast("int")
    tile = lambda p: F.floor(p / side).cast("int")
    tiles = lambda p: F.sequence(F.greatest(tile(p - halo), F.lit(0)), F.least(tile(p + halo), last))
    spot = lambda p, t: F.struct(p.cast("int").alias("p"), t.cast("int").alias("t"))
    # mirrored and clamped places beyond an edge show texels that the tile has; so does any place of an axis of one tile
    beyond = F.concat(F.sequence(F.lit(-halo), F.lit(-1)), F.sequence(extent, extent + (halo - 1))) if halo and mode == "repeat" else F.array().cast("array<int>")
    places = F.concat(F.array(at), F.when(last > 0, F.filter(beyond, lambda p: wrapped(p, extent, mode) == at)).otherwise(F.array().cast("array<int>")))
    near = F.flatten(F.transform(places, lambda p: F.transform(tiles(p), lambda t: spot(p, t))))
    # most texels are in the middle of a tile of their own
    middle = (at % side >= halo) & (at % side < side - halo) & (at > halo) & (at < extent - 1 - halo)
    return F.when(middle | (last <= 0), F.array(spot(at, tile(at)))).otherwise(near)


def tiled(texels: DataFrame, extents: Extents, halo: int, mode: str = "mirror", side: int = SIDE) -> DataFrame:
    """(surface_id, z, ty, tx, py, px, width, height, channels): the texels of each tile and of its halo, tile by tile in
    each partition. py and px are places in the image, below 0 or beyond it where a tile is to show what only another one
    has; all else beyond an edge is left to the reader, so a surface of one tile moves no texel twice."""
    rows = with_extents(texels, extents)
    rows = rows.withColumns({"_v": F.explode(_spots("y", F.col("height"), halo, side, mode))}).withColumn("_u", F.explode(_spots("x", F.col("width"), halo, side, mode)))
    rows = rows.select("surface_id", "z", F.col("_v.t").alias("ty"), F.col("_u.t").alias("tx"), F.col("_v.p").alias("py"), F.col("_u.p").alias("px"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *CHANNELS)
    return by_tile(rows, texels.count(), TILE)


def by_tile(rows: DataFrame, count: int, keys: tuple[str, ...]) -> DataFrame:
    """rows with those of a key together, sorted by keys; of more than PARTITION_ROWS rows a partition there are more
    partitions than the session asks for, so that what a task sorts doesn't grow with the input."""
    n = -(-count // PARTITION_ROWS)
    asked = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, *keys) if n > asked else rows.repartition(*keys)).sortWithinPartitions(*keys)


def chunks(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream that is sorted by keys, some CHUNK_ROWS rows at once or one larger group, and the number of
    each row's group, from 0."""
    held: list[pa.Table] = []
    size, wanted = 0, CHUNK_ROWS
    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        size += len(batch)
        if size < wanted:
            continue
        table = pa.concat_tables(held).combine_chunks()
        ids = _ids(table, keys)
        whole = int(np.searchsorted(ids, ids[-1]))  # the last group may go on
        if whole:
            yield table.slice(0, whole), ids[:whole]
        held, size = [table.slice(whole)], size - whole
        wanted = max(CHUNK_ROWS, 2 * size)
    if size:
        table = pa.concat_tables(held).combine_chunks()
        yield table, _ids(table, keys)


def _ids(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """A number that changes where any of the keys changes from a row to the next."""
    changes = np.zeros(len(table), bool)
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy(zero_copy_only=False) if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks().indices.to_numpy(zero_copy_only=False)
        changes[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changes)


def wrapped_places(p: np.ndarray, extent: int, mode: str) -> np.ndarray:
    """wrapped() of places of an axis."""
    if mode == "clamp":
        return np.clip(p, 0, extent - 1)
    if mode == "repeat":
        return p % extent
    turn = p % max(2 * extent - 2, 1)
    return np.minimum(turn, 2 * extent - 2 - turn) if extent > 1 else np.zeros_like(p)


def _sources(start: int, size: int, extent: int, halo: int, mode: str) -> np.ndarray:
    """For each place of a tile's padded axis the one that it is a copy of, itself where the tile was given it."""
    p = np.arange(start - halo, start + size + halo)
    if mode == "repeat" and size < extent:  # what another tile has was sent
        return np.arange(len(p))
    return wrapped_places(p, extent, mode) - start + halo


def _summed(kernels: dict[str, np.ndarray], channel: str, halo: int, side: int, mode: str):
    def some(table: pa.Table, ids: np.ndarray, shape: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        """Tiles of one shape: each has its place along each axis, its extents and the surface's."""
        top, left, down, across, height, width = shape
        n = int(ids[-1]) + 1
        i, j = (table.column(c).to_numpy() - at + halo for c, at in (("py", top), ("px", left)))
        plane = np.zeros((n, down + 2 * halo, across + 2 * halo))  # a place without a texel adds nothing
        plane[ids, i, j] = table.column(channel).to_numpy()
        plane = plane[:, _sources(top, down, height, halo, mode)][:, :, _sources(left, across, width, halo, mode)]
        own = np.flatnonzero((i >= halo) & (i < halo + down) & (j >= halo) & (j < halo + across))
        at = ids[own], i[own] - halo, j[own] - halo
        sums = []
        for k in kernels.values():
            total = np.zeros((n, down, across))
            for r, line in enumerate(k):
                for c, w in enumerate(line):
                    if w:
                        total += w * plane[:, r : r + down, c : c + across]
            sums.append(pa.array(total[at]))
        mine = table.take(pa.array(own)).combine_chunks()
        columns = [mine.column(c) for c in ("surface_id", "z", "py", "px", *CHANNELS)] + sums
        yield from pa.table(columns, names=["surface_id", "z", "y", "x", *CHANNELS, *kernels]).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in chunks(batches, TILE):
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            ty, tx, height, width = (table.column(c).to_numpy()[first] for c in ("ty", "tx", "height", "width"))
            shapes = np.stack([ty * side, tx * side, np.minimum(side, height - ty * side), np.minimum(side, width - tx * side), height, width], 1)
            kinds, of = np.unique(shapes, axis=0, return_inverse=True)
            of = of.ravel()
            order = np.argsort(of[ids], kind="stable")
            ends = np.searchsorted(of[ids][order], np.arange(len(kinds) + 1))
            for kind, a, b in zip(kinds.tolist(), ends[:-1], ends[1:], strict=True):
                most = max(1, CHUNK_CELLS // ((kind[2] + 2 * halo) * (kind[3] + 2 * halo)))
                rows = order[a:b]
                number = np.cumsum(np.diff(ids[rows], prepend=ids[rows[0]]) != 0)
                for low in range(0, int(number[-1]) + 1, most):
                    x, y = np.searchsorted(number, (low, low + most))
                    yield from some(table.take(pa.array(rows[x:y])), number[x:y] - low, kind)

    return run


def convolved(texels: DataFrame, kernels: dict[str, list[list[float]]], extents: Extents, channel: str, mode: str = "mirror", side: int = SIDE) -> DataFrame:
    """(surface_id, z, y, x, channels) with a column for each kernel: the sum of its weights and channel about each texel,
    in each slice. Taps are summed inside a tile. Surfaces are rectangles from the origin; a place without a texel gets no
    sum and adds nothing to those about it; a texel without a place or a surface is left out."""
    planes = {name: np.array(k, float) for name, k in kernels.items()}
    halo = max(k.shape[0] for k in planes.values()) // 2
    if any(k.shape[0] // 2 != halo for k in planes.values()):
        raise ValueError("kernels of one call have one size")
    kinds = {f.name: f.dataType for f in texels.schema}
    place = [StructField("surface_id", kinds["surface_id"]), *[StructField(c, texels.select(F.lit(0)).schema[0].dataType) for c in "zyx"]]
    schema = StructType([*place, *[StructField(c, DoubleType()) for c in (*CHANNELS, *planes)]])
    rows = texels.select("surface_id", *[F.col(c).cast("int").alias(c) for c in "zyx"], *[F.col(c).cast("double").alias(c) for c in CHANNELS])
    rows = rows.dropna(subset=["surface_id", "z", "y", "x"])
    return tiled(rows, extents, halo, mode, side).mapInArrow(_summed(planes, channel, halo, side, mode), schema)
