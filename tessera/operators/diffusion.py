"""Quantisation with error diffusion: a scan over a surface in which a texel waits for the one to its left and the three
above it.

``diffuse`` takes surfaces that fit a task: each is gathered to one row of arrays, and a step takes all texels of a wave,
x + 2 y, of all surfaces of one extent. ``diffuse_bands`` takes surfaces of any size: bands of lines are cut to tiles that
lean to the left by a texel a line, so that a tile waits only for those to its left, above and above to the left. All tiles
of a wave, band + column, of all surfaces are done at once by as many tasks; what they hand on, the errors along two sides,
is written for the next two waves. Both give the same values to the bit, whatever the height of the bands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.operators.steps import new_path, stored
from tessera.operators.tiles import CHUNK_CELLS, by_tile, chunks
from tessera.sources.relations import CHANNELS


def diffused(values: np.ndarray, quantize, carried: bool) -> np.ndarray:
    """Channels (n, height, width), quantised texel by texel: 7, 3, 5 and 1 sixteenths of the error go to the right and
    to the three texels below. Without ``carried`` the error leaves out what was carried in, as in the engine whose
    results are matched. A channel may also be given alone."""
    alone = values.ndim == 2
    values = values[None] if alone else values
    n, height, width = values.shape
    out, errors = np.zeros_like(values), np.zeros((n, height + 1, width + 2))  # of a line above and a texel on either side
    for wave in range(width + 2 * (height - 1)):
        y = np.arange(max(0, (wave - width + 2) // 2), min(height - 1, wave // 2) + 1)
        x = wave - 2 * y
        spread = errors[:, y, x] / 16 + errors[:, y, x + 1] * 5 / 16 + errors[:, y, x + 2] * 3 / 16 + errors[:, y + 1, x] * 7 / 16
        wanted = values[:, y, x] + spread
        out[:, y, x] = quantize(wanted)
        errors[:, y + 1, x + 1] = (wanted if carried else values[:, y, x]) - out[:, y, x]
    return out[0] if alone else out


def leaning(values: np.ndarray, there: np.ndarray, errors: np.ndarray, quantize, carried: bool) -> np.ndarray:
    """The same of tiles whose line i is shifted by i texels: values (..., lines, columns), and which places are texels.
    errors (..., lines + 1, columns + 2) holds those of the line above and of two columns to the left, and gets the tiles'."""
    lines, columns = values.shape[-2:]
    out = np.zeros_like(values)
    for wave in range(lines + columns - 1):
        i = np.arange(max(0, wave - columns + 1), min(lines - 1, wave) + 1)
        j = wave - i
        spread = errors[..., i, j] / 16 + errors[..., i, j + 1] * 5 / 16 + errors[..., i, j + 2] * 3 / 16 + errors[..., i + 1, j + 1] * 7 / 16
        wanted = values[..., i, j] + spread
        out[..., i, j] = quantize(wanted)
        errors[..., i + 1, j + 2] = np.where(there[..., i, j], (wanted if carried else values[..., i, j]) - out[..., i, j], 0.0)
    return out


def levels(bits: int, threshold: float | None):
    top = 2**bits - 1
    if threshold is not None:
        return lambda v: (v > threshold).astype(float)
    return lambda v: np.clip(np.floor(v * top + 0.5) / top, 0.0, 1.0)


def diffuse(texels: DataFrame, bits: int = 1, threshold: float | None = None, channels=CHANNELS, carried: bool = False) -> DataFrame:
    """Slice 0 of each surface quantised to ``bits``, or to 0 and 1 about a threshold, with error diffusion. Surfaces are
    whole rectangles from the origin."""
    level = levels(bits, threshold)

    @F.pandas_udf(ArrayType(DoubleType()))
    def scan(values: pd.Series, width: pd.Series) -> pd.Series:
        out = [None] * len(values)
        shapes = {}
        for i, (v, w) in enumerate(zip(values, width, strict=True)):
            shapes.setdefault((len(v) // w, w), []).append(i)
        for (height, w), rows in shapes.items():
            some = np.stack([np.asarray(values.iloc[i], float) for i in rows]).reshape(len(rows), height, w)
            for i, done in zip(rows, diffused(some, level, carried), strict=True):
                out[i] = done.ravel()
        return pd.Series(out)

    place = ["z", "y", "x"]
    whole = texels.where("z = 0").groupBy("surface_id").agg(F.sort_array(F.collect_list(F.struct(*place, *CHANNELS))).alias("t"), (F.max("x") + 1).alias("w"))
    column = lambda c: F.transform("t", lambda t: t[c].cast("double"))
    rows = whole.select("surface_id", "t", *[(scan(column(c), F.col("w")) if c in channels else column(c)).alias(c) for c in CHANNELS])
    rows = rows.select("surface_id", F.explode(F.arrays_zip(F.col("t"), *CHANNELS)).alias("v"))
    return rows.select("surface_id", *[F.col(f"v.t.{c}").alias(c) for c in place], *[F.col(f"v.{c}").alias(c) for c in CHANNELS]).select(texels.columns)


LEANING = ("surface_id", "z", "band", "column")
TEXEL, ERROR = 0, 1  # what a row of a wave is


def _wave(lines: int, columns: int, channels: tuple[str, ...], quantize, carried: bool):
    def some(table: pa.Table, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Tiles at once, cut to the lines and columns that they have."""
        band, column, y, x, kind = (table.column(c).to_numpy() for c in ("band", "column", "y", "x", "kind"))
        i, j, own = y - band * lines, x + y - column * columns, kind == TEXEL
        shape = int(i.max()) + 1, int(j.max()) + 1
        n = int(ids[-1]) + 1
        values, errors = np.zeros((len(channels), n, *shape)), np.zeros((len(channels), n, shape[0] + 1, shape[1] + 2))
        there = np.zeros((n, *shape), bool)
        there[ids[own], i[own], j[own]] = True
        for k, c in enumerate(channels):
            v = table.column(c).to_numpy()
            values[k, ids[own], i[own], j[own]] = v[own]
            errors[k, ids[~own], i[~own] + 1, j[~own] + 2] = v[~own]
        done = leaning(values, there, errors, quantize, carried)
        texels = table.filter(pa.array(own))
        i, j, ids, y, x, band, column = (v[own] for v in (i, j, ids, y, x, band, column))

        def put(at: np.ndarray, **new: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = texels.take(pa.array(at))
            for name, v in new.items():
                rows = rows.set_column(rows.column_names.index(name), name, pa.array(v))
            yield from rows.to_batches()

        yield from put(np.arange(len(i)), **{c: done[k, ids, i, j] for k, c in enumerate(channels)})
        # the last line goes to the tile below, the last two columns to the right one, their meeting to both and across
        low, right = i == lines - 1, j >= columns - 2
        for side, down, over in ((right, 0, 1), (low, 1, 0), (low & right, 1, 1)):
            at = np.flatnonzero(side)
            if len(at):
                goes = {"kind": np.full(len(at), ERROR), "wave": (band + column)[at] + down + over, "band": band[at] + down, "column": column[at] + over}
                yield from put(at, **{name: v.astype(np.int32) for name, v in goes.items()}, **{c: errors[k, ids[at], i[at] + 1, j[at] + 2] for k, c in enumerate(channels)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids in chunks(batches, LEANING):
            i = table.column("y").to_numpy() - table.column("band").to_numpy() * lines
            j = table.column("x").to_numpy() + table.column("y").to_numpy() - table.column("column").to_numpy() * columns
            most = max(1, CHUNK_CELLS // ((int(i.max()) + 2) * (int(j.max()) + 3)))
            for low in range(0, int(ids[-1]) + 1, most):
                a, b = np.searchsorted(ids, (low, low + most))
                if (table.column("kind").to_numpy()[a:b] == TEXEL).any():
                    yield from some(table.slice(a, b - a), ids[a:b] - low)

    return run


def diffuse_bands(texels: DataFrame, lines: int = 256, columns: int = 1024, bits: int = 1, threshold: float | None = None, channels=CHANNELS, carried: bool = False) -> DataFrame:
    """diffuse for surfaces of any size, each slice by itself: bands of so many lines, cut to tiles of so many columns (at
    least 2). There is a step for each wave, of which there are as many as bands and tiles of a band of the largest
    surface; what is held is a tile, or some small ones. A step that is lost is run again from what the two before it wrote."""
    if lines < 1 or columns < 2:
        raise ValueError("bands have a line at least, tiles two columns")
    spark, root = texels.sparkSession, new_path(texels.sparkSession, "diffusion")
    whole = lambda c: F.floor(c).cast("int")
    rows = texels.select("surface_id", *[F.col(c).cast("int").alias(c) for c in "zyx"], *[F.col(c).cast("double").alias(c) for c in CHANNELS])
    rows = rows.withColumns({"kind": F.lit(TEXEL), "band": whole(F.col("y") / lines), "column": whole((F.col("x") + F.col("y")) / columns)})
    rows = stored(rows.withColumn("wave", F.col("band") + F.col("column")), "waves", ["wave"])
    schema, steps = rows.schema, {}
    scan = _wave(lines, columns, tuple(channels), levels(bits, threshold), carried)
    for wave in sorted(r.wave for r in rows.select("wave").distinct().collect()):  # a number for each step
        now = rows.where(F.col("wave") == wave)
        for before in (wave - 1, wave - 2):
            if before in steps:
                now = now.unionByName(steps[before].where((F.col("kind") == ERROR) & (F.col("wave") == wave)))
        out = by_tile(now, now.count(), LEANING).mapInArrow(scan, schema)
        path = f"{root}/step={wave}"
        out.write.partitionBy("kind", "wave").parquet(path)
        steps[wave] = spark.read.schema(schema).parquet(path)
    if not steps:
        return texels
    done = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/step={wave}/kind={TEXEL}" for wave in steps])
    return done.select("surface_id", *"zyx", *CHANNELS).select(texels.columns)
