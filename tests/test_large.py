"""Images that are more than a task holds: tiles, bands and mixed extents against whole ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import extents as E
from tessera.operators import filters as W
from tessera.operators import tiles
from tessera.operators.diffusion import diffuse_bands, diffused, levels
from tessera.operators.sampling import bilinear_rms
from tessera.sources.relations import CHANNELS

SCHEMA = "surface_id int, z int, y int, x int, r double, g double, b double, a double"


def frame(spark, images, z=0):
    """images: by surface, (height, width) or (height, width, 4)."""
    rows = []
    for i, v in images.items():
        v = v if v.ndim == 3 else np.repeat(v[..., None], 4, 2)
        rows += [(i, z, y, x, *map(float, v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, SCHEMA)


def image(df, surface, column="r"):
    rows = df.where(F.col("surface_id") == surface).select("y", "x", column).collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.nan)
    for r in rows:
        assert np.isnan(out[r.y, r.x])
        out[r.y, r.x] = r[column]
    return out


PAD = {"mirror": "reflect", "repeat": "wrap", "clamp": "edge"}


@pytest.mark.parametrize("mode", ["mirror", "repeat", "clamp"])
@pytest.mark.parametrize("side", [4, 7, 64])
def test_convolution_by_tiles(spark, mode, side):
    """Extents below, at and above a tile, and below the reach of the kernel."""
    rng = np.random.default_rng(side)
    images = {1: rng.random((19, 13)), 2: rng.random((4, 8)), 3: rng.random((1, 5)), 4: rng.random((2, 1))}
    k = W.kernel("sobel5")
    texels = frame(spark, images)
    got = tiles.convolved(texels, {"s": k, "t": [list(r) for r in zip(*k, strict=True)]}, E.extents_of(texels), "r", mode, side)
    for i, v in images.items():
        padded = np.pad(v, 2, mode=PAD[mode])
        want = sum(k[r][c] * padded[r : r + v.shape[0], c : c + v.shape[1]] for r in range(5) for c in range(5))
        assert image(got, i, "s") == pytest.approx(want, abs=1e-12) and image(got, i) == pytest.approx(v)
    one = W.convolve(frame(spark, {1: images[1]}), k, (13, 19), "r", mode)
    assert image(one, 1) == pytest.approx(image(got, 1, "s"))


def test_each_slice_by_itself(spark):
    a, b = np.arange(12.0).reshape(3, 4), np.ones((3, 4))
    texels = frame(spark, {1: a}).union(frame(spark, {1: b}, z=1))
    got = W.convolve(texels, [[0, 0, 0], [0, 2, 0], [0, 0, 0]], (4, 3), "r")
    assert image(got.where("z = 1"), 1) == pytest.approx(2 * b) and image(got.where("z = 0"), 1) == pytest.approx(2 * a)


def plain_diffused(v, quantize, carried):
    """Texel by texel."""
    height, width = v.shape
    out, row = np.zeros_like(v), np.zeros(width + 2)
    for y in range(height):
        below = np.zeros(width + 2)
        for x in range(width):
            wanted = v[y, x] + row[x + 1]
            out[y, x] = quantize(np.array([wanted]))[0]
            d = (wanted if carried else v[y, x]) - out[y, x]
            row[x + 2] += 7 / 16 * d
            below[x : x + 3] += np.array([3, 5, 1]) / 16 * d
        row = below
    return out


@pytest.mark.parametrize("carried", [False, True])
@pytest.mark.parametrize(("lines", "columns"), [(1, 2), (3, 5), (4, 4), (64, 1000)])
def test_diffusion_by_bands(spark, carried, lines, columns):
    rng = np.random.default_rng(3)
    images = {1: rng.random((11, 9)), 2: rng.random((5, 17)), 3: rng.random((1, 6)), 4: rng.random((6, 1))}
    got = diffuse_bands(frame(spark, images), lines, columns, 2, carried=carried)
    for i, v in images.items():
        want = plain_diffused(v, levels(2, None), carried)
        assert (diffused(v, levels(2, None), carried) == want).all()
        assert (image(got, i) == want).all() and (image(got, i, "a") == want).all()


def test_bands_of_one_channel_and_nothing(spark):
    v = np.random.default_rng(1).random((5, 5, 4))
    got = diffuse_bands(frame(spark, {1: v}), 2, 3, threshold=0.5, channels=("g",))
    assert (image(got, 1, "g") == diffused(v[..., 1], levels(1, 0.5), False)).all() and (image(got, 1, "b") == v[..., 2]).all()
    assert diffuse_bands(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        diffuse_bands(frame(spark, {1: v}), 2, 1)


def test_mixed_extents_are_as_alone(spark):
    rng = np.random.default_rng(9)
    images = {1: rng.random((8, 8)), 2: rng.random((7, 10)), 3: rng.random((1, 1)), 4: rng.random((3, 16))}
    texels = frame(spark, images)
    extents = E.extents_of(texels)
    assert {(r.surface_id, r.width, r.height, r.depth) for r in extents.collect()} == {(i, v.shape[1], v.shape[0], 1) for i, v in images.items()}
    chain = E.mip_chain(texels, extents, W.triangle()).persist()
    plain = E.mip_chain(texels, extents).persist()
    for i, v in images.items():
        size = (v.shape[1], v.shape[0])
        assert {r.mip for r in chain.where(F.col("surface_id") == i).collect()} == set(range(len(W.mip_extents(size))))
        for found, shape in ((chain, W.triangle()), (plain, None)):
            alone = W.mip_chain(frame(spark, {i: v}), size, shape)
            for mip in range(len(W.mip_extents(size))):
                assert image(found.where(F.col("mip") == mip), i) == pytest.approx(image(alone.where(F.col("mip") == mip), i), abs=1e-12)


def test_volumes_of_mixed_extents(spark):
    rows = [(i, z, y, x, *[float(i + z + y * x)] * 4) for i, n in ((1, (4, 2, 6)), (2, (3, 3, 3))) for z in range(n[2]) for y in range(n[1]) for x in range(n[0])]
    texels = spark.createDataFrame(rows, SCHEMA)
    level, to = E.next_mip(texels, E.extents_of(texels))
    assert {(r.surface_id, r.width, r.height, r.depth) for r in to.collect()} == {(1, 2, 1, 3), (2, 1, 1, 1)}
    assert level.groupBy("surface_id").count().orderBy("surface_id").collect()[0]["count"] == 6
    assert level.where("surface_id = 2").first().r == pytest.approx(2 + 1 + 1)


def test_each_surface_stops_by_itself(spark):
    smooth, rough = np.tile(np.linspace(0.4, 0.5, 16), (16, 1)), np.random.default_rng(2).random((16, 16))
    texels = frame(spark, {1: smooth, 2: rough, 3: np.full((5, 40), 0.5)})
    out, at = E.auto_resized(texels, E.extents_of(texels), 0.05)
    assert {(r.surface_id, r.width, r.height) for r in at.collect()} == {(1, 4, 4), (2, 16, 16), (3, 40, 5)}  # 3 is too low for a half of 3 lines
    assert image(out, 2) == pytest.approx(rough) and image(out, 1).shape == (4, 4)
    half = frame(spark, {1: smooth[::2, ::2]})
    mine = E.bilinear_rms(frame(spark, {1: smooth}), E.extents_of(frame(spark, {1: smooth})), half, E.extents_of(half)).first().rms
    assert mine == pytest.approx(bilinear_rms(frame(spark, {1: smooth}), (16, 16), half, (8, 8)).first().rms)


def test_coverage_of_mixed_extents(spark):
    from tessera.operators import stats

    rng = np.random.default_rng(4)
    images = {1: rng.random((8, 8)), 2: rng.random((9, 14)) * 0.5, 3: np.full((4, 4), 0.5), 4: rng.random((1, 9))}
    texels = frame(spark, images)
    got = {r.surface_id: r.coverage for r in E.coverage(texels, 0.3).collect()}
    for i in (1, 2, 3):
        h, w = images[i].shape
        assert got[i] == pytest.approx(stats.coverage(frame(spark, {i: images[i]}), w, h, 0.3).first().coverage)
    assert 4 not in got  # a line has no quads
    scales = {r.surface_id: r.scale for r in E.coverage_scales(texels, 0.5, 0.6).collect()}
    for i in (1, 2):
        h, w = images[i].shape
        assert scales[i] == W.scale_to_coverage(frame(spark, {i: images[i]}), (w, h), 0.5, 0.6)[1]
    out = E.scaled_to_coverage(texels, 0.5, 0.6)
    assert image(out, 1, "a") == pytest.approx(np.clip(images[1] * scales[1], 0, 1)) and image(out, 4, "a") == pytest.approx(images[4]) and image(out, 1, "r") == pytest.approx(images[1])
    assert set(CHANNELS) <= set(out.columns)
