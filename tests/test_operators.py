"""Small images made by hand: edge rules, round trips and codes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.operators import codecs, filters, layout, space, stats
from tessera.sources.relations import grid


def image(spark, values, surface=0):
    """A surface of an array (height, width) or (height, width, 4)."""
    v = np.asarray(values, float)
    v = np.repeat(v[..., None], 4, 2) if v.ndim == 2 else v
    rows = [(surface, 0, y, x, *map(float, v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "surface_id int, z int, y int, x int, r double, g double, b double, a double")


def plane(texels, channel="r"):
    rows = texels.select("y", "x", channel).collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.nan)
    for r in rows:
        out[r.y, r.x] = r[channel]
    return out


@pytest.mark.parametrize("extent", [1, 2, 4])
def test_wraps(spark, extent):
    i = spark.range(-3, extent + 4).select("id", *[filters.wrapped(F.col("id"), extent, m).alias(m) for m in ("clamp", "repeat", "mirror")]).collect()

    def mirror(k):
        k = abs(k)
        while k >= extent:
            k = abs(2 * extent - 2 - k) if extent > 1 else 0
        return k

    for r in i:
        assert r.clamp == min(max(r.id, 0), extent - 1) and r["repeat"] == r.id % extent and r.mirror == mirror(r.id)


@pytest.mark.parametrize("shape", [filters.box(), filters.triangle(), filters.quadratic(), filters.cubic(), filters.bspline(), filters.mitchell(), filters.lanczos(), filters.sinc(), filters.kaiser(), filters.gaussian()], ids=str)
@pytest.mark.parametrize("dst", [3, 12])
def test_weights_sum_to_one(spark, shape, dst):
    shape = shape() if callable(shape) else shape
    w = filters.polyphase(spark, shape, 8, dst).groupBy("dst").agg(F.sum("w").alias("w")).collect()
    assert len(w) == dst and all(abs(r.w - 1) < 1e-9 for r in w)


def test_sobel_rows():
    assert filters.kernel("sobel5")[2] == [-3, -4, 0, 4, 3] and filters.kernel("sobel3") == [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]


@pytest.mark.parametrize("size", [(1, 1), (1, 5), (2, 2), (3, 3), (4, 3), (5, 5)])
def test_down_sampling_keeps_the_mean_of_a_constant(spark, size):
    out = plane(filters.fast_down_sample(image(spark, np.full(size[::-1], 0.7)), size))
    assert out.shape == filters.next_extent(size)[::-1] and np.allclose(out, 0.7)


def test_srgb_ladder(spark):
    values = [-1.0, 0.0, 0.0031308, 0.04045, 0.5, 1.0, 2.0, float("nan")]
    r = spark.createDataFrame([(v,) for v in values], "c double").select("c", T.srgb_encode(F.col("c")).alias("e")).collect()
    assert [x.e for x in r][:2] == [0, 0] and r[6].e == 1 and r[7].e == 0
    assert r[4].e == pytest.approx(1.055 * 0.5**0.41666 - 0.055)


def test_normals(spark):
    t = image(spark, [[[0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 0]]])
    assert plane(T.normalize(t)).tolist() == [[0, 0, 1]]
    flat = T.transform_normals(t, "paraboloid").orderBy("x").collect()
    assert flat[0].r is None and flat[2].r == pytest.approx(1.0)


def test_round_trips(spark):
    t = image(spark, np.random.default_rng(1).random((4, 4, 4)))
    back = T.changed(T.to_ycocg(t), b=F.lit(1.0))
    # co is unscaled: b = 1 halves it on the way back
    assert np.allclose(plane(T.from_ycocg(back), "g"), plane(t, "a") * 0 + (plane(T.to_ycocg(t), "a") + plane(T.to_ycocg(t), "g") / 2))
    shared = T.from_rgbe(T.to_rgbe(t))
    assert np.abs(plane(shared, "g") - plane(t, "g")).max() <= 1 / 512


def test_range_and_average_of_a_transparent_image(spark):
    t = image(spark, np.zeros((2, 2, 4)))
    r = stats.value_range(t, "r", "a").first()
    assert (r.low, r.high) == (stats.FLT_MAX, -stats.FLT_MAX) and stats.average(t, "r", "a").first().average == 0


def test_moves(spark):
    t = image(spark, [[1, 2, 3], [4, 5, 6]])
    assert plane(space.flip(t, "x", 3)).tolist() == [[3, 2, 1], [6, 5, 4]]
    assert plane(space.sub_image(t, 1, 2, 0, 1)).tolist() == [[2, 3], [5, 6]]
    one = spark.createDataFrame([(0, 4, 1, 1)], "surface_id int, width int, height int, depth int")
    assert plane(space.canvas(t, grid(one))).tolist() == [[1, 2, 3, 0]]


def test_blocks_over_the_edge_repeat_texels(spark):
    t = image(spark, np.arange(30).reshape(6, 5))
    b = {(r.by, r.bx): [x.r for x in r.t] for r in codecs.gather(t, 5, 6).collect()}
    assert b[0, 1] == [4, 4, 4, 4, 9, 9, 9, 9, 14, 14, 14, 14, 19, 19, 19, 19]
    assert b[1, 1] == [24, 24, 24, 24, 29, 29, 29, 29] * 2


@pytest.mark.parametrize("fmt", ["bc1", "bc3", "bc4", "bc5"])
def test_single_colours_come_back(spark, fmt):
    t = T.to_bytes(image(spark, np.full((4, 4), 0.5)))
    back = plane(codecs.decode(codecs.encode(t, fmt), fmt))
    assert np.abs(back - 127).max() <= 5


def test_refined_codes_are_better(spark):
    t = T.to_bytes(image(spark, np.random.default_rng(2).random((16, 16, 4))))
    blocks = codecs.gather(t)

    def error(refine):
        codes = codecs.colour_codes(blocks, refine).select("surface_id", "by", "bx", F.col("colour").alias("code"))
        return {(r.by, r.bx): r.e for r in stats.paired(t, codecs.decode(codes, "bc1")).groupBy(F.floor(F.col("y") / 4).alias("by"), F.floor(F.col("x") / 4).alias("bx")).agg(F.sum(sum((F.pow(F.col(c) - F.col(f"{c}2"), 2) for c in "rgb"), F.lit(0.0))).alias("e")).collect()}

    plain, refined = error(False), error(True)
    assert sum(refined.values()) < sum(plain.values())


def test_extents():
    assert layout.target_extent(300, 100, 200, "nearest_power") == (128, 32)
    assert layout.target_extent(300, 100, 200) == (200, 66)
    assert layout.target_extent(7, 5, rounding="next_four") == (8, 8) and layout.target_extent(7, 5, rounding="nearest_four") == (7, 5)
    assert len(filters.mip_extents((300, 100))) == math.floor(math.log2(300)) + 1


def test_principal_axis(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(8, 8, 1)) * np.array([3.0, 2.0, 1.0, 0.0]) + rng.normal(size=(8, 8, 4)) * 0.1
    row = stats.principal_axis(stats.covariance(image(spark, v))).first()
    assert abs(np.dot(row["axis"], np.array([3, 2, 1]) / 14**0.5)) > 0.999
    assert stats.principal_axis(stats.covariance(image(spark, np.full((2, 2), 0.5)))).first()["axis"] == pytest.approx([0, 0, 0], abs=1.0)


def test_auto_resize(spark):
    from tessera.plans.surface import Surface

    flat = Surface(image(spark, np.full((9, 6), 0.25)), 6, 9).auto_resized(0.01)
    assert (flat.width, flat.height) == (3, 5) and np.allclose(plane(flat.df), 0.25)
    noise = Surface(image(spark, np.random.default_rng(1).random((8, 8))), 8, 8).auto_resized(0.01)
    assert (noise.width, noise.height) == (8, 8)


@pytest.mark.parametrize("carried", [False, True])
def test_diffusion(carried):
    from tessera.operators.diffusion import diffused

    v = np.full((8, 8), 0.3)
    out = diffused(v, lambda x: (x > 0.5).astype(float), carried)
    assert set(out.ravel()) <= {0.0, 1.0}
    if carried:
        assert abs(out.mean() - 0.3) < 0.08


def test_files(spark, tmp_path):
    import struct
    import zlib

    from tessera.sources import files

    v = np.random.default_rng(6).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    lines = []
    for y in range(5):  # each line with another filter
        kind, line = y, v[y].astype(int).ravel()
        left = np.concatenate((np.zeros(4, int), line[:-4]))
        up = v[y - 1].astype(int).ravel() if y else np.zeros(28, int)
        corner = np.concatenate((np.zeros(4, int), up[:-4]))
        nearest = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner, strict=True)]
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(nearest)}[kind]
        lines.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert np.array_equal(files.png(data), v / 255)
    (tmp_path / "a.png").write_bytes(data)
    t = files.read_images(spark.read.format("binaryFile").load(f"file://{tmp_path}/a.png"))
    assert t.count() == 35 and np.allclose(plane(t, "b"), v[..., 2] / 255)
    extents = t.select("surface_id").distinct().select("surface_id", F.lit(7).alias("width"), F.lit(5).alias("height"))
    made = files.to_tga(T.changed(t, **{c: F.round(F.col(c) * 255) for c in "rgba"}), extents).first().content
    assert np.array_equal(files.tga(bytes(made)), v / 255)
    head = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 2\n"
    assert files.radiance(head + bytes([128, 64, 0, 129, 0, 0, 0, 0])).tolist() == [[[1.0, 0.5, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0]]]


def test_single_colours_have_the_best_pair():
    byte = [(i << 3) | (i >> 2) for i in range(32)]
    table = codecs.single_colours(5)
    for v in range(0, 256, 7):
        cost = {(m, n): abs((2 * byte[m] + byte[n]) // 3 - v) * 100 + abs(m - n) * 3 for m in range(32) for n in range(32)}
        assert cost[tuple(table[v].tolist())] == min(cost.values())


def test_ramp_blocks_against_a_scalar_loop():
    rng = np.random.default_rng(3)
    blocks = np.concatenate([rng.integers(0, 256, (20, 16)), rng.integers(90, 110, (10, 16)), np.full((1, 16), 7)])

    def palette(a, b):
        if a > b:
            return [a, b, *[((8 - k) * a + (k - 1) * b) // 7 for k in range(2, 8)]]
        return [a, b, *[((6 - k) * a + (k - 1) * b) // 5 for k in range(2, 6)], 0, 255]

    def indices(v, a, b):
        p = palette(a, b)
        k = [min(range(8), key=lambda i: ((p[i] - x) ** 2, i)) for x in v]
        return k, sum((p[i] - x) ** 2 for i, x in zip(k, v, strict=True))

    for v, code in zip(blocks.tolist(), codecs.ramp_blocks(blocks).tolist(), strict=True):
        hi, lo = max(v), min(v)
        a, b = hi - (hi - lo) // 34, lo + (hi - lo) // 34
        k, e = indices(v, a, b)
        best = (a, b, k)
        for _ in range(8):
            w = [(7, 0, 6, 5, 4, 3, 2, 1)[i] for i in k]
            aa, ab, bb = sum(x * x for x in w), sum(x * (7 - x) for x in w), sum((7 - x) ** 2 for x in w)
            ax, bx, det = sum(x * y for x, y in zip(w, v, strict=True)), sum((7 - x) * y for x, y in zip(w, v, strict=True)), aa * bb - ab * ab
            if not det:
                break
            fit = [min(255, max(0, 7 * n // det)) for n in (ax * bb - bx * ab, bx * aa - ax * ab)]
            a, b = max(fit), min(fit)
            k, again = indices(v, a, b)
            if again >= e:
                break
            best, e = (a, b, k), again
        bits = sum(i << (3 * n) for n, i in enumerate(best[2]))
        assert code == [best[0], best[1], *bits.to_bytes(6, "little")]


def test_planes_are_those_of_an_eigen_solver(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(4, 4, 4)) * [1.0, 0.5, 0.1, 0.0]
    row = stats.spreads(stats.covariance(image(spark, v))).first()
    points = v.reshape(-1, 4)[:, :3] - v.reshape(-1, 4)[:, :3].mean(axis=0)
    values, vectors = np.linalg.eigh(points.T @ points)
    assert np.allclose([row.spread3, row.spread2, row.spread1], values) and abs(np.dot(row.normal, vectors[:, 0])) == pytest.approx(1)
    flat = stats.planar(stats.covariance(image(spark, v * [1, 1, 0, 0]))).first()
    assert flat.planar and not stats.planar(stats.covariance(image(spark, v))).first().planar
    assert stats.spreads(stats.covariance(image(spark, np.full((2, 2), 0.5)))).first().normal == pytest.approx([0, 0, 1])


def test_four_means(spark):
    """The colours are the means of the texels that are nearest to them."""
    v = np.random.default_rng(12).integers(0, 256, (8, 8, 4))
    blocks = codecs.four_means(codecs.gather(T.to_bytes(image(spark, v / 255 + 1e-9)))).collect()
    assert len(blocks) == 4
    for row in blocks:
        points, means = np.array([[x[c] for c in "rgb"] for x in row.t], float), np.array(row.means).reshape(4, 3)
        nearest = ((points[:, None] - means[None]) ** 2).sum(2).argmin(1)
        assert len(set(nearest.tolist())) == row.clusters
        assert all(np.allclose(points[nearest == k].mean(axis=0), means[k], atol=1e-3) for k in set(nearest.tolist()))
    single = codecs.four_means(codecs.gather(T.to_bytes(image(spark, np.full((4, 4), 0.5))))).first()
    assert single["clusters"] == 1


def test_halves_of_special_values(spark):
    from tessera.functions import packing

    values = [0.0, 1.0, -2.0, 65504.0, 65519.0, 65520.0, 1e9, 6e-8, 5.9e-5, 0.333, float("inf"), float("nan"), -1e-9]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", packing.to_half(F.col("v")).alias("h")).withColumn("back", packing.from_half(F.col("h"))).collect()
    for r in rows:
        want = np.float16(r.v)
        assert (np.isnan(want) and np.isnan(r.back)) or r.back == pytest.approx(float(want), rel=1e-3, abs=6e-8)
    assert [r.h for r in rows][:4] == [0, 0x3C00, 0xC000, 0x7BFF]
    assert packing.mask_field(0x7E0) == (5, 6) and packing.mask_field(0) == (0, 0) and packing.byte_pitch(5, 24, 4) == 16


def test_images_of_the_jvm(spark, tmp_path):
    import struct
    import zlib

    from tessera.sources import relations

    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    v = np.random.default_rng(2).integers(0, 256, (3, 2, 3), dtype=np.uint8)
    body = b"".join(b"\0" + v[y].tobytes() for y in range(3))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))
    t = relations.from_image_source(spark.read.format("image").load(f"file://{tmp_path}"))
    for i, c in enumerate("rgb"):
        assert np.allclose(plane(t, c) * 255, v[..., i])
    assert t.count() == 6 and plane(t, "a").max() == 0
