"""Layouts of textures, and orders of spherical harmonics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.operators import textures as X

TEXTURE = "surface_id int, kind string, width int, height int, depth int, images int, mips int"
PART = "surface_id int, face int, mip int, width int, height int, depth int"


def test_parts_and_faults(spark):
    textures = spark.createDataFrame([
        (1, "2d", 5, 3, 9, 1, 0), (2, "cube", 4, 4, 1, 1, 0), (3, "3d", 4, 2, 8, 1, None), (4, "array", 2, 2, 1, 3, 1), (5, "cube", 4, 3, 1, 1, 0), (6, "2d", 4, 4, 1, 1, 9), (7, "flat", 1, 1, 1, 1, 1), (8, "2d", 0, 4, 1, 1, 1),
    ], TEXTURE)
    parts = X.expected_parts(textures.where("surface_id < 5"))
    rows = {(r.surface_id, r.face, r.mip): (r.width, r.height, r.depth) for r in parts.collect()}
    assert rows[1, 0, 0] == (5, 3, 1) and rows[1, 0, 2] == (1, 1, 1) and (1, 0, 3) not in rows
    assert len([k for k in rows if k[0] == 2]) == 18 and rows[3, 0, 1] == (2, 1, 4) and rows[3, 0, 3] == (1, 1, 1) and len([k for k in rows if k[0] == 4]) == 3
    assert X.faults(textures.where("surface_id < 5"), parts).count() == 0
    broken = spark.createDataFrame([(*k, *((9, 9, 9) if k == (3, 0, 1) else v)) for k, v in rows.items() if k != (2, 5, 0)] + [(4, 3, 0, 2, 2, 1), (99, 0, 0, 1, 1, 1), (6, 0, 0, 4, 4, 1)], PART)
    got = {(r.surface_id, r.face, r.mip, r.fault) for r in X.faults(textures, broken).collect()}
    assert got == {
        (2, 5, 0, "missing"), (3, 0, 1, "wrong extents"), (4, 3, 0, "unexpected"), (99, 0, 0, "unexpected"),
        (5, None, None, "cube isn't square"), (6, None, None, "too many levels"), (7, None, None, "unknown kind"), (8, None, None, "extents below one"),
    }


def test_texels_of_sound_textures(spark):
    textures = spark.createDataFrame([(1, "2d", 2, 1, 1, 1, 1), (2, "2d", 3, 1, 1, 1, 1)], TEXTURE)
    texels = spark.createDataFrame([(i, 0, 0, 0, 0, x, 0.5) for i in (1, 2) for x in range(2)], "surface_id int, face int, mip int, z int, y int, x int, r double")
    good, wrong = X.sound_texels(textures, texels)
    assert {r.surface_id for r in good.collect()} == {1} and [(r.surface_id, r.fault) for r in wrong.collect()] == [(2, "wrong extents")]


def test_harmonics_are_orthogonal(spark):
    """On a grid over the sphere products of two harmonics up to order 6 add up to one or nothing; the first nine are those
    of the fixed form."""
    n = 40
    nodes, weights = np.polynomial.legendre.leggauss(n)
    rows = [(float(math.sqrt(1 - z * z) * math.cos(a)), float(math.sqrt(1 - z * z) * math.sin(a)), float(z), float(w * 2 * math.pi / n)) for z, w in zip(nodes, weights, strict=True) for a in np.arange(n) * 2 * math.pi / n]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    values = T.harmonics_to(6, F.col("x"), F.col("y"), F.col("z"))
    assert len(values) == 49
    table = np.array([list(r) for r in df.select("w", *[v.alias(f"c{i}") for i, v in enumerate(values.values())]).collect()])
    product = (table[:, 1:] * table[:, :1]).T @ table[:, 1:]
    assert np.abs(product - np.eye(49)).max() < 1e-9
    names = [(band, m) for band in range(3) for m in range(-band, band + 1)]
    fixed = df.select(*[(a - values[k]).alias(f"d{i}") for i, (a, k) in enumerate(zip(T.harmonics(F.col("x"), F.col("y"), F.col("z")), names, strict=True))])
    assert np.abs(np.array([list(r) for r in fixed.collect()])).max() < 1e-6
