"""What steps over surfaces of mixed extents move and repeat."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tessera.operators import extents as E
from tessera.plans import mixed
from tests.test_large import frame


def _images():
    rng = np.random.default_rng(8)
    return {1: rng.random((9, 13)), 2: rng.random((8, 4)), 3: rng.random((1, 5))}


def test_bilinear_error_moves_a_texel_once(spark):
    """No exchange is keyed by the values of texels, as sums of taps would be; the error is that of four taps."""
    images = _images()
    half = {i: v[: -(-v.shape[0] // 2), : -(-v.shape[1] // 2)] for i, v in images.items()}
    t, small = frame(spark, images), frame(spark, half)
    got = E.bilinear_rms(t, E.extents_of(t), small, E.extents_of(small))
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert not [k for k in keys if re.search(r"\br#", k)]
    for row in got.collect():
        v, s = images[row.surface_id], half[row.surface_id]
        at = [np.arange(n) / n * m for n, m in zip(v.shape, s.shape, strict=True)]
        low = [np.floor(a).astype(int) for a in at]
        tap = lambda dy, dx: s[np.minimum(low[0] + dy, s.shape[0] - 1)][:, np.minimum(low[1] + dx, s.shape[1] - 1)]  # noqa: B023, E731
        fy, fx = (at[0] - low[0])[:, None], at[1] - low[1]
        want = (tap(0, 0) * (1 - fx) + tap(0, 1) * fx) * (1 - fy) + (tap(1, 0) * (1 - fx) + tap(1, 1) * fx) * fy
        assert row.rms == pytest.approx(np.sqrt(np.mean(4 * (v - want) ** 2)), abs=1e-12)


def test_quads_of_several_tiles(spark, monkeypatch):
    t = frame(spark, _images()).where("NOT (surface_id = 1 AND y = 4 AND x = 8)")
    rows = lambda: sorted(map(tuple, E._quads(t, "a").collect()))
    whole = rows()
    monkeypatch.setattr(E, "SIDE", 4)
    assert rows() == whole and len(whole) == 8 * 12 - 4 + 7 * 3


def test_coverage_scales_are_searched_once(spark, sf_dir, monkeypatch):
    steps, stored = [], E.stored
    monkeypatch.setattr(E, "stored", lambda df, name, *by: steps.append(name) or stored(df, name, *by))
    mixed.mixed_coverage_scale(spark, sf_dir)
    assert steps.count("bisection") == mixed.STEPS and steps.count("quads") == 1
