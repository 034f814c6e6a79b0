"""Surfaces with places that have no texel."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.operators import filters as W
from tests.test_large import PAD, frame


def _with_gap(spark):
    """A surface without its last block of 4 x 4 texels, and the same with zeros there."""
    v = np.random.default_rng(3).random((8, 12))
    texels = frame(spark, {0: v}).where("NOT (y >= 4 AND x >= 8)")
    v[4:, 8:] = 0.0
    return texels, v


@pytest.mark.parametrize("mode", ["mirror", "repeat", "clamp"])
def test_a_place_without_a_texel_adds_nothing(spark, mode):
    texels, v = _with_gap(spark)
    k = W.normalized(W.kernel("sobel3"))
    padded = np.pad(v, 1, mode=PAD[mode])
    want = sum(k[r][c] * padded[r : r + 8, c : c + 12] for r in range(3) for c in range(3))
    got = {(r.y, r.x): r.g for r in W.convolve(texels, k, (12, 8), "g", mode).collect()}
    assert len(got) == 80 and all(g == pytest.approx(want[at], abs=1e-12) for at, g in got.items())


def test_normals_beside_a_gap(spark):
    texels, v = _with_gap(spark)
    k = W.normalized(W.kernel("sobel3"))
    padded = np.pad(v, 1, mode="edge")
    du = sum(k[r][c] * padded[r : r + 8, c : c + 12] for r in range(3) for c in range(3))
    dv = sum(k[c][r] * padded[r : r + 8, c : c + 12] for r in range(3) for c in range(3))
    want = 0.5 * du / np.sqrt(du * du + dv * dv + 1 / 256) + 0.5
    bytes_ = texels.select("surface_id", "z", "y", "x", *[(texels[c] * 255).alias(c) for c in "rgba"])
    got = {(r.y, r.x): r.r for r in W.bytes_to_normal_map(bytes_, (12, 8), (1.0, 0.0, 0.0, 0.0), 3, "clamp").collect()}
    assert len(got) == 80 and all(g == pytest.approx(want[at], abs=1e-9) for at, g in got.items())


ODD = {
    "null values": "SELECT vec_id, list_transform(embedding, lambda v, i: CASE WHEN (vec_id * 64 + i) % 23 > 0 THEN v END) AS embedding FROM e",
    "short or no vectors": "SELECT vec_id, CASE vec_id % 7 WHEN 1 THEN embedding[:30] WHEN 2 THEN [] WHEN 3 THEN NULL ELSE embedding END AS embedding FROM e",
    "no ids, and gaps": "SELECT CASE WHEN vec_id % 11 > 0 THEN vec_id END AS vec_id, embedding FROM e WHERE vec_id % 20 < 17",
}


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("name", ["normal_map_bytes", "convolve_sobel", "normal_map", "mixed_convolve"])
def test_odd_vectors_give_what_the_sql_gives(spark, sf_dir, tmp_path, name, odd):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW e AS SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' WHERE vec_id < 130")
    db.execute(f"CREATE TABLE embeddings AS {ODD[odd]}")
    db.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    want = sorted(db.execute(entry.oracle_sql()[name]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert len(got) == len(want) and all(g == pytest.approx(w, abs=2e-6, nan_ok=False) for g, w in zip(got, want, strict=True))
