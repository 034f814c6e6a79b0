"""What tiles move and how many are worked on at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import diffusion, tiles
from tessera.operators import extents as E
from tests.test_large import SCHEMA, frame


@pytest.mark.parametrize("mode", ["mirror", "repeat", "clamp"])
def test_a_surface_of_one_tile_moves_no_texel_twice(spark, mode):
    texels = frame(spark, {1: np.ones((8, 8)), 2: np.ones((3, 1))})
    assert tiles.tiled(texels, E.extents_of(texels), 4, mode).count() == 67


def test_partitions_grow_with_the_rows(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)], SCHEMA)
    assert tiles.by_tile(rows, 9 * tiles.PARTITION_ROWS, ("surface_id",)).rdd.getNumPartitions() == 9


def test_chunks_hold_whole_groups_over_batches(monkeypatch):
    monkeypatch.setattr(tiles, "CHUNK_ROWS", 5)
    keys = np.repeat([3, 4, 6, 7, 9], [2, 9, 1, 1, 6])
    batches = [pa.RecordBatch.from_arrays([pa.array(part)], names=["k"]) for part in np.array_split(keys, 7)]
    got = [(t.column("k").to_pylist(), ids.tolist()) for t, ids in tiles.chunks(batches, ("k",))]
    assert sum((k for k, _ in got), []) == keys.tolist() and len(got) > 1
    assert all(set(a[0]).isdisjoint(b[0]) for a, b in zip(got[:-1], got[1:], strict=True))
    assert all(ids == np.unique(k, return_inverse=True)[1].tolist() for k, ids in got)


def test_small_tiles_of_a_wave_are_diffused_at_once(monkeypatch):
    calls, whole = [], diffusion.leaning
    monkeypatch.setattr(diffusion, "leaning", lambda *a: calls.append(1) or whole(*a))
    v = np.random.default_rng(5).random((50, 4, 4))
    at = np.stack(np.meshgrid(np.arange(50), np.arange(4), np.arange(4), indexing="ij"), -1).reshape(-1, 3).astype(np.int32)
    zero = np.zeros(len(at), np.int32)
    batch = pa.RecordBatch.from_pydict({"surface_id": at[:, 0], "z": zero, "y": at[:, 1], "x": at[:, 2], "r": v.ravel(), "kind": zero, "band": zero, "column": zero, "wave": zero})
    out = list(diffusion._wave(8, 16, ("r",), diffusion.levels(2, None), True)([batch]))
    got = pa.Table.from_batches(out).to_pandas().query("kind == 0").sort_values(["surface_id", "y", "x"])["r"].to_numpy()
    want = diffusion.diffused(v, diffusion.levels(2, None), True)
    assert len(calls) == 1 and np.array_equal(got, want.ravel())
