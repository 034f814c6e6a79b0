"""How often files are opened and how they are committed."""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import functions as F

from tessera.plans import files as plans
from tessera.sources import files, folders
from tests.test_large import frame


def test_each_task_commits_one_folder(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("surface_id"), F.lit(0).alias("piece"), F.lit(b"12").alias("data"))
    folders.write_files(rows, str(tmp_path), "bin", by_task=True)
    found = sorted(f for _, _, names in os.walk(tmp_path) for f in names)
    assert found == sorted(f"{i}.bin" for i in range(40))
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".bin")] and not os.listdir(tmp_path / "_temporary")


def test_without_containers_files_are_scanned_once(spark, tmp_path):
    texels = frame(spark, {i: np.full((2, 2), 9.0) for i in range(3)})
    sizes = texels.select("surface_id").distinct().select("surface_id", F.lit(2).alias("width"), F.lit(2).alias("height"))
    folders.write_files(folders.pieces(texels, sizes, "ppm"), str(tmp_path), "ppm", by_task=True)
    rows = folders.read_folder(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("binaryFile") == 1 and rows.count() == 12


def test_words_of_headers_and_of_what_is_none(spark):
    head = files.dds_header(F.lit(70000), F.lit(258), F.lit(3), F.lit(2**31 + 5), files.pixel_format(32, (0xFF000000, 0xFF0000, 0xFF00, 0xFF)))
    made = spark.range(1).select(F.lit(1).alias("surface_id"), head.alias("content"))
    others = spark.createDataFrame([(2, bytearray(b"DDS ")), (3, bytearray(b"DDS \x7c\x00")), (4, bytearray(b"no header" * 40)), (5, None)], "surface_id int, content binary")
    got = {r.surface_id: r for r in files.dds_info(made.union(others)).collect()}
    assert [got[i].valid for i in range(1, 6)] == [True, False, False, False, False]
    assert (got[1].width, got[1].height, got[1].mips, got[1].bits, got[1].r_mask, got[1].a_mask, got[1].payload) == (70000, 258, 3, 32, 0xFF000000, 0xFF, 128)


def test_words_of_headers_are_parsed_at_one_place(spark):
    """Short files, old and new headers, with words of zeros, small and large ones; the same as by struct."""
    rng, made = np.random.default_rng(7), []
    for i in range(200):
        words = rng.integers(0, 2**31, 37) * rng.integers(0, 2, 37)
        words[23:27] *= rng.integers(1, 3)  # masks have 32 bits
        words[1] = 124 if i % 5 else words[1]
        data = bytearray(struct.pack("<37I", 0x20534444, *words[1:].tolist()))
        if i % 3 == 0:
            data[84:88] = b"DX10"
        made.append((i, data[: int(rng.integers(4, 149))] if i % 7 == 0 else data))
    info = files.dds_info(spark.createDataFrame(made, "surface_id int, content binary"))
    names = {"pixel_flags": 80, "bits": 88, "r_mask": 92, "g_mask": 96, "b_mask": 100, "a_mask": 104, "width": 16, "height": 12}
    got = {r.surface_id: r for r in info.select("surface_id", "valid", "dxgi", "faces", "mips", "depth", *names).collect()}
    for i, data in made:
        at = lambda k, data=data: struct.unpack_from("<I", data, k)[0] if len(data) >= k + 4 else None
        assert got[i].valid == (at(4) == 124)
        for name, k in names.items():
            assert got[i][name] == at(k), (i, name)
        if len(data) == 148:
            new, caps = bytes(data[84:88]) == b"DX10", at(112)
            assert got[i].dxgi == (at(128) if new else 0)
            assert got[i].faces == (6 if caps & 0x200 else max(at(140), 1) if new else 1)
            assert got[i].mips == max(at(28), 1) and got[i].depth == (max(at(24), 1) if caps & 0x200000 else 1)
    assert info._jdf.queryExecution().executedPlan().toString().count("conv(") == 1


def test_a_container_of_one_texel_is_brought_together_once(spark, sf_dir):
    """The texels meet by surface for rows and containers at once, and a float is worked out once, not for each byte."""
    plan = plans.dds_floats(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(surface_id") == 1
    assert plan.count("2143289344") == 1  # not a number, of put_float
