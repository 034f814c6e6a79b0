"""PNG of all kinds, and folders of files."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import folders
from tessera.sources.png import PASSES, png, png_pieces, unfiltered

SCHEMA = "surface_id int, z int, y int, x int, r int, g int, b int, a int"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(line, up, step, kind):
    """A line of bytes coded with a filter, byte by byte."""
    out = bytearray([kind])
    for i, v in enumerate(line):
        a, b, c = line[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
        p = a + b - c
        nearest = min(((abs(p - x), k, x) for k, x in enumerate((a, b, c))))[2]
        out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
    return bytes(out)


def packed(samples, depth):
    """Bytes of lines of samples (height, width, n)."""
    lines = []
    for line in samples.reshape(len(samples), -1):
        if depth == 16:
            lines.append(line.astype(">u2").tobytes())
        else:
            bits = "".join(f"{int(v):0{depth}b}" for v in line)
            bits += "0" * (-len(bits) % 8)
            lines.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    return lines


def encoded(samples, colour, depth, interlace=False, kinds=(0, 1, 2, 3, 4), extra=b""):
    height, width, n = samples.shape
    body = b""
    for top, left, down, right in PASSES if interlace else ((0, 0, 1, 1),):
        part = samples[top::down, left::right]
        if part.size:
            lines = packed(part, depth)
            above = bytes(len(lines[0]))
            for y, line in enumerate(lines):
                body += filtered(line, above, max(1, n * depth // 8), kinds[y % len(kinds)])
                above = line
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlace))
    data = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", data[:10]) + chunk(b"IDAT", data[10:]) + chunk(b"IEND", b"")


KINDS = [(0, d) for d in (1, 2, 4, 8, 16)] + [(2, 8), (2, 16), (4, 8), (4, 16), (6, 8), (6, 16)]


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize(("colour", "depth"), KINDS)
@pytest.mark.parametrize("size", [(1, 1), (3, 2), (9, 13)])
def test_png_of_all_kinds(colour, depth, interlace, size):
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    v = np.random.default_rng(depth).integers(0, 1 << depth, (*size, n))
    top = (1 << depth) - 1
    got = png(encoded(v, colour, depth, interlace), exact=True)
    want = v / top
    rgb = want[..., :3] if n >= 3 else np.repeat(want[..., :1], 3, 2)
    alpha = want[..., -1:] if n in (2, 4) else np.zeros((*size, 1))
    assert got == pytest.approx(np.concatenate([rgb, alpha], 2))
    if depth == 16:  # cut to the high byte
        assert png(encoded(v, colour, depth, interlace))[..., 0] == pytest.approx((v[..., 0] >> 8) / 255)


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (1, 2, 0), (2, 4, 4, 1)])
def test_png_filters(kinds):
    v = np.random.default_rng(len(kinds)).integers(0, 256, (21, 17, 3))
    assert png(encoded(v, 2, 8, kinds=kinds))[..., :3] == pytest.approx(v / 255)


def test_png_palettes_and_transparent_colours():
    palette = np.arange(12, dtype=np.uint8).reshape(4, 3) * 20
    v = np.random.default_rng(1).integers(0, 4, (5, 6, 1))
    plte = chunk(b"PLTE", palette.tobytes())
    got = png(encoded(v, 3, 2, extra=plte))
    assert got[..., :3] == pytest.approx(palette[v[..., 0]] / 255) and got[..., 3].max() == 0
    got = png(encoded(v, 3, 2, extra=plte + chunk(b"tRNS", bytes([9, 0]))))
    assert got[..., 3] == pytest.approx(np.array([9, 0, 255, 255])[v[..., 0]] / 255)
    got = png(encoded(v, 0, 4, extra=chunk(b"tRNS", struct.pack(">H", 3))))
    assert (got[..., 3] == (v[..., 0] != 3)).all()


def test_large_png_is_quick():
    """Diagonals of 512 x 512 texels: 1,023 steps, not 786,432."""
    import time

    raw = np.random.default_rng(1).integers(0, 256, (512, 1 + 512 * 3), dtype=np.uint8)
    raw[:, 0] = 4
    began = time.time()
    unfiltered(raw, 3)
    assert time.time() - began < 5


def test_broken_png():
    good = encoded(np.ones((3, 3, 1), int), 0, 8)
    for bad in (b"", good[:40], good[:-30], good.replace(b"IDAT", b"IDOT"), b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 3, 7, 0, 0, 0, 0))):
        with pytest.raises(Exception):  # noqa: B017
            png(bad)


def texels(spark, images):
    return spark.createDataFrame([(i, 0, y, x, *map(int, v[y, x])) for i, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])], SCHEMA)


def sizes(spark, images):
    return spark.createDataFrame([(i, v.shape[1], v.shape[0]) for i, v in images.items()], "surface_id int, width int, height int")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(7)
    smooth = np.tile(np.arange(30)[:, None, None] * 5, (1, 20, 4)).astype(np.uint8)
    return {1: rng.integers(0, 256, (9, 5, 4)), 2: smooth, 3: rng.integers(0, 256, (1, 1, 4)), 4: rng.integers(0, 256, (70, 3, 4))}


@pytest.mark.parametrize("band", [1, 7, 64])
def test_png_by_bands(spark, images, band, tmp_path):
    for alpha in (True, False):
        rows = png_pieces(texels(spark, images), sizes(spark, images), alpha, band).orderBy("surface_id", "piece").collect()
        for i, v in images.items():
            data = b"".join(bytes(r.data) for r in rows if r.surface_id == i)
            got = png(data)
            assert got[..., :3] == pytest.approx(v[..., :3] / 255) and (not alpha or got[..., 3] == pytest.approx(v[..., 3] / 255))
            (tmp_path / f"{i}-{alpha}.png").write_bytes(data)
            assert len([r for r in rows if r.surface_id == i]) == 2 + -(-v.shape[0] // band)
    # another reader checks the checksums of chunks and of all bytes
    seen = spark.read.format("image").load(f"file://{tmp_path}").select("image.*").collect()
    assert len(seen) == 8 and {(r.height, r.width) for r in seen} == {v.shape[:2] for v in images.values()}
    for r in seen:
        i = int(os.path.basename(r.origin).split("-")[0])
        got = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
        assert (got[..., 2::-1] == images[i][..., :3]).all()


def read(df):
    out = {}
    for r in df.collect():
        out.setdefault(os.path.basename(r.path), {})[r.y, r.x] = (r.r, r.g, r.b, r.a, r.error)
    return out


def test_a_mixed_folder(spark, images, tmp_path):
    """Three formats written file by file, a container, broken files and others: one call reads all."""
    from tessera.sources import files

    for fmt in ("png", "tga", "ppm"):
        folders.write_files(folders.pieces(texels(spark, images), sizes(spark, images), fmt), str(tmp_path), fmt)
    assert sorted(os.listdir(tmp_path)) == sorted([f"{i}.{fmt}" for i in images for fmt in ("png", "tga", "ppm")] + ["_temporary"]) and not os.listdir(tmp_path / "_temporary")
    t = texels(spark, {1: images[1]}).withColumns({c: F.col(c) / 255 for c in "rgba"})
    (tmp_path / "c.dds").write_bytes(bytes(files.half_dds(t, sizes(spark, {1: images[1]}), 5).first().content))
    (tmp_path / "broken.png").write_bytes((tmp_path / "1.png").read_bytes()[:60])
    (tmp_path / "text.tga").write_bytes(b"no image")
    (tmp_path / "other.dds").write_bytes(b"DDS " + b"\0" * 200)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "renamed.jpg").write_bytes((tmp_path / "1.png").read_bytes())
    got = read(folders.read_folder(spark, f"file://{tmp_path}"))
    for i, v in images.items():
        for fmt in ("png", "tga", "ppm"):
            found = got[f"{i}.{fmt}"]
            assert len(found) == v.shape[0] * v.shape[1]
            for (y, x), r in found.items():
                assert r[:3] == pytest.approx(v[y, x, :3] / 255) and r[3] == pytest.approx(0 if fmt == "ppm" else v[y, x, 3] / 255)
    assert len(got["renamed.jpg"]) == 45 and len(got["c.dds"]) == 45
    assert got["c.dds"][2, 3][:4] == pytest.approx(images[1][2, 3] / 255, abs=1e-3)
    for name in ("broken.png", "text.tga", "other.dds"):
        ((place, r),) = got[name].items()
        assert place == (None, None) and r[0] is None and r[4]
    folders.register(spark)
    raster = read(spark.read.format("tessera_images").option("partitionbytes", 2000).load(str(tmp_path)))
    assert {n: v for n, v in raster.items() if not n.endswith(".dds")} == {n: v for n, v in got.items() if not n.endswith(".dds")}
    assert len(folders._Reader({"path": str(tmp_path), "partitionbytes": 500}).partitions()) > 3


def test_a_lost_task_leaves_nothing(spark, tmp_path):
    """A job that fails after some pieces were written: no file, no folder of it; the next one writes all."""
    (tmp_path / "keep.txt").write_text("x")
    rows = spark.createDataFrame([("a", 0, b"12"), ("a", 1, b"34"), ("b", 0, b"x"), ("b", 0, b"y")], "surface_id string, piece long, data binary")
    with pytest.raises(Exception, match="out of order"):
        folders.write_files(rows, str(tmp_path), "bin")
    assert [n for n in os.listdir(tmp_path) if n != "_temporary"] == ["keep.txt"] and not os.listdir(tmp_path / "_temporary")
    writer = folders._Writer({"path": str(tmp_path)})
    lost = writer.write(iter([{"name": "a.bin", "piece": 0, "data": b"half"}]))  # an attempt whose message never comes
    again = writer.write(iter([{"name": "a.bin", "piece": 0, "data": b"12"}, {"name": "a.bin", "piece": 5, "data": b"34"}]))
    assert lost.names != again.names
    writer.commit([again, None])
    assert (tmp_path / "a.bin").read_bytes() == b"1234" and not os.listdir(tmp_path / "_temporary")
    folders.write_files(rows.where("surface_id = 'a'"), str(tmp_path), "out")
    assert (tmp_path / "a.out").read_bytes() == b"1234"


def runs(texels):
    """Texels (bytes) coded by packets, runs of equal ones and others."""
    out, i = b"", 0
    while i < len(texels):
        n = 1
        while i + n < len(texels) and n < 128 and texels[i + n] == texels[i]:
            n += 1
        if n > 1:
            out += bytes([127 + n]) + texels[i]
        else:
            while i + n < len(texels) and n < 128 and texels[i + n] != texels[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + b"".join(texels[i : i + n])
        i += n
    return out


@pytest.mark.parametrize("coded", [False, True])
@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize(("kind", "bits"), [(1, 8), (2, 16), (2, 24), (2, 32), (3, 8)])
def test_tga_of_all_kinds(kind, bits, upper, coded):
    from tessera.sources.files import tga

    rng = np.random.default_rng(bits)
    n, height, width = bits // 8, 7, 300
    v = rng.integers(0, 3, (height, width, n), dtype=np.uint8) * 37
    palette = rng.integers(0, 256, (200, 3), dtype=np.uint8)
    stored = v if upper else v[::-1]
    texels = [bytes(t) for line in stored for t in line]
    head = struct.pack("<BBBHHBHHHHBB", 3, int(kind == 1), kind + 8 * coded, 0, 200 if kind == 1 else 0, 24 if kind == 1 else 0, 0, 0, width, height, bits, 0x20 if upper else 0)
    data = head + b"abc" + (palette.tobytes() if kind == 1 else b"") + (runs(texels) if coded else b"".join(texels))
    got = tga(data)
    if kind == 3:
        want = np.repeat(v, 4, 2) / 255
    elif kind == 1:
        want = np.concatenate([palette[v[..., 0]][..., ::-1] / 255, np.zeros((height, width, 1))], 2)
    elif bits == 16:
        word = v[..., 0].astype(int) + v[..., 1].astype(int) * 256
        want = np.stack([((word >> s & 31) * 8 + (word >> s & 31) // 4) / 255 for s in (10, 5, 0)] + [np.zeros((height, width))], 2)
    else:
        want = np.concatenate([v[..., 2::-1] / 255, v[..., 3:] / 255 if bits == 32 else np.zeros((height, width, 1))], 2)
    assert got == pytest.approx(want)
    if coded:
        with pytest.raises(Exception):  # noqa: B017
            tga(data[:-1])
    with pytest.raises(ValueError):
        tga(head[:16] + bytes([15]) + head[17:] + b"\0" * 9999)
