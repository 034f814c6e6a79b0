"""Queries that write and read folders of image files, and import images of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.functions.packing import packed_rows
from tessera.operators import extents as E
from tessera.operators import textures as X
from tessera.operators.steps import new_path
from tessera.plans.maps import BLOCKS
from tessera.plans.mixed import RAGGED
from tessera.sources import files, folders
from tessera.sources import relations as S
from tessera.sources.png import png, png_pieces

FORMATS = ("png", "tga", "ppm")


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 4 x 4 surface as a file of one of three formats, written to one folder and read by one call."""
    texels, path = T.to_bytes(S.blocks(spark, sf_dir)), new_path(spark, "files")
    extents = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("surface_id"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    for i, fmt in enumerate(FORMATS):
        mine = F.col("surface_id") % len(FORMATS) == i
        folders.write_files(folders.pieces(texels.where(mine), extents.where(mine), fmt), path, fmt, by_task=True)
    name = F.regexp_extract("path", r"(\d+)\.(\w+)$", 1).cast("long")
    rows = folders.read_folder(spark, path)
    return rows.select(name.alias("surface_id"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("format"), "y", "x", *[F.round(c, 6).alias(c) for c in S.CHANNELS])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for surface, content in zip(batch.column("surface_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            v = png(content)
            y, x = np.mgrid[: v.shape[0], : v.shape[1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(y.size, surface)), pa.array(y.ravel()), pa.array(x.ravel()), *[pa.array(np.ascontiguousarray(v[..., i]).ravel()) for i in range(4)]], names=["surface_id", "y", "x", *S.CHANNELS])


def png_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of four extents as PNG files that are deflated in bands of five lines, and read again."""
    t = S.ragged(spark, sf_dir)
    pieces = png_pieces(T.to_bytes(t), E.extents_of(t), band=5)
    parts = F.sort_array(F.collect_list(F.struct("piece", F.hex("data").alias("data"))))
    whole = pieces.groupBy("surface_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["data"]), "")).alias("content"))
    rows = whole.mapInArrow(_read, "surface_id long, y int, x int, r double, g double, b double, a double")
    return rows.select("surface_id", "y", "x", *[F.round(c, 6).alias(c) for c in S.CHANNELS])


def byte_import_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors as the lines of an image of 64 x 64 bytes; what is missing of the last one is zero."""
    e = S.table(spark, sf_dir, "embeddings")
    digits = F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.floor(S.level(v.cast("double")) * 255).cast("long")), 2, "0")), "")
    lines = e.select(F.floor(F.col("vec_id") / 64).alias("image"), F.struct("vec_id", digits.alias("d")).alias("line"))
    images = lines.groupBy("image").agg(F.unhex(F.rpad(F.array_join(F.sort_array(F.collect_list("line"))["d"], ""), 2 * 64 * 64, "0")).alias("data"))
    return S.from_bytes(images, "image", "data", 64, 64, ("r",)).select("surface_id", "y", "x", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))


def volume_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of 4 x 4 x 4 texels with their levels as containers, read again."""
    t = S.volume(spark, sf_dir)
    levels = T.to_bytes(E.mip_chain(t, E.extents_of(t)))
    masks = (0xFF0000, 0xFF00, 0xFF, 0xFF000000)
    word = [(F.col(c).cast("long"), 8) for c in "bgra"]
    # levels of other extents are packed for themselves: a line is as long as its texels
    rows = None
    for mip in range(3):
        part = packed_rows(levels.where(F.col("mip") == mip), word, 0).withColumn("mip", F.lit(mip))
        rows = part if rows is None else rows.unionByName(part)
    extents = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("surface_id"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    made = files.plain_dds(rows, extents, 32, masks, kind="3d", depth=4)
    return files.plain_texels(made).select("surface_id", "mip", "z", "y", "x", F.col("r").cast("int").alias("r"), F.col("a").cast("int").alias("a"))


def texture_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with textures of each part's size and kind, of which some have a level too few, a face too many or
    another extent."""
    p = S.table(spark, sf_dir, "part").where("p_partkey IS NOT NULL")
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("2d", "cube", "3d", "array", "flat")]), (key % 5 + 1).cast("int"))
    textures = p.select(key.alias("surface_id"), kind.alias("kind"), size.alias("width"), F.when(key % 7 == 3, size + 1).otherwise(size).alias("height"), (size % 4 + 1).alias("depth"), (size % 3 + 1).alias("images"), F.when(key % 11 == 5, 9).otherwise(0).alias("mips"))
    parts = X.expected_parts(textures)
    last = (F.col("surface_id") % 13 == 4) & (F.col("mip") == 1)
    wide = F.when((F.col("surface_id") % 17 == 6) & (F.col("mip") == 0), F.col("width") + 2).otherwise(F.col("width"))
    given = parts.where(~last).withColumn("width", wide)
    given = given.unionByName(given.where("surface_id % 19 = 8 AND face = 0 AND mip = 0").withColumn("face", F.lit(7)))
    return X.faults(textures, given)


QUERIES = {"volume_levels": volume_levels, "texture_faults": texture_faults, "files_round_trip": files_round_trip, "png_bands": png_bands, "byte_import_wide": byte_import_wide}
_BYTE = "round(trunc({c} * 255) / 255, 6)"
SQL = {
    "volume_levels": """WITH v AS (SELECT vec_id AS surface_id, (i // 16) AS z, (i % 16 // 4) AS y, (i % 4) AS x, greatest(0.0, least(1.0, embedding[i + 1]::DOUBLE + 0.5)) AS v FROM embeddings, range(64) AS ts(i)),
        l AS (SELECT surface_id, mip, z >> mip AS z, y >> mip AS y, x >> mip AS x, avg(v) AS v FROM v, (VALUES (0), (1), (2)) AS ms(mip) GROUP BY ALL)
        SELECT surface_id, mip, z::INT AS z, y::INT AS y, x::INT AS x, trunc(v * 255)::INT AS r, trunc(v * 255)::INT AS a FROM l""",
    "texture_faults": """WITH t AS (SELECT p_partkey AS id, ['2d', 'cube', '3d', 'array', 'flat'][p_partkey % 5 + 1] AS kind, p_size AS w, p_size + (p_partkey % 7 = 3)::INT AS h, CASE WHEN p_partkey % 5 = 2 THEN p_size % 4 + 1 ELSE 1 END AS d, p_size % 3 + 1 AS images, p_partkey % 11 = 5 AS nine FROM part),
        c AS (SELECT *, floor(log2(greatest(w, h, d)::DOUBLE) + 1e-9)::INT + 1 AS most, CASE kind WHEN 'cube' THEN 6 WHEN 'array' THEN images ELSE 1 END AS faces FROM t),
        o AS (SELECT *, CASE WHEN kind = 'flat' THEN 'unknown kind' WHEN least(w, h, d) < 1 THEN 'extents below one' WHEN kind = 'cube' AND w <> h THEN 'cube isn''t square' WHEN nine AND 9 > most THEN 'too many levels' END AS fault, CASE WHEN nine THEN 9 ELSE most END AS mips FROM c),
        p AS (SELECT id, face::INT AS face, mip::INT AS mip, w FROM (SELECT *, unnest(range(mips)) AS mip FROM (SELECT *, unnest(range(faces)) AS face FROM o WHERE fault IS NULL)))
        SELECT id AS surface_id, NULL::INT AS face, NULL::INT AS mip, fault FROM o WHERE fault IS NOT NULL
        UNION ALL SELECT id, face, mip, 'missing' FROM p WHERE id % 13 = 4 AND mip = 1
        UNION ALL SELECT id, face, mip, 'wrong extents' FROM p WHERE id % 17 = 6 AND mip = 0
        UNION ALL SELECT id, 7, mip, 'unexpected' FROM p WHERE id % 19 = 8 AND face = 0 AND mip = 0""",
    "files_round_trip": f"WITH {BLOCKS} SELECT surface_id, ['png', 'tga', 'ppm'][surface_id % 3 + 1] AS format, y, x, " + ", ".join(f"{_BYTE.format(c=c)} AS {c}" for c in "rgb") + f", CASE WHEN surface_id % 3 = 2 THEN 0.0 ELSE {_BYTE.format(c='a')} END AS a FROM b",
    "png_bands": f"WITH {RAGGED} SELECT id AS surface_id, y, x, " + ", ".join(f"{_BYTE.format(c='v')} AS {c}" for c in "rgba") + " FROM t0",
    "byte_import_wide": "SELECT i.image AS surface_id, y::INT AS y, x::INT AS x, CASE WHEN embedding IS NULL THEN 0.0 ELSE round(floor(greatest(0.0, least(1.0, embedding[x + 1]::DOUBLE + 0.5)) * 255) / 255, 6) END AS r, 0.0::DOUBLE AS a FROM (SELECT DISTINCT vec_id // 64 AS image FROM embeddings) AS i CROSS JOIN range(64) AS ys(y) CROSS JOIN range(64) AS xs(x) LEFT JOIN embeddings AS e ON e.vec_id = i.image * 64 + y",
}
