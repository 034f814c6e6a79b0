"""Textures as relations: what parts a texture of a kind must have, and which of those that are there don't fit.

A texture is (surface_id, kind, width, height, depth, images, mips); its parts are (surface_id, face, mip, width, height,
depth), one for each face, or image of an array, and level. Parts that are given meet those that must be there in one join,
so that a texture is refused by what is wrong with it before anything of it is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("2d", "cube", "3d", "array")
FACES = 6


def whole_chain(textures: DataFrame) -> DataFrame:
    """textures with the number of levels of a full chain where mips is null or 0; depth counts for volumes alone."""
    deep = F.when(F.col("kind") == "3d", F.col("depth")).otherwise(1)
    most = F.floor(F.log2(F.greatest("width", "height", deep).cast("double")) + 1e-9).cast("int") + 1
    return textures.withColumns({"depth": deep.cast("int"), "most": most, "mips": F.when(F.coalesce("mips", F.lit(0)) > 0, F.col("mips")).otherwise(most).cast("int")})


def expected_parts(textures: DataFrame) -> DataFrame:
    """The parts of textures: faces 0..5 of cubes, 0..images-1 of arrays, 0 of others, with all levels; each level halves
    the extents, which stay at least 1."""
    faces = F.when(F.col("kind") == "cube", FACES).when(F.col("kind") == "array", F.greatest("images", F.lit(1))).otherwise(1)
    rows = whole_chain(textures).where(F.col("kind").isin(*KINDS)).withColumn("face", F.explode(F.sequence(F.lit(0), faces.cast("int") - 1)))
    rows = rows.withColumn("mip", F.explode(F.sequence(F.lit(0), F.col("mips") - 1)))
    at = lambda c: F.greatest(F.call_function("shiftright", F.col(c).cast("int"), F.col("mip")), F.lit(1)).alias(c)
    return rows.select("surface_id", "face", "mip", at("width"), at("height"), at("depth"))


def parts_of(texels: DataFrame) -> DataFrame:
    """The parts that texels (surface_id, face, mip, z, y, x) are of."""
    extent = lambda axis, name: (F.max(axis) + 1).cast("int").alias(name)
    return texels.groupBy("surface_id", "face", "mip").agg(extent("x", "width"), extent("y", "height"), extent("z", "depth"))


def faults(textures: DataFrame, parts: DataFrame) -> DataFrame:
    """(surface_id, face, mip, fault) of what is wrong: unknown kind, extents below one, cube isn't square, too many levels
    (of the texture: face and mip are null); missing, unexpected, wrong extents (of a part). Textures without faults have
    no row. Parts of a texture that isn't there are unexpected."""
    known = whole_chain(textures)
    own = F.when(~F.col("kind").isin(*KINDS), "unknown kind").when(F.least("width", "height", "depth") < 1, "extents below one")
    own = own.when((F.col("kind") == "cube") & (F.col("width") != F.col("height")), "cube isn't square").when(F.col("mips") > F.col("most"), "too many levels")
    whole = known.select("surface_id", F.lit(None).cast("int").alias("face"), F.lit(None).cast("int").alias("mip"), own.alias("fault")).where("fault IS NOT NULL")
    sound = textures.join(whole.select("surface_id"), "surface_id", "left_anti")
    given = parts.select("surface_id", "face", "mip", F.struct("width", "height", "depth").alias("given"))
    wanted = expected_parts(sound).select("surface_id", "face", "mip", F.struct("width", "height", "depth").alias("wanted"))
    given = given.join(whole.select("surface_id"), "surface_id", "left_anti")
    both = wanted.join(given, ["surface_id", "face", "mip"], "full_outer")
    fault = F.when(F.col("given").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("given") != F.col("wanted"), "wrong extents")
    return whole.unionByName(both.select("surface_id", "face", "mip", fault.alias("fault")).where("fault IS NOT NULL"))


def sound_texels(textures: DataFrame, texels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texels of textures without faults, and the faults of the others."""
    wrong = faults(textures, parts_of(texels))
    good = textures.select("surface_id").join(wrong.select("surface_id"), "surface_id", "left_anti")
    return texels.join(good, "surface_id", "left_semi"), wrong
