"""Surfaces of different extents in one relation.

``extents`` is (surface_id, width, height, depth). Weights of a resampling are keyed by the extents before and after, so
that all surfaces are resampled at once, whatever theirs are; each surface has as many levels as its own extents give, and
decides for itself where to stop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import Filter, box
from tessera.operators.steps import small, stored
from tessera.operators.wraps import wrapped
from tessera.sources.relations import CHANNELS, PLACE, clamp

AXES = {"x": "width", "y": "height", "z": "depth"}
SIDE = 64  # of tiles of quads
WEIGHT_ROWS = 1_000_000  # of weights, or extents, that are broadcast; more are joined by merging


def extents_of(texels: DataFrame) -> DataFrame:
    """The extents of whole surfaces that begin at the origin."""
    return texels.groupBy("surface_id").agg(*[(F.max(axis) + 1).cast("int").alias(name) for axis, name in AXES.items()])


def weights(pairs: DataFrame, shape: Filter, mode: str = "mirror", samples: int = 32) -> DataFrame:
    """(before, after, dst, src, w) for each different (before, after) of pairs: polyphase weights of sum 1 for each dst."""
    width, f = shape
    step = F.col("before") / F.col("after")
    up = F.col("after") > F.col("before")
    scale, n = F.when(up, 1.0).otherwise(F.col("after") / F.col("before")), F.when(up, 1).otherwise(samples)
    reach = step * width
    rows = pairs.select("before", "after").distinct().select("*", F.explode(F.sequence(F.lit(0), F.col("after") - 1)).alias("dst"))
    rows = rows.withColumns({"centre": (F.col("dst") + 0.5) * step, "reach": reach})
    left = F.floor(F.col("centre") - F.col("reach"))
    rows = rows.withColumn("at", F.explode(F.sequence(left, left + F.ceil(F.col("reach") * 2))))
    rows = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    u = (F.col("at") - F.col("centre") + (F.col("k") + 0.5) / F.col("n")) * scale
    rows = rows.groupBy("before", "after", "dst", "at").agg(F.avg(f(u)).alias("w"))
    rows = rows.withColumn("src", wrapped(F.col("at"), F.col("before"), mode).cast("int"))
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("before", "after", "dst")))
    return rows.groupBy("before", "after", "dst", "src").agg(F.sum("w").alias("w")).where("w <> 0")


def halvings(pairs: DataFrame) -> DataFrame:
    """The same of the fast down-sampling to the next mip level: pairs of texels, or three that overlap of odd extents."""
    rows = pairs.select("before").distinct().withColumn("after", F.greatest(F.floor(F.col("before") / 2), F.lit(1)).cast("int"))
    rows = rows.withColumn("dst", F.explode(F.sequence(F.lit(0), F.col("after") - 1)))
    n, half, d = F.col("before"), F.col("after"), F.col("dst")
    odd = F.array(*[F.struct((d * 2 + i).alias("src"), (w / n).alias("w")) for i, w in enumerate((half - d, half, d + 1))])
    even = F.array(*[F.struct((d * 2 + i).alias("src"), F.lit(0.5).alias("w")) for i in (0, 1)])
    whole = F.array(F.struct(F.lit(0).alias("src"), F.lit(1.0).alias("w")))
    taps = F.when(n == 1, whole).when(n % 2 == 0, even).otherwise(odd)
    return rows.select("before", "after", "dst", F.explode(taps).alias("t")).select("before", "after", "dst", "t.src", "t.w")


def _resampled(texels: DataFrame, extents: DataFrame, targets: DataFrame, weigh, reach: float) -> DataFrame:
    """The texels of surfaces that are in targets at the extents there, axis by axis; an axis that keeps its extent isn't
    touched. One aggregate of the surfaces' extents tells which axes change, and bounds the weights by the different
    extents and the filter's reach: they are broadcast below WEIGHT_ROWS."""
    to = targets.select("surface_id", *[F.col(c).alias(f"{c}_to") for c in AXES.values() if c in targets.columns])
    if "depth_to" not in to.columns:
        to = to.join(extents.select("surface_id", F.col("depth").alias("depth_to")), "surface_id")
    sizes = extents.select("surface_id", *AXES.values()).join(to, "surface_id")
    columns = [f"{c}{end}" for c in AXES.values() for end in ("", "_to")]
    moved = {name: F.col(name) != F.col(f"{name}_to") for name in AXES.values()}
    told = [f(F.when(moved[n], x)).alias(f"{n}{i}") for n in AXES.values() for i, (f, x) in enumerate(((F.count_distinct, F.struct(n, f"{n}_to")), (F.max, F.col(n)), (F.max, F.col(f"{n}_to"))))]
    facts = sizes.agg(F.count(F.lit(1)).alias("surfaces"), *told).first()
    joined = lambda df, rows: F.broadcast(df) if rows <= WEIGHT_ROWS else df.hint("merge")
    rows = texels.select(*PLACE, *CHANNELS).join(joined(sizes, facts["surfaces"]), "surface_id")
    for axis, name in AXES.items():
        kinds, before, after = (facts[f"{name}{i}"] for i in range(3))
        if not kinds:
            continue
        pairs = sizes.where(moved[name]).select(F.col(name).alias("before"), F.col(f"{name}_to").alias("after")).distinct()
        taps = joined(weigh(pairs).withColumnsRenamed({"before": name, "after": f"{name}_to"}), kinds * (2 * reach * before + 2 * after))
        there = rows.where(moved[name]).withColumnRenamed(axis, "src").join(taps, [name, f"{name}_to", "src"])
        rest = [c for c in PLACE if c != axis]
        there = there.groupBy(*rest, F.col("dst").alias(axis), *columns).agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in CHANNELS])
        rows = rows.where(~moved[name]).unionByName(there)
    return rows.select(*PLACE, *CHANNELS)


def resized(texels: DataFrame, extents: DataFrame, targets: DataFrame, shape: Filter | None = None, mode: str = "mirror") -> DataFrame:
    """Each surface at its extent in targets (surface_id, width, height, and depth where volumes change theirs)."""
    shape = shape or box()
    return _resampled(texels, extents, targets, lambda pairs: weights(pairs, shape, mode), shape[0])


def halved(extents: DataFrame) -> DataFrame:
    """The extents of the next mip level."""
    return extents.select("surface_id", *[F.greatest(F.floor(F.col(c) / 2), F.lit(1)).cast("int").alias(c) for c in AXES.values()])


def next_mip(texels: DataFrame, extents: DataFrame, shape: Filter | None = None, mode: str = "mirror") -> tuple[DataFrame, DataFrame]:
    """The next level of each surface that has one, and its extents. Without a filter the fast down-sampling is used."""
    more = extents.where("width > 1 OR height > 1 OR depth > 1")
    to = halved(more)
    if shape is not None:
        return resized(texels, more, to, shape, mode), to
    return _resampled(texels, more, to, halvings, 1.0), to


def mip_chain(texels: DataFrame, extents: DataFrame, shape: Filter | None = None, levels: int | None = None) -> DataFrame:
    """texels with a column mip: every surface and all levels of its own, written level by level."""
    extents = stored(extents, "extents")
    top = extents.agg(F.max(F.greatest("width", "height", "depth"))).first()[0] or 1
    out, level = texels.select(F.lit(0).alias("mip"), *PLACE, *CHANNELS), texels
    for mip in range(1, min(levels or 64, top.bit_length())):
        level, extents = next_mip(level, extents, shape)
        level = stored(level, "level")
        out = out.unionByName(level.select(F.lit(mip).alias("mip"), *PLACE, *CHANNELS))
    return out


def bilinear_rms(texels: DataFrame, extents: DataFrame, image: DataFrame, image_extents: DataFrame, legacy: bool = True) -> DataFrame:
    """(surface_id, rms): each texel of slice 0 against the bilinear sample, clamped, of an image of another extent at its
    corner. The legacy form compares alpha with the sample's blue."""
    to = image_extents.select("surface_id", F.col("width").alias("w2"), F.col("height").alias("h2"))
    sizes = small(extents.select("surface_id", "width", "height").join(to, "surface_id"), WEIGHT_ROWS)
    parts = [(c, c) for c in "rgb"] + [("a", "b" if legacy else "a")]
    corners = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    # a quad of the image has its four corners in one row, the last line and column twice, so a texel meets one row
    last = lambda axis, n, spots: F.when(F.col(axis) == F.col(n) - 1, F.array(*spots, F.struct(F.col(axis).alias("at"), F.lit(1).alias("d")))).otherwise(F.array(*spots))
    spots = lambda axis, n: F.filter(last(axis, n, [F.struct((F.col(axis) - d).alias("at"), F.lit(d).alias("d")) for d in (0, 1)]), lambda s: s["at"] >= 0)
    used = sorted({q for _, q in parts})
    other = image.where("z = 0").join(sizes.select("surface_id", "w2", "h2"), "surface_id").withColumn("_v", F.explode(spots("y", "h2"))).withColumn("_u", F.explode(spots("x", "w2")))
    other = other.groupBy("surface_id", F.col("_v.at").alias("y2"), F.col("_u.at").alias("x2")).agg(*[F.sum(F.when((F.col("_v.d") == dy) & (F.col("_u.d") == dx), F.col(q))).alias(f"{q}{dy}{dx}") for q in used for dy, dx in corners])
    at = {axis: F.col(axis) / F.col(n).cast("double") * F.col(n2) for axis, n, n2 in (("x", "width", "w2"), ("y", "height", "h2"))}
    place = [wrapped(F.floor(at[axis]), F.col(n2), "clamp").cast("int").alias(f"{axis}2") for axis, n2 in (("y", "h2"), ("x", "w2"))]
    rows = texels.where("z = 0").join(sizes, "surface_id").select("surface_id", *place, *[(at[axis] - F.floor(at[axis])).alias(f"_{axis}") for axis in "yx"], *CHANNELS)
    weight = lambda dy, dx: (F.col("_y") if dy else 1 - F.col("_y")) * (F.col("_x") if dx else 1 - F.col("_x"))
    sample = lambda q: sum((F.coalesce(f"{q}{dy}{dx}", F.lit(0.0)) * weight(dy, dx) for dy, dx in corners), F.lit(0.0))
    error = sum((F.pow(F.col(p) - sample(q), 2) for p, q in parts), F.lit(0.0))
    return rows.join(other, ["surface_id", "y2", "x2"]).groupBy("surface_id").agg(F.sqrt(F.avg(error)).alias("rms"))


def auto_resized(texels: DataFrame, extents: DataFrame, tolerance: float, shape: Filter | None = None, mode: str = "mirror") -> tuple[DataFrame, DataFrame]:
    """Each surface halved (odd extents up) as long as both sides are at least four after it and the original is within
    the bilinear error of the result; and the extents. A surface that stops isn't looked at again."""
    up = lambda c: F.floor((F.col(c) + 1) / 2).cast("int").alias(c)
    extents = stored(extents.select("surface_id", *AXES.values()), "extents")
    out, kept = texels.select(*PLACE, *CHANNELS), extents
    level, at = out, kept
    while True:
        to = at.select("surface_id", *[up(c) for c in AXES.values()]).where("width >= 4 AND height >= 4")
        to = stored(to, "extents")
        if to.isEmpty():
            return out, kept
        ids = small(to.select("surface_id"), WEIGHT_ROWS)
        level = stored(resized(level, at, to, shape, mode), "level")
        good = bilinear_rms(texels.join(ids, "surface_id", "left_semi"), extents, level, to).where(F.col("rms") < tolerance).select("surface_id")
        good = small(stored(good, "good"), WEIGHT_ROWS)
        level, at = level.join(good, "surface_id", "left_semi"), to.join(good, "surface_id", "left_semi")
        out = out.join(good, "surface_id", "left_anti").unionByName(level)
        kept = kept.join(good, "surface_id", "left_anti").unionByName(at)


def _quads(texels: DataFrame, channel: str) -> DataFrame:
    """The corners of each quad of texels of slice 0 that has all four; those of a surface's tile of SIDE lines and columns
    lie together, so that what is summed up by surface is little before it is exchanged, whatever the number of tasks."""
    tile = lambda p: F.floor(p / SIDE).cast("int")
    tiles = lambda c: F.when((F.col(c) % SIDE == 0) & (F.col(c) > 0), F.array(tile(F.col(c)) - 1, tile(F.col(c)))).otherwise(F.array(tile(F.col(c))))
    t = texels.where("z = 0").select("surface_id", "y", "x", F.col(channel).alias("v"))
    t = t.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x"))).repartition("surface_id", "ty", "tx")
    corner = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]))
    at = t.select("surface_id", "ty", "tx", "y", "x", "v", corner.alias("k"))
    at = at.select("surface_id", "ty", "tx", (F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), "k", "v").where((tile(F.col("y")) == F.col("ty")) & (tile(F.col("x")) == F.col("tx")))
    pick = lambda dy, dx: F.max(F.when((F.col("k.dy") == dy) & (F.col("k.dx") == dx), F.col("v"))).alias(f"v{dy}{dx}")
    rows = at.groupBy("surface_id", "ty", "tx", "y", "x").agg(pick(0, 0), pick(0, 1), pick(1, 0), pick(1, 1), F.count(F.lit(1)).alias("n"))
    return rows.where("n = 4").drop("n", "ty", "tx", "y", "x")


def _passed(rows: DataFrame, reference: float, scale: Column) -> DataFrame:
    """rows of corners with passed: how many of the 4 x 4 samples pass."""
    level, total, steps = min(max(reference, 1 / 256), 255 / 256), F.lit(0), (0.125, 0.375, 0.625, 0.875)
    rows = rows.withColumns({f"_{c}": clamp(F.col(c) * scale) for c in ("v00", "v01", "v10", "v11")})
    rows = rows.withColumns({f"_{name}{i}": F.col(f"_{a}") * (1 - fx) + F.col(f"_{b}") * fx for i, fx in enumerate(steps) for name, a, b in (("top", "v00", "v01"), ("low", "v10", "v11"))})
    for fy in steps:
        for i in range(4):
            total = total + (F.col(f"_top{i}") * (1 - fy) + F.col(f"_low{i}") * fy > level).cast("int")
    return rows.withColumn("passed", total)


def coverage(texels: DataFrame, reference: float, channel: str = "a", scale: float = 1.0) -> DataFrame:
    """(surface_id, coverage) of surfaces of any extents: the share of 4 x 4 bilinear samples in each quad that pass."""
    return _passed(_quads(texels, channel), reference, F.lit(scale)).groupBy("surface_id").agg((F.avg("passed") / 16).alias("coverage"))


def coverage_scales(texels: DataFrame, wanted: float, reference: float, channel: str = "a", steps: int = 10) -> DataFrame:
    """(surface_id, scale, coverage): for each surface the scale of ``channel``, among those of a bisection of [0, 4] that
    begins at 1, whose coverage comes nearest to wanted (the earliest of equals). All surfaces go at once: a step is an
    aggregate of quads and the state of their surfaces."""
    corners = stored(_quads(texels, channel), "quads")
    state = corners.select("surface_id").distinct().select("surface_id", *[F.lit(v).alias(c) for c, v in (("low", 0.0), ("high", 4.0), ("scale", 1.0), ("best", 1.0), ("off", math.inf), ("got", 0.0), ("done", False))])
    kept = ["low", "high", "scale", "best", "off", "got", "done"]
    for _ in range(steps):
        state = stored(state, "bisection")
        rows = _passed(corners.join(small(state, WEIGHT_ROWS), "surface_id"), reference, F.col("scale")).groupBy("surface_id", *kept).agg((F.avg("passed") / 16).alias("now"))
        open_, off = ~F.col("done"), F.abs(F.col("now") - wanted)
        better, below = open_ & (off < F.col("off")), F.col("now") < wanted
        low, high = F.when(below, F.col("scale")).otherwise(F.col("low")), F.when(below, F.col("high")).otherwise(F.col("scale"))
        state = rows.select(
            "surface_id", low.alias("low"), high.alias("high"), ((low + high) / 2).alias("scale"), F.when(better, F.col("scale")).otherwise(F.col("best")).alias("best"),
            F.when(better, off).otherwise(F.col("off")).alias("off"), F.when(better, F.col("now")).otherwise(F.col("got")).alias("got"), (F.col("done") | (F.col("now") == wanted)).alias("done"),
        )
    return stored(state.select("surface_id", F.col("best").alias("scale"), F.col("got").alias("coverage")), "scales")


def scaled_to_coverage(texels: DataFrame, wanted: float, reference: float, channel: str = "a", steps: int = 10, scales: DataFrame | None = None) -> DataFrame:
    """texels with channel scaled for each surface by coverage_scales, or by scales that it gave before; a surface without
    quads stays as it is."""
    scales = coverage_scales(texels, wanted, reference, channel, steps) if scales is None else scales
    scales = scales.select("surface_id", F.col("scale").alias("_scale"))
    rows = texels.join(small(scales, WEIGHT_ROWS), "surface_id", "left")
    return rows.withColumn(channel, F.when(F.col("_scale").isNull(), F.col(channel)).otherwise(clamp(F.col(channel) * F.col("_scale")))).select(texels.columns)
