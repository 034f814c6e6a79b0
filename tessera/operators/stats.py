"""Statistics of surfaces and errors between them: grouped aggregates, after an equi-join on the place for pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.sources.relations import CHANNELS, PLACE, clamp

FLT_MAX = 3.4028234663852886e38


def average(texels: DataFrame, channel: str, alpha: str | None = None, gamma: float = 2.2) -> DataFrame:
    """(surface_id, average): the gamma-weighted mean of slice 0, weighted by alpha if given; 0 without weight."""
    value, weight = F.pow(F.greatest(F.col(channel), F.lit(0.0)), F.lit(gamma)), F.col(alpha) if alpha else F.lit(1.0)
    mean = F.try_divide(F.sum(value * weight), F.sum(weight))
    return texels.where("z = 0").groupBy("surface_id").agg(F.coalesce(F.pow(mean, F.lit(1 / gamma)), F.lit(0.0)).alias("average"))


def value_range(texels: DataFrame, channel: str, alpha: str | None = None, alpha_ref: float = 0.0) -> DataFrame:
    """(surface_id, low, high) of the texels that pass the alpha test; (FLT_MAX, -FLT_MAX) if none does."""
    value = F.when(F.col(alpha) > alpha_ref, F.col(channel)) if alpha else F.col(channel)
    return texels.groupBy("surface_id").agg(F.coalesce(F.min(value), F.lit(FLT_MAX)).alias("low"), F.coalesce(F.max(value), F.lit(-FLT_MAX)).alias("high"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) with all bins; the end bins take what lies outside. The scale is bins / high: low only moves it."""
    scale = bins / high
    at = clamp(F.floor(value * scale + -scale * low), 0, bins - 1).cast("int")
    found = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def quads(texels: DataFrame, width: int, height: int, channel: str = "a") -> DataFrame:
    """(surface_id, y, x, v00, v01, v10, v11): the corners of each quad of texels of slice 0."""
    t = texels.where("z = 0").select("surface_id", "y", "x", F.col(channel).alias("v"))
    # each texel goes to the four quads that it is a corner of
    corner = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]))
    at = t.select("surface_id", "y", "x", "v", corner.alias("k")).select("surface_id", (F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), "k", "v")
    at = at.where(F.col("y").between(0, height - 2) & F.col("x").between(0, width - 2))
    pick = lambda dy, dx: F.max(F.when((F.col("k.dy") == dy) & (F.col("k.dx") == dx), F.col("v"))).alias(f"v{dy}{dx}")
    return at.groupBy("surface_id", "y", "x").agg(pick(0, 0), pick(0, 1), pick(1, 0), pick(1, 1))


def quad_coverage(corners: DataFrame, width: int, height: int, reference: float, scale: float = 1.0) -> DataFrame:
    """(surface_id, coverage) of quads()."""
    corners = corners.withColumns({c: clamp(F.col(c) * scale) for c in ("v00", "v01", "v10", "v11")})
    passed = F.lit(0)
    for fy in (0.125, 0.375, 0.625, 0.875):
        for fx in (0.125, 0.375, 0.625, 0.875):
            top = F.col("v00") * (1 - fx) + F.col("v01") * fx
            low = F.col("v10") * (1 - fx) + F.col("v11") * fx
            passed = passed + ((top * (1 - fy) + low * fy) > min(max(reference, 1 / 256), 255 / 256)).cast("int")
    return corners.groupBy("surface_id").agg((F.sum(passed) / 16 / F.lit(float((width - 1) * (height - 1)))).alias("coverage"))


def coverage(texels: DataFrame, width: int, height: int, reference: float, channel: str = "a", scale: float = 1.0) -> DataFrame:
    """(surface_id, coverage): the share of 4 x 4 bilinear samples in each quad of texels of slice 0 that pass. A surface
    of one line or column has no quads and no row."""
    return quad_coverage(quads(texels, width, height, channel), width, height, reference, scale)


def paired(reference: DataFrame, image: DataFrame) -> DataFrame:
    """The texels of both side by side: r, g, b, a and r2, g2, b2, a2."""
    other = image.select(*PLACE, *[F.col(c).alias(f"{c}2") for c in CHANNELS])
    return reference.select(*PLACE, *CHANNELS).join(other, list(PLACE))


def _squared(pairs_weight: Column) -> Column:
    parts = [(F.col(c) - F.col(f"{c}2")) * pairs_weight for c in T.RGB]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def rms_error(pairs: DataFrame, alpha_weight: bool = False) -> DataFrame:
    """(surface_id, rms): over texels, not over channels."""
    weight = F.col("a") if alpha_weight else F.lit(1.0)
    return pairs.groupBy("surface_id").agg(F.sqrt(F.avg(_squared(weight))).alias("rms"))


def rms_alpha_error(pairs: DataFrame) -> DataFrame:
    d = F.col("a") - F.col("a2")
    return pairs.groupBy("surface_id").agg(F.sqrt(F.avg(d * d)).alias("rms"))


def mean_errors(pairs: DataFrame) -> DataFrame:
    """(surface_id, colour, alpha): mean absolute differences, colours summed over the channels."""
    colour = sum((F.abs(F.col(c) - F.col(f"{c}2")) for c in T.RGB), F.lit(0.0))
    return pairs.groupBy("surface_id").agg(F.avg(colour).alias("colour"), F.avg(F.abs(F.col("a") - F.col("a2"))).alias("alpha"))


def lab_error(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """(surface_id, delta_e): the mean distance in CIE Lab."""
    one, two = (T.lab(*[F.col(f"{c}{s}") for c in T.RGB], strict) for s in ("", "2"))
    d = [x - y for x, y in zip(one, two, strict=True)]
    return pairs.groupBy("surface_id").agg(F.avg(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("delta_e"))


def lab94_error(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """(surface_id, delta_e): the mean CIE94 distance. The weights of chroma and hue come from lightness, as in the
    engine whose results are matched; from chroma if strict."""
    one, two = (T.lab(*[F.col(f"{c}{s}") for c in T.RGB], strict) for s in ("", "2"))
    c1, c2 = (F.sqrt(x[1] * x[1] + x[2] * x[2]) for x in (one, two))
    dl, dc, da, db = one[0] - two[0], c1 - c2, one[1] - two[1], one[2] - two[2]
    dh = F.greatest(da * da + db * db - dc * dc, F.lit(0.0))
    by = c1 if strict else one[0]
    sc, sh = by * 0.045 + 1, by * 0.015 + 1
    return pairs.groupBy("surface_id").agg(F.avg(F.sqrt(dl * dl + dc / sc * (dc / sc) + dh / (sh * sh))).alias("delta_e"))


def angular_error(pairs: DataFrame) -> DataFrame:
    """(surface_id, mean, rms): the angle between packed normals, in radians."""
    unit = lambda s: [F.col(f"{c}{s}") * 2 - 1 for c in T.RGB]
    one, two = unit(""), unit("2")
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    angle = F.acos(clamp(F.coalesce(F.try_divide(dot(one, two), F.sqrt(dot(one, one) * dot(two, two))), F.lit(0.0)), -1.0, 1.0))
    return pairs.groupBy("surface_id").agg(F.avg(angle).alias("mean"), F.sqrt(F.avg(angle * angle)).alias("rms"))


def tone_mapped_error(reference: DataFrame, image: DataFrame, exposure: float) -> DataFrame:
    """(surface_id, rms) after exposure, Reinhard and sRGB."""
    shown = lambda t: T.to_srgb(T.tone_reinhard(T.scale_bias(t, 1 / exposure, 0.0, T.RGB)))
    return rms_error(paired(shown(reference), shown(image)))


def psnr(rms: Column) -> Column:
    """Decibels of an error on the scale of 0..1; 999 for none."""
    return F.when(rms == 0, 999.0).otherwise(F.log10(1 / F.when(rms != 0, rms)) * 20)


def block_stats(texels: DataFrame) -> DataFrame:
    """For each 4 x 4 block: bounds, whether it is of one colour and whether it has alpha below one."""
    key = ["surface_id", F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx")]
    bounds = [f(c).alias(f"{n}_{c}") for c in T.RGB for n, f in (("low", F.min), ("high", F.max))]
    single = F.greatest(*[F.max(c) - F.min(c) for c in T.RGB]) == 0
    return texels.groupBy(*key).agg(*bounds, single.alias("single_colour"), (F.min("a") < 1).alias("has_alpha"))


def covariance(texels: DataFrame, weight: str | None = None) -> DataFrame:
    """(surface_id, means, sums of products about them): the input of a principal axis."""
    w = F.col(weight) if weight else F.lit(1.0)
    n = F.sum(w)
    mean = {c: F.coalesce(F.try_divide(F.sum(F.col(c) * w), n), F.lit(0.0)) for c in T.RGB}
    pairs = [(p, q) for i, p in enumerate(T.RGB) for q in T.RGB[i:]]
    second = [(F.sum(F.col(p) * F.col(q) * w) - mean[p] * mean[q] * n).alias(f"{p}{q}") for p, q in pairs]
    return texels.groupBy("surface_id").agg(*[mean[c].alias(f"mean_{c}") for c in T.RGB], *second)


def principal_axis(moments: DataFrame, steps: int = 8) -> DataFrame:
    """moments (from covariance) with axis: the unit direction of most spread, by power iteration from the row of the
    matrix with the largest diagonal; zero without any spread."""
    m = {frozenset((p, q)): F.col(f"{p}{q}") for i, p in enumerate(T.RGB) for q in T.RGB[i:]}
    rows = [F.array(*[m[frozenset((p, q))] for q in T.RGB]) for p in T.RGB]
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    start = F.when((F.col("rr") >= F.col("gg")) & (F.col("rr") >= F.col("bb")), rows[0]).when(F.col("gg") >= F.col("bb"), rows[1]).otherwise(rows[2])

    def step(v, _):
        return unit(F.array(*[dot(r, v) for r in rows]))

    def unit(v):
        most = F.array_max(F.transform(v, F.abs))
        return F.transform(v, lambda x: F.coalesce(F.try_divide(x, most), F.lit(0.0)))

    out = moments.withColumn("_v", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), unit(start), step))
    length = F.sqrt(dot(F.col("_v"), F.col("_v")))
    return out.withColumn("axis", F.transform("_v", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))).drop("_v")


def spreads(moments: DataFrame) -> DataFrame:
    """moments (from covariance) with spread1 >= spread2 >= spread3, the eigenvalues of the matrix in closed form, and
    normal: the unit direction of least spread, (0, 0, 1) where no plane is defined."""
    m = {frozenset((p, q)): F.col(f"{p}{q}") for i, p in enumerate(T.RGB) for q in T.RGB[i:]}
    at = lambda p, q: m[frozenset((p, q))]
    mean = (at("r", "r") + at("g", "g") + at("b", "b")) / 3
    rows = moments.withColumn("_q", mean)
    off = {c: at(c, c) - F.col("_q") for c in T.RGB}
    size = F.sqrt((off["r"] * off["r"] + off["g"] * off["g"] + off["b"] * off["b"] + (at("r", "g") * at("r", "g") + at("r", "b") * at("r", "b") + at("g", "b") * at("g", "b")) * 2) / 6)
    det = off["r"] * (off["g"] * off["b"] - at("g", "b") * at("g", "b")) - at("r", "g") * (at("r", "g") * off["b"] - at("g", "b") * at("r", "b")) + at("r", "b") * (at("r", "g") * at("g", "b") - off["g"] * at("r", "b"))
    rows = rows.withColumn("_p", size)
    turn = F.acos(clamp(F.coalesce(F.try_divide(det, F.col("_p") * F.col("_p") * F.col("_p") * 2), F.lit(1.0)), -1.0, 1.0)) / 3
    rows = rows.withColumn("_t", turn)
    rows = rows.withColumns({"spread1": F.col("_q") + F.col("_p") * 2 * F.cos("_t"), "spread3": F.col("_q") + F.col("_p") * 2 * F.cos(F.col("_t") + 2 * math.pi / 3)})
    rows = rows.withColumn("spread2", F.col("_q") * 3 - F.col("spread1") - F.col("spread3"))
    line = {p: [at(p, q) - (F.col("spread3") if p == q else 0.0) for q in T.RGB] for p in T.RGB}
    cross = lambda a, b: F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    best = F.array_max(F.array(*[F.struct(square(v).alias("n"), v.alias("v")) for v in (cross(line["r"], line["g"]), cross(line["r"], line["b"]), cross(line["g"], line["b"]))]))
    rows = rows.withColumn("_best", best)
    normal = F.when(F.col("_best.n") > 1e-24, F.transform("_best.v", lambda x: x / F.sqrt("_best.n"))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return rows.withColumn("normal", normal).drop("_q", "_p", "_t", "_best")


def planar(moments: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """moments with planar: whether the least spread is below epsilon."""
    return spreads(moments).withColumn("planar", F.col("spread3") < epsilon)


def quantize_ceil(value: Column, bits: int, out: int = 8) -> Column:
    """The least value of ``bits`` bits, replicated to ``out``, that isn't below value."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(2**bits - 1)), lambda i: T.replicate(i, bits, out) / float(2**out - 1))
    return F.coalesce(F.array_min(F.filter(levels, lambda v: v >= value)), F.lit(1.0))


def scale_chroma(texels: DataFrame, bits: int = 5) -> DataFrame:
    """YCoCg texels with Co and Cg divided by the largest of their 4 x 4 block, quantised up, which goes to b. Extents
    are multiples of four."""
    key = ["surface_id", F.floor(F.col("y") / 4).alias("_by"), F.floor(F.col("x") / 4).alias("_bx")]
    most = texels.groupBy(*key).agg(quantize_ceil(F.greatest(F.lit(1 / 255), F.max(F.abs("r")), F.max(F.abs("g"))), bits).alias("_s"))
    rows = texels.select("*", *key[1:]).join(most, ["surface_id", "_by", "_bx"])
    return T.changed(rows, r=F.col("r") / F.col("_s"), g=F.col("g") / F.col("_s"), b=F.col("_s")).select(texels.columns)


