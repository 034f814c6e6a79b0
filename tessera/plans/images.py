"""Queries of the operators on whole surfaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.operators import filters as W
from tessera.operators import sampling as N
from tessera.operators import space as P
from tessera.operators import stats as A
from tessera.plans.maps import BLOCKS, HDR, SIGNED, UNIT, rounded, sql
from tessera.sources import relations as S

ATLAS = f"""{BLOCKS}, t AS (SELECT 0 AS surface_id, ((surface_id // 20) * 4 + y)::INT AS y, ((surface_id % 20) * 4 + x)::INT AS x, r, g, b, a FROM b),
  h AS (SELECT 80 AS w, (max(y) + 1)::INT AS h FROM t)"""
GRAY = """k AS (SELECT vec_id AS surface_id, (t // 8)::INT AS y, (t % 8)::INT AS x, greatest(0.0, least(1.0, embedding[t + 1]::DOUBLE + 0.5)) AS v
  FROM embeddings, range(64) AS ts(t))"""
QUANTIZED = "q AS (SELECT surface_id, y, x, floor(r * 31 + 0.5) / 31 AS r2, floor(g * 63 + 0.5) / 63 AS g2, floor(b * 31 + 0.5) / 31 AS b2, a AS a2 FROM b)"
PAIRS = f"{BLOCKS}, {QUANTIZED}, p AS (SELECT * FROM b JOIN q USING (surface_id, y, x))"


def size_of(texels: DataFrame, width: int = 80) -> tuple[int, int]:
    """The extents of the atlas: its height is one small aggregate."""
    top = texels.agg(F.max("y")).first()[0]
    return width, (top + 1 if top is not None else 1)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def _pairs(spark, sf_dir):
    b = S.blocks(spark, sf_dir)
    return A.paired(b, T.quantize_sizes(b))


def average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.average(S.blocks(spark, sf_dir), "r", "a"), "average")


def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.value_range(S.blocks(spark, sf_dir), "r", "a", 0.6), "low", "high")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(S.hdr(spark, sf_dir), F.col("r"), 0.0, 2.0, 64)


def quantity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any column is a channel without places."""
    return A.histogram(S.table(spark, sf_dir, "lineitem"), F.col("l_quantity"), 0.0, 50.0, 32)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.coverage(S.gray(spark, sf_dir), 8, 8, 0.5), "coverage")


def rms_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.rms_error(_pairs(spark, sf_dir)).withColumn("psnr", A.psnr(F.col("rms"))), "rms", "psnr")


def rms_alpha_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.rms_error(_pairs(spark, sf_dir), True), "rms")


def rms_alpha_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir)
    return _round(A.rms_alpha_error(A.paired(b, T.quantize(b, 3, True, ("a",)))), "rms")


def mean_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.mean_errors(_pairs(spark, sf_dir)), "colour", "alpha")


def lab_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.lab_error(_pairs(spark, sf_dir)), "delta_e")


def lab94_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.lab94_error(_pairs(spark, sf_dir)), "delta_e")


def angular_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.angular_error(_pairs(spark, sf_dir)), "mean", "rms")


def tone_mapped_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.hdr(spark, sf_dir)
    return _round(A.tone_mapped_error(t, T.from_rgbe(T.to_rgbe(t)), 2.0), "rms")


def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.block_stats(S.atlas(spark, sf_dir)), *[f"{n}_{c}" for n in ("low", "high") for c in T.RGB])


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.covariance(S.blocks(spark, sf_dir), "a")
    return _round(out, *[c for c in out.columns if c != "surface_id"])


def principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of most spread of each surface's colours, and how much of the spread lies along it."""
    out = A.principal_axis(A.covariance(S.blocks(spark, sf_dir)))
    axis = {c: F.element_at("axis", i + 1) for i, c in enumerate(T.RGB)}
    m = {p + q: F.col(p + q) if p <= q or p + q in out.columns else F.col(q + p) for p in T.RGB for q in T.RGB if p + q in out.columns}
    along = sum((v * axis[k[0]] * axis[k[1]] * (1 if k[0] == k[1] else 2) for k, v in m.items()), F.lit(0.0))
    share = F.coalesce(F.try_divide(along, F.col("rr") + F.col("gg") + F.col("bb")), F.lit(0.0))
    return out.select("surface_id", *[F.round(a, 6).alias(f"axis_{c}") for c, a in axis.items()], F.round(share, 6).alias("share"))


def normals_quartic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normals of the upper half, where a ray meets the quartic surface once; the others as they are."""
    n = T.normalize(T.scale_bias(S.blocks(spark, sf_dir), 2.0, -1.0, T.RGB))
    flat = T.transform_normals(n, "quartic").withColumnsRenamed({c: f"_{c}" for c in T.RGB}).drop("a")
    rows = n.join(flat, list(S.PLACE))
    return rounded(T.changed(rows, **{c: F.when(F.col("b") > 0.1, F.col(f"_{c}")).otherwise(F.col(c)) for c in T.RGB}))


def block_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.scale_chroma(T.to_ycocg(S.atlas(spark, sf_dir))))


def flip_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.flip(S.atlas(spark, sf_dir), "x", 80))


def flip_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.flip(S.blocks(spark, sf_dir), "y", 4))


def border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.border(S.gray(spark, sf_dir), 8, 8, (1, 0, 0, 1)))


def atlas_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.atlas_border(S.atlas(spark, sf_dir), 8, 4, (0, 1, 0, 1)))


def sub_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.sub_image(S.gray(spark, sf_dir), 2, 6, 1, 4))


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("surface_id"), F.lit(6).alias("width"), F.lit(10).alias("height"), F.lit(1).alias("depth"))
    return rounded(P.canvas(S.gray(spark, sf_dir), S.grid(ids)))


def planar_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector's quarters as the planes of a 4 x 4 surface."""
    e = S.table(spark, sf_dir, "embeddings").select("vec_id", *[F.slice("embedding", 1 + 16 * i, 16).alias(c) for i, c in enumerate(S.CHANNELS)])
    return rounded(S.planar(e, "vec_id", {c: c for c in S.CHANNELS}, 4))


def copy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir)
    return rounded(P.copy_channel(b, P.flip(b, "x", 4), "g", "a"))


def add_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir)
    return rounded(P.add_channel(b, P.flip(b, "x", 4), "r", "b", 0.5))


def copy_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.gray(spark, sf_dir)
    return rounded(P.copy_box(k, T.fill(k, (0.25, 0.5, 0.75, 1.0)), (1, 2), (4, 3), (3, 4)))


def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir)
    return rounded(P.difference(b, T.quantize_sizes(b), 4.0, True))


def warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.gray(spark, sf_dir)
    return rounded(P.warped(k, k, lambda x, y: (x * 0.5 + 1.25, y * 0.75 + 0.5), 8, 8))


def down_sample_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.fast_down_sample(S.gray(spark, sf_dir), (8, 8)))


def down_sample_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.fast_down_sample(P.sub_image(S.gray(spark, sf_dir), 0, 6, 0, 4), (7, 5)))


def resize_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.resize(S.gray(spark, sf_dir), (8, 8), (3, 5), W.box()))


def resize_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.resize(S.gray(spark, sf_dir), (8, 8), (5, 12), W.triangle(), "clamp"))


def resize_mitchell(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.atlas(spark, sf_dir)
    w, h = size_of(t)
    return rounded(W.resize(t, (w, h), (w // 2, h // 2), W.mitchell(), "repeat"))


def resize_kaiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.resize(S.gray(spark, sf_dir), (8, 8), (4, 4), W.kaiser()))


def mip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.mip_chain(S.gray(spark, sf_dir), (8, 8))
    return out.select("surface_id", "mip", "y", "x", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))


def mip_chain_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.mip_chain(S.gray(spark, sf_dir), (8, 8), W.triangle(), 3)
    return out.select("surface_id", "mip", "y", "x", F.round("r", 6).alias("r"))


def convolve_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.convolve(S.gray(spark, sf_dir), W.kernel("laplacian"), (8, 8), "r"))


def convolve_sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.atlas(spark, sf_dir)
    return rounded(W.convolve(t, W.normalized(W.kernel("sobel3")), size_of(t), "g", "repeat"))


def normal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.to_normal_map(S.gray(spark, sf_dir), (8, 8)))


def _points(spark, sf_dir):
    """Five places of each surface, inside and outside of it."""
    ids = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("surface_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("id"))
    return ids.select("surface_id", "id", (F.col("id") * 0.4375 - 0.53125).alias("u"), (F.col("id") * 0.28125 - 0.171875).alias("v"))


def _sampled(of, mode):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = of(_points(spark, sf_dir), S.gray(spark, sf_dir), 8, 8, mode)
        return out.select("surface_id", "id", F.round("r", 6).alias("value"))

    return run


def bilinear_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surface against its next mip level."""
    k = S.gray(spark, sf_dir)
    return _round(N.bilinear_rms(k, (8, 8), W.fast_down_sample(k, (8, 8)), (4, 4)), "rms")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atlas to linear light, one mip level down and back to gamma: its error against 5-6-5 levels."""
    t = S.atlas(spark, sf_dir)
    level = T.to_gamma(W.fast_down_sample(T.to_linear(t), (80, 4)))
    out = A.rms_error(A.paired(level, T.quantize_sizes(level)))
    return _round(out.withColumn("psnr", A.psnr(F.col("rms"))), "rms", "psnr")


def coverage_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha of the atlas scaled so that half of it passes a test at 0.6."""
    t = S.atlas(spark, sf_dir)
    out, scale = W.scale_to_coverage(t, size_of(t), 0.5, 0.6)
    return out.groupBy("surface_id").agg(F.round(F.avg("a"), 6).alias("mean_alpha"), F.round(F.lit(scale), 6).alias("scale"))


def resized_with(shape: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(W.resize(S.gray(spark, sf_dir), (8, 8), (5, 3), getattr(W, shape)()))

    return run


def resize_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.resize(S.volume(spark, sf_dir), (4, 4, 4), (2, 3, 6), W.triangle(), "repeat")
    return out.select("surface_id", "z", "y", "x", F.round("r", 6).alias("value"))


def flip_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flip(S.volume(spark, sf_dir), "z", 4).select("surface_id", "z", "y", "x", F.round("r", 6).alias("value"))


def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surface's first line under a triangle that is three times as wide."""
    w = W.kernel1(spark, W.triangle(), 3)
    k = S.gray(spark, sf_dir).where("y = 0")
    return k.join(F.broadcast(w), F.col("x") == F.col("i")).groupBy("surface_id").agg(F.round(F.sum(F.col("r") * F.col("w")), 6).alias("value"))


def solid_mip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.solid_mip(S.blocks(spark, sf_dir), (0.25, 0.5, 0.75, 1.0)))


def normal_map_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.bytes_to_normal_map(T.to_bytes(S.atlas(spark, sf_dir)), size_of(S.atlas(spark, sf_dir)), (0.25, 0.5, 0.25, 0.0), 3, "clamp"))


def convolve_prewitt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.convolve(S.gray(spark, sf_dir), W.normalized(W.kernel("prewitt5")), (8, 8), "r", "clamp"))


def best_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least spread of each surface's colours, and the size of the normal's parts."""
    out = A.planar(A.covariance(S.blocks(spark, sf_dir)), 0.05)
    return out.select("surface_id", F.round("spread1", 6).alias("most"), F.round("spread2", 6).alias("middle"), F.round("spread3", 6).alias("least"), "planar", *[F.round(F.abs(F.col("normal")[i]), 5).alias(c) for i, c in enumerate("xyz")])


def byte_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 bytes of each document's digest and its repetition as a 4 x 4 surface, blue first."""
    d = S.table(spark, sf_dir, "documents")
    digest = F.unhex(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    return rounded(S.from_bytes(d.select("doc_id", F.concat(digest, digest).alias("data")), "doc_id", "data", 4, 4))


def half_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four halves of each event's number."""
    e = S.table(spark, sf_dir, "events")
    bits = F.array(*[F.pmod(F.col("event_id") * m + a, F.lit(0x7C00)).cast("int") for m, a in ((1, 0), (37, 11), (101, 5), (997, 1))])
    out = S.from_halves(e.select("event_id", bits.alias("data")), "event_id", "data", 1, 1)
    return out.select("surface_id", *[F.round(c, 6).alias(c) for c in S.CHANNELS])


def _volume_points(spark, sf_dir):
    ids = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("surface_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("id"))
    return ids.select("surface_id", "id", (F.col("id") * 0.4375 - 0.53125).alias("u"), (F.col("id") * 0.28125 - 0.171875).alias("v"), (F.col("id") * 0.34375 - 0.28125).alias("w"))


def _volume_sampled(of, mode):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = of(_volume_points(spark, sf_dir), S.volume(spark, sf_dir), 4, 4, mode, depth=4)
        return out.select("surface_id", "id", F.round("r", 6).alias("value"))

    return run


VOLUME = """v AS (SELECT vec_id AS surface_id, (t // 16)::INT AS z, (t // 4 % 4)::INT AS y, (t % 4)::INT AS x, greatest(0.0, least(1.0, embedding[t + 1]::DOUBLE + 0.5)) AS v
  FROM embeddings, range(64) AS ts(t))"""


def _volume_sql(linear: bool, mode: str) -> str:
    wrap = {"clamp": "greatest(0, least(3, {i}))", "repeat": "(({i}) % 4 + 4) % 4", "mirror": "CASE WHEN (({i}) % 6 + 6) % 6 < 4 THEN (({i}) % 6 + 6) % 6 ELSE 6 - (({i}) % 6 + 6) % 6 END"}[mode]
    points = "p AS (SELECT vec_id AS surface_id, i::INT AS id, (i * 0.4375::DOUBLE - 0.53125) * 4 AS fx, (i * 0.28125::DOUBLE - 0.171875) * 4 AS fy, (i * 0.34375::DOUBLE - 0.28125) * 4 AS fz FROM embeddings, range(5) AS xs(i))"
    on = " AND ".join(f"v.{axis} = {wrap.format(i='i' + axis)}" for axis in "xyz")
    if not linear:
        near = ", ".join(f"floor(f{axis} + 0.5)::INT AS i{axis}" for axis in "xyz")
        return f"WITH {VOLUME}, {points}, q AS (SELECT surface_id, id, {near} FROM p) SELECT q.surface_id, id, round(v.v, 6) AS value FROM q JOIN v ON v.surface_id = q.surface_id AND {on}"
    start = "floor({} + 0.5)::INT" if mode == "mirror" else "floor({})::INT"
    near = ", ".join(f"{start.format('f' + axis)} + d{axis} AS i{axis}" for axis in "xyz")
    weight = " * ".join(f"(CASE d{axis} WHEN 1 THEN f{axis} - floor(f{axis}) ELSE 1 - f{axis} + floor(f{axis}) END)" for axis in "xyz")
    return f"""WITH {VOLUME}, {points}, q AS (SELECT surface_id, id, {near}, {weight} AS w FROM p, (VALUES (0), (1)) AS xs(dx), (VALUES (0), (1)) AS ys(dy), (VALUES (0), (1)) AS zs(dz))
        SELECT q.surface_id, id, round(sum(v.v * w), 6) AS value FROM q JOIN v ON v.surface_id = q.surface_id AND {on} GROUP BY 1, 2"""


def _axis_sql(steps: int = 8) -> str:
    """Power iteration, one step a view."""
    unit = lambda x, y, z, source: f"SELECT surface_id, rr, rg, rb, gg, gb, bb, x / m AS x, y / m AS y, z / m AS z FROM (SELECT *, greatest(abs(x), abs(y), abs(z)) AS m FROM (SELECT surface_id, rr, rg, rb, gg, gb, bb, {x} AS x, {y} AS y, {z} AS z FROM {source}))"
    pick = lambda a, b, c: f"CASE WHEN rr >= gg AND rr >= bb THEN {a} WHEN gg >= bb THEN {b} ELSE {c} END"
    views = [f"v0 AS ({unit(pick('rr', 'rg', 'rb'), pick('rg', 'gg', 'gb'), pick('rb', 'gb', 'bb'), 'c')})"]
    views += [f"v{i + 1} AS ({unit('rr * x + rg * y + rb * z', 'rg * x + gg * y + gb * z', 'rb * x + gb * y + bb * z', f'v{i}')})" for i in range(steps)]
    return ", ".join(views)


def _newton_sql(steps: int = 12) -> str:
    """Steps to the root of (1 - x x t t)(1 - y y t t) - z t along the normal's ray, one a view."""
    value, slope = "((1 - r * r * t * t) * (1 - g * g * t * t) - b * t)", "(-2 * r * r * t * (1 - g * g * t * t) - 2 * g * g * t * (1 - r * r * t * t) - b)"
    return ", ".join(f"t{i + 1} AS (SELECT * REPLACE (t - {value} / {slope} AS t) FROM t{i})" for i in range(steps))


COVARIANCE = "m AS (SELECT surface_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM b GROUP BY 1), c AS (SELECT surface_id, " + ", ".join(f"sum(({p} - m{p}) * ({q} - m{q})) AS {p}{q}" for p, q in ("rr", "rg", "rb", "gg", "gb", "bb")) + " FROM b JOIN m USING (surface_id) GROUP BY 1)"
PLANE = f"""WITH {BLOCKS}, {COVARIANCE}, q AS (SELECT *, (rr + gg + bb) / 3 AS q FROM c),
  p AS (SELECT *, sqrt(((rr - q) ** 2 + (gg - q) ** 2 + (bb - q) ** 2 + 2 * (rg * rg + rb * rb + gb * gb)) / 6) AS p FROM q),
  t AS (SELECT *, acos(greatest(-1.0, least(1.0, ((rr - q) * ((gg - q) * (bb - q) - gb * gb) - rg * (rg * (bb - q) - gb * rb) + rb * (rg * gb - (gg - q) * rb)) / (2 * p ** 3)))) / 3 AS t FROM p),
  e AS (SELECT *, q + 2 * p * cos(t) AS e1, q + 2 * p * cos(t + 2 * pi() / 3) AS e3 FROM t),
  k AS (SELECT *, unnest([[rg * gb - rb * (gg - e3), rb * rg - (rr - e3) * gb, (rr - e3) * (gg - e3) - rg * rg], [rg * (bb - e3) - rb * gb, rb * rb - (rr - e3) * (bb - e3), (rr - e3) * gb - rg * rb],
        [(gg - e3) * (bb - e3) - gb * gb, gb * rb - rg * (bb - e3), rg * gb - (gg - e3) * rb]]) AS n FROM e),
  o AS (SELECT * FROM (SELECT *, sqrt(n[1] ** 2 + n[2] ** 2 + n[3] ** 2) AS l FROM k) QUALIFY row_number() OVER (PARTITION BY surface_id ORDER BY l DESC) = 1)
  SELECT surface_id, round(e1, 6) AS most, round(3 * q - e1 - e3, 6) AS middle, round(e3, 6) AS least, e3 < 0.05 AS planar, round(abs(n[1] / l), 5) AS x, round(abs(n[2] / l), 5) AS y, round(abs(n[3] / l), 5) AS z FROM o"""
SHAPES = {  # the filters' formulas in u, and how far they reach
    "quadratic": ("CASE WHEN abs(u) < 0.5 THEN 0.75 - u * u WHEN abs(u) < 1.5 THEN 0.5 * (abs(u) - 1.5) ** 2 ELSE 0.0 END", 1.5),
    "cubic": ("CASE WHEN abs(u) < 1 THEN (2 * abs(u) - 3) * u * u + 1 ELSE 0.0 END", 1),
    "bspline": ("CASE WHEN abs(u) < 1 THEN (4 + u * u * (3 * abs(u) - 6)) / 6 WHEN abs(u) < 2 THEN (2 - abs(u)) ** 3 / 6 ELSE 0.0 END", 2),
    "lanczos": ("CASE WHEN abs(u) < 1e-9 THEN 1.0 WHEN abs(u) < 3 THEN sin(pi() * u) / (pi() * u) * sin(pi() * u / 3) / (pi() * u / 3) ELSE 0.0 END", 3),
    "sinc": ("CASE WHEN abs(u) < 1e-9 THEN 1.0 ELSE sin(pi() * u) / (pi() * u) END", 3),
    "gaussian": ("exp(-u * u / 2) / sqrt(2 * pi())", 3),
}


def _resized(source: str, sw: int, sh: int, wx: str, wy: str) -> str:
    return f"""SELECT surface_id, wy.dst AS y, wx.dst AS x, round(sum(v * wx.w * wy.w), 6) AS r, round(sum(v * wx.w * wy.w), 6) AS g, round(sum(v * wx.w * wy.w), 6) AS b,
        round(sum(v * wx.w * wy.w), 6) AS a FROM {source} JOIN {wx} wx ON wx.src = x JOIN {wy} wy ON wy.src = y GROUP BY 1, 2, 3"""


def weights(name: str, f: str, reach: float, src: int | str, dst: int | str, mode: str) -> str:
    """CTEs with the polyphase weights of f (an expression of u)."""
    up = isinstance(src, int) and dst > src
    scale, n = ("1.0", 1) if up else (f"({dst}::DOUBLE / {src})", 32)
    step = f"({src}::DOUBLE / {dst})"
    wrap = {"clamp": f"greatest(0, least({src} - 1, i))", "repeat": f"((i % {src}) + {src}) % {src}", "mirror": f"CASE WHEN ((i % (2 * {src} - 2)) + 2 * {src} - 2) % (2 * {src} - 2) < {src} THEN ((i % (2 * {src} - 2)) + 2 * {src} - 2) % (2 * {src} - 2) ELSE 2 * {src} - 2 - ((i % (2 * {src} - 2)) + 2 * {src} - 2) % (2 * {src} - 2) END"}[mode]
    return f"""{name}1 AS (SELECT k, (k + 0.5) * {step} AS c, floor((k + 0.5) * {step} - {reach} * {step})::INT + j AS i
          FROM range({dst}) AS ks(k), range(ceil(2 * {reach} * {step})::INT + 1) AS js(j)),
        {name}2 AS (SELECT k, i, avg({f}) AS w FROM (SELECT k, i, (i - c + (s + 0.5) / {n}) * {scale} AS u FROM {name}1, range({n}) AS ss(s)) GROUP BY k, i),
        {name} AS (SELECT k::INT AS dst, ({wrap})::INT AS src, sum(w) / any_value(total) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY k) AS total FROM {name2(name)}) GROUP BY 1, 2)"""


def name2(name: str) -> str:
    return f"{name}2"


BOX = "CASE WHEN abs(u) <= 0.5 THEN 1.0 ELSE 0.0 END"
TRIANGLE = "greatest(1 - abs(u), 0.0)"
MITCHELL = """CASE WHEN abs(u) < 1 THEN (7 * abs(u) ** 3 - 12 * u * u + 16.0 / 3) / 6 WHEN abs(u) < 2 THEN (-7.0 / 3 * abs(u) ** 3 + 12 * u * u - 20 * abs(u) + 32.0 / 3) / 6 ELSE 0 END"""
_BESSEL = lambda x: "(" + " + ".join(f"pow({x} / 2, {2 * k}) / {__import__('math').factorial(k) ** 2}.0::DOUBLE" for k in range(20)) + ")"
KAISER = f"""CASE WHEN abs(u) <= 3 THEN CASE WHEN abs(u) < 1e-9 THEN 1.0 ELSE sin(pi() * u) / (pi() * u) END * {_BESSEL('(4 * sqrt(greatest(0.0, 1 - u * u / 9)))')} / {_BESSEL('4.0::DOUBLE')} ELSE 0 END"""


def _kernel_sql(rows: list[list[float]]) -> str:
    n = len(rows)
    return "k9(dy, dx, w) AS (VALUES " + ", ".join(f"({r - n // 2}, {c - n // 2}, {rows[r][c]!r}::DOUBLE)" for r in range(n) for c in range(n)) + ")"


def _mirror(i: str, n: int) -> str:
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN {2 * n - 2} - ({i}) ELSE {i} END"


def _sobel_sql(n: int) -> list[list[float]]:
    h = (n - 1) // 2
    return [[0.0 if c == h else (1 if c > h else -1) * float((h + 1 - abs(c - h)) + (h - abs(r - h))) for c in range(n)] for r in range(n)]


def _blend_sql() -> list[list[float]]:
    total = [[sum(w * _sobel_sql(n)[r - (9 - n) // 2][c - (9 - n) // 2] for w, n in ((1, 3), (0.5, 5), (0.25, 7), (0.125, 9)) if 0 <= r - (9 - n) // 2 < n and 0 <= c - (9 - n) // 2 < n) for c in range(9)] for r in range(9)]
    size = sum(abs(v) for row in total for v in row)
    return [[v / size for v in row] for row in total]


GRAY_OUT = "round(v, 6) AS r, round(v, 6) AS g, round(v, 6) AS b, round(v, 6) AS a"
SAMPLES = " + ".join(f"((v00 * {(1 - x) * (1 - y)} + v01 * {x * (1 - y)} + v10 * {(1 - x) * y} + v11 * {x * y}) > 0.5)::INT" for y in (0.125, 0.375, 0.625, 0.875) for x in (0.125, 0.375, 0.625, 0.875))
PASSED = SAMPLES.replace("> 0.5)", "> 0.6)")
LAB = """lab AS (SELECT surface_id, y, x, n, 116 * fx - 16 AS l, 500 * (fx - fy) AS aa, 200 * (fy - fz) AS bb FROM (
  SELECT *, CASE WHEN tx > 216 / 24389.0::DOUBLE THEN cbrt(tx) ELSE tx * 841 / 108 + 4 / 29.0::DOUBLE END AS fx,
  CASE WHEN ty > 216 / 24389.0::DOUBLE THEN cbrt(ty) ELSE ty * 841 / 108 + 4 / 29.0::DOUBLE END AS fy, CASE WHEN tz > 216 / 24389.0::DOUBLE THEN cbrt(tz) ELSE tz * 841 / 108 + 4 / 29.0::DOUBLE END AS fz FROM (
    SELECT surface_id, y, x, n, (0.412453 * pow(r, 2.2) + 0.357580 * pow(g, 2.2) + 0.180423 * pow(b, 2.2)) / 0.950456 AS tx,
    0.212671 * pow(r, 2.2) + 0.715160 * pow(g, 2.2) + 0.072169 * pow(b, 2.2) AS ty, (0.019334 * pow(r, 2.2) + 0.119193 * pow(g, 2.2) + 0.950227 * pow(b, 2.2)) / 1.088754 AS tz
    FROM (SELECT surface_id, y, x, 1 AS n, r, g, b FROM b UNION ALL SELECT surface_id, y, x, 2, r2, g2, b2 FROM q)))),
  two AS (SELECT o.surface_id, o.l AS l1, o.aa AS a1, o.bb AS b1, p.l AS l2, p.aa AS a2, p.bb AS b2 FROM lab o JOIN lab p USING (surface_id, y, x) WHERE o.n = 1 AND p.n = 2)"""

def _sample_sql(linear: bool, mode: str) -> str:
    wrap = {"clamp": "greatest(0, least(7, {i}))", "repeat": "(({i}) % 8 + 8) % 8", "mirror": "CASE WHEN (({i}) % 14 + 14) % 14 < 8 THEN (({i}) % 14 + 14) % 14 ELSE 14 - (({i}) % 14 + 14) % 14 END"}[mode]
    points = "p AS (SELECT vec_id AS surface_id, i::INT AS id, (i * 0.4375::DOUBLE - 0.53125) * 8 AS fx, (i * 0.28125::DOUBLE - 0.171875) * 8 AS fy FROM embeddings, range(5) AS xs(i))"
    if not linear:
        return f"WITH {GRAY}, {points}, q AS (SELECT surface_id, id, floor(fx + 0.5)::INT AS i, floor(fy + 0.5)::INT AS j FROM p) SELECT q.surface_id, id, round(v, 6) AS value FROM q JOIN k ON k.surface_id = q.surface_id AND k.x = {wrap.format(i='i')} AND k.y = {wrap.format(i='j')}"
    start = "floor({} + 0.5)::INT" if mode == "mirror" else "floor({})::INT"  # mirrored taps begin at the rounded place
    return f"""WITH {GRAY}, {points}, q AS (SELECT surface_id, id, {start.format('fx')} + dx AS i, {start.format('fy')} + dy AS j, (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) AS w
        FROM p, (VALUES (0), (1)) AS xs(dx), (VALUES (0), (1)) AS ys(dy)) SELECT q.surface_id, id, round(sum(v * w), 6) AS value FROM q JOIN k ON k.surface_id = q.surface_id AND k.x = {wrap.format(i='i')} AND k.y = {wrap.format(i='j')} GROUP BY 1, 2"""


CASES = {
    "surface_average": (average, f"WITH {BLOCKS} SELECT surface_id, round(CASE WHEN sum(a) = 0 THEN 0 ELSE pow(sum(pow(r, 2.2) * a) / sum(a), 1 / 2.2::DOUBLE) END, 6) AS average FROM b GROUP BY 1"),
    "surface_range": (value_range, f"WITH {BLOCKS} SELECT surface_id, round(coalesce(min(r) FILTER (a > 0.6), 3.4028234663852886e38), 6) AS low, round(coalesce(max(r) FILTER (a > 0.6), -3.4028234663852886e38), 6) AS high FROM b GROUP BY 1"),
    "surface_histogram": (histogram, f"WITH {HDR} SELECT k::INT AS bin, count(r) AS n FROM range(64) AS ks(k) LEFT JOIN b ON greatest(0, least(63, floor(r * 32.0::DOUBLE))) = k GROUP BY 1"),
    "column_histogram": (quantity_histogram, "SELECT k::INT AS bin, count(l_quantity) AS n FROM range(32) AS ks(k) LEFT JOIN lineitem ON greatest(0, least(31, floor(l_quantity * (32 / 50.0::DOUBLE)))) = k GROUP BY 1"),
    "alpha_coverage": (coverage, f"""WITH {GRAY}, q AS (SELECT o.surface_id, o.v AS v00, r.v AS v01, d.v AS v10, e.v AS v11 FROM k o JOIN k r ON r.surface_id = o.surface_id AND r.y = o.y AND r.x = o.x + 1
        JOIN k d ON d.surface_id = o.surface_id AND d.y = o.y + 1 AND d.x = o.x JOIN k e ON e.surface_id = o.surface_id AND e.y = o.y + 1 AND e.x = o.x + 1)
        SELECT surface_id, round(sum({SAMPLES}) / 16.0::DOUBLE / 49, 6) AS coverage FROM q GROUP BY 1"""),
    "rms_error": (rms_error, f"WITH {PAIRS}, e AS (SELECT surface_id, sqrt(avg((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2)) AS e FROM p GROUP BY 1) SELECT surface_id, round(e, 6) AS rms, round(CASE WHEN e = 0 THEN 999 ELSE -20 * log10(e) END, 6) AS psnr FROM e"),
    "rms_error_alpha_weighted": (rms_alpha_weighted, f"WITH {PAIRS} SELECT surface_id, round(sqrt(avg(a * a * ((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2))), 6) AS rms FROM p GROUP BY 1"),
    "rms_alpha_error": (rms_alpha_error, f"WITH {BLOCKS} SELECT surface_id, round(sqrt(avg((a - floor(a * 7 + 0.5) / 7) ** 2)), 6) AS rms FROM b GROUP BY 1"),
    "mean_errors": (mean_errors, f"WITH {PAIRS} SELECT surface_id, round(avg(abs(r - r2) + abs(g - g2) + abs(b - b2)), 6) AS colour, round(avg(abs(a - a2)), 6) AS alpha FROM p GROUP BY 1"),
    "lab_error": (lab_error, f"WITH {BLOCKS}, {QUANTIZED}, {LAB} SELECT surface_id, round(avg(sqrt((l1 - l2) ** 2 + (a1 - a2) ** 2 + (b1 - b2) ** 2)), 6) AS delta_e FROM two GROUP BY 1"),
    "lab94_error": (lab94_error, f"""WITH {BLOCKS}, {QUANTIZED}, {LAB}, c AS (SELECT *, sqrt(a1 * a1 + b1 * b1) - sqrt(a2 * a2 + b2 * b2) AS dc FROM two)
        SELECT surface_id, round(avg(sqrt((l1 - l2) ** 2 + (dc / (1 + 0.045 * l1)) ** 2 + greatest(0.0, (a1 - a2) ** 2 + (b1 - b2) ** 2 - dc * dc) / (1 + 0.015 * l1) ** 2)), 6) AS delta_e FROM c GROUP BY 1"""),
    "angular_error": (angular_error, f"""WITH {PAIRS}, u AS (SELECT surface_id, 2 * r - 1 AS x1, 2 * g - 1 AS y1, 2 * b - 1 AS z1, 2 * r2 - 1 AS x2, 2 * g2 - 1 AS y2, 2 * b2 - 1 AS z2 FROM p),
        an AS (SELECT surface_id, acos(greatest(-1.0, least(1.0, (x1 * x2 + y1 * y2 + z1 * z2) / sqrt((x1 * x1 + y1 * y1 + z1 * z1) * (x2 * x2 + y2 * y2 + z2 * z2))))) AS t FROM u)
        SELECT surface_id, round(avg(t), 6) AS mean, round(sqrt(avg(t * t)), 6) AS rms FROM an GROUP BY 1"""),
    "block_stats": (block_stats, f"WITH {ATLAS} SELECT 0 AS surface_id, (y // 4)::INT AS \"by\", (x // 4)::INT AS bx, " + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in "rgb" for n, f in (("low", "min"), ("high", "max"))) + ", count(DISTINCT (r, g, b)) = 1 AS single_colour, bool_or(a < 1) AS has_alpha FROM t GROUP BY 1, 2, 3"),
    "covariance": (covariance, f"WITH {BLOCKS}, m AS (SELECT surface_id, sum(r * a) / sum(a) AS mr, sum(g * a) / sum(a) AS mg, sum(b * a) / sum(a) AS mb FROM b GROUP BY 1) SELECT surface_id, round(any_value(mr), 6) AS mean_r, round(any_value(mg), 6) AS mean_g, round(any_value(mb), 6) AS mean_b, " + ", ".join(f"round(sum(a * ({p} - m{p}) * ({q} - m{q})), 6) AS {p}{q}" for p, q in ("rr", "rg", "rb", "gg", "gb", "bb")) + " FROM b JOIN m USING (surface_id) GROUP BY 1"),
    "block_chroma": (block_chroma, f"""WITH {ATLAS}, c AS (SELECT y, x, r - b AS co, g - (r + b) / 2 AS cg, g / 2 + (r + b) / 4 AS l FROM t),
        m AS (SELECT y // 4 AS v, x // 4 AS u, greatest(1 / 255.0::DOUBLE, max(abs(co)), max(abs(cg))) AS m FROM c GROUP BY 1, 2),
        s AS (SELECT v, u, coalesce(min((i * 8 + i // 4) / 255.0::DOUBLE) FILTER ((i * 8 + i // 4) / 255.0::DOUBLE >= m), 1) AS s FROM m, range(32) AS xs(i) GROUP BY 1, 2)
        SELECT 0 AS surface_id, y, x, round(co / s, 6) AS r, round(cg / s, 6) AS g, round(s, 6) AS b, round(l, 6) AS a FROM c JOIN s ON v = y // 4 AND u = x // 4"""),
    "flip_x": (flip_x, sql(ATLAS, "(SELECT * REPLACE (79 - x AS x) FROM t)")),
    "flip_y": (flip_y, sql(BLOCKS, "(SELECT * REPLACE (3 - y AS y) FROM b)")),
    "border": (border, f"WITH {GRAY} SELECT surface_id, y, x, " + ", ".join(f"CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN {v}.0::DOUBLE ELSE round(v, 6) END AS {c}" for c, v in zip("rgba", (1, 0, 0, 1), strict=True)) + " FROM k"),
    "atlas_border": (atlas_border, f"WITH {ATLAS} SELECT surface_id, y, x, " + ", ".join(f"CASE WHEN x % 8 IN (0, 7) OR y % 4 IN (0, 3) THEN {v}.0::DOUBLE ELSE round({c}, 6) END AS {c}" for c, v in zip("rgba", (0, 1, 0, 1), strict=True)) + " FROM t"),
    "sub_image": (sub_image, f"WITH {GRAY} SELECT surface_id, y - 1 AS y, x - 2 AS x, {GRAY_OUT} FROM k WHERE x >= 2 AND x <= 6 AND y >= 1 AND y <= 4"),
    "canvas": (canvas, f"WITH {GRAY}, o AS (SELECT vec_id AS surface_id, y::INT AS y, x::INT AS x FROM embeddings, range(10) AS ys(y), range(6) AS xs(x)) SELECT surface_id, y, x, {GRAY_OUT.replace('round(v, 6)', 'round(coalesce(v, 0), 6)')} FROM o LEFT JOIN k USING (surface_id, y, x)"),
    "planar_import": (planar_import, "SELECT vec_id AS surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, " + ", ".join(f"round(embedding[{16 * i} + t + 1]::DOUBLE, 6) AS {c}" for i, c in enumerate("rgba")) + " FROM embeddings, range(16) AS ts(t)"),
    "copy_channel": (copy_channel, f"WITH {BLOCKS} SELECT b.surface_id, b.y, b.x, round(b.r, 6) AS r, round(b.g, 6) AS g, round(b.b, 6) AS b, round(o.g, 6) AS a FROM b JOIN b o ON o.surface_id = b.surface_id AND o.y = b.y AND o.x = 3 - b.x"),
    "add_channel": (add_channel, f"WITH {BLOCKS} SELECT b.surface_id, b.y, b.x, round(b.r, 6) AS r, round(b.g, 6) AS g, round(b.b + o.r / 2, 6) AS b, round(b.a, 6) AS a FROM b JOIN b o ON o.surface_id = b.surface_id AND o.y = b.y AND o.x = 3 - b.x"),
    "copy_box": (copy_box, f"WITH {GRAY} SELECT surface_id, y, x, " + ", ".join(f"CASE WHEN x BETWEEN 3 AND 6 AND y BETWEEN 4 AND 6 THEN {v}::DOUBLE ELSE round(v, 6) END AS {c}" for c, v in zip("rgba", (0.25, 0.5, 0.75, 1.0), strict=True)) + " FROM k"),
    "difference": (difference, sql(PAIRS, "p", "4 * a * (r2 - r)", "4 * a * (g2 - g)", "4 * a * (b2 - b)", "a")),
    "warp": (warp, f"""WITH {GRAY}, f AS (SELECT surface_id, y, x, x * 0.5::DOUBLE + 1.25 AS fx, y * 0.75::DOUBLE + 0.5 AS fy FROM k),
        w AS (SELECT *, floor(fx)::INT AS x0, floor(fy)::INT AS y0 FROM f),
        o AS (SELECT w.surface_id, w.y, w.x, sum(k.v * (CASE WHEN dx = 1 THEN fx - x0 ELSE 1 - (fx - x0) END) * (CASE WHEN dy = 1 THEN fy - y0 ELSE 1 - (fy - y0) END)) AS v
              FROM w, (VALUES (0), (1)) AS xs(dx), (VALUES (0), (1)) AS ys(dy), k WHERE k.surface_id = w.surface_id AND k.x = least(x0 + dx, 7) AND k.y = least(y0 + dy, 7) GROUP BY 1, 2, 3)
        SELECT surface_id, y, x, {GRAY_OUT} FROM o"""),
    "down_sample_even": (down_sample_even, f"WITH {GRAY}, o AS (SELECT surface_id, (y // 2)::INT AS y, (x // 2)::INT AS x, avg(v) AS v FROM k GROUP BY 1, 2, 3) SELECT surface_id, y, x, {GRAY_OUT} FROM o"),
    "down_sample_odd": (down_sample_odd, f"""WITH {GRAY}, wx(dst, src, w) AS (SELECT d::INT, (2 * d + j)::INT, (CASE j WHEN 0 THEN 3 - d WHEN 1 THEN 3 ELSE 1 + d END) / 7.0::DOUBLE FROM range(3) AS ds(d), range(3) AS js(j)),
        wy(dst, src, w) AS (SELECT d::INT, (2 * d + j)::INT, (CASE j WHEN 0 THEN 2 - d WHEN 1 THEN 2 ELSE 1 + d END) / 5.0::DOUBLE FROM range(2) AS ds(d), range(3) AS js(j)) {_resized('k', 7, 5, 'wx', 'wy')}"""),
    "resize_box": (resize_box, f"WITH {GRAY}, {weights('wx', BOX, 0.5, 8, 3, 'mirror')}, {weights('wy', BOX, 0.5, 8, 5, 'mirror')} {_resized('k', 8, 8, 'wx', 'wy')}"),
    "resize_triangle": (resize_triangle, f"WITH {GRAY}, {weights('wx', TRIANGLE, 1, 8, 5, 'clamp')}, {weights('wy', TRIANGLE, 1, 8, 12, 'clamp')} {_resized('k', 8, 8, 'wx', 'wy')}"),
    "resize_kaiser": (resize_kaiser, f"WITH {GRAY}, {weights('wx', KAISER, 3, 8, 4, 'mirror')}, {weights('wy', KAISER, 3, 8, 4, 'mirror')} {_resized('k', 8, 8, 'wx', 'wy')}"),
    "mip_chain": (mip_chain, f"""WITH {GRAY} SELECT surface_id, mip, (y // (1 << mip))::INT AS y, (x // (1 << mip))::INT AS x, round(avg(v), 6) AS r, round(avg(v), 6) AS a
        FROM k, (VALUES (0), (1), (2), (3)) AS ms(mip) GROUP BY 1, 2, 3, 4"""),
    "mip_chain_triangle": (mip_chain_triangle, f"""WITH {GRAY}, {weights('wa', TRIANGLE, 1, 8, 4, 'mirror')}, {weights('wb', TRIANGLE, 1, 4, 2, 'mirror')},
        one AS (SELECT surface_id, wy.dst AS y, wx.dst AS x, sum(v * wx.w * wy.w) AS v FROM k JOIN wa wx ON wx.src = x JOIN wa wy ON wy.src = y GROUP BY 1, 2, 3),
        two AS (SELECT surface_id, wy.dst AS y, wx.dst AS x, sum(v * wx.w * wy.w) AS v FROM one JOIN wb wx ON wx.src = x JOIN wb wy ON wy.src = y GROUP BY 1, 2, 3)
        SELECT surface_id, 0 AS mip, y, x, round(v, 6) AS r FROM k UNION ALL SELECT surface_id, 1, y, x, round(v, 6) FROM one UNION ALL SELECT surface_id, 2, y, x, round(v, 6) FROM two"""),
    "convolve_laplacian": (convolve_laplacian, f"""WITH {GRAY}, k9(dy, dx) AS (SELECT y::INT, x::INT FROM range(-1, 2) AS ys(y), range(-1, 2) AS xs(x)),
        o AS (SELECT k.surface_id, k.y, k.x, any_value(k.v) AS v, sum(s.v * CASE WHEN dx = 0 AND dy = 0 THEN 4 WHEN dx = 0 OR dy = 0 THEN -1 ELSE 0 END) AS c FROM k, k9, k s WHERE s.surface_id = k.surface_id AND s.y = {_mirror('k.y + dy', 8)} AND s.x = {_mirror('k.x + dx', 8)} GROUP BY 1, 2, 3)
        SELECT surface_id, y, x, round(c, 6) AS r, round(v, 6) AS g, round(v, 6) AS b, round(v, 6) AS a FROM o"""),
    "convolve_sobel": (convolve_sobel, f"""WITH {ATLAS}, k9(dy, dx, w) AS (VALUES (-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)),
        o AS (SELECT t.y, t.x, any_value(t.r) AS r, any_value(t.b) AS b, any_value(t.a) AS a, sum(s.g * k9.w) / 8 AS c FROM t, h, k9, t s WHERE s.y = (t.y + dy + h.h) % h.h AND s.x = (t.x + dx + 80) % 80 GROUP BY 1, 2)
        SELECT 0 AS surface_id, y, x, round(r, 6) AS r, round(c, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM o"""),
    "normal_map": (normal_map, f"""WITH {GRAY}, {_kernel_sql(_blend_sql())},
        o AS (SELECT k.surface_id, k.y, k.x, any_value(k.v) AS v, sum(s.v * k9.w) AS du, sum(s.v * kt.w) AS dv FROM k, k9, k9 kt, k s
              WHERE kt.dx = k9.dy AND kt.dy = k9.dx AND s.surface_id = k.surface_id AND s.y = {_mirror('k.y + k9.dy', 8)} AND s.x = {_mirror('k.x + k9.dx', 8)} GROUP BY 1, 2, 3),
        l AS (SELECT *, sqrt(du * du + dv * dv + 1 / 256.0::DOUBLE) AS l FROM o)
        SELECT surface_id, y, x, round(du / l, 6) AS r, round(dv / l, 6) AS g, round(1 / 16.0::DOUBLE / l, 6) AS b, round(v, 6) AS a FROM l"""),
    "mip_error": (flagship, f"""WITH {ATLAS}, m AS (SELECT y // 2 AS y, x // 2 AS x, pow(avg(pow(r, 2.2)), 1 / 2.2::DOUBLE) AS r, pow(avg(pow(g, 2.2)), 1 / 2.2::DOUBLE) AS g, pow(avg(pow(b, 2.2)), 1 / 2.2::DOUBLE) AS b FROM t GROUP BY 1, 2),
        e AS (SELECT sqrt(avg((r - floor(r * 31 + 0.5) / 31) ** 2 + (g - floor(g * 63 + 0.5) / 63) ** 2 + (b - floor(b * 31 + 0.5) / 31) ** 2)) AS e FROM m)
        SELECT 0 AS surface_id, round(e, 6) AS rms, round(-20 * log10(e), 6) AS psnr FROM e"""),
    "tone_mapped_error": (tone_mapped_error, f"""WITH {HDR}, e0 AS (SELECT *, CASE WHEN greatest(r, g, b) > 0 THEN greatest(-16, floor(log2(greatest(r, g, b)))) ELSE -16 END + 16 AS e0 FROM b),
        e AS (SELECT *, pow(2.0, e0 + (round_even(greatest(r, g, b) / pow(2.0, e0 - 24), 0) = 512)::INT - 24) AS u FROM e0),
        c AS (SELECT unnest([r, g, b]) AS v, unnest([floor(r / u + 0.5) * u, floor(g / u + 0.5) * u, floor(b / u + 0.5) * u]) AS v2 FROM e),
        d AS (SELECT v / 2 / (1 + v / 2) AS v, v2 / 2 / (1 + v2 / 2) AS v2 FROM c),
        s AS (SELECT CASE WHEN v <= 0.0031308 THEN 12.92 * v ELSE 1.055 * pow(v, 0.41666) - 0.055 END AS v, CASE WHEN v2 <= 0.0031308 THEN 12.92 * v2 ELSE 1.055 * pow(v2, 0.41666) - 0.055 END AS v2 FROM d)
        SELECT 0 AS surface_id, round(sqrt(3 * avg((v - v2) ** 2)), 6) AS rms FROM s"""),
    "resize_mitchell": (resize_mitchell, f"""WITH {ATLAS}, {weights('wx', MITCHELL, 2, 80, 40, 'repeat')}, n AS (SELECT h.h AS n FROM h),
        m AS (SELECT j, avg({MITCHELL}) AS w FROM (SELECT j, (j - 4 + (s + 0.5) / 32) / 2 AS u FROM range(0, 9) AS js(j), range(32) AS ss(s)) GROUP BY j),
        ws AS (SELECT (y // 2)::INT AS dst, ((y - 3 + j + n) % n)::INT AS src, w / (SELECT sum(w) FROM m) AS w FROM n, m, (SELECT DISTINCT y FROM t WHERE y % 2 = 0))
        SELECT 0 AS surface_id, ws.dst AS y, wx.dst AS x, round(sum(r * wx.w * ws.w), 6) AS r, round(sum(g * wx.w * ws.w), 6) AS g, round(sum(b * wx.w * ws.w), 6) AS b, round(sum(a * wx.w * ws.w), 6) AS a
        FROM t JOIN wx ON wx.src = x JOIN ws ON ws.src = y GROUP BY 1, 2, 3"""),
    "coverage_scale": (coverage_scale, f"""WITH RECURSIVE {ATLAS}, q AS (SELECT o.a AS v00, r.a AS v01, d.a AS v10, e.a AS v11 FROM t o JOIN t r ON r.y = o.y AND r.x = o.x + 1 JOIN t d ON d.y = o.y + 1 AND d.x = o.x JOIN t e ON e.y = o.y + 1 AND e.x = o.x + 1),
        s AS (  -- a step tests the scale that the one before it chose
          SELECT 0 AS step, 0.0::DOUBLE AS low, 4.0::DOUBLE AS high, 1.0::DOUBLE AS scale, NULL::DOUBLE AS tried, NULL::DOUBLE AS got
          UNION ALL
          SELECT step + 1, CASE WHEN c < 0.5 THEN scale ELSE low END, CASE WHEN c < 0.5 THEN high ELSE scale END, CASE WHEN c < 0.5 THEN (scale + high) / 2 ELSE (low + scale) / 2 END, scale, c
          FROM (SELECT step, low, high, scale, sum({PASSED}) / 16.0::DOUBLE / (79 * (SELECT h - 1 FROM h)) AS c
                FROM (SELECT step, low, high, scale, least(1.0, v00 * scale) AS v00, least(1.0, v01 * scale) AS v01, least(1.0, v10 * scale) AS v10, least(1.0, v11 * scale) AS v11 FROM s, q WHERE step < 10 AND coalesce(got, 0) <> 0.5) GROUP BY 1, 2, 3, 4)),
        f AS (SELECT tried AS scale FROM s WHERE tried IS NOT NULL ORDER BY abs(got - 0.5), step LIMIT 1)
        SELECT 0 AS surface_id, round(avg(least(1.0, a * scale)), 6) AS mean_alpha, round(any_value(scale), 6) AS scale FROM t, f"""),
    "principal_axis": (principal_axis, f"""WITH {BLOCKS}, {COVARIANCE}, {_axis_sql()}, u AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM v8)
        SELECT surface_id, round(x / l, 6) AS axis_r, round(y / l, 6) AS axis_g, round(z / l, 6) AS axis_b,
               round((rr * x * x + gg * y * y + bb * z * z + 2 * (rg * x * y + rb * x * z + gb * y * z)) / (l * l) / (rr + gg + bb), 6) AS share FROM u"""),
    "resize_volume": (resize_volume, f"""WITH {VOLUME}, {weights('wx', TRIANGLE, 1, 4, 2, 'repeat')}, {weights('wy', TRIANGLE, 1, 4, 3, 'repeat')}, {weights('wz', TRIANGLE, 1, 4, 6, 'repeat')}
        SELECT surface_id, wz.dst AS z, wy.dst AS y, wx.dst AS x, round(sum(v * wx.w * wy.w * wz.w), 6) AS value FROM v JOIN wx ON wx.src = x JOIN wy ON wy.src = y JOIN wz ON wz.src = z GROUP BY 1, 2, 3, 4"""),
    "flip_z": (flip_z, f"WITH {VOLUME} SELECT surface_id, 3 - z AS z, y, x, round(v, 6) AS value FROM v"),
    "kernel1_weights": (kernel_weights, f"""WITH {GRAY}, m AS (SELECT i, avg(greatest(0.0, 1 - abs((i - 3 + (s + 0.5) / 32) / 3))) AS w FROM range(6) AS xs(i), range(32) AS ss(s) GROUP BY 1)
        SELECT surface_id, round(sum(v * w) / (SELECT sum(w) FROM m), 6) AS value FROM k JOIN m ON i = x WHERE y = 0 GROUP BY 1"""),
    "solid_mip": (solid_mip, "SELECT vec_id AS surface_id, y::INT AS y, x::INT AS x, 0.25::DOUBLE AS r, 0.5::DOUBLE AS g, 0.75::DOUBLE AS b, 1.0::DOUBLE AS a FROM embeddings, range(2) AS ys(y), range(2) AS xs(x)"),
    "normal_map_bytes": (normal_map_bytes, f"""WITH {ATLAS}, i AS (SELECT y, x, (trunc(r * 255) + 2 * trunc(g * 255) + trunc(b * 255)) / 4 / 255.0::DOUBLE AS v FROM t), k9(dy, dx, w) AS (VALUES (-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)),
        u AS (SELECT i.y, i.x, any_value(i.v) AS v, sum(s.v * k9.w) / 8 AS du FROM i, h, k9, i s WHERE s.y = greatest(0, least(h.h - 1, i.y + dy)) AND s.x = greatest(0, least(79, i.x + dx)) GROUP BY 1, 2),
        d AS (SELECT i.y, i.x, sum(s.v * k9.w) / 8 AS dv FROM i, h, k9, i s WHERE s.y = greatest(0, least(h.h - 1, i.y + dx)) AND s.x = greatest(0, least(79, i.x + dy)) GROUP BY 1, 2),
        l AS (SELECT *, sqrt(du * du + dv * dv + 1 / 256.0::DOUBLE) AS l FROM u JOIN d USING (y, x))
        SELECT 0 AS surface_id, y, x, round(0.5 * du / l + 0.5, 6) AS r, round(0.5 * dv / l + 0.5, 6) AS g, round(0.5 / 16 / l + 0.5, 6) AS b, round(v, 6) AS a FROM l"""),
    "convolve_prewitt": (convolve_prewitt, f"""WITH {GRAY}, o AS (SELECT k.surface_id, k.y, k.x, any_value(k.v) AS v, sum(s.v * dx) / 30 AS c FROM k, range(-2, 3) AS ys(dy), range(-2, 3) AS xs(dx), k s
        WHERE s.surface_id = k.surface_id AND s.y = greatest(0, least(7, k.y + dy)) AND s.x = greatest(0, least(7, k.x + dx)) GROUP BY 1, 2, 3) SELECT surface_id, y, x, round(c, 6) AS r, round(v, 6) AS g, round(v, 6) AS b, round(v, 6) AS a FROM o"""),
    "best_plane": (best_plane, PLANE),
    "byte_import": (byte_import, "WITH d AS (SELECT doc_id, sha256(doc_id::VARCHAR) || sha256(doc_id::VARCHAR) AS h FROM documents), " + "p AS (SELECT doc_id, t, " + ", ".join(f"(instr('0123456789abcdef', substr(h, (8 * t + {2 * i + 1})::INT, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, (8 * t + {2 * i + 2})::INT, 1)) - 1 AS {c}" for i, c in enumerate("bgra"))
        + " FROM d, range(16) AS ts(t)) SELECT doc_id AS surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, round(r / 255, 6) AS r, round(g / 255, 6) AS g, round(b / 255, 6) AS b, round(a / 255, 6) AS a FROM p"),
    "half_import": (half_import, "WITH i AS (SELECT event_id AS surface_id, " + ", ".join(f"(event_id * {m} + {a}) % 31744 AS {c}" for c, m, a in (("r", 1, 0), ("g", 37, 11), ("b", 101, 5), ("a", 997, 1))) + " FROM events) SELECT surface_id, "
        + ", ".join(f"round(CASE WHEN {c} < 1024 THEN {c} * pow(2.0, -24) ELSE (1 + ({c} % 1024) / 1024.0::DOUBLE) * pow(2.0, {c} // 1024 - 15) END, 6) AS {c}" for c in "rgba") + " FROM i"),
    "normals_quartic": (normals_quartic, f"""WITH {BLOCKS}, {SIGNED}, {UNIT}, t0 AS (SELECT *, (sqrt(b * b + 4 * (r * r + g * g)) - b) / (2 * (r * r + g * g)) AS t FROM n), {_newton_sql()}
        SELECT surface_id, y, x, round(CASE WHEN b > 0.1 THEN r * t ELSE r END, 6) AS r, round(CASE WHEN b > 0.1 THEN g * t ELSE g END, 6) AS g, round(CASE WHEN b > 0.1 THEN 0 ELSE b END, 6) AS b, round(a, 6) AS a FROM t12"""),
    "bilinear_error": (bilinear_error, f"""WITH {GRAY}, m AS (SELECT surface_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM k GROUP BY 1, 2, 3),
        t AS (SELECT k.surface_id, k.y, k.x, any_value(k.v) AS v, sum(m.v * (CASE WHEN k.x % 2 = 0 THEN 1 - dx ELSE 0.5::DOUBLE END) * (CASE WHEN k.y % 2 = 0 THEN 1 - dy ELSE 0.5::DOUBLE END)) AS s FROM k, (VALUES (0), (1)) AS xs(dx), (VALUES (0), (1)) AS ys(dy), m
              WHERE m.surface_id = k.surface_id AND m.x = least(k.x // 2 + dx, 3) AND m.y = least(k.y // 2 + dy, 3) GROUP BY 1, 2, 3)
        SELECT surface_id, round(sqrt(avg(4 * (v - s) ** 2)), 6) AS rms FROM t GROUP BY 1"""),
}
for _shape, (_formula, _reach) in SHAPES.items():
    CASES[f"resize_{_shape}"] = (resized_with(_shape), f"WITH {GRAY}, {weights('wx', _formula, _reach, 8, 5, 'mirror')}, {weights('wy', _formula, _reach, 8, 3, 'mirror')} {_resized('k', 8, 8, 'wx', 'wy')}")
for _mode in ("clamp", "repeat", "mirror"):
    CASES[f"volume_nearest_{_mode}"] = (_volume_sampled(N.sample_nearest, _mode), _volume_sql(False, _mode))
    CASES[f"volume_linear_{_mode}"] = (_volume_sampled(N.sample_linear, _mode), _volume_sql(True, _mode))
    CASES[f"sample_nearest_{_mode}"] = (_sampled(N.sample_nearest, _mode), _sample_sql(False, _mode))
    CASES[f"sample_linear_{_mode}"] = (_sampled(N.sample_linear, _mode), _sample_sql(True, _mode))
QUERIES = {name: run for name, (run, _) in CASES.items()}
SQL = {name: text for name, (_, text) in CASES.items() if text}
