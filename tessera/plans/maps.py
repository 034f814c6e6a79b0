"""Queries of the per-texel maps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.sources import relations as S

#: Views of the same relations in SQL.
BLOCKS = """b AS (SELECT vec_id AS surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x,
  greatest(0.0, least(1.0, embedding[4 * t + 1]::DOUBLE + 0.5)) AS r, greatest(0.0, least(1.0, embedding[4 * t + 2]::DOUBLE + 0.5)) AS g,
  greatest(0.0, least(1.0, embedding[4 * t + 3]::DOUBLE + 0.5)) AS b, greatest(0.0, least(1.0, embedding[4 * t + 4]::DOUBLE + 0.5)) AS a
  FROM embeddings, range(16) AS ts(t))"""
HDR = """b AS (SELECT 0 AS surface_id, (event_id // 50)::INT AS y, (event_id % 50)::INT AS x, coalesce(value, 0) / 100 AS r,
  coalesce(value, 0) / 100 / 2 AS g, coalesce(value, 0) / 100 / 4 AS b, 1.0::DOUBLE AS a FROM events)"""
SIGNED = "s AS (SELECT surface_id, y, x, 2 * r - 1 AS r, 2 * g - 1 AS g, 2 * b - 1 AS b, a FROM b)"
UNIT = "n AS (SELECT surface_id, y, x, r / l AS r, g / l AS g, b / l AS b, a FROM (SELECT *, sqrt(r * r + g * g + b * b) AS l FROM s))"


def rounded(texels: DataFrame) -> DataFrame:
    return texels.select("surface_id", "y", "x", *[F.round(c, 6).alias(c) for c in S.CHANNELS])


def sql(views: str, source: str, r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> str:
    put = ", ".join(f"round(({e})::DOUBLE, 6) AS {c}" for c, e in zip("rgba", (r, g, b, a), strict=True))
    return f"WITH {views} SELECT surface_id, y, x, {put} FROM {source}"


def same(views: str, source: str, of: str, alpha: str = "a", channels: str = "rgb") -> str:
    """One expression of c for each of the channels."""
    put = [of.replace("{c}", c) if c in channels else ("a" if c == "a" and alpha == "a" else (alpha if c == "a" else c)) for c in "rgba"]
    return sql(views, source, *put)


def signed(t: DataFrame) -> DataFrame:
    return T.scale_bias(t, 2.0, -1.0, T.RGB)


LAB_PARTS = """l AS (SELECT surface_id, y, x, a AS alpha, pow(r, 2.2) AS lr, pow(g, 2.2) AS lg, pow(b, 2.2) AS lb FROM b),
  q AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS tx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS ty,
        (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS tz FROM l),
  f AS (SELECT *, CASE WHEN tx > 216 / 24389.0::DOUBLE THEN cbrt(tx) ELSE tx * 841 / 108 + 4 / 29.0::DOUBLE END AS fx,
        CASE WHEN ty > 216 / 24389.0::DOUBLE THEN cbrt(ty) ELSE ty * 841 / 108 + 4 / 29.0::DOUBLE END AS fy,
        CASE WHEN tz > 216 / 24389.0::DOUBLE THEN cbrt(tz) ELSE tz * 841 / 108 + 4 / 29.0::DOUBLE END AS fz FROM q)"""
#: There and back again: what is left of a colour after both matrices.
ROUND_TRIP = f"""WITH {BLOCKS}, v AS (SELECT surface_id, y, x, a, 0.412453 * pow(r, 2.2) + 0.357580 * pow(g, 2.2) + 0.180423 * pow(b, 2.2) AS vx,
  0.212671 * pow(r, 2.2) + 0.715160 * pow(g, 2.2) + 0.072169 * pow(b, 2.2) AS vy, 0.019334 * pow(r, 2.2) + 0.119193 * pow(g, 2.2) + 0.950227 * pow(b, 2.2) AS vz FROM b)
  SELECT surface_id, y, x, round(pow(greatest(0.0, 3.2404542 * vx - 1.5371385 * vy - 0.4985314 * vz), 1 / 2.2::DOUBLE), 6) AS r,
         round(pow(greatest(0.0, 1.8760108 * vy - 0.9692660 * vx + 0.0415560 * vz), 1 / 2.2::DOUBLE), 6) AS g,
         round(pow(greatest(0.0, 0.0556434 * vx - 0.2040259 * vy + 1.0572252 * vz), 1 / 2.2::DOUBLE), 6) AS b, round(a, 6) AS a FROM v"""
MATRIX = ((0.5, 0.1, 0.0, 0.0), (0.2, 0.7, 0.3, 0.0), (0.1, 0.2, 0.6, 0.0), (0.0, 0.0, 0.1, 1.0))
CLAMP01 = "greatest(0.0, least(1.0, {c}))"
CASES = {
    # name: (relation, map, SQL)
    "to_linear": (S.blocks, lambda t: T.to_linear(t, 2.2), same(BLOCKS, "b", "pow({c}, 2.2)")),
    "to_gamma": (S.blocks, lambda t: T.to_gamma(t, 2.2), same(BLOCKS, "b", "pow({c}, 1 / 2.2::DOUBLE)")),
    "to_linear_channel": (S.blocks, lambda t: T.to_linear(t, 1.8, ("g",)), sql(BLOCKS, "b", g="pow(g, 1.8)")),
    "to_srgb": (S.blocks, T.to_srgb, same(BLOCKS, "b", "CASE WHEN {c} <= 0 THEN 0 WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 0.41666) - 0.055 END")),
    "to_srgb_fast": (S.blocks, T.to_srgb_fast, same(BLOCKS, "b", "0.662002687 * sqrt({c}) + 0.684122060 * pow({c}, 0.25) - 0.323583601 * pow({c}, 0.125) - 0.0225411470 * {c}")),
    "from_srgb": (S.blocks, T.from_srgb, same(BLOCKS, "b", "CASE WHEN {c} < 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END")),
    "from_srgb_fast": (S.blocks, T.from_srgb_fast, same(BLOCKS, "b", "0.305306011 * {c} * {c} * {c} + 0.682171111 * {c} * {c} + 0.012522878 * {c}")),
    "to_console_srgb": (S.blocks, T.to_console_srgb, same(BLOCKS, "b", "CASE WHEN {c} < 0.0625 THEN 4 * {c} WHEN {c} < 0.125 THEN 0.25 + 2 * ({c} - 0.0625) WHEN {c} < 0.5 THEN 0.25 + {c} WHEN {c} < 1 THEN 0.5 + 0.5 * {c} ELSE 1 END")),
    "transform": (S.blocks, lambda t: T.transform(t, MATRIX, (0.1, 0.0, -0.1, 0.0)), sql(BLOCKS, "b", "0.5 * r + 0.2 * g + 0.1 * b + 0.1", "0.1 * r + 0.7 * g + 0.2 * b", "0.3 * g + 0.6 * b + 0.1 * a - 0.1", "a")),
    "swizzle": (S.blocks, lambda t: T.swizzle(t, (2, 6, 0, 4)), sql(BLOCKS, "b", "b", "-1", "r", "1")),
    "scale_bias": (S.blocks, lambda t: T.scale_bias(t, 3.0, -0.25, ("r", "a")), sql(BLOCKS, "b", r="3 * r - 0.25", a="3 * a - 0.25")),
    "clamp": (S.blocks, lambda t: T.clamped(t, 0.4, 0.6), same(BLOCKS, "b", "greatest(0.4, least(0.6, {c}))", channels="rgba")),
    "blend": (S.blocks, lambda t: T.blend(t, (1, 0, 0.5, 1), 0.25), sql(BLOCKS, "b", "0.75 * r + 0.25", "0.75 * g", "0.75 * b + 0.125", "0.75 * a + 0.25")),
    "premultiply": (S.blocks, T.premultiply, same(BLOCKS, "b", "{c} * a")),
    "greyscale": (S.blocks, T.greyscale, sql(BLOCKS, "b", *["(2 * r + 5 * g + b) / 8"] * 4)),
    "fill": (S.blocks, lambda t: T.fill(t, (0.1, 0.2, 0.3, 0.4)), sql(BLOCKS, "b", "0.1", "0.2", "0.3", "0.4")),
    "absolute": (S.blocks, lambda t: T.absolute(signed(t)), sql(f"{BLOCKS}, {SIGNED}", "s", "abs(r)", "abs(g)", "abs(b)", "a")),
    "to_log": (S.hdr, lambda t: T.to_log(T.scale_bias(t, 1.0, 0.125), 4.0), same(HDR, "b", "log2({c} + 0.125) / 2", "1.125")),
    "from_log": (S.blocks, lambda t: T.from_log(t, 4.0), same(BLOCKS, "b", "pow(4.0, {c})")),
    "tone_linear": (S.hdr, T.tone_linear, same(HDR, "b", "{c} / greatest(1.0, r, g, b)")),
    "tone_reinhard": (S.hdr, T.tone_reinhard, same(HDR, "b", "{c} / (1 + {c})")),
    "tone_halo": (S.hdr, T.tone_halo, same(HDR, "b", "1 - pow(0.5, {c})")),
    "to_rgbm": (
        S.blocks, T.to_rgbm,
        f"""WITH {BLOCKS}, i AS (SELECT *, ceil((greatest(r, g, b, 0.25) - 0.25) / 0.75 * 255)::INT AS im FROM b),
        m AS (SELECT *, m / 255.0::DOUBLE * 0.75 + 0.25 AS k FROM i, range(256) AS ms(m) WHERE m >= im - 16 AND m < im + 16),
        e AS (SELECT *, r - round_even(least(r / k, 1.0) * 255, 0) / 255 * k AS er, g - round_even(least(g / k, 1.0) * 255, 0) / 255 * k AS eg,
              b - round_even(least(b / k, 1.0) * 255, 0) / 255 * k AS eb FROM m),
        o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY surface_id, y, x ORDER BY er * er + eg * eg + eb * eb, m) = 1)
        SELECT surface_id, y, x, round(least(r / k, 1.0), 6) AS r, round(least(g / k, 1.0), 6) AS g, round(least(b / k, 1.0), 6) AS b, round((k - 0.25) / 0.75, 6) AS a FROM o""",
    ),
    "from_rgbm": (S.blocks, lambda t: T.from_rgbm(t, 2.0, 0.25), same(BLOCKS, "b", "{c} * (1.75 * a + 0.25)", "1")),
    "to_lm": (S.blocks, lambda t: T.to_lm(t, 0.25), sql(BLOCKS, "b", *["(r + g + b) / 3 / greatest(r, g, b, 0.25)"] * 3, "(greatest(r, g, b, 0.25) - 0.25) / 0.75")),
    "to_rgbe": (
        S.hdr, T.to_rgbe,
        f"""WITH {HDR}, e AS (SELECT *, CASE WHEN greatest(r, g, b) > 0 THEN greatest(-16, floor(log2(greatest(r, g, b)))) ELSE -16 END + 16 AS e0 FROM b),
        u AS (SELECT *, e0 + (round_even(greatest(r, g, b) / pow(2.0, e0 - 24), 0) = 512)::INT AS e FROM e)
        SELECT surface_id, y, x, round(floor(r / pow(2.0, e - 24) + 0.5) / 511, 6) AS r, round(floor(g / pow(2.0, e - 24) + 0.5) / 511, 6) AS g,
               round(floor(b / pow(2.0, e - 24) + 0.5) / 511, 6) AS b, round(e / 31.0::DOUBLE, 6) AS a FROM u""",
    ),
    "from_rgbe": (S.blocks, T.from_rgbe, same(BLOCKS, "b", "round_even({c} * 511, 0) * pow(2.0, round_even(a * 31, 0) - 24)", "1")),
    "to_ycocg": (S.blocks, T.to_ycocg, sql(BLOCKS, "b", "r - b", "g - (r + b) / 2", "1", "g / 2 + (r + b) / 4")),
    "from_ycocg": (S.blocks, T.from_ycocg, sql(BLOCKS, "b", "a + b / 2 * (r - g)", "a + b / 2 * g", "a - b / 2 * (r + g)", "1")),
    "to_luvw": (S.blocks, T.to_luvw, same(BLOCKS, "b", "{c} / greatest(sqrt(r * r + g * g + b * b), 1e-6)", "greatest(sqrt(r * r + g * g + b * b), 1e-6) / sqrt(3.0)")),
    "from_luvw": (S.blocks, T.from_luvw, same(BLOCKS, "b", "{c} * (a * (sqrt(3.0) - 0.25) + 0.25)", "1")),
    "binarize": (S.blocks, lambda t: T.binarize(t, 0.5), same(BLOCKS, "b", "CASE WHEN {c} > 0.5 THEN 1 ELSE 0 END", channels="rgba")),
    "quantize_exact": (S.blocks, lambda t: T.quantize(t, 5), same(BLOCKS, "b", "floor({c} * 31 + 0.5) / 31")),
    "quantize_uniform": (S.blocks, lambda t: T.quantize(t, 4, False), same(BLOCKS, "b", "least((floor({c} * 16) + 0.5) / 16, 1.0)")),
    "quantize_565": (S.blocks, T.quantize_sizes, sql(BLOCKS, "b", "floor(r * 31 + 0.5) / 31", "floor(g * 63 + 0.5) / 63", "floor(b * 31 + 0.5) / 31")),
    "pack_normals": (S.blocks, lambda t: T.pack_normals(signed(t)), same(BLOCKS, "b", "(2 * {c} - 1) * 0.5 + 0.5")),
    "expand_normals": (S.blocks, T.expand_normals, same(BLOCKS, "b", "2 * {c} - 1")),
    "normalize_normals": (S.blocks, lambda t: T.normalize(signed(t)), sql(f"{BLOCKS}, {SIGNED}, {UNIT}", "n")),
    "normals_orthographic": (S.blocks, lambda t: T.transform_normals(signed(t), "orthographic"), sql(f"{BLOCKS}, {SIGNED}, {UNIT}", "n", b="0")),
    "normals_stereographic": (S.blocks, lambda t: T.transform_normals(signed(t), "stereographic"), sql(f"{BLOCKS}, {SIGNED}, {UNIT}", "n", "r / (1 + b)", "g / (1 + b)", "0")),
    "normals_paraboloid": (S.blocks, lambda t: T.transform_normals(signed(t), "paraboloid"), sql(f"{BLOCKS}, {SIGNED}, {UNIT}", "n", "r * (sqrt(b * b + 4 * (r * r + g * g)) - b) / (2 * (r * r + g * g))", "g * (sqrt(b * b + 4 * (r * r + g * g)) - b) / (2 * (r * r + g * g))", "0")),
    "reconstruct_orthographic": (S.blocks, lambda t: T.reconstruct_normals(signed(t), "orthographic"), sql(f"{BLOCKS}, {SIGNED}", "s", b="sqrt(1 - least(1.0, r * r + g * g))")),
    "reconstruct_stereographic": (S.blocks, lambda t: T.reconstruct_normals(signed(t), "stereographic"), sql(f"{BLOCKS}, {SIGNED}", "s", "2 * r / (1 + least(1.0, r * r + g * g))", "2 * g / (1 + least(1.0, r * r + g * g))", "2 / (1 + least(1.0, r * r + g * g)) - 1")),
    "clean_normals": (S.blocks, lambda t: T.clean_normals(signed(t)), sql(f"{BLOCKS}, {SIGNED}", "s", b="r * r + g * g")),
    "to_xyz": (S.blocks, T.to_xyz, sql(BLOCKS, "b", *[f"{m} * pow(r, 2.2) + {n} * pow(g, 2.2) + {o} * pow(b, 2.2)" for m, n, o in ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))])),
    "from_xyz": (S.blocks, T.from_xyz, sql(BLOCKS, "b", *[f"pow(greatest(0.0, {m} * r + {n} * g + {o} * b), 1 / 2.2::DOUBLE)" for m, n, o in ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))])),
    "lab_round_trip": (S.blocks, lambda t: T.from_lab(T.to_lab(t, strict=True)), ROUND_TRIP),
    "to_lch": (
        S.blocks, lambda t: T.to_lch(t, strict=True),
        f"""WITH {BLOCKS}, {LAB_PARTS} SELECT surface_id, y, x, round(116 * fy - 16, 6) AS r, round(sqrt(pow(500 * (fx - fy), 2) + pow(200 * (fy - fz), 2)), 6) AS g,
            round(atan2(500 * (fx - fy), 200 * (fy - fz)), 6) AS b, round(alpha, 6) AS a FROM f""",
    ),
    "to_lm_dark": (S.blocks, lambda t: T.to_lm(t, 0.6), sql(BLOCKS, "b", *["(r + g + b) / 3 / greatest(r, g, b, 0.6)"] * 3, "(greatest(r, g, b, 0.6) - 0.6) / 0.4")),
    "from_rgbm_least": (S.blocks, lambda t: T.from_rgbm(t, 2.0, 0.0), same(BLOCKS, "b", "{c} * (a * (2 - 1e-6) + 1e-6)", "1")),
    "to_lab": (
        S.blocks, T.to_lab,
        f"""WITH {BLOCKS}, l AS (SELECT surface_id, y, x, a AS alpha, pow(r, 2.2) AS lr, pow(g, 2.2) AS lg, pow(b, 2.2) AS lb FROM b),
        q AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS tx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS ty,
              (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS tz FROM l),
        f AS (SELECT *, CASE WHEN tx > 216 / 24389.0::DOUBLE THEN cbrt(tx) ELSE tx * 841 / 108 + 4 / 29.0::DOUBLE END AS fx,
              CASE WHEN ty > 216 / 24389.0::DOUBLE THEN cbrt(ty) ELSE ty * 841 / 108 + 4 / 29.0::DOUBLE END AS fy,
              CASE WHEN tz > 216 / 24389.0::DOUBLE THEN cbrt(tz) ELSE tz * 841 / 108 + 4 / 29.0::DOUBLE END AS fz FROM q)
        SELECT surface_id, y, x, round(116 * fx - 16, 6) AS r, round(500 * (fx - fy), 6) AS g, round(200 * (fy - fz), 6) AS b, round(alpha, 6) AS a FROM f""",
    ),
}


def _query(relation, of):
    return lambda spark, sf_dir: rounded(of(relation(spark, sf_dir)))


def bytes_565(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit texels, packed to 5-6-5 and expanded again."""
    t = T.to_bytes(S.blocks(spark, sf_dir))
    code = T.to_565(F.col("r"), F.col("g"), F.col("b"))
    back = T.from_565(F.col("code"))
    return t.withColumn("code", code).select("surface_id", "y", "x", *S.CHANNELS, "code", *[c.cast("int").alias(n) for c, n in zip(back, ("r2", "g2", "b2"), strict=True)])


def irradiance_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of alpha over directions against the 25 harmonics up to band 4, a row for each."""
    n = T.normalize(T.expand_normals(S.blocks(spark, sf_dir)))
    values = T.harmonics_to(4, F.col("r"), F.col("g"), F.col("b"))
    sums = n.groupBy("surface_id").agg(*[F.avg(v * F.col("a")).alias(f"c{i}") for i, v in enumerate(values.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(band).alias("band"), F.lit(m).alias("argument"), F.round(f"c{i}", 6).alias("value")) for i, (band, m) in enumerate(values)]))
    return sums.select("surface_id", rows.alias("v")).select("surface_id", "v.*")


def irradiance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surface's red, weighted by the spherical harmonics of its texels' directions and averaged."""
    t = T.normalize(signed(S.blocks(spark, sf_dir)))
    sums = [F.round(F.avg(h * F.col("a")), 6).alias(f"c{i}") for i, h in enumerate(T.harmonics(T.C.r, T.C.g, T.C.b))]
    return t.groupBy("surface_id").agg(*sums)


#: The polynomials of the real harmonics by band and argument.
HARMONICS = {
    (0, 0): "0.28209479177387814::DOUBLE",
    (1, -1): "-0.4886025119029199 * y", (1, 0): "0.4886025119029199 * z", (1, 1): "-0.4886025119029199 * x",
    (2, -2): "1.0925484305920792 * x * y", (2, -1): "-1.0925484305920792 * y * z", (2, 0): "0.31539156525252005 * (3 * z * z - 1)", (2, 1): "-1.0925484305920792 * x * z", (2, 2): "0.5462742152960396 * (x * x - y * y)",
    (3, -3): "-0.5900435899266435 * (3 * x * x * y - y * y * y)", (3, -2): "2.890611442640554 * x * y * z", (3, -1): "-0.4570457994644658 * y * (5 * z * z - 1)", (3, 0): "0.3731763325901154 * z * (5 * z * z - 3)",
    (3, 1): "-0.4570457994644658 * x * (5 * z * z - 1)", (3, 2): "1.445305721320277 * (x * x - y * y) * z", (3, 3): "-0.5900435899266435 * (x * x * x - 3 * x * y * y)",
    (4, -4): "0.6258357354491761 * 4 * (x * x * x * y - x * y * y * y)", (4, -3): "-1.7701307697799304 * z * (3 * x * x * y - y * y * y)", (4, -2): "0.9461746957575601 * x * y * (7 * z * z - 1)",
    (4, -1): "-0.6690465435572892 * y * z * (7 * z * z - 3)", (4, 0): "0.10578554691520431 * (35 * z * z * z * z - 30 * z * z + 3)", (4, 1): "-0.6690465435572892 * x * z * (7 * z * z - 3)",
    (4, 2): "0.47308734787878004 * (x * x - y * y) * (7 * z * z - 1)", (4, 3): "-1.7701307697799304 * z * (x * x * x - 3 * x * y * y)", (4, 4): "0.6258357354491761 * (x * x * x * x - 6 * x * x * y * y + y * y * y * y)",
}
QUERIES = {f"map_{name}": _query(relation, of) for name, (relation, of, _) in CASES.items()} | {"map_bytes_565": bytes_565, "sh_projection": irradiance, "sh_orders": irradiance_orders}
SQL = {f"map_{name}": text for name, (_, _, text) in CASES.items()} | {
    "map_bytes_565": f"""WITH {BLOCKS}, i AS (SELECT surface_id, y, x, trunc(r * 255)::INT AS r, trunc(g * 255)::INT AS g, trunc(b * 255)::INT AS b, trunc(a * 255)::INT AS a FROM b),
        q AS (SELECT *, r // 8 AS r5, g // 4 AS g6, b // 8 AS b5 FROM i)
        SELECT surface_id, y, x, r, g, b, a, (r5 * 2048 + g6 * 32 + b5)::INT AS code, (r5 * 8 + r5 // 4)::INT AS r2, (g6 * 4 + g6 // 16)::INT AS g2, (b5 * 8 + b5 // 4)::INT AS b2 FROM q""",
    "sh_orders": f"""WITH {BLOCKS}, {SIGNED}, {UNIT}, h AS (SELECT surface_id, a, r AS x, g AS y, b AS z FROM n)
        SELECT surface_id, band, argument, round(avg(v * a), 6) AS value FROM ({" UNION ALL ".join(f"SELECT surface_id, a, {band} AS band, {m} AS argument, {f} AS v FROM h" for (band, m), f in HARMONICS.items())}) GROUP BY 1, 2, 3""",
    "sh_projection": f"""WITH {BLOCKS}, {SIGNED}, {UNIT}
        SELECT surface_id, round(avg(0.2820948 * a), 6) AS c0, round(avg(-0.4886025 * g * a), 6) AS c1, round(avg(0.4886025 * b * a), 6) AS c2, round(avg(-0.4886025 * r * a), 6) AS c3,
               round(avg(1.0925484 * r * g * a), 6) AS c4, round(avg(-1.0925484 * g * b * a), 6) AS c5, round(avg((0.9461747 * b * b - 0.3153916) * a), 6) AS c6,
               round(avg(-1.0925484 * r * b * a), 6) AS c7, round(avg(0.5462742 * (r * r - g * g) * a), 6) AS c8 FROM n GROUP BY surface_id""",
}
