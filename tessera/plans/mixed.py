"""Queries on surfaces of different extents in one relation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.operators import colours as K
from tessera.operators import extents as E
from tessera.operators import filters as W
from tessera.operators import tiles
from tessera.operators.codecs import gather
from tessera.operators.diffusion import diffuse_bands
from tessera.plans.maps import BLOCKS
from tessera.sources import relations as S

TOLERANCE, WANTED, REFERENCE = 0.22, 0.4, 0.3
MERGE = 0.09
STEPS = 10

RAGGED = f"""e(m, w, h) AS (VALUES {', '.join(f'({i}, {w}, {h})' for i, (w, h) in enumerate(S.RAGGED))}),
  sv AS (SELECT vec_id AS id, w, h, embedding, vec_id % 7 + 1 AS f FROM embeddings JOIN e ON vec_id % {len(S.RAGGED)} = m),
  t0 AS (SELECT id, w, h, y::INT AS y, x::INT AS x, greatest(0.0, least(1.0, embedding[(y * w + x) % 64 + 1]::DOUBLE + 0.5)) * f / 7 AS v
         FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM sv)))"""
HALVINGS = """hv AS (SELECT n AS b, d AS dst, d * 2 + i AS src, CASE WHEN n = 1 THEN 1.0 WHEN n % 2 = 0 THEN 0.5 WHEN i = 0 THEN (n // 2 - d) / n::DOUBLE WHEN i = 1 THEN (n // 2) / n::DOUBLE ELSE (d + 1) / n::DOUBLE END AS w
  FROM range(1, 33) AS ns(n), range(16) AS ds(d), range(3) AS ks(i) WHERE d < greatest(n // 2, 1) AND i < CASE WHEN n = 1 THEN 1 WHEN n % 2 = 0 THEN 2 ELSE 3 END)"""


def _extents(spark, sf_dir):
    t = S.ragged(spark, sf_dir)
    return t, E.extents_of(t)


def mixed_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of surfaces of four extents, each as many as its own."""
    return E.mip_chain(*_extents(spark, sf_dir)).select("surface_id", "mip", "y", "x", F.round("r", 6).alias("r"))


def mixed_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surface to two thirds of its width and three lines more."""
    t, extents = _extents(spark, sf_dir)
    to = extents.select("surface_id", F.floor((F.col("width") * 2 + 2) / 3).cast("int").alias("width"), (F.col("height") + 3).alias("height"))
    return E.resized(t, extents, to, W.triangle(), "repeat").select("surface_id", "y", "x", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))


def mixed_auto_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each surface stops, and its mean there."""
    out, at = E.auto_resized(*_extents(spark, sf_dir), TOLERANCE)
    return out.groupBy("surface_id").agg(F.round(F.avg("r"), 6).alias("mean")).join(at, "surface_id").select("surface_id", "width", "height", "mean")


def mixed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.coverage(S.ragged(spark, sf_dir), REFERENCE)
    return out.select("surface_id", F.round("coverage", 6).alias("coverage"))


def mixed_coverage_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of each surface's alpha for a coverage of WANTED, and its mean with it."""
    t = S.ragged(spark, sf_dir)
    scales = E.coverage_scales(t, WANTED, REFERENCE, steps=STEPS)
    means = E.scaled_to_coverage(t, WANTED, REFERENCE, steps=STEPS, scales=scales).groupBy("surface_id").agg(F.avg("a").alias("mean"))
    return scales.join(means, "surface_id").select("surface_id", *[F.round(c, 6).alias(c) for c in ("scale", "coverage", "mean")])


def mixed_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5 x 5 kernel over surfaces of four extents, in tiles of 8 x 8 texels with a halo of two."""
    t, extents = _extents(spark, sf_dir)
    out = tiles.convolved(t, {"sum": W.normalized(W.kernel("sobel5"))}, extents, "r", "mirror", 8)
    return out.select("surface_id", "y", "x", F.round("r", 6).alias("r"), F.round("sum", 6).alias("sum"))


def mixed_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, extents = _extents(spark, sf_dir)
    out = W.to_normal_map(t, extents, mode="clamp")
    return out.select("surface_id", "y", "x", *[F.round(c, 6).alias(c) for c in S.CHANNELS])


def diffusion_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of four extents quantised to eight levels with error diffusion, in bands of eight lines and tiles of
    sixteen columns."""
    out = diffuse_bands(S.ragged(spark, sf_dir), 8, 16, 3, channels=("r",), carried=True)
    return out.select("surface_id", "y", "x", F.round("r", 6).alias("r"))


def merged_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colours of each 4 x 4 surface, darkened by half, after merging, and which are left without blacks."""
    t = T.each(S.blocks(spark, sf_dir), lambda c: c / 2, T.RGB)
    rows = K.merged(gather(t), MERGE)
    rows = rows.select("surface_id", "any_black", F.size(K.without_blacks(F.col("colours"))).alias("left"), F.posexplode("colours").alias("k", "c"))
    return rows.select("surface_id", "k", *[F.round(f"c.{c}", 6).alias(c) for c in "rgbw"], "any_black", "left")


def _merged_sql() -> str:
    near = f"abs(c.r - x.r) < {MERGE} AND abs(c.g - x.g) < {MERGE} AND abs(c.b - x.b) < {MERGE}"
    mean = lambda c: f"(c.{c} * c.w + x.{c} * x.w) / (c.w + x.w)"
    return f"""WITH RECURSIVE {BLOCKS}, n AS (SELECT surface_id AS id, y * 4 + x AS t, {{'r': r / 2, 'g': g / 2, 'b': b / 2, 'w': a::DOUBLE}} AS x FROM b),
        f AS (SELECT DISTINCT surface_id AS id, -1::BIGINT AS t, []::STRUCT(r DOUBLE, g DOUBLE, b DOUBLE, w DOUBLE)[] AS cs, false AS black FROM b
          UNION ALL SELECT id, t, CASE WHEN x.w <= 0 THEN cs WHEN spot = 0 THEN list_append(cs, x) ELSE list_transform(cs, lambda c, i: CASE WHEN i = spot THEN {{'r': {mean('r')}, 'g': {mean('g')}, 'b': {mean('b')}, 'w': c.w + x.w}} ELSE c END) END,
            black OR (x.w > 0 AND x.r < 0.125 AND x.g < 0.125 AND x.b < 0.125)
          FROM (SELECT n.id, n.t, n.x, f.cs, f.black, coalesce(list_position(list_transform(f.cs, lambda c: {near.replace('x.', 'n.x.')}), true), 0) AS spot FROM f JOIN n ON n.id = f.id AND n.t = f.t + 1)),
        e AS (SELECT id, black, len(list_filter(cs, lambda c: NOT (c.r < 0.125 AND c.g < 0.125 AND c.b < 0.125))) AS left_, unnest(cs) AS c, unnest(range(len(cs))) AS k FROM f WHERE t = 15)
        SELECT id AS surface_id, k, round(c.r, 6) AS r, round(c.g, 6) AS g, round(c.b, 6) AS b, round(c.w, 6) AS w, black AS any_black, left_ AS "left" FROM e"""


def _kernel_sql(name: str, k: list[list[float]]) -> str:
    values = ", ".join(f"({r}, {c}, {v}::DOUBLE)" for r, line in enumerate(k) for c, v in enumerate(line))
    return f"{name}(dy, dx, wt) AS (VALUES {values})"


def _tap(axis: str, n: str, half: int, mode: str) -> str:
    at = f"(t.{axis} + k.d{axis} - {half})"
    if mode == "clamp":
        return f"greatest(0, least({n} - 1, {at}))"
    return f"least((({at} % (2 * {n} - 2)) + 2 * {n} - 2) % (2 * {n} - 2), 2 * {n} - 2 - (({at} % (2 * {n} - 2)) + 2 * {n} - 2) % (2 * {n} - 2))"


def _sums_sql(name: str, kernel: str, half: int, mode: str) -> str:
    taps = f"SELECT t.id, t.y, t.x, t.v, k.wt, {_tap('y', 't.h', half, mode)} AS oy, {_tap('x', 't.w', half, mode)} AS ox FROM t0 AS t, {kernel} AS k"
    return f"{name}p AS MATERIALIZED ({taps}), {name} AS (SELECT p.id, p.y, p.x, any_value(p.v) AS v, sum(p.wt * o.v) AS s FROM {name}p AS p JOIN t0 AS o ON o.id = p.id AND o.y = p.oy AND o.x = p.ox GROUP BY 1, 2, 3)"


def _diffusion_sql() -> str:
    spread = "list_transform(range(1, w + 3), lambda i: coalesce(ahead[i + 1], 0) + CASE WHEN i = 1 AND x < w - 1 THEN d * 7 / 16 WHEN i = w - 1 AND x > 0 THEN d * 3 / 16 WHEN i = w THEN d * 5 / 16 WHEN i = w + 1 AND x < w - 1 THEN d / 16 ELSE 0.0 END)"
    return f"""WITH RECURSIVE {RAGGED}, n AS (SELECT id, w, y * w + x AS t, v FROM t0),
        s AS (SELECT id, w, -1::BIGINT AS t, 0.0::DOUBLE AS q, [0.0::DOUBLE] AS ahead FROM (SELECT DISTINCT id, w FROM t0)
          UNION ALL SELECT id, w, t, q, {spread} AS ahead FROM (SELECT *, wanted - q AS d, t % w AS x FROM (SELECT *, greatest(0.0, least(1.0, floor(wanted * 7 + 0.5) / 7)) AS q FROM (SELECT s.id, s.w, n.t, n.v, s.ahead, n.v + CASE WHEN s.t < 0 THEN 0 ELSE s.ahead[1] END AS wanted FROM s JOIN n ON n.id = s.id AND n.t = s.t + 1))))
        SELECT id AS surface_id, (t // w)::INT AS y, (t % w)::INT AS x, round(q, 6) AS r FROM s WHERE t >= 0"""


DU = W.normalized(W.blended_sobel(1 / 1.875, 0.5 / 1.875, 0.25 / 1.875, 0.125 / 1.875))
DV = [list(row) for row in zip(*DU, strict=True)]


def _mips_sql() -> str:
    levels = [f"t{k + 1} AS (SELECT id, greatest(t.w // 2, 1) AS w, greatest(t.h // 2, 1) AS h, hy.dst AS y, hx.dst AS x, sum(v * hx.w * hy.w) AS v FROM t{k} AS t JOIN hv AS hx ON hx.b = t.w AND hx.src = x JOIN hv AS hy ON hy.b = t.h AND hy.src = y WHERE t.w > 1 OR t.h > 1 GROUP BY ALL)" for k in range(5)]
    parts = " UNION ALL ".join(f"SELECT id AS surface_id, {k} AS mip, y::INT AS y, x::INT AS x, round(v, 6) AS r FROM t{k}" for k in range(6))
    return f"WITH {RAGGED}, {HALVINGS}, {', '.join(levels)} {parts}"


def _polyphase(pairs: str, reach: float, f: str, wrap: str) -> str:
    """CTE pw (b, a, dst, src, w) for each different (b, a)."""
    return f"""pr AS (SELECT DISTINCT b, a FROM ({pairs}) WHERE a <> b),
  p1 AS (SELECT b, a, k, (k + 0.5) * b / a AS c, {reach}::DOUBLE * b / a AS reach, CASE WHEN a > b THEN 1 ELSE 32 END AS n FROM (SELECT *, unnest(range(a)) AS k FROM pr)),
  p2 AS (SELECT *, (floor(c - reach) + j)::INT AS i FROM (SELECT *, unnest(range(ceil(reach * 2)::INT + 1)) AS j FROM p1)),
  p3 AS (SELECT b, a, k, i, avg({f}) AS w FROM (SELECT b, a, k, i, (i - c + (s + 0.5) / n) * CASE WHEN a > b THEN 1 ELSE a / b::DOUBLE END AS u FROM (SELECT *, unnest(range(n)) AS s FROM p2)) GROUP BY b, a, k, i),
  pw AS (SELECT b, a, k AS dst, ({wrap})::INT AS src, sum(w / total) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY b, a, k) AS total FROM p3) GROUP BY 1, 2, 3, 4
         UNION ALL SELECT DISTINCT b, a, k, k, 1.0 FROM (SELECT b, a, unnest(range(a)) AS k FROM ({pairs}) WHERE a = b))"""


MIRROR = "CASE WHEN b = 1 THEN 0 ELSE least(((i % (2 * b - 2)) + 2 * b - 2) % (2 * b - 2), 2 * b - 2 - ((i % (2 * b - 2)) + 2 * b - 2) % (2 * b - 2)) END"


def _moved(source: str, w: str, h: str) -> str:
    return f"SELECT id, {w} AS w, {h} AS h, py.dst AS y, px.dst AS x, sum(v * px.w * py.w) AS v FROM {source} AS t JOIN pw AS px ON px.b = t.w AND px.a = {w} AND px.src = x JOIN pw AS py ON py.b = t.h AND py.a = {h} AND py.src = y GROUP BY ALL"


def _auto_sql() -> str:
    """l0 is the original; l1, l2, ... are the accepted levels, as many as the largest extent allows."""
    pairs = "SELECT n AS b, (n + 1) // 2 AS a FROM range(2, 33) AS ns(n)"
    out = []
    for k in range(4):
        out.append(f"c{k + 1} AS ({_moved(f'(SELECT * FROM l{k} WHERE (w + 1) // 2 >= 4 AND (h + 1) // 2 >= 4)', '((t.w + 1) // 2)', '((t.h + 1) // 2)')})")
        out.append(f"""k{k + 1} AS (SELECT o.id, o.y, o.x, any_value(o.v) AS v, sum(c.v * CASE WHEN dx = 0 THEN 1 - (o.ax - floor(o.ax)) ELSE o.ax - floor(o.ax) END * CASE WHEN dy = 0 THEN 1 - (o.ay - floor(o.ay)) ELSE o.ay - floor(o.ay) END) AS s
          FROM (SELECT t.*, z.w AS w2, z.h AS h2, x::DOUBLE / t.w * z.w AS ax, y::DOUBLE / t.h * z.h AS ay FROM t0 AS t JOIN (SELECT DISTINCT id, w, h FROM c{k + 1}) AS z USING (id)) AS o, (VALUES (0), (1)) AS xs(dx), (VALUES (0), (1)) AS ys(dy), c{k + 1} AS c
          WHERE c.id = o.id AND c.x = least(floor(o.ax) + dx, o.w2 - 1) AND c.y = least(floor(o.ay) + dy, o.h2 - 1) GROUP BY 1, 2, 3)""")
        out.append(f"g{k + 1} AS (SELECT id FROM k{k + 1} GROUP BY id HAVING sqrt(avg(4 * (v - s) ** 2)) < {TOLERANCE})")
        out.append(f"l{k + 1} AS (SELECT * FROM c{k + 1} WHERE id IN (SELECT id FROM g{k + 1}))")
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM l{k}" for k in range(5))
    return f"WITH {RAGGED}, l0 AS (SELECT * FROM t0), {_polyphase(pairs, 0.5, 'CASE WHEN abs(u) <= 0.5 THEN 1 ELSE 0 END', MIRROR)}, {', '.join(out)}, u AS ({every}) SELECT id AS surface_id, any_value(w)::INT AS width, any_value(h)::INT AS height, round(avg(v), 6) AS mean FROM u WHERE k = (SELECT max(k) FROM u AS q WHERE q.id = u.id) GROUP BY id"


def _passed(scale: str) -> str:
    v = {c: f"least(1.0, {c} * {scale})" for c in ("v00", "v01", "v10", "v11")}
    return " + ".join(f"(({v['v00']} * {1 - x} + {v['v01']} * {x}) * {1 - y} + ({v['v10']} * {1 - x} + {v['v11']} * {x}) * {y} > {REFERENCE})::INT" for y in (0.125, 0.375, 0.625, 0.875) for x in (0.125, 0.375, 0.625, 0.875))


QUADS = "q AS (SELECT a.id, a.v AS v00, b.v AS v01, c.v AS v10, d.v AS v11 FROM t0 a JOIN t0 b ON a.id = b.id AND b.y = a.y AND b.x = a.x + 1 JOIN t0 c ON a.id = c.id AND c.y = a.y + 1 AND c.x = a.x JOIN t0 d ON a.id = d.id AND d.y = a.y + 1 AND d.x = a.x + 1)"


def _scale_sql() -> str:
    steps = ["b0 AS (SELECT id, 0.0::DOUBLE AS low, 4.0::DOUBLE AS high, 1.0::DOUBLE AS scale, 1.0::DOUBLE AS best, 1e9::DOUBLE AS off, 0.0::DOUBLE AS got, false AS done FROM q GROUP BY id)"]
    for k in range(STEPS):
        steps.append(f"n{k} AS (SELECT id, low, high, scale, best, off, got, done, avg({_passed('scale')}) / 16 AS now FROM q JOIN b{k} USING (id) GROUP BY ALL)")
        steps.append(f"""b{k + 1} AS (SELECT id, low, high, (low + high) / 2 AS scale, best, off, got, done FROM (SELECT id, CASE WHEN now < {WANTED} THEN scale ELSE low END AS low, CASE WHEN now < {WANTED} THEN high ELSE scale END AS high,
          CASE WHEN better THEN scale ELSE best END AS best, CASE WHEN better THEN abs(now - {WANTED}) ELSE off END AS off, CASE WHEN better THEN now ELSE got END AS got, done OR now = {WANTED} AS done
          FROM (SELECT *, NOT done AND abs(now - {WANTED}) < off AS better FROM n{k})))""")
    return f"WITH {RAGGED}, {QUADS}, {', '.join(steps)} SELECT t0.id AS surface_id, round(best, 6) AS scale, round(any_value(got), 6) AS coverage, round(avg(least(1.0, v * best)), 6) AS mean FROM t0 JOIN b{STEPS} AS b USING (id) GROUP BY t0.id, best"


TO_W, TO_H = "((t.w * 2 + 2) // 3)", "(t.h + 3)"
_PAIRS = "SELECT w AS b, (w * 2 + 2) // 3 AS a FROM e UNION ALL SELECT h, h + 3 FROM e"
QUERIES = {"mixed_mips": mixed_mips, "mixed_resize": mixed_resize, "mixed_auto_resize": mixed_auto_resize, "mixed_coverage": mixed_coverage, "mixed_coverage_scale": mixed_coverage_scale,
           "mixed_convolve": mixed_convolve, "mixed_normals": mixed_normals, "diffusion_bands": diffusion_bands, "merged_colours": merged_colours}
SQL = {
    "mixed_mips": _mips_sql(),
    "mixed_resize": f"WITH {RAGGED}, {_polyphase(_PAIRS, 1.0, 'greatest(1 - abs(u), 0)', '((i % b) + b) % b')} SELECT id AS surface_id, y::INT AS y, x::INT AS x, round(v, 6) AS r, round(v, 6) AS a FROM ({_moved('t0', TO_W, TO_H)})",
    "mixed_auto_resize": _auto_sql(),
    "mixed_coverage": f"WITH {RAGGED}, {QUADS} SELECT id AS surface_id, round(avg({_passed('1')}) / 16, 6) AS coverage FROM q GROUP BY id",
    "mixed_coverage_scale": _scale_sql(),
    "mixed_convolve": f"WITH {RAGGED}, {_kernel_sql('kn', W.normalized(W.kernel('sobel5')))}, {_sums_sql('o', 'kn', 2, 'mirror')} SELECT id AS surface_id, y, x, round(v, 6) AS r, round(s, 6) AS sum FROM o",
    "mixed_normals": f"""WITH {RAGGED}, {_kernel_sql('ku', DU)}, {_kernel_sql('kv', DV)}, {_sums_sql('u', 'ku', 4, 'clamp')}, {_sums_sql('v', 'kv', 4, 'clamp')},
        l AS (SELECT u.id, u.y, u.x, u.v AS a, u.s AS r, v.s AS g, 1 / 16.0::DOUBLE AS b, sqrt(u.s * u.s + v.s * v.s + 1 / 256.0::DOUBLE) AS n FROM u JOIN v ON u.id = v.id AND u.y = v.y AND u.x = v.x)
        SELECT id AS surface_id, y, x, round(r / n, 6) AS r, round(g / n, 6) AS g, round(b / n, 6) AS b, round(a, 6) AS a FROM l""",
    "diffusion_bands": _diffusion_sql(),
    "merged_colours": _merged_sql(),
}
