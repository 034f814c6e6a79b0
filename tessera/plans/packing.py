"""Queries of packed numbers and plain texel formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import packing as K
from tessera.functions import texel as T
from tessera.plans.maps import BLOCKS, HDR
from tessera.sources import relations as S

R5G6B5, A1R5G5B5, A2R10G10B10, L8A8 = (0xF800, 0x7E0, 0x1F, 0), (0x7C00, 0x3E0, 0x1F, 0x8000), (0x3FF00000, 0xFFC00, 0x3FF, 0xC0000000), (0xFF, 0, 0, 0xFF00)


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, discounts and their products as halves, and back."""
    v = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.array(F.col("l_extendedprice"), F.col("l_discount") * -1e-4, F.col("l_tax") * 1e-6, F.col("l_quantity") * F.col("l_discount"))).alias("v"))
    out = v.select("l_orderkey", "l_partkey", "l_suppkey", "v", K.to_half(F.col("v")).alias("bits"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", F.round("v", 9).alias("v"), "bits", F.round(K.from_half(F.col("bits")), 9).alias("back"))


def packed_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as 11-, 11- and 10-bit floats, as mantissas with a shared exponent of either kind, and back."""
    t = S.hdr(spark, sf_dir)
    f11, f10 = K.to_small_float(F.col("r"), 6), K.to_small_float(F.col("b"), 5)
    t = t.select("y", "x", f11.alias("f11"), f10.alias("f10"), K.to_9995(F.col("r"), F.col("g"), F.col("b")).alias("shared"), K.to_rgbe8(F.col("r"), F.col("g"), F.col("b")).alias("rgbe"))
    back = [K.from_small_float(F.col("f11"), 6), K.from_small_float(F.col("f10"), 5), K.from_9995(F.col("shared"))[1], K.from_rgbe8(F.col("rgbe"))[2]]
    return t.select("*", *[F.round(c, 6).alias(n) for c, n in zip(back, ("r11", "b10", "g9", "b8"), strict=True)])


def _packed(masks, bits: int, alignment: int = 1):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The rows of the 4 x 4 surfaces as bytes."""
        rows = K.uncompressed(S.blocks(spark, sf_dir), 4, masks=masks, bits=bits, alignment=alignment)
        return rows.select("surface_id", "y", F.lower(F.hex("data")).alias("data"))

    return run


def packed_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.uncompressed(S.blocks(spark, sf_dir), 4, (16, 16, 16, 16), kind="float")
    return rows.select("surface_id", "y", F.lower(F.hex("data")).alias("data"))


def packed_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.uncompressed(S.blocks(spark, sf_dir), 4, (9, 9, 9, 5), kind="shared")
    return rows.select("surface_id", "y", F.lower(F.hex("data")).alias("data"))


def unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit texels with a bit of alpha, read back as bytes."""
    t = S.blocks(spark, sf_dir).withColumn("bits", K.pack_unorm(tuple(F.col(c) for c in S.CHANNELS), A1R5G5B5))
    return t.select("surface_id", "y", "x", "bits", *[c.alias(n) for c, n in zip(K.unpack_unorm(F.col("bits"), A1R5G5B5), S.CHANNELS, strict=True)])


def _bytes(of):
    return lambda spark, sf_dir: of(T.to_bytes(S.blocks(spark, sf_dir))).select("surface_id", "y", "x", *S.CHANNELS)


def hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each texel's hue, and its perceptual distance from its own 5-6-5 form."""
    b = S.blocks(spark, sf_dir)
    pairs = b.join(T.quantize_sizes(b).select(*S.PLACE, *[F.col(c).alias(f"{c}2") for c in T.RGB]), list(S.PLACE))
    far = T.colour_distance((F.col("r"), F.col("g"), F.col("b")), (F.col("r2"), F.col("g2"), F.col("b2")))
    return pairs.select("surface_id", "y", "x", F.round(K.hue(F.col("r"), F.col("g"), F.col("b")), 6).alias("hue"), F.round(far, 6).alias("distance"))


def _hex_sql(value: str, bits: int) -> str:
    """The bytes of an unsigned integer, the lowest first."""
    return " || ".join(f"printf('%02x', ({value}) // {256**i} % 256)" for i in range(bits // 8))


def _wide(c: str, size: int) -> str:
    return f"(floor({c} * 65535 + 0.5)::BIGINT // {2 ** (16 - size)})"


def _row_sql(value: str, bits: int, pad: str = "") -> str:
    return f"WITH {BLOCKS}, p AS (SELECT surface_id, y, x, ({value})::BIGINT AS p FROM b) SELECT surface_id, y, string_agg({_hex_sql('p', bits)}, '' ORDER BY x) || '{pad}' AS data FROM p GROUP BY 1, 2"


_EXPONENT = "floor(log2(abs({v})))"
HALF = """CASE WHEN {v} = 0 THEN 0 WHEN abs({v}) >= pow(2.0, -14) THEN CASE WHEN floor(abs({v}) / pow(2.0, floor(log2(abs({v}))) - 10) + 0.5) = 2048 THEN (floor(log2(abs({v}))) + 16) * 1024 ELSE (floor(log2(abs({v}))) + 15) * 1024 + floor(abs({v}) / pow(2.0, floor(log2(abs({v}))) - 10) + 0.5) - 1024 END
  ELSE floor(CASE WHEN floor(abs({v}) / pow(2.0, floor(log2(abs({v}))) - 10) + 0.5) = 2048 THEN 1024 ELSE floor(abs({v}) / pow(2.0, floor(log2(abs({v}))) - 10) + 0.5) END * pow(2.0, floor(log2(abs({v}))) + 14)) END"""
_BACK = "CASE WHEN bits % 32768 < 1024 THEN bits % 1024 * pow(2.0, -24) WHEN bits % 32768 >= 31744 THEN 'inf'::DOUBLE ELSE (1 + bits % 1024 / 1024.0::DOUBLE) * pow(2.0, bits % 32768 // 1024 - 15) END * CASE WHEN bits >= 32768 THEN -1 ELSE 1 END"
_SMALL = "(CASE WHEN {c} < pow(2.0, -14) THEN 0 ELSE (floor(log2({c})) + 15) * {m} + floor(({c} / pow(2.0, floor(log2({c}))) - 1) * {m}) END)::BIGINT"
_UNSMALL = "CASE WHEN {c} < {m} THEN 0 ELSE (1 + {c} % {m} / {m}.0::DOUBLE) * pow(2.0, {c} // {m} - 15) END"
QUERIES = {
    "half_floats": halves, "packed_floats": packed_floats, "pack_565": _packed(R5G6B5, 16), "pack_2101010": _packed(A2R10G10B10, 32), "pack_88": _packed(L8A8, 16, 16), "pack_24": _packed((0xFF0000, 0xFF00, 0xFF, 0), 24, 16),
    "pack_12": _packed((0xF00, 0xF0, 0xF, 0), 12), "pack_half": packed_halves, "pack_shared": packed_shared, "unpack_1555": unpacked, "truncate_565": _bytes(K.truncated), "alpha4": _bytes(lambda t: K.truncated(t, (8, 8, 8, 4))), "binary_alpha": _bytes(K.binary_alpha), "hues": hues,
}
SQL = {
    "half_floats": f"""WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, v, v::FLOAT::DOUBLE AS f FROM (SELECT *, unnest([l_extendedprice, l_discount * -1e-4::DOUBLE, l_tax * 1e-6::DOUBLE, l_quantity * l_discount]) AS v FROM lineitem)),
        h AS (SELECT *, CASE WHEN abs(f) >= 65520 THEN 31744 ELSE ({HALF.format(v='f')})::BIGINT END + CASE WHEN f < 0 THEN 32768 ELSE 0 END AS bits FROM v)
        SELECT l_orderkey, l_partkey, l_suppkey, round(v, 9) AS v, bits, round({_BACK}, 9) AS back FROM h""",
    "packed_floats": f"""WITH {HDR}, f AS (SELECT y, x, r::FLOAT::DOUBLE AS fr, b::FLOAT::DOUBLE AS fb, r, g, b, greatest(r, g, b) AS m FROM b),
        e AS (SELECT *, CASE WHEN m > 0 THEN greatest(-16, floor(log2(m))) ELSE -16 END + 16 AS e0 FROM f), u AS (SELECT *, e0 + (floor(m / pow(2.0, e0 - 24) + 0.5) = 512)::INT AS e FROM e),
        p AS (SELECT y, x, {_SMALL.format(c='fr', m=64)} AS f11, {_SMALL.format(c='fb', m=32)} AS f10,
              (floor(r / pow(2.0, e - 24) + 0.5) + 512 * floor(g / pow(2.0, e - 24) + 0.5) + 262144 * floor(b / pow(2.0, e - 24) + 0.5) + 134217728 * e)::BIGINT AS shared,
              CASE WHEN m < 1e-32 THEN 0 ELSE (least(255, floor(r * pow(2.0, 7 - floor(log2(m))) + 0.5)) + 256 * least(255, floor(g * pow(2.0, 7 - floor(log2(m))) + 0.5)) + 65536 * least(255, floor(b * pow(2.0, 7 - floor(log2(m))) + 0.5)) + 16777216 * (floor(log2(m)) + 129))::BIGINT END AS rgbe FROM u)
        SELECT *, round({_UNSMALL.format(c='f11', m=64)}, 6) AS r11, round({_UNSMALL.format(c='f10', m=32)}, 6) AS b10, round(shared // 512 % 512 * pow(2.0, shared // 134217728 - 24), 6) AS g9,
               round(CASE WHEN rgbe // 16777216 = 0 THEN 0 ELSE rgbe // 65536 % 256 * pow(2.0, rgbe // 16777216 - 136) END, 6) AS b8 FROM p""",
    "pack_565": _row_sql(f"{_wide('r', 5)} * 2048 + {_wide('g', 6)} * 32 + {_wide('b', 5)}", 16),
    "pack_2101010": _row_sql(f"{_wide('a', 2)} * 1073741824 + {_wide('r', 10)} * 1048576 + {_wide('g', 10)} * 1024 + {_wide('b', 10)}", 32),
    "pack_88": _row_sql(f"{_wide('a', 8)} * 256 + {_wide('r', 8)}", 16, "00" * 8),
    "pack_24": _row_sql(f"{_wide('r', 8)} * 65536 + {_wide('g', 8)} * 256 + {_wide('b', 8)}", 24, "00" * 4),
    "pack_12": f"WITH {BLOCKS}, p AS (SELECT surface_id, y, x, ({_wide('r', 4)} * 256 + {_wide('g', 4)} * 16 + {_wide('b', 4)})::BIGINT AS p FROM b), w AS (SELECT surface_id, y, sum(p * (4096 ** x)::BIGINT)::BIGINT AS w FROM p GROUP BY 1, 2) SELECT surface_id, y, {_hex_sql('w', 48)} AS data FROM w",
    "pack_half": f"WITH {BLOCKS}, f AS (SELECT surface_id, y, x, r::FLOAT::DOUBLE AS r, g::FLOAT::DOUBLE AS g, b::FLOAT::DOUBLE AS b, a::FLOAT::DOUBLE AS a FROM b), h AS (SELECT surface_id, y, x, " + ", ".join(f"({HALF.format(v=c)})::BIGINT AS {c}" for c in "rgba") + " FROM f) SELECT surface_id, y, string_agg(" + " || ".join(_hex_sql(c, 16) for c in "rgba") + ", '' ORDER BY x) AS data FROM h GROUP BY 1, 2",
    "pack_shared": f"""WITH {BLOCKS}, m AS (SELECT *, greatest(r, g, b) AS m FROM b), e AS (SELECT *, CASE WHEN m > 0 THEN greatest(-16, floor(log2(m))) ELSE -16 END + 16 AS e0 FROM m), u AS (SELECT *, e0 + (floor(m / pow(2.0, e0 - 24) + 0.5) = 512)::INT AS e FROM e),
        p AS (SELECT surface_id, y, x, (floor(r / pow(2.0, e - 24) + 0.5) + 512 * floor(g / pow(2.0, e - 24) + 0.5) + 262144 * floor(b / pow(2.0, e - 24) + 0.5) + 134217728 * e)::BIGINT AS p FROM u) SELECT surface_id, y, string_agg({_hex_sql('p', 32)}, '' ORDER BY x) AS data FROM p GROUP BY 1, 2""",
    "unpack_1555": f"WITH {BLOCKS}, p AS (SELECT surface_id, y, x, {_wide('r', 5)} AS r, {_wide('g', 5)} AS g, {_wide('b', 5)} AS b, {_wide('a', 1)} AS a FROM b) SELECT surface_id, y, x, a * 32768 + r * 1024 + g * 32 + b AS bits, (r * 8 + r // 4)::INT AS r, (g * 8 + g // 4)::INT AS g, (b * 8 + b // 4)::INT AS b, (a * 255)::INT AS a FROM p",
    "truncate_565": f"WITH {BLOCKS}, i AS (SELECT surface_id, y, x, trunc(r * 255)::INT AS r, trunc(g * 255)::INT AS g, trunc(b * 255)::INT AS b, trunc(a * 255)::INT AS a FROM b) SELECT surface_id, y, x, (r // 8 * 8 + r // 32)::INT AS r, (g // 4 * 4 + g // 64)::INT AS g, (b // 8 * 8 + b // 32)::INT AS b, a FROM i",
    "alpha4": f"WITH {BLOCKS} SELECT surface_id, y, x, trunc(r * 255)::INT AS r, trunc(g * 255)::INT AS g, trunc(b * 255)::INT AS b, (trunc(a * 255)::INT // 16 * 17)::INT AS a FROM b",
    "binary_alpha": f"WITH {BLOCKS} SELECT surface_id, y, x, trunc(r * 255)::INT AS r, trunc(g * 255)::INT AS g, trunc(b * 255)::INT AS b, (CASE WHEN trunc(a * 255) > 127 THEN 255 ELSE 0 END)::INT AS a FROM b",
    "hues": f"""WITH {BLOCKS}, q AS (SELECT *, floor(r * 31 + 0.5) / 31 AS r2, floor(g * 63 + 0.5) / 63 AS g2, floor(b * 31 + 0.5) / 31 AS b2 FROM b)
        SELECT surface_id, y, x, round(atan2(sqrt(3.0) * (g - b), 2 * r - g - b) / (2 * pi()) + 0.5, 6) AS hue, round(sqrt((2 + (r + r2) / 2) * (r - r2) ** 2 + 4 * (g - g2) ** 2 + (3 - (r + r2) / 2) * (b - b2) ** 2), 6) AS distance FROM q""",
}
