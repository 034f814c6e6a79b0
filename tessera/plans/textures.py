"""Queries of block codes, texture sizes and formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.operators import codecs as C
from tessera.operators import stats as A
from tessera.operators.layout import FORMATS, format_table, levels, sizes
from tessera.plans.maps import BLOCKS
from tessera.sources import relations as S


def synthetic_codes(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """A code for each order, of its key's multiples."""
    o = S.table(spark, sf_dir, "orders")
    part = lambda m, a: C.code_bytes((F.col("o_orderkey") * m + a) % 2**32, 4)
    words = [part(40503, 7), part(2654435, 11), part(30011, 40503), part(1640531, 5)]
    return o.select(F.col("o_orderkey").alias("surface_id"), F.lit(0).alias("by"), F.lit(0).alias("bx"), F.concat(*words[: size // 4]).alias("code"))


def _decoded(fmt: str, decoder: str = "d3d10", bias: bool = False):
    size = (C.SIZES | C.ETC_SIZES)[fmt]
    return lambda spark, sf_dir: C.decode(synthetic_codes(spark, sf_dir, size), fmt, decoder, bias).select("surface_id", "y", "x", "r", "g", "b", "a")


def _encoded(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The codes of the atlas."""
        codes = C.encode(T.to_bytes(S.atlas(spark, sf_dir)), fmt)
        return codes.select("by", "bx", F.lower(F.hex("code")).alias("code"))

    return run


def _errors(texels: DataFrame, codes: DataFrame, fmt: str, channels: str) -> DataFrame:
    pairs = A.paired(texels, C.decode(codes, fmt))
    error = sum((F.pow(F.col(c) - F.col(f"{c}2"), 2) for c in channels), F.lit(0.0))
    return pairs.groupBy("surface_id", F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx")).agg(F.round(F.sqrt(F.avg(error)), 6).alias("rms"))


def encode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each format loses of each block of the atlas."""
    t, out = T.to_bytes(S.atlas(spark, sf_dir)), None
    for fmt, channels in (("bc1", "rgb"), ("bc2", "rgba"), ("bc3", "rgba"), ("bc4", "r"), ("bc5", "rg")):
        part = _errors(t, C.encode(t, fmt), fmt, channels).select(F.lit(fmt).alias("format"), "by", "bx", "rms")
        out = part if out is None else out.unionByName(part)
    return out


def encode_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which every texel with an alpha below a third is made transparent."""
    t = T.to_bytes(S.atlas(spark, sf_dir)).withColumn("a", F.when(F.col("a") < 85, 0).otherwise(F.col("a")))
    codes = C.encode(t, "bc1a")
    pairs = A.paired(t, C.decode(codes, "bc1a"))
    wrong = pairs.groupBy(F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx")).agg(F.sum(((F.col("a") < 128) != (F.col("a2") == 0)).cast("int")).alias("wrong"), F.min("a").alias("low"))
    return codes.join(wrong, ["by", "bx"]).select("by", "bx", F.lower(F.hex("code")).alias("code"), "wrong", "low")


def encode_rgbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of colour over M, and what is lost of the colours."""
    t = T.to_bytes(S.atlas(spark, sf_dir))
    codes = C.encode(t, "bc3_rgbm")
    m = F.col("a") / 255 * 0.75 + 0.25
    back = C.decode(codes, "bc3_rgbm").select("surface_id", "z", "y", "x", *[(F.col(c) * m).alias(c) for c in T.RGB], F.lit(255).alias("a"))
    errors = A.rms_error(A.paired(t, back).withColumn("surface_id", (F.floor(F.col("y") / 4) * 100000 + F.floor(F.col("x") / 4)).cast("long")))
    rows = codes.withColumn("surface_id", (F.col("by") * 100000 + F.col("bx")).cast("long")).join(errors, "surface_id")
    return rows.select("by", "bx", F.lower(F.hex("code")).alias("code"), F.round("rms", 6).alias("rms"))


def four_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four colours of each block of the atlas, and the mean square distance from them."""
    rows = C.four_means(C.gather(T.to_bytes(S.atlas(spark, sf_dir))))
    near = lambda x: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: sum((F.pow(x[c].cast("double") - F.element_at("means", (j * 3 + i + 1).cast("int")), 2) for i, c in enumerate("rgb")), F.lit(0.0))))
    error = F.aggregate(F.transform("t", near), F.lit(0.0), lambda s, x: s + x) / 16
    return rows.select("by", "bx", "clusters", F.transform("means", lambda m: F.round(m, 4)).alias("means"), F.round(error, 4).alias("error"))


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A texture for each part: extents and a format from its key and size."""
    p = S.table(spark, sf_dir, "part")
    names = F.array(*[F.lit(n) for n in FORMATS])
    return p.select(F.col("p_partkey").alias("surface_id"), (F.col("p_partkey") % 300 + 1).cast("int").alias("width"), (F.col("p_size") * 7 + 1).cast("int").alias("height"), F.lit(1).alias("depth"), F.get(names, (F.col("p_partkey") % len(FORMATS)).cast("int")).alias("format"))


def mip_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(_surfaces(spark, sf_dir)).select("surface_id", "format", "mip", "width", "height", "size", "offset")


def estimated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(_surfaces(spark, sf_dir))


def format_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surfaces(spark, sf_dir).join(format_table(spark), "format").select("surface_id", "format", "dxgi", "fourcc", "unit_bytes", "is_block")


def _ints(first: int) -> str:
    """The bytes of the synthetic codes as integers w0..w3."""
    rules = ((40503, 7), (2654435, 11), (30011, 40503), (1640531, 5))
    return "o AS (SELECT o_orderkey AS surface_id, " + ", ".join(f"((o_orderkey::HUGEINT * {m} + {a}) % 4294967296)::BIGINT AS w{i}" for i, (m, a) in enumerate(rules)) + f", w{first} % 65536 AS c0, w{first} // 65536 AS c1, w{first + 1} AS bits FROM orders)"


def _third(wa: int, wb: int, bias: int) -> str:
    return f"({wa} * {{c}}0 + {wb} * {{c}}1 + {bias}) // 3"


def _colour_sql(first: int, bias: int = 0) -> str:
    five = lambda e: f"(({e}) * 8 + ({e}) // 4)"
    six = "(({e}) * 4 + ({e}) // 16)"
    ends = ", ".join(f"{five(f'c{n} // 2048')} AS r{n}, {six.format(e=f'c{n} // 32 % 64')} AS g{n}, {five(f'c{n} % 32')} AS b{n}" for n in (0, 1))
    pick = lambda c: f"(CASE k WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 WHEN 2 THEN CASE WHEN c0 > c1 THEN {_third(2, 1, bias).format(c=c)} ELSE ({c}0 + {c}1) // 2 END ELSE CASE WHEN c0 > c1 THEN {_third(1, 2, bias).format(c=c)} ELSE 0 END END)::INT AS {c}"
    return f"{_ints(first)}, e AS (SELECT *, {ends} FROM o), x AS (SELECT *, (bits >> (2 * t)::INT) & 3 AS k FROM e, range(16) AS ts(t)), c AS (SELECT surface_id, t, w0, w1, (t // 4)::INT AS y, (t % 4)::INT AS x, {pick('r')}, {pick('g')}, {pick('b')}, (CASE WHEN c0 <= c1 AND k = 3 THEN 0 ELSE 255 END)::INT AS a FROM x)"


def _nv5x_sql() -> str:
    """Red and blue by 22 eighths, green by its difference in 256ths."""
    ends = ", ".join(f"c{n} // 2048 AS r{n}, (c{n} // 32 % 64) * 4 + (c{n} // 32 % 64) // 16 AS g{n}, c{n} % 32 AS b{n}" for n in (0, 1))
    thin = lambda c: f"(CASE k WHEN 0 THEN 3 * {c}0 * 22 // 8 WHEN 1 THEN 3 * {c}1 * 22 // 8 WHEN 2 THEN CASE WHEN c0 > c1 THEN (2 * {c}0 + {c}1) * 22 // 8 ELSE ({c}0 + {c}1) * 33 // 8 END ELSE CASE WHEN c0 > c1 THEN (2 * {c}1 + {c}0) * 22 // 8 ELSE 0 END END)::INT AS {c}"
    green = """(CASE k WHEN 0 THEN g0 WHEN 1 THEN g1 WHEN 2 THEN CASE WHEN c0 > c1 THEN floor((256 * g0 + trunc((g1 - g0) / 4.0) + 128 + (g1 - g0) * 80) / 256.0) ELSE floor((256 * g0 + trunc((g1 - g0) / 4.0) + 128 + (g1 - g0) * 128) / 256.0) END
      ELSE CASE WHEN c0 > c1 THEN floor((256 * g1 - trunc((g1 - g0) / 4.0) + 128 - (g1 - g0) * 80) / 256.0) ELSE 0 END END)::INT AS g"""
    return f"WITH {_ints(0)}, e AS (SELECT *, {ends} FROM o), x AS (SELECT *, (bits >> (2 * t)::INT) & 3 AS k FROM e, range(16) AS ts(t)) SELECT surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, {thin('r')}, {green}, {thin('b')}, (CASE WHEN c0 <= c1 AND k = 3 THEN 0 ELSE 255 END)::INT AS a FROM x"


def _ramp_sql(low: str, high: str, bias: tuple[int, int] = (0, 0)) -> str:
    a, b, k = f"({low} % 256)", f"({low} // 256 % 256)", f"((({low} // 65536 + {high}::HUGEINT * 65536) // (8 ** t)::HUGEINT) % 8)"
    return f"(CASE {k} WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE CASE WHEN {a} > {b} THEN ((8 - {k}) * {a} + ({k} - 1) * {b} + {bias[0]}) // 7 WHEN {k} = 6 THEN 0 WHEN {k} = 7 THEN 255 ELSE ((6 - {k}) * {a} + ({k} - 1) * {b} + {bias[1]}) // 5 END END)::INT"


def _swapped(w: str) -> str:
    """The same four bytes, read with the highest first."""
    return f"({w} % 256 * 16777216 + {w} // 256 % 256 * 65536 + {w} // 65536 % 256 * 256 + {w} // 16777216)"


def _eac_sql(first: int, wide: bool, out: str) -> str:
    """The value of texel t of a block of words w{first} and the next one."""
    word = f"({_swapped(f'w{first}')} % 65536 * 4294967296::BIGINT + {_swapped(f'w{first + 1}')})"
    base, times, row = f"(w{first} % 256)", f"(w{first} // 256 % 256 // 16)", f"(w{first} // 256 % 16)"
    table = "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in C.EAC_MODIFIERS) + "]"
    modifier = f"({table}[{row} + 1][({word} // (8 ** (15 - (4 * (t % 4) + t // 4)))::BIGINT) % 8 + 1])"
    if not wide:
        return f"greatest(0, least(255, {base} + {modifier} * {times}))::INT AS {out}"
    eleven = f"greatest(0, least(2047, {base} * 8 + 4 + CASE WHEN {times} = 0 THEN {modifier} ELSE {modifier} * 8 * {times} END))"
    return f"({eleven} * 32 + {eleven} // 64)::INT AS {out}"


def _etc_sql(first: int, alpha: str) -> str:
    """Texels of blocks whose colour words are w{first} and the next one: the mode, then the colour by mode."""
    f = lambda low, n, w="hi": f"({w} // {2**low} % {2**n})"
    signed = lambda e: f"(({e} + 4) % 8 - 4)"
    double = lambda e, n: f"({e} * {2 ** (8 - n)} + {e} // {2 ** (2 * n - 8)})"
    put = lambda e: f"greatest(0, least(255, {e}))"
    views = [f"n AS (SELECT *, {_swapped(f'w{first}')} AS hi, {_swapped(f'w{first + 1}')} AS lo FROM o)"]
    five = ", ".join(f"{f(27 - 8 * i, 5)} AS u{c}, {f(27 - 8 * i, 5)} + {signed(f(24 - 8 * i, 3))} AS v{c}" for i, c in enumerate("rgb"))
    four = ", ".join(f"{f(28 - 8 * i, 4)} * 17 AS i{c}, {f(24 - 8 * i, 4)} * 17 AS j{c}" for i, c in enumerate("rgb"))
    views.append(f"m AS (SELECT *, {five}, {four}, {f(1, 1)} AS diff, {f(0, 1)} AS flip FROM n)")
    views.append("""k AS (SELECT *, CASE WHEN diff = 1 AND (vr < 0 OR vr > 31) THEN 'T' WHEN diff = 1 AND (vg < 0 OR vg > 31) THEN 'H' WHEN diff = 1 AND (vb < 0 OR vb > 31) THEN 'P' ELSE 'E' END AS mode,
        t % 4 AS x, t // 4 AS y, lo // (2 ** (16 + 4 * (t % 4) + t // 4))::BIGINT % 2 * 2 + lo // (2 ** (4 * (t % 4) + t // 4))::BIGINT % 2 AS s FROM m, range(16) AS ts(t))""")
    steps = "[" + ", ".join(f"[{a}, {b}, -{a}, -{b}]" for a, b in C.ETC_STEPS) + "]"
    far = "[" + ", ".join(map(str, C.ETC_DISTANCES)) + "]"
    h0 = {"r": f(27, 4), "g": f"({f(24, 3)} * 2 + {f(20, 1)})", "b": f"({f(19, 1)} * 8 + {f(15, 3)})"}
    h1 = {"r": f(11, 4), "g": f(7, 4), "b": f(3, 4)}
    number = lambda h: f"({h['r']} * 256 + {h['g']} * 16 + {h['b']})"
    views.append(f"""d AS (SELECT *, CASE flip WHEN 1 THEN y // 2 ELSE x // 2 END AS half, {far}[{f(2, 2)} * 2 + {f(0, 1)} + 1] AS dt, {far}[{f(2, 1)} * 4 + {f(0, 1)} * 2 + ({number(h0)} >= {number(h1)})::INT + 1] AS dh FROM k)""")
    t0 = {"r": f"({f(27, 2)} * 4 + {f(24, 2)}) * 17", "g": f"{f(20, 4)} * 17", "b": f"{f(16, 4)} * 17"}
    t1 = {c: f"{f(12 - 4 * i, 4)} * 17" for i, c in enumerate("rgb")}
    plane = {
        "r": (double(f(25, 6), 6), double(f"({f(2, 5)} * 2 + {f(0, 1)})", 6), double(f(13, 6, "lo"), 6)),
        "g": (double(f"({f(24, 1)} * 64 + {f(17, 6)})", 7), double(f(25, 7, "lo"), 7), double(f(6, 7, "lo"), 7)),
        "b": (double(f"({f(16, 1)} * 32 + {f(11, 2)} * 8 + {f(7, 3)})", 6), double(f(19, 6, "lo"), 6), double(f(0, 6, "lo"), 6)),
    }
    def channel(c: str) -> str:
        base = f"CASE WHEN diff = 1 THEN CASE half WHEN 0 THEN {double(f'u{c}', 5)} ELSE {double(f'v{c}', 5)} END ELSE CASE half WHEN 0 THEN i{c} ELSE j{c} END END"
        e = put(f"({base}) + {steps}[CASE half WHEN 0 THEN {f(5, 3)} ELSE {f(2, 3)} END + 1][s + 1]")
        t = f"CASE s WHEN 0 THEN {t0[c]} ELSE {put(f'{t1[c]} + (2 - s) * dt')} END"
        h = put(f"CASE WHEN s < 2 THEN {h0[c]} ELSE {h1[c]} END * 17 + CASE WHEN s % 2 = 0 THEN dh ELSE -dh END")
        o, r, v = plane[c]
        p = put(f"floor((4 * {o} + x * ({r} - {o}) + y * ({v} - {o}) + 2) / 4.0)")
        return f"(CASE mode WHEN 'E' THEN {e} WHEN 'T' THEN {t} WHEN 'H' THEN {h} ELSE {p} END)::INT AS {c}"

    return f"WITH {_ints(0)}, {', '.join(views)} SELECT surface_id, y::INT AS y, x::INT AS x, {channel('r')}, {channel('g')}, {channel('b')}, {alpha} FROM d"


BLOCK_TEXELS = f"""{BLOCKS}, i AS (SELECT (surface_id // 20)::INT AS "by", (surface_id % 20)::INT AS bx, 4 * y + x AS t, trunc(r * 255)::INT AS r, trunc(g * 255)::INT AS g, trunc(b * 255)::INT AS b, trunc(a * 255)::INT AS a FROM b)"""


def _ramp_code_sql(name: str, channel: str) -> str:
    """Views that end in {name} (by, bx, code, e): ends from the bounds, then up to eight fits while the error falls."""
    eight = ", ".join(["a", "b", *[f"({8 - k} * a + {k - 1} * b) // 7" for k in range(2, 8)]])
    six = ", ".join(["a", "b", *[f"({6 - k} * a + {k - 1} * b) // 5" for k in range(2, 6)], "0", "255"])
    # the first of the nearest entries, and its distance
    look = f"list_transform(CASE WHEN a > b THEN [{eight}] ELSE [{six}] END, lambda p: (p - v) * (p - v))"
    indexed = lambda source: f"SELECT * EXCLUDE (far), list_position(far, list_min(far)) - 1 AS k, (sum(list_min(far)) OVER (PARTITION BY \"by\", bx))::BIGINT AS e FROM (SELECT *, {look} AS far FROM {source})"
    start = f"(SELECT \"by\", bx, t, v, hi - (hi - lo) // 34 AS a, lo + (hi - lo) // 34 AS b FROM (SELECT \"by\", bx, t, {channel} AS v, max({channel}) OVER w AS hi, min({channel}) OVER w AS lo FROM i WINDOW w AS (PARTITION BY \"by\", bx)))"
    w = "[7, 0, 6, 5, 4, 3, 2, 1][k + 1]"
    sums = f"(SELECT *, sum({w} * {w}) OVER q AS aa, sum({w} * (7 - {w})) OVER q AS ab, sum((7 - {w}) * (7 - {w})) OVER q AS bb, sum({w} * v) OVER q AS ax, sum((7 - {w}) * v) OVER q AS bx_ FROM {name}_r WHERE step < 8 AND live WINDOW q AS (PARTITION BY \"by\", bx))"
    fit = lambda n: f"greatest(0, least(255, floor(7 * ({n}) / (aa * bb - ab * ab))))"
    one, two = fit("ax * bb - bx_ * ab"), fit("bx_ * aa - ax * ab")
    moved = f"(SELECT step + 1 AS step, \"by\", bx, t, v, greatest({one}, {two})::INT AS a, least({one}, {two})::INT AS b, e AS before FROM {sums} WHERE aa * bb - ab * ab <> 0)"
    return f"""{name}_r AS (SELECT 0 AS step, "by", bx, t, v, a, b, k, e, true AS live FROM ({indexed(start)})
          UNION ALL SELECT step, "by", bx, t, v, a, b, k, e, e < before AS live FROM ({indexed(moved)})),
        {name}_b AS (SELECT * FROM {name}_r WHERE live QUALIFY step = max(step) OVER (PARTITION BY "by", bx)),
        {name} AS (SELECT "by", bx, printf('%02x%02x', any_value(a), any_value(b)) || {_hex_of('sum(k * (8 ** t)::BIGINT)::BIGINT', 6)} AS code, any_value(e) AS e FROM {name}_b GROUP BY 1, 2)"""


def _hex_of(value: str, count: int) -> str:
    return " || ".join(f"printf('%02x', ({value}) // {256**i} % 256)" for i in range(count))


def _bc1_sql() -> str:
    """Views that end in colour (by, bx, code)."""
    byte = {5: lambda e: f"(({e}) * 8 + ({e}) // 4)", 6: lambda e: f"(({e}) * 4 + ({e}) // 16)"}
    size = {"r": 5, "g": 6, "b": 5}

    def level(v: str, bits: int) -> str:
        top = 2**bits - 1
        low = f"floor(greatest(0.0, least({top}.0, {v} * ({top} / 255.0::DOUBLE))))::INT"
        return f"(CASE WHEN abs({v} - {byte[bits](f'{low} + 1')}) < abs({v} - {byte[bits](low)}) THEN least({low} + 1, {top}) ELSE {low} END)"

    packed = lambda p: f"({level(p + 'r', 5)} * 2048 + {level(p + 'g', 6)} * 32 + {level(p + 'b', 5)})"
    parts = {"r": "{c} // 2048", "g": "{c} // 32 % 64", "b": "{c} % 32"}
    ends = ", ".join(f"{byte[size[c]](parts[c].format(c=f'c{n}'))} AS p{n}{c}" for n in (0, 1) for c in "rgb")
    far = lambda p, q: " + ".join(f"(3 * {c} - {p} * p0{c} - {q} * p1{c}) ** 2" for c in "rgb")
    index = lambda source: f"SELECT *, CASE WHEN (d1 > d2 AND d0 > d2) OR (d0 > d3 AND d1 > d3) THEN 2 ELSE 0 END + CASE WHEN d0 > d3 AND d2 > d3 THEN 1 ELSE 0 END AS k FROM (SELECT *, {far(3, 0)} AS d0, {far(0, 3)} AS d1, {far(2, 1)} AS d2, {far(1, 2)} AS d3 FROM (SELECT *, {ends} FROM {source}))"
    table = lambda bits: f"m{bits} AS (SELECT v, first, second FROM (SELECT v, first, second, abs((2 * {byte[bits]('first')} + {byte[bits]('second')}) // 3 - v) * 100 + abs(first - second) * 3 AS cost FROM range(256) AS vs(v), range({2**bits}) AS fs(first), range({2**bits}) AS ss(second)) QUALIFY row_number() OVER (PARTITION BY v ORDER BY cost, second, first) = 1)"
    w = "[3, 0, 2, 1][k + 1]"
    sums = ", ".join(f"sum({w} * {c}) OVER q AS x{c}, sum((3 - {w}) * {c}) OVER q AS y{c}" for c in "rgb")
    one = ", ".join(f"greatest(0.0, least(255.0, ((x{c} * bb - y{c} * ab) * 3.0::DOUBLE) / (aa * bb - ab * ab))) AS n{c}, greatest(0.0, least(255.0, ((y{c} * aa - x{c} * ab) * 3.0::DOUBLE) / (aa * bb - ab * ab))) AS q{c}" for c in "rgb")
    inset = lambda h, l: f"(({h} - {l}) / 16.0::DOUBLE - 8 / 255.0::DOUBLE / 16)"  # noqa: E731, E741
    inner = ", ".join(f"greatest(0.0, least(255.0, h{c} - {inset(f'h{c}', f'l{c}')})) AS n{c}, greatest(0.0, least(255.0, l{c} + {inset(f'h{c}', f'l{c}')})) AS q{c}" for c in "rgb")
    bounds = ", ".join(f"max({c}) OVER q AS hi{c}, min({c}) OVER q AS lo{c}" for c in "rgb")
    return f"""{table(5)}, {table(6)},
        b0 AS (SELECT *, {bounds} FROM i WINDOW q AS (PARTITION BY "by", bx)),
        b1 AS (SELECT *, sum((2 * r - hir - lor) * (2 * b - hib - lob)) OVER q < 0 AS tr, sum((2 * g - hig - log_) * (2 * b - hib - lob)) OVER q < 0 AS tg FROM (SELECT * RENAME (log AS log_) FROM b0) WINDOW q AS (PARTITION BY "by", bx)),
        b2 AS (SELECT *, CASE WHEN tr THEN lor ELSE hir END AS hr, CASE WHEN tr THEN hir ELSE lor END AS lr, CASE WHEN tg THEN log_ ELSE hig END AS hg, CASE WHEN tg THEN hig ELSE log_ END AS lg, hib AS hb, lob AS lb FROM b1),
        b3 AS (SELECT "by", bx, t, r, g, b, hir = lor AND hig = log_ AND hib = lob AS alone, greatest({packed('n')}, {packed('q')}) AS c0, least({packed('n')}, {packed('q')}) AS c1 FROM (SELECT *, {inner} FROM b2)),
        b4 AS (SELECT "by", bx, t, r, g, b, alone, c0, c1, k FROM ({index('b3')})),
        b5 AS (SELECT *, sum({w} * {w}) OVER q AS aa, sum({w} * (3 - {w})) OVER q AS ab, sum((3 - {w}) * (3 - {w})) OVER q AS bb, {sums} FROM b4 WINDOW q AS (PARTITION BY "by", bx)),
        b6 AS (SELECT "by", bx, t, r, g, b, greatest({packed('n')}, {packed('q')}) AS c0, least({packed('n')}, {packed('q')}) AS c1 FROM (SELECT *, {one} FROM b5 WHERE aa * bb - ab * ab <> 0)),
        b7 AS (SELECT "by", bx, t, c0, c1, k FROM ({index('b6')}) UNION ALL SELECT "by", bx, t, c0, c1, k FROM b5 WHERE aa * bb - ab * ab = 0),
        b8 AS (SELECT "by", bx, any_value(c0) AS c0, any_value(c1) AS c1, sum(k * (4 ** t)::BIGINT)::BIGINT AS bits FROM b7 GROUP BY 1, 2),
        s0 AS (SELECT "by", bx, x.first * 2048 + y.first * 32 + z.first AS u, x.second * 2048 + y.second * 32 + z.second AS v FROM b3 JOIN m5 x ON x.v = r JOIN m6 y ON y.v = g JOIN m5 z ON z.v = b WHERE alone AND t = 0),
        colour AS (SELECT "by", bx, {_hex_of('c0', 2)} || {_hex_of('c1', 2)} || {_hex_of('bits', 4)} AS code
          FROM (SELECT "by", bx, coalesce(greatest(u, v), c0) AS c0, coalesce(least(u, v), c1) AS c1, CASE WHEN u IS NULL THEN bits WHEN u < v THEN 4294967295 ELSE 2863311530 END AS bits FROM b8 LEFT JOIN s0 USING ("by", bx)))"""


#: Fixed values, written out here and not taken from the code that they test.
FORMAT_ROWS = """f(i, format, dxgi, fourcc, unit_bytes, is_block) AS (VALUES (0, 'rgba', 28, '', 4, false), (1, 'bgra', 87, '', 4, false), (2, 'bc1', 71, 'DXT1', 8, true), (3, 'bc2', 74, 'DXT3', 16, true),
  (4, 'bc3', 77, 'DXT5', 16, true), (5, 'bc4', 80, 'ATI1', 8, true), (6, 'bc5', 83, 'ATI2', 16, true), (7, 'bc6', 95, '', 16, true), (8, 'bc7', 98, '', 16, true))"""
LEVELS = f"""{FORMAT_ROWS}, p AS (SELECT p_partkey AS surface_id, (p_partkey % 300 + 1)::INT AS w, (p_size * 7 + 1)::INT AS h, format, unit_bytes, is_block FROM part JOIN f ON i = p_partkey % {len(FORMATS)}),
  l AS (SELECT *, greatest(1, w >> mip)::INT AS width, greatest(1, h >> mip)::INT AS height FROM p, (SELECT x::INT AS mip FROM range(16) AS xs(x)) WHERE greatest(w, h) >> mip > 0),
  z AS (SELECT *, (CASE WHEN is_block THEN ((width + 3) // 4) * ((height + 3) // 4) ELSE width * height END * unit_bytes)::BIGINT AS size FROM l)"""
QUERIES = {f"decode_{f}": _decoded(f) for f in (*C.SIZES, *C.ETC_SIZES)} | {f"encode_{f}": _encoded(f) for f in ("bc1", "bc2", "bc3", "bc3n", "bc4", "bc5")}
QUERIES |= {"decode_bc1_nv5x": _decoded("bc1", "nv5x"), "decode_bc1_rounded": _decoded("bc1", bias=True), "decode_bc4_d3d9": _decoded("bc4", "d3d9"), "encode_errors": encode_errors, "encode_bc1a": encode_clear, "encode_rgbm": encode_rgbm, "four_means": four_means}
QUERIES |= {"mip_layout": mip_layout, "estimated_sizes": estimated_sizes, "format_codes": format_codes}
_NIBBLES = """alpha AS (SELECT "by", bx, string_agg(printf('%02x', low + 16 * high), '' ORDER BY h) AS code FROM (SELECT "by", bx, t // 2 AS h, max(CASE WHEN t % 2 = 0 THEN floor(a / 17.0 + 0.5)::INT END) AS low, max(CASE WHEN t % 2 = 1 THEN floor(a / 17.0 + 0.5)::INT END) AS high FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_JOINED = 'SELECT "by", bx, alpha.code || colour.code AS code FROM alpha JOIN colour USING ("by", bx)'
SQL = {
    "decode_bc1": f"WITH {_colour_sql(0)} SELECT surface_id, y, x, r, g, b, a FROM c",
    "decode_bc1_rounded": f"WITH {_colour_sql(0, 1)} SELECT surface_id, y, x, r, g, b, a FROM c",
    "decode_bc1_nv5x": _nv5x_sql(),
    "decode_bc2": f"WITH {_colour_sql(2)} SELECT surface_id, y, x, r, g, b, (17 * ((CASE WHEN t < 8 THEN w0 ELSE w1 END >> (4 * (t % 8))::INT) & 15))::INT AS a FROM c",
    "decode_bc3": f"WITH {_colour_sql(2)} SELECT surface_id, y, x, r, g, b, {_ramp_sql('w0', 'w1')} AS a FROM c",
    "decode_bc4": f"WITH {_ints(0)}, v AS (SELECT surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, {_ramp_sql('w0', 'w1')} AS v FROM o, range(16) AS ts(t)) SELECT surface_id, y, x, v AS r, v AS g, v AS b, 255 AS a FROM v",
    "decode_bc4_d3d9": f"WITH {_ints(0)}, v AS (SELECT surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, {_ramp_sql('w0', 'w1', (3, 2))} AS v FROM o, range(16) AS ts(t)) SELECT surface_id, y, x, v AS r, v AS g, v AS b, 255 AS a FROM v",
    "decode_bc5": f"WITH {_ints(0)} SELECT surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, {_ramp_sql('w0', 'w1')} AS r, {_ramp_sql('w2', 'w3')} AS g, 0 AS b, 255 AS a FROM o, range(16) AS ts(t)",
    "decode_etc2_rgb": _etc_sql(0, "255 AS a"),
    "decode_etc2_rgba": _etc_sql(2, _eac_sql(0, False, "a")),
    "decode_eac_r": f"WITH {_ints(0)} SELECT surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, {_eac_sql(0, True, 'r')}, 0 AS g, 0 AS b, 65535 AS a FROM o, range(16) AS ts(t)",
    "decode_eac_rg": f"WITH {_ints(0)} SELECT surface_id, (t // 4)::INT AS y, (t % 4)::INT AS x, {_eac_sql(0, True, 'r')}, {_eac_sql(2, True, 'g')}, 0 AS b, 65535 AS a FROM o, range(16) AS ts(t)",
    "encode_bc1": f'WITH RECURSIVE {BLOCK_TEXELS}, {_bc1_sql()} SELECT "by", bx, code FROM colour',
    "encode_bc2": f"WITH RECURSIVE {BLOCK_TEXELS}, {_bc1_sql()}, {_NIBBLES} {_JOINED}",
    "encode_bc3": f"WITH RECURSIVE {BLOCK_TEXELS}, {_bc1_sql()}, {_ramp_code_sql('alpha', 'a')} {_JOINED}",
    "encode_bc3n": f"WITH RECURSIVE {BLOCK_TEXELS.replace('AS (SELECT (surface_id // 20)', 'AS (SELECT * REPLACE (255 AS r, 0 AS b, r AS a) FROM (SELECT (surface_id // 20)') + ')'}, {_bc1_sql()}, {_ramp_code_sql('alpha', 'a')} {_JOINED}",
    "encode_bc4": f'WITH RECURSIVE {BLOCK_TEXELS}, {_ramp_code_sql("red", "r")} SELECT "by", bx, code FROM red',
    "encode_bc5": f'WITH RECURSIVE {BLOCK_TEXELS}, {_ramp_code_sql("red", "r")}, {_ramp_code_sql("green", "g")} SELECT "by", bx, red.code || green.code AS code FROM red JOIN green USING ("by", bx)',
    "mip_layout": f"WITH {LEVELS} SELECT surface_id, format, mip, width, height, size, (sum(size) OVER (PARTITION BY surface_id ORDER BY mip) - size)::BIGINT AS \"offset\" FROM z",
    "estimated_sizes": f"WITH {LEVELS} SELECT surface_id, format, count(*) AS mips, sum(size)::BIGINT AS bytes FROM z GROUP BY 1, 2",
    "format_codes": f"WITH {FORMAT_ROWS} SELECT p_partkey AS surface_id, format, dxgi, fourcc, unit_bytes, is_block FROM part JOIN f ON i = p_partkey % {len(FORMATS)}",
}
