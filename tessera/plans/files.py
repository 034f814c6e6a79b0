"""Queries that write and read containers, make textures, and diffuse errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import packing as K
from tessera.functions import texel as T
from tessera.operators import diffusion, stats
from tessera.operators.layout import levels, sizes
from tessera.plans.images import GRAY
from tessera.plans.maps import BLOCKS
from tessera.plans.packing import HALF
from tessera.plans.surface import Options, Surface, assembled, compressed, containers
from tessera.plans.textures import LEVELS, _ramp_code_sql, _surfaces
from tessera.sources import files
from tessera.sources import relations as S


def dds_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of a texture for each part, in the old form (null where the format has no code there) and the new."""
    rows = levels(_surfaces(spark, sf_dir)).where("mip = 0").join(sizes(_surfaces(spark, sf_dir)).select("surface_id", "mips"), "surface_id").where("is_block")
    head = lambda **new: files.dds_header(F.col("width"), F.col("height"), F.col("mips"), F.col("size"), [files.FOURCC, F.lit("DX10") if new else F.col("fourcc"), 0, 0, 0, 0, 0], **new)
    return rows.select("surface_id", F.when(F.col("fourcc") != "", F.lower(F.hex(head()))).alias("old"), F.lower(F.hex(head(dxgi=F.col("dxgi")))).alias("new"))


def dds_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from headers of cubes of each part's width, and of the first bytes of documents, which are none."""
    p = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("surface_id"), (F.col("p_size") * 4).alias("w"), F.expr("p_partkey % 5 + 1").alias("m"))
    head = files.dds_header(F.col("w"), F.col("w"), F.col("m"), F.col("w") * 2, files.pixel_format(16, (0xF800, 0x7E0, 0x1F, 0)), "cube", pitch=True)
    texts = S.table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("surface_id"), F.col("text").cast("binary").alias("content"))
    out = files.dds_info(p.select("surface_id", head.alias("content")).union(texts))
    return out.select("surface_id", "valid", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in ("width", "height", "mips", "faces", "bits", "g_mask", "payload")])


def dds_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks read back from containers of one channel."""
    made = containers(Surface(S.gray(spark, sf_dir), 8, 8), "bc4")
    return files.from_dds(made).select("surface_id", "by", "bx", "format", F.lower(F.hex("code")).alias("code"))


def dds_texels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers read back and decoded: the error of each surface."""
    t = T.to_bytes(S.gray(spark, sf_dir))
    back = files.decode_dds(containers(Surface(S.gray(spark, sf_dir), 8, 8), "bc4"))
    pairs = stats.paired(t, back)
    return pairs.groupBy("surface_id").agg(F.count(F.lit(1)).alias("texels"), F.round(F.sqrt(F.avg(F.pow(F.col("r") - F.col("r2"), 2))), 6).alias("rms"))


def dds_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faces of cubes, mirrored in turn, with all of their levels, read back."""
    one = Surface(S.gray(spark, sf_dir), 8, 8)
    parts = [one, one.flip("x"), one.flip("y"), one.flip("x").flip("y"), one, one.flip("x")]
    made = assembled(parts, "bc4", Options("bc4", gamma=1.0))
    return files.from_dds(made).select("surface_id", "face", "mip", "by", "bx", F.lower(F.hex("code")).alias("code"))


def dds_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of three images, whose header has the new form, read back."""
    one = Surface(S.gray(spark, sf_dir), 8, 8)
    made = assembled([one, one.flip("x"), one.flip("y")], "bc4", kind="array")
    info = files.dds_info(made).select("surface_id", "faces", "dxgi")
    return files.from_dds(made).join(info, "surface_id").select("surface_id", "face", "by", "bx", "faces", "dxgi", F.lower(F.hex("code")).alias("code"))


def _extents(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("surface_id"), F.lit(n).alias("width"), F.lit(n).alias("height"))


def _plain(bits: int, masks: tuple):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """4 x 4 surfaces in containers of plain texels, read back."""
        rows = K.uncompressed(S.blocks(spark, sf_dir), 4, masks=masks, bits=bits)
        back = files.plain_texels(files.plain_dds(rows, _extents(spark, sf_dir, 4), bits, masks))
        return back.select("surface_id", "y", "x", *[F.col(c).cast("int").alias(c) for c in S.CHANNELS])

    return run


def dds_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 surfaces in containers of halves, read back."""
    back = files.plain_texels(files.half_dds(S.blocks(spark, sf_dir), _extents(spark, sf_dir, 4), 4))
    return back.select("surface_id", "y", "x", *[F.round(c, 9).alias(c) for c in S.CHANNELS])


def dds_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as containers of one float a texel, a texel each."""
    t = S.hdr(spark, sf_dir).select((F.col("y").cast("long") * 50 + F.col("x")).alias("surface_id"), "z", F.lit(0).alias("y"), F.lit(0).alias("x"), *S.CHANNELS)
    # a row is a container: brought together once, for the rows of texels and for the container
    rows = K.uncompressed(t.repartition("surface_id"), 1, (32, 0, 0, 0), kind="float")
    back = files.plain_texels(files.plain_dds(rows, t.select("surface_id", F.lit(1).alias("width"), F.lit(1).alias("height")), 32, code=files.FLOAT_CODE))
    return back.select("surface_id", *[F.round(c, 5).alias(c) for c in S.CHANNELS])


def ppm_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.to_ppm(T.to_bytes(S.blocks(spark, sf_dir)), _extents(spark, sf_dir, 4))
    return made.select("surface_id", F.length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def tga_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.to_bytes(S.gray(spark, sf_dir))
    extents = t.select("surface_id").distinct().select("surface_id", F.lit(8).alias("width"), F.lit(8).alias("height"))
    return files.to_tga(t, extents).select("surface_id", F.length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full chains of block codes of each 8 x 8 surface, filtered in linear light, written to containers and read back."""
    made = containers(Surface(S.gray(spark, sf_dir), 8, 8), "bc4", Options("bc4"))
    return files.from_dds(made).select("surface_id", "mip", "by", "bx", F.lower(F.hex("code")).alias("code"))


def _diffused(carried: bool, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The first channel of each 8 x 8 surface, quantised with error diffusion."""
        out = diffusion.diffuse(S.gray(spark, sf_dir), channels=("r",), carried=carried, **how)
        return out.select("surface_id", "y", "x", F.round("r", 6).alias("r"))

    return run


def prepared_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 4 x 4 surfaces whose alpha was made binary and whose colours were quantised before encoding."""
    out = compressed(Surface(S.blocks(spark, sf_dir), 4, 4), Options("bc2", gamma=1.0, mips=False, quantize=True, binary_alpha=True))
    return out.select("surface_id", F.lower(F.hex(F.substring("code", 1, 8))).alias("alpha"))


def _diffusion_sql(carried: bool, level: str) -> str:
    """A step a texel, in the order of the scan: the errors that are still to come lie in a list."""
    error = "wanted - q" if carried else "v - q"
    spread = f"list_transform(range(1, 11), lambda i: coalesce(ahead[i + 1], 0) + CASE WHEN i = 1 AND x < 7 THEN d * 7 / 16 WHEN i = 7 AND x > 0 THEN d * 3 / 16 WHEN i = 8 THEN d * 5 / 16 WHEN i = 9 AND x < 7 THEN d / 16 ELSE 0.0 END)"
    return f"""WITH RECURSIVE {GRAY}, n AS (SELECT surface_id, y * 8 + x AS t, v FROM k),
        s AS (SELECT surface_id, -1::BIGINT AS t, 0.0::DOUBLE AS q, [0.0::DOUBLE] AS ahead FROM (SELECT DISTINCT surface_id FROM k)
          UNION ALL SELECT surface_id, t, q, {spread} AS ahead FROM (SELECT *, {error} AS d, t % 8 AS x FROM (SELECT *, {level} AS q FROM (SELECT s.surface_id, n.t, n.v, s.ahead, n.v + CASE WHEN s.t < 0 THEN 0 ELSE s.ahead[1] END AS wanted FROM s JOIN n ON n.surface_id = s.surface_id AND n.t = s.t + 1))))
        SELECT surface_id, (t // 8)::INT AS y, (t % 8)::INT AS x, round(q, 6) AS r FROM s WHERE t >= 0"""


def _level_codes_sql(views: str, key: str) -> str:
    """Codes of one channel of the texels of lv (id, mip, y, x, v bytes), blocks over an edge repeating what is inside."""
    return f"""{views}, sz AS (SELECT *, greatest(1, 8 >> mip) AS n FROM (SELECT DISTINCT id, mip FROM lv)),
        i AS (SELECT sz.id * 10 + sz.mip AS "by", (8 * b0 + b1)::INT AS bx, 4 * ty + tx AS t, lv.v AS r FROM sz, range(2) AS bs(b0), range(2) AS cs(b1), range(4) AS ys(ty), range(4) AS xs(tx), lv
              WHERE 4 * b0 < n AND 4 * b1 < n AND lv.id = sz.id AND lv.mip = sz.mip AND lv.y = 4 * b0 + ty % least(4, n - 4 * b0) AND lv.x = 4 * b1 + tx % least(4, n - 4 * b1)),
        {_ramp_code_sql('red', 'r')} SELECT {key}, bx // 8 AS "by", bx % 8 AS bx, code FROM red"""


def _mips_sql(gamma: float, source: str, ids: str) -> str:
    return f"lv AS (SELECT {ids} AS id, mip, y // (1 << mip) AS y, x // (1 << mip) AS x, trunc(greatest(0.0, least(1.0, pow(avg(pow(v, {gamma}::DOUBLE)), 1 / {gamma}::DOUBLE))) * 255)::INT AS v FROM {source}, (VALUES (0), (1), (2), (3)) AS ms(mip) GROUP BY 1, 2, 3, 4)"


FACES = """f AS (SELECT surface_id, face, CASE WHEN face IN (2, 3) THEN 7 - y ELSE y END AS y, CASE WHEN face IN (1, 3, 5) THEN 7 - x ELSE x END AS x, v FROM k, range(6) AS fs(face))"""


def _header_sql() -> str:
    """The words of headers, the lowest byte of each first."""
    word = lambda e: " || ".join(f"printf('%02x', ({e})::BIGINT // {256**i} % 256)" for i in range(4))
    many = lambda a, b: f"CASE WHEN mips > 1 THEN {a} ELSE {b} END"
    def head(code: str, tail: str) -> str:
        words = ["124", many(0xA1007, 0x81007), "height", "width", "size", "0", "mips"]
        return f"'44445320' || {' || '.join(word(w) for w in words)} || repeat('00', 44) || {word('32')} || {word('4')} || {code} || repeat('00', 20) || {word(many(0x401008, 0x1000))} || repeat('00', 16){tail}"

    code = "lower(hex(encode(fourcc)))"
    new = f" || {word('dxgi')} || {word('3')} || {word('0')} || {word('1')} || {word('0')}"
    return f"""WITH {LEVELS}, n AS (SELECT z.*, dxgi, fourcc, floor(log2(greatest(w, h)))::INT + 1 AS mips FROM z JOIN f ON f.format = z.format WHERE mip = 0 AND z.is_block)
        SELECT surface_id, CASE WHEN fourcc <> '' THEN {head(code, '')} END AS old, {head("'44583130'", new)} AS new FROM n"""


def _plain_sql(sizes_: tuple) -> str:
    """What is left of a channel of so many bits, expanded to a byte."""
    def channel(c: str, n: int) -> str:
        if not n:
            return f"{255 if c == 'a' else 0} AS {c}"
        v = f"(floor({c} * 65535 + 0.5)::BIGINT // {2 ** (16 - n)})"
        expanded = {1: f"{v} * 255", 4: f"{v} * 17", 5: f"{v} * 8 + {v} // 4", 6: f"{v} * 4 + {v} // 16", 8: v}[n]
        return f"({expanded})::INT AS {c}"

    return f"WITH {BLOCKS} SELECT surface_id, y, x, {', '.join(channel(c, n) for c, n in zip('rgba', sizes_, strict=True))} FROM b"


_PLAIN = {"dds_8888": (32, (0xFF0000, 0xFF00, 0xFF, 0xFF000000), (8, 8, 8, 8)), "dds_565": (16, (0xF800, 0x7E0, 0x1F, 0), (5, 6, 5, 0)), "dds_1555": (16, (0x7C00, 0x3E0, 0x1F, 0x8000), (5, 5, 5, 1)), "dds_888": (24, (0xFF, 0xFF00, 0xFF0000, 0), (8, 8, 8, 0))}
QUERIES = {
    "dds_headers": dds_headers, "dds_info": dds_info, "dds_round_trip": dds_round_trip, "dds_texels": dds_texels, "dds_cube": dds_cube, "dds_array": dds_array, "dds_halves": dds_halves, "dds_floats": dds_floats, "ppm_files": ppm_files, "tga_files": tga_files,
    "texture_chains": textures, "prepared_codes": prepared_codes, "error_diffusion": _diffused(False, threshold=0.5), "error_diffusion_carried": _diffused(True, threshold=0.5), "error_diffusion_levels": _diffused(False, bits=3),
} | {name: _plain(bits, masks) for name, (bits, masks, _) in _PLAIN.items()}
_UNHALF = "CASE WHEN {c} < 1024 THEN {c} * pow(2.0, -24) ELSE (1 + {c} % 1024 / 1024.0::DOUBLE) * pow(2.0, {c} // 1024 - 15) END"
SQL = {name: _plain_sql(kept) for name, (_, _, kept) in _PLAIN.items()} | {
    "dds_headers": _header_sql(),
    "dds_info": """SELECT p_partkey AS surface_id, true AS valid, p_size * 4 AS width, p_size * 4 AS height, (p_partkey % 5 + 1)::INT AS mips, 6 AS faces, 16 AS bits, 2016::BIGINT AS g_mask, 128 AS payload FROM part
        UNION ALL SELECT -doc_id - 1, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents""",
    "dds_round_trip": f"WITH RECURSIVE {GRAY}, " + _level_codes_sql("lv AS (SELECT surface_id AS id, 0 AS mip, y, x, trunc(v * 255)::INT AS v FROM k)", """\"by\" // 10 AS surface_id, 'bc4' AS format""").replace("SELECT \"by\" // 10 AS surface_id, 'bc4' AS format, bx // 8 AS \"by\"", "SELECT \"by\" // 10 AS surface_id, 'bc4' AS format, (bx // 8)::INT AS \"by\""),
    "dds_texels": f"WITH RECURSIVE {GRAY}, " + _level_codes_sql("lv AS (SELECT surface_id AS id, 0 AS mip, y, x, trunc(v * 255)::INT AS v FROM k)", "e").split(" SELECT e, ")[0] + """ SELECT "by" // 10 AS surface_id, (count(*) * 16)::BIGINT AS texels, round(sqrt(sum(e) / (16.0::DOUBLE * count(*))), 6) AS rms FROM red GROUP BY 1""",
    "texture_chains": f"WITH RECURSIVE {GRAY}, " + _level_codes_sql(_mips_sql(2.2, "k", "surface_id"), '"by" // 10 AS surface_id, ("by" % 10)::INT AS mip'),
    "dds_cube": f"WITH RECURSIVE {GRAY}, {FACES}, " + _level_codes_sql(_mips_sql(1.0, "f", "surface_id * 6 + face"), '"by" // 60 AS surface_id, ("by" // 10 % 6)::INT AS face, ("by" % 10)::INT AS mip'),
    "dds_array": f"WITH RECURSIVE {GRAY}, {FACES}, " + _level_codes_sql("lv AS (SELECT surface_id * 6 + face AS id, 0 AS mip, y, x, trunc(v * 255)::INT AS v FROM f WHERE face < 3)", '"by" // 60 AS surface_id, ("by" // 10 % 6)::INT AS face, 3 AS faces, 80 AS dxgi'),
    "dds_halves": f"WITH {BLOCKS}, f AS (SELECT surface_id, y, x, " + ", ".join(f"{c}::FLOAT::DOUBLE AS {c}" for c in "rgba") + " FROM b), h AS (SELECT surface_id, y, x, " + ", ".join(f"({HALF.format(v=c)})::BIGINT AS {c}" for c in "rgba") + " FROM f) SELECT surface_id, y, x, " + ", ".join(f"round({_UNHALF.format(c=c)}, 9) AS {c}" for c in "rgba") + " FROM h",
    "dds_floats": "SELECT event_id AS surface_id, round((coalesce(value, 0) / 100)::FLOAT::DOUBLE, 5) AS r, 0.0::DOUBLE AS g, 0.0::DOUBLE AS b, 1.0::DOUBLE AS a FROM events",
    "ppm_files": f"""WITH {BLOCKS}, p AS (SELECT surface_id, encode('P6' || chr(10) || '4 4' || chr(10) || '255' || chr(10)) || unhex(string_agg(printf('%02x%02x%02x', trunc(r * 255)::INT, trunc(g * 255)::INT, trunc(b * 255)::INT), '' ORDER BY y, x)) AS data FROM b GROUP BY 1)
        SELECT surface_id, octet_length(data)::INT AS n_bytes, sha256(data) AS sha256 FROM p""",
    "tga_files": f"""WITH {GRAY}, p AS (SELECT surface_id, string_agg(repeat(printf('%02x', trunc(v * 255)::INT), 4), '' ORDER BY y, x) AS body FROM k GROUP BY 1)
        SELECT surface_id, (octet_length(unhex('000002000000000000000000080008002028' || body)))::INT AS n_bytes, sha256(unhex('000002000000000000000000080008002028' || body)) AS sha256 FROM p""",
    "prepared_codes": f"WITH {BLOCKS}, n AS (SELECT surface_id, y, x // 2 AS h, sum(CASE WHEN a > 0.5 THEN CASE x % 2 WHEN 0 THEN 15 ELSE 240 END ELSE 0 END)::INT AS v FROM b GROUP BY 1, 2, 3) SELECT surface_id, string_agg(printf('%02x', v), '' ORDER BY y, h) AS alpha FROM n GROUP BY 1",
    "error_diffusion": _diffusion_sql(False, "CASE WHEN wanted > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END"),
    "error_diffusion_carried": _diffusion_sql(True, "CASE WHEN wanted > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END"),
    "error_diffusion_levels": _diffusion_sql(False, "greatest(0.0, least(1.0, floor(wanted * 7 + 0.5) / 7))"),
}
