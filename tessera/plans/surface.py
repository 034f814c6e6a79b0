"""Surface: texels with their metadata, and calls that add to their plan. Nothing runs until a result is asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import texel as T
from tessera.operators import codecs, filters, space, stats
from tessera.operators.diffusion import diffuse
from tessera.operators.layout import target_extent
from tessera.operators.sampling import bilinear_rms
from tessera.sources.files import to_dds


@dataclass(frozen=True)
class Surface:
    """Surfaces of one extent: df is (surface_id, z, y, x, r, g, b, a)."""

    df: DataFrame
    width: int
    height: int
    wrap: str = "mirror"
    alpha: str = "none"  # or transparency, premultiplied
    is_normal: bool = False

    def map(self, of, *args, **kwargs) -> Surface:
        """Any map of tessera.functions.texel."""
        return replace(self, df=of(self.df, *args, **kwargs))

    def to_linear(self, gamma: float = 2.2) -> Surface:
        return self.map(T.to_linear, gamma)

    def to_gamma(self, gamma: float = 2.2) -> Surface:
        return self.map(T.to_gamma, gamma)

    def resize(self, width: int, height: int, shape: filters.Filter | None = None) -> Surface:
        df = filters.resize(self.df, (self.width, self.height), (width, height), shape, self.wrap)
        return replace(self, df=df, width=width, height=height)

    def fitted(self, limit: int = 0, rounding: str = "none") -> Surface:
        return self.resize(*target_extent(self.width, self.height, limit, rounding))

    def next_mip(self, shape: filters.Filter | None = None) -> Surface:
        if shape is not None:
            return self.resize(*filters.next_extent((self.width, self.height)), shape)
        width, height = filters.next_extent((self.width, self.height))
        return replace(self, df=filters.fast_down_sample(self.df, (self.width, self.height)), width=width, height=height)

    def has_next_mip(self, least: int = 1) -> bool:
        return max(self.width, self.height) > least

    def auto_resized(self, tolerance: float, shape: filters.Filter | None = None) -> Surface:
        """Halved (odd extents up) as long as the result, sampled back, stays within the bilinear error on average and
        both sides are at least four: one aggregate a step."""
        out = self
        while min(out.width, out.height) >= 4:
            half = out.resize((out.width + 1) // 2, (out.height + 1) // 2, shape)
            rms = bilinear_rms(out.df, (out.width, out.height), half.df, (half.width, half.height)).agg(F.avg("rms")).first()[0]
            if rms is None or rms >= tolerance:
                break
            out = half
        return out

    def flip(self, axis: str) -> Surface:
        return self.map(space.flip, axis, {"x": self.width, "y": self.height}[axis])

    def squared(self, shape: filters.Filter | None = None, rounding: str = "none") -> Surface:
        """Both sides as long as the rounded mean of them."""
        return self.resize(*target_extent(self.width, self.height, 0, rounding, "cube"), shape)

    def normal_map(self) -> Surface:
        return replace(self, df=filters.to_normal_map(self.df, (self.width, self.height), mode=self.wrap), is_normal=True)

    def error(self, other: Surface) -> DataFrame:
        """(surface_id, rms); of different extents FLT_MAX for each surface."""
        if (self.width, self.height) != (other.width, other.height):
            return self.df.select("surface_id").distinct().withColumn("rms", F.lit(stats.FLT_MAX))
        return stats.rms_error(stats.paired(self.df, other.df), self.alpha == "transparency")


@dataclass(frozen=True)
class Options:
    """How textures are made: mip levels are filtered in linear light, and each is encoded from a gamma copy."""

    fmt: str = "bc1"
    gamma: float = 2.2
    mips: bool = True
    shape: filters.Filter | None = None
    limit: int = 0
    rounding: str = "none"
    height_map: bool = False
    dither: bool = False  # colours to 5-6-5 levels with error diffusion before encoding
    quantize: bool = False  # the same without diffusion
    binary_alpha: bool = False
    alpha_threshold: float = 0.5


def prepared(texels: DataFrame, options: Options) -> DataFrame:
    """What is quantised before encoding: colours of the formats with 5-6-5 ends, and alpha to two values."""
    if options.fmt in ("bc1", "bc1a", "bc2", "bc3") and options.dither:
        for channel, bits in zip("rgb", (5, 6, 5), strict=True):
            texels = diffuse(texels, bits, channels=(channel,))
    elif options.fmt in ("bc1", "bc1a", "bc2", "bc3") and options.quantize:
        texels = T.quantize_sizes(texels)
    if options.binary_alpha:
        texels = diffuse(texels, threshold=options.alpha_threshold, channels=("a",)) if options.dither else T.binarize(texels, options.alpha_threshold, ("a",))
    return texels


def compressed(surface: Surface, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(surface_id, mip, by, bx, code) of all levels."""
    level = surface.normal_map() if options.height_map else surface
    gamma = 1.0 if level.is_normal else options.gamma
    level = level.to_linear(gamma).fitted(options.limit, options.rounding)
    out, mip = None, 0
    while True:
        shown = level.map(T.pack_normals) if level.is_normal else level.to_gamma(gamma)
        shown = shown.map(prepared, options)
        codes = codecs.encode(T.to_bytes(shown.df), options.fmt, level.width, level.height).withColumn("mip", F.lit(mip))
        out = codes if out is None else out.unionByName(codes)
        if not options.mips or not level.has_next_mip():
            return out.select("surface_id", "mip", "by", "bx", "code")
        level, mip = level.next_mip(options.shape), mip + 1
        level = level.map(T.normalize) if level.is_normal else level


def containers(surface: Surface, fmt: str = "bc1", options: Options | None = None, kind: str = "2d", dx10: bool = False) -> DataFrame:
    """(surface_id, content): a container of each surface, with all levels that the options ask for; without options the
    base level as it is."""
    extents = surface.df.select("surface_id").distinct().select("surface_id", F.lit(surface.width).alias("width"), F.lit(surface.height).alias("height"))
    codes = compressed(surface, replace(options, fmt=fmt)) if options else codecs.encode(T.to_bytes(surface.df), fmt, surface.width, surface.height)
    return to_dds(codes, fmt, extents, kind, dx10)


def assembled(parts: list[Surface], fmt: str = "bc1", options: Options | None = None, kind: str = "cube") -> DataFrame:
    """(surface_id, content): containers whose faces, or images of an array, are the surfaces of equal id of each part."""
    first = parts[0]
    if any((p.width, p.height) != (first.width, first.height) for p in parts) or (kind == "cube" and (len(parts) != 6 or first.width != first.height)):
        raise ValueError("faces have one extent; a cube has six square ones")
    codes = None
    for face, part in enumerate(parts):
        rows = compressed(part, replace(options, fmt=fmt)) if options else codecs.encode(T.to_bytes(part.df), fmt, part.width, part.height).withColumn("mip", F.lit(0))
        rows = rows.withColumn("face", F.lit(face))
        codes = rows if codes is None else codes.unionByName(rows)
    extents = first.df.select("surface_id").distinct().select("surface_id", F.lit(first.width).alias("width"), F.lit(first.height).alias("height"))
    return to_dds(codes, fmt, extents, kind, dx10=kind == "array", images=len(parts))
