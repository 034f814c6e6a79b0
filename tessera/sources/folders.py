"""Folders of image files: read by one call whatever their formats, and written file by file.

Formats are told by content. A file that can't be read becomes a row with its path and the error, and no texel. Files are
written from pieces, which a task streams to a temporary name; they get their names when the job commits, so a task that
is lost leaves nothing behind.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


from tessera.operators.codecs import code_bytes
from tessera.operators.steps import stored
from tessera.functions.packing import packed_rows
from tessera.sources import files
from tessera.sources.png import SIGNATURE, png, png_pieces
from tessera.sources.relations import CHANNELS

TEXELS = "path string, z int, y int, x int, r double, g double, b double, a double, error string"
ARROW = pa.schema([("path", pa.string()), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), *[(c, pa.float64()) for c in CHANNELS], ("error", pa.string())])
LINES = 1 << 16  # texels of a batch
DDS = b"DDS "


def ppm(data: bytes) -> np.ndarray:
    """The texels of a binary portable pixmap of 8 bits; alpha is 0."""
    words, at = [], 2
    while len(words) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        words.append(int(data[at:end]))
        at = end
    width, height, top = words
    if top != 255:
        raise ValueError("unsupported PPM")
    rgb = np.frombuffer(data, np.uint8, width * height * 3, at + 1).reshape(height, width, 3)
    return np.concatenate([rgb, np.zeros((height, width, 1), np.uint8)], 2) / 255.0


def decoded(data: bytes) -> np.ndarray:
    """The texels (height, width, 4) of a file of any raster format, told by its first bytes; TGA has none and comes
    last."""
    if data[:8] == SIGNATURE:
        return png(data)
    if data[:2] == b"#?":
        return files.radiance(data)
    if data[:2] == b"P6":
        return ppm(data)
    if data[:2] == b"\xff\xd8":
        raise ValueError("JPEG: spark.read.format('image') and relations.from_image_source read it")
    if len(data) > 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11):
        return files.tga(data)
    raise ValueError("unknown format")


def batches_of(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """The texels of a file, or one row with what is wrong with it."""
    try:
        v = decoded(data)
    except Exception as e:  # whatever a broken file leads to is told in its row
        row = [[path], *[[None]] * 7, [f"{type(e).__name__}: {e}"]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, ARROW, strict=True)], schema=ARROW)
        return
    height, width = v.shape[:2]
    lines = max(1, LINES // max(1, width))
    for top in range(0, height, lines):
        part = v[top : top + lines]
        y, x = np.mgrid[top : top + len(part), :width].astype(np.int32)
        n = y.size
        columns = [pa.array([path]).take(pa.array(np.zeros(n, np.int64))), pa.array(np.zeros(n, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), *[pa.array(np.ascontiguousarray(part[..., i]).ravel()) for i in range(4)], pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield from batches_of(path.as_py(), content.as_py())


def read_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, z, y, x, r, g, b, a, error): the texels, 0..1, of all files below path, of PNG, TGA, PPM, Radiance and (base
    levels of) containers with blocks or plain texels. It reads whatever Spark reads, files by size to tasks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    container = F.substring("content", 1, 4) == F.lit(DDS)
    rasters = found.where(~container).mapInArrow(_decode, TEXELS)
    # files are opened again by each branch below: containers are written first, and where there are none that is all
    inside = stored(found.where(container).select(F.col("path").alias("surface_id"), "content"), "containers")
    if inside.isEmpty():
        return rasters
    blocks = _unit(files.decode_dds(inside))
    plain = files.plain_texels(inside).where("face = 0 AND mip = 0")
    wide = files.dds_info(inside).select("surface_id", F.col("code").isin(files.HALF_CODE, files.FLOAT_CODE).alias("wide"))
    plain = plain.join(wide, "surface_id").select("surface_id", "z", "y", "x", *[F.when(F.col("wide"), F.col(c)).otherwise(F.col(c) / 255).alias(c) for c in CHANNELS])
    texels = blocks.select("surface_id", "z", "y", "x", *CHANNELS).unionByName(plain)
    told = texels.select(F.col("surface_id").alias("path"), *[F.col(c).cast("int").alias(c) for c in "zyx"], *[F.col(c).cast("double").alias(c) for c in CHANNELS], F.when(F.col("r").isNull(), "the file ends early").alias("error"))
    lost = inside.select(F.col("surface_id").alias("path")).join(texels.select(F.col("surface_id").alias("path")).distinct(), "path", "left_anti")
    lost = lost.select("path", *[F.lit(None).cast("int").alias(c) for c in "zyx"], *[F.lit(None).cast("double").alias(c) for c in CHANNELS], F.lit("unsupported container").alias("error"))
    return rasters.unionByName(told).unionByName(lost)


def _unit(texels: DataFrame) -> DataFrame:
    return texels.withColumns({c: F.col(c) / 255 for c in CHANNELS})


def pieces(texels: DataFrame, extents: DataFrame, fmt: str) -> DataFrame:
    """(surface_id, piece, data) of files of texels of 0..255 by format: png, tga (32 bits, from the top) or ppm."""
    if fmt == "png":
        return png_pieces(texels, extents)
    order = {"tga": "bgra", "ppm": "rgb"}.get(fmt)
    if order is None:
        raise ValueError(f"unsupported format: {fmt}")
    value = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(255)).cast("long")
    lines = packed_rows(texels.where("z = 0"), [(value(c), 8) for c in order], 0).select("surface_id", (F.col("y") + 1).cast("long").alias("piece"), "data")
    if fmt == "ppm":
        head = F.concat(F.lit("P6\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary")
    else:
        head = F.concat(F.unhex(F.lit("000002" + "00" * 9)), code_bytes(F.col("width").cast("long"), 2), code_bytes(F.col("height").cast("long"), 2), F.unhex(F.lit("2028")))
    return extents.select("surface_id", F.lit(0).cast("long").alias("piece"), head.alias("data")).unionByName(lines)


def write_files(parts: DataFrame, path: str, ending: str, by_task: bool = False) -> None:
    """Writes pieces (surface_id, piece, data) as files named after the surface. All files appear at the end or none; by_task
    each task's in a folder of its own below path, so that the end takes a step for each task and not for each file."""
    register(parts.sparkSession)
    rows = parts.select(F.concat(F.regexp_replace(F.col("surface_id").cast("string"), r"[^A-Za-z0-9._=-]", "_"), F.lit(f".{ending}")).alias("name"), F.col("piece").cast("long").alias("piece"), "data")
    rows.repartition("name").sortWithinPartitions("name", "piece").write.format("tessera_files").mode("append").option("bytask", by_task).save(path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths, self.value = paths, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Files]:
        """Files in the order of their names, by size: a partition has so many bytes, or one file."""
        fs, root = file_system(self.path)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
        out, size = [[]], 0
        for i in sorted(infos, key=lambda i: i.path):
            if out[-1] and size + i.size > self.most:
                out.append([])
                size = 0
            out[-1].append(i.path)
            size += i.size
        return [Files(paths) for paths in out if paths] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path in partition.paths:
            try:
                with fs.open_input_stream(path) as f:
                    data = f.read()
            except OSError as e:
                data = str(e).encode()
            yield from batches_of(path, data)


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job, self.by_task = options["path"], uuid.uuid4().hex, str(options.get("bytask", "false")).lower() == "true"

    def write(self, rows: Iterator) -> _Written:
        """Streams the pieces of one file after the other to files of this attempt alone."""
        fs, root = file_system(self.path)
        attempt = uuid.uuid4().hex
        folder = f"{root}/_temporary/{self.job}/{attempt}"
        fs.create_dir(folder, recursive=True)
        done, name, last, out = [], None, -1, None
        try:
            for row in rows:
                if row["name"] != name:
                    if out is not None:
                        out.close()
                    name, last, out = row["name"], -1, None
                    done.append((f"{folder}/{name}", f"{root}/{name}"))
                    out = fs.open_output_stream(done[-1][0])
                if row["piece"] <= last:
                    raise ValueError(f"{name}: pieces out of order")
                last = row["piece"]
                out.write(bytes(row["data"]))
        finally:
            if out is not None:
                out.close()
        return _Written([(folder, f"{root}/{attempt}")] if self.by_task and done else done)

    def _clean(self) -> None:
        fs, root = file_system(self.path)
        at = f"{root}/_temporary/{self.job}"
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, _ = file_system(self.path)
        for message in messages:
            for source, target in message.names if message else []:
                fs.move(source, target)
        self._clean()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()


class Images(DataSource):
    """spark.read.format("tessera_images").load(folder): the texels of raster files, partitions by size."""

    @classmethod
    def name(cls) -> str:
        return "tessera_images"

    def schema(self) -> str:
        return TEXELS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


class Pieces(DataSource):
    """df.write.format("tessera_files").save(folder) of (name, piece, data), files whole and in order in each partition."""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return "name string, piece long, data binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Images)
    spark.dataSource.register(Pieces)
