"""WARC: an audit of replicas by Merkle trees over records and their offset ranges.

Records of an archive lie at slots, ordered by offset. Each record's bytes are hashed together with its length; a node of
the next level hashes its up to ``FAN`` children in order with the ranges of offsets that they cover, counted from where
the node itself begins. So a record that became longer or shorter changes the nodes above it and no others: what it moves
isn't taken for damage, but told as a shift. Two replicas are compared from their roots on: only children of nodes that
differ are ever joined, so an intact archive costs one comparison and a damaged record a path of ``FAN`` children a level.
All levels are DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

FAN, LEVELS = 16, 3  # 4096 slots an archive
SLOTS = FAN**LEVELS
NAMELESS = -(2**62)  # the first archive of pages without a page_id


def warc_record(url: Column, content: Column, number: Column) -> Column:
    """The bytes of a WARC/1.0 response record."""
    body = F.coalesce(content, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archived(pages: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(archive, slot, page_id, offset, length, content_hash): pages by page_id in archives of ``slots`` records.

    Pages without a page_id lie in archives of their own, far below the others, by hashes of url and content. Of pages
    that repeat a page_id each is a record of its own after the others of its slot, told apart by ``copy``. Null urls and
    texts count as empty.
    """
    record = warc_record(F.col("url"), F.col("html"), F.col("page_id"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record.alias("record"))
    apart = F.lit(NAMELESS) + F.pmod(F.xxhash64("record"), F.lit(2**32))
    rows = rows.select(
        F.coalesce(F.floor(F.col("page_id") / slots), apart).alias("archive"), F.coalesce(F.pmod("page_id", F.lit(slots)), F.pmod(F.xxhash64(F.lit("slot"), "record"), F.lit(slots))).cast("int").alias("slot"), "page_id",
        F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("content_hash"),
    )
    order = Window.partitionBy("archive").orderBy("slot", "content_hash")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    copy = F.row_number().over(Window.partitionBy("archive", "slot").orderBy("content_hash")) - 1
    return rows.withColumn("offset", offset).withColumn("copy", copy)


def merkle(records: DataFrame, levels: int = LEVELS, fan: int = FAN) -> list[DataFrame]:
    """The levels of the trees from the records' slots (0) to the roots: (archive, node, first, last, hash)."""
    leaf = F.sha2(F.concat_ws("|", F.col("content_hash"), F.col("length").cast("string")), 256)
    rows = records.select("archive", F.col("slot").cast("long").alias("node"), "copy", "offset", (F.col("offset") + F.col("length")).alias("end"), leaf.alias("hash"))
    level = _folded(rows.withColumn("child", F.col("copy").cast("long")))
    out = [level]
    for _ in range(levels):
        up = level.select("archive", F.floor(F.col("node") / fan).alias("node"), F.col("node").alias("child"), F.col("first").alias("offset"), F.col("last").alias("end"), "hash")
        level = _folded(up)
        out.append(level)
    return out


def _folded(children: DataFrame) -> DataFrame:
    """Nodes of children: their hashes, and their ranges from the beginning of the node."""
    nodes = children.groupBy("archive", "node").agg(F.min("offset").alias("first"), F.max("end").alias("last"), F.array_sort(F.collect_list(F.struct("child", "offset", "end", "hash"))).alias("of"))
    told = lambda x: F.concat_ws(":", x["child"].cast("string"), (x["offset"] - F.col("first")).cast("string"), (x["end"] - F.col("first")).cast("string"), x["hash"])
    return nodes.select("archive", "node", "first", "last", F.sha2(F.array_join(F.transform("of", told), ";"), 256).alias("hash"))


def audit(primary: list[DataFrame], replica: list[DataFrame], fan: int = FAN) -> DataFrame:
    """(archive, slot): the slots whose records differ or are on one side only. Records that are moved as a whole by others
    before them don't differ."""
    suspects = None
    for mine, other in zip(reversed(primary), reversed(replica), strict=True):
        a = mine.select("archive", "node", F.col("hash").alias("a"))
        b = other.select("archive", "node", F.col("hash").alias("b"))
        if suspects is not None:
            up = lambda x: x.withColumn("up", F.floor(F.col("node") / fan)).join(suspects.withColumnRenamed("node", "up"), ["archive", "up"], "left_semi").drop("up")  # noqa: B023, E731
            a, b = up(a), up(b)
        suspects = a.join(b, ["archive", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")
    return suspects.withColumnRenamed("node", "slot")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica in which of every 97 pages one has a changed byte, one is longer by a byte and one is missing."""
    kind, text = F.pmod("page_id", F.lit(97)), F.coalesce("html", F.lit(""))
    html = F.when((kind == 13) & (F.length("html") > 0), F.concat(F.lit("#"), F.substring(text, 2, 2**31 - 1))).when(kind == 41, F.concat(F.lit("#"), text)).otherwise(F.col("html"))
    return pages.where(F.coalesce(kind != 71, F.lit(True))).select("page_id", "url", html.alias("html"))


def fixity(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record at a slot that the audit finds: archive, slot, page_id, offset, length, content_hash,
    replica_offset, replica_length and replica_hash (null where that side has no record). A record of another length is
    one row, whatever lies behind it: ``moved`` tells what it moves."""
    mine, other = written(archived(primary), "records"), written(archived(replica), "records")
    levels = [[written(x, "level") for x in merkle(side)] for side in (mine, other)]
    at = written(audit(*levels), "suspects")
    a = mine.join(at, ["archive", "slot"], "left_semi")
    b = other.join(at, ["archive", "slot"], "left_semi")
    b = b.select("archive", "slot", "copy", F.col("page_id").alias("other_id"), *[F.col(c).alias(f"replica_{n}") for c, n in (("offset", "offset"), ("length", "length"), ("content_hash", "hash"))])
    out = a.join(b, ["archive", "slot", "copy"], "full_outer")
    return out.select("archive", "slot", F.coalesce("page_id", "other_id").alias("page_id"), "offset", "length", "content_hash", "replica_offset", "replica_length", "replica_hash")


def moved(found: DataFrame) -> DataFrame:
    """Of fixity's rows: (archive, after, before, shift), the intact records between two found slots (before is null up to
    the end) that lie shift bytes further on in the replica, or back if it is negative."""
    slots = found.groupBy("archive", "slot").agg((F.sum(F.coalesce("replica_length", F.lit(0))) - F.sum(F.coalesce("length", F.lit(0)))).alias("more"))
    order = Window.partitionBy("archive").orderBy("slot")
    rows = slots.select("archive", F.col("slot").alias("after"), F.lead("slot").over(order).alias("before"), F.sum("more").over(order).alias("shift"))
    return rows.where("shift <> 0")


def read_warc(files: DataFrame) -> DataFrame:
    """(path, offset, length, url, content) of the records of whole WARC files (binaryFile rows: path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(_records(path, bytes(data))), columns=["path", "offset", "length", "url", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, offset long, length long, url string, content binary")


def _records(path: str, data: bytes) -> Iterator[tuple]:
    at = 0
    while (split := data.find(b"\r\n\r\n", at)) >= 0:
        head = dict(line.split(": ", 1) for line in data[at:split].decode("utf-8", "replace").split("\r\n") if ": " in line)
        body = split + 4
        end = body + int(head.get("Content-Length", 0))
        yield path, at, end + 4 - at, head.get("WARC-Target-URI"), data[body:end]
        at = end + 4


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity(pages, damaged(pages))


SQL = {
    "op10_warc": r"""
        WITH p AS (
          SELECT page_id, url, coalesce(html, '') AS html, page_id % 97 AS kind,
                 CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN '#' || substring(html, 2) WHEN page_id % 97 = 41 THEN '#' || coalesce(html, '') ELSE coalesce(html, '') END AS other FROM pages),
        r AS (
          SELECT page_id, kind, which, encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                   || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR || '>' || chr(13) || chr(10)
                   || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(body))::VARCHAR
                   || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10)) AS record
          FROM (SELECT *, CASE WHEN which = 0 THEN html ELSE other END AS body FROM p, (VALUES (0), (1)) AS ws(which)) WHERE which = 0 OR kind <> 71),
        s AS (
          SELECT which, kind, page_id, floor(page_id / 4096)::BIGINT AS archive, (page_id % 4096)::INT AS slot, octet_length(record)::BIGINT AS length, sha256(record) AS hash,
                 (sum(octet_length(record)) OVER (PARTITION BY which, floor(page_id / 4096) ORDER BY page_id) - octet_length(record))::BIGINT AS at FROM r)
        SELECT a.archive, a.slot, a.page_id, a.at AS "offset", a.length, a.hash AS content_hash, b.at AS replica_offset, b.length AS replica_length, b.hash AS replica_hash
        FROM (SELECT * FROM s WHERE which = 0) AS a LEFT JOIN (SELECT * FROM s WHERE which = 1) AS b USING (page_id) WHERE a.hash IS DISTINCT FROM b.hash"""
}
QUERIES = {"op10_warc": op10_warc}
