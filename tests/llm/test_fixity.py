"""Damage of other lengths is told from what it moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import fixity


def pages(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("text "), (F.col("id") % 7).cast("int")).alias("html"), F.lit("clash").alias("slot"), F.lit(0).alias("offset"))


def change(df, page, html):
    return df.withColumn("html", F.when(F.col("page_id") == page, html).otherwise(F.col("html")))


def test_a_longer_record_is_one_row(spark):
    mine = pages(spark)
    found = fixity.fixity(mine, change(mine, 100, F.lit("much longer than it was before, by far"))).collect()
    assert [r.page_id for r in found] == [100] and found[0].replica_length > found[0].length and found[0].offset == found[0].replica_offset


def test_shorter_missing_and_added(spark):
    mine = pages(spark)
    other = change(change(mine, 40, F.lit("")), 900, F.lit("x")).where("page_id <> 500")
    rows = fixity.fixity(mine, other)
    found = {r.page_id: r for r in rows.collect()}
    assert set(found) == {40, 500, 900} and found[500].replica_hash is None and found[900].replica_offset < found[900].offset
    shifts = {(r.after, r.before): r.shift for r in fixity.moved(rows).collect()}
    lengths = {i: (r.replica_length or 0) - r.length for i, r in found.items()}
    assert shifts == {(40, 500): lengths[40], (500, 900): lengths[40] + lengths[500], **({(900, None): sum(lengths.values())} if sum(lengths.values()) else {})}
    back = {r.page_id: r for r in fixity.fixity(other, mine).collect()}
    assert set(back) == {40, 500, 900} and back[500].content_hash is None and back[500].page_id == 500


def test_records_that_change_places(spark):
    """Two records of one length that are swapped are both found: contents belong to their slots."""
    mine = spark.createDataFrame([(i, "u", f"<p>{i:04}</p>") for i in range(50)], "page_id long, url string, html string")
    other = change(change(mine, 10, F.lit("<p>0020</p>")), 20, F.lit("<p>0010</p>"))
    assert {r.page_id for r in fixity.fixity(mine, other).collect()} == {10, 20}
    assert fixity.moved(fixity.fixity(mine, other)).count() == 0


def test_long_pages_and_copies(spark):
    rows = [(1, "u", "x" * 2_000_000), (1, "u", "y"), (1, "u", "y"), (2, None, None)]
    mine = spark.createDataFrame(rows, "page_id long, url string, html string")
    other = spark.createDataFrame([(1, "u", "x" * 2_000_000 + "z"), *rows[1:]], mine.schema)
    assert fixity.fixity(mine, mine).count() == 0
    assert {r.page_id for r in fixity.fixity(mine, other).collect()} == {1}
