"""Halves of nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.packing import from_half, to_half


def test_a_null_stays_null(spark):
    rows = spark.createDataFrame([(None,), (1.5,)], "v double")
    assert [r.back for r in rows.select(from_half(to_half(F.col("v"))).alias("back")).collect()] == [None, 1.5]
