"""What is parsed of a code."""

from __future__ import annotations

from tessera.operators.codecs import decode


def test_bytes_of_a_code_are_not_parsed_for_each_value_of_a_ramp(spark):
    codes = spark.createDataFrame([(1, 0, 0, bytearray(range(16)))], "surface_id int, by int, bx int, code binary")
    plan = decode(codes, "eac_rg")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("conv(") <= 8
