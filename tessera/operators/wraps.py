"""Indexes beyond an extent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.relations import clamp


def wrapped(i: Column, extent: int | Column, mode: str) -> Column:
    """An index of any size inside 0..extent-1: clamp, repeat, or mirror without the edge texel twice."""
    if isinstance(extent, Column):
        if mode == "clamp":
            return F.least(F.greatest(i, F.lit(0)), extent - 1)
        if mode == "repeat":
            return F.pmod(i, extent)
        period = F.greatest(extent * 2 - 2, F.lit(1))
        turn = F.pmod(i, period)
        return F.when(extent == 1, 0).otherwise(F.least(turn, period - turn))
    if mode == "clamp":
        return clamp(i, 0, extent - 1)
    if mode == "repeat":
        return F.pmod(i, F.lit(extent))
    if extent == 1:
        return F.lit(0)
    turn = F.pmod(i, F.lit(2 * extent - 2))
    return F.least(turn, 2 * extent - 2 - turn)
