"""What is left of a block's colours before a fit: near-equal ones are merged, black ones left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1 / 256
BLACK = 1 / 8  # fixed value: below it in each channel a colour counts as black
COLOUR = "array<struct<r:double,g:double,b:double,w:double>>"


def is_black(colour: Column) -> Column:
    return (colour["r"] < BLACK) & (colour["g"] < BLACK) & (colour["b"] < BLACK)


def merged(blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """blocks (as from gather, colours of 0..1) with colours (r, g, b, w) and any_black. Texels are taken in order, their
    alpha being the weight, those of none left out. A texel joins the first colour that differs by less than threshold in
    each channel, which becomes their weighted mean; else it is a colour of its own. any_black: a texel was black."""
    texels = F.filter(F.transform("t", lambda x: F.struct(*[x[c].cast("double").alias(c) for c in "rgb"], x["a"].cast("double").alias("w"))), lambda x: x["w"] > 0)

    def near(a: Column, b: Column) -> Column:
        return (F.abs(a["r"] - b["r"]) < threshold) & (F.abs(a["g"] - b["g"]) < threshold) & (F.abs(a["b"] - b["b"]) < threshold)

    def both(a: Column, b: Column) -> Column:
        w = a["w"] + b["w"]
        return F.struct(*[((a[c] * a["w"] + b[c] * b["w"]) / w).alias(c) for c in "rgb"], w.alias("w"))

    def fold(found: Column, x: Column) -> Column:
        at = F.array_position(F.transform(found, lambda c: near(c, x)), True)  # from 1; 0 if there is none
        return F.when(at == 0, F.concat(found, F.array(x))).otherwise(F.transform(found, lambda c, i: F.when(i + 1 == at, both(c, x)).otherwise(c)))

    rows = blocks.withColumn("_t", texels)
    return rows.withColumns({"colours": F.aggregate("_t", F.array().cast(COLOUR), fold), "any_black": F.exists("_t", is_black)}).drop("_t")


def without_blacks(colours: Column) -> Column:
    """The colours that aren't black, in order."""
    return F.filter(colours, lambda c: ~is_black(c))
