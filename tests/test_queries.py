"""Each query outside the optional subpackage against its SQL, and the properties of those that SQL can't express."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

OURS = {name: run for module in entry.MODULES for name, run in module.QUERIES.items()}
SQL = {name: text for module in entry.MODULES for name, text in module.SQL.items()}


@pytest.fixture(scope="module")
def duck(sf_dir_module):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir_module}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def sf_dir_module():
    return "/root/testdata/sf0.001"


def rows(table, columns):
    """Sorted rows with numbers rounded, so that both sides print alike; a null is last, whatever else the column has."""
    shown = [tuple(round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v) for v in (x[c] for c in columns)) for x in table]
    return sorted(shown, key=lambda r: tuple((v is None, v) if v is not None else (True, 0) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir_module, name):
    df = OURS[name](spark, sf_dir_module)
    columns = sorted(df.columns)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    theirs = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    mine = [r.asDict() for r in df.collect()]
    a, b = rows(mine, columns), rows(theirs, columns)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b, strict=True) if any((abs(p - q) > 2e-5 * (1 + abs(q))) if isinstance(p, float) else p != q for p, q in zip(x, y, strict=True))]
    assert not off, off[:3]


def test_codes_are_near(spark, sf_dir):
    from pyspark.sql import functions as F

    out = {r.format: r.rms for r in OURS["encode_errors"](spark, sf_dir).groupBy("format").agg(F.avg("rms").alias("rms")).collect()}
    # noise in three or four dimensions about a line, and in one
    assert out["bc1"] < 45 and out["bc2"] < 45 and out["bc3"] < 45 and out["bc4"] < 6 and out["bc5"] < 9
    # a block without a transparent texel is written opaque, whatever its alpha
    clear = OURS["encode_bc1a"](spark, sf_dir).where("low = 0").agg(F.sum("wrong"), F.count(F.lit(1))).first()
    assert clear[0] == 0 and clear[1] > 0
    assert OURS["encode_rgbm"](spark, sf_dir).agg(F.avg("rms")).first()[0] < 45


def test_coverage_scale(spark, sf_dir):
    from tessera.operators import filters, stats
    from tessera.plans.images import size_of
    from tessera.sources import relations

    t = relations.atlas(spark, sf_dir)
    out, _ = filters.scale_to_coverage(t, size_of(t), 0.5, 0.6)
    assert abs(stats.coverage(out, *size_of(t), 0.6).first().coverage - 0.5) < 0.02


def test_entry(spark):
    assert entry.entry(spark).count() == 1
