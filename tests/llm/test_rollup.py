"""Commits that break off, come again, or are continued by another object on the same folder."""

from __future__ import annotations

import pytest

from tessera.llm import rollup


@pytest.fixture
def change(spark):
    return lambda docs, tokens, source="s": spark.createDataFrame([(source, "en", "v", docs, tokens)], "source string, lang string, version string, docs long, tokens long")


def totals(r):
    return sorted(tuple(x) for x in r.totals().collect())


def test_another_object_goes_on(spark, change, tmp_path):
    path = f"file://{tmp_path}/r"
    assert totals(rollup.Rollup(spark, path)) == []
    assert rollup.Rollup(spark, path).commit("a", change(2, 10))
    again = rollup.Rollup(spark, path)
    assert not again.commit("a", change(2, 10)) and again.commit("b", change(-1, -4))
    assert totals(rollup.Rollup(spark, path)) == [("s", "en", "v", 1, 6)]


def test_a_broken_off_commit_does_not_count(spark, change, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    r.commit("a", change(1, 5))
    r.stage(change(1, 7))  # the driver is lost before the log has it
    (tmp_path / "r" / "log" / "_temporary").mkdir()
    (tmp_path / "r" / "rows" / "_temporary" / "0").mkdir(parents=True)
    assert totals(r) == [("s", "en", "v", 1, 5)]
    assert r.commit("b", change(1, 7)) and totals(r) == [("s", "en", "v", 2, 12)]


def test_two_writers_of_one_batch(spark, change, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    one, two = r.stage(change(1, 5)), r.stage(change(1, 5))
    r.publish("a", one)
    r.publish("a", two)
    assert totals(r) == [("s", "en", "v", 1, 5)]


def test_names_and_empty_batches(spark, change, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    for name in ("../x", "a/b", "", "_hidden", "é ' \""):
        assert r.commit(name, change(1, 1, None)) and not r.commit(name, change(1, 1, None))
    assert r.commit("empty", change(1, 1).limit(0)) and not r.commit("empty", change(1, 1))
    assert totals(r) == [(None, "en", "v", 5, 5)]
    assert r.commit("gone", change(-5, -5, None)) and totals(r) == []
