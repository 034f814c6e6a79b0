"""Nulls, empty texts, repeated rows, clashing columns and empty tables: the results that the docstrings define."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, fixity, line_dedup, mixing, near_dedup, neighbours, pieces, pseudo_likelihood, rollup, toxicity

LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s1"), (2, "alpha BETA gamma delta epsilon zeta", "en", None), (3, None, None, "s1"),
    (4, "", "de", "s2"), (5, "   \n\t ", "de", "s2"), (6, "one two", "fr", "s2"), (6, "one two", "fr", "s2"), (None, "one two", "fr", "s2"),
    (7, LONG, "en", "s3"), (8, "line a\nline b\nline c", "en", "s1"), (9, "line a\nline b\nother", "en", "s1"), (10, "ünï▁cødé 🎉 text", "es", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    clash = ("row", "run", "digest", "size", "rank", "bands", "_id", "key", "s", "start", "n", "bucket")
    return rows.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_exact(docs, none):
    rows = exact_dedup.exact_dedup(docs, fan=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(ROWS)
    assert by[1][0].keep_id == by[2][0].keep_id == 2 and by[2][0].kept and not by[1][0].kept
    assert by[3][0].keep_id == 4 and by[3][0].group_size == 2
    assert by[6][0].keep_id == by[None][0].keep_id == 6 and by[6][0].group_size == 3
    assert sum(r.kept for r in by[6]) == 1 and not by[None][0].kept
    assert exact_dedup.exact_dedup(none).count() == 0
    assert {r.doc_id for r in exact_dedup.keep_unique(docs).collect()} == {2, 4, 5, 6, 7, 8, 9, 10}
    assert exact_dedup.keep_unique(docs).columns == docs.columns


def test_near(docs, none):
    rows = {r.doc_id: r for r in near_dedup.near_dedup(docs).collect()}
    assert rows[1].component_id == rows[2].component_id == 1 and rows[1].kept and not rows[2].kept
    assert rows[3].n_shingles == rows[4].n_shingles == rows[5].n_shingles == 0 and rows[4].component_id == 4
    assert rows[None].component_id == 6 and rows[6].n_shingles == 1 and rows[7].n_shingles == 29_996
    assert near_dedup.near_dedup(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mixed_sizes(docs, block=7).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    sources = {r.source: r for r in rows}
    assert sum(r.target for r in sources.values()) == pytest.approx(sum(r.source_size for r in sources.values()))
    for s, r in sources.items():
        assert sum(x.taken for x in rows if x.source == s) == pytest.approx(r.target, abs=10)  # words, of blocks of one word
    assert mixing.mixed_sizes(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_lines(docs, none):
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_words=4).collect()}
    assert rows[9].text == "other" and rows[9].n_deleted == 2 and rows[8].n_deleted == 0 and rows[8].n_lines == 3
    assert rows[3].text is None and rows[3].n_lines == 0 and rows[4].text == "" and rows[4].n_lines == 1
    assert line_dedup.line_dedup(none).count() == 0


def test_pieces(docs, none):
    rows = {r.doc_id: r for r in pieces.encoded(docs).collect()}
    assert rows[3].n_pieces == rows[4].n_pieces == 0 and rows[3].round_trip
    assert all(r.round_trip for i, r in rows.items() if i != 10) and not rows[10].round_trip
    assert pieces.encoded(none).count() == 0
    back = pieces.decoded(pieces.encoded(docs)).where("doc_id = 10").first()
    assert back.text == "ünï cødé 🎉 text"


def test_toxicity(spark, docs, none):
    marked = labels(spark, [(1, 1, 0), (2, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (8, 1, 5)])
    rows = toxicity.toxicity(docs, marked).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.toxicity_score <= 1 for r in rows)
    assert toxicity.toxicity(none, marked).count() == 0
    assert {r.toxicity_score for r in toxicity.toxicity(docs, labels(spark)).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, labels(spark)).columns == docs.columns
    import pyarrow as pa

    column = pa.array(["aé日b", "", "éé"])
    (_, data, offsets), = toxicity.slices(column)
    owner, value = toxicity.characters(data, offsets)
    assert owner.tolist() == [0] * 6 + [1] * 2 + [2] * 4 and value[2] == value[9] == value[10] != value[3]
    assert len(toxicity.grams(owner, value, 4)[0]) == 3 + 1


def test_language_model(docs, none):
    rows = {r.doc_id: r for r in pseudo_likelihood.scored(docs).collect()}
    assert rows[3].n_tokens == 0 and rows[3].log_prob == 0 and rows[3].mean_log_prob is None
    assert rows[7].n_tokens == 30_000 and rows[7].log_prob < 0
    assert pseudo_likelihood.scored(none).count() == 0


def test_rollup(docs, none):
    rows = rollup.maintained(docs).collect()
    assert sum(r.docs for r in rows) == len(ROWS)
    assert any(r.source is None for r in rows) and any(r.lang is None and r.tokens == 0 for r in rows)
    assert rollup.maintained(none).count() == 0


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, rank int, entry string"
    rows = [(i, [float(i), 1.0], 0, "x") for i in range(0, 30)] + [(40, None, 0, "x"), (60, [0.0, 0.0], 0, "x"), (80, [float("nan"), 1.0], 0, "x"), (100, [None, 1.0], 0, "x"), (None, [1.0, 1.0], 0, "x"), (120, [1.0], 0, "x"), (31, [5.0, 1.0], 0, "x"), (5, [5.0, 1.0], 0, "x")]
    got = neighbours.nearest(spark.createDataFrame(rows, schema)).collect()
    assert {r.query_id for r in got} == {0, 20}
    first = [r.vec_id for r in sorted((r for r in got if r.query_id == 20), key=lambda r: r["rank"])]
    assert first[:9] == [29, 28, 27, 26, 25, 24, 23, 22, 21] and len(first) == 20
    tied = [r for r in got if r.query_id == 0]
    assert [r.vec_id for r in sorted(tied, key=lambda r: r["rank"])] == list(range(1, 21))
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, None, None), (2, "v", ""), (None, "w", "x"), (5000, "u", "é")], "page_id long, url string, html string")
    assert fixity.fixity(pages, pages).count() == 0
    other = pages.where("page_id <> 5000").union(spark.createDataFrame([(9, "n", "new")], pages.schema))
    found = {(r.page_id, r.content_hash is None, r.replica_hash is None) for r in fixity.fixity(pages, other).collect()}
    assert found == {(5000, False, True), (9, True, False), (None, False, True)}
    lost = {(r.page_id, r.content_hash is None, r.replica_hash is None) for r in fixity.fixity(pages, pages.where("page_id IS NOT NULL")).collect()}
    assert lost == {(None, False, True)}  # a record without an id is missed too
    none = spark.createDataFrame([], pages.schema)
    assert fixity.fixity(none, none).count() == 0
