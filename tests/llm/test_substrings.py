"""Duplicate windows against a dictionary of all windows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import substring_dedup as S

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def check(spark, rows, window, seed):
    got = [tuple(r) for r in S.substring_dedup(spark.createDataFrame(rows, SCHEMA).withColumn("a", F.lit("clash")).withColumn("t", F.lit(0)), window, seed).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


@pytest.mark.parametrize("window", [4, 9])
def test_random_texts(spark, window):
    """Passages that many texts share, in part, with copies, near copies and runs of one word."""
    rng = random.Random(window)
    passages = [[rng.choice("abcdef") for _ in range(rng.randint(3, 30))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p))
            words += rng.choice((p, p[:cut], p[cut:], [rng.choice("xyz") + str(rng.randint(0, 99)) for _ in range(5)], ["r"] * rng.randint(0, 15)))
        rows.append((i, " ".join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (202, ""), (203, " \n\t "), (204, rows[7][1].upper())]
    check(spark, rows, window, 2)


def test_small_tables(spark):
    assert S.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, "a b c")], 4, 2)
    check(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d e")], 4, 2)
    check(spark, [(None, "é ß 日本 x y"), (None, "é ß 日本 x z")], 4, 2)
    long = " ".join(f"w{i % 5000}" for i in range(12_000))
    check(spark, [(1, long), (2, "one two three")], 35, 8)


def test_factors_follow_their_source():
    """The longer of two runs is taken, and the next factor begins where it ends."""
    hits = [(10, 0, 3, 1, 90), (11, 3, 4, 2, 50), (12, 7, 2, 3, 51), (13, 9, 1, 77, 80)]
    assert list(S.parse(hits)) == [(0, 9, 1), (9, 1, 77)]
    assert list(S.parse([(5, 0, 3, 5, 5), (6, 3, 2, 6, 6)])) == [(0, 5, 5)]  # copies of a text alone
    assert list(S.parse([(5, 0, 3, 1, 5), (8, 30, 2, 2, 8)])) == [(0, 3, 1), (30, 2, 2)]  # not neighbours


def test_spans(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {shared} c{i}") for i in range(5)]
    spans = defaultdict(set)
    for r in S.duplicate_spans(spark.createDataFrame(rows, SCHEMA)).collect():
        spans[r.doc_id].update(range(r.start, r.stop))
        assert r.stop - r.start >= 35
    assert all(v == set(range(2, 62)) for v in spans.values()) and len(spans) == 5
