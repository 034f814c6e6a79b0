"""The classifier against sets of n-grams in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.llm import toxicity as X
from tessera.llm.texthash import BYTE, FOLD, STEP

MASK = (1 << 64) - 1
BYTES = [int(b) for b in BYTE]


def plain_mixed(x):
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 & MASK
    x = (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D & MASK
    return x ^ (x >> 33)


def plain_buckets(text):
    """The buckets of the distinct runs of 4 to 7 characters of a text between blanks."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\v\f\r" else c for c in text or "")
    values = []
    for c in f" {text} ":
        v = 0
        for b in c.encode():
            v = (v * int(FOLD) + BYTES[b]) & MASK
        values.append(v)
    found = set()
    for size in (4, 5, 6, 7):
        for i in range(len(values) - size + 1):
            total = 0
            for v in values[i : i + size]:
                total = (total * int(STEP) + v) & MASK
            found.add(plain_mixed(total) >> (64 - X.BITS))
    return found


TEXTS = ["", None, "a", "you ABSOLUTE fool", "you absolute\tfool\n", "ünï 日本 texts 🎉", "x" * 5000, "the cat sat", "fool fool fool"]


def test_features_of_a_text():
    import pyarrow as pa

    got = {i: set() for i in range(len(TEXTS))}
    for first, row, bucket in X.features(pa.array(TEXTS, pa.large_string())):
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            assert b not in got[r + first]
            got[r + first].add(b)
    assert got == {i: plain_buckets(t) for i, t in enumerate(TEXTS)}


def test_scores_of_the_table(spark, sf_dir="/root/testdata/sf0.01"):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    weights, intercept = X.fitted(docs, labels)
    score = X.scorer(spark, weights, intercept)
    few = docs.where("length(text) < 1500")
    rows = few.select("text", score("text").alias("score")).collect()
    assert len(rows) > 50 and np.count_nonzero(weights) > 0
    for r in rows:
        total = intercept + sum(float(weights[b]) for b in plain_buckets(r.text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4, abs=1e-9)


def test_features_are_scaled_log_count_ratios():
    """Only n-grams whose presence differs enough between the classes get a weight, of the sign of the ratio."""
    toxic = np.array([1] * 12 + [0] * 24)
    texts = [f"you fool {i}" for i in range(12)] + [f"kind words {i}" for i in range(24)]
    weights, _ = X.fit(texts, toxic)
    counts = {}
    for t, y in zip(texts, toxic, strict=True):
        for b in plain_buckets(t):
            counts.setdefault(b, [0, 0])[y] += 1
    for b, (n0, n1) in counts.items():
        ratio = math.log((n1 + 0.5) / (12 + 1)) - math.log((n0 + 0.5) / (24 + 1))
        error = math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
        if abs(ratio) < max(X.MIN_RATIO, X.MIN_ERRORS * error) - 1e-4:
            assert weights[b] == 0
        elif weights[b]:
            assert weights[b] * ratio * ratio > 0 and (weights[b] > 0) == (ratio > 0)
    assert set(np.flatnonzero(weights)) <= set(counts)
