"""Spelling variants against neighbours by deletion, and near words against an edit distance."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import spelling as S

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 199 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """Candidates share what is left of them without one letter."""
    holes = defaultdict(set)
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes[x].add(w)
    found = {}
    for w, n in words.items():
        near = {x for h in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in holes[h] if brute_near(w, x)}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 5 * n else None
        found[w] = (form, n, len(near), words[form] if form else None)
    out = []
    for w, (form, n, near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, form, root, n, near, form_n))
    return sorted(out)


@pytest.mark.parametrize("part", [S.PART, 7])
def test_random_words(spark, part):
    rng = random.Random(part)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    words = {}
    for stem in stems:
        for _ in range(12):
            i, c = rng.randint(0, len(stem)), rng.choice("abé")
            w = rng.choice((stem, stem[:i] + c + stem[i:], stem[:i] + stem[i + 1 :], stem[:i] + c + stem[i + 1 :]))
            if len(w) >= 6:
                words[w] = rng.choice((5, 5, 9, 40, 250, 2000))
    got = sorted(tuple(r) for r in S.variants(spark.createDataFrame(list(words.items()), "word string, n long"), part=part).collect())
    assert got == brute(words) and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_every_kind_of_error():
    index = S.Index(["abcdef", "abcdeg", "xabcdef", "abcdefx", "abcxdef", "aabcdef", "bcdefg"])
    names = ["abcdef", "abcdeg", "xabcdef", "abcdefx", "abcxdef", "aabcdef", "bcdefg"]
    for m in (6, 7):
        for word in (*names, "abcde", "zbcdef", "abcdefxy"):
            bits = index.near(word, m // 2, False, m)
            assert {n for i, n in enumerate(names) if bits >> i & 1} == {n for n in names if brute_near(word, n) and min(len(word), len(n)) == m}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in S.op13_spelling_variants(spark, sf_dir).collect())
    assert got == brute(brute_words(rows))


def test_small_tables(spark):
    schema = "doc_id long, text string, word string, n int"
    assert S.spelling_variants(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None), (None, "Straße STRASSE " * 9), (2, ""), (3, "Übermut übermut " * 6 + "überMut-uebermut"), (3, "x" * 300_000 + " " + "Straße " * 3)]
    got = sorted(tuple(r) for r in S.spelling_variants(spark.createDataFrame([(*r, "clash", 0) for r in rows], schema)).collect())
    assert got == brute(brute_words(rows)) and any(r[0] == "straße" for r in got) and any(r[0] == "Übermut" for r in got)
