"""What the operators left out before: words that shared a bucket, and what else a review found."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exact_dedup, line_dedup, mixing, near_dedup, pseudo_likelihood


def colliding_words():
    """Two words of one bucket of the former 2^18."""
    seen, words = {}, [f"w{i}" for i in range(4000)]
    (_, buckets, _), = pseudo_likelihood.tokens(pa.array([" ".join(words)]))
    for word, bucket in zip(words, buckets.tolist(), strict=True):
        if bucket in seen:
            return seen[bucket], word
        seen[bucket] = word
    raise AssertionError


@pytest.mark.parametrize("most", [0, 100, 1000])
def test_words_of_one_bucket_have_their_own_counts(spark, most):
    often, rare = colliding_words()
    common = " ".join(f"c{i} c{i} c{i}" for i in range(pseudo_likelihood.OWN))
    texts = {1: f"{often} {often} {rare}", 2: common, 3: "x y z " + often, 4: None, 5: f"{often.upper()} a b c d d a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    parts = pseudo_likelihood.sliced(docs).cache()
    counts = pseudo_likelihood.corpus_counts(parts)
    want = Counter(w for t in texts.values() if t for w in t.lower().split())
    assert sorted(r.n for r in counts.collect()) == sorted(want.values())
    words = pseudo_likelihood.vocabulary(counts, most)
    assert words.total.sum() == sum(want.values())
    hashes = {w: next(pseudo_likelihood.tokens(pa.array([w]), 64))[1] for w in want}
    classes = {w: int(words.classes(h, np.array([want[w]]))[0]) for w, h in hashes.items()}
    mass = np.bincount(list(classes.values()), [want[w] for w in classes], pseudo_likelihood.CLASSES)
    assert np.array_equal(mass, words.total)
    assert classes[often] < pseudo_likelihood.OWN <= classes[rare]
    got = {i: s for r in pseudo_likelihood.classed(parts, counts, words).collect() for i, s in zip(r.doc_ids, r.shares, strict=True)}
    for i, text in texts.items():
        assert np.isclose(got[i], sum(np.log(want[w] / mass[classes[w]]) for w in (text or "").lower().split()))


def test_training_predicts_every_token():
    rounds = [np.arange(1003)[pseudo_likelihood.turn_of(turn)] for turn in range(pseudo_likelihood.ROUNDS)]
    assert np.array_equal(np.sort(np.concatenate(rounds)), np.arange(1003))


def test_stages_decide_by_row(spark):
    texts = [f"{w} is a text of its own with some words" for w in ("alpha", "beta", "gamma")]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[2]), (4, texts[1]), (None, "p"), (None, "q"), (None, "q"), (6, None), (6, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    tuples = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    whole = {("2", texts[0]), ("4", texts[1]), ("3", texts[2]), ("None", "p"), ("None", "q"), ("6", "None")}
    assert tuples(exact_dedup.keep_unique(docs)) == sorted(whole)
    near = (whole - {("2", texts[0]), ("4", texts[1])}) | {("1", texts[0]), ("3", texts[1])}
    assert tuples(near_dedup.keep_distinct(docs)) == sorted([*near, ("6", "None")])  # blank texts are linked with nothing
    one = spark.createDataFrame([(7, "a b", "s"), (7, "a b", "s"), (7, "c d e f", "s"), (None, "g", "s")], docs.schema)
    assert mixing.mixed_documents(one).count() == 4  # of one source every row is taken once


@pytest.mark.parametrize("module", [near_dedup, line_dedup], ids=["near", "lines"])
def test_other_splits_between_the_passes(spark, tmp_path, monkeypatch, module):
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) if k % 3 else f"only {k}\nline a\nline b" for k in range(12)]
    path = f"file://{tmp_path}/docs"
    for k, text in enumerate(texts):
        spark.createDataFrame([(k, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    docs, key = spark.read.parquet(path), "spark.sql.files.maxPartitionBytes"
    run = module.near_dedup if module is near_dedup else module.line_dedup
    step = "settled" if module is near_dedup else "written"
    want, usual, written = sorted(map(tuple, run(docs).collect()), key=str), spark.conf.get(key), getattr(module, step)

    def resplit(df, name, *done):
        out = written(df, name, *done)
        spark.conf.set(key, "8k")  # as when other cores are registered
        return out

    monkeypatch.setattr(module, step, resplit)
    try:
        spark.conf.set(key, "1g")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        assert sorted(map(tuple, run(docs).collect()), key=str) == want
    finally:
        spark.conf.set(key, usual)
        spark.conf.unset("spark.sql.files.minPartitionNum")
