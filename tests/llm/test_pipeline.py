"""The pipeline's stages against plain Python, each on what the one before it wrote."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import mixing, pieces, toxicity  # noqa: E402
from tessera.llm.common import table, written  # noqa: E402
from tests.llm.test_against_brute_force import brute_components  # noqa: E402
from tests.llm.test_mixing import brute_mix  # noqa: E402
from tests.llm.test_small_tables import ROWS, SCHEMA  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    ids = [[r.doc_id for r in out.select("doc_id").collect()] for _, out in kept]
    predicted = {r.doc_id for r in toxicity.op3_toxicity(spark, DATA).where("predicted = 1").collect()}
    whole = dict(table(spark, DATA, "documents").select("doc_id", "text").collect())
    assert set(ids[0]) == set(whole) - predicted
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for i in sorted(ids[0]):
        last[whole[i].translate(low)] = i
    assert sorted(ids[1]) == sorted(last.values())
    _, label = brute_components({i: whole[i] for i in ids[1]})
    assert sorted(ids[2]) == sorted({label[i] for i in ids[1]})
    # the mix: as often as the slots of a schedule, walked one by one, read a document
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", whole[r.doc_id]))) for r in kept[3][0].select("doc_id", "source").collect()]
    taken, _ = brute_mix(rows, {r.source: r.target for r in mixing.mixed_sizes(kept[3][0]).collect()})
    want = Counter({i: -(-taken[i] // n) for i, _, n in rows if n})
    assert Counter(ids[3]) == +want
    final = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    encoder = pieces.Encoder(pieces.Vocabulary.load())
    assert Counter(r.doc_id for r in final) == +want
    assert all(list(r.ids) == encoder.encode([whole[r.doc_id]])[0] and r.round_trip for r in final)


def test_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeated rows, a long text and clashing names through all stages; then an empty table."""
    clash = ("row", "run", "digest", "size", "rank", "bands", "_id", "key", "s", "start", "n", "bucket", "slot", "label", "node")
    nameless = (None, "a text without an id", None, "s1")
    for folder, rows in (("full", [*ROWS, nameless, nameless]), ("none", [])):
        docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in clash])
        docs.write.parquet(f"file://{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/full")
    got = Counter(r.doc_id for r in out.collect())
    # 1 is a copy of 2; 3, 4 and 5 have no words, so the mix takes none of them; the long text is above its share
    assert set(got) == {None, 2, 6, 7, 8, 9, 10} and got[7] == 1 and max(got.values()) <= 3
    empty = corpus_pipeline.run(spark, f"file://{tmp_path}/none")
    assert empty.columns == out.columns and empty.count() == 0
