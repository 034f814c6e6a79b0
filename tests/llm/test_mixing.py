"""The mix against a schedule that is walked slot by slot in plain Python."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import mixing


def corput(k):
    return int(f"{k:b}"[::-1], 2) / 2 ** k.bit_length() if k else 0.0


def golden(k):
    return k * mixing.GOLDEN % 1.0


def brute_mix(docs, targets, point=corput, block=mixing.BLOCK, slots=mixing.SLOTS):
    """docs: (doc_id, source, size) with unique doc_id; targets: by source. The words taken and first slot of each."""
    total = sum(d[2] for d in docs)
    block = max(1, min(block, total // slots))
    line = defaultdict(list)
    for doc_id, source, size in sorted(docs, key=lambda d: hashlib.md5(f"mix{d[0]}".encode()).hexdigest()):
        line[source] += [doc_id] * size
    names = sorted(targets, key=lambda s: (s is None, s))
    ends = np.round(np.cumsum([targets[s] for s in names]) / sum(targets.values()), 12)
    seen, taken, first = defaultdict(int), defaultdict(int), {}
    slots = -(-total // block)
    plan = []
    for slot in range(slots):
        source = names[int(np.searchsorted(ends, point(slot), "right"))]
        plan.append((slot, source, seen[source]))
        seen[source] += 1
    want = {s: int(targets[s] + 0.5) for s in names}
    for i, s in enumerate(names):
        plan += [(slots + (rank - seen[s]) * len(names) + i, s, rank) for rank in range(seen[s], -(-want[s] // block))]
    for slot, source, rank in plan:
        blocks = -(-want[source] // block)
        if rank >= blocks:
            continue
        at = shuffle(rank, blocks)
        for doc_id in (line[source] * 3)[at * block : min((at + 1) * block, want[source])]:
            taken[doc_id] += 1
            first[doc_id] = min(slot, first.get(doc_id, slot))
    return taken, first


def shuffle(rank, blocks):
    full, (chunk, inner) = blocks // 1024, divmod(rank, 1024)
    if chunk == full:
        return full * 1024 + inner * 1031 % (blocks - full * 1024)
    moved = chunk * (4294967311 % full) % full
    return moved * 1024 + (inner * 1031 + moved * 7) % 1024


@pytest.mark.parametrize("blocks", [1, 2, 700, 1023, 1024, 1030, 5000, 10_240])
def test_the_shuffle_is_one(spark, blocks):
    from pyspark.sql import functions as F

    got = [r.at for r in spark.range(blocks).select(mixing.shuffled(F.col("id"), F.lit(blocks)).alias("at"), "id").orderBy("id").collect()]
    assert sorted(got) == list(range(blocks)) and got == [shuffle(i, blocks) for i in range(blocks)]


def test_small_sources_are_not_lost(spark):
    """One source of 600,000 words and eight of five, of which a block would hold all."""
    rows = [(i, "big", 10_000) for i in range(60)] + [(100 + i, f"s{i}", 5) for i in range(8)]
    got = mixing.mixed_sizes(frame(spark, rows), slots=64).collect()
    for source, target in {r.source: r.target for r in got}.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= max(1, target / 100)
    assert {r.source for r in got if r.taken} == {"big", *(f"s{i}" for i in range(8))}
    assert {r.doc_id for r in mixing.mixed_documents(frame(spark, rows)).collect()} >= set(range(100, 108))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    return [(i, f"s{i * i % 7}" if i % 5 else None, int(rng.integers(0, 60))) for i in range(90)]


def frame(spark, rows):
    return spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, s, n in rows], "doc_id long, source string, text string")


@pytest.mark.parametrize("slots", [40, 300, 65536])
@pytest.mark.parametrize(("point", "plain"), [(mixing.van_der_corput, corput), (mixing.golden, golden)], ids=["corput", "golden"])
def test_the_schedule_decides(spark, rows, slots, point, plain):
    got = mixing.mixed_sizes(frame(spark, rows), slots=slots, point=point).collect()
    targets = {r.source: r.target for r in got}
    taken, first = brute_mix(rows, targets, plain, slots=slots)
    assert {r.doc_id: (r.taken, r.first_slot) for r in got} == {i: (taken[i], first.get(i)) for i, _, _ in rows}
    off = [abs(sum(taken[i] for i, s, _ in rows if s == source) - target) for source, target in targets.items()]
    assert max(off) <= 1
    assert all(r.taken <= 3 * r.size for r in got)


def test_another_sequence_reads_other_words(spark, rows):
    """What is taken of a source is its target whatever the sequence; which slot reads which words is the sequence's."""
    by = {}
    for point in (mixing.van_der_corput, mixing.golden):
        _, taken = mixing.mix(frame(spark, rows), slots=300, point=point)
        by[point] = {(r.slot, r.doc_id, r.from_word, r.words) for r in taken.collect()}
    a, b = by.values()
    assert a != b and sum(x[3] for x in a) == sum(x[3] for x in b)


def test_every_stretch_has_the_shares(spark):
    sources = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 0.0), (3, 20.0)], "s int, target double")
    found = sorted(tuple(r) for r in mixing.schedule(spark, sources, 4096).collect())
    assert [r[0] for r in found] == list(range(4096)) and all(s != 2 for _, s, _ in found)
    for first in range(0, 4096, 256):
        n = np.bincount([s for _, s, _ in found[first : first + 256]], minlength=4)
        assert np.abs(n / 256 - [0.5, 0.3, 0, 0.2]).max() < 0.03
    for s in (0, 1, 3):
        assert [r for _, x, r in found if x == s] == list(range(sum(x == s for _, x, _ in found)))


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(Exception, match="more than 2 sources"):
        mixing.mixed_sizes(frame(spark, [(1, "a", 3), (2, "b", 3), (3, "c", 3)])).count()
