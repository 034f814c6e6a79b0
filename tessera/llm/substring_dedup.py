"""Substring dedup by relative Lempel-Ziv parsing over content-defined phrases.

A text is its sequence of words, a window is ``WINDOW`` consecutive ones. Each window has an anchor: the leftmost of its
``SEED``-word grams with the least hash. Neighbouring windows with one anchor form a phrase, so a text is a sequence of
phrases that depend on its own words alone, and equal stretches of text have equal phrases but for their ends. The
reference is the whole corpus: its phrases are dealt by anchor to index blocks, and each phrase of each text meets the
block that may hold it, so every text is parsed against every block that could have a factor of it.

* Parsing. A phrase that occurs elsewhere has two sources, its first and its last occurrence (but itself). ``parse`` walks
  over the phrases of a text and takes, greedily, the source that goes on longest with the phrases that follow. Each
  factor holds a whole phrase and so ``WINDOW`` words at least: it is a duplicate span.
* Factor boundaries. A factor may begin or end within a phrase, which then occurs nowhere else as a whole while its anchor
  does. Windows of such phrases are checked one by one: equal windows have the same anchor, so each is compared, by its
  hash, with the windows of all phrases of its anchor, one occurrence of each phrase.

Windows are known by two 64-bit hashes (of the anchor's words and of all words), phrases likewise. Equal texts are parsed
once and count as often as they occur. No pair is ever formed; a join has one row for each key on one side, so that Spark
splits the partition of a key that very many rows share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, settled, table
from tessera.llm.texthash import STEP, U, inverse, mixed, slices, word_hashes

WINDOW, SEED = 35, 8
KEY = ["a", "b", "doc_id"]  # two hashes of a text, and the row that stands for it
PHRASES_SQL = "a long, b long, doc_id long, first array<int>, n array<int>, seed array<long>, phrase array<long>"
FACTORS_SQL = "t long, first int, n int, source long"


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the leftmost least of values[i : i + width], as far as that is inside."""
    best, span = np.arange(len(values)), 1
    while span < width and len(best) > 1:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


class Ranges:
    """Hashes of ranges of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        power, back = np.full(len(words) + 1, STEP, U), np.full(len(words) + 1, U(inverse(int(STEP))), U)
        power[0] = back[0] = 1
        power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        self.total = np.concatenate((np.zeros(1, U), np.cumsum(words * power[:-1], dtype=U)))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.total[stop] - self.total[start]) * self.back[start])


def phrases(words: np.ndarray, at: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, first, n, anchor hash, phrase hash) of the phrases of rows whose words are words[at[i] : at[i + 1]]: a phrase
    is the windows that begin at its n words from first on (counted over all rows)."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none.astype(U), none.astype(U)
    ranges, places = Ranges(words), np.arange(len(words) - seed + 1)
    grams = ranges(places, places + seed)
    ends = np.repeat(at[1:], np.diff(at))
    starts = np.flatnonzero(np.arange(len(words)) + window <= ends)
    if not len(starts):
        return none, none, none, none.astype(U), none.astype(U)
    anchor = leftmost_least(grams, window - seed + 1)[starts]
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, n = starts[new], np.diff(np.concatenate((new, [len(starts)])))
    return np.searchsorted(at, first, "right") - 1, first, n, grams[anchor[new]], ranges(first, first + n - 1 + window)


def _parsed(window: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, data, offsets in slices(batch.column("text")):
                words, at = word_hashes(data, offsets, lowered=False)
                row, first, n, seeds, found = phrases(words, at, window, seed)
                ends = np.searchsorted(row, np.arange(len(at))).astype(np.int32)
                values = ((first - at[row]).astype(np.int32), n.astype(np.int32), seeds.view(np.int64), found.view(np.int64))
                lists = [pa.ListArray.from_arrays(ends, x) for x in values]
                known = [batch.column(c)[top : top + len(at) - 1] for c in KEY]
                yield pa.RecordBatch.from_arrays([*known, *lists], names=[*KEY, "first", "n", "seed", "phrase"])

    return run


def _windows(window: int):
    """The hashes of all windows of the phrases in spots (first, n, seed), a row for each phrase."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, data, offsets in slices(batch.column("text")):
                words, at = word_hashes(data, offsets, lowered=False)
                ranges = Ranges(words)
                spots = batch.column("spots")[top : top + len(at) - 1]
                count = np.diff(spots.offsets.to_numpy())
                first, n, seeds = (np.asarray(x) for x in spots.flatten().flatten())
                begin = np.cumsum(n) - n
                start = np.repeat(np.repeat(at[:-1], count) + first - begin, n) + np.arange(n.sum())
                hashes = ranges(start, start + window).view(np.int64)
                owner = np.repeat(np.asarray(batch.column("t")[top : top + len(at) - 1]), count)
                ends = np.concatenate((begin, [n.sum()])).astype(np.int32)
                for i in range(0, len(n), 5000):
                    j = min(len(n), i + 5000)
                    lists = pa.ListArray.from_arrays(ends[i : j + 1] - ends[i], hashes[ends[i] : ends[j]])
                    yield pa.RecordBatch.from_arrays([pa.array(owner[i:j]), pa.array(first[i:j]), pa.array(seeds[i:j]), lists], names=["t", "first", "seed", "hashes"])

    return run


def parse(hits: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """Factors (first, n, source) of a text from its repeated phrases (pid, first, n, low, high) in order: windows from
    first on, n of them, are those of the phrase source and of the phrases after it. Greedy, the longest first."""
    i = 0
    while i < len(hits):
        pid, first, n, low, high = hits[i]
        ends = {}
        for source in {x for x in (low, high) if x != pid} or {pid}:
            j, to = i + 1, n
            while j < len(hits) and hits[j][0] == pid + j - i and source + j - i in hits[j][3:5]:
                to += hits[j][2]
                j += 1
            ends[source] = (j, to)
        source = max(sorted(ends), key=lambda x: ends[x][0])
        i, to = ends[source]
        yield first, to, source


def _factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, first, n, source = [], [], [], []
        for t, hits in zip(batch.column("t").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            for x in parse([(h["pid"], h["first"], h["n"], h["low"], h["high"]) for h in hits]):
                owner.append(t)
                first.append(x[0])
                n.append(x[1])
                source.append(x[2])
        yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(source, pa.int64())], names=["t", "first", "n", "source"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with two hashes of their texts; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(texts, marks). texts: t, a, b, doc_id of each different text with a phrase, doc_id being that of the row that
    stands for it. marks: (t, first, n, source): the n windows of text t from word first on occur elsewhere too, those of
    a factor from the phrase source on; source is null for windows at the boundaries of factors."""
    parsed = keyed(docs).mapInArrow(_parsed(window, seed), PHRASES_SQL).withColumn("t", F.monotonically_increasing_id())
    parsed = settled(parsed.where(F.size("first") > 0), "parsed")
    texts = parsed.groupBy("a", "b").agg(F.min(F.struct("t", "doc_id")).alias("x"), F.count(F.lit(1)).alias("copies"))
    texts = settled(texts.select("x.t", "a", "b", "x.doc_id", "copies"), "texts")
    every = parsed.join(texts.select("t", "copies").hint("merge"), "t").select("t", "copies", F.explode(F.arrays_zip("first", "n", "seed", "phrase")).alias("p"))
    # phrases of a text follow each other
    every = settled(every.select("t", "copies", "p.*").withColumn("pid", F.monotonically_increasing_id()), "every", parsed)
    index = every.groupBy("seed", "phrase").agg(F.sum("copies").alias("copies"), F.min("pid").alias("low"), F.max("pid").alias("high"), *[F.min(c).alias(c) for c in ("t", "first", "n")])
    index = settled(index, "index")
    sources = index.where("copies > 1").select("seed", "phrase", "low", "high")
    hits = settled(every.drop("copies").join(sources.hint("merge"), ["seed", "phrase"]).drop("phrase"), "hits", every)
    # one occurrence of each phrase whose anchor has others: where low = high, t, first and n are those of the only one
    spots = index.where("low = high").select("t", "first", "n", "seed").union(hits.where("pid = low AND low < high").select("t", "first", "n", "seed"))
    several = index.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("seed")
    spots = spots.join(several.hint("merge"), "seed", "left_semi").groupBy("t").agg(F.collect_list(F.struct("first", "n", "seed")).alias("spots"))
    spots = settled(spots, "spots", index)
    listed = hits.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("pid", "first", "n", "low", "high"))).alias("hits"))
    factors = settled(listed.mapInArrow(_factors, FACTORS_SQL), "factors", hits)
    named = lambda df: df.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    found = named(keyed(docs)).join(named(spots.join(texts.drop("copies"), "t")).hint("merge"), [*KEY, "known"]).select("t", "text", "spots")
    found = settled(found.mapInArrow(_windows(window), "t long, first int, seed long, hashes array<long>"), "windows", spots)
    each = found.select("t", "first", "seed", F.posexplode("hashes").alias("i", "hash")).select("t", (F.col("first") + F.col("i")).alias("first"), "seed", "hash")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("t", "first") for f in (F.min, F.max)]
    # a row that is repeated may bring a window twice, so places are compared instead of counted
    twice = each.groupBy("seed", "hash").agg(*ends).where("min_t <> max_t OR min_first <> max_first").select("seed", "hash")
    checked = each.join(twice.hint("merge"), ["seed", "hash"], "left_semi").select("t", "first", F.lit(1).alias("n"), F.lit(None).cast("long").alias("source"))
    return texts, settled(factors.union(checked), "marks", factors, found)


def _kept(window: int):
    word = regex.compile(WORD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in range(0, len(batch), 256):
                ids, texts, marks = (batch.column(c)[top : top + 256] for c in ("doc_id", "text", "marks"))
                total, removed, out = [], [], []
                for text, spans in zip(texts.to_pylist(), marks.to_pylist(), strict=True):
                    words = word.findall(text)
                    total.append(len(words))
                    if spans:
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, [s["first"] for s in spans], 1)
                        np.add.at(step, [s["first"] + s["n"] - 1 + window for s in spans], -1)
                        stays = np.cumsum(step[:-1]) == 0
                        words = [words[i] for i in np.flatnonzero(stays)]
                    removed.append(total[-1] - len(words))
                    out.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, text (the words that stay, joined by one space).

    Words are the runs without the white space of ASCII, unchanged. A word goes if a window that covers it also begins at
    another place, in the same text or another; windows are judged on the input. A null text has no words, and neither has
    a blank one; a text of fewer words than a window loses none. Repeated rows are copies of each other and lose all words
    of a text that is at least a window long, whatever their doc_id, null or not. An empty table gives an empty result.
    Other columns of docs aren't read.
    """
    texts, marks = repeated_windows(docs, window, seed)
    listed = marks.groupBy("t").agg(F.collect_list(F.struct("first", "n")).alias("marks")).join(texts.select("t", "a", "b"), "t").drop("t")
    return keyed(docs).join(listed.hint("merge"), ["a", "b"], "left").select("doc_id", "text", "marks").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, text string")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The duplicate spans of each different text that has some: doc_id (of the row that stands for the text, the first
    read), start and stop in words, factor (false: a window at a boundary of factors)."""
    texts, marks = repeated_windows(docs, window, seed)
    spans = marks.join(texts, "t")
    return spans.select("doc_id", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + window).alias("stop"), F.col("source").isNotNull().alias("factor"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op11_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
        p AS (SELECT id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS s FROM d),
        h AS (SELECT id, s, md5(array_to_string(w[s : s + {WINDOW - 1}], ' ')) AS h FROM p),
        r AS (SELECT id, s FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
        g AS (SELECT DISTINCT id, unnest(range(s, s + {WINDOW})) AS i FROM r),
        x AS (SELECT id, count(*) AS n, list(i) AS gone FROM g GROUP BY id),
        u AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        k AS (SELECT u.id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN g ON u.id = g.id AND u.i = g.i WHERE g.id IS NULL GROUP BY u.id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN x ON d.id = x.id LEFT JOIN k ON d.id = k.id"""
}
QUERIES = {"op11_substring_dedup": op11_substring_dedup}
