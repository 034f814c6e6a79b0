"""Spelling variant grouping with a bit-sliced position index.

The vocabulary is dealt to blocks. In a block, a bit set for each (position, letter) has the words with that letter there,
as one long integer; its bits are words. For a query word all words of a block are walked at once: after each letter the
set of words without an error so far, and the sets with one error by kind, are intersected with the bit set of the letter
at the same position (replaced), one further (the other word has a letter more) or one before (a letter less).

Blocks: of two words that differ by one letter, the shorter one (or either) having m letters, the first ``m // 2`` letters
or the last ``m - m // 2`` agree. So a word of length L lies in the blocks of its beginning and of its end for m = L and
m = L - 1, and meets a near word in exactly one of them: pairs whose beginning agrees are left out in the blocks of ends.
A large block is cut to parts of at most ``PART`` words, and its words are queries to each part. What leaves a block is a
count and the best near word for each query, never a pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

RUN = "[A-Za-zÀ-ÿ]+"
EVERY = 199  # a word of a document loses a letter if this divides its hash
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
PART = 1 << 14
HELD = 400_000  # words that a task counts before it sends them on


def seen(doc_id: str, run: str) -> str:
    """The word that is counted for a lower-cased run of a document."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _lower(text: str) -> str:
    """A-Z alone become a-z, as lower() of bytes does."""
    return text.encode().lower().decode()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, words = re.compile(RUN), Counter()

    def sent() -> Iterator[pa.RecordBatch]:
        items = list(words.items())
        words.clear()
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            for run, n in Counter(find.findall(_lower(text.as_py() or ""))).items():
                words[seen(doc_id, run)] += n
            if len(words) > HELD:
                yield from sent()
    yield from sent()


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least so many code points that occur so often. A null doc_id is an empty text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counted, "word string, n long").where(F.length("word") >= letters)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Index:
    """The bit sets of some words."""

    def __init__(self, words: list[str]):
        at, length = defaultdict(list), defaultdict(list)
        for i, w in enumerate(words):
            length[len(w)].append(i)
            for j, c in enumerate(w):
                at[j, c].append(i)
        self.size = len(words)
        self.at, self.length = ({k: self.bits(v) for k, v in x.items()} for x in (at, length))

    def bits(self, places: list[int]) -> int:
        if self.size < 512:
            return sum(1 << i for i in places)
        out = bytearray(self.size // 8 + 1)
        for i in places:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    def near(self, word: str, head: int, apart: bool, shortest: int) -> int:
        """The words at one error from word, of pairs whose shorter one has ``shortest`` letters; with apart, only those
        that don't agree with word in the first head letters."""
        at, get = self.at, self.at.get
        clean = (1 << self.size) - 1  # no error so far
        other = more = less = 0  # one: a letter replaced, a letter more in the other word, a letter less
        same = 0
        for i, c in enumerate(word):
            here = get((i, c), 0)
            other = (other & here) | (clean & ~here)
            more = (more | clean) & get((i + 1, c), 0)
            less = clean | (less & get((i - 1, c), 0)) if i else clean
            clean &= here
            if i + 1 == head:
                same = clean
            if not (clean | other | more | less):
                return 0
        n = len(word)
        found = 0
        if n == shortest:
            found = (other & self.length.get(n, 0)) | ((more | clean) & self.length.get(n + 1, 0))
        elif n == shortest + 1:
            found = less & self.length.get(n - 1, 0)
        return found & ~same if apart else found


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the queries of one part of a block: how many, and the best."""
    types = [("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]
    for batch in batches:
        rows = []
        for m, side, i, j, words in zip(*[batch.column(c).to_pylist() for c in ("m", "side", "i", "j", "words")], strict=True):
            known = sorted((-x["n"], x["word"]) for x in words if x["part"] == i)
            index = Index([w for _, w in known])
            for x in words:
                if x["part"] == j and (found := index.near(x["word"], m // 2, side == "end", m)):
                    n, best = known[(found & -found).bit_length() - 1]
                    rows.append((x["word"], found.bit_count(), -n, best))
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones: how many, and the one of largest n, ties to
    the smallest in code-point order."""
    n, ends = F.length("word"), []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        ends += [F.struct(m.alias("m"), F.lit(side).alias("side"), key.alias("key")) for side, key in (("begin", F.substring("word", F.lit(1), half)), ("end", F.substring("word", n - (m - half) + 1, m - half)))]
    rows = words.select("word", "n", F.explode(F.array(*ends)).alias("b")).select("word", "n", "b.*")
    block = ["m", "side", "key"]
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("parts", (F.floor(F.col("size") / part) + 1).cast("int"))
    rows = rows.join(sizes.drop("size").hint("merge"), block).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    met = F.array_distinct(F.concat(F.transform(others, lambda x: F.struct(F.col("part").alias("i"), x.alias("j"))), F.transform(others, lambda x: F.struct(x.alias("i"), F.col("part").alias("j")))))
    groups = rows.withColumn("to", F.explode(met)).groupBy(*block, "to.i", "to.j").agg(F.collect_list(F.struct("word", "n", "part")).alias("words"))
    found = groups.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("x")).select("word", "n_near", (-F.col("x.n")).alias("best_n"), "x.best")


def variants(words: DataFrame, times: int = TIMES, part: int = PART) -> DataFrame:
    """One row for each of words (word, n): word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: smallest in code-point order) if that is at least ``times`` the word's n,
    else null; root is where the forms end that begin with word, itself if it has none. Words are unique and not null.
    An empty table gives an empty result.
    """
    near = near_words(words, part)
    out = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")), "near")
    links = written(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:  # chains halve in each round; n grows by ``times`` along a chain, so there are few
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(after, "root", "left_semi").isEmpty():
            break
        links = written(links.join(after.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    out = out.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """variants of the vocabulary of docs. Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z
    lower-cased, some of them with a letter dropped (``seen``), of at least 6 code points that occur at least 5 times. A
    null text has none. Repeated rows count as often as they are there. Other columns aren't read."""
    return variants(written(vocabulary(docs), "words"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
