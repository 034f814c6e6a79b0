"""LM scoring by masked pseudo-likelihood: each token is predicted from the two tokens on either side.

The texts are read once: each slice of them becomes a row with the words it holds, by 64-bit hash, and the number of
each token's word. Spark counts every word of the corpus into a table. The most frequent words are classes of their own,
the rest fall by their counts into classes of equal mass, and a word's share of its class is its count's. The counts are
joined back to the words of each slice, which leaves a byte for each token: its class. On these the window network
(position-wise class embeddings, tanh, softmax over classes) is trained in numpy. Documents are dealt to shards of about
``SHARD`` tokens by a hash of their ids and classes; each shard trains from the same weights on every ``STRIDE``-th token
of all its texts, in an order that the hashes give, and the weights are averaged by tokens. This is done ``ROUNDS``
times, each time on other tokens, until every token was predicted once. So scores don't depend on how the input lies in
partitions. The last pass sums log P(class | window) + log P(word | class) over every token of a document. No word
shares another's count. The network has a fixed size; the driver gets one row for each different count and the averaged
weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.texthash import SLICE, U, slices, word_hashes

BITS = 18
BUCKETS = 1 << BITS  # so many words at most are sent to all tasks with their counts; the others are joined
TEXT = 1 << 20  # bytes of a slice, which then seldom has more than 2^16 different words
CLASSES, OWN = 128, 96  # of all classes so many hold one word
WINDOW = (-2, -1, 1, 2)
DIM = 24
STRIDE, ROUNDS, RATE, STEP_TOKENS = 2, 2, 0.15, 256  # as many rounds as the stride: every token is learnt from
BLOCK = 16384  # tokens that are scored at once


@dataclass
class Words:
    """The class of each bucket and the log of its share of the class."""

    classes: np.ndarray
    share: np.ndarray


def word_classes(counts: np.ndarray) -> Words:
    order = np.argsort(-counts, kind="stable")
    rest = counts[order[OWN:]] + 1.0  # a bucket that the corpus lacks has some mass too
    bins = np.minimum((np.cumsum(rest) - rest / 2) / rest.sum() * (CLASSES - OWN), CLASSES - OWN - 1).astype(np.int16)
    classes = np.empty(BUCKETS, np.int16)
    classes[order[:OWN]] = np.arange(OWN)
    classes[order[OWN:]] = OWN + bins
    mass = np.bincount(classes, counts + 1.0, CLASSES)
    return Words(classes, np.log((counts + 1.0) / mass[classes]))


class Network:
    """weights: one embedding of each class (and of the edge of a text) for each place of the window, and the output."""

    shapes = [(len(WINDOW), CLASSES + 1, DIM), (DIM,), (DIM, CLASSES), (CLASSES,)]
    size = sum(int(np.prod(s)) for s in shapes)

    def __init__(self, flat: np.ndarray):
        ends = np.cumsum([0, *[int(np.prod(s)) for s in self.shapes]])
        self.flat = flat.astype(np.float32)
        self.embed, self.bias, self.out, self.base = (self.flat[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], self.shapes, strict=False))

    @classmethod
    def start(cls, classes: np.ndarray) -> Network:
        """Small random weights; the output's base is the frequency of the classes."""
        net = cls(np.random.default_rng(4).normal(0, 0.1, cls.size))
        net.bias[:] = 0
        net.base[:] = np.log(classes / classes.sum())
        return net

    def hidden(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.broadcast_to(self.bias, (len(at), DIM)).copy()
        for place, shift in enumerate(WINDOW):
            total += self.embed[place][padded[at + shift]]
        return np.tanh(total)

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(class at each place | its window)."""
        z = self.hidden(padded, at) @ self.out + self.base
        z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(at)), padded[at]]
        return own - np.log(np.exp(z).sum(axis=1))

    def learn(self, padded: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step down the gradient of the mean negative log probability."""
        h = self.hidden(padded, at)
        z = h @ self.out + self.base
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(at)), padded[at]] -= 1
        p *= rate / len(at) ** 0.5
        back = (p @ self.out.T) * (1 - h * h)
        self.out -= h.T @ p
        self.base -= p.sum(axis=0)
        self.bias -= back.sum(axis=0)
        dims, flat = np.arange(DIM), back.ravel()
        for place, shift in enumerate(WINDOW):  # the sum over the tokens of each class
            cells = (padded[at + shift][:, None] * DIM + dims).ravel()
            self.embed[place] -= np.bincount(cells, flat, (CLASSES + 1) * DIM).reshape(CLASSES + 1, DIM)


def tokens(column: pa.Array, bits: int = BITS, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, the first bits of each word's hash, words before each row and after the last), slice by slice."""
    for first, data, offsets in slices(column, most):
        hashes, at = word_hashes(data, offsets)
        yield first, hashes if bits == 64 else (hashes >> U(64 - bits)).astype(np.int64), at


def padded_classes(classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes with the edge's class between texts, twice, and the place of each word among them."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(classes)) + 2 * (text + 1)
    out = np.full(len(classes) + 2 * len(at), CLASSES, np.int64)
    out[place] = classes
    return out, place


CODED = "chunk long, doc_ids array<long>, at array<long>, tokens binary, words array<long>, n array<long>"


def sliced(docs: DataFrame) -> DataFrame:
    """A row for each slice of texts: its documents, the tokens before each and after the last, the distinct words (their
    hashes) with their counts in the slice, and the number of each token's word among them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, hashes, at in tokens(batch.column("text"), 64, TEXT):
                words, number, n = np.unique(hashes, return_inverse=True, return_counts=True)
                ids = batch.column("doc_id")[first : first + len(at) - 1]
                row = [[chunk], [ids.to_pylist()], [at], [number.astype(_width(len(words))).tobytes()], [words.view(np.int64)], [n]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "doc_ids", "at", "tokens", "words", "n"])
                chunk += 1

    return docs.mapInArrow(run, CODED)


def _width(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


@dataclass
class Vocabulary:
    """What gives each word its class and share: the hashes of the OWN most frequent words; of the others, for each
    different count, rising, the mass of all words that are more frequent and of those with this count; the mass of each
    class. The words of one count follow each other by hash. hot: the hashes, rising, and the counts of frequent words."""

    own: np.ndarray
    counts: np.ndarray
    before: np.ndarray
    mass: np.ndarray
    total: np.ndarray
    hot: np.ndarray
    hot_n: np.ndarray

    def shares(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.log(n / np.maximum(self.total[classes], 1))

    def classes(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        level = np.minimum(np.searchsorted(self.counts, n), max(len(self.counts) - 1, 0))
        out = np.full(len(words), OWN, np.uint8)
        if len(self.counts):
            place = self.before[level] + (words >> U(11)).astype(np.float64) / 2.0**53 * self.mass[level]
            out = (OWN + np.minimum(place / self.mass.sum() * (CLASSES - OWN), CLASSES - OWN - 1)).astype(np.uint8)
        rank = np.argsort(self.own)
        at = rank[np.minimum(np.searchsorted(self.own, words, sorter=rank), len(self.own) - 1)]
        return np.where(self.own[at] == words, at, out).astype(np.uint8)


def vocabulary(counts: DataFrame, most: int = BUCKETS) -> Vocabulary:
    """counts: (word, n), each word once; most: how many hot words there are at most beside the OWN first ones."""
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    levels = dict(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect())  # at most (2 * tokens) ** 0.5 rows
    upto = dict(zip(sorted(levels, reverse=True), np.cumsum([levels[k] for k in sorted(levels, reverse=True)]).tolist(), strict=True))
    least = min((k for k, words in upto.items() if words <= most), default=2**62)
    hot = counts.where((F.col("n") >= least) | F.col("word").isin([r.word for r in top])).toPandas()
    order = np.argsort(hot_words := hot["word"].to_numpy(np.int64).view(U))
    for row in top:
        levels[row.n] -= 1
    n = np.array(sorted(k for k, members in levels.items() if members), np.int64)
    mass = n.astype(np.float64) * np.array([levels[k] for k in n.tolist()], np.float64)
    own = np.array([r.word for r in top], np.int64).view(U)
    found = Vocabulary(own, n, mass.sum() - np.cumsum(mass), mass, np.zeros(CLASSES), hot_words[order], hot["n"].to_numpy(np.int64)[order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            words, n = (batch.column(c).to_numpy() for c in ("word", "n"))
            np.add.at(total, found.classes(words.view(U), n), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], names=["class", "n"])

    if top:
        for row in counts.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
            found.total[row["class"]] = row.n
    return found


def corpus_counts(slices: DataFrame) -> DataFrame:
    """(word, n): how often each word comes in all texts."""
    rows = slices.select(F.explode(F.arrays_zip("words", "n")).alias("x"))
    return rows.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.n").alias("n"))


REST = "chunk long, doc_ids array<long>, at array<long>, classes binary, shares array<double>, words array<long>, rare binary, tokens binary"


def classed(slices: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_ids, at, classes, shares) of each slice: a byte for each token, and for each document the sum of the logs of
    its words' shares. Hot words are looked up, the others joined; those that the join leaves out come once."""
    spark = slices.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    rare = 255  # instead of a class, until the join

    def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                words, at = batch.column("words")[i].values.to_numpy().view(U), batch.column("at")[i].values.to_numpy()
                number = np.frombuffer(batch.column("tokens")[i].as_buffer(), _width(len(words)))
                classes, logs, other = np.zeros(len(words), np.uint8), np.zeros(len(words)), np.ones(len(words), bool)
                if len(words):
                    place = np.minimum(np.searchsorted(found.hot, words), len(found.hot) - 1)
                    other, n = found.hot[place] != words, found.hot_n[place]
                    classes = np.where(other, rare, found.classes(words, n)).astype(np.uint8)
                    logs = np.where(other, 0.0, found.shares(np.where(other, 0, classes), n))
                sums = np.concatenate(([0.0], np.cumsum(logs[number])))
                left = number[other[number]]
                left = (np.cumsum(other) - 1)[left].astype(_width(int(other.sum())))
                row = [batch.column("chunk")[i].as_py()], [batch.column("doc_ids")[i].as_py()], [at], [classes[number].tobytes()], [sums[at[1:]] - sums[at[:-1]]]
                row += [words[other].view(np.int64)], [np.packbits(other).tobytes()], [left.tobytes()]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                names = ["chunk", "doc_ids", "at", "classes", "shares", "words", "rare", "tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = shared.value, []
        for row in left.combine_chunks().to_batches():
            words, at = row.column("words")[0].values.to_numpy().view(U), row.column("at")[0].values.to_numpy()
            places = np.flatnonzero(np.unpackbits(np.frombuffer(row.column("rare")[0].as_buffer(), np.uint8)))
            n = np.ones(len(words), np.int64)
            n[np.searchsorted(places, right.column("place").to_numpy())] = right.column("n").to_numpy()
            kinds = found.classes(words, n)
            number = np.frombuffer(row.column("tokens")[0].as_buffer(), _width(len(words)))
            classes = np.frombuffer(row.column("classes")[0].as_buffer(), np.uint8).copy()
            spots = np.flatnonzero(classes == rare)
            classes[spots] = kinds[number]
            logs = np.zeros(len(classes))
            logs[spots] = found.shares(kinds, n)[number]
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            out.append([row.column("doc_ids")[0].as_py(), at, classes.tobytes(), row.column("shares")[0].values.to_numpy() + sums[at[1:]] - sums[at[:-1]]])
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64())]
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["doc_ids", "at", "classes", "shares"])

    hot = F.broadcast(spark.createDataFrame(pa.table({"word": vocabulary.hot.view(np.int64)})))
    rows = slices.select(F.col("chunk").alias("of"), F.posexplode("words").alias("place", "word")).join(hot, "word", "left_anti")
    known = rows.join(counts.where("n > 1").join(hot, "word", "left_anti"), "word").select("of", "place", "n")
    pairs = slices.mapInArrow(looked_up, REST).groupBy("chunk").cogroup(known.groupBy("of"))
    return pairs.applyInArrow(joined, "doc_ids array<long>, at array<long>, classes binary, shares array<double>")


SHARD = 1 << 21  # tokens
DOCS = "doc_id long, key long, n_tokens long, classes binary, share double"


def by_document(slices: DataFrame) -> DataFrame:
    """(doc_id, key, n_tokens, classes, share): the rows of classed() taken apart; key tells documents apart but for those
    with the same id and classes."""
    each = F.explode(F.arrays_zip(F.col("doc_ids"), F.slice("at", 1, F.size("doc_ids")).alias("first"), F.slice("at", 2, F.size("doc_ids")).alias("last"), F.col("shares"))).alias("d")
    rows = slices.select("classes", each)
    part = F.call_function("substring", F.col("classes"), (F.col("d.first") + 1).cast("int"), (F.col("d.last") - F.col("d.first")).cast("int"))
    rows = rows.select(F.col("d.doc_ids").alias("doc_id"), (F.col("d.last") - F.col("d.first")).alias("n_tokens"), part.alias("classes"), F.col("d.shares").alias("share"))
    return rows.select("doc_id", F.xxhash64("doc_id", "classes").alias("key"), "n_tokens", "classes", "share")


def texts_of(classes: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, tokens before each document and after the last)."""
    flat = b"".join(classes.to_pylist())
    return np.frombuffer(flat, np.uint8).astype(np.int64), np.concatenate(([0], np.cumsum(n)))


def turn_of(turn: int) -> slice:
    """The tokens that a round learns from."""
    return slice(turn * STRIDE // ROUNDS, None, STRIDE)


def learnt(net: Network, classes: pa.Array, n: np.ndarray, turn: int) -> int:
    """Train on the texts in their order, some at a time; the number of tokens that were predicted."""
    seen, first = 0, 0
    ends = np.cumsum(n)
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 18), "right")))
        padded, place = padded_classes(*texts_of(classes.slice(first, last - first), n[first:last]))
        place = place[turn_of(turn)]
        place = place[np.random.default_rng(len(place)).permutation(len(place))]
        for at in range(0, len(place), STEP_TOKENS):
            net.learn(padded, place[at : at + STEP_TOKENS], RATE / (1 + 0.0005 * seen / STEP_TOKENS))
            seen += len(place[at : at + STEP_TOKENS])
        first = last
    return seen


def _trainer(weights, turn: int):
    def train(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("key", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        own, n = Network(weights.value.copy()), shard.column("n_tokens").to_numpy()
        seen = learnt(own, pa.concat_arrays(shard.column("classes").chunks), n, turn)
        flat = own.flat.astype(np.float64) * seen
        return pa.table({"i": np.arange(len(flat), dtype=np.int32), "w": flat, "n": np.full(len(flat), seen)})

    return train


def trained(docs: DataFrame, total: np.ndarray) -> Network:
    """docs: as by_document gives; total: the mass of each class."""
    spark = docs.sparkSession
    net = Network.start(total + 1.0)
    shards = int(total.sum()) // SHARD + 1
    dealt = docs.where("n_tokens > 0").select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "doc_id", "n_tokens", "classes")
    for turn in range(ROUNDS):
        train = _trainer(spark.sparkContext.broadcast(net.flat), turn)
        sums = dealt.groupBy("shard").applyInArrow(train, "i int, w double, n long").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
        if len(sums):  # a row for each weight
            flat = np.zeros(Network.size)
            flat[sums["i"].to_numpy()] = sums["w"].to_numpy() / np.maximum(sums["n"].to_numpy(), 1)
            net = Network(flat)
    return net


def scored(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, log_prob (the sum over tokens), mean_log_prob.

    Words are the runs without the white space of ASCII, A-Z lower-cased. Null texts and texts without words have
    0 tokens, a log_prob of 0 and a null mean_log_prob. Rows that repeat a doc_id and its text have one score. An empty
    table gives an empty result. Other columns of docs aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = written(sliced(docs), "slices")
    counts = written(corpus_counts(parts), "words")
    words = vocabulary(counts)
    rows = written(by_document(classed(parts, counts, words)), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(trained(rows, words.total).flat)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            classes, at = texts_of(batch.column("classes"), n)
            padded, place = padded_classes(classes, at)
            logs = np.zeros(len(place))
            for b in range(0, len(place), BLOCK):
                logs[b : b + BLOCK] = net.log_probabilities(padded, place[b : b + BLOCK])
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            total = sums[at[1:]] - sums[at[:-1]] + batch.column("share").to_numpy()
            mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total), mean], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return rows.select("doc_id", "n_tokens", "classes", "share").mapInArrow(score, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op4_pseudo_likelihood": op4_pseudo_likelihood}
