"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary is read on the driver from a public model file (never trained here) and broadcast as arrays of fixed
size. A file of type unigram brings its log scores. The pieces of a merge-ordered file are in order of frequency; they
get the log probabilities of Zipf's law over that order. Unknown characters become the bytes of their UTF-8 form.

No piece of such a vocabulary has a marker after another character, so the best path of a text is made of the best
paths of its words with their leading markers. Each task keeps the paths of words it has seen, up to a bound, and finds
those of new words in numpy, all words of a length at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEPT_WORDS = 300_000  # of a task; more are found anew
UNKNOWN_PENALTY = 10.0  # below the least score of a piece
NEVER = np.float64(-1e18)


@dataclass
class DoubleArray:
    """A trie: from node s the character of code c leads to base[s] + c if check there is s. leaf is the piece or -1."""

    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray


def double_array(words: dict[tuple[int, ...], int]) -> DoubleArray:
    """The trie of the words (tuples of codes from 1): nodes in breadth-first order, the children of each at the first
    offset where all their places are free."""
    root: dict = {}
    for word, piece in words.items():
        node = root
        for code in word:
            node = node.setdefault(code, {})
        node[0] = piece
    widest = max((max(w) for w in words), default=1)
    nodes = sum(map(len, words))
    base, check, leaf = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    taken = np.zeros(0, bool)
    free, level = 1, [(0, root)]
    while level:
        below = []
        for at, node in level:
            if free + 2 * widest + 8192 > len(taken):
                more = max(2 * len(taken), nodes + 4 * widest + 16384) - len(taken)
                base, taken = np.append(base, np.zeros(more, np.int64)), np.append(taken, np.zeros(more, bool))
                check, leaf = np.append(check, np.full(more, -1)), np.append(leaf, np.full(more, -1))
                taken[0] = True
            leaf[at] = node.pop(0, -1)
            if not node:
                continue
            codes = np.sort(np.fromiter(node, np.int64, len(node)))
            offset, look = 0, free
            while not offset:
                places = look + np.flatnonzero(~taken[look : look + 4096])
                starts = places - codes[0]
                starts = starts[starts > 0]
                fits = starts[~taken[np.minimum(starts[:, None] + codes, len(taken) - 1)].any(axis=1)]
                offset = int(fits[0]) if len(fits) else 0
                look += 4096
                if look + 4096 + widest > len(taken):
                    break
            if not offset:
                offset = int(np.flatnonzero(taken).max()) + 1
            base[at] = offset
            taken[offset + codes] = True
            check[offset + codes] = at
            while taken[free]:
                free += 1
            below += [(offset + c, child) for c, child in node.items()]
        level = below
    end = (int(np.flatnonzero(taken).max()) if len(taken) else 0) + widest + 2
    pad = lambda x, v: np.append(x, np.full(max(0, end - len(x)), v))[:end]
    return DoubleArray(pad(base, 0), pad(check, -1), pad(leaf, -1))


class Vocabulary:
    """Pieces with ids and log scores, the ids of the 256 bytes, and the trie."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.byte_of = {x: b for b, x in enumerate(byte_ids)}
        used = {p: i for i, p in enumerate(pieces) if normal[i] and p}
        alphabet = sorted(set(chain.from_iterable(used)))
        self.code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.table = np.zeros(0x110000, np.int32)
        self.table[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.scores = np.array(scores, np.float64)
        self.trie = double_array({tuple(self.code[c] for c in p): i for p, i in used.items()})
        self.longest = max(map(len, used), default=1)
        self.unknown = min((scores[i] for i in used.values()), default=0.0) - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in used)
        self.word = re.compile(".+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL)

    @classmethod
    def load(cls, model: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        if all(x == int(x) for x in scores):  # merge order, not log probabilities
            scores = zipf_scores(scores, plain)
        return cls(pieces, scores, plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def zipf_scores(order: list[float], plain: list[bool]) -> list[float]:
    """log of a probability that falls with the rank; the first pieces of the merge order have the least rank.
    Longer merges of a rank close by win, as a path of fewer pieces has fewer factors."""
    ids = [i for i in np.argsort([-x for x in order], kind="stable").tolist() if plain[i]]
    total = np.log(np.sum(1 / np.arange(2, len(ids) + 2)))
    scores = [0.0] * len(order)
    for rank, i in enumerate(ids):
        scores[i] = float(-np.log(rank + 2) - total)
    return scores


def best_paths(vocabulary: Vocabulary, words: list[str]) -> list[list[int]]:
    """The ids of the best path of each word. Of equal paths to a place the one whose last piece is longest stays."""
    out: list[list[int]] = [[]] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    first = 0
    while first < len(order):
        length = int(lengths[order[first]])
        most = max(1, 2_000_000 // max(1, length))
        last = min(first + most, int(np.searchsorted(lengths[order], length, "right")))
        some = order[first:last]
        if length:
            points = np.frombuffer("".join([words[i] for i in some.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            for i, path in zip(some.tolist(), _paths(vocabulary, points.reshape(-1, length)), strict=True):
                out[i] = path
        first = last
    return out


def _paths(vocabulary: Vocabulary, points: np.ndarray) -> list[list[int]]:
    n, length = points.shape
    codes = vocabulary.table[np.minimum(points, 0x10FFFF)]
    trie, scores = vocabulary.trie, vocabulary.scores
    best, piece, start = np.full((length + 1, n), NEVER), np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.int32)
    best[0] = 0
    for i in range(length):
        live, state = np.arange(n), np.zeros(n, np.int64)
        single = np.zeros(n, bool)
        for d in range(min(vocabulary.longest, length - i)):
            code = codes[live, i + d]
            after = trie.base[state] + code
            ok = (code > 0) & (trie.check[after] == state)
            live, state = live[ok], after[ok]
            if not len(live):
                break
            leaf = trie.leaf[state]
            hit = leaf >= 0
            rows, ids = live[hit], leaf[hit]
            if d == 0:
                single[rows] = True
            value = best[i, rows] + scores[ids]
            better = value > best[i + d + 1, rows]
            rows, ids = rows[better], ids[better]
            best[i + d + 1, rows], piece[i + d + 1, rows], start[i + d + 1, rows] = value[better], ids, i
        rows = np.flatnonzero(~single)
        value = best[i, rows] + vocabulary.unknown
        better = value > best[i + 1, rows]
        rows = rows[better]
        best[i + 1, rows], piece[i + 1, rows], start[i + 1, rows] = value[better], -1, i
    # back along the paths, all words at once
    place, steps = np.full(n, length), []
    every = np.arange(n)
    while (place > 0).any():
        on = place > 0
        steps.append(np.where(on, np.where(piece[place, every] >= 0, piece[place, every], -2 - points[every, np.maximum(place - 1, 0)].astype(np.int64)), -1))
        place = np.where(on, start[place, every], 0)
    found = []
    for row in np.array(steps[::-1]).T.tolist():
        path = [x for x in row if x != -1]
        if path and min(path) < -1:
            path = [y for x in path for y in ([x] if x >= 0 else [vocabulary.byte_ids[b] for b in chr(-2 - x).encode("utf-8", "replace")])]
        found.append(path)
    return found


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.seen = vocabulary, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text: a marker before it, a marker for each blank; an empty text has none."""
        split = self.vocabulary.word.findall
        parts = [split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.seen))
        if len(self.seen) + len(new) > KEPT_WORDS:
            new, self.seen = list(set(chain.from_iterable(parts))), {}
        self.seen.update(zip(new, best_paths(self.vocabulary, new), strict=True))
        get = self.seen.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become blanks, the first one goes, runs of bytes are read as UTF-8."""
        pieces, byte_of = self.vocabulary.pieces, self.vocabulary.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([pieces[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(pieces[i])
            text = "".join(out) + run.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


RESULT = "doc_id long, n_pieces long, ids array<int>, round_trip boolean"


def _sub_batches(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row for each row of docs: doc_id, n_pieces, ids, and round_trip: decoding gives the text again.

    Null and empty texts have no ids, and round_trip is true. A text that holds the marker itself decodes to blanks in
    its place. Other columns of docs aren't read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # of one size for any input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for first, last in _sub_batches(texts):
                some = texts[first:last]
                ids = encoder.encode(some)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                same = [encoder.decode(x) == t for x, t in zip(ids, some, strict=True)]
                columns = [batch.column("doc_id")[first:last], pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(ends, flat), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """tokens (with a column ids) with a column text; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("string")
    def read(ids):
        decode = Encoder(shared.value).decode
        return ids.map(lambda x: None if x is None else decode(x.tolist()))

    return tokens.withColumn("text", read("ids"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op1_sentencepiece": op1_sentencepiece}
