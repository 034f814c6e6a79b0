"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each class, those of least hash, texts whole):
presence counts of hashed character n-grams give the log-count ratios; n-grams whose ratio is below ``MIN_RATIO`` or below
``MIN_ERRORS`` standard errors are left out; a logistic regression is then trained in numpy on the ratios of the
n-grams that a text has, and its intercept is moved from the sample's class shares to those of all labelled rows.
Scoring is a column expression, one pass over the texts with a weight table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.texthash import BYTE, FOLD, LOWER, SPACE, STEP, U, distinct, mixed, slices

SAMPLE = {1: 1500, 0: 4500}
SIZES = (4, 5, 6, 7)
BITS = 22
MIN_RATIO, MIN_ERRORS = 1.0, 3.0
REJECT = 0.7


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each character of rows of UTF-8, A-Z lower-cased, white space as blanks; rows begin and end with a
    blank."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 0x20, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    inner = np.ones(len(padded), bool)
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    inner[ends - 1] = inner[np.concatenate(([0], ends[:-1]))] = False
    padded[inner] = np.where(SPACE[data], 0x20, LOWER[data])
    lead = np.flatnonzero(padded & 0xC0 != 0x80)
    size = np.diff(np.append(lead, len(padded)))
    value = BYTE[padded[lead]]
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        value[long] = value[long] * FOLD + BYTE[padded[lead[long] + k]]
    return owner[lead], value


def grams(owner: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of characters that lies within a row."""
    if len(value) < size:
        return owner[:0], np.zeros(0, np.int64)
    total = value
    for k in range(1, size):
        total = total[:-1] * STEP + value[k:]
    row = owner[: len(total)]
    whole = row == owner[size - 1 :]
    return row[whole], (mixed(total[whole]) >> U(64 - BITS)).astype(np.int64)


def features(column: pa.Array, chosen: np.ndarray | None = None):
    """(first row, row, bucket) of the distinct n-gram buckets of rows, slice by slice; of those chosen, if given."""
    for first, data, offsets in slices(column, 1 << 19):
        owner, value = characters(data, offsets)
        found = []
        for size in SIZES:
            row, bucket = grams(owner, value, size)
            if chosen is not None:
                hit = chosen[bucket]
                row, bucket = row[hit], bucket[hit]
            found.append((row << BITS) | bucket)
        both = distinct(np.concatenate(found))
        yield first, both >> BITS, both & ((1 << BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray, odds: float | None = None, rounds: int = 200, decay: float = 2e-3, smooth: float = 0.5) -> tuple[np.ndarray, float]:
    """The weight of each bucket (0: not a feature) and the intercept; odds: of label 1 among all labelled rows."""
    column = pa.array(texts, pa.large_string())
    counts = np.zeros((2, 1 << BITS), np.float32)
    for first, row, bucket in features(column):
        of = toxic[row + first]
        for y in (0, 1):
            counts[y] += np.bincount(bucket[of == y], minlength=1 << BITS)
    # log of the ratio of presence rates, with equal shares of smoothing for both classes
    n1, n0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    ratio = np.log((counts[1] + smooth) / (n1 + 2 * smooth)) - np.log((counts[0] + smooth) / (n0 + 2 * smooth))
    error = np.sqrt(1 / (counts[1] + smooth) + 1 / (counts[0] + smooth))
    ratio[np.abs(ratio) < np.maximum(MIN_RATIO, MIN_ERRORS * error)] = 0
    del counts, error  # a second pass over the texts is cheaper than the n-grams of all of them in memory
    parts = [(row + first, bucket) for first, row, bucket in features(column, ratio != 0)]
    row, bucket = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    names = distinct(bucket)
    at = np.searchsorted(names, bucket)
    x = ratio[names][at]
    w, b, y = np.zeros(len(names)), 0.0, toxic.astype(np.float64)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):  # full-batch Adam
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(texts)) + b, -30, 30)))
        g = (p - y) / max(1, len(texts))
        grad = np.append(np.bincount(at, x * g[row], len(names)) + decay * w / max(1, len(names)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = ratio[names] * w
    return weights, float(b + (np.log(odds * n0 / n1) if odds else 0.0))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """fit() of at most SAMPLE rows of each class outside the held-out third, with whole texts, in one task, and with
    the odds of label 1 among all labelled rows outside it. The driver gets the weights that aren't 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    picked = None
    for y, most in SAMPLE.items():
        some = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    picked = picked.withColumnRenamed("doc_id", "_id")  # at most sum(SAMPLE) rows of 12 bytes: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "text", "toxic")
    # of rows that repeat an id one is learnt from, so that the sample keeps its bound
    rows = rows.groupBy("_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    odds = of[1] / of[0] if len(of) == 2 else None

    def learn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        sample = pd.concat(parts).sort_values(["_id", "toxic", "text"])
        weights, intercept = fit(sample["text"].fillna("").tolist(), sample["toxic"].to_numpy(np.int64), odds)
        used = np.flatnonzero(weights)
        yield pd.DataFrame({"bucket": np.append(used, -1), "weight": np.append(weights[used].astype(np.float64), intercept)})

    found = rows.repartition(1).mapInPandas(learn, "bucket long, weight double").toPandas() if of else pd.DataFrame({"bucket": [-1], "weight": [0.0]})
    found = dict(zip(found["bucket"].tolist(), found["weight"].tolist(), strict=True))
    intercept = found.pop(-1, 0.0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.array(list(found), np.int64)] = list(found.values())
    return weights, intercept


def scorer(spark: SparkSession, weights: np.ndarray, intercept: float):
    """A function of the text column: the probability of label 1."""
    model = spark.sparkContext.broadcast((weights, weights != 0))  # 20 MB at any size of the input

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weight, chosen = model.value
        out = np.full(len(texts), intercept)
        for first, row, bucket in features(pa.array(texts, pa.large_string()), chosen):
            out += np.bincount(row + first, weight[bucket], len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with toxicity_score and toxicity_predicted.

    Null and empty texts get the score of a text without features. Without labelled rows the score of every text is
    0.5. Labels that are null or neither 0 nor 1 are not learnt from; of a document with both labels, both are. Of rows
    that repeat a doc_id the text of least hash is learnt from. Columns of docs with the names of the results are replaced.
    """
    score = scorer(docs.sparkSession, *fitted(docs, labels))
    return docs.withColumn("toxicity_score", score(docs["text"].cast("string"))).withColumn("toxicity_predicted", (F.col("toxicity_score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = scorer(docs.sparkSession, *fitted(docs, labels))
    return docs.where(score(docs["text"].cast("string")) < REJECT)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op3_toxicity": op3_toxicity}
