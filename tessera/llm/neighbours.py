"""Approximate nearest neighbours by learned partitions.

On a bounded sample of vectors the exact neighbour graph is built and cut into balanced parts; a small network learns
which parts hold the neighbours of a vector. Every vector of the table is then indexed under its most probable part,
and each query is compared, by exact inner products, with the vectors of its several most probable parts: as many as
their probabilities call for, a few where the router is sure and more where it isn't. How much probability that takes is
measured on the sample. The number of parts grows with the table. Equal vectors are one entry with its smallest identifiers, as no more of
them can be among the nearest; parts are dealt out in chunks of bounded size, whatever a part's share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

SAMPLE = 8192  # vectors that the graph, the parts and the network are fitted on
PART_SAMPLE = 32  # sample vectors of a part, at least
PART_ROWS, FEW = 800, 32  # rows of a part, at least, if there are more than FEW parts
CHUNK = 4096  # rows, and queries, of a comparison
SURE = 0.94  # recall on the sample that the number of probed parts reaches


@dataclass
class Router:
    layers: list[np.ndarray]
    parts: int
    reach: float = 1.0

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of each row, the most probable first, and the probability of all that come before each."""
        w1, b1, w2, b2 = self.layers
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        p = np.exp(z - z.max(axis=1, keepdims=True), dtype=np.float64)
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order.astype(np.int32), np.cumsum(p, axis=1) - p

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row lies in."""
        return self.ranked(x)[0][:, 0]

    def probed(self, x: np.ndarray) -> list[np.ndarray]:
        """The parts that each row is sought in: those before which less than ``reach`` comes."""
        order, before = self.ranked(x)
        return [parts[: max(1, n)] for parts, n in zip(order, (before <= self.reach).sum(axis=1), strict=True)]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product with each row, itself excepted."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1), 1)
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 9) -> np.ndarray:
    """A part for each node. A set of nodes is halved at the median of its graph's second eigenvector, found by power
    iteration, until there are ``parts`` (a power of two) of equal size."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(near), np.int64)
    count = 1
    while count < parts:
        after = part * 2
        for p in range(count):
            nodes = np.flatnonzero(part == p)
            place = np.full(len(near), -1)
            place[nodes] = np.arange(len(nodes))
            a, b = np.repeat(np.arange(len(nodes)), near.shape[1]), place[near[nodes].ravel()]
            a, b = a[b >= 0], b[b >= 0]
            degree = np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes)) + 1.0
            v = rng.normal(size=len(nodes))
            for _ in range(60):
                v = v - (v * degree).sum() / degree.sum()  # off the constant vector
                v = (np.bincount(a, v[b], len(nodes)) + np.bincount(b, v[a], len(nodes)) + v) / degree + v
                v /= np.linalg.norm(v) + 1e-12
            after[nodes[np.argsort(v, kind="stable")[len(nodes) // 2 :]]] += 1
        part, count = after, count * 2
    return part


def fit(x: np.ndarray, most: int, k: int = 20, links: int = 50, hidden: int = 256, epochs: int = 20, seed: int = 9) -> Router:
    """The router of a sample (rows are vectors, few enough for one machine: at most SAMPLE) with ``most`` parts at most.
    It learns from a graph of ``links`` neighbours; the first k of them measure what it must reach."""
    x = x.astype(np.float32)
    parts = 1 << max(0, int(np.log2(max(1, min(most, len(x) // PART_SAMPLE)))))
    dim = x.shape[1]
    if parts == 1:
        return Router([np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)], 1)
    links = min(links, len(x) - 1)
    near = neighbour_graph(x, links)
    part = balanced_parts(near, parts)
    wanted = np.zeros((len(x), parts), np.float32)
    for column in range(links):
        wanted[np.arange(len(x)), part[near[:, column]]] += 1 / (links + 1)
    wanted[np.arange(len(x)), part] += 1 / (links + 1)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    w = [a.astype(np.float32) for a in w]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):  # cross-entropy, Adam
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            e = (d @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ e, e.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(w, parts)
    order, before = router.ranked(x)
    places = np.take_along_axis(np.argsort(order, axis=1), order[:, 0][near[:, :k]], 1)
    router.reach = float(np.quantile(np.take_along_axis(before, places, 1), SURE, method="higher"))
    return router


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with v array<double>: vectors that aren't null, zero or without a finite number in some place, of the
    length that most have (of lengths that equally many have the larger). A null vec_id takes no part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    out = out.where(F.coalesce(fine, F.lit(False)))
    return out


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(entry, v, ids): equal vectors as one entry, named by its least id, with its ``ids`` least ids."""
    runs = rows.withColumn("run", F.spark_partition_id()).distinct()
    own = F.row_number().over(Window.partitionBy("v", "run").orderBy("vec_id"))
    every = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = runs.withColumn("n", own).where(F.col("n") <= ids).select("v", "vec_id").distinct()
    least = least.withColumn("n", every).where(F.col("n") <= ids)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "v", "ids")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v) the k rows of largest inner product found, without
    the query's own, nearest first, ties to the smaller vec_id. rows and queries come from usable()."""
    spark = rows.sparkSession
    found = written(distinct_vectors(rows, k + 1), "entries")
    asked = written(queries.distinct(), "queries")
    targets = written(asked.groupBy("v").agg(F.min("vec_id").alias("target")), "targets")
    sample = found.orderBy(F.xxhash64("v"), "entry").limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(FEW, found.count() // PART_ROWS)
    model = spark.sparkContext.broadcast(fit(np.stack(sample["v"].to_numpy()), most, k))

    stacked = lambda v: np.stack(v.to_numpy()).astype(np.float32)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(model.value.home(stacked(v)) if len(v) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def probed(v: pd.Series) -> pd.Series:
        return pd.Series(model.value.probed(stacked(v)) if len(v) else [])

    placed = written(found.select("entry", "v", home("v").alias("part")), "placed")
    sent = written(targets.select("target", "v", F.explode(probed("v")).alias("part")), "sent")
    chunks = lambda df, name: df.groupBy("part").agg((F.floor(F.count(F.lit(1)) / CHUNK) + 1).alias(name))
    sizes = chunks(placed, "of_rows").join(chunks(sent, "of_queries"), "part")  # a row for each part
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = placed.join(sizes, "part").withColumn("i", F.pmod(F.xxhash64("entry"), F.col("of_rows"))).withColumn("j", every("of_queries"))
    right = sent.join(sizes, "part").withColumn("j", F.pmod(F.xxhash64("target"), F.col("of_queries"))).withColumn("i", every("of_rows"))

    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"target": [], "entry": [], "near": []})
        ids, x = rows["entry"].to_numpy(), np.stack(rows["v"].to_numpy())
        out, most = [], min(len(ids), k + 5)  # a few more than asked: the last bits of a product may differ here
        for at in range(0, len(asked), 512):
            some = asked.iloc[at : at + 512]
            near = np.stack(some["v"].to_numpy()) @ x.T
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            # ties at the cut: the smaller entries are taken
            cut = np.take_along_axis(near, top, 1).min(axis=1, keepdims=True)
            tied = (near >= cut - 1e-12).sum(axis=1) > most
            for r in np.flatnonzero(tied):
                top[r] = np.lexsort((ids, -np.round(near[r], 12)))[:most]
            out.append(pd.DataFrame({"target": np.repeat(some["target"].to_numpy(), most), "entry": ids[top].ravel(), "near": np.take_along_axis(near, top, 1).ravel()}))
        return pd.concat(out)

    keys = ["part", "i", "j"]
    near = left.select(*keys, "entry", "v").groupBy(*keys).cogroup(right.select(*keys, "target", "v").groupBy(*keys)).applyInPandas(compare, "target long, entry long, near double")
    best = Window.partitionBy("target").orderBy(F.desc("near"), "entry")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 5).select("target", "entry")
    pairs = near.join(targets.withColumnRenamed("v", "q"), "target").join(found, "entry")
    pairs = pairs.select("target", F.explode("ids").alias("vec_id"), inner_product(F.col("q"), F.col("v")).alias("score"))
    order = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    pairs = pairs.withColumn("n", order("target")).where(F.col("n") <= k + 1)
    lists = pairs.groupBy("target").agg(F.collect_list(F.struct("vec_id", "score")).alias("list"))
    ids = asked.join(targets, "v").select(F.col("vec_id").alias("query_id"), "target").distinct()
    out = ids.join(lists, "target").select("query_id", F.explode("list").alias("x")).select("query_id", "x.vec_id", "x.score")
    out = out.where("vec_id <> query_id").withColumn("rank", order("query_id")).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def one_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the length that most have; of lengths that equally many have the larger."""
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def nearest(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """search() for the rows whose vec_id is divisible by ``every``, against all rows.

    Null, zero and non-finite vectors take no part, nor do vectors of another length than most have. With fewer than k
    others all are returned; an empty table gives an empty result. Rows that repeat a vec_id and its vector are one.
    """
    fine = one_length(usable(rows))
    return search(fine, fine.where(F.col("vec_id") % every == 0), k)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
QUERIES = {"op9_neighbours": op9_neighbours}
