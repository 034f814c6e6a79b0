"""MinHash near-dedup with min-max hashing.

Under each permutation both the minimum and the maximum are kept, so ``PERMUTATIONS`` hash evaluations give twice as
many signature values. The values are banded; texts with a shared band are candidates. Links are confirmed on the full
shingle sets, never on signatures. At a similarity of 0.85 a pair shares no band with a probability of about 2e-6.

Work on a group of n near copies stays near n. Texts with equal sets are one node. In a bucket, the member that shares
most bands with others is the pivot, and each member is compared with its pivot alone. What this can miss is found
exactly: let P be the pivot, I the part of a set inside P and R the rest. Members A and B of P's family that are not
yet in one component can be linked only if min(|I_A|, |I_B|) + |R_A & R_B| is large enough for the threshold. Pairs
with a shared element in R are found by an equi-join on (pivot, element). Pairs without one need 85 % of either set
inside P and sizes within 85 % of each other, so they are found by an equi-join on (pivot, size class): a large family
whose members are all a little too far from P has none. These are confirmed on full sets as well.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROW, attach, only_rows, settled, table, with_rows
from tessera.llm.components import components
from tessera.llm.texthash import U, mixed, shingle_sets

BANDS, WIDTH = 28, 6
PERMUTATIONS = BANDS * WIDTH // 2
PERCENT = 85
COMMON = 32  # members of a family
_rng = np.random.default_rng(85)
TIMES = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TURN = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
FIRM = _rng.integers(0, 2**63, (BANDS, WIDTH), dtype=U) * U(2) + U(1)

SIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("run", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNED_SQL = "doc_id long, row long, run long, n_shingles long, digest binary, bands array<long>"


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The signature of a set: the minima and then the maxima under all permutations."""
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    short = (shingles >> U(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        values = (short[None, at : at + 1024] ^ TURN[:, None]) * TIMES[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band. A band takes values from far apart, so not both extremes of a permutation."""
    values = signature.astype(U).reshape(WIDTH, BANDS).T
    return mixed((values * FIRM).sum(axis=1, dtype=U) + FIRM[:, 0]).view(np.int64)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bands = [], [], []
        for found in shingle_sets(batch.column("text")):
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            bands.append(band_keys(min_max(found)) if len(found) else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
        keys = pa.ListArray.from_arrays(ends, np.concatenate(bands) if bands else np.zeros(0, np.int64))
        columns = [batch.column("doc_id"), batch.column("row"), batch.column("run"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), keys]
        yield pa.RecordBatch.from_arrays(columns, schema=SIGNED)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(batch.column("text")))
        for at in range(0, len(found), 1000):
            some = found[at : at + 1000]
            ends = np.cumsum([0, *map(len, some)], dtype=np.int32)
            flat = np.concatenate(some).view(np.int64) if some else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node")[at : at + 1000], pa.ListArray.from_arrays(ends, flat)], names=["node", "items"])


def numbered(docs: DataFrame) -> DataFrame:
    """docs as with_rows wrote them, so that every plan finds the same rows by their numbers."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(ROW).alias("row"), F.spark_partition_id().cast("long").alias("run"), F.col("text").cast("string").alias("text")
    )


def enough(inter: Column, n_a: Column, n_b: Column) -> Column:
    """inter / union reaches the threshold; inter may be an upper bound."""
    return (100 + PERCENT) * inter >= PERCENT * (n_a + n_b)


def size_class(n: Column) -> Column:
    """Sizes by classes of about two per cent."""
    return F.floor(F.log(F.greatest(n, F.lit(1.0))) / math.log(1.02) + 1e-9)


def spread(c: str, runs: int = 64) -> Column:
    """One of so many runs: a key that very many rows share is joined run by run."""
    return F.pmod(F.xxhash64(c, F.lit("run")), F.lit(runs))


def candidate_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) of the buckets with several nodes."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(several, "key")


def pivot_edges(buckets: DataFrame) -> DataFrame:
    """(pivot, node), each pair once: the pivot of each bucket against its other members."""
    shared = buckets.groupBy("node").agg(F.sum("members").alias("shared"))
    best = buckets.join(shared, "node").groupBy("key").agg(F.max(F.struct("shared", "node"))["node"].alias("pivot"))
    return buckets.join(best, "key").where("pivot <> node").select("pivot", "node").distinct()


def compared(edges: DataFrame, sets: DataFrame, a: str, b: str, per_chunk: int = 64) -> DataFrame:
    """edges with the sets of both ends, items_a and items_b. One end may be that of very many edges: its set is dealt
    out again for each ``per_chunk`` of them."""
    chunks = edges.groupBy(a).agg((F.floor(F.count(F.lit(1)) / per_chunk) + 1).alias("chunks"))
    many = sets.withColumnRenamed("node", a).join(chunks, a).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = attach(edges.withColumn("run", spread(b)), chunks, [a], "run", "inner")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(b), F.col("chunks"))).drop("chunks", "run")
    dealt = dealt.join(many.select(a, "chunk", F.col("items").alias("items_a")), [a, "chunk"])
    return dealt.join(sets.withColumnsRenamed({"node": b, "items": "items_b"}), b)


def confirmed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes that give the components of all links."""
    buckets = settled(candidate_buckets(nodes), "buckets")
    wanted = buckets.select(F.col("node").alias("row")).distinct()
    # a merge join at any size: what it moves then grows with the input alone
    texts = numbered(docs).select("row", "text").join(wanted.hint("merge"), "row", "left_semi")
    sets = settled(texts.withColumnRenamed("row", "node").mapInArrow(_sets, "node long, items array<long>"), "sets")
    pairs = compared(settled(pivot_edges(buckets), "pivots", buckets), sets, "pivot", "node")
    star = pairs.select(
        "pivot", "node", F.size("items_a").alias("n_pivot"), F.size("items_b").alias("n"), F.size(F.array_intersect("items_a", "items_b")).alias("inside"),
        F.array_except("items_b", "items_a").alias("rest"),
    )
    star = settled(star.withColumn("linked", enough(F.col("inside"), F.col("n_pivot"), F.col("n"))), "star")
    links = star.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return links.union(rest_links(star, links, sets))


def rest_links(star: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links between members of a pivot's family of which at least one isn't in the pivot's component.

    Elements outside the pivot that more than ``COMMON`` members hold count as inside: the bound holds for any such
    choice, and no element joins more than COMMON members.
    """
    labels = components(links)
    label = lambda c, out: labels.withColumnsRenamed({"node": c, "label": out})
    family = attach(star.withColumn("run", spread("node")).join(label("node", "l"), "node", "left"), label("pivot", "lp"), ["pivot"], "run")
    family = family.select("pivot", "node", "run", "n", "inside", "rest", F.coalesce("l", "node").alias("l"), (F.coalesce("l", "node") != F.coalesce("lp", "pivot")).alias("apart"))
    family = attach(family, family.where("apart").select("pivot").distinct(), ["pivot"], "run", "inner").drop("run")
    family = settled(family, "family", labels)
    items = family.select("pivot", "node", F.explode("rest").alias("item"))
    common = settled(items.groupBy("pivot", "item").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > COMMON), "common")
    held = items.join(common, ["pivot", "item"]).groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("held"))
    family = family.withColumn("out", F.size("rest")).drop("rest").join(held, ["pivot", "node"], "left")
    shift = F.coalesce("held", F.lit(0))
    family = settled(family.withColumn("inside", F.col("inside") + shift).withColumn("out", F.col("out") - shift).drop("held"), "family")
    side = lambda df, x: df.select("pivot", *[F.col(c).alias(c + x) for c in ("node", "n", "inside", "out", "l")])
    rare = items.join(common, ["pivot", "item"], "left_anti")
    least, differ = F.least("inside_a", "inside_b"), F.col("l_a") != F.col("l_b")
    holder = lambda df, x: side(df, x).join(rare.withColumnRenamed("node", "node" + x), ["pivot", "node" + x])
    near = holder(family.where("apart"), "_a").join(holder(family, "_b"), ["pivot", "item"])
    near = near.where(differ & enough(least + F.least("out_a", "out_b"), F.col("n_a"), F.col("n_b")))
    near = near.groupBy("pivot", "node_a", "node_b").agg(F.count(F.lit(1)).alias("both"), *[F.first(c).alias(c) for c in ("inside_a", "inside_b", "n_a", "n_b")])
    near = settled(near.where(enough(least + F.col("both"), F.col("n_a"), F.col("n_b"))).select("node_a", "node_b"), "near")
    # without a common rest each set has PERCENT of its elements inside, and sizes differ by no more
    within = family.where(F.col("inside") * 100 >= F.col("n") * PERCENT)
    most = F.col("inside_a") * ((100 + PERCENT) / PERCENT) - F.col("n_a")
    sizes = F.sequence(size_class(F.col("n_a") * (PERCENT / 100)), size_class(F.greatest(most, F.col("n_a") * (PERCENT / 100))))
    one = side(within.where("apart"), "_a").withColumn("size", F.explode(sizes))
    plain = one.join(side(within, "_b").withColumn("size", size_class(F.col("n_b"))), ["pivot", "size"]).where(differ & enough(least, F.col("n_a"), F.col("n_b")))
    pairs = near.union(plain.select("node_a", "node_b"))
    pairs = settled(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "pairs")
    pairs = compared(pairs, sets, "a", "b")
    inter = F.size(F.array_intersect("items_a", "items_b"))
    return pairs.where(enough(inter, F.size("items_a"), F.size("items_b"))).select("a", "b")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Words are the runs without the white space of ASCII, A-Z lower-cased; the set of a text holds its distinct 5-word
    shingles, or its whole word sequence if that is shorter. Texts are linked if 100 * intersection >= 85 * union.
    Null and blank texts have an empty set and are linked with nothing: each stays as its own component. Rows that
    repeat a doc_id have the component of their own text; a null doc_id never names a component. An empty table gives an
    empty result.
    """
    return decided(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def decided(docs: DataFrame) -> DataFrame:
    """near_dedup with row, and alike: what the rows of a component have in common and no others."""
    if ROW not in docs.columns:
        docs = with_rows(docs.select("doc_id", "text"))
    signed = settled(numbered(docs).mapInArrow(_sign, SIGNED_SQL), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    nodes = settled(nodes, "nodes")
    labels = components(settled(confirmed(docs, nodes), "links"))
    lows = nodes.select("digest", "node", "low").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = lows.groupBy("label").agg(F.min("low").alias("component_id"))
    facts = lows.join(least, "label").select("digest", "label", "component_id")
    out = attach(signed.drop("bands"), facts, ["digest"], "run")
    full = F.col("n_shingles") > 0
    component = F.when(full, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("row", "run", "doc_id", "n_shingles", component.alias("component_id"), F.when(full, F.col("label")).otherwise(F.col("row")).alias("alike"))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one row of each component, the first by doc_id (null last)."""
    rows = with_rows(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    some = decided(rows).groupBy("alike", "run").agg(F.min(order).alias("first"))
    kept = some.groupBy("alike").agg(F.min("first")["row"].alias("row"))
    return only_rows(rows, kept).select(docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op7_near_dedup": op7_near_dedup}
