"""Exact dedup: sorted digest runs merged up a tree, a winner and a count kept at each level.

Each input partition is a run of digests. In each round the runs whose numbers agree but for the lowest digit (base
``fan``) are exchanged and merged: all entries of a digest from these runs meet, sorted by digest (the plan is a sort
aggregate), and one entry stays with the winning identifier and the summed count. A digest never has more than
``fan`` entries in a merge, however hot it is, since each run has already folded its own copies. An entry is the
SHA-256 together with a second hash and the byte length, so equality is verified at every level. The winners then go
back down the same tree to the rows, again at most ``fan`` entries of a digest at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROW, lower_ascii, table, written

KEY = ["digest", "check", "n_bytes"]


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, run, digest, check, n_bytes) of each row; texts are equal if identical after lower-casing A-Z."""
    return numbered_digests(docs, F.monotonically_increasing_id())


def numbered_digests(docs: DataFrame, row: Column) -> DataFrame:
    norm = lower_ascii(F.col("text")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row.alias("row"),
        F.spark_partition_id().cast("long").alias("run"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.length(norm).cast("long").alias("n_bytes"),
    )


def merge_tree(rows: DataFrame, fan: int = 16) -> list[DataFrame]:
    """The levels from the runs to the root: (run, KEY, keep (doc_id, row), copies)."""
    level = written(
        rows.groupBy("run", *KEY).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("copies")),
        "runs",
    )
    levels, runs = [level], (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        up = level.withColumn("run", F.floor(F.col("run") / fan))
        level = written(up.groupBy("run", *KEY).agg(F.max("keep").alias("keep"), F.sum("copies").alias("copies")), "runs")
        levels.append(level)
        runs = -(-runs // fan)
    return levels


def exact_dedup(docs: DataFrame, fan: int = 16) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty) the row with the largest doc_id stays. A null doc_id is smaller than any
    other; of rows that repeat a doc_id and its text one stays. An empty table gives an empty result. Other columns of
    docs aren't read.
    """
    out = decided(written(digest_rows(docs), "digests"), fan)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def decided(rows: DataFrame, fan: int = 16) -> DataFrame:
    """exact_dedup of written digest rows, with row."""
    levels = merge_tree(rows, fan)
    facts = levels[-1].where("copies > 1").select(*KEY, "run", "keep", "copies")
    for lower in reversed(levels[:-1]):  # the winners go down, level by level
        lower = lower.select(*KEY, "run", F.floor(F.col("run") / fan).alias("up"))
        facts = lower.join(facts.withColumnRenamed("run", "up"), [*KEY, "up"]).drop("up")
    out = rows.join(facts, [*KEY, "run"], "left")
    keep = F.coalesce(F.col("keep"), F.struct("doc_id", "row"))
    return out.select(
        "row",
        "doc_id",
        keep["doc_id"].alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (keep["row"] == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_unique(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: one row of each group of equal texts. A row is known by two hashes
    of all its columns, so no copy of the texts is written; rows that are equal in every column are folded to one."""
    name = F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit("second"), *docs.columns).alias("b"))
    kept = decided(written(numbered_digests(docs, name), "digests")).where("kept").groupBy(F.col("row").alias(ROW)).agg(F.count(F.lit(1)).alias("n"))
    kept = written(kept, "kept")
    rows = docs.withColumn(ROW, name)
    once = rows.join(kept.where("n = 1").select(ROW).hint("merge"), ROW, "left_semi")
    more = rows.join(kept.where("n > 1").select(ROW), ROW, "left_semi").dropDuplicates([ROW])
    return once.unionByName(more).select(docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SQL = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_lowered('text')}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)"""
}
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
