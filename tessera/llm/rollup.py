"""Token counts: rollups by source, language and tokenizer version that are maintained from deltas.

Each batch holds signed changes: an insert adds a document's tokens, a delete takes them away, a revised count takes
the old one away and adds the new one. A batch is folded to one row for each group, written, and then committed by one
line of a log in the same folder; a batch that the log has is never counted again. The totals are sums over the
committed batches, and they are additive: no text is read twice to keep them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table, written

FOLDER = "/opt/tokenizers"
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
KEY = ["source", "lang", "version"]


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, version: Column, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, lang, version, tokens) of whole texts; version names the tokenizer of a row. Null texts have 0
    tokens; a null or unknown version gives null."""
    import public_tokenizers

    names = {}
    for name in VERSIONS:
        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            names[name] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    shared = docs.sparkSession.sparkContext.broadcast((names, public_tokenizers.PATTERN))  # two public vocabularies

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern = shared.value
        encoders = {name: _encoder(r, pattern) for name, r in ranks.items()}
        for batch in batches:
            of = [encoders.get(v) for v in batch.column("version").to_pylist()]
            sizes = [e and len(e.encode_ordinary(t or "")) for e, t in zip(of, batch.column("text").to_pylist(), strict=True)]
            kept = [batch.column(c) for c in ("doc_id", "source", "lang", "version")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "version", "tokens"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], version.cast("string").alias("version"), F.col("text").cast("string").alias("text")]
    return docs.select(columns).mapInArrow(count, "doc_id long, source string, lang string, version string, tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """counts as changes: +1 inserts, -1 deletes."""
    return counts.select(*KEY, F.lit(sign).cast("long").alias("docs"), (F.coalesce("tokens", F.lit(0)) * sign).alias("tokens"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Rollup:
    """The committed batches in a shared folder, which is all the state there is: another object on the same folder goes
    on where this one ended.

    ``rows`` holds what every write attempt brought, under the attempt's own name; ``log`` names the attempt that counts
    for a batch. A commit writes its rows first and then its line of the log, one file that the job's commit puts in
    place at once. Rows of an attempt that broke off have no line and never count; of two attempts of one batch that both
    got a line the first by name counts. Each method is a Spark job.
    """

    rows_schema = "attempt string, source string, lang string, version string, docs long, tokens long"
    log_schema = "batch string, attempt string"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/tessera-rollup-{uuid.uuid4().hex}"

    def stage(self, changes: DataFrame) -> str:
        """Write changes (KEY, docs, tokens), folded, and return the attempt's name. They don't count yet."""
        attempt = uuid.uuid4().hex
        folded = changes.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        folded.select(F.lit(attempt).alias("attempt"), *KEY, "docs", "tokens").write.mode("append").parquet(f"{self.path}/rows")
        return attempt

    def publish(self, batch: str, attempt: str) -> None:
        self.spark.createDataFrame([(batch, attempt)], self.log_schema).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit the changes under this name, any string; False, and nothing is read, if it was committed before."""
        if not _stored(self.spark, f"{self.path}/log", self.log_schema).where(F.col("batch") == batch).isEmpty():
            return False
        self.publish(batch, self.stage(changes))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens): groups whose documents are all gone have no row."""
        counting = _stored(self.spark, f"{self.path}/log", self.log_schema).groupBy("batch").agg(F.min("attempt").alias("attempt"))
        rows = _stored(self.spark, f"{self.path}/rows", self.rows_schema).join(counting, "attempt", "left_semi")
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where((F.col("docs") != 0) | (F.col("tokens") != 0))


def maintained(docs: DataFrame) -> DataFrame:
    """The totals after four commits: all documents under the first version, then documents deleted (doc_id divisible
    by 11), then the non-English ones revised to the second version, and the second batch once more, as a retry.

    Null source and lang are groups of their own; null texts count 0 tokens; a null doc_id is never deleted. Rows that
    repeat a doc_id count as often as they come. An empty table gives an empty result.
    """
    rollup = Rollup(docs.sparkSession)
    gone = F.coalesce(F.pmod("doc_id", F.lit(11)) == 0, F.lit(False))
    other = F.coalesce(F.col("lang") != "en", F.lit(False))
    first = written(token_counts(docs, F.lit(VERSIONS[0])), "counts")
    rollup.commit("inserts", signed(first, 1))
    deletes = signed(first.where(gone), -1)
    rollup.commit("deletes", deletes)
    again = token_counts(docs.where(other & ~gone), F.lit(VERSIONS[1]))
    rollup.commit("revisions", signed(first.where(other & ~gone), -1).union(signed(again, 1)))
    rollup.commit("deletes", deletes)
    return rollup.totals()


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_token_counts": op6_token_counts}
