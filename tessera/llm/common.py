"""What several operators share: the table readers, written intermediate tables and joins that stand hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the byte classes that separate words in this library.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of texts that go to a Python worker at once, while a step is written.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
_own: dict[str, str] = {}  # by application: the folder where none is set


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set and all of Spark runs in one
    process, as in tests, a new local one; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        name = spark.sparkContext.applicationId
        at = _own.setdefault(name, _own.get(name) or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there, and a lost executor costs no more
    than the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def settled(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """written(df) with small Arrow batches, after which the tables in done (as written or settled returned them) are
    deleted, and the driver is asked to collect its garbage: the shuffle files of a finished step stay on the executors'
    disks until it does."""
    spark = df.sparkSession
    usual = spark.conf.get(BATCH[0], None)
    try:
        spark.conf.set(*BATCH)
        out = written(df, name)
    finally:
        spark.conf.unset(BATCH[0]) if usual is None else spark.conf.set(BATCH[0], usual)
    for at in [t._tessera_path for t in done if hasattr(t, "_tessera_path")]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # plans that Python still holds keep their shuffle files
    spark._jvm.System.gc()
    return out


#: The column of with_rows.
ROW = "_tessera_row"


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written: a plan that numbers rows twice may split its input in another way."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def only_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of with_rows whose number is among kept's (row). A merge join at any size."""
    return rows.join(kept.select(F.col("row").alias(ROW)).hint("merge"), ROW, "left_semi")


def lower_ascii(text: Column) -> Column:
    """A-Z only become a-z; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def attach(rows: DataFrame, facts: DataFrame, key: list[str], run: str, how: str = "left") -> DataFrame:
    """rows joined to facts, which has a row for each key. A key may hold a third of all rows: facts first meet the
    (key, run) pairs, of which a key has as many as there are runs, then the rows meet these pairs."""
    pairs = rows.select(*key, run).distinct().join(facts, key)
    return rows.join(pairs, [*key, run], how)


def running_offsets(sums: DataFrame, group: str, bucket: str, value: str, buckets: int, fan: int = 512) -> DataFrame:
    """For rows (group, bucket, value), one for each pair: offset, the sum of value over smaller buckets of the group.
    No window holds more than fan rows: bucket numbers are summed by digits of base fan."""
    if buckets <= fan:
        before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(group, bucket, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("offset"))
    upper = F.col(bucket).cast("long")
    tops = sums.groupBy(group, F.floor(upper / fan).alias("_top")).agg(F.sum(value).alias("_v"))
    tops = running_offsets(tops, group, "_top", "_v", -(-buckets // fan), fan).withColumnRenamed("offset", "_before")
    before = Window.partitionBy(group, "_top").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.withColumn("_top", F.floor(upper / fan))
    inner = inner.select(group, bucket, "_top", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_in"))
    return inner.join(tops, [group, "_top"]).select(group, bucket, (F.col("_in") + F.col("_before")).alias("offset"))
