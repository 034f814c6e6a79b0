"""Mixing sources to target weights by a low-discrepancy schedule.

The k-th point of a low-discrepancy sequence (van der Corput's of base 2, or multiples of the golden ratio), mapped
through the cumulative target shares, names the source of slot k, so that every stretch of the schedule has the sources
in their shares. The slots of a source are ranked. The documents of a source, in a seeded random order, form a line of
words which is read up to ``REPEATS`` times over, as far as its target, and cut into blocks of equal size, the last one
shorter; the slot of rank r reads the block at place r of a fixed shuffle. By the sequence's discrepancy the scheduled
slots of a source are its blocks but for a few. What is missing is settled by slots of its own at the end of the schedule,
so that each source, however small, gives its target to the word; slots beyond a source's last block stay empty. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROW, WORD, attach, running_offsets, table, with_rows, written

REPEATS = 3  # no document is taken more often
BLOCK = 64  # words of a block, at most
SLOTS = 65536  # of a schedule at least, or as many as there are words
MOST_SOURCES = 1_000_000
GOLDEN = 0.6180339887498949  # fixed value: the golden ratio less one
CHUNK = 1024  # blocks that are shuffled among each other, and as a whole with others
STRIDES = (4294967311, 1031)  # primes above the number of chunks and above CHUNK


def van_der_corput(k: Column) -> Column:
    """The k-th point: the bits of k in reverse behind the binary point. Neighbours, pairs, ... are swapped by masks."""
    for half in range(6):
        step = 1 << half
        mask = sum(((1 << step) - 1) << at for at in range(0, 64, 2 * step))
        low = F.lit(mask if mask < 2**63 else mask - 2**64)
        k = F.shiftleft(k.bitwiseAND(low), step).bitwiseOR(F.shiftrightunsigned(k, step).bitwiseAND(low))
    return F.shiftrightunsigned(k, 11) / F.lit(float(2**53))


def golden(k: Column) -> Column:
    return F.pmod(k * F.lit(GOLDEN), F.lit(1.0))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, row, source, key, size, mix): key stands for the source and isn't null, mix is a seeded hash that orders
    the documents."""
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("row"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("mix"),
    )


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(s, source, source_size, target): sources by code point, null last, weigh 1, 2, 3, repeating, and share all
    words; a target stops at repeats times the source's size and the excess is shared anew by weight.

    Sources ordered by limit / weight fill up in this order. With the first ones full, the rest get level * weight;
    the first source whose limit isn't below its share tells the level. The windows hold one row for each source, of
    which there may be MOST_SOURCES: more raise an error when this runs.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("s", F.row_number().over(by_name) - 1)
    src = src.where(F.when(F.col("s") < MOST_SOURCES, True).otherwise(F.raise_error(F.lit(f"more than {MOST_SOURCES} sources"))))
    src = src.withColumn("weight", (F.col("s") % 3 + 1).cast("double"))
    src = src.withColumn("most", (F.col("source_size") * repeats).cast("double"))
    src = src.withColumn("ratio", F.col("most") / F.col("weight"))
    rising = Window.orderBy("ratio", "s")
    every = Window.partitionBy(F.lit(0))
    src = src.withColumn("full", F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
    src = src.withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))).over(every))
    level = F.coalesce(F.col("found.level"), F.lit(0.0))
    return src.select("s", "source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, slots: int, point=van_der_corput) -> DataFrame:
    """(slot, s, rank): the source of each slot and the slot's rank among those of its source.

    Points and the sources' stretches of 0..1 meet by the cell that they lie in, of which there are a few for each
    source; the points of a low-discrepancy sequence fill cells evenly. Ends are rounded to twelve places.
    """
    upto = F.round(F.sum("target").over(Window.orderBy("s")) / F.sum("target").over(Window.partitionBy(F.lit(0))), 12)
    ends = sources.where("target > 0").select("s", upto.alias("high"))
    ends = ends.select("s", F.coalesce(F.lag("high").over(Window.orderBy("s")), F.lit(0.0)).alias("low"), "high")
    cells = 1 << max(8, (4 * sources.count() - 1).bit_length())
    inside = F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))
    ends = ends.where("low < high").select("s", "low", "high", F.explode(inside).alias("cell"))
    slot = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    slot = slot.join(ends, "cell").where("low <= u AND u < high").select("slot", "s", F.floor(F.col("slot") / 1024).alias("chunk"))
    counts = slot.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = running_offsets(counts, "s", "chunk", "n", slots // 1024 + 1)
    within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    return slot.withColumn("within", within).join(before, ["s", "chunk"]).select("slot", "s", (F.col("within") + F.col("offset")).alias("rank"))


def shuffled(rank: Column, blocks: Column) -> Column:
    """The place of rank (from 0) in a fixed shuffle of so many blocks: chunks are dealt by a prime stride, and so are the
    blocks within a chunk."""
    full, chunk, inner = F.floor(blocks / CHUNK), F.floor(rank / CHUNK), rank % CHUNK
    moved = chunk * (F.lit(STRIDES[0]) % F.greatest(full, F.lit(1))) % F.greatest(full, F.lit(1))
    rest = F.greatest(blocks - full * CHUNK, F.lit(1))
    return F.when(chunk < full, moved * CHUNK + (inner * STRIDES[1] + moved * 7) % CHUNK).otherwise(full * CHUNK + inner * STRIDES[1] % rest).cast("long")


def settled_slots(planned: DataFrame, sources: DataFrame, slots: int, block: int) -> DataFrame:
    """(slot, s, rank, block): the scheduled slots as far as their sources have blocks, and slots after all others for the
    blocks that are left."""
    counts = planned.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    blocks = sources.select("s", F.ceil(F.col("want") / block).alias("blocks"))
    left = blocks.join(counts, "s", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("blocks > n")
    left = left.withColumn("rank", F.explode(F.sequence("n", F.col("blocks") - 1)))
    left = left.select((F.lit(slots) + (F.col("rank") - F.col("n")) * sources.count() + F.col("s")).alias("slot"), "s", "rank", "blocks")
    rows = attach(planned.withColumn("run", F.pmod("slot", F.lit(64))), blocks, ["s"], "run", "inner").where("rank < blocks").select("slot", "s", "rank", "blocks")
    return rows.union(left).select("slot", "s", "rank", shuffled(F.col("rank"), F.col("blocks")).alias("block"))


def lines(sizes: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """sizes with s, source_size, target and start, the document's place on its source's line."""
    buckets = rows // 512 + 1
    facts = sources.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "s", "source_size", "target", "want")
    docs = attach(sizes.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(256))), facts, ["key"], "run", "inner").drop("key", "run")
    unit = F.conv(F.substring("mix", 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    docs = docs.withColumn("bucket", F.floor(unit * buckets))
    sums = docs.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = running_offsets(sums, "s", "bucket", "n", buckets)
    within = Window.partitionBy("s", "bucket").orderBy("mix", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return docs.join(before, ["s", "bucket"]).withColumn("start", F.col("within") + F.col("offset")).drop("within", "offset", "bucket", "mix")


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: str = "mix", repeats: int = REPEATS, point=van_der_corput) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes and targets, and the mix: (slot, row, doc_id, s, from_word, words).

    A row of the mix says that this slot reads words from_word and on of the document. Blocks have ``block`` words, or
    fewer where the schedule would have less than ``slots`` slots. Null texts and texts without words have size 0 and
    are never taken; a null source is a source; an empty table gives empty results.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs, seed), "sizes")
    sources = written(targets(sizes, repeats).withColumn("want", F.round("target").cast("long")), "sources")
    rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(block, total // slots))
    slots = -(-total // block)
    planned = written(settled_slots(written(schedule(spark, sources, slots, point), "points"), sources, slots, block), "schedule")
    placed = written(lines(sizes, sources, rows), "lines")
    begin = F.col("epoch") * F.col("source_size") + F.col("start")
    pieces = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    pieces = pieces.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), "want")).where("begin < end")
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)
    pieces = pieces.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("end"), (F.col("block") + 1) * block)
    pieces = pieces.select("row", "doc_id", "s", "block", (low - F.col("begin")).alias("from_word"), (high - low).alias("words"))
    return placed, pieces.join(planned, ["s", "block"]).select("slot", "row", "doc_id", "s", "from_word", "words")


def mixed_sizes(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: str = "mix", point=van_der_corput) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, blocks (how many slots read it)
    and first_slot (null if none)."""
    return taken_words(docs, block, slots, seed, point).select("doc_id", "source", "size", "source_size", "target", "taken", "blocks", "first_slot")


def taken_words(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: str = "mix", point=van_der_corput) -> DataFrame:
    """mixed_sizes with row."""
    placed, taken = mix(docs, block, slots, seed, point=point)
    words = taken.groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("blocks"), F.min("slot").alias("first_slot"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return placed.join(words, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", none("taken"), none("blocks"), "first_slot")


def mixed_documents(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: str = "mix") -> DataFrame:
    """docs as the mix reads them: a document comes as often as its slots read it, the last time perhaps in part."""
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("int")
    rows = with_rows(docs)
    kept = taken_words(rows, block, slots, seed).select(F.col("row").alias(ROW), times.alias("_mix_times")).where("_mix_times > 0")
    out = rows.join(kept.hint("merge"), ROW)
    out = out.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_mix_times")).alias("_mix_copy"))
    return out.select(docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


SQL = {
    "op8_mixing": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, md5('mix' || doc_id::VARCHAR) AS mix,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
          FROM documents),
        src AS (
          SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS most,
                 ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
          FROM d GROUP BY source),
        fill AS (  -- sources that are above their limit are set to it, and the rest is shared again
          SELECT 0 AS step, source, source_size, most, weight, false AS capped,
                 (SELECT sum(source_size) FROM src)::DOUBLE AS rest, (SELECT sum(weight) FROM src)::DOUBLE AS open FROM src
          UNION ALL
          SELECT step + 1, source, source_size, most, weight, now_capped,
                 (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) FILTER (now_capped) OVER (), 0),
                 sum(weight) FILTER (NOT now_capped) OVER ()
          FROM (SELECT *, capped OR rest / open * weight > most AS now_capped FROM fill) WHERE step < 64),
        t AS (
          SELECT source, source_size, CASE WHEN capped THEN most ELSE rest / open * weight END AS target
          FROM fill WHERE step = 64),
        placed AS (
          SELECT d.*, source_size, target,
                 (sum(size) OVER (PARTITION BY d.source ORDER BY mix, doc_id) - size)::BIGINT AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        wanted AS (SELECT source, round(target)::BIGINT AS want, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s, count(*) OVER () AS many FROM t),
        size AS (
          SELECT total, greatest(1, least(64, total // 65536)) AS block FROM (SELECT sum(size)::BIGINT AS total FROM d)),
        points AS (  -- the bits of the slot's number behind the binary point, the lowest first
          SELECT slot, sum(((slot >> bit) & 1) / pow(2.0, bit + 1)) AS u
          FROM (SELECT unnest(range(((total + block - 1) // block)::BIGINT)) AS slot FROM size), range(40) AS bits(bit) GROUP BY slot),
        ends AS (
          SELECT source, round(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER (), 12) AS high FROM t WHERE target > 0),
        parts AS (SELECT source, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low, high FROM ends),
        slots AS (
          SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
          FROM points JOIN parts ON low <= u AND u < high),
        most AS (  -- the blocks of each source, and its scheduled slots
          SELECT w.source, s, many, (want + block - 1) // block AS blocks, (SELECT count(*) FROM slots AS x WHERE x.source IS NOT DISTINCT FROM w.source) AS n,
                 greatest(((want + block - 1) // block) // 1024, 1) AS deal, ((want + block - 1) // block) // 1024 AS whole FROM wanted AS w, size),
        planned AS (  -- those, and slots at the end for blocks that are left
          SELECT slot, x.source, rank, blocks, deal, whole FROM slots AS x JOIN most AS m ON x.source IS NOT DISTINCT FROM m.source WHERE rank < blocks
          UNION ALL
          SELECT (total + block - 1) // block + (rank - n) * many + s, source, rank, blocks, deal, whole
          FROM (SELECT *, unnest(range(n, blocks)) AS rank FROM most WHERE n < blocks), size),
        dealt AS (
          SELECT slot, source, CASE WHEN rank // 1024 < whole THEN moved * 1024 + (rank % 1024 * 1031 + moved * 7) % 1024
                                    ELSE whole * 1024 + rank % 1024 * 1031 % greatest(blocks - whole * 1024, 1) END AS block_at
          FROM (SELECT *, (rank // 1024) * (4294967311 % deal) % deal AS moved FROM planned)),
        pieces AS (
          SELECT doc_id, p.source, e * source_size + start AS first, least(e * source_size + start + size, want) AS last, block,
                 unnest(range((e * source_size + start) // block, (least(e * source_size + start + size, want) - 1) // block + 1)) AS block_at
          FROM placed AS p JOIN wanted AS w ON p.source IS NOT DISTINCT FROM w.source, (SELECT block FROM size), (VALUES (0), (1), (2)) AS epochs(e)
          WHERE size > 0 AND e * source_size + start < want),
        taken AS (
          SELECT doc_id, sum(least(last, (p.block_at + 1) * block) - greatest(first, p.block_at * block))::BIGINT AS taken, count(*) AS blocks, min(slot) AS first_slot
          FROM pieces AS p JOIN dealt AS d ON p.block_at = d.block_at AND p.source IS NOT DISTINCT FROM d.source GROUP BY doc_id)
        SELECT p.doc_id, p.source, p.size, source_size, target, coalesce(taken, 0) AS taken, coalesce(blocks, 0) AS blocks, first_slot
        FROM placed AS p LEFT JOIN taken AS t ON p.doc_id = t.doc_id"""
}
QUERIES = {"op8_mixing": op8_mixing}
