"""Line dedup: a suffix array over the lines of all documents by prefix doubling, and the intervals of its common prefixes.

Up: lines get ranks in the order of their hashes. In each round the ranks of two neighbouring windows of 2^k lines make
the rank of a window twice as long, by sorting within each old rank, as in building a suffix array. A window that comes
once can't begin a longer repeated one, so only repeated windows go on; the rounds end when none is left.

Down: equal ranks of 2^k lines tell how far neighbouring suffixes agree, the largest power first. A group holds
suffixes that agree on so many lines. In each round the members of a group whose next 2^k lines have equal ranks are
moved to a group of their own, 2^k lines deeper, and its first member stays behind in their stead. In the end each group
is an interval of the suffix array: its members are the first suffixes of the interval's parts, and they agree on
exactly the interval's longest common prefix, a repeated run that can't be prolonged for all of them.

A member that isn't the first of its interval is a later copy of the interval's run, and that is the longest run from
there that came before. The lines of such copies go if the run has at least ``MIN_WORDS`` words and ``MIN_LINES`` lines.
First means by doc_id (null first), row and position. Only DataFrame functions are used. Ranks are counted in buckets
and joined by runs, so no key gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROW, WORD, attach, running_offsets, table, with_rows, written

MIN_WORDS, MIN_LINES = 10, 1
RUNS = 256
BLANK = r"[\x20\x09-\x0D]"
SUFFIX = ["doc_id", "row", "run", "pos"]


def _words(line: str, most: int) -> Column:
    """The words of a line; where ``most`` isn't 0, no more than so many are looked for: the rest of a line isn't read."""
    count = F.regexp_count(line, F.lit(WORD)).cast("long")
    many = f"^{BLANK}*+(?:{WORD}+{BLANK}++){{{most - 1}}}{WORD}"
    return F.when(F.rlike(line, F.lit(many)), F.lit(most).cast("long")).otherwise(count) if most > 0 else count


def line_ids(docs: DataFrame, most: int = 0) -> DataFrame:
    """(doc_id, row, run, pos, words, h1, h2) of each line of what with_rows wrote; two hashes tell lines apart. words:
    as many as there are, or ``most``, if that isn't 0 and there are more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ROW).alias("row"), "text")
    rows = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    run, words = F.pmod(F.xxhash64("row"), F.lit(RUNS)).alias("run"), _words("line", most).alias("words")
    return rows.select("doc_id", "row", run, "pos", words, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def ranked(groups: DataFrame, within: str, by: list[str], bucket, buckets: int) -> DataFrame:
    """groups (within, by, members) with rank: the least rank of the old group plus the members that sort before."""
    rows = groups.withColumn("bucket", bucket)
    before = running_offsets(rows.groupBy(within, "bucket").agg(F.sum("members").alias("n")), within, "bucket", "n", buckets)
    own = F.sum("members").over(Window.partitionBy(within, "bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0)))
    return rows.join(before, [within, "bucket"]).withColumn("rank", F.col(within) + F.col("own") + F.col("offset")).drop("own", "offset", "bucket")


def repeated_windows(lines: DataFrame) -> list[DataFrame]:
    """For 1, 2, 4, ... lines: (SUFFIX, words, rank) of the windows that come more than once."""
    columns, levels, width = [*SUFFIX, "words", "rank"], [], 1
    buckets = lines.count() // 256 + 1
    unit = F.shiftrightunsigned(F.col("h1"), 32).cast("double") / F.lit(float(2**32))

    def named(rows: DataFrame, key: list[str], within: Column, by: list[str], bucket: Column) -> DataFrame:
        """rows with the rank of their key, of those keys that come more than once. Keys are counted by run, once: that
        makes the groups, and their ranks come back to the rows by the same runs."""
        runs = written(rows.groupBy(*key, "run").agg(F.count(F.lit(1)).alias("members")), "runs")
        groups = written(runs.groupBy(*key).agg(F.sum("members").alias("members")).where("members > 1"), "groups")
        ranks = ranked(groups.withColumn("within", within), "within", by, bucket, buckets).select(*key, "rank")
        return written(rows.join(runs.select(*key, "run").join(ranks, key), [*key, "run"]).select(columns), "windows")

    level = named(lines, ["h1", "h2"], F.lit(0).cast("long"), ["h1", "h2"], F.floor(unit * buckets))
    while not level.isEmpty():
        levels.append(level)
        here = level.withColumnRenamed("rank", "a")
        after = level.select("row", (F.col("pos") - width).alias("pos"), F.col("rank").alias("b"), F.col("words").alias("more"))
        pairs = here.join(after, ["row", "pos"]).withColumn("words", F.col("words") + F.col("more")).drop("more")
        pairs = written(pairs, "pairs")
        level, width = named(pairs, ["a", "b"], F.col("a"), ["b"], F.floor(F.col("b") / 256)), 2 * width
    return levels


GROUP = ["lines", "of_row", "of_pos"]
ITEM = [*SUFFIX, "weight", *GROUP, "words"]


def deeper(items: DataFrame, width: int) -> DataFrame:
    """(ITEM) after a round over items (ITEM, rank, more), by groups of equal GROUP and rank: the members of groups of two
    and more, ``width`` lines deeper; the first of each such group, as it was, standing for all of them; and the others, as
    those without a rank. Of items without a group (lines 0) only the first kind is there. A group is named by its depth
    and its first suffix. weight is the number of suffixes that a member stands for."""
    key, total = [*GROUP, "rank"], [F.sum(c).alias(c) for c in ("members", "all")]
    runs = items.where("rank IS NOT NULL").groupBy(*key, "run").agg(F.count(F.lit(1)).alias("members"), F.sum("weight").alias("all"), F.min(F.struct("doc_id", "row", "pos")).alias("first"))
    runs = written(runs, "runs")
    alike = runs.groupBy(*key).agg(*total, F.min("first").alias("first")).where("members > 1")
    alike = alike.select(*key, "all", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))
    items = written(items.join(runs.select(*key, "run").join(alike, key), [*key, "run"], "left"), "members")
    new = {"lines": F.col("lines") + width, "words": F.col("words") + F.col("more"), "of_row": F.col("first_row"), "of_pos": F.col("first_pos")}
    item = lambda **changed: F.struct(*[changed.get(c, F.col(c)).alias(c) for c in ITEM])
    alone, grouped, first = F.col("all").isNull(), F.col("lines") > 0, (F.col("row") == F.col("first_row")) & (F.col("pos") == F.col("first_pos"))
    parts = [F.when(alone & grouped, item()), F.when(~alone, item(**new)), F.when(~alone & grouped & first, item(weight=F.col("all")))]
    return items.select(F.explode(F.array_compact(F.array(*parts))).alias("item")).select("item.*")


def intervals(levels: list[DataFrame], min_words: int = 0) -> DataFrame:
    """(ITEM): the members of each interval of the suffix array with a common prefix, by GROUP; weight is the number of
    suffixes of the member's part. Of intervals of one line only those of min_words words are there."""
    groups = None
    for k in range(len(levels) - 1, -1, -1):
        level, width = levels[k], 1 << k
        # of all suffixes those with a repeated window; of those with a longer one the first of each
        fresh = level.withColumn("weight", F.lit(1).cast("long"))
        if groups is not None:
            longer = levels[k + 1].groupBy("rank").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("all"))
            longer = levels[k + 1].select("row", "pos").join(longer.select("first.row", "first.pos", "all"), ["row", "pos"], "left").withColumn("long", F.lit(True))
            fresh = fresh.join(longer, ["row", "pos"], "left").where("long IS NULL OR all IS NOT NULL").withColumn("weight", F.coalesce("all", "weight"))
        if k == 0:
            fresh = fresh.where(F.col("words") >= min_words)
        zero = F.lit(0).cast("long")
        fresh = fresh.select(*SUFFIX, "weight", F.lit(0).alias("lines"), zero.alias("of_row"), F.lit(0).alias("of_pos"), zero.alias("words"), "rank", F.col("words").alias("more"))
        if groups is not None:
            here = level.select("row", F.col("pos").alias("at"), "rank", F.col("words").alias("more"))
            fresh = fresh.unionByName(groups.withColumn("at", F.col("pos") + F.col("lines")).join(here, ["row", "at"], "left").drop("at"))
        groups = deeper(fresh, width)  # of a table written in this round
    return groups


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """(row, pos, lines, copies): the suffixes that begin with a later copy of a repeated run: the lines of the longest
    such run, and how often it comes, if it has enough words and lines."""
    levels = repeated_windows(lines)
    if not levels:
        return lines.select("row", "pos", F.lit(0).alias("lines"), F.lit(0).cast("long").alias("copies")).limit(0)
    found = intervals(levels, min_words).where((F.col("words") >= min_words) & (F.col("lines") >= min_lines))
    size = found.groupBy(*GROUP).agg(F.sum("weight").alias("copies"))
    later = found.where("row <> of_row OR pos <> of_pos")
    return written(attach(later, size, GROUP, "run", "inner").select("row", "pos", "lines", "copies"), "copies")


def runs_of(copies: DataFrame) -> DataFrame:
    """(row, runs, longest): the stretches of lines (first, lines) that the copies cover, and the longest copied run
    (lines, copies). A copy never ends before one that begins earlier does, as it would be longer otherwise."""
    order = Window.partitionBy("row").orderBy("pos")
    rows = copies.withColumn("end", F.col("pos") + F.col("lines"))
    opens = F.coalesce(F.col("pos") > F.lag("end").over(order), F.lit(True)).cast("int")
    rows = rows.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(order))
    rows = rows.groupBy("row", "stretch").agg(F.min("pos").alias("first"), (F.max("end") - F.min("pos")).alias("n"), F.max(F.struct("lines", "copies")).alias("longest"))
    return rows.groupBy("row").agg(F.collect_list(F.struct("first", F.col("n").alias("lines"))).alias("runs"), F.max("longest").alias("longest"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """One row for each row of docs: doc_id, text (what is left), n_lines, n_deleted, n_runs (stretches of deleted
    lines), longest_run (lines of the longest run that was copied here) and run_copies (how often that one comes).

    Lines are split at line feeds, words are runs without the white space of ASCII. Of equal runs of at least
    ``min_words`` words and ``min_lines`` lines the first by doc_id (null first), row and position stays, also within a
    document; a copy that overlaps its first occurrence goes as far as it reaches beyond the first line. A null text has
    no lines and stays null; an empty text has one empty line; a text without lines left is empty. An empty table gives
    an empty result. Rows that repeat a doc_id and a text are copies like others. Other columns of docs aren't read.
    """
    docs = with_rows(docs.select("doc_id", "text"))
    gone = runs_of(later_copies(written(line_ids(docs, min_words), "lines"), min_words, min_lines))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ROW).alias("row"), "text")
    # a merge join at any size: what it moves then grows with the input alone
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], (r["first"] + r["lines"] - 1).cast("int"))))
    rows = rows.join(gone.select("row", places.alias("gone"), F.size("runs").alias("runs"), "longest").hint("merge"), "row", "left")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    # only texts that lose lines are split, once
    left = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))[0]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), count(n_lines).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_deleted"),
        count(F.col("runs")).alias("n_runs"), count(F.col("longest.lines")).alias("longest_run"), count(F.col("longest.copies")).alias("run_copies"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", "run_copies", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = {  # windows grow by a line a step, as long as they come more than once
    "op2_line_dedup": r"""
        WITH RECURSIVE l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
        grow AS (
          SELECT 1 AS n, * FROM (
            SELECT doc_id, pos, name, words, count(*) OVER (PARTITION BY name) AS copies, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) > 1 AS later
            FROM (SELECT *, md5(line) AS name FROM w)) WHERE copies > 1
          UNION ALL
          SELECT * FROM (
            SELECT n, doc_id, pos, name, words, count(*) OVER (PARTITION BY name) AS copies, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) > 1 AS later
            FROM (SELECT g.n + 1 AS n, g.doc_id, g.pos, md5(g.name || w.line) AS name, g.words + w.words AS words
                  FROM grow AS g JOIN w ON w.doc_id = g.doc_id AND w.pos = g.pos + g.n)) WHERE copies > 1),
        longest AS (SELECT * FROM grow WHERE later QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1),
        copied AS (SELECT * FROM longest WHERE words >= 10),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM copied),
        m AS (SELECT w.doc_id, w.pos, line, gone.pos IS NOT NULL AS gone FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos),
        s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM m),
        t AS (
          SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (opens) AS n_runs,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS left
          FROM s GROUP BY doc_id),
        r AS (SELECT doc_id, max(n)::BIGINT AS longest_run, arg_max(copies, n * 1e9::DOUBLE + copies) AS run_copies FROM copied GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs,
               coalesce(longest_run, 0) AS longest_run, coalesce(run_copies, 0) AS run_copies, CASE WHEN text IS NOT NULL THEN sha256("left") END AS text_sha256
        FROM documents AS d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id"""
}
QUERIES = {"op2_line_dedup": op2_line_dedup}
