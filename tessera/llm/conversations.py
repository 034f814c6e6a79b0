"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is repaired by edits of its turns so that role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole to user
or assistant 3, Delete 4 (a must for blank and duplicate turns), Insert of an empty user or assistant turn 3, and 3 more
for a truncated turn that stays. Four states know all that matters of what was written: nothing, s, u, a.

A block is at most ``BLOCK`` turns of one conversation in order; each is reduced to the 4 x 4 costs between states before
and after it, with the ASCII order of the audits that reach these costs. Between blocks, and inside each of them, forward
and backward cost vectors meet in the middle, the audit-least optimal crossing is taken, and both halves are solved in the
same way, so nothing but vectors of four numbers is kept for a half.

Why ranks are enough to find the least audit: after a given turn all audits have equally many letters other than I and end
with one of them, so none is the beginning of another, and what follows can't change their order. An audit also tells the
roles: I and R have one possible role in each state.

A very long conversation is many blocks on many tasks; only its blocks' 32 small numbers, and in the end the stream of its
edits for the digest, pass one task, and neither keeps texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40  # the cost of what can't be
INITIALS = "sua"
ROLE_OF = {"u": "user", "a": "assistant"}
INSERTED = (2, 2, 3, 2)  # the state after an insert
END = (0, 2 * INSERT, INSERT, 0)  # inserts that end a conversation
BLANK, DUPLICATE, CUT = 1, 2, 3


def step(kind: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a turn: kind is 4 * fault + place of its initial in INITIALS (or 3)."""
    fault, initial = divmod(kind, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state, cost, audit = before, 0, ""
        for _ in range(3):  # no, one or two inserts first
            after = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT else 0
                written_next = 3 if state == 2 else 2
                after.append((written_next, REROLE + extra, "R"))
                if (initial == 0 and state == 0) or (initial in (1, 2) and written_next == initial + 1):
                    after.append((initial + 1, KEEP + extra, "K"))
            for to, more, letter in after:
                found = (cost + more, audit + letter)
                best[before, to] = min(best.get((before, to), (FAR, "")), found)
            state, cost, audit = INSERTED[state], cost + INSERT, audit + "I"
    return [(a, b, cost, audit) for (a, b), (cost, audit) in sorted(best.items())]


STEPS = [step(kind) for kind in range(16)]


def forward(steps: list, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Least costs from start to each state over steps[lo:hi], and the order of the least audits that have them."""
    costs, ranks = [FAR] * 4, [0] * 4
    costs[start] = 0
    for i in range(lo, hi):
        best = [(FAR, 0, "")] * 4
        for a, b, cost, audit in steps[i]:
            if costs[a] < FAR and (found := (costs[a] + cost, ranks[a], audit)) < best[b]:
                best[b] = found
        costs = [x[0] for x in best]
        order = sorted((x[1], x[2], b) for b, x in enumerate(best) if x[0] < FAR)
        ranks = [0] * 4
        for rank, x in enumerate(order):
            ranks[x[2]] = rank
    return costs, ranks


def backward(steps: list, lo: int, hi: int, stop: int) -> list[int]:
    """Least costs from each state over steps[lo:hi] to stop."""
    costs = [FAR] * 4
    costs[stop] = 0
    for i in range(hi - 1, lo - 1, -1):
        less = [FAR] * 4
        for a, b, cost, _ in steps[i]:
            less[a] = min(less[a], cost + costs[b])
        costs = less
    return costs


def crossings(steps: list, start: int, stop: int) -> list[int]:
    """The states between the steps, start and stop included, of the cheapest path with the least audit."""
    out = [start] * len(steps) + [stop]
    open_ = [(0, len(steps))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        (costs, ranks), rest = forward(steps, lo, mid, out[lo]), backward(steps, mid, hi, out[hi])
        out[mid] = min((costs[s] + rest[s], ranks[s], s) for s in range(4) if costs[s] < FAR)[2]
        open_ += [(mid, hi), (lo, mid)]
    return out


def last_state(steps: list) -> int:
    costs, ranks = forward(steps, 0, len(steps), 0)
    return min((costs[s] + END[s], ranks[s], s) for s in range(4) if costs[s] < FAR)[2]


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs, ranks = [], []
        for kinds in batch.column("kinds").to_pylist():
            steps = [STEPS[k] for k in kinds]
            found = [forward(steps, 0, len(steps), s) for s in range(4)]
            costs.append([c for x in found for c in x[0]])
            ranks.append([r for x in found for r in x[1]])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))], names=["conv_id", "block", "costs", "ranks"])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, starts, stops, lasts = [], [], [], []
        for found in batch.column("blocks").to_pylist():
            steps = [[(a, b, x["costs"][4 * a + b], str(x["ranks"][4 * a + b])) for a in range(4) for b in range(4) if x["costs"][4 * a + b] < FAR] for x in found]
            states = crossings(steps, 0, last_state(steps))
            blocks += [x["block"] for x in found]
            starts += states[:-1]
            stops += states[1:]
            lasts += [False] * (len(found) - 1) + [True]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(lasts, pa.bool_())], names=["block", "start", "stop", "last"])


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "place", "k", "edit", "initial"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            steps = [STEPS[k] for k in x["kinds"]]
            states = crossings(steps, x["start"], x["stop"])
            for i, kind in enumerate(x["kinds"]):
                state = states[i]
                audit = next(s[3] for s in steps[i] if s[:2] == (state, states[i + 1]))
                tail = "I" * (END[x["stop"]] // INSERT) if x["last"] and i + 1 == len(steps) else ""
                for k, letter in enumerate(audit + tail):
                    if letter == "I":
                        state = INSERTED[state]
                    elif letter == "R":
                        state = 3 if state == 2 else 2
                    elif letter == "K":
                        state = kind % 4 + 1
                    rows.append((x["conv_id"], x["block"] + i, k, letter, "" if letter == "D" else INITIALS[state - 1]))
        for at in range(0, max(len(rows), 1), 10_000):
            columns = list(zip(*rows[at : at + 10_000], strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults that the hash of conv_id and turn puts in; a null counts as one space."""
    space = F.lit(" ")
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(times)).select("conv_id", "turn", "role", "text")


def _placed(block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the sorted rows of a partition, and cuts them to blocks of one conversation."""
        count, top, conv = 0, 0, object()
        for batch in batches:
            blocks, part = [], batch.column("part").to_pylist()
            for i, c in enumerate(batch.column("conv_id").to_pylist()):
                if c != conv or count + i - top >= block:
                    conv, top = c, count + i
                blocks.append((part[i] << 40) + top)
            places = [(p << 40) + count + i for i, p in enumerate(part)]
            count += len(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "turn", "role", "text")], pa.array(places, pa.int64()), pa.array(blocks, pa.int64())], names=["conv_id", "turn", "role", "text", "place", "block"])

    return run


def placed(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns in order (by turn, nulls first; equal ones by role and text): place grows with the order, block is the place
    of the first turn of a block."""
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.withColumn("part", F.spark_partition_id().cast("long"))
    return written(rows.mapInArrow(_placed(block), "conv_id long, turn long, role string, text string, place long, block long"), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """turns with fault: 0 or the first that holds of BLANK, DUPLICATE (role and text were there before) and CUT."""
    name = [F.xxhash64("role", "text"), F.xxhash64("text", F.lit("second"), "role")]
    first = turns.groupBy("conv_id", name[0].alias("a"), name[1].alias("b")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    ink, whole = F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~ink, BLANK).when(F.col("first").isNull(), DUPLICATE).when(~whole, CUT).otherwise(0)
    return turns.join(first, "place", "left").withColumn("fault", fault).drop("first")


def initial(role: Column) -> Column:
    """0, 1, 2 for s, u, a and 3 for any other initial, or none."""
    at = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    return F.when((F.length(role) > 0) & (at > 0), at - 1).otherwise(3)


def edits(turns: DataFrame) -> DataFrame:
    """The edits of placed turns, in the order of conv_id, place, k: edit (K, R, D or I), role and text as repaired; and of
    the turn itself (all but I) turn, fault and initial."""
    known = written(faults(turns).withColumn("initial", initial(F.col("role"))), "faults")
    kinds = F.sort_array(F.collect_list(F.struct("place", (F.col("fault") * 4 + F.col("initial")).alias("kind"))))
    blocks = written(known.groupBy("conv_id", "block").agg(kinds["kind"].alias("kinds")), "blocks")
    sums = blocks.mapInArrow(_summaries, "conv_id long, block long, costs array<long>, ranks array<long>")
    whole = sums.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "ranks"))).alias("blocks"))
    ends = whole.mapInArrow(_ends, "block long, start int, stop int, last boolean")
    found = blocks.join(ends, "block").mapInArrow(_edits, "conv_id long, place long, k int, edit string, initial string")
    rows = found.withColumnRenamed("initial", "to").join(known.drop("conv_id", "block"), "place")
    inserted = F.col("edit") == "I"
    named = F.when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant")
    own = lambda c: F.when(~inserted, F.col(c)).alias(c)
    return rows.select(
        "conv_id", "place", "k", "edit", F.when(F.col("edit").isin("R", "I"), named).otherwise(F.col("role")).alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"), own("turn"), own("fault"), own("initial"),
    )


def repaired(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, position (grows with the order), role, text, edit (K, R or I). Turns are taken
    by turn (nulls first), equal ones by role and text; a null role or text is one space. A role that is empty or begins
    with anything but s, u, a can't be kept. Turns without a conv_id are one conversation. Other columns aren't read; an
    empty table gives an empty result."""
    rows = edits(placed(convs, block)).where("edit <> 'D'")
    return rows.select("conv_id", F.struct("place", "k").alias("position"), "role", "text", "edit")


class _Audit:
    def __init__(self, conv: int | None):
        self.conv, self.letters, self.cost, self.sha, self.lines = conv, [], 0, hashlib.sha256(), 0
        self.faults, self.illegal, self.before, self.turn, self.low, self.turns = [0] * 4, 0, "", None, None, 0

    def add(self, edit, role, text, turn, fault, initial):
        self.letters.append(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "D":
            self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1
        if edit != "I":
            self.cost += TRUNCATED if fault == CUT and edit != "D" else 0
            self.faults[fault] += 1
            own = (INITIALS + "-")[initial]
            self.illegal += bool(self.before) and self.before + own not in ("su", "ua", "au")
            self.before = own
            if turn is not None and turn != self.turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.turn = turn

    def row(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest())


AUDIT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
AUDIT_TYPES = [pa.int64()] * 7 + [pa.string()] * 2
AUDIT_NAMES = [x.split()[0] for x in AUDIT_SQL.split(", ")]


def _audits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a stream of sorted edits; no text is kept."""
    now = None
    for batch in batches:
        rows = []
        for conv, *edit in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "turn", "fault", "initial")], strict=True):
            if now is None or now.conv != conv:
                rows += [now.row()] if now else []
                now = _Audit(conv)
            now.add(*edit)
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, AUDIT_TYPES, strict=True)], names=AUDIT_NAMES)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), AUDIT_TYPES, strict=True)], names=AUDIT_NAMES)


def audited(convs: DataFrame, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conv_id of names: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of the
    repaired role:text, joined by newlines) of its turns in convs; zeros and empty texts where it has none. gaps are the
    turn numbers that are missing between least and largest."""
    rows = edits(placed(convs, block)).repartition("conv_id").sortWithinPartitions("conv_id", "place", "k")
    found = rows.mapInArrow(_audits, AUDIT_SQL).withColumnRenamed("conv_id", "id")
    all_ = names.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = all_.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in AUDIT_NAMES[1:7]]
    return out.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    return audited(damaged(convs), convs)


SQL = {
    # states: 0 nothing written, 1 s, 2 u, 3 a; a row of "dp" is the cheapest way, ties by audit, to a state after i turns
    "op12_conversation_repair": r"""
        WITH RECURSIVE
        crc AS (SELECT list(c ORDER BY i) AS t FROM (
          SELECT i, list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) AS c FROM range(256) AS bytes(i))),
        r0 AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
                                 lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1]), 4294967295), 4294967295) % 20 AS fault
          FROM conversations, crc),
        r1 AS (
          SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
          FROM r0 WHERE fault <> 0),
        r2 AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS kind, substring(role, 1, 1) AS initial
          FROM r1),
        inserts(a, b, letters, said) AS (VALUES
          (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', '
user:'), (1, 2, 'I', '
user:'), (2, 3, 'I', '
assistant:'), (3, 2, 'I', '
user:'),
          (0, 3, 'II', '
user:
assistant:'), (1, 3, 'II', '
user:
assistant:'), (2, 2, 'II', '
assistant:
user:'), (3, 3, 'II', '
user:
assistant:')),
        moves(b, c, letter, initial) AS (VALUES
          (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
          (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'R', NULL)),
        dp AS (
          SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'said': ''} AS best FROM r2
          UNION ALL
          SELECT conv_id, i, state, min(best) FROM (
            SELECT r.conv_id, r.i, m.c AS state,
                   {'cost': dp.best.cost + 3 * length(n.letters) + CASE m.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN r.kind = 'truncated' AND m.letter <> 'D' THEN 3 ELSE 0 END,
                    'audit': dp.best.audit || n.letters || m.letter,
                    'said': dp.best.said || replace(n.said, '
', chr(10)) || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || CASE m.c WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text END} AS best
            FROM dp JOIN r2 AS r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN inserts AS n ON n.a = dp.state JOIN moves AS m ON m.b = n.b
            WHERE (m.letter <> 'K' OR m.initial = r.initial) AND (m.letter = 'D' OR r.kind NOT IN ('blank', 'duplicate')))
          GROUP BY conv_id, i, state),
        ends(state, letters, said) AS (VALUES (0, '', ''), (1, 'II', '
user:
assistant:'), (2, 'I', '
assistant:'), (3, '', '')),
        done AS (
          SELECT dp.conv_id, min({'cost': best.cost + 3 * length(e.letters), 'audit': best.audit || e.letters, 'said': best.said || replace(e.said, '
', chr(10))}) AS best
          FROM dp JOIN ends AS e USING (state) JOIN (SELECT conv_id, max(i) AS i FROM r2 GROUP BY 1) AS l ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND l.i = dp.i GROUP BY 1),
        facts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
                 count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
          FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r2) GROUP BY 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substring(best.said, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN facts AS f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done AS d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""
}
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
