"""Line dedup against a comparison of all pairs of suffixes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tessera.llm import line_dedup


def brute(docs, min_words, min_lines):
    """docs: (doc_id, text), doc_id unique or null. (text, n_deleted, longest_run, run_copies) of each."""
    order = sorted((i for i, (_, t) in enumerate(docs) if t is not None), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    lines = {i: docs[i][1].split("\n") for i in order}
    suffixes = [(i, p) for i in order for p in range(len(lines[i]))]

    def common(a, b):
        n = 0
        while a[1] + n < len(lines[a[0]]) and b[1] + n < len(lines[b[0]]) and lines[a[0]][a[1] + n] == lines[b[0]][b[1] + n]:
            n += 1
        return n

    gone, longest = Counter(), {}
    for k, s in enumerate(suffixes):
        shared = [common(s, t) for t in suffixes]
        n = max(shared[:k], default=0)
        if n >= min_lines and n and sum(len(x.split()) for x in lines[s[0]][s[1] : s[1] + n]) >= min_words:
            gone.update({(s[0], s[1] + j): 1 for j in range(n)})
            longest[s[0]] = max(longest.get(s[0], (0, 0)), (n, sum(x >= n for x in shared)))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        left = None if text is None else "\n".join(x for p, x in enumerate(lines[i]) if not gone[i, p])
        out.append((doc_id, left, sum(1 for a, _ in gone if a == i), *longest.get(i, (0, 0))))
    return out


def random_docs(seed):
    rng = np.random.default_rng(seed)
    alphabet = ["a b", "c", "d e f", "", "g h"]
    docs = []
    for i in range(24):
        docs.append((int(i) if i else None, "\n".join(alphabet[k] for k in rng.integers(0, 5, rng.integers(0, 14)))))
    docs[5] = (5, None)
    docs[9] = (9, docs[8][1])
    docs[12] = (12, "\n".join([docs[11][1], docs[11][1], docs[10][1]]))
    docs[20] = (20, "\n".join(["d e f"] * 17))  # a run that overlaps itself
    return docs


@pytest.mark.parametrize(("seed", "min_words", "min_lines"), [(1, 5, 1), (2, 2, 2), (3, 0, 3)])
def test_runs(spark, seed, min_words, min_lines):
    docs = random_docs(seed)
    rows = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words, min_lines).collect()
    got = sorted(str((r.doc_id, r.text, r.n_deleted, r.longest_run, r.run_copies)) for r in rows)
    assert got == sorted(map(str, brute(docs, min_words, min_lines)))


def test_intervals_are_maximal(spark):
    docs = line_dedup.with_rows(spark.createDataFrame(random_docs(4), "doc_id long, text string").coalesce(1))
    found = line_dedup.intervals(line_dedup.repeated_windows(line_dedup.line_ids(docs))).collect()
    lines = {r["_tessera_row"]: r.text.split("\n") for r in docs.where("text IS NOT NULL").collect()}
    groups = {}
    for r in found:
        groups.setdefault((r.lines, r.of_row, r.of_pos), []).append(r)
    for (n, *_), members in groups.items():
        if len(members) > 1:
            assert len({tuple(lines[r.row][r.pos : r.pos + n]) for r in members}) == 1
            further = [tuple(lines[r.row][r.pos : r.pos + n + 1]) for r in members]
            assert len({f for f in further if len(f) == n + 1}) == sum(len(f) == n + 1 for f in further)


def test_repeated_rows_and_null_ids(spark):
    text = "one two three\nfour five six\nseven eight nine ten"
    rows = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "other\n" + text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_runs, r.longest_run, r.run_copies) for r in line_dedup.line_dedup(rows).collect())
    assert got == [("1", "", 1, 3, 4), ("1", "", 1, 3, 4), ("2", "other", 1, 3, 4), ("None", text, 0, 0, 0)]


def test_keys_are_counted_once(spark, monkeypatch):
    """A level is made of one table of counts by run; of a line no more words are looked for than decide, and a line of
    blanks, or with blanks before its words, has as many as before."""
    names, kept = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: names.append(name) or kept(df, name))
    texts = [" \t one  two\rthree ", "", " \x0b ", "a b c d e f g", "a b c", "a b c d", "é è f"]
    docs = line_dedup.with_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for most, want in ((0, [3, 0, 0, 7, 3, 4, 2]), (3, [3, 0, 0, 3, 3, 3, 2]), (1, [1, 0, 0, 1, 1, 1, 1])):
        assert [r.words for r in line_dedup.line_ids(docs, most).orderBy("doc_id").collect()] == want
    names.clear()
    line_dedup.line_dedup(spark.createDataFrame([(1, "x y\nz"), (2, "x y\nz")], "doc_id long, text string"), 2).collect()
    assert names.count("runs") == names.count("windows") + names.count("members")
    assert names.count("members") == names.count("windows") - 1  # the last level is empty
