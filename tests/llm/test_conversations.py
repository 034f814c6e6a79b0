"""Conversation repair against a table of all states that is kept whole."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import conversations as C

INK = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"
PAIRS = ("u", "su", "ua", "au")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def cheapest(turns):
    """(cost, audit, lines) of turns (role, text, fault), every audit of least cost of every state being compared."""
    def grown(best):
        for _ in range(3):
            for last, (cost, audit, lines) in list(best.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if last + initial in PAIRS:
                        found = (cost + 3, audit + "I", (*lines, (role, "")))
                        if initial not in best or found[:2] < best[initial][:2]:
                            best[initial] = found
        return best

    best = {"": (0, "", ())}
    for role, text, fault in turns:
        new = {}

        def put(last, found, new=new):
            if last not in new or found[:2] < new[last][:2]:
                new[last] = found

        for last, (cost, audit, lines) in grown(dict(best)).items():
            put(last, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] and last + role[:1] in ("s", *PAIRS):
                put(role[:1], (cost + more, audit + "K", (*lines, (role, text))))
            for initial, name in (("u", "user"), ("a", "assistant")):
                if last + initial in PAIRS:
                    put(initial, (cost + 3 + more, audit + "R", (*lines, (name, text))))
        best = new
    return min((x for last, x in grown(best).items() if last in ("", "a")), key=lambda x: x[:2])


def brute(rows, names):
    convs = {r[0]: [] for r in names}
    for r in rows:
        convs[r[0]].append(r)
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, turns = set(), []
        for _, _, role, text in found:
            ink = INK.findall(text)
            turns.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, lines = cheapest(turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
        faults, numbers = [t[2] for t in turns], [r[1] for r in found if r[1] is not None]
        initials = [r[2][:1] for r in found]
        out.append((
            conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
            sum(a + b not in PAIRS[1:] for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        ))
    return out


def key(r):
    return r[0] is not None, r[0] or 0


def random_rows(seed):
    rng = random.Random(seed)
    roles, texts = ("user", "assistant", "system", "tool", "", None, "umpire"), ("Hello.", "So", "a b!", "", " \t", "Why?  \n", None, "Hello.\n")
    rows = []
    for conv in [*range(40), None]:
        for i in range(rng.choice((0, 1, 2, 5, 9, 30))):
            rows.append((conv, rng.choice((i, i, i, rng.randint(0, 40), None)), rng.choice(roles[: rng.choice((2, 3, 7))]), rng.choice(texts[:3]) if rng.random() < 0.6 else rng.choice(texts)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 3), (3, 1)])
def test_random_conversations(spark, seed, block):
    rows = random_rows(seed)
    convs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", place string, fault int")
    got = [tuple(r) for r in C.audited(C.damaged(convs), convs, block).collect()]
    assert sorted(got, key=key) == sorted(brute(damage(rows), rows), key=key)


def test_the_table_itself(spark, sf_dir):
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in C.op12_conversation_repair(spark, sf_dir).collect()]
    assert sorted(got, key=key) == sorted(brute(damage(rows), rows), key=key)


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.audited(none, none).count() == 0 and C.repaired(none).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    one = spark.createDataFrame([(7, 1, "user", "x")], SCHEMA)
    assert [tuple(r) for r in C.audited(none, one).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", empty)]
    rows = C.repaired(spark.createDataFrame([(1, 0, "assistant", "Yes."), (1, 1, "user", "So?"), (1, 2, "user", "So?")], SCHEMA)).orderBy("position").collect()
    assert [(r.role, r.text, r.edit) for r in rows] == [("user", "", "I"), ("assistant", "Yes.", "K"), ("user", "So?", "K"), ("assistant", "", "I")]


def test_one_very_long_conversation(spark):
    """Blocks of 64 turns, and linear time: the audit is that of one block."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(("user", "assistant", "system")), f"t{i}" + rng.choice((".", "")) if rng.random() < 0.9 else "") for i in range(3000)]
    convs = spark.createDataFrame(rows, SCHEMA)
    a, b = (C.audited(convs, convs, block).first() for block in (64, 4096))
    assert a == b and tuple(a) == brute(rows, rows)[0]
