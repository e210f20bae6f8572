"""Conversation repair against all edits of short conversations and a plain search over longer ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from wagerlens.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, place string, segment string, symbol string"
WHOLE = re.compile("(s?(ua)+)?")


def faults(rows):
    """What each (turn, role, text) counts as first."""
    seen, found = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        found.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def all_repairs(rows):
    """Every way to edit a few rows, with at most two insertions in a row: the cheapest and then least."""
    fault, best = faults(rows), None
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
    own = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", None), ("R", "user"), ("R", "assistant")] for f in fault]
    for inserted in itertools.product(gaps, repeat=len(rows) + 1):
        if sum(map(len, inserted)) > 4:
            continue
        for edits in itertools.product(*own):
            cost, letters, lines = 0, "", []
            for k in range(len(rows) + 1):
                for one in inserted[k]:
                    cost, letters = cost + 3, letters + "I"
                    lines.append(({"u": "user", "a": "assistant"}[one], ""))
                if k < len(rows):
                    letter, role = edits[k]
                    letters += letter
                    cost += {"D": 4, "K": 0, "R": 3}[letter] + (3 if letter != "D" and fault[k] == "truncated" else 0)
                    if letter != "D":
                        lines.append((role or rows[k][1], rows[k][2]))
            if WHOLE.fullmatch("".join(role[:1] or "-" for role, _ in lines)) and (best is None or (cost, letters) < best[:2]):
                best = cost, letters, lines
    return best


def searched(rows):
    """The same for any number of rows: least (cost, letters) from each row and state on, without tables."""
    fault, memo = faults(rows), {}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    for k in range(len(rows), -1, -1):
        options = {}
        for state in after:
            found = [(0, "", [])] if k == len(rows) and state in ("", "a") else []
            if k < len(rows):
                _, role, text = rows[k]
                more = 3 if fault[k] == "truncated" else 0
                c, l, lines = memo[k + 1, state]
                found.append((4 + c, "D" + l, lines))
                if fault[k] not in ("blank", "duplicate"):
                    if role[:1] == after[state] or role[:1] == "s" and state == "":
                        c, l, lines = memo[k + 1, role[:1]]
                        found.append((more + c, "K" + l, [(role, text), *lines]))
                    c, l, lines = memo[k + 1, after[state]]
                    found.append((3 + more + c, "R" + l, [({"u": "user", "a": "assistant"}[after[state]], text), *lines]))
            options[state] = found
        for _ in range(3):  # insertions lead to other states at the same row
            for state in after:
                if options[after[state]]:
                    c, l, lines = min(options[after[state]], key=lambda x: x[:2])
                    options[state] = options[state] + [(3 + c, "I" + l, [({"u": "user", "a": "assistant"}[after[state]], ""), *lines])]
        memo |= {(k, state): min(found, key=lambda x: x[:2]) for state, found in options.items()}
    return memo[0, ""]


def brute(rows, repair=searched):
    """The summary of one conversation's (turn, role, text)."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    fault, turns = faults(ordered), {t for t, _, _ in ordered if t is not None}
    cost, audit, lines = repair(ordered)
    text = "\n".join(f"{role}:{text}" for role, text in lines)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(ordered)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def brute_damage(rows):
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        kept = found[conv_id]
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv_id: brute(kept) for conv_id, kept in found.items()}


def made(seed, conversations, longest):
    draw, rows = random.Random(seed), []
    roles = ["user", "assistant", "user", "assistant", "system", "u", "tool", "", None, "User"]
    texts = ["Fine.", "Cut off", "Why? \n", " \t", "", None, "Yes!", "No\x0b", "é.", ". "]
    for conv_id in range(conversations):
        for turn in range(draw.randint(1, longest)):
            turn = draw.choice([turn, turn, turn, turn + 2, None])
            rows.append((draw.choice([conv_id] * 30 + [None]), turn, draw.choice(roles), draw.choice(texts + [f"own {len(rows)}{draw.choice('.?x ')}"] * 20)))
    return rows


def summary(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def test_every_edit_of_short_conversations():
    draw = random.Random(1)
    for _ in range(60):
        rows = [(k, draw.choice(["user", "assistant", "system", "x"]), draw.choice(["a.", "b", "c?", f"{k}.", ""])) for k in range(draw.randint(0, 3))]
        assert searched(rows) == all_repairs(rows)


def test_block_tables_against_a_plain_search():
    draw = random.Random(2)
    symbol = {(f, i): 0 if f in ("blank", "duplicate") else 1 + "sua-".index(i) + 4 * (f == "truncated") for f in ("blank", "duplicate", "truncated", "") for i in "sua-"}
    for n in [*range(14), *(draw.randint(14, 200) for _ in range(60))]:
        rows = [(k, draw.choice(["user", "assistant", "system", "-"]), draw.choice([f"{k}.", f"{k}.", f"{k}", "", "again."])) for k in range(n)]
        symbols = bytes(symbol[f, role[0]] for f, (_, role, _) in zip(faults(rows), rows))
        cost, letters, lines = searched(rows)
        assert C.repair(symbols) == (cost, letters)
        assert [x[1:] for x in C.edited(letters, iter([(r, t, s) for (_, r, t), s in zip(rows, symbols)]), C.NOTHING)] == lines
    tables = C.block_tables()
    assert tables.block_before.shape == (len(tables.vectors), 9**C.BLOCK) and len(tables.vectors) < 200


@pytest.mark.parametrize("large", [None, 6])
def test_damage_and_repair(spark, monkeypatch, large):
    """Whole conversations in a task, and the same when longer ones are cut into segments."""
    if large is not None:
        monkeypatch.setattr(C, "LARGE_ROWS", large)
    rows = made(3, 80, 12) + made(4, 3, 150)
    frame = spark.createDataFrame([(*r, "p", "s", "y") for r in rows], SCHEMA).repartition(3)
    found = summary(C.repair_summary(C.with_damage(C.prepared(frame))))
    assert found == brute_damage(rows)
    lines = defaultdict(list)
    for r in C.repaired_rows(C.with_damage(C.prepared(frame))).orderBy("conv_id", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in found} == {c: row[-1] for c, row in found.items()}


def test_a_conversation_with_a_third_of_all_rows(spark, monkeypatch):
    """It is cut where rows are equal, too, and no task gets it whole."""
    monkeypatch.setattr(C, "LARGE_ROWS", 100)
    rows = [(7, None if k % 3 else k // 9, "user" if k % 2 else "assistant", f"t {k}." if k % 5 else "same.") for k in range(1500)]
    rows += [(7, None, "user", "equal rows.")] * 700 + [(100 + k, 0, "user", "Fine.") for k in range(500)]
    frame = spark.createDataFrame([(*r, "p", "s", "y") for r in rows], SCHEMA)
    segments = C._Segments(C._parted(C.prepared(frame))[1])
    sizes = [r.n for r in segments.rows.groupBy("conv_id", "segment").count().withColumnRenamed("count", "n").collect()]
    assert sum(sizes) == 2200 and max(sizes) < 1100
    found = summary(C.repair_summary(C.prepared(frame)))
    assert found[7] == brute([r[1:] for r in rows if r[0] == 7]) and len(found) == 501


def test_one_text_of_great_length_and_nothing(spark):
    long = "word " * 200_000
    frame = spark.createDataFrame([(1, 0, "user", long, "p", "s", "y"), (2, 0, "assistant", ".", "p", "s", "y")], SCHEMA)
    found = summary(C.repair_summary(C.prepared(frame)))
    assert found == {1: brute([(0, "user", long)]), 2: brute([(0, "assistant", ".")])}
    assert C.repair_summary(C.prepared(frame.limit(0))).count() == C.repaired_rows(C.prepared(frame.limit(0))).count() == 0


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert summary(C.op13_conversation_repair(spark, sf_dir)) == brute_damage(rows)
