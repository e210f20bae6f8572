"""Conversation structure repair (operator 13) by Four-Russians block tables.

A conversation's rows, in the order of their turns, are edited at least cost until the initials of its roles read
``(s?(ua)+)?``: a row is kept, gets the role user or assistant, or is deleted, and rows without text are inserted. What the cheapest edits
from a row on cost depends on the state before it only: nothing yet, after a system row, after a user, after an assistant. The
four costs, less their least, are one of few vectors, and a row is one of nine symbols. For every vector and every block of
``BLOCK`` symbols a table holds the vector before the block and what was subtracted, so that rows are taken a block at a time, from
the last to the first. The vectors at the blocks' ends are kept. The edits are then traced from the first row on: each block is
expanded backward into the vectors at its rows, by which the least letter among all cheapest edits is known. (Tracing along with a
forward search would compare audits that differ in length before they end, which is not safe among ties.)

Conversations are dealt by id and read in order, one at a time. Those of more than ``LARGE_ROWS`` rows or ``LARGE_BYTES`` of text are
cut into segments by ranges of turns: each segment gives its costs between any two states, these give the vectors at the segments'
ends and the states at their starts, and the segments are traced by themselves. Only the hash of such a conversation's
text is taken in one task, which reads the lines in order and holds none.

Defined cases: null roles and texts count as one space, rows with a null conv_id are one conversation, null turns come first and rows of equal turn
in the order of role and text; blank rows and rows seen earlier must go; repeated rows are duplicates; a conversation without rows has zeros and
nothing to repair; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wagerlens.llm.common import ASCII_SPACE, ship, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4
#: What a task holds of a conversation, and so the size of a segment.
LARGE_ROWS, LARGE_BYTES = 50_000, 32 << 20

#: States, and what a row of the role that must come next leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: a row that must go; then rows by initial (s, u, a, any other), and the same for truncated ones.
GOES, INITIALS = 0, "sua"
SYMBOLS = 9
#: Where a kept row of an initial leads, by state.
KEPT: tuple[tuple[int | None, ...], ...] = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
FAR = 1 << 40

Vector = tuple[int, ...]


def _with_inserts(costs: list[int]) -> Vector:
    for _ in range(3):
        costs = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
    return tuple(min(c, FAR) for c in costs)


#: Costs after the last row.
END: Vector = _with_inserts([0, FAR, FAR, 0])
ONLY: tuple[Vector, ...] = tuple(tuple(0 if s == end else FAR for s in range(4)) for end in range(4))


def _moves(after: Vector, symbol: int, state: int) -> dict[str, tuple[int, int]]:
    """The cost and the state that each edit of a row leads to, before any insertion."""
    found = {"D": (DELETE + after[state], state)}
    if symbol != GOES:
        initial, more = (symbol - 1) % 4, TRUNCATED * (symbol > 4)
        if (kept := KEPT[initial][state]) is not None:
            found["K"] = KEEP + more + after[kept], kept
        found["R"] = REROLE + more + after[NEXT[state]], NEXT[state]
    return found


def costs_before(after: Vector, symbol: int) -> Vector:
    return _with_inserts([min(cost for cost, _ in _moves(after, symbol, state).values()) for state in range(4)])


def normalised(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(FAR if c >= FAR // 2 else c - least for c in costs), least


class BlockTables:
    """All normalised vectors; by vector and symbol, and by vector and block: the vector before and the costs taken off; the edit of each state."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        for vector in (END, *ONLY):
            self._add(normalised(vector)[0])
        before, off, letters = [], [], []
        for vector in self.vectors:  # which grows until no step leads to a new one
            steps = [normalised(costs_before(vector, symbol)) for symbol in range(SYMBOLS)]
            before.append([self._add(found) for found, _ in steps])
            off.append([least for _, least in steps])
            letters.append([[self._letter(vector, symbol, state) for state in range(4)] for symbol in range(SYMBOLS)])
        self.before, self.off, self.letters = np.array(before), np.array(off), letters
        self.block_before, self.block_off, width = self.before, self.off, 1
        while width < BLOCK:  # a block's later symbols come first
            later, cost = self.block_before[:, None, :], self.block_off[:, None, :]
            first = np.arange(SYMBOLS)[None, :, None]
            self.block_before, self.block_off = self.before[later, first].reshape(len(before), -1), (cost + self.off[later, first]).reshape(len(before), -1)
            width += 1

    def _add(self, vector: Vector) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def _letter(after: Vector, symbol: int, state: int) -> tuple[str, int]:
        """The least letter of the cheapest edits at a row, and the state after it; after an insertion the same row comes again."""
        costs, moves = costs_before(after, symbol), _moves(after, symbol, state)
        moves["I"] = INSERT + costs[NEXT[state]], NEXT[state]
        best = min((letter for letter, (cost, _) in moves.items() if cost == costs[state]), default="D")
        return best, moves[best][1]


@cache
def block_tables() -> BlockTables:
    return BlockTables()


_POWERS = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def backward(symbols: bytes, vector: int) -> tuple[int, int, list[int]]:
    """The vector before a row of symbols, the costs taken off, and the vectors after its blocks (from the first; the odd rows come first)."""
    tables = block_tables()
    odd = len(symbols) % BLOCK
    blocks = np.frombuffer(symbols, np.uint8)[odd:].reshape(-1, BLOCK) @ _POWERS
    total, after = 0, []
    for block in blocks[::-1].tolist():
        after.append(vector)
        total += int(tables.block_off[vector, block])
        vector = int(tables.block_before[vector, block])
    after.append(vector)
    for symbol in symbols[:odd][::-1]:
        total += int(tables.off[vector, symbol])
        vector = int(tables.before[vector, symbol])
    return vector, total, after[::-1]


@lru_cache(1 << 16)
def expanded(vector: int, symbols: bytes, state: int) -> tuple[str, int]:
    """The letters of a block's edits and the state after it, from the vector after it."""
    tables = block_tables()
    after = [vector]
    for symbol in symbols[:0:-1]:
        after.append(int(tables.before[after[-1], symbol]))
    letters = []
    for symbol in symbols:
        at = after.pop()
        while True:
            letter, state = tables.letters[at][symbol][state]
            letters.append(letter)
            if letter != "I":
                break
    return "".join(letters), state


def traced(symbols: bytes, after: list[int], state: int) -> tuple[str, int]:
    """The letters of all edits of a row of symbols and the state after it, from what ``backward`` has kept."""
    odd, parts = len(symbols) % BLOCK, []
    cuts = [0, *range(odd, len(symbols) + 1, BLOCK)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            part, state = expanded(after[k], symbols[a:b], state)
            parts.append(part)
    return "".join(parts), state


def last_inserts(state: int) -> str:
    """The insertions after the last row."""
    return {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def repair(symbols: bytes) -> tuple[int, str]:
    """The least cost of a conversation and the letters of its edits, the least of all cheapest."""
    tables = block_tables()
    vector, total, after = backward(symbols, tables.number[END])
    letters, state = traced(symbols, after, NOTHING)
    return total + tables.vectors[vector][NOTHING], letters + last_inserts(state)


def edited(letters: str, rows: Iterator[tuple[str, str, int]], state: int) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the rows that edits leave or insert, from (role, text, symbol) of the rows as they were."""
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield letter, ROLE[state], ""
            continue
        role, text, symbol = next(rows)
        if letter == "R":
            state = NEXT[state]
            yield letter, ROLE[state], text
        elif letter == "K":
            state = KEPT[(symbol - 1) % 4][state]
            yield letter, role, text


LEGAL = {"su", "ua", "au"}


@dataclass
class Conversation:
    """The rows of a conversation, or of one segment of it, in order."""

    conv_id: object
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    symbols: bytearray = field(default_factory=bytearray)
    seen: set[tuple[str, str]] = field(default_factory=set)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0

    def add(self, turn: int | None, role: str, text: str, symbol: int, first: bool | None = None) -> None:
        """Take a row; ``symbol`` is 0 for blank rows. Without ``first`` a row is a duplicate if it was seen here."""
        if first is None:
            first = (role, text) not in self.seen
            self.seen.add((role, text))
        self.blank += symbol == GOES
        self.duplicate += symbol != GOES and not first
        symbol = symbol if first else GOES
        self.truncated += symbol > 4
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.symbols.append(symbol)

    def counts(self) -> tuple[int, int, int, int, int]:
        known = [turn for turn in self.turns if turn is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:]))
        return gaps, self.blank, self.duplicate, self.truncated, illegal

    def rows(self) -> Iterator[tuple[str, str, int]]:
        return iter(zip(self.roles, self.texts, self.symbols))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _symbol() -> Column:
    """A row's symbol, but for duplicates."""
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4))
    initial = F.when(F.col("role") == "", 4).otherwise(initial)
    ended = F.col("text").rlike(f"[.!?][{ASCII_SPACE}]*\\z")
    return F.when(~F.col("text").rlike(f"[^{ASCII_SPACE}]"), GOES).when(ended, initial).otherwise(initial + 4).cast("int")


def prepared(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times) of a frame: ``times`` is how often a row stands there."""
    ship(conversations.sparkSession)
    given = [F.col(f"`{c}`") for c in (conv, turn, role, text)]
    blank = [F.coalesce(c.cast("string"), F.lit(" ")) for c in given[2:]]
    return conversations.select(given[0].alias("conv_id"), given[1].cast("long").alias("turn"), blank[0].alias("role"), blank[1].alias("text"), F.lit(1).alias("times"))


def with_damage(rows: DataFrame) -> DataFrame:
    """``prepared`` rows after the damage of the registered query; dropped rows stand there no times."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _large(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.octet_length("text")).alias("size"))
    return written(sizes.filter(f"n > {LARGE_ROWS} or size > {LARGE_BYTES}").select("conv_id", F.lit(True).alias("large")))


_ORDER = ["turn", "role", "text"]  # nulls come first


_LINE = {"place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
_SUMMARY = {**{c: pa.int64() for c in _COUNTS}, "audit": pa.string(), "repaired_sha256": pa.string()}


def _types(kind: str, columns: dict[str, pa.DataType]) -> str:
    return f"conv_id {kind}, " + ", ".join(f"{name} {'long' if type_ == pa.int64() else 'string'}" for name, type_ in columns.items())


def _held(rows: DataFrame, as_rows: bool) -> DataFrame:
    """The conversations that fit a task's memory, one after the other."""
    columns = _LINE if as_rows else _SUMMARY
    ordered = rows.withColumn("symbol", _symbol()).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)

    def finished(one: Conversation) -> Iterator[tuple]:
        cost, letters = repair(bytes(one.symbols))
        lines = edited(letters, one.rows(), NOTHING)
        if as_rows:
            yield from ((one.conv_id, place, *line) for place, line in enumerate(lines))
        else:
            text = "\n".join(f"{role}:{text}" for _, role, text in lines)
            yield one.conv_id, *one.counts(), cost, letters, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        found = (row for one in _conversations(batches, kinds) for row in finished(one))
        while some := list(islice(found, 1000)):
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*some), (kinds[0], *columns.values()))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *columns])

    return ordered.mapInArrow(repaired, _types(rows.schema["conv_id"].dataType.simpleString(), columns))


def _conversations(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[Conversation]:
    """The conversations of ordered rows; ``kinds`` gets the type of their ids."""
    current = None
    for batch in batches:
        kinds.append(batch["conv_id"].type)
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            for conv_id, turn, role, text, times, symbol in zip(*(part[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "symbol"))):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        yield current
                    current = Conversation(conv_id)
                for _ in range(times):
                    current.add(turn, role, text, symbol)
    if current is not None:
        yield current


class _Segments:
    """The large conversations: segments of rows by ranges of turns, and what each gives."""

    def __init__(self, rows: DataFrame):
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        # Written first, so that the places which part equal rows are the same in every attempt.
        single = written(rows.withColumn("copy", F.explode(F.expr("array_repeat(0, times)"))).withColumn("symbol", _symbol()).drop("copy", "times"))
        single = single.withColumn("tie", F.monotonically_increasing_id())
        rows, size = single.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        segments = 1 + max(rows // LARGE_ROWS, (size or 0) // LARGE_BYTES)
        ordered = single.repartitionByRange(segments, "conv_id", *_ORDER, "tie").sortWithinPartitions("conv_id", *_ORDER, "tie")
        rows = written(ordered.drop("tie").withColumn("place", F.monotonically_increasing_id()))
        first = rows.groupBy("conv_id", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("same")).agg(F.min("place").alias("place"))
        marked = rows.join(first.select("place", F.lit(True).alias("first")), "place", "left").withColumn("first", F.coalesce("first", F.lit(False)))
        self.rows = written(marked.withColumn("segment", F.shiftright("place", 33)))
        narrow = self.rows.select("conv_id", "segment", "place", "turn", F.substring("role", 1, 1).alias("role"), F.lit("").alias("text"), "symbol", "first")
        self.symbols = written(narrow.groupBy("conv_id", "segment").applyInArrow(self._summed, f"conv_id {self.kind}, segment long, {self._SUMS}"))
        ends = self.symbols.drop("symbols").groupBy("conv_id").applyInArrow(self._vectors, f"conv_id {self.kind}, segment long, vector int")
        ends = ends.toDF("of", "part", "vector")
        both = self.symbols.join(ends, F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("part") == F.col("segment"))).select("conv_id", "segment", "symbols", "vector")
        self.traces = written(both.mapInArrow(self._traced, f"conv_id {self.kind}, segment long, audits array<string>, states array<int>"))

    _SUMS = "symbols binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_role string, last_role string"

    @staticmethod
    def _segment(group: pa.Table) -> Conversation:
        one = Conversation(group["conv_id"][0].as_py())
        for row in group.sort_by("place").select(["turn", "role", "text", "symbol", "first"]).to_pylist():
            one.add(**row)
        return one

    @staticmethod
    def _summed(group: pa.Table) -> pa.Table:
        one, tables = _Segments._segment(group), block_tables()
        symbols, costs = bytes(one.symbols), []
        for end in range(4):
            vector, total, _ = backward(symbols, tables.number[ONLY[end]])
            costs.append([min(FAR, total + c) for c in tables.vectors[vector]])
        known = [turn for turn in one.turns if turn is not None]
        _, blank, duplicate, truncated, illegal = one.counts()
        return pa.table({
            "conv_id": group["conv_id"].slice(0, 1), "segment": group["segment"].slice(0, 1), "symbols": pa.array([symbols], pa.binary()),
            "costs": pa.array([[costs[end][state] for state in range(4) for end in range(4)]], pa.list_(pa.int64())),
            "blank": [blank], "duplicate": [duplicate], "truncated": [truncated], "illegal": [illegal],
            "low": pa.array([min(known, default=None)], pa.int64()), "high": pa.array([max(known, default=None)], pa.int64()), "turns": [len(set(known))],
            "first_role": [one.roles[0]], "last_role": [one.roles[-1]],
        })

    @staticmethod
    def _vectors(group: pa.Table) -> pa.Table:
        """The vector after each segment, from the last to the first."""
        tables = block_tables()
        ordered = group.sort_by([("segment", "descending")])
        vector, found = END, []
        for costs in ordered["costs"].to_pylist():
            vector = normalised(vector)[0]
            found.append(tables.number[vector])
            vector = tuple(min(costs[4 * state + end] + vector[end] for end in range(4)) for state in range(4))
        return pa.table({"conv_id": ordered["conv_id"], "segment": ordered["segment"], "vector": pa.array(found, pa.int32())})

    @staticmethod
    def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The letters of a segment and the state after it, for each state that it may start in."""
        for batch in batches:
            for k in range(batch.num_rows):
                symbols, vector = batch["symbols"][k].as_py(), batch["vector"][k].as_py()
                after = backward(symbols, vector)[2]
                audits, states = zip(*(traced(symbols, after, state) for state in range(4)))
                yield pa.RecordBatch.from_arrays([batch["conv_id"][k : k + 1], batch["segment"][k : k + 1], pa.array([list(audits)]), pa.array([list(states)], pa.list_(pa.int32()))], ["conv_id", "segment", "audits", "states"])

    def starts(self) -> DataFrame:
        """(conv_id, segment, state, audit): the state before each segment and its letters, with the last insertions."""

        def chained(group: pa.Table) -> pa.Table:
            ordered = group.sort_by("segment")
            state, states, audits = NOTHING, [], []
            for audit, after in zip(ordered["audits"].to_pylist(), ordered["states"].to_pylist()):
                states.append(state)
                audits.append(audit[state])
                state = after[state]
            audits[-1] += last_inserts(state)
            return pa.table({"conv_id": ordered["conv_id"], "segment": ordered["segment"], "state": pa.array(states, pa.int32()), "audit": audits})

        return written(self.traces.groupBy("conv_id").applyInArrow(chained, f"conv_id {self.kind}, segment long, state int, audit string"))

    def lines(self, starts: DataFrame) -> DataFrame:
        """(conv_id, place, edit, role, text) of the repaired rows; places rise within a conversation."""

        def of_segment(key: tuple, group: pa.Table, chosen: pa.Table) -> pa.Table:
            one, first = _Segments._segment(group), group["segment"][0].as_py() << 33
            found = list(edited(chosen["audit"][0].as_py(), one.rows(), chosen["state"][0].as_py()))
            columns = [pa.array([line[k] for line in found], pa.string()) for k in range(3)]
            ids = pa.repeat(group["conv_id"][0], len(found))
            return pa.table([ids, pa.array(range(first, first + len(found)), pa.int64()), *columns], ["conv_id", "place", "edit", "role", "text"])

        return self.rows.groupBy("conv_id", "segment").cogroup(starts.groupBy("conv_id", "segment")).applyInArrow(of_segment, _types(self.kind, _LINE))

    def summary(self) -> DataFrame:
        starts = self.starts()

        def added(group: pa.Table) -> pa.Table:
            ordered = group.sort_by("segment")
            rows = ordered.drop_columns(["conv_id", "costs"]).to_pylist()
            known = [row for row in rows if row["turns"]]
            shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
            gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(row["turns"] for row in known) + shared if known else 0
            illegal = sum(row["illegal"] for row in rows) + sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(rows, rows[1:]))
            vector, tables = END, block_tables()
            for costs in ordered["costs"].to_pylist()[::-1]:
                vector = tuple(min(costs[4 * state + end] + vector[end] for end in range(4)) for state in range(4))
            sums = {c: [sum(row[c] for row in rows)] for c in ("blank", "duplicate", "truncated")}
            return pa.table({"conv_id": ordered["conv_id"].slice(0, 1), "gaps": [gaps], **sums, "illegal": [illegal], "cost": [vector[NOTHING]]})

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest, current, kind = None, None, None

            def last() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()])], ["of", "hash"])

            for batch in batches:
                kind = batch["conv_id"].type
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    for conv_id, role, text in zip(*(part[c].to_pylist() for c in ("conv_id", "role", "text"))):
                        if digest is None or conv_id != current:
                            if digest is not None:
                                yield last()
                            digest, current = hashlib.sha256(), conv_id
                        else:
                            digest.update(b"\n")
                        digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if digest is not None:
                yield last()

        counts = self.symbols.drop("symbols").groupBy("conv_id").applyInArrow(added, f"conv_id {self.kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
        audits = starts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x.audit), "").alias("audit"))
        ordered = self.lines(starts).repartition("conv_id").sortWithinPartitions("conv_id", "place")
        hashes = written(ordered.mapInArrow(hashed, f"of {self.kind}, hash string"))
        same = lambda left, right, how: left.join(right, F.col("conv_id").eqNullSafe(F.col("of")), how).drop("of")
        found = same(same(counts, audits.withColumnRenamed("conv_id", "of"), "left"), hashes, "left")
        return found.select("conv_id", *_COUNTS, "audit", F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations that fit a task's memory, and those of larger ones, if there are any."""
    large = _large(rows)
    if large.isEmpty():
        return rows, None
    marked = rows.join(large.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return marked.filter("large is null").drop("large"), marked.filter("large").drop("large")


def repair_summary(rows: DataFrame) -> DataFrame:
    """For ``prepared`` rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    held, large = _parted(rows)
    found = _held(held, False)
    return found if large is None else found.union(_Segments(large).summary())


def repaired_rows(rows: DataFrame) -> DataFrame:
    """For ``prepared`` rows: conv_id, place (rising within a conversation), edit (K, R or I), role, text of the repaired conversations."""
    held, large = _parted(rows)
    found = _held(held, True)
    if large is None:
        return found
    segments = _Segments(large)
    return found.union(segments.lines(segments.starts()))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair_summary(with_damage(prepared(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT)),
           lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]))) % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(i)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
faulty AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         substr(role, 1, 1) || lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS pair,
         max(place) OVER (PARTITION BY conv_id) - place AS behind
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(behind) AS last
  FROM faulty GROUP BY conv_id),
before AS (
  -- The cheapest repair from a row on, least letters first, after nothing (e), a system row (s), a user (u) and an assistant (a).
  SELECT conv_id, -1::BIGINT AS behind, {'c': 0, 'l': '', 't': ''} AS e, {'c': 6, 'l': 'II', 't': E'user:\nassistant:\n'} AS s,
         {'c': 3, 'l': 'I', 't': E'assistant:\n'} AS u, {'c': 0, 'l': '', 't': ''} AS a
  FROM counted
  UNION ALL
  SELECT conv_id, behind, list_min([e0, {'c': u1.c + 3, 'l': 'I' || u1.l, 't': E'user:\n' || u1.t}]), list_min([s0, {'c': u1.c + 3, 'l': 'I' || u1.l, 't': E'user:\n' || u1.t}]), u1, a1
  FROM (
    SELECT conv_id, behind, e0, s0,
           list_min([u0, {'c': a0.c + 3, 'l': 'I' || a0.l, 't': E'assistant:\n' || a0.t}]) AS u1,
           list_min([a0, {'c': u0.c + 3, 'l': 'I' || u0.l, 't': E'user:\n' || u0.t}]) AS a1
    FROM (
      SELECT conv_id, behind,
             list_min(list_filter([ed, CASE WHEN initial = 's' THEN sk WHEN initial = 'u' THEN uk END, ur], lambda x: x IS NOT NULL)) AS e0,
             list_min(list_filter([sd, CASE WHEN initial = 'u' THEN uk END, ur], lambda x: x IS NOT NULL)) AS s0,
             list_min(list_filter([ud, CASE WHEN initial = 'a' THEN ak END, ar], lambda x: x IS NOT NULL)) AS u0,
             list_min(list_filter([ad, CASE WHEN initial = 'u' THEN uk END, ur], lambda x: x IS NOT NULL)) AS a0
      FROM (
        SELECT b.conv_id, f.behind, initial,
               {'c': e.c + 4, 'l': 'D' || e.l, 't': e.t} AS ed, {'c': s.c + 4, 'l': 'D' || s.l, 't': s.t} AS sd,
               {'c': u.c + 4, 'l': 'D' || u.l, 't': u.t} AS ud, {'c': a.c + 4, 'l': 'D' || a.l, 't': a.t} AS ad,
               CASE WHEN stays THEN {'c': s.c + more, 'l': 'K' || s.l, 't': role || ':' || text || E'\n' || s.t} END AS sk,
               CASE WHEN stays THEN {'c': u.c + more, 'l': 'K' || u.l, 't': role || ':' || text || E'\n' || u.t} END AS uk,
               CASE WHEN stays THEN {'c': a.c + more, 'l': 'K' || a.l, 't': role || ':' || text || E'\n' || a.t} END AS ak,
               CASE WHEN stays THEN {'c': u.c + more + 3, 'l': 'R' || u.l, 't': 'user:' || text || E'\n' || u.t} END AS ur,
               CASE WHEN stays THEN {'c': a.c + more + 3, 'l': 'R' || a.l, 't': 'assistant:' || text || E'\n' || a.t} END AS ar
        FROM before b
        JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faulty) f
          ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.behind = b.behind + 1)))),
whole AS (SELECT c.*, b.e FROM counted c JOIN before b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.behind = c.last)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.l, '') AS audit,
       sha256(CASE WHEN e.t IS NULL OR e.t = '' THEN '' ELSE substr(e.t, 1, length(e.t) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
