"""SentencePiece encoding and decoding (operator 9) by a streaming Viterbi search.

A model's pieces span a lattice over a text. The search keeps, for each place, the one survivor that ends there, with a
backpointer to where its last piece starts, from the last committed boundary on. Whenever all paths from the last ``longest`` positions (the
longest piece's length) go back to one boundary, the ids before it are final: they are emitted and forgotten, so that a text of any
length needs a window only. The model's kind says which path survives.

*Unigram*: the one with the greatest sum of scores, the first found of equals, a character without a piece at the least score less a
penalty. Sums are kept in single precision from the text's start, as the library does, or long texts would round otherwise.

*BPE*: such a model's encoding is not the path of greatest summed scores. It is, all the same, the one path through the lattice whose
neighbours are all *stable*: merging the two side by side, the best pair first, ends in the two again. So each position has one
survivor, the piece that is stable after the survivor where it starts, found among the pieces that end there.

Where no piece of a BPE model has a word mark inside, all paths converge before each run of word marks; texts are
cut there, and the ids of short cuts are kept in a bounded memo. New ones are cut further where two characters stand side by side in no piece. An encoder lives as long as its worker process.

Defined cases: null and empty texts have no ids; characters without a piece are their UTF-8 bytes' pieces, or the unknown piece,
once for several in a row, if the model has no byte pieces; decoding drops the leading space that encoding adds and turns broken UTF-8 into U+FFFD; a
word mark (U+2581) in a text decodes as a space, so such texts do not round-trip; every given row gives one row; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.bpe_count import Memo
from wagerlens.llm.common import resident, table, texts, version

MAX_PIECES = 1_000_000
MEMO_ENTRIES, MEMO_LENGTH = 250_000, 48
#: Pairs of units that a worker remembers as stable or not.
DECIDED = 1_000_000
MARK = "▁"

# Fixed values of the model files: kinds of models and of pieces, and how far below the least score an unknown character lies.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """A model as plain data: ids and ranks (0 first) of pieces, the two halves of each stable piece's last merge."""

    ids: dict[str, int]
    ranks: dict[str, float]
    halves: dict[str, tuple[str, str]]
    byte_ids: tuple[int, ...]
    unknown: int
    longest: int
    cut_at_marks: bool
    #: What each id decodes to.
    bytes_of_id: tuple[bytes, ...]
    #: Scores of pieces and of an unknown character; None for a BPE model.
    scores: dict[str, float] | None = None
    unknown_score: float = 0.0


def merge_all(text: str, ranks: dict[str, float]) -> list[tuple[str, str]]:
    """The merges of a short text, lowest rank first and then leftmost, in order; what is left is not returned."""
    symbol: list[str | None] = list(text)
    after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap = [(ranks[a + b], i, a, b) for i, (a, b) in enumerate(pairwise(text)) if a + b in ranks]
    heapify(heap)
    merges = []
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if symbol[i] != a or j >= len(text) or symbol[j] != b:
            continue
        merges.append((a, b))
        symbol[i], symbol[j], after[i] = a + b, None, after[j]
        if after[i] < len(text):
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else len(text)
            if right < len(text) and (rank := ranks.get(symbol[left] + symbol[right])) is not None:
                heappush(heap, (rank, left, symbol[left], symbol[right]))
    return merges


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message: number and value, bytes for texts and messages."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at : at + size]
            at += size


def read_pieces(path: str) -> Pieces:
    """Read a ``.model`` file of the BPE or the unigram kind with identity normalisation; what else it may ask for is refused on a sample."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    if size > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    text, scores, types, kind = [], [], [], UNIGRAM
    for field, value in _fields(model.serialized_model_proto()):
        if field == 1:
            given = dict(_fields(value))
            text.append(given[1].decode())
            scores.append(float(np.frombuffer(given[2], np.float32)[0]) if 2 in given else 0.0)
            types.append(given.get(3, NORMAL))
        elif field == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or USER_DEFINED in types:
        raise ValueError("only unigram and BPE models without pieces of a user's own are supported")
    byte_ids = {int(text[i][3:5], 16): i for i in range(size) if types[i] == BYTE}
    plain = [i for i in range(size) if types[i] == NORMAL]
    ids = {text[i]: i for i in plain}
    if model.encode(" ﬁ  x", out_type=str)[0][:1] != MARK or model.decode(model.encode("a  ")) != "a  ":
        raise ValueError("only models with a leading mark and identity normalisation are supported")
    ranks, halves = {}, {}
    if kind == BPE:
        ranks = {text[i]: -scores[i] for i in plain}
        for piece in ids:
            if len(piece) > 1 and (merges := merge_all(piece, ranks)) and "".join(merges[-1]) == piece:
                halves[piece] = merges[-1]
    decoded = [
        bytes([int(text[i][3:5], 16)]) if types[i] == BYTE else b"" if types[i] == CONTROL else " ⁇ ".encode() if types[i] == UNKNOWN else text[i].replace(MARK, " ").encode()
        for i in range(size)
    ]
    least = min((scores[i] for i in plain), default=0.0)
    found = Pieces(
        ids, ranks, halves, tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (), model.unk_id(),
        max(map(len, ids if kind == UNIGRAM else halves), default=1), not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in ids), tuple(decoded),
        {text[i]: scores[i] for i in plain} if kind == UNIGRAM else None, float(np.float32(np.float32(least) - np.float32(UNKNOWN_PENALTY))),
    )
    sample = " ".join(piece.replace(MARK, " ") + other for piece, other in zip(list(ids)[:500], reversed(list(ids)))) + " ﬁ  ①\u3000é"
    if np.frombuffer(encoder(found)(sample), np.int32).tolist() != model.encode(sample):
        raise ValueError("the model asks for more than its pieces say, such as another normalisation")
    return found


def stable(left: str, right: str, pieces: Pieces) -> bool:
    """Whether merging ``left + right`` never merges across the border.

    The merges are undone from the last one: at each moment the two symbols at the border are known, and a merge of them must not
    come before the merges already undone. Equal ranks merge leftmost first, so a merge at the border comes before an
    equal one on its right and after one on its left.
    """
    ranks, halves = pieces.ranks, pieces.halves
    # The border's merge must come before this (rank, place): places are 0 left of the border, 1 on it, 2 right of it.
    limit = (float("inf"), 1)
    while True:
        across = ranks.get(left + right)
        if across is not None and (across, 1) < limit:
            return False
        last_left = (ranks[left], 0) if left in halves else (-1.0, 0)
        last_right = (ranks[right], 2) if right in halves else (-1.0, 2)
        if last_left[0] < 0 and last_right[0] < 0:
            return True
        if last_left > last_right:
            limit, left = last_left, halves[left][1]
        else:
            limit, right = last_right, halves[right][0]


class Lattice:
    """The units of a model (its characters and stable pieces) numbered, to be found backwards from where they end.

    A node is a pair: where the character before leads, and the unit that the characters on the way to it spell, or -1. Whether two units are stable side by side is decided once and kept in a bounded table.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.units = [piece for piece in pieces.ids if len(piece) == 1 or piece in pieces.halves]
        self.root: list = [{}, -1]
        for number, unit in enumerate(self.units):
            node = self.root
            for char in reversed(unit):
                node = node[0].setdefault(char, [{}, -1])
            node[1] = number
        self.decided: list[dict[int, bool]] = [{} for _ in self.units]
        self.held = 0

    def decide(self, left: int, right: int) -> bool:
        self.held += 1
        if self.held > DECIDED:
            for known in self.decided:
                known.clear()
            self.held = 1
        found = self.decided[left][right] = stable(self.units[left], self.units[right], self.pieces)
        return found

    def committed(self, text: str) -> Iterator[list[tuple[int, int]]]:
        """The (unit, start) of a text, in lists that are emitted as soon as all surviving paths agree on them.

        A character that no piece has is unit -1; nothing merges with it.
        """
        root, decided = self.root[0], self.decided
        window = 4 * self.pieces.longest
        done, before = 0, -1
        starts: list[int] = []  # where the survivor at each position after ``done`` starts, and which unit it is
        units: list[int] = []
        for end in range(1, len(text) + 1):
            leads, start = root, end
            while start > done:
                node = leads.get(text[start - 1])
                if node is None:
                    start, unit = end - 1, -1
                    break
                start -= 1
                leads, unit = node
                if unit >= 0:  # just one of them is stable
                    left = units[start - done - 1] if start > done else before
                    if left < 0:
                        break
                    ok = decided[left].get(unit)
                    if ok or ok is None and self.decide(left, unit):
                        break
            else:
                start, unit = end - 1, -1
            starts.append(start)
            units.append(unit)
            if len(starts) >= window:
                boundary = _converged(starts, done, range(end - self.pieces.longest + 1, end + 1))
                if boundary > done:
                    yield _trace(starts, units, done, boundary)
                    before = units[boundary - done - 1]
                    starts, units, done = starts[boundary - done :], units[boundary - done :], boundary
        if done < len(text):
            yield _trace(starts, units, done, len(text))


def _converged(starts: list[int], done: int, positions: Iterable[int]) -> int:
    """The boundary to which all paths from some positions go back."""
    ends = set(positions)
    while len(ends) > 1:  # go back from the last of them until one is left
        late = max(ends)
        ends.remove(late)
        ends.add(starts[late - done - 1] if late > done else done)
    return ends.pop()


def _trace(starts: list[int], units: list[int], done: int, end: int) -> list[tuple[int, int]]:
    found = []
    while end > done:
        place = end - done - 1
        end = starts[place]
        found.append((units[place], end))
    return found[::-1]


class ScoreLattice:
    """The pieces of a unigram model by a trie over their characters; ``committed`` as in ``Lattice``."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.units = list(pieces.scores)
        self.root: dict = {}
        for number, unit in enumerate(self.units):
            node = self.root
            for char in unit:
                node = node.setdefault(char, {})
            node[0] = number, pieces.scores[unit]

    def committed(self, text: str) -> Iterator[list[tuple[int, int]]]:
        root, unknown = self.root, self.pieces.unknown_score
        longest, size, single = self.pieces.longest, len(text), struct.Struct("f")
        window = 4 * longest
        done = 0
        # For each position after ``done``: where its survivor starts, which unit it is, and the sum; -1 where nothing ends yet.
        starts: list[int] = []
        units: list[int] = []
        sums: list[float] = []
        so_far = 0.0
        for start in range(size):
            if start > done:
                so_far = sums[start - done - 1]
            node, end, alone = root, start, False
            while end < size:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                if end - done > len(starts):
                    starts.append(-1)
                    units.append(-1)
                    sums.append(0.0)
                if 0 in node:
                    unit, score = node[0]
                    place, total = end - done - 1, single.unpack(single.pack(score + so_far))[0]
                    if starts[place] < 0 or total > sums[place]:
                        starts[place], units[place], sums[place] = start, unit, total
                    alone = alone or end == start + 1
            if not alone:
                if start + 1 - done > len(starts):
                    starts.append(-1)
                    units.append(-1)
                    sums.append(0.0)
                place, total = start - done, single.unpack(single.pack(unknown + so_far))[0]
                if starts[place] < 0 or total > sums[place]:
                    starts[place], units[place], sums[place] = start, -1, total
            if start + 1 - done >= window:
                # Paths that go on leave from here or from a position behind it where something ends.
                live = [start + 1] + [done + k + 1 for k in range(start + 1 - done, len(starts)) if starts[k] >= 0]
                boundary = _converged(starts, done, live)
                if boundary > done:
                    yield _trace(starts, units, done, boundary)
                    so_far = sums[boundary - done - 1]
                    starts, units, sums, done = starts[boundary - done :], units[boundary - done :], sums[boundary - done :], boundary
        if done < size:
            yield _trace(starts, units, done, size)


def encoder(pieces: Pieces) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit integers."""
    lattice = Lattice(pieces) if pieces.scores is None else ScoreLattice(pieces)
    id_bytes = [np.int32(pieces.ids[unit]).tobytes() for unit in lattice.units]

    def unknown(char: str) -> bytes:
        given = [pieces.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if pieces.byte_ids else [pieces.unknown]
        return np.array(given, np.int32).tobytes()

    def encode(part: str) -> bytes:
        return b"".join(id_bytes[unit] if unit >= 0 else unknown(part[start]) for found in lattice.committed(part) for unit, start in found)

    # No merge crosses two characters that stand side by side in no piece, so what they part is encoded apart.
    inside = {piece[k : k + 2] for piece in pieces.ids for k in range(len(piece) - 1)}

    def parted(part: str) -> bytes:
        cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in inside]
        if not cuts:
            return encode(part)
        return b"".join([memo[part[a:b]] for a, b in zip([0, *cuts], [*cuts, len(part)])])

    memo = Memo(parted, MEMO_ENTRIES, MEMO_LENGTH)
    cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if pieces.cut_at_marks else lambda text: [text]
    double = MARK + MARK

    def ids(text: str) -> bytes:
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if pieces.cut_at_marks and double not in marked:
            return b"".join(map(memo.__getitem__, [MARK + word for word in marked[1:].split(MARK)]))
        return b"".join(map(memo.__getitem__, cut(marked)))

    def scored(text: str) -> bytes:
        return encode(MARK + text.replace(" ", MARK)) if text else b""

    whole = ids if pieces.scores is None else scored
    return whole if pieces.byte_ids else lambda text: _once(whole(text), pieces.unknown)


def _once(found: bytes, unknown: int) -> bytes:
    """Ids with one unknown piece for several in a row."""
    ids = np.frombuffer(found, np.int32)
    again = (ids[1:] == unknown) & (ids[:-1] == unknown)
    return np.delete(ids, np.flatnonzero(again) + 1).tobytes() if again.any() else found


def encode_pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, ids (array<int>) of every row."""
    rows = texts(docs, id_column, text_column)
    model, name = docs.sparkSession.sparkContext.broadcast(read_pieces(path)), version("pieces", path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = resident(name, lambda: encoder(model.value))
        for batch in batches:
            found = [ids_of(text or "") for text in batch["text"].to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int64)
            flat = np.frombuffer(b"".join(found), np.int32)
            # Pieces of at most 32-bit offsets, so that long batches fit an Arrow list.
            start = 0
            while start < len(found):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 24), side="right")) - 1)
                lists = pa.ListArray.from_arrays(pa.array((ends[start : stop + 1] - ends[start]).astype(np.int32)), pa.array(flat[ends[start] : ends[stop]]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][start:stop], batch["text"][start:stop], lists], ["doc_id", "text", "ids"])
                start = stop

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encoded, f"doc_id {kind}, text string, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, ids_column: str = "ids", keep: tuple[str, ...] = ("doc_id", "text", "ids")) -> DataFrame:
    """``keep`` and ``decoded``, the text of the ids; null ids give an empty text, ids outside the model fail."""
    model = encoded.sparkSession.sparkContext.broadcast(read_pieces(path))
    rows = encoded.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids_column}`").cast("array<int>").alias("_ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(model.value.bytes_of_id, pa.large_binary())
        for batch in batches:
            column = batch.column(len(keep))
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            taken = pieces.take(column.flatten())
            # The pieces' bytes lie one after the other, so a row's text is one slice of them.
            places = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
            body = memoryview(taken.buffers()[2]) if len(taken) and taken.buffers()[2] else memoryview(b"")
            found = [bytes(body[places[a] : places[b]]).decode("utf-8", "replace").removeprefix(" ") for a, b in pairwise(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*keep, "decoded"])

    types = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(decoded, f"{types}, decoded string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash (xxhash64 of the ids), round_trip: whether decoding gives the text again."""
    both = decode_pieces(encode_pieces(docs, path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the public piece model of 32k."""
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
