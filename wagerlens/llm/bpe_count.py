"""Token counts (operator 6) by heap and linked list, without emitting identifiers.

A word's symbols start as its bytes, in a doubly linked list. A heap holds every adjacent
pair that has a rank; the lowest rank is popped (the leftmost first), the two symbols
become one, and the pairs it now forms are pushed. The count is symbols minus merges.

Texts are cut where the library's pre-tokenizer always cuts (before white space that follows
other text), and the counts of pieces seen are kept in a bounded memo, as long as its worker process lives (some 150 MB of it when full). A special string inside a text
counts as one token, as by the library's default. Vocabulary: the ``.json`` of a byte-level BPE, read
on the driver from a given path and broadcast; ``MAX_MERGES`` bounds its size.

Defined cases: null and empty texts have 0 tokens; very long words take n log n; every given
row gives one row; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wagerlens.llm.common import resident, table, texts, version

MAX_MERGES = 1_000_000
#: Entries of one generation of a worker's memo, and the longest key that is kept; longer pieces are counted each time.
MEMO_ENTRIES, MEMO_LENGTH = 200_000, 64

#: The pre-tokenizer's pattern and Unicode's White_Space. Fixed values.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_WORD = regex.compile(PRETOKEN.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))

@dataclass(frozen=True)
class Merges:
    """Symbols are numbered: bytes first, then merged strings. ``steps``: pair as left * 2**32 + right -> rank * 2**32 + merged symbol."""

    steps: dict[int, int]
    specials: tuple[str, ...]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def read_merges(path: str) -> Merges:
    """Ranked pairs and special strings of a byte-level BPE ``.json`` file."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    if given["model"]["type"] != "BPE" or given["pre_tokenizer"]["type"] != "ByteLevel" or given["model"]["ignore_merges"]:
        raise ValueError("not a byte-level BPE with merges")
    if given["pre_tokenizer"]["add_prefix_space"] or given["normalizer"]:
        raise ValueError("prefix spaces and normalizers are not supported")
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in given["model"]["merges"]]
    if len(pairs) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    number = byte_letters()
    steps: dict[int, int] = {}
    for rank, (a, b) in enumerate(pairs):
        merged = number.setdefault(a + b, len(number))
        steps.setdefault(number[a] << 32 | number[b], rank << 32 | merged)
    return Merges(steps, tuple(x["content"] for x in given["added_tokens"] if x["special"]))


def merged_count(word: bytes, steps: dict[int, int]) -> int:
    """Symbols that are left of a word when no adjacent pair has a rank."""
    size = len(word)
    symbol = list(word)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    # Of the pair's left place: rank, place and merged symbol, ordered as the merges are.
    heap = []
    for i in range(size - 1):
        if (step := steps.get(symbol[i] << 32 | symbol[i + 1])) is not None:
            heap.append((step >> 32, i, step & 0xFFFFFFFF, symbol[i], symbol[i + 1]))
    heapify(heap)
    merges = 0
    while heap:
        _, left, merged, a, b = heappop(heap)
        right = after[left]
        if symbol[left] != a or right >= size or symbol[right] != b:
            continue  # one of the two has merged since
        symbol[left], symbol[right] = merged, -1
        merges += 1
        after[left] = follower = after[right]
        if follower < size:
            before[follower] = left
            if (step := steps.get(merged << 32 | symbol[follower])) is not None:
                heappush(heap, (step >> 32, left, step & 0xFFFFFFFF, merged, symbol[follower]))
        leader = before[left]
        if leader >= 0 and (step := steps.get(symbol[leader] << 32 | merged)) is not None:
            heappush(heap, (step >> 32, leader, step & 0xFFFFFFFF, symbol[leader], merged))
    return size - merges


class Memo(dict):
    """Values of keys seen of late, in two generations of at most ``entries``, so that a worker's memory is bounded."""

    def __init__(self, compute: Callable[[Any], Any], entries: int, longest: int = MEMO_LENGTH):
        self.compute, self.entries, self.longest, self.older = compute, entries, longest, {}

    def __missing__(self, key: Any) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def counter(merges: Merges) -> Callable[[str], int]:
    """A function that counts the tokens of one text."""
    words = Memo(lambda word: merged_count(word.encode("utf-8", "surrogatepass"), merges.steps), MEMO_ENTRIES)
    memo = Memo(lambda piece: sum(map(words.__getitem__, _WORD.findall(piece))), MEMO_ENTRIES)
    specials = merges.specials
    cut = regex.compile("|".join(regex.escape(x) for x in sorted(specials, key=len, reverse=True))) if specials else None

    def count(text: str) -> int:
        if cut is None or not any(x in text for x in specials):
            return sum(map(memo.__getitem__, _PIECE.findall(text)))
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(memo.__getitem__, _PIECE.findall(part))) for part in parts)

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = texts(docs, id_column, text_column)
    vocabulary, name = docs.sparkSession.sparkContext.broadcast(read_merges(path)), version("merges", path)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = resident(name, lambda: counter(vocabulary.value))
        for batch in batches:
            given = [text or "" for text in batch["text"].to_pylist()]
            n_bytes = [len(text.encode("utf-8", "surrogatepass")) for text in given]
            n_tokens = [count(text) for text in given]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the public byte-level vocabulary of 50k."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
