"""Benchmark decontamination (operator 11) by one Aho-Corasick automaton over the benchmark's windows.

Texts are normalised to words: A-Z in lower case, and everything but digits, letters and non-ASCII characters
parts words. Each test question or answer gives its windows of ``WINDOW`` consecutive words, a shorter one itself whole. All
windows, as text between single spaces, form one automaton, which reads each document's words once, joined in the same
way. It reports every window that ends at a place, so overlapping windows and windows within others are all found. A match's place
gives its words, and the words their places in the original: normalisation keeps each byte's place, so spans refer to the text as given.

The automaton goes to all executors, so the windows in it are bounded by ``AUTOMATON_BYTES``. Larger benchmarks are cut into
blocks by a hash of the window, each an automaton for one more scan; what the scans find is joined by a hash of the text.

Defined cases: null texts and texts without words have no words and no hits; items without words have no windows; items of one id
are one item; an item without id marks words but is not listed; every given row gives one row; no documents give no rows and no items no hits;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.common import resident, ship, table, texts, written

WINDOW = 10
#: Bytes of distinct windows in one automaton, whose nodes take some sixty times as much.
AUTOMATON_BYTES = 4 << 20

#: What each byte of a text stands for: word characters for themselves, A-Z in lower case, others for a space.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: First and last word of a match, and the item (null for items without id).
HIT = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("item_id", pa.string())])
Hit = tuple[int, int, str | None]


def joined(words: list[bytes]) -> str:
    """Words between single spaces, one character a byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def item_windows(raw: bytes | None, window: int = WINDOW) -> set[bytes]:
    words = (raw or b"").translate(FOLD).split()
    return {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else set()


class Automaton:
    """The windows of a block and the items that have them."""

    def __init__(self, windows: list[tuple[bytes, list[str], bool]]):
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.items: list[list[str | None]] = []
        self.sizes: list[int] = []
        for window, items, nameless in windows:
            self.machine.add_word(joined([window]), len(self.items))
            self.items.append([*items, None] if nameless else items)
            self.sizes.append(window.count(b" ") + 1)
        if windows:
            self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> list[Hit]:
        """Every occurrence of every window in a text's words."""
        if not words or not self.items:
            return []
        text = joined(words)
        matches = list(self.machine.iter(text))
        if not matches:
            return []
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
        last = np.searchsorted(spaces, [end for end, _ in matches]) - 1
        return [(int(k) - self.sizes[number] + 1, int(k), item) for k, (_, number) in zip(last, matches) for item in self.items[number]]


def spans_of(raw: bytes, hits: list[Hit]) -> list[tuple[str | None, int, int]]:
    """(item, start, end) of the longest stretches of words that an item's windows cover, in characters of the given text."""
    is_word = np.frombuffer(raw.translate(FOLD), np.uint8) != 0x20
    edges = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    letters = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    starts, ends = letters[np.flatnonzero(edges == 1)], letters[np.flatnonzero(edges == -1)]
    by_item: dict[str | None, list[list[int]]] = defaultdict(list)
    for first, last, item in sorted(hits, key=lambda hit: hit[:2]):
        stretches = by_item[item]
        if stretches and first <= stretches[-1][1] + 1:
            stretches[-1][1] = max(stretches[-1][1], last)
        else:
            stretches.append([first, last])
    return [(item, int(starts[a]), int(ends[b])) for item, stretches in sorted(by_item.items(), key=lambda x: (x[0] is None, x[0] or "")) for a, b in stretches]


def _judged(raw: bytes | None, n_words: int, hits: list[Hit]) -> tuple:
    """n_words, n_hit, items, spans of a text."""
    if not hits:
        return n_words, 0, [], []
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, [first for first, _, _ in hits], 1)
    np.add.at(edge, [last + 1 for _, last, _ in hits], -1)
    items = sorted({item for _, _, item in hits if item is not None}, key=str.encode)
    return n_words, int((np.cumsum(edge) > 0).sum()), items, spans_of(raw, hits)


_SPAN = pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(_SPAN)}


def _frame(doc_ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(_TYPES.values())]
    return pa.RecordBatch.from_arrays([doc_ids, *arrays], ["doc_id", *_TYPES])


def windows_of(items: DataFrame, id_column: str, text_columns: tuple[str, ...], window: int) -> DataFrame:
    """(window, items, nameless): the distinct windows of all texts, the ids that have them, and whether an item without id does."""
    ship(items.sparkSession)
    one = [items.select(F.col(f"`{id_column}`").cast("string").alias("item"), F.col(f"`{c}`").cast("string").cast("binary").alias("text")) for c in text_columns]
    rows = one[0]
    for more in one[1:]:
        rows = rows.union(more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"]):
                found = sorted(item_windows(text.as_py(), window))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    cut_rows = rows.mapInArrow(cut, "item string, window binary")
    return cut_rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull()).alias("nameless"))


def find_benchmark(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_texts: tuple[str, ...] = ("text",),
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside windows), items (ids as strings, ordered), spans (item_id, start, end in the given text) of every row."""
    rows = texts(docs, id_column, text_column).withColumn("text", F.col("text").cast("binary"))
    context, kind, name = docs.sparkSession.sparkContext, rows.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex
    windows = written(windows_of(items, item_column, item_texts, window))
    size = windows.agg(F.sum(F.length("window") + F.size("items"))).first()[0] or 0
    blocks = max(1, -(-size // AUTOMATON_BYTES))
    result = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<item_id string, start long, end long>>"

    def block(number: int):
        """A block's windows, which are bounded, for all executors."""
        chosen = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number)
        return context.broadcast([(bytes(row.window), list(row["items"]), row.nameless) for row in chosen.collect()])

    if blocks == 1:
        only = block(0)

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = resident(name, lambda: Automaton(only.value))
            for batch in batches:
                found = []
                for text in batch["text"]:
                    raw = text.as_py()
                    words = (raw or b"").translate(FOLD).split()
                    found.append(_judged(raw, len(words), automaton.hits(words)))
                yield _frame(batch["doc_id"], found)

        return rows.mapInArrow(scanned, result)

    keyed = rows.withColumn("key", F.md5("text"))

    def scan(number: int) -> DataFrame:
        part = block(number)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = resident(f"{name}-{number}", lambda: Automaton(part.value))
            for batch in batches:
                for key, text in zip(batch["key"].to_pylist(), batch["text"]):
                    if found := automaton.hits((text.as_py() or b"").translate(FOLD).split()):
                        given = [dict(zip(("first", "last", "item_id"), hit)) for hit in found]
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([given], pa.list_(HIT))], ["key", "hits"])

        return keyed.select("key", "text").mapInArrow(hits, "key string, hits array<struct<first long, last long, item_id string>>").dropDuplicates(["key"])

    found = written(scan(0))
    for number in range(1, blocks):
        found = found.union(written(scan(number)))
    found = found.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, hits in zip(batch["text"], batch["hits"]):
                raw = text.as_py()
                given = [(hit["first"], hit["last"], hit["item_id"]) for hit in hits.as_py() or []]
                rows.append(_judged(raw, len((raw or b"").translate(FOLD).split()), given))
            yield _frame(batch["doc_id"], rows)

    return keyed.join(found, "key", "left").select("doc_id", "text", "hits").mapInArrow(judged, result)


def without_benchmark(docs: DataFrame, items: DataFrame, most_hit: float = 0.0, **given) -> DataFrame:
    """doc_id and n_words of the rows of ``docs`` of whose words at most this share is hit."""
    found = find_benchmark(docs, items, **given)
    return found.filter(F.col("n_hit") <= most_hit * F.col("n_words")).select("doc_id", "n_words")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every document is made of benchmark windows."""
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS gram
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k)
  WHERE len(w) > 0),
places AS (
  SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS t(k)),
hits AS (SELECT p.r, p.k, p.size, x.item_id FROM places p JOIN windows x USING (size, gram)),
hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""
