"""LM scoring (operator 5): stupid-backoff scores against n-gram counts of the whole corpus.

A word's score is the count of the n-gram that ends there over the count of its context, if the n-gram occurs at least
``MIN_COUNT`` times in the corpus, else ``ALPHA`` times the score with a shorter context; a single word's is
its share of all words. A document's score is the mean binary logarithm. (With a least count of 2, no text scores well
by being its own and only witness.)

Relations: n-grams of each block of documents, exploded and counted within the block, are dealt by ranges of their
64-bit hash (``part``). A part sums the blocks' counts into its piece of the corpus table and joins them back: each block gets
the corpus counts of its own n-grams. A block's documents then meet those counts, and scores are
summed per document. N-grams of a block and part travel as one sorted array, so a frequent n-gram is at most one entry a
block. Every n-gram of every document is counted; nothing is pruned or held on the driver. There are as many parts, and tasks that sum or
score, as the texts' bytes ask for, so that a task holds as much of 1 GB as of 1 TB.

The texts are read twice and must come in the same splits both times, as they do from tables; each block's n-grams are checked for it.

Defined cases: words are lower-cased in A-Z; null texts and texts without words have no score; a document of one word has
a unigram score; repeated rows count and score repeatedly; a row without doc_id counts and scores like any other; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.common import table, texts

ORDER, MIN_COUNT, ALPHA = 3, 2, 0.4
#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 12 << 20
#: Text bytes whose n-grams a part holds, about.
PART_BYTES = 4 << 20
#: Digits of the registered score.
DIGITS = 6

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """A split's documents in blocks: number, ids, texts."""
    number, ids, raws, size, kind = TaskContext.get().partitionId() << 32, [], [], 0, None
    for batch in batches:
        kind = batch["doc_id"].type
        for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            ids.append(doc_id)
            raws.append(raw or b"")
            size += len(raws[-1])
            if size >= BLOCK_BYTES:
                yield number, pa.array(ids, kind), raws
                number, ids, raws, size = number + 1, [], [], 0
    if ids:
        yield number, pa.array(ids, kind), raws


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, one after the other, and where each text ends."""
    hashes: list[np.ndarray] = []
    for raw in raws:
        words = raw.lower().split()
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate([np.empty(0, np.uint64), *hashes]), np.cumsum([len(x) for x in hashes], dtype=np.int64)


def gram_keys(words: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to ``order``: keys of the n-grams that end at each word with enough words before it in its text."""
    found = []
    for n in range(1, order + 1):
        ends = np.flatnonzero(places >= n - 1)
        total = np.full(len(ends), n, np.uint64)
        for k in range(n):
            total += words[ends - k] * _ODD[k]
            total = (total ^ (total >> np.uint64(29))) * _ODD[-1]
        total ^= total >> np.uint64(32)
        found.append(np.maximum(total, np.uint64(1)))  # key 0 is for the number of words
    return found


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; the list is emptied and the keys are sorted in place, as
    a block's keys are what a worker's memory goes to."""
    joined = np.concatenate(grams)
    grams.clear()
    joined.sort()
    first = np.ones(len(joined), bool)
    np.not_equal(joined[1:], joined[:-1], out=first[1:])
    place = np.flatnonzero(first)
    return joined[place], np.diff(place, append=len(joined))


def _places(ends: np.ndarray) -> np.ndarray:
    """Each word's place in its text."""
    sizes = np.diff(ends, prepend=0)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _packed(keys: np.ndarray, start: int) -> bytes:
    """Sorted keys as differences of 6 bytes if they fit, else 8; the first byte tells."""
    steps = np.diff(keys, prepend=np.uint64(start))
    width = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, start: int) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(start)


def _squeezed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(counts.astype(np.uint64).tobytes())


def _digest(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(0)).view(np.int64))


UNEQUAL = "a split had other documents when it was read again: write the input as a table first"


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint64)


def backoff_scores(
    docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_words, hits (words scored by n-grams of 1, 2, ... words), log2_sum (null without words)."""
    if not 1 <= order <= len(_ODD) - 1:
        raise ValueError(f"order must be from 1 to {len(_ODD) - 1}")
    rows = texts(docs, id_column, text_column).withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, (size // PART_BYTES).bit_length())
    tasks = 1 + size // BLOCK_BYTES
    starts = [part << (64 - bits) for part in range(1 << bits)]

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, raws in _blocks(batches):
            words, ends = word_hashes(raws)
            keys, times = _distinct([np.zeros(1, np.uint64), *gram_keys(words, _places(ends), order)])
            times[0] = len(words)  # of the key under which words are added up
            del words, raws
            cuts = [*np.searchsorted(keys, np.array(starts, np.uint64)), len(keys)]
            parts = [p for p in range(len(starts)) if cuts[p] < cuts[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()),
                 pa.array([_packed(keys[cuts[p] : cuts[p + 1]], starts[p]) for p in parts], pa.binary()),
                 pa.array([_squeezed(times[cuts[p] : cuts[p + 1]]) for p in parts], pa.binary()),
                 pa.array([_digest(keys[cuts[p] : cuts[p + 1]]) for p in parts], pa.int64())],
                ["part", "block", "keys", "times", "digest"],
            )

    def counted(group: pa.Table) -> pa.Table:
        start = starts[group["part"][0].as_py()]
        keys = [_unpacked(data, start) for data in group["keys"].to_pylist()]
        sizes = np.cumsum([len(x) for x in keys])[:-1]
        times = np.concatenate([_counts(data) for data in group["times"].to_pylist()])
        joined = np.concatenate(keys)
        del keys
        by_key = np.argsort(joined, kind="stable")
        first = np.flatnonzero(np.diff(joined[by_key], prepend=joined[by_key[0]] ^ np.uint64(1)))
        sums = np.add.reduceat(times[by_key], first)
        corpus = np.empty_like(times)
        corpus[by_key] = np.repeat(sums, np.diff(first, append=len(joined)))
        back = [_squeezed(x) for x in np.split(corpus, sizes)]
        return pa.table({"block": group["block"], "part": group["part"], "times": pa.array(back, pa.binary()), "digest": group["digest"]})

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for block, ids, raws in _blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([[len(raw) for raw in raws]], pa.list_(pa.int64())), pa.array([squeeze(b"".join(raws))], pa.binary())],
                ["block", "ids", "sizes", "body"],
            )

    def scored(documents: pa.Table, counts: pa.Table) -> pa.Table:
        if documents.num_rows != 1 or not counts.num_rows:
            raise RuntimeError(UNEQUAL)
        ids, sizes = documents["ids"].combine_chunks().flatten(), documents["sizes"][0].as_py()
        body = zstandard.ZstdDecompressor().decompress(documents["body"][0].as_py())
        limits = np.cumsum([0, *sizes])
        words, ends = word_hashes([body[a:b] for a, b in zip(limits, limits[1:])])
        del body
        places = _places(ends)
        grams = gram_keys(words, places, order)
        del words
        known = _distinct(list(grams))[0]
        corpus = np.concatenate([_counts(data) for data in counts.sort_by("part")["times"].to_pylist()])
        total, corpus = float(corpus[0]), corpus[1:]
        if len(corpus) != len(known) or np.bitwise_xor.reduce(counts["digest"].to_numpy()) != _digest(known):
            raise RuntimeError(UNEQUAL)
        level = np.ones(len(places), np.int8)
        value = np.zeros(len(places))
        shorter = before = value
        for n, keys in enumerate(grams, 1):
            count = np.zeros(len(places), np.uint64)
            ends_here = np.flatnonzero(places >= n - 1)
            count[ends_here] = corpus[np.searchsorted(known, keys)]
            if n == 1:
                value = count / max(total, 1.0)
            else:
                context = np.roll(shorter, 1).astype(float)  # the first word's is not used
                used = (places >= n - 1) & (count >= min_count)
                value = np.where(used, count / np.maximum(context, 1.0), alpha * value)
                value = np.where(places >= n - 1, value, before)
                level = np.where(used, n, level)
            shorter, before = count, value
        begins = ends - np.diff(ends, prepend=0)
        n_words = ends - begins
        sums = np.array([np.log2(value[a:b]).sum() for a, b in zip(begins, ends)])
        of_level = (np.concatenate([[0], np.cumsum(level == n, dtype=np.int32)]) for n in range(1, order + 1))
        hits = np.stack([(x[ends] - x[begins]).astype(np.int64) for x in of_level], axis=1)
        return pa.table(
            {"doc_id": ids, "n_words": pa.array(n_words), "hits": pa.array(list(hits), pa.list_(pa.int64())), "log2_sum": pa.array(sums, pa.float64(), mask=n_words == 0)}
        )

    grams = rows.mapInArrow(exploded, "part int, block long, keys binary, times binary, digest long").repartition(1 << bits, "part")
    counts = grams.groupBy("part").applyInArrow(counted, "block long, part int, times binary, digest long").repartition(tasks, "block")
    documents = rows.mapInArrow(gathered, f"block long, ids array<{kind}>, sizes array<long>, body binary").repartition(tasks, "block")
    return documents.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, n_words long, hits array<long>, log2_sum double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's mean log2 score, and how many of its words each order scored."""
    scores = backoff_scores(table(spark, sf_dir, "documents"))
    return scores.selectExpr(
        "doc_id", "n_words", "hits[2] as n_trigram", "hits[1] as n_bigram", "hits[0] as n_unigram",
        f"round(log2_sum / n_words, {DIGITS}) as score",
    )


ORACLE_SQL = r"""
WITH words AS (
  SELECT d.row_no, d.doc_id, len(d.w) AS n_words, t.i, d.w[t.i] AS w1, d.w[t.i - 1] AS w2, d.w[t.i - 2] AS w3
  FROM (SELECT row_number() OVER () AS row_no, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x20\x09-\x0D]+') AS w FROM documents) d,
       unnest(range(1, len(d.w) + 1)) AS t(i)),
placed AS (
  SELECT row_no, n_words, i, w1, CASE WHEN i > 1 THEN w2 END AS w2, CASE WHEN i > 2 THEN w3 END AS w3 FROM words),
uni AS (SELECT w1, count(*) AS c FROM placed GROUP BY 1),
bi AS (SELECT w2, w1, count(*) AS c FROM placed WHERE i > 1 GROUP BY 1, 2),
tri AS (SELECT w3, w2, w1, count(*) AS c FROM placed WHERE i > 2 GROUP BY 1, 2, 3),
counted AS (
  SELECT p.row_no, p.n_words, p.i, u.c AS c1, b.c AS c2, t.c AS c3, v.c AS d1, e.c AS d2, (SELECT count(*) FROM placed) AS n
  FROM placed p
  JOIN uni u ON u.w1 = p.w1
  LEFT JOIN bi b ON b.w2 = p.w2 AND b.w1 = p.w1
  LEFT JOIN tri t ON t.w3 = p.w3 AND t.w2 = p.w2 AND t.w1 = p.w1
  LEFT JOIN uni v ON v.w1 = p.w2
  LEFT JOIN bi e ON e.w2 = p.w3 AND e.w1 = p.w2),
scored AS (
  SELECT row_no, n_words,
         CASE WHEN i > 2 AND c3 >= 2 THEN 3 WHEN i > 1 AND c2 >= 2 THEN 2 ELSE 1 END AS level,
         log2(CASE WHEN i > 2 AND c3 >= 2 THEN c3 / d2::DOUBLE
                   WHEN i > 1 AND c2 >= 2 THEN (CASE WHEN i > 2 THEN 0.4 ELSE 1.0 END)::DOUBLE * (c2 / d1::DOUBLE)
                   ELSE (CASE WHEN i > 2 THEN 0.4::DOUBLE * 0.4::DOUBLE WHEN i > 1 THEN 0.4 ELSE 1.0 END)::DOUBLE * (c1 / n::DOUBLE) END) AS s
  FROM counted),
summed AS (
  SELECT row_no, count(*) FILTER (level = 3) AS n_trigram, count(*) FILTER (level = 2) AS n_bigram,
         count(*) FILTER (level = 1) AS n_unigram, round(sum(s) / any_value(n_words), 6) AS score
  FROM scored GROUP BY row_no)
SELECT d.doc_id, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS n_words,
       coalesce(n_trigram, 0) AS n_trigram, coalesce(n_bigram, 0) AS n_bigram, coalesce(n_unigram, 0) AS n_unigram, score
FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents) d LEFT JOIN summed USING (row_no)
"""
