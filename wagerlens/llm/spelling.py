"""Spelling variants (operator 12) by an index of variable-length grams.

Words are counted over all texts. Their grams of 2 to ``LONGEST`` code points are counted too, and those in many words make
the gram dictionary: a gram that is frequent is extended by a further character, as a list of words that have it would be
long. How frequent follows from the number of grams, so that the dictionary is bounded (``FREQUENT`` grams of a length).
A word is decomposed into the longest grams that start at each place and do not end within an earlier one.

An edit at a place affects, of a word's grams, only those that end in the ``longest`` places from there on: the others have all
their characters before it, or start behind it and end beyond any gram that holds it. (In words of ``2 * longest`` code points and more, some gram is
always left; shorter words use shorter grams.) So of two grams whose ends are that far apart at least one is in every near
word, as far from the start if it is the first and from the end if it is the second. Each word therefore merges just two lists for near words of its
length and two for those that are one longer: of all pairs of grams the bound allows, the two whose lists are shortest. Words that
meet in a list are verified by their edit distance within the join, so that only near words come out of it.

All joins are told to shuffle, as every side grows with the vocabulary and Spark sizes it too low: it takes rows made in Python for as many as those
they are made of (a word is in some 17 lists), and a written step for its compressed files. What Spark broadcasts goes through the driver.

Defined cases: null texts have no words; a row without id is damaged as if its id were empty; runs count once for each time they occur, in
repeated rows too; words of any length are compared whole; equal counts go by code-point order; no words give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.common import table, texts, written

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
SHORTEST, LONGEST = 2, 6
#: Grams of one length in the dictionary at most, and how often a gram occurs in it at least.
FREQUENT, LEAST = 20_000, 16
#: Different words or grams that a task counts together.
COUNTED = 500_000

#: Of the damage: one run in so many loses a code point.
DAMAGED = 199

Piece = tuple[int, int]


def damaged(run: str, id_crc: int) -> str:
    """The run without one code point, if ``DAMAGED`` divides the crc32 of id and run."""
    h = zlib.crc32(run.encode(), id_crc)
    if h % DAMAGED:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def _counts(given: Iterator[Counter], name: str) -> Iterator[pa.RecordBatch]:
    """Counts of a task, passed on whenever they are many."""
    held: Counter = Counter()
    for some in given:
        held.update(some)
        if len(held) >= COUNTED:
            yield from _batches(held, name)
            held = Counter()
    yield from _batches(held, name)


def _batches(counts: Counter, name: str) -> Iterator[pa.RecordBatch]:
    items = iter(counts.items())
    while some := list(islice(items, 50_000)):
        keys, times = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64())], [name, "n"])


def word_counts(docs: DataFrame, damage: bool = True, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): runs of letters in lower case (of A-Z), damaged if asked, of so many code points and occurrences at least."""
    rows = texts(docs, id_column, text_column).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # A shorter run, whole as it is, cannot become a word.
    runs_of = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}").findall

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_texts() -> Iterator[Counter]:
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    runs = Counter(runs_of((text.as_py() or b"").lower().decode()))
                    if not damage:
                        yield runs
                        continue
                    id_crc, found = zlib.crc32(f"{doc_id or ''}:".encode()), Counter()
                    for run, times in runs.items():
                        found[damaged(run, id_crc)] += times
                    yield found

        yield from _counts(of_texts(), "word")

    words = rows.mapInArrow(counted, "word string, n long").filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame) -> tuple[dict[str, int], int]:
    """The frequent grams and their counts, and the count from which a gram is frequent."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_words() -> Iterator[Counter]:
            for batch in batches:
                for word in batch["word"].to_pylist():
                    yield Counter(word[p : p + q] for q in range(SHORTEST, LONGEST + 1) for p in range(len(word) - q + 1))

        yield from _counts(of_words(), "gram")

    grams = written(words.select("word").mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST))
    most = grams.groupBy(F.length("gram")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    # Fewer than FREQUENT grams of a length can occur that often.
    least = max(LEAST, -(-most // FREQUENT))
    return {row.gram: row.n for row in grams.filter(F.col("n") >= least).collect()}, least


def longest_gram(length: int) -> int:
    """Of words of this length and one more: an edit leaves some of their grams."""
    return min(LONGEST, length // 2)


def pieces(word: str, longest: int, frequent: dict[str, int]) -> list[Piece]:
    """Start and end of the grams of a word."""
    found, reach, size = [], 0, len(word)
    for start in range(size - SHORTEST + 1):
        end = start + SHORTEST
        while end < size and end - start < longest and word[start:end] in frequent:
            end += 1
        if end > reach:
            found.append((start, end))
            reach = end
    return found


def shortest_lists(word: str, given: list[Piece], apart: int, frequent: dict[str, int], least: int) -> tuple[Piece, Piece]:
    """The two grams with the least lists whose ends are ``apart`` or more: every edit leaves one of them."""
    cost = [frequent.get(word[a:b], least) for a, b in given]
    best = None
    first, low = 0, 0  # the least list among the grams that end early enough
    for k, (_, end) in enumerate(given):
        while first < k and given[first][1] + apart <= end:
            if cost[first] < cost[low]:
                low = first
            first += 1
        if first and (best is None or cost[low] + cost[k] < best[0]):
            best = cost[low] + cost[k], low, k
    return given[best[1]], given[best[2]]


def _key(kind: str, length: int, place: int, gram: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}{length}:{place}:{gram}") - (1 << 63)


def filed_under(word: str, frequent: dict[str, int]) -> list[int]:
    """The lists that hold a word: for words of its length, and for words that are one shorter."""
    size = len(word)
    keys = [_key("=", size, a, word[a:b]) for a, b in pieces(word, longest_gram(size), frequent)]
    if size > MIN_LENGTH:
        for a, b in pieces(word, longest_gram(size - 1), frequent):
            keys += _key("<", size - 1, a, word[a:b]), _key(">", size - 1, size - a, word[a:b])
    return keys


def merged_lists(word: str, frequent: dict[str, int], least: int) -> list[int]:
    """The lists that hold all near words of a word's length, and all that are one longer."""
    size, longest = len(word), longest_gram(len(word))
    given = pieces(word, longest, frequent)
    (a, b), (c, d) = shortest_lists(word, given, longest, frequent, least)
    same = [_key("=", size, a, word[a:b]), _key("=", size, c, word[c:d])]
    # A code point more between two others touches one place less.
    (a, b), (c, d) = shortest_lists(word, given, longest - 1, frequent, least)
    return same + [_key("<", size, a, word[a:b]), _key(">", size, size - c, word[c:d])]


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): the pairs of a frame of distinct words that differ by one code point, each once; words of 6 code points or more."""
    frequent, least = gram_dictionary(words)
    dictionary = words.sparkSession.sparkContext.broadcast(frequent)

    def listed(filed: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = dictionary.value
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    found = [filed_under(word, known) if filed else merged_lists(word, known, least) for word in part["word"].to_pylist()]
                    place = pa.array([k for k, keys in enumerate(found) for _ in keys], pa.int64())
                    keys = pa.array([key for keys in found for key in keys], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, part["word"].take(place), part["n"].take(place)], ["key", "word", "n"])

        return words.select("word", "n").mapInArrow(rows, "key long, word string, n long")

    index, probes = listed(True).toDF("key", "b", "n_b"), listed(False).toDF("key", "a", "n_a")
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = probes.join(index.hint("merge"), "key").filter(once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) lead from each word; they must not lead round."""
    current = written(links.select("word", F.col("form").alias("root")))
    while True:
        # Steps double each time.
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(current.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return current


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a frame of distinct (word, n).

    The form is the near word with the largest n, if that is ``ratio`` times the word's or more (above 1, so that forms do not lead round).
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = written(words)
    pairs = written(near_words(words))
    both = pairs.toDF("word", "n", "other", "n_other").union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("least"), "other")).alias("best"), F.first("n").alias("n"))
    is_form = -F.col("best.least") >= ratio * F.col("n")
    near = written(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.least")).alias("form_n")))
    ends = roots(near.filter("form is not null"))
    return words.join(near.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all frequent words of the damaged documents."""
    return spelling_forms(word_counts(table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
             lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
           lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]))) AS h
  FROM runs, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
without_one AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(0, length(word))) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without_one a JOIN without_one b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without_one a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without_one a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chains AS (
  WITH RECURSIVE led AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN formed f ON f.word = l.next)
  SELECT word, root FROM led WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chains USING (word)
"""
