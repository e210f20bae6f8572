"""N-gram Jaccard join (operator 3): a size-aware heavy-light join of word-shingle sets.

Two sets with Jaccard similarity of at least 4/5 share, in any fixed order of tokens, at least c tokens among
the first ``n - ceil(4n/5) + c`` of each. Rare tokens come first in the order used here.
Small sets file every 2-subset of that prefix (c = 2), so that only sets with both tokens meet;
large sets scan the inverted lists of their prefix tokens (c = 1), which also hold the small sets
that are large enough to match a large one. The boundary is the size at which the summed cost of subsets and
of list scans is least, by the lengths of all lists there are: longer lists move it up.

Steps, each written to the shared folder:

1. One pass over the texts gives each document's set size and 64-bit class (equal sets are one class from here on) and the
   tokens that repeat within a few million tokens of a task. Their summed counts are lower bounds of the true ones
   (lossy counting). The ``HEAVY_TOKENS`` most frequent form the order's heavy end; any order gives the same links.
2. A second pass files the prefixes, in buckets of tokens that NumPy looks through. Only tokens under which different classes meet are kept (those of frequent
   tokens are dealt by class as well, so that no task gets all of a hot token's rows). The lengths of these lists, and
   of those of some subsets of every set, give the boundary; the sets up to it file subsets of the tokens that they have kept.
3. Short lists name all their pairs, with the number of keys under which they meet; only those that meet often and early enough for the threshold
   stay, and only those whose sketches differ by no more than linked sets can. Of a long list, a few pivots are named in each round.
4. In rounds, each class is compared with those of its pairs that meet most often, outside its component.
   Links join components, so that large groups fall together.
5. All pairs that are still in different components and can link, of long lists as well,
   are compared. What is left out is connected already or cannot link, so no component is missed, whatever the groups' sizes.

Comparisons are exact on 64-bit token hashes of whole texts.

Defined cases: null texts, empty ones and those without words have an empty set and link with nothing; a row
without doc_id links with nothing and has a null component; equal texts are one class however many they are;
repeated rows give repeated rows; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wagerlens.llm.common import BROADCAST_ROWS, shared_folder, small_enough, table, texts, written
from wagerlens.llm.components import connected_components
from wagerlens.llm.word_hashes import hashed_words

WORDS = 5
#: Jaccard threshold as a fraction.
SHARE = (4, 5)
#: Tokens in the broadcast order (12 bytes each): a fixed bound, which bears on speed and not on results.
HEAVY_TOKENS = 1 << 17
#: Bytes of text that are split and hashed together.
PART_BYTES = 1 << 19
#: Tokens that a task looks at together when it counts, and the least count there that it passes on.
COUNT_WINDOW, COUNT_LEAST = 1 << 21, 4
#: Rows of a frequent token that are looked at together, about.
TOKEN_ROWS = 4096
#: Prefix tokens that are looked through together for those that meet, about, and the least number of such buckets.
BUCKET_ROWS, BUCKETS = 1 << 18, 64
#: Prefix tokens that a task holds before it files them, and rows of short lists of which it names the pairs together.
FILED_ROWS, PAIRED_ROWS = 1 << 19, 1 << 18
#: Groups into which the pairs of a class are dealt before the most met of all are taken.
DEALT = 16
#: Pivots of a long list and round, and rounds. They bear on the work, not on the result: what the rounds leave is compared in the last step.
PIVOTS, ROUNDS = 4, 3
#: Lists longer than this are long: their pairs are not all named.
LONG_LIST = 32
#: The ratio of sizes from one band to the next: more than that of any linked sets.
SIZE_BAND = 1.3
#: Bits of a class's sketch.
SKETCH = 1024
#: Pairs that are compared together, and tokens of the sets that a task remembers while it compares.
COMPARED = 256
REMEMBERED = 1 << 22
#: Sizes from here on are one class of the cost model; enumeration never pays there.
LARGEST_BOUNDARY = 512

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    return values * np.uint64(0xD6E8FEB86659FD93)


def shingled(raw: bytes | None, words: int = WORDS) -> tuple[np.ndarray, int]:
    """Sorted distinct 64-bit hashes of a text's word shingles, and how many words it has."""
    found = raw.lower().split() if raw else []
    if not found:
        return np.empty(0, np.uint64), 0
    width = min(words, len(found))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for k in range(width):
        total += hashes[k : len(found) - width + 1 + k] * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
    return np.unique(_mixed(total)), len(found)


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    return shingled(raw, words)[0]


def shingled_texts(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingled`` for many texts at once: all their tokens, where each text's begin (and the last ones end), and the texts' numbers of words."""
    hashes, n_words = hashed_words(texts.cast(pa.binary()))
    starts = np.concatenate([[0], np.cumsum(n_words)])

    windows = max(0, len(hashes) - words + 1)
    total = np.full(len(hashes), words, np.uint64)
    for k in range(words):
        total[:windows] += hashes[k : windows + k] * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
    whole = np.ones(len(hashes), bool)
    for k in range(1, words):
        whole[starts[1:][n_words >= words] - k] = False
    for text in np.flatnonzero((n_words > 0) & (n_words < words)):
        begin, width = starts[text], int(n_words[text])
        whole[begin + 1 : begin + width] = False
        total[begin] = width
        for k in range(width):
            total[begin : begin + 1] += hashes[begin + k : begin + k + 1] * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
    tokens = _mixed(total[whole])
    bounds = np.concatenate([[0], np.cumsum(np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0))])
    for begin, end in zip(bounds.tolist(), bounds[1:].tolist()):
        tokens[begin:end].sort()
    distinct_here = np.ones(len(tokens), bool)
    distinct_here[1:] = tokens[1:] != tokens[:-1]
    distinct_here[bounds[:-1][bounds[:-1] < len(tokens)]] = True
    return tokens[distinct_here], np.concatenate([[0], np.cumsum(distinct_here)])[bounds], n_words


def _in_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of the texts of about ``PART_BYTES`` each, a longer text by itself."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + PART_BYTES, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def _sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """``shingled`` of each text."""
    for part in _in_parts(texts):
        tokens, bounds, n_words = shingled_texts(part)
        for begin, end, count in zip(bounds.tolist(), bounds[1:].tolist(), n_words.tolist()):
            yield tokens[begin:end], count


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    name = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return name - (1 << 64) if name >> 63 else name


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Which of ``SKETCH`` cells hold an odd number of tokens, as 64-bit words.

    Two sketches differ in at most as many bits as the sets differ in tokens.
    """
    odd = np.bincount((tokens % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def least_overlap(size: int) -> int:
    """Tokens that a set of this size shares with any set that it links with, at least."""
    return -(-SHARE[0] * size // SHARE[1])


def prefix_length(size: int, subset: int) -> int:
    return min(size, size - least_overlap(size) + subset)


def choose_boundary(costs: dict[int, tuple[float, float]]) -> int:
    """The size up to which enumerating 2-subsets costs least in sum.

    ``costs`` gives, for all sets of a size, what their subsets cost and how many list entries they scan. Sets below
    ``least_overlap(boundary + 1)`` are in no list, as no larger set than the boundary can link with them.
    """
    entries = sum(scanned for _, scanned in costs.values())
    best, boundary, filed = entries, 1, 0.0
    for size in range(2, LARGEST_BOUNDARY + 1):
        filed += costs.get(size, (0, 0))[0]
        in_no_list = sum(scanned for other, (_, scanned) in costs.items() if other < least_overlap(size + 1))
        if filed + entries - in_no_list < best:
            best, boundary = filed + entries - in_no_list, size
    return boundary


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def _measure(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, *keep, n_words, size, class) of each document, and (token, times) of tokens that repeat, from one pass."""
    kept = ["doc_id", *keep]
    row = StructType([*(StructField(c, docs.schema[c].dataType) for c in kept), *(StructField(c, LongType()) for c in ("n_words", "size", "class", "token", "times"))])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held, types = 0, []
        names = [*kept, "n_words", "size", "class", "token", "times", "kind"]

        def repeats() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(waiting), return_counts=True)
            often = times >= COUNT_LEAST
            n = int(often.sum())
            blank = [pa.nulls(n, kind) for kind in (*types, pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*blank, _long(token[often]), pa.array(times[often], pa.int64()), pa.array([1] * n, pa.int32())], names)

        for batch in batches:
            n, types = batch.num_rows, [batch[c].type for c in kept]
            words, sizes, classes = [], [], []
            for tokens, count in _sets(batch["text"]):
                words.append(count)
                sizes.append(len(tokens))
                classes.append(class_of(tokens) if count else None)
                waiting.append(tokens)
                held += len(tokens)
                if held >= COUNT_WINDOW:
                    yield repeats()
                    waiting, held = [], 0
            measures = [pa.array(values, pa.int64()) for values in (words, sizes, classes)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *measures, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int32())], names)
        if held:
            yield repeats()

    both = docs.mapInArrow(passed, row.add("kind", "integer"))
    folder = shared_folder(docs.sparkSession)
    both.write.partitionBy("kind").parquet(folder)
    back = docs.sparkSession.read.schema(both.schema).parquet(folder)
    return back.filter("kind = 0").select(*kept, "n_words", "size", "class"), back.filter("kind = 1").select("token", "times")


def _heavy(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted heavy tokens with their counts."""
    totals = written(counted.groupBy("token").agg(F.sum("times").alias("times")))
    steps = totals.groupBy(F.floor(4 * F.log2("times")).alias("step")).agg(F.count("*").alias("n")).collect()
    room, cut = HEAVY_TOKENS, math.inf
    for step in sorted(steps, key=lambda row: -row.step):
        room -= step.n
        if room < 0:
            break
        cut = step.step
    if cut is math.inf:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    chosen = totals.filter(F.floor(4 * F.log2("times")) >= cut).toPandas()
    token = chosen["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], chosen["times"].to_numpy(np.int64)[order]


def _file_prefixes(docs: DataFrame, heavy: np.ndarray, weight: np.ndarray, buckets: int) -> DataFrame:
    """The tokens in each class's prefix for c = 2 and their places there, once a task: rows of a bucket and, as arrays of bytes, key, class, size, place, deals.

    ``deals`` is the number of groups into which the classes of a frequent token are dealt; it is 1 for the others. Token and group give the bucket.
    """
    order = docs.sparkSession.sparkContext.broadcast((heavy, weight))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_heavy, weights = order.value
        some_heavy = np.zeros(1 << 22, bool)  # by their first bits, which tells nearly all others apart
        some_heavy[tokens_heavy >> np.uint64(42)] = True
        seen: set[int] = set()
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def rows() -> pa.RecordBatch:
            key, name, size, place, deals = (np.concatenate(column) for column in zip(*waiting))
            bucket = ((key ^ _mixed(_dealt(name, deals).astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)
            by_bucket = np.argsort(bucket)
            bucket = bucket[by_bucket]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            columns = [[x.tobytes() for x in np.split(column[by_bucket], starts[1:])] for column in (key, name, size, place, deals)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *(pa.array(column, pa.binary()) for column in columns)], ["bucket", *_FILED])

        for batch in batches:
            for part in _in_parts(batch["text"]):
                tokens, bounds, _ = shingled_texts(part)
                weighed = np.zeros(len(tokens), np.int64)
                maybe = np.flatnonzero(some_heavy[tokens >> np.uint64(42)])
                if len(tokens_heavy) and len(maybe):
                    place = np.minimum(np.searchsorted(tokens_heavy, tokens[maybe]), len(tokens_heavy) - 1)
                    weighed[maybe] = np.where(tokens_heavy[place] == tokens[maybe], weights[place], 0)
                known = np.diff(np.concatenate([[0], np.cumsum(weighed > 0)])[bounds])
                names, sizes, widths, places = [], [], [], []
                for begin, end, any_known in zip(bounds.tolist(), bounds[1:].tolist(), known.tolist()):
                    size = end - begin
                    if size < 2 or (name := class_of(tokens[begin:end])) in seen:
                        continue  # a set of one token links with its equals only
                    seen.add(name)
                    width = prefix_length(size, 2)
                    places.append(begin + (np.argsort(weighed[begin:end], kind="stable")[:width] if any_known else np.arange(width)))
                    names.append(name)
                    sizes.append(size)
                    widths.append(width)
                if names:
                    at, width = np.concatenate(places), np.array(widths)
                    place = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
                    deals = 1 + weighed[at] // TOKEN_ROWS
                    waiting.append((tokens[at], np.repeat(np.array(names, np.int64), width), np.repeat(np.array(sizes, np.int32), width), place.astype(np.int32), deals.astype(np.int32)))
                    held += len(at)
                if held >= FILED_ROWS:
                    yield rows()
                    waiting, held = [], 0
        if held:
            yield rows()

    return docs.mapInArrow(filed, "bucket int, " + ", ".join(f"{name} binary" for name in _FILED))


#: The columns of filed prefixes and the types of their arrays.
_FILED = {"key": np.int64, "class": np.int64, "size": np.int32, "place": np.int32, "deals": np.int32}


def _dealt(name: np.ndarray, deals: np.ndarray) -> np.ndarray:
    """The group of a frequent token into which a class is dealt."""
    return (name & 0xFFFFFFFF) % deals


def _meeting(key: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, deals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a bucket, each class once, hold a frequent token or one under which classes meet, and the lengths of their lists (for c = 1)."""
    mark = key ^ _dealt(name, deals) * -0x61C8864680B583EB
    order = np.argsort(mark)
    mark = mark[order]
    again = np.concatenate([[False], mark[1:] == mark[:-1], [False]])
    order = order[again[1:] | again[:-1] | (deals[order] > 1)]
    group = _dealt(name[order], deals[order])
    by_list = np.lexsort((name[order], group, key[order]))
    order, group = order[by_list], group[by_list]
    new_list = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (group[1:] != group[:-1])])[: len(order)]
    new = new_list | np.concatenate([[True], name[order][1:] != name[order][:-1]])[: len(order)]
    order, new_list = order[new], new_list[new]
    numbers = np.cumsum(new_list) - 1
    classes = np.bincount(numbers)[numbers]
    listed = place[order] < size[order] + SHARE[0] * size[order] // -SHARE[1] + 1
    lengths = np.bincount(numbers, listed)[numbers].astype(np.int64) * deals[order]
    lengths = np.where(deals[order] > 1, np.maximum(lengths, LONG_LIST + 1), lengths)
    kept = (classes > 1) | (deals[order] > 1)
    return order[kept], lengths[kept]


def _lists(filed: DataFrame) -> DataFrame:
    """(key, class, size, place, length) of the tokens under which classes meet, and ``length`` of their lists for c = 1.

    All of a frequent token's classes are kept, as those it meets may be in its other groups; its list counts as long.
    """

    def met(bucket: pa.Table) -> pa.Table:
        filed = {name: np.concatenate([np.frombuffer(rows.as_buffer(), kind) for rows in bucket[name]]) for name, kind in _FILED.items()}
        rows, lengths = _meeting(*filed.values())
        return pa.table({**{name: pa.array(filed[name][rows]) for name in ("key", "class", "size", "place")}, "length": pa.array(lengths, pa.int64())})

    return written(filed.groupBy("bucket").applyInArrow(met, "key long, class long, size int, place int, length long"))


def _kept_tokens(lists: DataFrame) -> DataFrame:
    """(class, size, tokens) of the sets up to ``LARGEST_BOUNDARY``: the tokens that they share with others, the rarest first; no more than a prefix holds."""
    rows = lists.filter(f"size <= {LARGEST_BOUNDARY}").groupBy("class", "size").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("tokens"))
    return written(rows.select("class", "size", F.col("tokens.key").alias("tokens")).filter("size(tokens) > 1"))


def _costs(lists: DataFrame, kept: DataFrame) -> dict[int, tuple[float, float]]:
    """By set size: what the subsets of its sets would cost, and how many list entries they scan.

    A subset costs its own entry and those that it meets. How many these are is measured on three subsets of every set: its rarest
    tokens, two in the middle, and the rarest with the most frequent; so the work is linear whatever the groups' sizes.
    """
    scanned = lists.filter(f"place < {_prefix('size')}")
    read = scanned.groupBy(F.least("size", F.lit(LARGEST_BOUNDARY + 1)).alias("size")).agg(F.sum("length").alias("read"))
    some = "array(xxhash64(tokens[0], tokens[1]), xxhash64(tokens[n div 2 - 1], tokens[n div 2]), xxhash64(tokens[0], tokens[n - 1]))"
    looked = kept.withColumn("n", F.size("tokens").cast("long")).select("class", "size", "n", F.explode(F.array_distinct(F.expr(some))).alias("key"))
    met = looked.groupBy("key").agg(F.count("*").alias("length"))
    each = looked.join(met, "key").groupBy("class", "size").agg(F.first("n").alias("n"), F.avg("length").alias("length"))
    filed = each.groupBy("size").agg(F.sum(F.expr("n * (n - 1) / 2 * (1 + length)")).alias("cost"))
    both = read.join(filed, "size", "full").select("size", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("read", F.lit(0)).alias("read"))
    return {row.size: (float(row.cost), float(row.read)) for row in both.collect()}


def _filed_by_size(lists: DataFrame, kept: DataFrame, boundary: int) -> DataFrame:
    """(key, class, size, place, length): the lists for c = 1 of the sets that a large one may link with, and the subsets of small sets, with place -1."""
    large = lists.filter(f"size >= {least_overlap(boundary + 1)} and place < {_prefix('size')}")
    if boundary < 2:
        return large
    tokens = kept.filter(f"size <= {boundary}").select("class", "size", F.sort_array("tokens").alias("tokens"))
    subsets = tokens.select(F.explode(F.expr("flatten(transform(tokens, (x, i) -> transform(slice(tokens, i + 2, size(tokens)), y -> xxhash64(x, y))))")).alias("key"), "class", "size")
    subsets = written(subsets.withColumn("place", F.lit(-1)))
    met = subsets.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("length")).filter("low <> high")
    return large.union(subsets.join(met, "key").select("key", "class", "size", "place", "length"))


def _can_link(a: str, b: str) -> str:
    """Sizes that allow the threshold."""
    return f"{SHARE[1]} * least({a}, {b}) >= {SHARE[0]} * greatest({a}, {b})"


def _prefix(size: str) -> str:
    return f"({size} - ceil({SHARE[0]} * {size} / {SHARE[1]}) + 1)"


def _sure(a: str, b: str) -> str:
    """How many tokens linked sets of these sizes have in both prefixes, at least.

    Of the tokens that they share, the first k are at most ``k - 1 + size - overlap`` places from the start of either, so
    those with places below the prefix length meet: ``prefix - (size - overlap)`` of them at least, for either set.
    """
    overlap = f"ceil({SHARE[0]} * ({a} + {b}) / {SHARE[0] + SHARE[1]})"
    return f"least({_prefix(a)} - ({a} - {overlap}), {_prefix(b)} - ({b} - {overlap}))"


def _enough_met(a: str, b: str, n: str, listed: int) -> str:
    """Whether two sets that meet under at most ``n`` keys can link, for sets that file whole prefixes (``listed`` tokens or more)."""
    return f"least({a}, {b}) < {listed} or {n} >= {_sure(a, b)}"


def pairs_of_short_lists(key: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, size_a, size_b, n), a < b: the pairs of classes that meet under a key and may link, and under how many keys of tokens.

    Sets share at most as many tokens before one that they meet under as the lower of its places tells, and at most as many behind it as
    the shorter rest has; keys that leave too few so are not counted for a pair, as linked sets meet under no such key. Subsets (place -1) tell no place.
    """
    by_key = np.lexsort((name, key))
    key, name, size, place = key[by_key], name[by_key], size[by_key].astype(np.int64), place[by_key].astype(np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    for apart in range(1, len(key)):
        one = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(one):
            break
        other = one + apart
        a, b, at, to = size[one], size[other], place[one], place[other]
        overlap = -(-SHARE[0] * (a + b) // (SHARE[0] + SHARE[1]))
        enough = (at < 0) | (to < 0) | (np.minimum(at, to) + np.minimum(a - at, b - to) >= overlap)
        good = enough & (name[one] != name[other]) & (SHARE[1] * np.minimum(a, b) >= SHARE[0] * np.maximum(a, b))
        one, other = one[good], other[good]
        found.append((name[one], name[other], size[one], size[other], (place[one] >= 0) & (place[other] >= 0)))
    if not found:
        return (np.empty(0, np.int64),) * 5
    a, b, size_a, size_b, counts = (np.concatenate(column) for column in zip(*found))
    by_pair = np.lexsort((b, a))
    a, b = a[by_pair], b[by_pair]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    n = np.add.reduceat(counts[by_pair].astype(np.int64), new) if len(new) else np.empty(0, np.int64)
    return a[new], b[new], size_a[by_pair][new], size_b[by_pair][new], n


def _pairs_of_short_lists(met: DataFrame, longs: DataFrame, listed: int) -> DataFrame:
    """(a, b, size_a, size_b, n), a < b: the pairs of classes that meet under keys of short lists and can link.

    With as many more keys as both have in long lists, those under which they meet must be enough.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        held = 0

        def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs_of_short_lists(*rows)], ["a", "b", "size_a", "size_b", "n"])

        for batch in batches:  # sorted by key: the last one's rows wait for those to come
            waiting.append([batch[name].to_numpy() for name in ("key", "class", "size", "place")])
            held += batch.num_rows
            if held >= PAIRED_ROWS:
                rows = [np.concatenate(column) for column in zip(*waiting)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))
                if whole:
                    yield pairs([column[:whole] for column in rows])
                waiting = [[column[whole:] for column in rows]]
                held = len(waiting[0][0])
        if held:
            yield pairs([np.concatenate(column) for column in zip(*waiting)])

    short = met.filter(f"length <= {LONG_LIST}").select("key", "class", "size", "place").repartition("key").sortWithinPartitions("key")
    pairs = short.mapInArrow(paired, "a long, b long, size_a long, size_b long, n long")
    pairs = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b")))
    sure = pairs.filter(_enough_met("size_a", "size_b", "n", listed))
    # The others need their keys in long lists, which few classes have.
    more = pairs.filter(f"not ({_enough_met('size_a', 'size_b', 'n', listed)})")
    for x in "ab":
        more = more.join(longs.select(F.col("class").alias(x), F.col("longs").alias(f"longs_{x}")), x)
    more = more.filter(_enough_met("size_a", "size_b", "n + least(longs_a, longs_b)", listed))
    columns = ("a", "b", "n", "size_a", "size_b")
    return sure.select(*columns).union(more.select(*columns))


def _differ(a: str = "a", b: str = "b") -> str:
    """In how many bits two sketches differ."""
    return " + ".join(f"bit_count(s{k}_{a} ^ s{k}_{b})" for k in range(SKETCH // 64))


def _sketches(bodies: DataFrame) -> DataFrame:
    return bodies.select("class", *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH // 64)))


#: Whether sketches differ by no more than those of linked sets can.
_SKETCHES_ALLOW = f"{SHARE[0] + SHARE[1]} * ({_differ()}) <= {SHARE[1] - SHARE[0]} * (size_a + size_b)"


def _may_link(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches do not differ by more than linked sets can."""
    columns = pairs.columns
    for x in "ab":
        pairs = pairs.join(sketches.toDF(x, *(f"s{k}_{x}" for k in range(SKETCH // 64))), x)
    return pairs.filter(_SKETCHES_ALLOW).select(columns)


def _pairs_of_long_lists(apart: DataFrame, longs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of classes in different components that can link, of those that share keys of long lists only.

    They must have the first of these early enough in both
    prefixes for the others to follow it (a long list of a subset tells nothing of the kind), and sketches that do not differ by more than linked sets can.
    Sizes more than one band apart allow no link, so that only rows of a key in neighbouring bands meet.
    """
    rows = apart.join(longs, "class", "left").withColumn("longs", F.coalesce("longs", F.lit(0))).withColumn("band", F.floor(F.log("size") / math.log(SIZE_BAND)))
    one, other = (rows.select("key", "band", F.col("class").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "place", "part", "longs"))) for x in "ab")
    other = other.withColumn("band", F.explode(F.expr("sequence(band - 1, band + 1)")))
    sure = _sure("size_a", "size_b")
    early = f"least(longs_a, longs_b) >= {sure} and place_a <= {_prefix('size_a')} - {sure} and place_b <= {_prefix('size_b')} - {sure}"
    behind = f"{SHARE[0] + SHARE[1]} * (least(place_a, place_b) + least(size_a - place_a, size_b - place_b)) >= {SHARE[0]} * (size_a + size_b)"
    many = (
        one.join(other, ["key", "band"]).filter("a < b and part_a <> part_b").filter(_can_link("size_a", "size_b"))
        .filter(f"place_a < 0 or {behind} and {early}").groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    )
    return _may_link(many, sketches).select("a", "b")


def _linked(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, by their whole texts; a pair's texts are compared once."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in (whole.slice(start, COMPARED) for whole in batches for start in range(0, whole.num_rows, COMPARED)):
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            if held > REMEMBERED:
                known, held = {}, 0
            new = {name: (text, i) for text, names in (("text_a", a), ("text_b", b)) for i, name in enumerate(names) if name not in known}
            for name, (tokens, _) in zip(new, _sets(pa.array([batch[text][i].as_py() for text, i in new.values()], pa.binary()))):
                known[name] = tokens
                held += len(tokens)
            links = []
            for i in range(batch.num_rows):
                one, other = known[a[i]], known[b[i]]
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if SHARE[1] * shared >= SHARE[0] * (len(one) + len(other) - shared):
                    links.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    found = bodies.select("class", "text")
    wanted = written(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct())
    if wanted.count() <= BROADCAST_ROWS:  # no other texts are moved
        found = written(found.join(F.broadcast(wanted), "class", "left_semi"))
    # Joins between two exchanges: adaptive execution splits the rows of a hot b.
    with_both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(compared, "a long, b long")


def _with_parts(met: DataFrame, components: DataFrame | None) -> DataFrame:
    """The meetings with ``part``, the component of each class; itself before there are links."""
    if components is None:
        return met.withColumn("part", F.col("class"))
    joined = small_enough(written(components).withColumnRenamed("node", "class"))
    return met.join(joined, "class", "left").withColumn("part", F.coalesce("component", "class")).drop("component")


def _apart_pairs(pairs: DataFrame, components: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of classes in different components."""
    if components is None:
        return pairs
    columns, joined = pairs.columns, small_enough(written(components))
    for x in "ab":
        pairs = pairs.join(joined.toDF(x, f"part_{x}"), x, "left")
    return pairs.filter("coalesce(part_a, a) <> coalesce(part_b, b)").select(columns)


def _pivot_pairs(parts: DataFrame, turn: int) -> DataFrame:
    """(a, b, n, size_a, size_b), a < b: pairs of a class and one of its keys' pivots in another component, by the keys that offer them.

    A key's pivots are its first classes by ``PIVOTS`` hash orders, other ones each turn: minima over the key.
    """
    order = lambda k: F.struct(F.xxhash64("class", F.lit(turn * PIVOTS + k)), "class", "size", "part")
    of_key = parts.groupBy("key").agg(*(F.min(order(k)).alias(f"pivot{k}") for k in range(PIVOTS)))
    of_key = of_key.select("key", F.array_distinct(F.array(*(f"pivot{k}" for k in range(PIVOTS)))).alias("pivots"))
    parts = parts.join(of_key, "key")
    offered = parts.select("class", "size", "part", "pivots").withColumn("pivot", F.explode("pivots"))
    # Two pivots of one key offer their pair to each other: the smaller one's offer counts.
    once = F.expr("class < pivot.class or not exists(pivots, x -> x.class = class)")
    apart = offered.filter("part <> pivot.part").filter(once).filter(_can_link("size", "pivot.size"))
    own, other = F.struct("class", "size"), F.struct("pivot.class", "pivot.size")
    low, high = F.least(own, other), F.greatest(own, other)
    pair = apart.select(low["class"].alias("a"), high["class"].alias("b"), low["size"].alias("size_a"), high["size"].alias("size_b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))


def _most_met(candidates: DataFrame) -> DataFrame:
    """Of the pairs (a, b, n), those that are among the ``PIVOTS`` most met of either class."""
    both = candidates.select(F.col("a").alias("of"), "a", "b", "n").union(candidates.select(F.col("b").alias("of"), "a", "b", "n"))
    # A pivot of thousands has as many rows here: the most met are taken of each of its dealt groups first, then of those.
    for of in (("of", "dealt"), ("of",)):
        place = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("n"), "a", "b"))
        both = both.withColumn("dealt", F.pmod(F.xxhash64("a", "b"), F.lit(DEALT))).withColumn("place", place).filter(f"place <= {PIVOTS}")
    return both.select("a", "b").distinct()


def _apart(parts: DataFrame) -> DataFrame:
    """The meetings under keys where more than one component meets."""
    wide = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return parts.join(wide.filter("low <> high").select("key"), "key")


def _bodies(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(class, text, sketch) of the representatives of the classes in ``members`` (class, doc_id), one row each."""
    wanted = members.select("doc_id").distinct()
    found = docs.join(small_enough(written(wanted)), "doc_id", "left_semi")
    schema = "class long, text binary, sketch array<long>"

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, cells, places = [], [], []
            for place, (tokens, _) in enumerate(_sets(batch["text"])):
                if len(tokens) and (name := class_of(tokens)) not in seen:
                    seen.add(name)
                    names.append(name)
                    cells.append(sketch(tokens))
                    places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch["text"].take(pa.array(places, pa.int64())), pa.array(cells, pa.list_(pa.int64()))], ["class", "text", "sketch"])

    bodies = written(found.select("text").mapInArrow(named, schema).withColumn("row", F.monotonically_increasing_id()))
    # Equal texts of several tasks: the first row stays.
    repeated = written(bodies.groupBy("class").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").select("class", "first"))
    return bodies.join(small_enough(repeated), "class", "left").filter("first is null or row = first").select("class", "text", "sketch")


def classes_and_components(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """For a frame of doc_id, text (binary) and the columns to ``keep``: these without the text, and n_words, n_shingles, class, component
    (the class by which it goes) and component_id, as components of rows that share an id share a component_id."""
    measured, counted = _measure(rows, keep)
    classes = written(measured.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size")))
    heavy, weight = _heavy(counted)
    # Classes of rows that have an id, so that every meeting can be looked up.
    tokens = classes.filter("size > 1").agg(F.sum(F.expr(f"{_prefix('size')} + 1"))).first()[0] or 0
    lists = _lists(_file_prefixes(rows.filter("doc_id is not null").select("text"), heavy, weight, max(BUCKETS, -(-tokens // BUCKET_ROWS))))
    kept = _kept_tokens(lists)
    boundary = choose_boundary(_costs(lists, kept))
    met = written(_filed_by_size(lists, kept, boundary))
    listed = least_overlap(boundary + 1)
    long_rows = written(met.filter(f"length > {LONG_LIST}").select("key", "class", "size", "place"))
    longs = small_enough(written(long_rows.filter("place >= 0").groupBy("class").agg(F.count("*").alias("longs"))))
    pairs = written(_pairs_of_short_lists(met, longs, listed))
    nodes = written(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(long_rows.select("class")).distinct())
    bodies = _bodies(rows.select("doc_id", "text"), classes.join(nodes, "class", "left_semi"))
    sketches = written(_sketches(bodies))
    pairs = written(_may_link(pairs, sketches))

    tried = links = components = None
    for turn in range(ROUNDS):
        offered = _may_link(_pivot_pairs(_with_parts(long_rows, components), turn), sketches)
        candidates = _apart_pairs(pairs, components).unionByName(offered).groupBy("a", "b").agg(F.sum("n").alias("n"))
        if tried is not None:
            candidates = candidates.join(tried, ["a", "b"], "left_anti")
        now = written(_most_met(candidates))
        found = written(_linked(now, bodies))
        tried, links = (now, found) if tried is None else (tried.union(now), links.union(found))
        components = connected_components(links)
    rest = _pairs_of_long_lists(_apart(_with_parts(long_rows, components)), longs, sketches).union(_apart_pairs(pairs, components).select("a", "b"))
    all_links = links.union(_linked(written(rest.distinct().join(tried, ["a", "b"], "left_anti")), bodies))

    linked = written(connected_components(all_links)).withColumnRenamed("node", "class")
    linked = classes.join(linked, "class", "left").select("class", "doc_id", F.coalesce("component", "class").alias("component"))
    first = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(linked.join(written(first), "component").select("class", "component", "component_id"))
    return measured.join(named, "class", "left").select(
        "doc_id", *keep, "n_words", F.col("size").alias("n_shingles"), "class", "component",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _components(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return classes_and_components(texts(docs, id_column, text_column).withColumn("text", F.col("text").cast("binary")))


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set), component_id (smallest doc_id reachable by links)."""
    return _components(docs, id_column, text_column).select("doc_id", "n_shingles", "class", "component_id")


def _with_class(docs: DataFrame, text_column: str, name: str) -> DataFrame:
    """``docs`` and the class of each row's text."""
    place = docs.columns.index(text_column)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([class_of(tokens) if len(tokens) else None for tokens, _ in _sets(batch.column(place).cast(pa.binary()))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], [*batch.schema.names, name])

    return docs.mapInArrow(named, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of ``docs``: one with its smallest doc_id.

    Rows without doc_id stay, and so do rows without words, wholly repeated ones once. The ids to drop are broadcast if they are few, else
    joined by a shuffle. Rows whose id is repeated are told apart by the class of their text, as one id may be in several groups.
    """
    found = written(_components(docs, id_column, text_column))
    drop = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct())
    repeated = written(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_column)))
    if repeated.isEmpty():
        return docs.join(small_enough(drop), id_column, "left_anti").select(docs.columns)
    repeated = small_enough(repeated)
    once = docs.join(repeated, id_column, "left_anti").join(small_enough(drop), id_column, "left_anti").select(docs.columns)
    name = max(docs.columns, key=len) + "_class"
    first = found.filter("doc_id = component_id and class is not null").groupBy("component").agg(F.min("doc_id").alias(id_column), F.min("class").alias(name))
    first = written(first.join(repeated, id_column, "left_semi").select(id_column, name))
    rows = _with_class(docs.join(repeated, id_column, "left_semi").select(docs.columns), text_column, name)
    worded = rows.filter(F.col(name).isNotNull()).join(small_enough(first), [id_column, name], "left_semi").dropDuplicates([id_column, name])
    empty = rows.filter(F.col(name).isNull()).dropDuplicates([id_column, text_column])
    return once.union(worded.select(docs.columns)).union(empty.select(docs.columns))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and components of every document."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
