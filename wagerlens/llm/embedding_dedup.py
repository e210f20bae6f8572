"""Embedding near-duplicates (operator 2): iterative quantisation, hash tables of several code sets, exact rerank.

A rotation is learnt on a bounded sample (``SAMPLE`` distinct vectors, the first by a hash) so that the signs of the rotated
principal components make balanced binary codes that lose little; further code sets are learnt alike, each from a random start of its own.
Consecutive bits of the sets are the keys of the tables, and two vectors meet if they share the key of one table. Length and number of
the tables follow from synthetic neighbours of the sample at the threshold itself: at least ``RECALL`` of them have to
meet, whatever the number of vectors and wherever their centre, and of all such choices the cheapest for this number is taken. Pairs that
meet are passed on if their codes differ in no more bits than any such neighbours do, and decided by the cosine of
the given vectors in double precision. Links found are exact; recall against brute force is measured in the tests.

Equal vectors are one class from the start, however many they are, so only pairs of different vectors are looked at.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows without
an id (their component_id and kept are null); shorter vectors count as padded with zeros; repeated rows are equal vectors; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.common import small_enough, table, written
from wagerlens.llm.components import connected_components

THRESHOLD = 0.95
SAMPLE, ROTATIONS = 20_000, 30
BITS = 64
#: The least share of pairs at the threshold that meet in a table, and how many synthetic pairs of each kind tell.
RECALL, TRIALS = 0.999, 4096
#: What a row filed in a table costs, in pairs compared; bounds of the planes (bits of all tables) and of a key.
ROW_COST, MOST_PLANES, LONGEST = 32, 8192, 40
#: Rows whose bits are computed at once.
CODED_ROWS = 1000
#: Components of the vectors that a task looks at together.
MATRIX = 1 << 22


@dataclass(frozen=True)
class Quantiser:
    """Centre of the sample and the learnt projection (width x bits)."""

    centre: np.ndarray
    projection: np.ndarray

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """One 64-bit code for each row, as signed integers; unused high bits are 0."""
        bits = (_unit(rows) - self.centre) @ self.projection > 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def _unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def rotation_for(reduced: np.ndarray, start: int, turns: int = ROTATIONS) -> np.ndarray:
    """A rotation of the rows towards the corners of the cube, learnt from the random rotation numbered ``start``."""
    bits = reduced.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(start).normal(size=(bits, bits)))[0]
    for _ in range(turns):
        corners = np.where(reduced @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ corners)
        rotation = left @ right
    return rotation


def for_learning(rows: np.ndarray) -> np.ndarray:
    """The rows that code sets are learnt from: all but the first ``TRIALS``, on which the tables are tried, unless too few are left."""
    return rows[TRIALS:] if len(rows) >= 2 * TRIALS else rows


def learn(rows: np.ndarray, bits: int = BITS, turns: int = ROTATIONS) -> Quantiser:
    """Iterative quantisation: principal components, then a learnt rotation of them."""
    width = rows.shape[1]
    bits = min(bits, width)
    units = _unit(rows)
    centre = units.mean(axis=0)
    centred = units - centre
    _, _, axes = np.linalg.svd(centred.T @ centred)
    projection = axes[:bits].T
    return Quantiser(centre, projection @ rotation_for(centred @ projection, 0, turns))


@dataclass(frozen=True)
class Index:
    """Planes of the tables (width x tables * length), and the most bits in which codes of compared vectors differ."""

    centre: np.ndarray
    planes: np.ndarray
    tables: int
    length: int
    far_bits: int

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """The key of each row in each table; the table's number is part of it."""
        bits = ((_unit(rows) - self.centre) @ self.planes > 0).reshape(len(rows), self.tables, self.length)
        return bits @ (1 << np.arange(self.length, dtype=np.int64)) + (np.arange(self.tables, dtype=np.int64) << LONGEST)


def neighbours(units: np.ndarray, threshold: float, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine is the threshold: apart in any direction, and in directions in which ``units`` differ."""
    ways = [draw.normal(size=units.shape), units[draw.permutation(len(units))] - units]
    apart = np.concatenate(ways)
    units = np.concatenate([units, units])
    apart -= (apart * units).sum(axis=1, keepdims=True) * units
    norm = np.linalg.norm(apart, axis=1, keepdims=True)
    known = norm[:, 0] > 1e-9
    units, apart = units[known], apart[known] / norm[known]
    return units, threshold * units + math.sqrt(max(0.0, 1 - threshold**2)) * apart


def choose_index(rows: np.ndarray, quantiser: Quantiser, count: int, threshold: float = THRESHOLD) -> Index:
    """The cheapest tables for ``count`` vectors like ``rows`` in which ``RECALL`` of the pairs at the threshold meet.

    Keys of no bits, under which all pairs meet, are the first choice looked at, so there always is one.
    """
    draw = np.random.default_rng(1)
    units = _unit(rows[:TRIALS])
    ones, others = neighbours(units, threshold, draw)
    kinds = np.arange(len(ones)) < len(ones) / 2
    bits = quantiser.projection.shape[1]
    far_bits = int(np.bitwise_count((quantiser.codes(ones) ^ quantiser.codes(others)).view(np.uint64)).max(initial=0)) + 1
    reduced = (_unit(for_learning(rows)) - quantiser.centre) @ quantiser.projection
    sets, flips, signs = [], [], []

    def planes_for(number: int) -> None:
        """Code sets for so many planes at least, their flips between neighbours and signs of the sample."""
        while len(sets) * bits < number:
            sets.append(quantiser.projection @ rotation_for(reduced, len(sets)) if sets else quantiser.projection)
            flips.append(((ones - quantiser.centre) @ sets[-1] > 0) != ((others - quantiser.centre) @ sets[-1] > 0))
            signs.append((units - quantiser.centre) @ sets[-1] > 0)

    def columns(found: list[np.ndarray], table: int, length: int) -> np.ndarray:
        first, last = table * length // bits, -(-(table + 1) * length // bits)
        wide = np.concatenate(found[first:last], axis=1) if length else np.zeros((len(found[0]), 0), bool)
        return wide[:, table * length - first * bits :][:, :length]

    def met_by(length: int, most: float) -> int | None:
        """How many tables of this key length are needed, if not more than ``most``."""
        met, tables = np.zeros(len(ones), bool), 0
        while tables < 1 or any(len(part) and part.mean() < RECALL for part in (met[kinds], met[~kinds])):
            if tables + 1 > most or (tables + 1) * length > MOST_PLANES:
                return None
            planes_for(max(1, (tables + 1) * length))
            met |= ~columns(flips, tables, length).any(axis=1)
            tables += 1
        return tables

    def shared(length: int, tables: int) -> float:
        """The share of all pairs of the sample that have the same key in a table."""
        size, found = len(units), []
        for t in range(min(tables, 4)):
            keys = columns(signs, t, length) @ (1 << np.arange(length, dtype=np.int64))
            times = np.unique(keys, return_counts=True)[1]
            found.append((times * (times - 1.0)).sum() / max(1, size * (size - 1)))
        return sum(found) / len(found)

    best, chosen = math.inf, (1, 0)
    for length in range(LONGEST + 1):
        tables = met_by(length, best / ROW_COST)
        if tables is None:
            break
        cost = tables * (ROW_COST + count * shared(length, tables))
        if cost < best:
            best, chosen = cost, (tables, length)
    tables, length = chosen
    planes_for(max(1, tables * length))
    return Index(quantiser.centre, np.concatenate(sets, axis=1)[:, : tables * length], tables, length, far_bits)


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``; null components are NaN."""
    lengths, values = _lengths(column), column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(column), width).astype(float)
    rows = np.zeros((len(column), width))
    rows[np.arange(width) < lengths[:, None]] = values
    return rows


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows that are looked at together: their matrix is bounded, however long some rows are."""
    lengths = _lengths(column)
    step = max(1, min(CODED_ROWS, MATRIX // max(1, int(lengths.max(initial=1)))))
    return ((start, min(start + step, len(column))) for start in range(0, len(column), step))


def distinct_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, class) of every row, the class null where the row links with nothing; and (class, vec_id, n, vector)."""
    given = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    kind = given.schema["vec_id"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(batch["vector"]):
                part = batch.slice(start, stop - start)
                lengths = _lengths(part["vector"])
                rows = _matrix(part["vector"], int(lengths.max(initial=0))) + 0.0  # -0 becomes 0
                used = rows != 0
                good = np.isfinite(rows).all(axis=1) & used.any(axis=1) & ~np.asarray(part["vec_id"].is_null())
                sizes = np.where(good, rows.shape[1] - used[:, ::-1].argmax(axis=1), 0) if rows.shape[1] else lengths
                names = [int(np.uint64(xxhash.xxh3_64_intdigest(row[:size].tobytes())).astype(np.int64)) if size else None for row, size in zip(rows, sizes)]
                kept = rows[np.arange(rows.shape[1]) < sizes[:, None]]
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                vectors = pa.ListArray.from_arrays(ends, pa.array(kept, pa.float64()), mask=pa.array(~good))
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(names, pa.int64()), vectors], ["vec_id", "class", "vector"])

    rows = written(given.mapInArrow(named, f"vec_id {kind}, class long, vector array<double>"))
    classes = rows.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    return rows.select("vec_id", "class"), written(classes)


def meeting_pairs(codes: DataFrame, far_bits: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share a key and whose codes differ in at most ``far_bits`` bits; each pair once."""
    filed = codes.select("class", "code", F.explode("keys").alias("key"))
    both = filed.toDF("a", "code_a", "key").join(filed.toDF("b", "code_b", "key"), "key")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= far_bits)
    return both.filter(near).select("a", "b").distinct()


def _similar(pairs: DataFrame, classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs whose given vectors have a cosine of at least ``threshold``."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), CODED_ROWS):
                some = batch.slice(start, CODED_ROWS)
                cosine = (_unit(_matrix(some["vector_a"], width)) * _unit(_matrix(some["vector_b"], width))).sum(axis=1)
                near = pa.array(cosine >= threshold)
                yield pa.RecordBatch.from_arrays([some["a"].filter(near), some["b"].filter(near), pa.array(cosine).filter(near)], ["a", "b", "cosine"])

    vectors = classes.select("class", "vector")
    with_a = pairs.join(vectors.toDF("a", "vector_a"), "a")
    return with_a.join(vectors.toDF("b", "vector_b"), "b").select("a", "b", "vector_a", "vector_b").mapInArrow(ranked, "a long, b long, cosine double")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each given row."""
    rows, classes = distinct_vectors(vectors, id_column, vector_column)
    count, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if count:
        drawn = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("vector").toPandas()["vector"]
        fitted = np.zeros((len(drawn), width))
        for i, values in enumerate(drawn):
            fitted[i, : len(values)] = values
        quantiser = learn(for_learning(fitted))
        index = choose_index(fitted, quantiser, count, threshold)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), CODED_ROWS):
                    some = batch.slice(start, CODED_ROWS)
                    rows = _matrix(some["vector"], width)
                    found = index.keys(rows)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([some["class"], pa.array(quantiser.codes(rows)), keys], ["class", "code", "keys"])

        codes = written(classes.select("class", "vector").mapInArrow(coded, "class long, code long, keys array<long>"))
        pairs = written(meeting_pairs(codes, index.far_bits))
        links = written(_similar(pairs, classes, width, threshold).select("a", "b"))
    else:
        links = vectors.sparkSession.createDataFrame([], "a long, b long")
    times = classes.select("class", "n")
    linked = (
        links.union(links.select("b", "a")).toDF("class", "other")
        .join(times.toDF("other", "n"), "other").groupBy("class").agg(F.sum("n").alias("others"))
    )
    joined = connected_components(links).withColumnRenamed("node", "class")
    each = classes.select("class", "vec_id", "n").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    each = written(each.join(linked, "class", "left"))
    first = written(each.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    each = written(each.join(small_enough(first), "component").select("class", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    found = rows.join(small_enough(each), "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
