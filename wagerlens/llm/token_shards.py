"""Token ids in training order (operator 7): a keyed permutation, fixed-stride shards, resumable reads.

Documents become one stream of ids for each input split, every document followed by the end id, cut into sequences of
``length`` ids; a split's last sequence is padded with the end id. The texts are tokenised once: their sequences are written in compressed
groups, and counted by split (one number a split), so that all can be numbered from 0 to N - 1 without a global sort. A keyed Feistel
network over the next even number of bits, walked until it falls below N, is a permutation of those numbers: it gives each
sequence its slot in training order, with no table and no shuffle of its own.

The sequences of a group that go to one shard, a range of slots, travel together and compressed. Each task gets a range of shards, sorts
their slots and writes them by Spark's text writer: a record is the sequence's
little-endian 16-bit ids and a newline byte, so slot s is at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``. A reader
that stopped at a slot goes on from it (``read_slots``); a task that is lost is run again and its file committed once.

Defined cases: null and
empty texts are a lone end id; special strings in texts are ordinary text; a row without doc_id counts like any other
and is null in ``doc_ids``; repeated rows are written repeatedly; very long texts span many sequences; no rows write no shard and
give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.bpe_count import PRETOKEN
from wagerlens.llm.common import resident, shared_folder, table, texts, version, written

LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 8192, 0x5EED, 4
MAX_RANKS = 60_000
#: Sequences that are compressed together, groups that are dealt together, and tasks that write shards at most.
GROUP, GROUPS, WRITERS = 128, 8, 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file; ids and the end id must fit 16 bits."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    if len(ranks) > MAX_RANKS or max(ranks.values()) + 1 >= 1 << 16:
        raise ValueError("ids do not fit 16 bits")
    return ranks


def id_writer(ranks: dict[bytes, int]) -> Callable[[str], bytes]:
    """A function from a text to its ids as 16-bit integers."""
    import tiktoken

    if sys.byteorder != "little":
        raise RuntimeError("records are little-endian")
    library = tiktoken.Encoding("given", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: library.encode_to_numpy(text, disallowed_special=()).astype(np.uint16).tobytes()


def feistel(index: np.ndarray, count: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of sequence numbers: a permutation of 0 .. count - 1 for each key."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(values: np.ndarray) -> np.ndarray:
        left, right = values >> np.uint64(half), values & mask
        for turn in range(rounds):
            mixed = right + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) % (1 << 64))
            for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(odd)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    slots = once(index.astype(np.uint64))
    while (out := slots >= np.uint64(count)).any():
        slots[out] = once(slots[out])  # walk the cycle until it is below the count
    return slots.astype(np.int64)


def _streams(write: Callable[[str], bytes], end: bytes, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, list]]:
    """A split's sequences of ``size`` bytes with the ids of the documents that they hold; the last may be shorter."""
    held, total, owners = [], 0, []
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            body = write(text.as_py() or "") + end
            held.append(body)
            total += len(body)
            owners.append(doc_id)
            if total >= size:
                stream = b"".join(held)
                whole = len(stream) // size * size
                yield stream[:size], owners
                for start in range(size, whole, size):
                    yield stream[start : start + size], [doc_id]
                rest = stream[whole:]
                held, total, owners = ([rest], len(rest), [doc_id]) if rest else ([], 0, [])
    if total:
        yield b"".join(held), owners


def write_shards(
    docs: DataFrame, path: str, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, int]:
    """Write the shards below ``folder``; return slot, sequence, n_tokens, doc_ids of every sequence, and how many there are."""
    spark = docs.sparkSession
    rows = texts(docs, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    size = 2 * length

    name = version("ranks", path)

    def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, end = resident(name, lambda: id_writer(ranks.value)), np.uint16(len(ranks.value)).tobytes()
        split, made, squeeze, kinds = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3).compress, []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds.append(batch["doc_id"].type)
                yield batch

        for group in _groups(_streams(write, end, noted(), size)):
            tokens = [len(body) // 2 for body, _ in group]
            body = b"".join(body for body, _ in group) + end * (length - tokens[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([split], pa.int32()), pa.array([made], pa.int64()), pa.array([len(group)], pa.int64()), pa.array([tokens], pa.list_(pa.int32())),
                 pa.array([[owners for _, owners in group]], pa.list_(pa.list_(kinds[0]))), pa.array([squeeze(body)], pa.binary())],
                ["split", "place", "n", "n_tokens", "doc_ids", "body"],
            )
            made += len(group)

    plan = written(rows.mapInArrow(staged, f"split int, place long, n long, n_tokens array<int>, doc_ids array<array<{kind}>>, body binary"))
    # One number for each input split: the only thing that is collected.
    first, count = {}, 0
    for split, n in sorted(tuple(row) for row in plan.groupBy("split").agg(F.sum("n")).collect()):
        first[split] = count
        count += n

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress

        def groups() -> Iterator[tuple[np.ndarray, bytes]]:
            for batch in batches:
                for split, place, n, body in zip(*(batch[c] for c in ("split", "place", "n", "body"))):
                    yield feistel(first[split.as_py()] + place.as_py() + np.arange(n.as_py()), count, key), unpack(body.as_py())

        for some in _groups(groups(), GROUPS):
            slots = np.concatenate([found for found, _ in some])
            order = np.argsort(slots)
            records = np.frombuffer(b"".join(body for _, body in some), np.uint8).reshape(-1, size)[order]
            shards, starts = np.unique(slots[order] // per_shard, return_index=True)
            for shard, a, b in zip(shards.tolist(), starts, [*starts[1:], len(order)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([slots[order[a:b]]], pa.list_(pa.int64())), pa.array([squeeze(records[a:b].tobytes())], pa.binary())], ["shard", "slots", "body"]
                )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, slots, body in zip(*(batch[c] for c in ("shard", "slots", "body"))):
                raw = unpack(body.as_py())
                records = [raw[k : k + size] for k in range(0, len(raw), size)]
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(records), pa.int32()), slots.values, pa.array(records, pa.binary())], ["shard", "slot", "record"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split, place, n, tokens, owners in zip(*(batch[c] for c in ("split", "place", "n", "n_tokens", "doc_ids"))):
                index = first[split.as_py()] + place.as_py() + np.arange(n.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(feistel(index, count, key)), pa.array(index), tokens.values, owners.values], ["slot", "sequence", "n_tokens", "doc_ids"])

    if count:
        shards = -(-count // per_shard)
        each = -(-shards // WRITERS)  # a task writes the shards of a range of slots
        records = plan.select("split", "place", "n", "body").mapInArrow(dealt, "shard int, slots array<long>, body binary")
        opened_rows = records.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).mapInArrow(opened, "shard int, slot long, record binary")
        (
            opened_rows.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("record"))
            .write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(folder)
        )
    return plan.drop("body").mapInArrow(placed, f"slot long, sequence long, n_tokens int, doc_ids array<{kind}>"), count


def _groups(items: Iterator, most: int = GROUP) -> Iterator[list]:
    while group := list(islice(items, most)):
        yield group


def read_slots(spark: SparkSession, folder: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, offset, body of the slots from ``start`` to before ``stop``; only the shards that hold them are read."""
    size = 2 * length
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    wanted = files.filter(F.col("shard").between(start // per_shard, max(start, stop - 1) // per_shard))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"]):
                body = memoryview(content.as_buffer())
                places = [k for k in range(len(body) // (size + 1)) if start <= shard * per_shard + k < stop]
                for some in (places[k : k + 1024] for k in range(0, len(places), 1024)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard * per_shard + k for k in some], pa.int64()), pa.array([shard] * len(some), pa.int64()),
                         pa.array([k * (size + 1) for k in some], pa.int64()), pa.array([bytes(body[k * (size + 1) :][:size]) for k in some], pa.binary())],
                        ["slot", "shard", "offset", "body"],
                    )

    return wanted.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(records, "slot long, shard long, offset long, body binary")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the corpus: its slot, where its record is, its documents, and the record's checksum as read back."""
    import public_tokenizers

    folder = shared_folder(spark)
    manifest, count = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), folder)
    if not count:
        nothing = F.lit(0).cast("long")
        return manifest.select("slot", nothing.alias("shard"), nothing.alias("offset"), "sequence", "n_tokens", "doc_ids", nothing.alias("crc"))
    back = read_slots(spark, folder, 0, count).select("slot", "shard", "offset", F.crc32("body").alias("crc"))
    return manifest.join(back, "slot").select("slot", "shard", "offset", "sequence", "n_tokens", "doc_ids", "crc")
