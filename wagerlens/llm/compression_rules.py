"""Quality rules (operator 8): base counts and zstandard compression bands.

The ratio of a text is its UTF-8 bytes over their zstandard size. Repetition raises it, noise
lowers it, and both depend on length, so each length has its own band. The band is
held by the whole document and by every fixed chunk of ``CHUNK_BYTES`` (a last chunk shorter than
``CHUNK_LEAST`` counts with the whole only). A document outside any band is rejected.

Defined cases: null and empty texts have no words, fail the base rule and are not kept;
documents with fewer bytes than the first band are not judged by compression; every given row
gives one row; no rows give no rows; other columns are ignored (``rules_frame``) or
kept (``apply_rules``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.common import table, texts

LEVEL, CHUNK_BYTES, CHUNK_LEAST = 3, 2048, 1024
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = b"#*$%&|<>"

#: From so many bytes on: the least ratio of a whole document, a curve that follows noise as it grows with length and stays below clean prose of 20 words or
#: more. Random base64 words have 0.88 at 64 bytes, 1.0 at 128, 1.31 at 1024 and 1.38 from 8 kB on; random words of a-z 1.62 at 1024 and 1.72 at most;
#: random hexadecimal words 1.9 at 4096 and 1.97 at most. Clean prose has 0.96 at least at 80 bytes, 1.02 at 128, 1.66 at 1024, 1.82 at 2048, 1.95 at
#: 4096, 2.16 at 8192 and 2.3 at 32 kB. So a-z words can be told from prose from 1024 bytes on and hexadecimal ones from 4096 on; base64 at any length
#: from 128 on. Texts shorter than the first band are hardly compressed at all, whatever they hold.
LEAST = (
    (64, 0.91), (80, 0.94), (96, 0.965), (112, 1.0), (128, 1.02), (144, 1.045), (160, 1.065), (176, 1.085), (192, 1.11), (224, 1.15),
    (256, 1.19), (320, 1.22), (384, 1.26), (448, 1.29), (512, 1.32), (600, 1.35), (700, 1.38), (850, 1.44),
    (1024, 1.65), (1280, 1.67), (1536, 1.71), (2048, 1.75), (2560, 1.78), (3072, 1.82), (4096, 1.93), (5120, 1.96), (6144, 2.0), (8192, 2.03), (16384, 2.06), (32768, 2.1),
)
#: The same for the greatest ratio, above repetition in clean prose.
MOST = ((0, 3.0), (512, 3.2), (1024, 3.6), (4096, 4.2), (16384, 5.0), (65536, 7.0))


def _at(size: int, steps: Sequence[tuple[int, float]]) -> float:
    return steps[bisect_right([step[0] for step in steps], size) - 1][1]


#: Least and greatest ratio by size: wherever one of the two changes.
WHOLE_BANDS = tuple((size, _at(size, LEAST), _at(size, MOST)) for size in sorted({step[0] for step in (*LEAST, *MOST) if step[0] >= LEAST[0][0]}))
#: The same for chunks, by the chunk's bytes.
CHUNK_BANDS = ((1024, 1.62, 3.6), (1536, 1.7, 3.6), (2048, 1.74, 4.2))

Band = tuple[int, float, float]
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """All limits of the rules."""

    whole: Sequence[Band] = WHOLE_BANDS
    chunk: Sequence[Band] = CHUNK_BANDS
    min_words: int = MIN_WORDS
    max_repeat_percent: int = MAX_REPEAT_PERCENT


def in_band(size: int, ratio: float, bands: Sequence[Band]) -> bool:
    """True below the first band's length, too."""
    place = bisect_right([band[0] for band in bands], size)
    return place == 0 or bands[place - 1][1] <= ratio <= bands[place - 1][2]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more; equal hashes are only a hint, the windows themselves decide."""
    size = len(words) - window + 1
    if size < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words))
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    hashes = np.zeros(size, np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0x100000001B3) + spread[k : k + size]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    hint = np.zeros(size, bool)
    hint[order[1:][same]] = hint[order[:-1][same]] = True
    places = np.flatnonzero(hint)
    _, which, times = np.unique(np.lib.stride_tricks.sliding_window_view(ids, window)[places], axis=0, return_inverse=True, return_counts=True)
    starts = places[times[which.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge_text(raw: bytes, pack: Callable[[bytes], bytes], limits: Limits) -> tuple:
    """One text's counts, base verdict, ratios (null where there is nothing to measure) and verdict."""
    words = raw.split()
    n_words = len(words)
    word_chars = len(raw.translate(None, _CONTINUATION + _SPACE))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    base_failed = n_words < limits.min_words or 100 * n_repeat > limits.max_repeat_percent * n_words
    size = len(raw)
    ratio = size / len(pack(raw)) if size else None
    fits = ratio is None or in_band(size, ratio, limits.whole)
    least = most = None
    for start in range(0, size, CHUNK_BYTES):
        chunk = raw[start : start + CHUNK_BYTES]
        if len(chunk) >= CHUNK_LEAST:
            part = len(chunk) / len(pack(chunk))
            least, most = (part, part) if least is None else (min(least, part), max(most, part))
            fits = fits and in_band(len(chunk), part, limits.chunk)
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, not base_failed and fits, ratio, least, most


_FIELDS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"), ("least_chunk_ratio", "double"), ("most_chunk_ratio", "double"),
)
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def rules_frame(docs: DataFrame, limits: Limits = Limits(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and the ratios of the whole and of the chunks."""
    rows = texts(docs, id_column, text_column).withColumn("text", F.col("text").cast("binary"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            found = [judge_text(raw or b"", pack, limits) for raw in batch["text"].to_pylist()]
            columns = zip(*found) if found else [[] for _ in _FIELDS]
            arrays = [pa.array(list(values), _ARROW[kind]) for values, (_, kind) in zip(columns, _FIELDS)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", *(name for name, _ in _FIELDS)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judged, f"doc_id {kind}, " + ", ".join(" ".join(field) for field in _FIELDS))


def apply_rules(docs: DataFrame, limits: Limits = Limits(), text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, without a join or a shuffle."""
    place = docs.columns.index(text_column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            raw = batch.column(place).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([judge_text(text or b"", pack, limits)[6] for text in raw], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and compression verdict of every document."""
    return rules_frame(table(spark, sf_dir, "documents"))
