"""Words of many texts at once, and their XXH3 hashes, in NumPy.

Words are runs of anything but space, tab, LF, VT, FF and CR, with A-Z lower-cased, as ``bytes.lower().split()`` gives them. A call of the
hash library for each word costs more than all other work on a text, so words of up to 16 bytes are hashed in columns; the values are the library's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_IN_WORD = bytes(byte not in b"\t\n\v\f\r " for byte in range(256))

# XXH3's constants for inputs of up to 16 bytes without a seed.
_FLIP_3, _FLIP_8 = np.uint64(0x87275A9B), np.uint64(0xC73AB174C5ECD5A2)
_FLIP_LOW, _FLIP_HIGH = np.uint64(0x6782737BEA4239B9), np.uint64(0xAF56BC3B0996523A)
_PRIME_MX1, _PRIME_MX2 = np.uint64(0x165667919E3779F9), np.uint64(0x9FB21C651E98DF25)
_PRIME_2, _PRIME_3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_HALF = np.uint64(0xFFFFFFFF)


def _shifted(values: np.ndarray, bits: int) -> np.ndarray:
    return values ^ (values >> np.uint64(bits))


def _rolled(values: np.ndarray, bits: int) -> np.ndarray:
    return (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def _folded_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two halves of the 128-bit products, one xor the other."""
    bits = np.uint64(32)
    a_low, a_high, b_low, b_high = a & _HALF, a >> bits, b & _HALF, b >> bits
    low, cross, other = a_low * b_low, a_high * b_low, a_low * b_high
    middle = (low >> bits) + (cross & _HALF) + (other & _HALF)
    return (a * b) ^ (a_high * b_high + (cross >> bits) + (other >> bits) + (middle >> bits))


def _up_to_3(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    first, middle, last = (data[at].astype(np.uint64) for at in (begin, begin + (size >> 1), end - 1))
    mixed = ((first << np.uint64(16)) | (middle << np.uint64(24)) | last | (size.astype(np.uint64) << np.uint64(8))) ^ _FLIP_3
    return _shifted(_shifted(_shifted(mixed, 33) * _PRIME_2, 29) * _PRIME_3, 32)


def _up_to_8(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    four = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    mixed = (four[end - 4].astype(np.uint64) + (four[begin].astype(np.uint64) << np.uint64(32))) ^ _FLIP_8
    mixed ^= _rolled(mixed, 49) ^ _rolled(mixed, 24)
    mixed *= _PRIME_MX2
    mixed ^= (mixed >> np.uint64(35)) + (end - begin).astype(np.uint64)
    return _shifted(mixed * _PRIME_MX2, 28)


def _up_to_16(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low, high = eight[begin] ^ _FLIP_LOW, eight[end - 8] ^ _FLIP_HIGH
    mixed = (end - begin).astype(np.uint64) + low.byteswap() + high + _folded_product(low, high)
    return _shifted(_shifted(mixed, 37) * _PRIME_MX1, 32)


def _longer(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    words = (data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist()))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(begin))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts (binary; null: none), and each text's number of words."""
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    lower = texts.buffers()[2].slice(int(bounds[0]), size).to_pybytes().lower()
    bounds = bounds - bounds[0]
    within = np.frombuffer(lower.translate(_IN_WORD), bool)
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    starts, ends = bounds[:-1][bounds[:-1] < size], bounds[1:][bounds[1:] > 0] - 1
    first[starts], last[ends] = within[starts], within[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n_words = np.diff(np.searchsorted(begin, bounds))

    lengths, hashes = end - begin, np.empty(len(begin), np.uint64)
    data = np.frombuffer(lower + bytes(8), np.uint8)
    for least, most, hashed in ((1, 3, _up_to_3), (4, 8, _up_to_8), (9, 16, _up_to_16), (17, size, _longer)):
        some = np.flatnonzero((lengths >= least) & (lengths <= most))
        hashes[some] = hashed(data, begin[some], end[some])
    return hashes, n_words
