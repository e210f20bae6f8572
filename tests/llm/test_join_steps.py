"""Steps of the n-gram join that work on many texts or list rows at once, against the plain ones."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wagerlens.llm import ngram_join as J
from wagerlens.llm.word_hashes import hashed_words

BYTES = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"a", b"Z", b"\xff", b"\xc3\x89", b"\x00", b"\x1c", b"\x85", b"\xa0", b"word", b"Longer0123456789"]


def odd_texts(draw):
    return [None if draw.random() < 0.1 else b"".join(draw.choice(BYTES) for _ in range(draw.choice([0, 1, 3, 10, 60]))) for _ in range(draw.randint(0, 12))]


def test_hashes_are_those_of_the_library():
    draw = random.Random(1)
    texts = [b" ".join(draw.randbytes(n).translate(bytes(range(33, 256)) + bytes(range(65, 98))) for _ in range(5)) for n in range(1, 40)]
    for texts in [texts, *(odd_texts(draw) for _ in range(200))]:
        hashes, counts = hashed_words(pa.array([b"before", *texts, b"behind"], pa.binary()).slice(1, len(texts)))
        words = [(text or b"").lower().split() for text in texts]
        assert hashes.tolist() == [xxhash.xxh3_64_intdigest(word) for found in words for word in found]
        assert counts.tolist() == [len(found) for found in words]


@pytest.mark.parametrize("words", [3, 5, 7])
@pytest.mark.filterwarnings("error")
def test_sets_of_many_texts(monkeypatch, words):
    monkeypatch.setattr(J, "PART_BYTES", 40)
    draw = random.Random(2)
    for _ in range(100):
        texts = odd_texts(draw)
        tokens, bounds, counts = J.shingled_texts(pa.array(texts, pa.binary()), words)
        parts = list(J._sets(pa.array(texts, pa.binary())))
        assert len(parts) == len(texts)
        for k, text in enumerate(texts):
            wanted, count = J.shingled(text, words)
            assert count == counts[k] == parts[k][1] and np.array_equal(wanted, tokens[bounds[k] : bounds[k + 1]])
            assert np.array_equal(parts[k][0], J.shingles(text))


def test_pairs_of_short_lists():
    """Linked sets are named with all keys that both prefixes hold; no other pair has more than it shares."""
    draw = random.Random(3)
    sets = []
    for group in range(40):
        base = draw.sample(range(2000), draw.choice([5, 8, 30, 90]))
        for _ in range(draw.randint(1, 4)):
            other = [x for x in base if draw.random() > 0.04] + draw.sample(range(2000), draw.randint(0, 3))
            sets.append(sorted(set(other)))
    prefixes = [s[: J.prefix_length(len(s), 1)] for s in sets]
    rows = [(key, name, len(sets[name]), place) for name, prefix in enumerate(prefixes) for place, key in enumerate(prefix)]
    draw.shuffle(rows)
    found = {(a, b): (x, y, n) for a, b, x, y, n in zip(*(column.tolist() for column in J.pairs_of_short_lists(*np.array(rows).T)))}
    linked = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            shared = len(set(prefixes[a]) & set(prefixes[b]))
            both = len(set(sets[a]) & set(sets[b]))
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                linked += 1
                assert found[a, b] == (len(sets[a]), len(sets[b]), shared)
            elif (a, b) in found:
                assert found[a, b][2] <= shared
    assert linked > 20
    assert [len(column) for column in J.pairs_of_short_lists(*np.empty((4, 0), np.int64))] == [0] * 5


def test_rows_of_a_bucket():
    """Lists of one class go, however often it is filed; a frequent token's classes stay, alone in their group or not."""
    rows = np.array([(5, 1, 9, 0, 1), (5, 1, 9, 0, 1), (6, 1, 9, 1, 1), (6, 2, 9, 0, 1), (6, 3, 9, 3, 1), (7, 4, 9, 0, 2)]).T
    kept, lengths = J._meeting(*rows)
    assert [tuple(rows[:2, k]) for k in kept] == [(6, 1), (6, 2), (6, 3), (7, 4)]
    assert lengths.tolist() == [2, 2, 2, J.LONG_LIST + 1]


def test_links_under_dealt_tokens_only(documents, words, monkeypatch):
    """Copies and one near copy, all of whose shared tokens are frequent and dealt to groups: one is often alone in the first group."""
    monkeypatch.setattr(J, "COUNT_LEAST", 2)
    monkeypatch.setattr(J, "TOKEN_ROWS", 2)
    rows = []
    for k in range(12):
        base = words(60, 4000 + k)
        rows += [(10 * k + copy, " ".join(base), "s") for copy in range(4)] + [(10 * k + 5, " ".join([*base, "more"]), "s")]
    found = {r.doc_id: r.component_id for r in J.jaccard_classes(documents(rows).coalesce(1)).collect()}
    assert found == {i: i - i % 10 for i, _, _ in rows}
