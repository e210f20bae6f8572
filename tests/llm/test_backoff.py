from __future__ import annotations

import math
from collections import Counter

import pytest

from tools.compare import difference, open_oracle
from wagerlens.llm import backoff as B


def brute(rows, order=3, least=2, alpha=0.4):
    texts = [(t or "").encode().lower().split() for _, t, _ in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))

    def score(words):
        if len(words) == 1:
            return counts[words] / total, 1
        if counts[words] >= least:
            return counts[words] / counts[words[:-1]], len(words)
        value, level = score(words[1:])
        return alpha * value, level

    found = []
    for (doc_id, _, _), w in zip(rows, texts):
        scores = [score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))]
        hits = Counter(level for _, level in scores)
        found.append((doc_id, len(w), [hits[n] for n in range(1, order + 1)], sum(math.log2(s) for s, _ in scores) if w else None))
    return found


@pytest.mark.parametrize("order, least, block", [(3, 2, 1 << 24), (3, 2, 900), (1, 1, 900), (4, 3, 2000), (2, 1, 1 << 24)])
def test_against_brute_force(spark, documents, odd_rows, words, monkeypatch, order, least, block):
    monkeypatch.setattr(B, "BLOCK_BYTES", block)
    rows = odd_rows + [(20 + k, " ".join(words(k * 7, k % 5, "ab")), "s") for k in range(30)]
    found = [tuple(r) for r in B.backoff_scores(documents(rows).repartition(3), order=order, min_count=least).collect()]
    wanted = brute(rows, order, least)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert len(found) == len(wanted)
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key)):
        assert a[:3] == b[:3] and a[3] == (b[3] if b[3] is None else pytest.approx(b[3], rel=1e-9))


def test_of_nothing(documents):
    assert B.backoff_scores(documents([])).count() == 0
    assert [tuple(r) for r in B.backoff_scores(documents([(1, None, "s"), (2, " ", "s")])).collect()] == [(1, 0, [0, 0, 0], None), (2, 0, [0, 0, 0], None)]


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert difference(B.op5_lm_scoring(spark, sf_dir), open_oracle(sf_dir), B.ORACLE_SQL) is None


def test_inputs_that_change_between_the_scans(documents, words):
    """Scores of other texts than were counted are refused."""
    docs = documents([(k, " ".join(words(20, k)), "s") for k in range(50)])

    def other(batches):
        import uuid

        for batch in batches:
            batch["text"] = [f"some words {uuid.uuid4()}" for _ in batch["text"]]
            yield batch

    changing = docs.mapInPandas(other, docs.schema)
    with pytest.raises(Exception, match="write the input as a table first"):
        B.backoff_scores(changing).collect()


def test_parts_follow_the_bytes(documents, words, monkeypatch):
    """Many parts and blocks give the same scores as few."""
    rows = [(k, " ".join(words(60, k % 20)), "s") for k in range(200)]
    few = sorted(map(tuple, B.backoff_scores(documents(rows)).collect()))
    monkeypatch.setattr(B, "PART_BYTES", 500)
    many = B.backoff_scores(documents(rows))
    assert sorted(map(tuple, many.collect())) == few
