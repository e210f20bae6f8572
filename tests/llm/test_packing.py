from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from wagerlens.llm import packing as P


def plain_best_fit(items, capacity):
    """Look at every bin for the tightest compatible one; the first opened wins a tie."""
    bins, found = [], []
    for size, source, cluster in items:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and (cluster is None or cluster not in b["clusters"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[k]["left"] -= size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
        found.append(k)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_a_plain_search(seed):
    draw = random.Random(seed)
    items = [(draw.randint(1, 100), draw.choice([None, 1, 1, 1, 2, 3, 4, 5]), draw.choice([None, None, 7, draw.randrange(50)])) for _ in range(400)]
    items.sort(key=lambda x: -x[0])
    assert P.best_fit(items, 100) == plain_best_fit(items, 100)


def check_bins(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        if r.bin is None:
            assert r.size == 0
        else:
            held[r.block, r.part, r.bin].append(r)
    for pieces in held.values():
        assert sum(r.size for r in pieces) == pieces[0].bin_size <= capacity
        assert max(Counter(r.source for r in pieces).values()) == 1
        assert max(Counter(r.cluster for r in pieces if r.cluster is not None).values(), default=1) == 1


def test_documents(documents, odd_rows, words):
    rows = odd_rows + [(50 + k, " ".join(words(k % 90, k)), f"s{k % 3}") for k in range(200)]
    found = P.pack_documents(documents(rows), capacity=128, block=64).collect()
    check_bins(found, 128)
    sizes = defaultdict(int)
    for r in found:
        sizes[r.doc_id] += r.size
        assert r.start == r.piece * 128
    wanted = defaultdict(int)
    for i, t, _ in rows:
        wanted[i] += len((t or "").encode().split())
    assert sizes == wanted
    assert len({(r.block, r.part) for r in found if r.part == 0}) > 2
    assert P.pack_documents(documents([])).count() == 0


def test_a_hot_source_and_a_large_group(documents, words):
    rows = [(k, " ".join(words(20, k % 7 if k < 100 else k)), "hot" if k % 3 else f"s{k % 11}") for k in range(300)]
    found = P.pack_documents(documents(rows), capacity=100, block=128).collect()
    check_bins(found, 100)
    assert len(found) == 300


def test_near_copies_share_no_bin(documents, words):
    """Texts with one word changed are of one cluster, rows without an id included; without clusters they share bins."""
    rows = []
    for k in range(24):
        text = words(60, 500 + k // 4)
        text[7 * (k % 4)] = f"new{k}"
        rows.append((k if k % 5 else None, " ".join(text), f"s{k}"))
    rows = [(i, t + " " + " ".join(words(60, 500 + k // 4)[:60] * 2), s) for k, (i, t, s) in enumerate(rows)]
    rows += [(100, None, "a"), (101, "other", "b")]
    near = {s: k // 4 for k, (_, _, s) in enumerate(rows[:24])}

    def shared(found):
        bins = defaultdict(list)
        for r in found:
            if r.bin is not None and r.source in near:
                bins[r.block, r.part, r.bin].append(near[r.source])
        return sum(max(Counter(groups).values()) > 1 for groups in bins.values())

    found = P.pack_near_copies(documents(rows), capacity=1000).collect()
    check_bins(found, 1000)
    assert len(found) == len(rows) and shared(found) == 0
    assert shared(P.pack_documents(documents(rows), capacity=1000).collect()) > 0


def test_registered_query(spark):
    rows = P.op10_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    check_bins(rows, P.CAPACITY)
    docs = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and sum(r.size for r in rows) == sum(docs.values())
