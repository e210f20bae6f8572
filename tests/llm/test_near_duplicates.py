"""The n-gram join and the embedding search against all pairs, and the components below both."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from wagerlens.llm import embedding_dedup as E
from wagerlens.llm import ngram_join as J
from wagerlens.llm.components import connected_components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_join(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    known = [k for k, i in enumerate(ids) if i is not None]
    links = [(a, b) for a in known for b in known if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    part = roots(range(len(rows)), links)
    least = {}
    for k in known:
        least[part[k]] = min(ids[k], least.get(part[k], ids[k]))
    return Counter((i, len(s), least.get(part[k]) if i is not None else None) for k, (i, s) in enumerate(zip(ids, sets)))


@pytest.fixture(scope="module")
def near_copies(words):
    """Groups of near copies around the threshold, of all sizes, and a passage that many texts share."""
    draw, rows, doc_id = random.Random(11), [], 100
    passage = words(60, 77)
    for group in range(14):
        base = words(draw.choice([6, 9, 14, 25, 60, 130, 300]), 200 + group)
        for _ in range(draw.choice([2, 5, 12])):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 50))):
                at = draw.randrange(len(text))
                text[at : at + draw.randint(0, 1)] = words(draw.randint(0, 2), draw.randrange(10**6))
            rows.append((doc_id, " ".join(text if draw.random() < 0.8 else [w.upper() for w in text]), "s"))
            doc_id += 1
    for k in range(40):
        rows.append((doc_id + k, " ".join(words(draw.choice([5, 20, 80]), 900 + k) + passage + words(draw.choice([5, 20]), 1900 + k)), "s"))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("boundary", [None, 1, 500])
def test_join_against_all_pairs(documents, near_copies, odd_rows, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(J, "choose_boundary", lambda costs: boundary)
    monkeypatch.setattr(J, "COUNT_LEAST", 2)
    rows = near_copies + odd_rows
    found = J.jaccard_classes(documents(rows).repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_join(rows)
    assert len({r.component_id for r in found}) < len(rows) - 30


def test_join_of_a_large_group(documents, words):
    """A third of all rows are near copies of each other and a third are equal."""
    base, rows = words(120, 3), []
    for k in range(150):
        text = list(base)
        text[k % 120] = f"new{k}"
        rows += [(k, " ".join(text), "s"), (1000 + k, "the very same few words", "s"), (2000 + k, " ".join(words(40, 5000 + k)), "s")]
    found = {r.doc_id: r.component_id for r in J.jaccard_classes(documents(rows)).collect()}
    assert {found[k] for k in range(150)} == {0} and {found[1000 + k] for k in range(150)} == {1000}
    assert all(found[2000 + k] == 2000 + k for k in range(150))


def test_join_of_nothing(documents):
    assert J.jaccard_classes(documents([])).count() == 0
    assert [tuple(r) for r in J.jaccard_classes(documents([(1, None, "s")])).collect()] == [(1, 0, None, 1)]


def test_keep_one(documents, near_copies, odd_rows):
    rows = near_copies + odd_rows
    docs = documents(rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = {i for i, _, c in brute_join(rows) if i is None or i == c}
    got = Counter(r.doc_id for r in kept.collect())
    assert set(got) == wanted and got[4] == 1 and got[None] == 2 and all(n == 1 for i, n in got.items() if i is not None)


def test_keep_one_of_repeated_ids(documents, words):
    """An id with several texts: each text stays or goes with its own group, and each group keeps one row."""
    one, two, three, four = (" ".join(words(60, seed)) for seed in (71, 72, 73, 74))
    near = " ".join([*words(60, 73), "more"])
    rows = [
        (1, one, "a"), (5, one, "a"), (5, two, "a"),  # the second text of 5 has no group of a smaller id
        (7, three, "a"), (7, near, "a"), (8, three, "a"),  # two near texts of the smallest id
        (9, four, "a"), (9, four.upper(), "a"), (9, "quite another few words", "a"), (9, None, "a"), (9, None, "a"), (9, "", "a"), (10, four, "a"), (11, "alone", "a"),
    ]
    kept = Counter((r.doc_id, None if r.text is None else r.text.lower()) for r in J.keep_one(documents(rows)).collect())
    thirds = Counter({key: n for key, n in kept.items() if key[0] == 7})
    assert sum(thirds.values()) == 1 and set(thirds) <= {(7, three), (7, near)}
    assert kept - thirds == Counter([(1, one), (5, two), (9, four), (9, "quite another few words"), (9, None), (9, ""), (11, "alone")])


def test_registered_join(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    found = J.op3_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_join(rows)


def test_prefixes_of_linked_sets_share_enough():
    draw = random.Random(5)
    for _ in range(300):
        size = draw.randint(2, 60)
        one = set(draw.sample(range(200), size))
        other = (one - set(draw.sample(sorted(one), draw.randint(0, size // 5)))) | set(draw.sample(range(200, 300), draw.randint(0, size // 5)))
        if 5 * len(one & other) >= 4 * len(one | other):
            for subset in (1, 2):
                a, b = (set(sorted(s)[: J.prefix_length(len(s), subset)]) for s in (one, other))
                assert len(a & b) >= min(subset, len(one & other))


def test_boundary_follows_cost():
    """Short lists are scanned, long ones make subsets pay, and the most costly sizes decide how far."""
    subsets = {n: 200 * J.prefix_length(n, 2) * (J.prefix_length(n, 2) - 1) / 2 for n in range(2, 400)}
    scans = lambda length: {n: (subsets[n], 100 * J.prefix_length(n, 1) * length) for n in subsets}
    low, high = J.choose_boundary(scans(2.0)), J.choose_boundary(scans(50.0))
    assert 1 <= low < high < 400 and J.choose_boundary({}) == 1


def filed(documents, rows, monkeypatch):
    """What the join files for some rows, and the boundary that its costs gave."""
    seen, by_size = [], J._filed_by_size
    monkeypatch.setattr(J, "_filed_by_size", lambda lists, kept, boundary: seen.append((by_size(lists, kept, boundary), boundary)) or seen[-1][0])
    found = J.jaccard_classes(documents(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_join(rows)
    return seen[0][1], Counter(r.place < 0 for r in seen[0][0].collect())


def test_longer_lists_move_the_boundary(documents, words, monkeypatch):
    """Pairs of long texts are scanned; short texts over so few words that tokens have long lists, but pairs of tokens short ones, file subsets."""
    rows = []
    for k in range(60):
        base = words(50, 300 + k // 2)
        rows.append((k, " ".join(base if k % 2 else [*base[:-1], f"end{k}"]), "s"))
    low, few = filed(documents, rows, monkeypatch)
    draw = random.Random(6)
    rows += [(1000 + k, " ".join(draw.choice("abc") for _ in range(12)), "s") for k in range(600)]
    high, many = filed(documents, rows, monkeypatch)
    assert (low, few[True]) == (1, 0) and 8 <= high < 46 and many[True] > 300


def test_components(spark):
    draw = random.Random(8)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    frame = spark.createDataFrame([*links, *((b, a) for a, b in links[:50]), (None, 3)], "a long, b long")
    links = [link for link in links if link[0] != link[1]]
    wanted = roots({n for link in links for n in link}, links)
    assert {tuple(r) for r in connected_components(frame).collect()} == set(wanted.items())
    assert connected_components(frame.limit(0)).count() == 0


def brute_vectors(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            scaled = np.array(v + [0.0] * (64 - len(v))) / np.abs(v).max()  # so that no square vanishes
            good[k] = scaled / np.linalg.norm(scaled)
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] >= threshold]
    n, part = Counter(k for link in links for k in link), roots(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[part[k]] = min(i, least.get(part[k], i))
    return [(i, n[k], least.get(part[k]) if i is not None else None) for k, (i, _) in enumerate(rows)], len(links)


def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(2)
    rows = []
    for group in range(60):
        centre = draw.normal(size=64)
        for spread in draw.choice([0.0, 0.1, 0.2, 0.25], size=draw.integers(1, 9)):
            rows.append((len(rows), (centre + spread * draw.normal(size=64)).astype(np.float32).tolist()))
    same = draw.normal(size=64).astype(np.float32).tolist()
    rows += [(1000 + k, same) for k in range(150)] + [(2000, [2 * x for x in same]), (2001, [-x for x in same])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] * 64), (3004, [None] + same[1:]), (3005, [float("inf")] + same[1:]), (None, same)]
    rows += [(3006, [1.0, 2.0]), (3007, [1.0, 2.01]), (3008, [1.0, 2.0, 0.0]), (3009, [-0.0, 1e-300]), (3010, [0.0, 1e-300])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, class string")
    found = Counter(tuple(r)[:3] for r in E.near_vectors(frame).collect())
    wanted, links = brute_vectors(rows)
    assert sum(n for (_, n, _), k in found.items() for _ in range(k)) >= 2 * 0.99 * links
    assert found == Counter(wanted)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, where bits flip most often: recall is at least 0.9, and no pair below is linked."""
    draw = np.random.default_rng(4)
    rows, pairs = [], []
    for k in range(1500):
        a, b = draw.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cosine = draw.uniform(0.94, 0.97)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)).tolist())]
        pairs.append(cosine >= 0.95)
    found = {r.vec_id: r for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    hits = [found[2 * k].n_links > 0 for k in range(1500)]
    assert sum(h for h, p in zip(hits, pairs) if p) >= 0.9 * sum(pairs)
    assert not any(h for h, p in zip(hits, pairs) if not p)


def off_centre(draw, n, norm):
    """Unit vectors about a common direction of that norm, the same for every draw."""
    centre = np.eye(64)[5] * norm
    apart = draw.normal(size=(n, 64))
    return E._unit(centre + np.sqrt(1 - norm**2) * apart / np.linalg.norm(apart, axis=1, keepdims=True))


@pytest.mark.parametrize("norm", [0.0, 0.7])
@pytest.mark.parametrize("count", [3000, 28_000, 4_000_000, 30_000_000])
def test_tables_of_every_count_meet_the_recall(norm, count):
    """Pairs at the threshold itself, drawn apart from the fitted ones: all but a few in a thousand meet and are compared."""
    draw = np.random.default_rng(12)
    fitted = off_centre(draw, 6000, norm)
    quantiser = E.learn(fitted)
    index = E.choose_index(fitted, quantiser, count)
    a, b = E.neighbours(off_centre(draw, 2000, norm), 0.95, draw)
    assert np.allclose((a * b).sum(axis=1), 0.95)
    met = np.concatenate([(index.keys(x) == index.keys(y)).any(axis=1) for x, y in zip(np.split(a, 8), np.split(b, 8))])
    compared = np.bitwise_count((quantiser.codes(a) ^ quantiser.codes(b)).view(np.uint64)) <= index.far_bits
    assert (met & compared).mean() >= 0.99


def test_further_code_sets_are_learnt():
    """They lose less than random rotations do, differ from one another, and the trials of the tables are not among what they learn from."""
    draw = np.random.default_rng(6)
    reduced = off_centre(draw, 3000, 0.3) @ np.diag(np.linspace(0.2, 1, 64))

    def loss(rotation):
        turned = reduced @ rotation
        return ((np.sign(turned) - turned / np.abs(turned).mean()) ** 2).mean()

    sets = [E.rotation_for(reduced, start) for start in range(3)]
    assert all(loss(E.rotation_for(reduced, start)) < 0.97 * loss(E.rotation_for(reduced, start, 0)) for start in range(3))
    assert all(np.allclose(one.T @ one, np.eye(64)) for one in sets)
    assert all(np.abs(one.T @ other).max(axis=0).mean() < 0.7 for one, other in zip(sets, sets[1:]))
    many = np.arange(2 * E.TRIALS)
    assert set(E.for_learning(many)).isdisjoint(many[: E.TRIALS]) and len(E.for_learning(many[1:])) == len(many) - 1


@pytest.mark.parametrize("norm", [0.0, 0.7])
def test_recall_with_the_tables_of_many_vectors(spark, monkeypatch, norm):
    choose, chosen = E.choose_index, []
    monkeypatch.setattr(E, "choose_index", lambda rows, quantiser, count, threshold: chosen.append(choose(rows, quantiser, 4_000_000, threshold)) or chosen[0])
    draw = np.random.default_rng(9)
    a, b = E.neighbours(off_centre(draw, 600, norm), 0.9501, draw)
    a, b = a[:600], b[:600]  # apart in any direction
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    found = {r.vec_id: r for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(found) == 1200 and chosen[0].length > 10 < chosen[0].tables
    assert sum(found[k].component_id == found[k + 600].component_id for k in range(600)) >= 0.99 * 600


def test_vectors_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_vectors(frame).count() == 0
    alone = spark.createDataFrame([(3, None), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, E.near_vectors(alone).collect()), key=str) == [(3, 0, 3, True), (None, 0, None, None)]


def test_rotation_balances_bits():
    rows = np.random.default_rng(1).normal(size=(3000, 16)) * np.arange(1, 17) + 3
    codes = E.learn(rows).codes(rows).view(np.uint64)
    shares = [((codes >> np.uint64(bit)) & np.uint64(1)).mean() for bit in range(16)]
    assert all(0.25 < share < 0.75 for share in shares)
