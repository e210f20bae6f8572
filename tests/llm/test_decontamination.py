"""Benchmark windows found by the automaton against a plain search for every window."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from wagerlens.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def brute(docs, items):
    windows = set()
    for item, text in items:
        found = [w for w, _, _ in words_of(text)]
        windows |= {(item, tuple(found[k : k + 10])) for k in range(max(1, len(found) - 9)) if found}
    rows = Counter()
    for doc_id, text in docs:
        found = words_of(text)
        plain = tuple(w for w, _, _ in found)
        covered, spans = set(), {}
        for item, window in windows:
            for k in range(len(plain) - len(window) + 1):
                if plain[k : k + len(window)] == window:
                    covered |= set(range(k, k + len(window)))
                    spans.setdefault(item, set()).update(range(k, k + len(window)))
        cut = []
        for item, places in sorted(spans.items(), key=lambda x: (x[0] is None, x[0] or "")):
            for k in sorted(places):
                if k - 1 not in places:
                    end = k
                    while end + 1 in places:
                        end += 1
                    cut.append((item, found[k][1], found[end][2]))
        rows[doc_id, len(plain), len(covered), tuple(sorted((i for i in spans if i is not None), key=str.encode)), tuple(cut)] += 1
    return rows


def as_rows(frame):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.item_id, s.start, s.end) for s in r.spans)) for r in frame.collect())


@pytest.fixture(scope="module")
def benchmark_rows(words):
    shared = words(14, 3)
    return [
        ("10", " ".join(words(25, 1))), ("9", "Quite, SHORT! item"), ("9", " ".join([*words(4, 2), *shared])), ("é", " ".join(shared)), (None, " ".join(words(12, 8))),
        ("none", None), ("empty", " .,! "), ("tiny", "tail"), ("10", " ".join(words(25, 1))), ("loop", "a b " * 9),
    ]


@pytest.fixture(scope="module")
def contaminated(words, benchmark_rows, odd_rows):
    draw, rows = random.Random(3), list(odd_rows)
    for k in range(60):
        text = words(draw.randint(0, 60), 100 + k, "abcdefghéü")
        for _ in range(draw.randint(0, 3)):
            part = (draw.choice(benchmark_rows)[1] or "").split()
            at, start = draw.randint(0, len(text)), draw.randint(0, 3)
            text[at:at] = [draw.choice([w, w.upper(), w + ",", "(" + w]) for w in part[start : start + draw.choice([9, 10, 11, 30])]]
        rows.append((100 + k, draw.choice([" ", "\n", "  - ", "_"]).join(text), "s"))
    return rows + [(200, "Áb a b a b a b a b a b a b", "s"), (201, "quite short item", "s"), (202, "quite short item", "s")]


@pytest.mark.parametrize("bound", [None, 300])
def test_hits_against_a_plain_search(spark, documents, contaminated, benchmark_rows, monkeypatch, bound):
    """The items, words and spans are those of every window looked for by itself, with one automaton and with many."""
    if bound:
        monkeypatch.setattr(D, "AUTOMATON_BYTES", bound)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in benchmark_rows], "item_id string, text string, doc_id string, window int")
    found = as_rows(D.find_benchmark(documents(contaminated).repartition(3), items))
    assert found == brute([(i, t) for i, t, _ in contaminated], benchmark_rows)
    assert sum(n for (_, _, hit, _, _), n in found.items() if hit) > 20


def test_questions_and_answers(spark, documents, words):
    question, answer = " ".join(words(12, 1)), " ".join(words(11, 2))
    items = spark.createDataFrame([(7, question, answer), (8, None, "yes")], "n long, question string, answer string")
    docs = documents([(1, f"x {answer} y", "s"), (2, question, "s"), (3, f"{question[:20]} yes", "s"), (4, "other", "s")])
    given = {"item_column": "n", "item_texts": ("question", "answer")}
    assert {r.doc_id: r["items"] for r in D.find_benchmark(docs, items, **given).collect()} == {1: ["7"], 2: ["7"], 3: ["8"], 4: []}
    assert sorted(r.doc_id for r in D.without_benchmark(docs, items, **given).collect()) == [4]
    assert sorted(r.doc_id for r in D.without_benchmark(docs, items, most_hit=0.5, **given).collect()) == [3, 4]


def test_a_long_text_and_nothing(spark, documents, words):
    items = spark.createDataFrame([(1, "w " * 10)], "item_id long, text string")
    row = D.find_benchmark(documents([(1, "w " * 50_000 + " ".join(words(9, 2)), "s")]), items).first()
    assert (row.n_words, row.n_hit, row["items"], len(row.spans)) == (50_009, 50_000, ["1"], 1)
    assert D.find_benchmark(documents([]), items).count() == 0
    assert [r.n_hit for r in D.find_benchmark(documents([(1, "w " * 10, "s")]), items.limit(0)).collect()] == [0]


def test_registered_query(spark):
    """The digest columns follow from a plain search over the whole tables."""
    sf_dir = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    wanted = brute(read("documents", "doc_id"), [(str(i), t) for i, t in read("benchmark", "item_id")])
    digest = lambda items: hashlib.sha256(",".join(items).encode()).hexdigest()
    found = D.op11_benchmark_decontamination(spark, sf_dir).collect()
    assert Counter(tuple(r) for r in found) == Counter({(i, n, hit, len(items), digest(items), hit > 0): k for (i, n, hit, items, _), k in wanted.items()})
    assert any(r.contaminated for r in found)
