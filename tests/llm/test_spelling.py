"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from wagerlens.llm import spelling as S


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return rows


def edited(word, draw, letters):
    at, kind = draw.randrange(len(word) + 1), draw.randrange(3)
    return word[:at] + (draw.choice(letters) if kind else "") + word[at + (kind != 2) :]


def vocabulary(seed, size, letters):
    draw = random.Random(seed)
    counts = {}
    for _ in range(size):
        word = "".join(draw.choice(letters) for _ in range(draw.choice([6, 6, 7, 8, 9, 12, 13, 20, 60])))
        n = draw.choice([5, 5, 6, 30, 40, 1000])
        for _ in range(draw.randint(1, 8)):
            counts[word] = n
            word, n = edited(word, draw, letters), max(5, n // draw.choice([1, 3, 5, 6]))
    return {w: n for w, n in counts.items() if len(w) >= 6}


@pytest.mark.parametrize("letters, least", [("abc", 16), ("abc", 1), ("abcdefghijé÷", 3), ("ab", 1000)])
def test_forms_against_all_words(spark, monkeypatch, letters, least):
    """Whatever the dictionary: of all grams, of a few, of none."""
    monkeypatch.setattr(S, "LEAST", least)
    counts = vocabulary(len(letters), 120, letters)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = [tuple(r) for r in S.spelling_forms(frame).collect()]
    assert len(found) == len(counts) and set(found) == brute_forms(counts)
    assert any(row[1] != row[2] and row[1] is not None for row in found)  # chains of forms


def test_an_edit_leaves_one_of_two_lists():
    """Every word with one code point replaced or added is in a list that its original merges."""
    draw = random.Random(2)
    for letters in ("ab", "abcd"):
        frequent = {"".join(draw.choice(letters) for _ in range(draw.randint(2, 6))): draw.randint(1, 9) for _ in range(60)}
        frequent |= {gram[:k]: 9 for gram in list(frequent) for k in range(2, len(gram))}  # prefixes of frequent grams are frequent
        for _ in range(300):
            word = "".join(draw.choice(letters) for _ in range(draw.randint(6, 16)))
            merged = set(S.merged_lists(word, frequent, 1))
            assert len(merged) == 4 or len(set(word)) < 3
            for at in range(len(word) + 1):
                for letter in letters:
                    longer, same = word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]
                    assert merged & set(S.filed_under(longer, frequent))
                    assert at == len(word) or same == word or merged & set(S.filed_under(same, frequent))


def test_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 60)
    monkeypatch.setattr(S, "LEAST", 1)
    frame = spark.createDataFrame(list(vocabulary(5, 200, "abcde").items()), "word string, n long")
    frequent, least = S.gram_dictionary(frame)
    assert least > 1 and max(Counter(map(len, frequent)).values()) <= 60 and all(gram[:-1] in frequent for gram in frequent if len(gram) > 2)


def test_counts_are_passed_on_in_parts(monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 3)
    found = [batch.to_pydict() for batch in S._counts(iter([Counter("ab"), Counter("bcc"), Counter("ad")]), "word")]
    assert found == [{"word": ["a", "b", "c"], "n": [1, 2, 2]}, {"word": ["a", "d"], "n": [1, 1]}]


def test_counts_of_texts(documents, odd_rows, words):
    rows = list(odd_rows) + [(300 + k, " ".join(words(50, k % 9, "abcdÉ×")) + " Straße-Étéééé naïvely_ Ābcdefg " * 2, "s") for k in range(60)]
    found = {r.word: r.n for r in S.word_counts(documents(rows)).collect()}
    assert found == brute_counts([(i, t) for i, t, _ in rows])
    plain = Counter(re.findall("[a-zÀ-ÿ]+", " ".join(t or "" for _, t, _ in rows).lower().replace("é", "é")))
    assert {r.word for r in S.word_counts(documents([(i, (t or "").lower(), s) for i, t, s in rows]), damage=False).collect()} == {w for w, n in plain.items() if n >= 5 and len(w) >= 6}


def test_a_frequent_word_and_nothing(spark, documents):
    """One word of a third of all runs, near to all others; texts without words."""
    counts = {"common": 100_000} | {f"c{a}mmon": 5 for a in "abcdefghij"} | {f"common{a}": 600 for a in "abcd"} | {"comman": 30_000, "commanx": 5}
    found = {tuple(r) for r in S.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert found == brute_forms(counts)
    for rows in ([], [(1, None, "s"), (2, "short words", "s")]):
        assert S.spelling_forms(S.word_counts(documents(rows))).count() == 0
    with pytest.raises(ValueError, match="more frequent"):
        S.spelling_forms(spark.createDataFrame([("common", 5)], "word string, n long"), ratio=1)


def test_no_join_broadcasts(spark, monkeypatch):
    """Each side of a join grows with the vocabulary, and Spark sizes it too low: a few words, whose tables Spark takes for small."""
    plans, write = [], S.written

    def run(df):
        df.collect()  # the plan is final then
        plans.append(df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0])
        return write(df)

    monkeypatch.setattr(S, "written", run)
    counts = vocabulary(7, 120, "abc")
    found = run(S.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {tuple(r) for r in found.collect()} == brute_forms(counts)
    assert sum("Join" in plan for plan in plans) >= 4  # lists, two steps of roots, the result
    assert all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in plans if "Join" in plan)


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    counts = brute_counts([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    assert {tuple(r) for r in S.op12_spelling_variants(spark, sf_dir).collect()} == brute_forms(counts)
