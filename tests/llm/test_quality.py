from __future__ import annotations

import zlib

import numpy as np
import pytest

from wagerlens.llm import gam_quality as G

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in G.op4_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(found[i].score, q) for i, q in labels.items() if i in found and found[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, 1, 0, "x"), (10, 0, 0, "x"), (None, 1, 0, "x"), (9, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    scored = G.score_texts(docs, G.fit(docs, labels)).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    nothing = G.fit(docs, labels.limit(0))
    assert {r.score for r in G.score_texts(docs, nothing).collect()} == {0.5}
    kept = G.keep_good(docs, nothing, threshold=0.4)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)
    assert G.keep_good(documents([]), nothing).count() == G.score_texts(documents([]), nothing).count() == 0


def test_training_reads_no_held_out_row_and_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, marks = G.training_rows(docs.select("doc_id", "text"), labels)
    wanted = [r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert len(rows) == len(wanted) and marks.sum() == sum(wanted)
    assert len(G.training_rows(docs.select("doc_id", "text"), labels, most=17)[0]) == 17


def test_model_learns_shapes_and_an_interaction():
    draw = np.random.default_rng(0)
    rows = draw.random((4000, len(G.FEATURES)))
    marks = ((rows[:, 3] > 0.5) ^ (rows[:, 7] > 0.4)).astype(float)
    model = G.train(rows[:3000], marks[:3000])
    assert {(7, 3)} <= {(i, j) for i, j, *_ in model.pairs}
    assert ((model.score(rows[3000:]) > 0.5) == marks[3000:]).mean() > 0.85
    bump = (np.abs(rows[:, 2] - 0.5) < 0.2).astype(float)
    assert ((G.train(rows[:3000], bump[:3000]).score(rows[3000:]) > 0.5) == bump[3000:]).mean() > 0.97


def test_score_is_a_sum_of_tables():
    model = G.Model(0.5, [np.array([1.0])] * 2, [np.array([0.0, 1.0]), np.array([0.0, -2.0])], [(1, 0, np.array([1.0]), np.array([1.0]), np.array([[0.0, 0.0], [0.0, 3.0]]))])
    assert model.score(np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]])) == pytest.approx([1 / (1 + np.exp(-x)) for x in (0.5, 1.5, 2.5)])
