from __future__ import annotations

import corpus_pipeline as C
import __spark_entry__ as driver
from wagerlens.llm import compression_rules, gam_quality, ngram_join, packing

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """Each stage keeps exactly what its operator, run by itself on the same rows, keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in C.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "best_fit_packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = gam_quality.fit(docs, labels)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    wanted = [
        lambda d: gam_quality.score_texts(d, model).filter("predicted = 1"),
        lambda d: compression_rules.rules_frame(d).filter("kept"),
        lambda d: ngram_join.jaccard_classes(d).filter("doc_id = component_id"),
    ]
    for (_, stage), expected in zip(C.STAGES[:-1], wanted):
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        assert ids(kept) == ids(expected(docs))
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    packed = C.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({r.doc_id for r in packed}) == ids(docs)
    assert sorted(map(str, packed)) == sorted(map(str, C.run(spark, SF).collect()))


def test_odd_rows_and_no_rows(spark, documents, odd_rows, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd_rows, []):
        docs = documents(rows)
        for _, stage in C.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in driver.queries() if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in driver.queries()
    assert packing.CAPACITY > 0
