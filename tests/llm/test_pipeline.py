"""The pipeline stage by stage on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from quarry.llm.decontamination import benchmark_leaks


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
        if name == "decontamination":
            assert benchmark_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[0] > counts[2] > counts[0] / 2
    assert docs.select("doc_id").distinct().count() == counts[-1]
    one = {(r.doc_id, r.start, r.ids_crc32) for r in docs.collect()}
    assert one == {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()}


def test_stages_on_awkward_rows(spark, sf, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns whose names the stages use; and no rows at all."""
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " tail"), (None, "a b c"), (None, None), (5, "token = 0123456789abcdef0123456789abcdef"), (6, " \n "), (6, " \n ")]
    schema = "doc_id long, text string, toxicity_score string, id string, cluster long, label string, _text string"
    for name, given in (("odd", [(i, t, "s", "i", None, "l", "x") for i, t in rows]), ("none", [])):
        docs = spark.createDataFrame(given, schema)
        for stage_name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}-{stage_name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage_name}")
            if stage_name != "packing":
                assert docs.columns == columns
            if stage_name == "near_dedup" and given:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 0, 1, 2, 3, 3, 5, 6, 6]
            if stage_name == "secret_scan" and given:
                assert [r.text for r in docs.where("doc_id = 5").collect()] == ["token = [SECRET]"]
        assert docs.count() == (11 if given else 0) or docs.select("doc_id").distinct().count() == (6 if given else 0)
