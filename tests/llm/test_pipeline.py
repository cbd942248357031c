from __future__ import annotations

import corpus_pipeline

from .helpers import awkward, frame, prose


def test_stages_take_effect(spark, tmp_path):
    near = prose(50, 400)
    rows = awkward() + [(2000 + k, prose(2000 + k, 80)) for k in range(30)]
    rows += [(2100, near), (2101, near + " x"), (2102, near), (2103, prose(51, 40) + ' token = "abcdef0123456789abcdef0123456789abcdef01"')]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2000 + k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.schema == docs.schema, name
        out.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in seen.collect()}
        assert {2000 + k for k in range(30)} <= ids, name
        if name == "quality_rules":
            assert not ids & {1, 2, 3, 4, 5, 6, 17} and {2100, 2101, 2102} <= ids
        if name == "exact_dedup":
            assert 2100 not in ids and 2102 in ids and seen.where("doc_id = 9").count() == 1
        if name == "simhash_near_dedup":
            assert 2101 in ids and 2102 not in ids
        if name == "secret_scans":
            text = seen.where("doc_id = 2103").first()
            assert "abcdef0123456789abcdef" not in text.text and text.n_chars == len(text.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_empty_tables(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
