"""The pipeline's stages on no documents, on nulls, repeated rows, long texts and columns with the operators' own names."""

import random

import pytest
from conftest import WORDS, prose

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _cut string, fp long, root long, score double, text_hash long"


def folder(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in rows if r[0] is not None and r[0] < 60], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_no_documents(spark, tmp_path):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, folder(spark, tmp_path, [])).collect() == []


def test_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = prose(rng, WORDS, 80).split(" ")
        if i % 5 == 0:
            words[5:5] = ["vilespawn", "grumbleworth", "vilespawn"] * 3
        rows.append((i, " ".join(words), "en", "s", 1, "own", 7, 8, 0.5, 9))
    long = prose(rng, WORDS, 20_000)
    rows += [(100, long, "en", None, None, "own", 7, 8, 0.5, 9), (100, long, "en", None, None, "own", 7, 8, 0.5, 9), (None, prose(rng, WORDS, 60), "en", None, None, None, None, None, None, None)]
    rows += [(101, None, "en", None, None, None, None, None, None, None), (102, "", None, None, None, None, None, None, None, None), rows[0], rows[0]]
    path = folder(spark, tmp_path, rows)
    docs, sizes = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, pipeline.stored(stage(spark, docs, path), "test")
        assert docs.columns == before.columns, name
        sizes.append({(r.doc_id, r.fp) for r in docs.collect()})
    toxic, language, near, cut = sizes
    assert not {(i, 7) for i in range(0, 60, 5)} & toxic and {(i, 7) for i in range(60) if i % 5} | {(100, 7), (None, None), (101, None), (102, None)} == toxic
    assert language == toxic - {(101, None), (102, None)} == near == cut
    assert docs.count() == len(cut)
    packed = pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in cut} and sum(r.length for r in packed if r.doc_id == 100) > 20_000
