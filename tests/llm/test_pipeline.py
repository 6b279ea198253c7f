"""The pipeline's stages one after another against plain forms, on a small corpus."""

import random
import zlib

import numpy as np
import pytest
from conftest import WORDS, prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("corpus"))
    texts = [prose(rng, WORDS, rng.randint(60, 200)) for _ in range(80)]
    toxic = set(range(0, 80, 6))
    for i in toxic:
        words = texts[i].split(" ")
        for _ in range(6):
            words[rng.randrange(len(words))] = rng.choice(["vilespawn", "grumbleworth"])
        texts[i] = " ".join(words)
    texts[1:3] = [texts[3]] * 2
    passage = prose(rng, WORDS, 60)
    for i in (7, 8, 9):
        texts[i] += "\n" + passage
    texts += ["漢字かな交じり文は別の言語である " * 10, None, ""]
    rows = [(i, t, "en" if i < 80 else None, f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, toxic, passage


def test_stages(spark, folder):
    import corpus_pipeline as pipeline
    from tessera.llm.simhash import fingerprint
    from tessera.llm.passages import removals
    from tessera.llm.tokens import TextEncoder

    path, rows, toxic, passage = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:-1]:
        before, docs = docs, pipeline.stored(stage(spark, docs, path), "test")
        assert docs.columns == before.columns and docs.count() <= before.count()
        kept.append({r.doc_id: r.text for r in docs.collect()})
    clean, known, first, cut = kept
    assert not toxic & clean.keys() and len(clean) >= 83 - len(toxic) - 2
    assert 80 not in known and set(known) == {i for i in clean if i < 80}
    near = lambda a, b: (fingerprint(a) ^ fingerprint(b)).bit_count() <= 2
    assert all(any(near(t, first[j]) and j <= i for j in first) for i, t in known.items()) and 1 in first and 2 not in first and 3 not in first
    assert all(not near(first[a], first[b]) for a in first for b in first if a < b)
    want = {r.doc_id: r.text for r in removals(spark.createDataFrame(list(first.items()), "doc_id long, text string")).collect()}
    assert cut == want and sum(passage.split("\n")[0] in t for t in cut.values()) == 1
    encoder = TextEncoder(pipeline.vocabulary(pipeline.BYTE_BPE))
    found = {}
    for r in pipeline.STAGES[-1][1](spark, docs, path).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert found.keys() == cut.keys()
    for i, t in cut.items():
        ids = encoder.encode([t])[0] + np.array([1], "<u4").tobytes()
        assert sorted(found[i])[0][0] == 0 and sum(n for _, n, _ in found[i]) == len(ids) // 4
        assert all(zlib.crc32(ids[4 * a : 4 * (a + n)]) == c for a, n, c in found[i])


def test_run_equals_its_stages(spark, folder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder[0]), "test")
    columns = ["doc_id", "start", "length", "ids_crc32"]
    whole = pipeline.run(spark, folder[0])
    assert whole.groupBy("doc_id").sum("length").exceptAll(docs.groupBy("doc_id").sum("length")).isEmpty() and set(columns) <= set(whole.columns)
