"""What the pipeline's stages leave in an executor's workers has a bound."""

import pytest

pytest.importorskip("public_tokenizers")


def test_workers_remember_few_chunks_after_packing(spark):
    import corpus_pipeline as pipeline
    from tessera.llm.packing import pack

    docs = spark.createDataFrame([(d, " ".join(f"{d}x{k}" for k in range(40_000))) for d in range(6)], "doc_id long, text string").coalesce(1)
    rows = pipeline.packed(spark, docs, "").collect()

    def held(batches):
        import pyarrow as pa

        from tessera.llm import common

        for _ in batches:
            own = [len(s._new) + len(s._old) for key, s in common._STATE.items() if key[0] == "tokens"]
            yield pa.RecordBatch.from_pydict({"n": pa.array(own, pa.int64())})

    found = [r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()]
    assert found and 0 < max(found) <= 150_000, found
    # All 240,000 words were packed, as with a larger memory.
    assert sorted(rows) == sorted(pack(docs, pipeline.vocabulary(pipeline.BYTE_BPE)).collect()) and len({r.doc_id for r in rows}) == 6


def test_batches_are_small_in_every_stage(spark):
    import corpus_pipeline as pipeline
    from tessera.llm.common import bounded_batches

    bounded_batches(spark)  # as an operator does inside a stage, after the pipeline and before
    pipeline.packed(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    bounded_batches(spark)
    values = [int(spark.conf.get(f"spark.sql.{k}")) for k in ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "parquet.columnarReaderBatchSize")]
    assert values == [pipeline.BATCH_ROWS, pipeline.BATCH_BYTES, pipeline.READ_ROWS]
