"""Token ids of documents as Simple-8b shard files in the shared folder, in ascending doc_id order, and back.

Writing: texts are dealt out by ranges of (doc_id, hash of the text) and sorted, so that a hot id can
be split; each task encodes a stream and writes shards of a bounded number of ids under a
temporary name, then renames them, so a retried task replaces equal files. The manifest, one
row a shard, gives each shard's first id number. Reading: Spark's binaryFile source, decoded in runs of blocks.

Defined results: null or empty text is the end id alone; null doc_ids come first; rows
with one doc_id are ordered by the text's hash, then anyhow; other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, scratch_path, stored

#: Ids in a shard, about 10 MB of file; a task holds one shard's ids at a time.
SHARD_IDS = 4_000_000
#: Ids that a reader decodes at once.
DECODE_IDS = 1 << 20
MANIFEST = "partition int, piece int, name string, n_docs long, n_ids long"
READ = "name string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def write(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards and returns the stored manifest: name, n_docs, n_ids, shard_start."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from tessera.llm.simple8b import to_file
        from tessera.llm.tokens import encoder, in_groups

        context, end = TaskContext.get(), np.array([end_id], "<u4").tobytes()
        files, folder = fs.FileSystem.from_uri(path)
        docs, parts, lengths, held, piece = [], [], [], 0, 0

        def flush():
            nonlocal docs, parts, lengths, held, piece
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"{context.partitionId():08d}-{piece:06d}.s8b"
            files.create_dir(folder, recursive=True)
            trial = f"{folder}/_{name}.{context.taskAttemptId()}"
            with files.open_output_stream(trial) as out:
                out.write(to_file(docs, lengths, ids))
            files.move(trial, f"{folder}/{name}")
            row = [context.partitionId()], [piece], [name], [len(docs)], [len(ids)]
            docs, parts, lengths, held, piece = [], [], [], 0, piece + 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["partition", "piece", "name", "n_docs", "n_ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in in_groups(batch.column(1).to_pylist()):
                for doc_id, encoded in zip(ids[at : at + len(texts)], encoder(tokenizer_path).encode(texts), strict=True):
                    docs.append(doc_id)
                    parts.append(encoded + end)
                    lengths.append(len(encoded) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_ids:
                        yield flush()
        if docs:
            yield flush()

    ranked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    manifest = stored(ranked.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("partition", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.select("name", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")).alias("shard_start"))


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.simple8b import Shard

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                starts = np.cumsum(shard.lengths) - shard.lengths
                crcs, at = [], 0
                while at < len(starts):  # documents of about DECODE_IDS ids at once
                    upto = max(at + 1, int(np.searchsorted(starts, starts[at] + DECODE_IDS)))
                    last = int(starts[upto - 1] + shard.lengths[upto - 1])
                    data = memoryview(shard.ids(int(starts[at]), last).astype("<u4").tobytes())
                    for s, n in zip((starts[at:upto] - starts[at]).tolist(), shard.lengths[at:upto].tolist(), strict=True):
                        crcs.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
                    at = upto
                names = pa.array([name.as_py()] * len(starts))
                columns = [names, pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in READ.split(", ")])

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(path)
    decoded = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, READ)
    rows = decoded.join(manifest.select("name", "shard_start"), "name")
    return rows.select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    path = path or scratch_path(spark, "tokens")
    manifest = write(documents, path, tokenizer_path, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, path, manifest)
