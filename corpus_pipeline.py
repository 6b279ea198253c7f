"""A corpus pipeline of five of the operators: what one stage keeps is written and read again as the next one's documents.

Defined results, of every stage: all columns of the documents stay, whatever others there are; no documents give no rows. Null and empty texts score the base rate
of toxicity and stay there; they have no letter, so the language stage drops them. Null ids stay until near copies are dropped, where a row without an id is kept only
if its group has no other. Of repeated rows the near copies' stage keeps one. Where there are no labels of both kinds nothing is toxic; where
no document names its language every document is in an unknown one. Very long texts are read whole; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language, near_copies, packing, passages, toxicity
from tessera.llm.common import bounded_batches, stored, table
from tessera.llm.queries import BYTE_BPE, vocabulary

#: Rows and bytes of a batch that goes to a Python worker, and rows of one that Spark decodes from Parquet. One executor goes through all stages, and its JVM can be
#: large from the ones before, so batches of texts are smaller here than where an operator runs alone.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 1_000, 2 << 20, 512


def _small_batches(spark: SparkSession) -> None:
    bounded_batches(spark, BATCH_ROWS, BATCH_BYTES, READ_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a field fitted on the labelled ones."""
    _small_batches(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the documents name, by models of a sample of each."""
    _small_batches(spark)
    return language.accepted(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: similarity 0.8 at least of their sets of 5-word shingles.

    Fingerprints of 64 bits can't tell that: at this similarity they differ in up to 16 bits, a distance at which partitions leave out hardly any pair
    (figures in the README). So candidates come from bands of minima, and each is verified on whole sets.
    """
    _small_batches(spark)
    return near_copies.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand in an earlier one."""
    _small_batches(spark)
    return passages.deduplicated(docs)


#: Chunks that a worker remembers while it packs, and characters that it encodes together: the JVM beside it can still hold heap of the stages before,
#: so a worker takes less here than where packing runs alone.
REMEMBERED, MOST_CHARS = 100_000, 500_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    _small_batches(spark)
    return packing.pack(docs, vocabulary(BYTE_BPE), end_id=1, remembered=REMEMBERED, most_chars=MOST_CHARS)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", packed)]

#: The models and hashes of the stages are out of SQL's reach; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
