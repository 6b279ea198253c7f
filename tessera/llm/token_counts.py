"""Exact histogram of encoded lengths, and its suffix sums.

Documents are counted by length before anything is shuffled, so the histogram has a row for each
distinct length, whatever the number of documents. Suffix sums are made in two levels: within
ranges of lengths side by side, and over the ranges' sums.

Defined results: null or empty text has length 0; repeated rows count each; other columns are
ignored; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, stored

#: Lengths in a range of the suffix sums.
RANGE = 128


def lengths(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row ``length`` for each document: ids of its whole text, without special tokens."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.tokens import encoder, in_groups

        for batch in batches:
            found = [len(x) // 4 for _, texts in in_groups(batch.column(0).to_pylist()) for x in encoder(tokenizer_path).encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["length"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("text").cast("string")).mapInArrow(run, "length long")


def histogram(length_rows: DataFrame) -> DataFrame:
    """length, n_docs, and for a context limit of that length: documents and tokens of that length or longer, of shorter ones,
    the truncated total (each document cut to the limit), and the share of documents that fit."""
    counts = length_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = stored(counts.withColumn("part", (F.col("length") / RANGE).cast("long")), "histogram")  # read twice below, made once
    upto = Window.partitionBy("part").orderBy("length")
    within = counts.withColumns({
        "d": F.sum("n_docs").over(upto), "t": F.sum(F.col("n_docs") * F.col("length")).over(upto),
    })
    parts = within.groupBy("part").agg(F.max("d").alias("pd"), F.max("t").alias("pt"))
    every = Window.orderBy("part")  # a row a range: the longest document's length over RANGE at most
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    parts = parts.select(
        "part", F.coalesce(F.sum("pd").over(before), zero).alias("bd"), F.coalesce(F.sum("pt").over(before), zero).alias("bt"),
        F.sum("pd").over(whole).alias("docs"), F.sum("pt").over(whole).alias("tokens"),
    )
    upto_docs, upto_tokens = F.col("bd") + F.col("d"), F.col("bt") + F.col("t")
    longer = F.col("docs") - upto_docs
    return within.join(parts, "part").select(
        "length", "n_docs", (longer + F.col("n_docs")).alias("docs_at_least"), (F.col("tokens") - upto_tokens + F.col("n_docs") * F.col("length")).alias("tokens_at_least"),
        upto_docs.alias("docs_up_to"), upto_tokens.alias("tokens_up_to"), (upto_tokens + longer * F.col("length")).alias("truncated_total"),
        (upto_docs / F.col("docs")).alias("share_that_fits"),
    )


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left when each document is cut to ``limit``, which needn't be a length of the histogram."""
    row = hist.filter(F.col("length") > limit).agg(F.sum("n_docs").alias("d")).first()
    short = hist.filter(F.col("length") <= limit).agg(F.max("tokens_up_to").alias("t")).first()
    return (short["t"] or 0) + limit * (row["d"] or 0)


def quantile(hist: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents don't exceed."""
    return hist.filter(F.col("share_that_fits") >= share).agg(F.min("length").alias("q")).first()["q"]
