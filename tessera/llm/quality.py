"""Quality rules from cross-document line frequency, in DataFrame functions only.

One pass over the texts works out the base counts and each line's digest (without regard to case, white space, digits) and words; both halves
of the rule read that stored table. For each host, distinct documents with a line are counted; a line above the limits is
boilerplate and is removed: in more than ``LEAST_DOCS`` documents and either in more than ``SHARE_OF_HOST`` of the host's or in more than ``MOST_DOCS``, however large
the host. A document is rejected if it fails the base rules, or if removal depletes it: too small a share of its words is left.

Counts are made in each task before they are dealt out, by (host, line, document), so a hot host or line isn't
one task's work; the lines over the limit meet the documents' lines again in a join that adaptive execution can split.

Defined results: a document is a doc_id (null ones are one document); rows of one doc_id are judged each by itself; null text has no words and fails
the base rules, and isn't counted in its host; a null host is a host of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
#: A line may always stand in so many of a host's documents.
LEAST_DOCS = 20
SHARE_OF_HOST = 0.02
MOST_DOCS = 1000
#: Of a document's words, the share that has to be left.
LEFT = 0.5
LEAST_WORDS = 50


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_hash(line: Column) -> Column:
    """The digest of a line without regard to case, digits and amount of white space."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), SPACE, " "), "[0-9]+", "0"))


def base_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, host, has_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines: digest and words of each) of each row."""
    one = documents.select(F.col("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    two = one.withColumns({"words": words_of(text), "own": lines_of(text)})
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    three = two.withColumns({"n": F.size("words"), "three": F.when(F.size("words") > 2, F.slice(hashes, 1, F.size("words") - 2))})
    # Windows with a twin: hashes in order, with their places, of which neighbours are equal. Texts without one skip the sort.
    some = F.size(F.array_distinct("three")) < F.size("three")
    four = three.withColumn("sorted", F.when(some, F.array_sort(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, i: F.when((x["h"] == F.get("sorted", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("sorted", F.greatest(i - 1, F.lit(0)))["h"])), x["i"])
    five = four.withColumn("places", F.array_sort(F.filter(F.transform("sorted", twin), lambda p: p.isNotNull())))
    covered = F.aggregate("places", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    return five.select(
        "doc_id", "host", F.col("text").isNotNull().alias("has_text"), F.col("n").cast("long").alias("n_words"), F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), F.transform("own", lambda x: F.struct(normal_hash(x).alias("h"), F.size(words_of(x)).alias("n"))).alias("lines"),
    )


def boilerplate(counted: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE_OF_HOST, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, line: digest, n_docs) of lines above the limits, from stored ``base_counts``."""
    own = counted.filter("has_text")
    sizes = own.groupBy("host", "doc_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    per_doc = own.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("line")).groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one"))
    counts = per_doc.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > least_docs)
    limit = counts.join(sizes, counts["host"].eqNullSafe(sizes["host"])).filter((F.col("n_docs") > F.col("n_host") * share) | (F.col("n_docs") > most_docs))
    return limit.select(counts["host"], "line", "n_docs")


def judged(documents: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE_OF_HOST, most_docs: int = MOST_DOCS, left: float = LEFT) -> DataFrame:
    """doc_id, base counts, base_failed, kept, removed_words (of boilerplate lines), for every row."""
    counted = stored(base_counts(documents).withColumn("row", F.monotonically_increasing_id()), "counted")
    common = stored(boilerplate(counted, least_docs, share, most_docs), "boilerplate").select(F.col("host").alias("of_host"), F.col("line").alias("h"))
    lines = counted.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    met = lines.join(common, (lines["h"] == common["h"]) & F.col("host").eqNullSafe(F.col("of_host")))
    removed = stored(met.groupBy("row").agg(F.sum("n").alias("gone")), "removed")
    gone = F.coalesce("gone", F.lit(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= left * F.col("n_words"))).alias("kept"), gone.alias("removed_words"),
    )
