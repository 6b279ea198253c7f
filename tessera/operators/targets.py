"""Results of several build targets made one: union of findings, intersection of unused directives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(findings: DataFrame, target: str = "target") -> DataFrame:
    """Findings equal but for their target as one row with ``targets``, sorted."""
    rest = [c for c in findings.columns if c != target]
    return findings.groupBy(*rest).agg(F.array_sort(F.collect_set(target)).alias("targets"))


def unused_everywhere(unused: DataFrame, seen: DataFrame, key: list[str], path: str, target: str = "target", failed: list[str] | None = None) -> DataFrame:
    """Directives unused in every target in which their path was seen; none if a target failed."""
    if failed:
        return unused.select(*key).limit(0)
    times = unused.groupBy(*key).agg(F.count_distinct(target).alias("_unused"))
    seen_in = seen.groupBy(path).agg(F.count_distinct(target).alias("_seen"))
    return times.join(seen_in, path).filter("_unused = _seen").select(*key)


def one_digest(sources: DataFrame) -> DataFrame:
    """path, digest; an error where targets saw different bytes of a path."""
    both = sources.groupBy("path").agg(F.min("digest").alias("digest"), F.max("digest").alias("_other"))
    same = F.assert_true(F.col("digest") == F.col("_other"), F.concat(F.lit("different sources of "), F.col("path")))
    return both.filter(same.isNull()).drop("_other")
