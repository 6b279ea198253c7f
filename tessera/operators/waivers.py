"""Waivers over findings: suppressions, baselines with multiplicities, superseded findings, changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suppressed(findings: DataFrame, directives: DataFrame, key: list[str], at: str = "line") -> DataFrame:
    """Each finding with the first directive, in their order ``ord``, that holds its place (the column ``at``: a line, or the offset of its start), or null.

    ``directives`` (key..., first, last, ord) are grouped into one array a key, so the join is an equi join and
    no finding is multiplied by the directives that it is held against.
    """
    lists = directives.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "first", "last"))).alias("_ds"))
    met = findings.join(lists, key, "left")
    hit = F.filter("_ds", lambda d: (d["first"] <= F.col(at)) & (F.col(at) < d["last"]))
    return met.withColumn("directive", F.get(hit, F.lit(0))["ord"]).drop("_ds")


def unused(directives: DataFrame, met: DataFrame, key: list[str]) -> DataFrame:
    """Directives that are no finding's first."""
    used = met.filter("directive is not null").select(*key, F.col("directive").alias("ord")).distinct()
    return directives.join(used, [*key, "ord"], "left_anti")


def baseline_of(findings: DataFrame, key: list[str]) -> DataFrame:
    """The baseline that hides these findings: key and count."""
    return findings.groupBy(*key).agg(F.count(F.lit(1)).alias("count"))


def apply_baseline(findings: DataFrame, baseline: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Findings with ``hidden``: the first ``count`` of each key, in canonical order. Expired entries are left out by the caller.

    Rows of keys that the baseline doesn't have aren't ranked: they need no window, so only waived keys are sorted.
    """
    entries = baseline.select(*key, F.col("count").alias("_n"))
    met = findings.join(entries, key, "left")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    waived = met.filter("_n is not null").withColumn("hidden", rank <= F.col("_n"))
    rest = met.filter("_n is null").withColumn("hidden", F.lit(False))
    return waived.unionByName(rest).drop("_n")


def stale(baseline: DataFrame, findings: DataFrame, analysed: DataFrame, key: list[str], path: str, cutoff: Column) -> DataFrame:
    """Entries of analysed paths that hide fewer findings than they count: key, remaining. Expired ones aren't stale."""
    live = baseline.filter(F.col("expires_on").isNull() | (F.col("expires_on") > cutoff)).join(analysed.select(path).distinct(), path, "left_semi")
    met = baseline_of(findings, key).withColumnRenamed("count", "_met")
    out = live.join(met, key, "left").withColumn("remaining", F.col("count") - F.coalesce("_met", F.lit(0)))
    return out.filter("remaining > 0").select(*key, "remaining")


def expired(baseline: DataFrame, analysed: DataFrame, key: list[str], path: str, cutoff: Column) -> DataFrame:
    return baseline.filter(F.col("expires_on") <= cutoff).join(analysed.select(path).distinct(), path, "left_semi").select(*key, "expires_on")


def superseded(findings: DataFrame, pairs: list[tuple[str, str]], place: list[str]) -> DataFrame:
    """Findings without those whose exact place has a finding of a more specific rule; pairs are (specific, generic)."""
    spark = findings.sparkSession
    table = F.broadcast(spark.createDataFrame(pairs, "specific string, generic string"))
    specific = findings.join(table, findings["rule_id"] == table["specific"]).select(*place, F.col("generic").alias("rule_id"))
    return findings.join(specific, [*place, "rule_id"], "left_anti")


def merged_ranges(ranges: DataFrame, key: list[str], gap: int = 1) -> DataFrame:
    """Inclusive ranges (first, last) of each key, those that overlap or stand ``gap`` apart made one."""
    before = Window.partitionBy(*key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.coalesce(F.col("first") > F.max("last").over(before) + gap, F.lit(True)).cast("int")
    islands = ranges.withColumn("_new", begins).withColumn("_island", F.sum("_new").over(upto))
    return islands.groupBy(*key, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def in_scope(findings: DataFrame, ranges: DataFrame, key: list[str], first: str = "line", last: str = "line") -> DataFrame:
    """Findings with ``changed``: whether they overlap a changed range of their key. Ranges are grouped, so no finding is multiplied."""
    lists = ranges.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("_rs"))
    met = findings.join(lists, key, "left")
    overlaps = F.exists("_rs", lambda r: (F.col(first) <= r["last"]) & (r["first"] <= F.col(last)))
    return met.withColumn("changed", F.coalesce(overlaps, F.lit(False))).drop("_rs")


def owned_fixes(fixes: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """Fixes (key..., fix, edits: array of first, last) every line of whose every edit is in a changed range."""
    lists = merged_ranges(ranges, key).groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("_rs"))
    met = fixes.join(lists, key)
    return met.filter(F.forall("edits", lambda e: F.exists("_rs", lambda r: (r["first"] <= e["first"]) & (e["last"] <= r["last"])))).drop("_rs")
