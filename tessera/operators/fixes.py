"""Fixes: candidates checked, conflicts found, edits spliced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(candidates: DataFrame, allowed: list[str]) -> DataFrame:
    """Candidates (digest, now_digest, safety, edits, size...) with ``reason``: why one is refused, the first that holds, or null."""
    bad_range = F.exists("edits", lambda e: (e["start"] < 0) | (e["end"] < e["start"]) | (e["end"] > F.col("size")))
    reason = (
        F.when(F.col("digest") != F.col("now_digest"), "stale-source").when(F.col("edits").isNull(), "missing-fix").when(~F.col("safety").isin(allowed), "not-authorised")
        .when(F.size("edits") == 0, "no-edits").when(bad_range, "bad-range")
    )
    return candidates.withColumn("reason", reason)


def span(edits: Column) -> Column:
    """struct(start, end) of the stretch that edits reach over."""
    return F.struct(F.array_min(F.transform(edits, lambda e: e["start"])).alias("start"), F.array_max(F.transform(edits, lambda e: e["end"])).alias("end"))


def conflicted(edits: DataFrame, path: str, candidate: str) -> DataFrame:
    """(path, candidate) of candidates with an edit that conflicts with another edit of the path.

    Two replacements conflict if they overlap, two insertions if they stand at one place, an insertion and a replacement if it
    stands strictly inside. Edits are met in order of start with the largest end before them and the smallest start
    after them, so a path costs a sort, not a pair of every two edits.
    """
    e = edits.select(path, candidate, "start", "end", (F.col("start") == F.col("end")).alias("_empty"))
    own = Window.partitionBy(path)
    # Replacements: overlap some earlier one (by start) or some later one.
    by_start = own.orderBy("start", "end", candidate)
    full = e.filter(~F.col("_empty"))
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("start").over(by_start)  # the nearest start that follows decides
    hit = full.withColumns({"_b": before, "_a": after}).filter((F.col("_b") > F.col("start")) | (F.col("_a") < F.col("end")))
    # Insertions at one place.
    same = e.filter("_empty").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(path, "start"))).filter("_n > 1")
    # Insertions inside replacements: the insertion sees the largest end among earlier starts, the replacement the nearest insertion after its start.
    order = own.orderBy("start", F.col("_empty").desc(), "end")  # at one start an insertion comes first: a boundary isn't inside
    reach = F.max(F.when(~F.col("_empty"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("_empty"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    mixed = e.withColumns({"_r": reach, "_l": later}).filter((F.col("_empty") & (F.col("_r") > F.col("start"))) | (~F.col("_empty") & (F.col("_l") > F.col("start")) & (F.col("_l") < F.col("end"))))
    return hit.select(path, candidate).unionByName(same.select(path, candidate)).unionByName(mixed.select(path, candidate)).distinct()


def import_conflicts(imports: DataFrame, path: str, candidate: str) -> DataFrame:
    """(path, candidate) whose required imports give one name to several packages, or one package several names."""
    by_name = imports.groupBy(path, "name").agg(F.count_distinct("import_path").alias("n")).filter("n > 1").select(path, "name")
    by_path = imports.groupBy(path, "import_path").agg(F.count_distinct("name").alias("n")).filter("n > 1").select(path, "import_path")
    a = imports.join(by_name, [path, "name"], "left_semi").select(path, candidate)
    return a.unionByName(imports.join(by_path, [path, "import_path"], "left_semi").select(path, candidate)).distinct()


def spliced(text: Column, edits: Column) -> Column:
    """The text with non-conflicting edits (array of start, end, new_text; character offsets) applied from right to left."""
    ordered = F.array_sort(edits, lambda a, b: F.when(a["start"] != b["start"], F.sign(b["start"] - a["start"]).cast("int")).otherwise(F.sign(b["end"] - a["end"]).cast("int")))
    cut = lambda s, e: F.concat(F.substring(s, F.lit(1), e["start"]), e["new_text"], F.substring(s, e["end"] + 1, F.length(s)))
    return F.aggregate(ordered, text, cut)
