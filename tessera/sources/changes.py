"""Changed lines from a diff's text, and a file's language version from the module file above it, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.summaries import nearest_ancestor

HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def hunks(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """path, first, last: inclusive ranges of lines that a unified diff adds or changes, for every file that is still there.

    A diff's sections are told apart in the row; a hunk without new lines has no range. A renamed file goes by its new path.
    """
    sections = diffs.select(F.explode(F.split(F.col(text), r"(?m)^diff --git .*\n")).alias("s")).filter("s <> ''")
    path = F.regexp_extract("s", r'(?m)^\+\+\+ "?b/(.*?)"?\t?$', 1)
    starts, counts = F.regexp_extract_all("s", F.lit(HUNK), F.lit(1)), F.regexp_extract_all("s", F.lit(HUNK), F.lit(2))
    pairs = sections.select(path.alias("path"), F.explode(F.arrays_zip(starts.alias("a"), counts.alias("n"))).alias("h")).filter("path <> ''")
    n = F.when(F.col("h.n") == "", 1).otherwise(F.col("h.n").cast("int"))
    out = pairs.select("path", F.col("h.a").cast("int").alias("first"), n.alias("n")).filter("n > 0")
    return out.select("path", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def go_versions(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files (path) with ``root`` and ``value``: the folder of the nearest module file (path, text) above, and the version that it names; null without one."""
    roots = modules.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.nullif(F.regexp_extract("text", r"(?m)^go[ \t]+(\d+\.\d+(?:\.\d+)?)[ \t]*(?://.*)?\r?$", 1), F.lit("")).alias("value"))
    return nearest_ancestor(files, roots.filter("value is not null"))
