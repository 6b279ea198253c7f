"""The registry as reports: lists, a table, an explanation, and documents of a run's results."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule_id string, tier string, presets array<string>, fixable boolean, options string, summary string"
#: Rules whose findings may come with a fix, told by running them over the authored code.
DOCUMENT_VERSION = 1


def dimension(spark: SparkSession, rules: dict, fixable: Iterable[str] = ()) -> DataFrame:
    fixable = set(fixable)
    rows = [(r.rule_id, r.tier, list(r.presets), r.rule_id in fixable, json.dumps(r.options, sort_keys=True, default=list), r.summary) for r in rules.values()]
    return spark.createDataFrame(rows, RULE)


def listed(rules: DataFrame, preset: str | None = None, tier: str | None = None, fixable: bool | None = None) -> DataFrame:
    """The rules of a preset, tier or kind, in order of their ids."""
    out = rules
    if preset is not None:
        out = out.filter(F.array_contains("presets", preset))
    if tier is not None:
        out = out.filter(F.col("tier") == tier)
    if fixable is not None:
        out = out.filter(F.col("fixable") == fixable)
    return out.orderBy("rule_id")


def list_text(rules: DataFrame) -> DataFrame:
    """``out``: a line for each rule."""
    return rules.select("rule_id", F.concat_ws("  ", "rule_id", "tier", F.array_join("presets", ","), "summary").alias("out"))


def markdown(rules: DataFrame) -> DataFrame:
    """``out``: a row of a table for each rule; bars in texts are escaped."""
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    return rules.select("rule_id", F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(F.lit("`"), "rule_id", F.lit("`")), "tier", F.array_join("presets", ", "), F.when(F.col("fixable"), "yes").otherwise("no"), cell(F.col("summary"))), F.lit(" |")).alias("out"))


def explained(rule, fixable: bool = False) -> str:
    """What there is to say about one rule."""
    lines = [rule.rule_id, "", f"It finds where {rule.summary}.", "", f"tier: {rule.tier}", f"presets: {', '.join(rule.presets)}", f"fix: {'offered' if fixable else 'none'}"]
    return "\n".join(lines + [f"option {k}: {json.dumps(v, default=list)}" for k, v in sorted(rule.options.items())]) + "\n"


def lint_documents(findings: DataFrame) -> DataFrame:
    """path, document: a file's findings (path, rule_id, severity, message_key, line, column, start, end, disposition) as JSON, visible ones in
    canonical order and counts of the others. A run's envelope is the documents in order of path between a head and a foot."""
    item = F.struct("start", "end", "rule_id", "severity", "message_key", "line", "column")
    out = findings.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("disposition") == "visible", item))).alias("diagnostics"),
        F.count_if(F.col("disposition") == "suppressed").alias("suppressed"), F.count_if(F.col("disposition") == "baselined").alias("baselined"),
    )
    return out.select("path", F.to_json(F.struct(F.lit(DOCUMENT_VERSION).alias("schema_version"), "path", "diagnostics", "suppressed", "baselined")).alias("document"))


def fix_documents(fixed: DataFrame) -> DataFrame:
    """path, document: what fixes were applied to and refused of each file."""
    status = F.when(F.col("applied") > 0, "fixed").when(F.exists("refused", lambda r: r["reason"].isin("conflict", "validation")), "conflict").otherwise("unchanged")
    return fixed.select("path", F.to_json(F.struct(F.lit(DOCUMENT_VERSION).alias("schema_version"), "path", status.alias("status"), "applied", F.array_sort("refused").alias("rejected"), F.col("digest").alias("sha256"))).alias("document"))


def format_documents(formatted: DataFrame) -> DataFrame:
    """path, document: whether a file's layout changes, and why it can't."""
    return formatted.select("path", F.to_json(F.struct(F.lit(DOCUMENT_VERSION).alias("schema_version"), "path", "changed", "error")).alias("document"))
