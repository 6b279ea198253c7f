"""Reports: dispositions, machine-readable documents, annotations, source frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISPOSITIONS = ("visible", "preexisting", "suppressed", "baselined")


def dispositions(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, findings and a count for each disposition, zero rows for selected rules without findings."""
    sums = [F.sum((F.col("disposition") == d).cast("long")).alias(d) for d in DISPOSITIONS]
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), *sums)
    out = rules.select("rule_id").join(counts, "rule_id", "left")
    return out.select("rule_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("findings", *DISPOSITIONS)))


def tier_reasons(selection: DataFrame) -> DataFrame:
    """tier, rules: the sorted rules that ask for a tier; types is also asked for by every deeper rule."""
    needs = F.when(F.col("tier").isin("cfg", "ssa"), F.array("tier", F.lit("types"))).otherwise(F.array("tier"))
    return selection.select(F.explode(needs).alias("tier"), "rule_id").groupBy("tier").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def annotation_text(value: Column) -> Column:
    """Text of a workflow command: per cent, carriage return and newline escaped."""
    for plain, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def annotation_property(value: Column) -> Column:
    """A property's value: colon and comma escaped besides."""
    value = annotation_text(value)
    for plain, code in ((":", "%3A"), (",", "%2C")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def annotations(findings: DataFrame) -> DataFrame:
    """``out``: a workflow command for each finding (path, line, severity, rule_id, message)."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    return findings.withColumn("out", F.concat(F.lit("::"), level, F.lit(" file="), annotation_property(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit(",title="), annotation_property(F.col("rule_id")), F.lit("::"), annotation_text(F.col("message"))))


def short_text(findings: DataFrame) -> DataFrame:
    """``out``: path:line:column: severity: message [rule]."""
    return findings.withColumn("out", F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), (F.col("start") + 1).cast("string"), F.lit(": "), F.col("severity"), F.lit(": "), F.col("message"), F.lit(" ["), F.col("rule_id"), F.lit("]")))


def json_documents(findings: DataFrame, order: list[str]) -> DataFrame:
    """path, document: one JSON document for each path, its findings in canonical order.

    A document for each path keeps every list as small as one path's findings; a whole report is the sorted concatenation of them.
    """
    item = F.struct(*(c for c in order if c != "path"))
    lists = findings.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("diagnostics"))
    return lists.select("path", F.to_json(F.struct(F.lit(1).alias("schema_version"), "path", "diagnostics")).alias("document"))


def sarif(findings: DataFrame, rules: DataFrame, tool: str = "tessera") -> DataFrame:
    """path, document: a SARIF 2.1.0 log for each path, with the distinct sorted rules of its results."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), (F.col("start") + 1).alias("startColumn"), (F.col("end") + 1).alias("endColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("line").alias("l"), F.col("start").alias("s"), F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    described = findings.join(F.broadcast(rules.select("rule_id", "summary")), "rule_id", "left")
    lists = described.groupBy("path").agg(F.array_sort(F.collect_list(result)).alias("r"), F.array_sort(F.collect_set(F.struct(F.col("rule_id").alias("id"), F.struct(F.coalesce("summary", F.lit("")).alias("text")).alias("shortDescription")))).alias("rules"))
    results = F.transform("r", lambda x: F.struct(x["ruleId"].alias("ruleId"), x["level"].alias("level"), x["message"].alias("message"), x["locations"].alias("locations")))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), results.alias("results"))
    return lists.select("path", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def frames(findings: DataFrame, lines: DataFrame, key: str, around: int = 1) -> DataFrame:
    """Findings with each line from ``around`` before to ``around`` after: an equi join on exploded line numbers."""
    wanted = findings.withColumn("shown", F.explode(F.sequence(F.greatest(F.col("line") - around, F.lit(1)), F.col("line") + around)))
    text = lines.select(key, F.col("line").alias("shown"), "t")
    return wanted.join(text, [key, "shown"])


def exit_code(findings: DataFrame) -> DataFrame:
    """code: 1 with a finding that is an error, else 0; warnings alone don't fail."""
    return findings.agg(F.coalesce(F.max((F.col("severity") == "error").cast("int")), F.lit(0)).alias("code"))


# What a run's end tells, by the worst thing that happened in it.
EXITS = {"success": 0, "findings": 1, "source": 2, "invocation": 3, "conflict": 4, "filesystem": 5, "internal": 6, "cancelled": 130}
