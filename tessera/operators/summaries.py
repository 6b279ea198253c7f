"""Aggregates, orders and joins of a run's records: costs, outcomes, states, owners, nearest ancestors, worst errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes of adjudicated findings in the order of reports.
CLASSES = ("true-positive", "false-positive", "duplicate-vet", "duplicate-staticcheck", "unsupported-source", "unsupported-build", "unresolved")
DIAGNOSTIC_ORDER = ("path", "digest", "start", "end", "rule_id", "severity", "message_key", "message", "targets", "related", "notes", "help", "fixes", "withheld")
BASELINE_ORDER = ("path", "rule_id", "message_key", "source_fingerprint")
FIX_ORDER = ("path", "digest", "start", "end", "rule_id", "fix")
RESULT_ORDER = ("start", "end", "rule_id", "fix", "reason", "message")
CORPUS_ORDER = ("rule_id", "path", "start", "end", "message_key", "message")


def ordered(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows in one of the orders above, by those of its columns that there are."""
    return df.orderBy(*(n for n in names if n in df.columns))


def cost(calls: DataFrame, *keys: str) -> DataFrame:
    """keys, calls, duration, allocations: what rules or tiers have cost."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("duration").alias("duration"), F.sum("bytes").alias("bytes"))


def cache_outcomes(events: DataFrame, *keys: str) -> DataFrame:
    """keys, lookups, hits, misses, invalidations, writes from events with an outcome; a lookup is all but a write."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    out = events.groupBy(*keys).agg(of("hit").alias("hits"), of("miss").alias("misses"), of("invalidation").alias("invalidations"), of("write").alias("writes"))
    return out.withColumn("lookups", F.col("hits") + F.col("misses") + F.col("invalidations"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings, errors, warnings, files, rules."""
    return findings.agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"),
        F.count_distinct("path").alias("files"), F.count_distinct("rule_id").alias("rules"),
    )


def met(state: Column) -> Column:
    """An aggregate: the state that all rows agree on; null if one differs or isn't known."""
    return F.when((F.count(F.lit(1)) == F.count(state)) & (F.min(state) == F.max(state)), F.min(state))


def effects(paths: DataFrame, *keys: str) -> DataFrame:
    """keys, always (on all paths), kinds (on any), guaranteed (on all), from rows (happens, kinds as bits) of each path."""
    return paths.groupBy(*keys).agg(F.bool_and("happens").alias("always"), F.bit_or("kinds").alias("kinds"), F.bit_and("kinds").alias("guaranteed"))


def owners(files: DataFrame) -> DataFrame:
    """path, package: of the packages that list a file the first."""
    return files.groupBy("path").agg(F.min("package").alias("package"))


def nearest_ancestor(files: DataFrame, roots: DataFrame, deepest: int = 64) -> DataFrame:
    """Files with ``root``: the deepest folder of ``roots`` (folder, value) that they stand in, and its value.

    A file meets its own folders only, by an equi join on their names: no prefix is compared with every file.
    """
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    folders = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    met = folders.join(roots, "folder").groupBy("path").agg(F.max_by(F.struct("folder", "value"), F.length("folder")).alias("r"))
    return files.join(met, "path", "left").select(*files.columns, F.col("r.folder").alias("root"), F.col("r.value").alias("value"))


def worst(outcomes: DataFrame, *keys: str) -> DataFrame:
    """keys, code, place: the highest exit code, of equal ones the first."""
    return outcomes.groupBy(*keys).agg(F.max_by(F.struct("code", "place"), F.struct("code", -F.col("place"))).alias("w")).select(*keys, "w.code", "w.place")


def cached(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """key, value of each asked key; an entry whose content doesn't have its digest counts as missing."""
    sound = entries.filter(F.sha2("value", 256) == F.col("digest")).select("key", "value")
    return keys.join(sound, "key", "left").withColumn("outcome", F.when(F.col("value").isNotNull(), "hit").otherwise("miss"))


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """key, value, status of new entries: written where the key is new, kept where the value is the same, else a conflict."""
    old = entries.select("key", F.col("value").alias("old"))
    status = F.when(F.col("old").isNull(), "written").when(F.col("old") == F.col("value"), "kept").otherwise("conflict")
    return new.join(old, "key", "left").withColumn("status", status).drop("old")


def rendered_baseline(entries: DataFrame) -> DataFrame:
    """path, document: entries of a path as JSON in canonical order; whole baselines are the documents in order of path."""
    item = F.struct("rule_id", "message_key", "source_fingerprint", "count")
    return entries.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("document"))


def import_groups(specs: DataFrame) -> DataFrame:
    """Import specs (path, ord, line, import_path) with ``group``: a blank line begins a new one; the source's order stays."""
    own = Window.partitionBy("path").orderBy("ord")
    begins = F.when(F.col("line") - F.lag("line").over(own) > 1, 1).otherwise(0)
    return specs.withColumn("b", begins).withColumn("group", F.sum("b").over(own).cast("int")).drop("b")


def bounded_queue(requests: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Requests with ``admitted``: the first ``most`` of a session wait, later ones are refused."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return requests.withColumn("admitted", rank <= most)


def at_most_one_pending(requests: DataFrame, key: str, order: str, busy: Column) -> DataFrame:
    """Requests with ``state``: while one runs (``busy``) only the newest waits, those before it are cancelled."""
    later = F.max(F.when(busy, F.col(order))).over(Window.partitionBy(key))
    return requests.withColumn("state", F.when(~busy, "run").when(F.col(order) == later, "pending").otherwise("cancelled"))
