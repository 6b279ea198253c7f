"""Versioned change streams: the newest version of each key, bursts, superseded results. The batch forms first, then live ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """The newest version of each key with the named columns: one aggregation with partial sums in each task, no sort."""
    return changes.groupBy(key).agg(F.max_by(F.struct(version, *columns), version).alias("_m")).select(key, "_m.*")


def debounced(events: DataFrame, key: str, at: str, gap: str, tie: str) -> DataFrame:
    """The last event of each burst: one that no event of its key follows within ``gap``."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    return events.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") > F.col(at) + F.expr(f"INTERVAL {gap}"))).drop("_next")


def bursts(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """key, first, last, n of runs of events that follow each other within ``gap``."""
    own = F.session_window(F.col(at), gap)
    return events.groupBy(key, own.alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def current(results: DataFrame, documents: DataFrame, key: list[str]) -> DataFrame:
    """Results that still belong to the current documents: same key, version and digest."""
    return results.join(documents.select(*key), key, "left_semi")


def coalesced(paths: DataFrame, group: str, path: str, most: int = 4096) -> DataFrame:
    """group, n, everything, paths: the distinct changed paths of a group, or, above ``most``, the word to look at everything.

    Distinct paths are counted before they are gathered, and only groups within the bound are gathered.
    """
    each = paths.select(group, path).distinct()
    counts = each.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    small = each.join(counts.filter(F.col("n") <= most), group).groupBy(group, "n").agg(F.array_sort(F.collect_list(path)).alias("paths"))
    return small.select(group, "n", F.lit(False).alias("everything"), "paths").unionByName(counts.filter(F.col("n") > most).select(group, "n", F.lit(True).alias("everything"), F.array().cast("array<string>").alias("paths")))


def latest_stream(changes: DataFrame, key: str, version: str, columns: dict[str, str]) -> DataFrame:
    """A stream of the rows that are newer than anything seen of their key; state is the highest version of each key."""
    kinds = changes.schema
    version_kind = kinds[version].dataType.simpleString()
    key_kind = kinds[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {key_kind}", f"`{version}` {version_kind}", *(f"`{c}` {t}" for c, t in columns.items())])

    def step(own_key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        seen = state.get[0] if state.exists else None
        rows = pd.concat(list(batches))
        best = rows.loc[rows[version].idxmax()]
        if seen is None or best[version] > seen:
            state.update((int(best[version]),))
            yield pd.DataFrame([[own_key[0], best[version], *(best[c] for c in columns)]], columns=[key, version, *columns])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return changes.select(key, version, *columns).groupBy(key).applyInPandasWithState(step, schema, f"seen {version_kind}", "append", GroupStateTimeout.NoTimeout)


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str):
    """Starts a query that hands each micro-batch to ``sink`` and stops when the available input is done."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def incremental(changed: DataFrame, edges: DataFrame, cached: DataFrame, work: Callable[[DataFrame], DataFrame], key: str = "node") -> DataFrame:
    """Cached results of what no change reaches, and new results of the rest."""
    from tessera.operators.graph import affected

    again = affected(changed, edges)
    return cached.join(again, key, "left_anti").unionByName(work(again))
