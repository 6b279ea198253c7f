"""Bounded retention: oldest first eviction, and most recent first admission that skips what doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pruned(entries: DataFrame, most_entries: int, most_bytes: int, group: list[str], age: str = "modified", key: str = "key", size: str = "size") -> DataFrame:
    """Entries with ``kept``: the oldest (ties by key) go until the number and the bytes of the group are within bounds."""
    newest = Window.partitionBy(*group).orderBy(F.desc(age), F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(age), F.desc(key))) <= most_entries) & (F.sum(size).over(newest) <= most_bytes)
    # Eviction from the old end stops at the first point that fits, so a newer entry that is too large alone evicts all before it.
    return entries.withColumn("_fits", fits).withColumn("kept", F.min("_fits").over(newest)).drop("_fits")


def admitted(items: Column, most: int, most_bytes: int, always_first: bool = False) -> Column:
    """Of an array of struct(id, size), most recent first, the ids kept: one that would overflow is skipped and the next is tried."""
    state = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < most) & (s["used"] + x["size"] <= most_bytes)
        if always_first:
            fits = fits | (s["n"] == 0)
        size = F.when(fits, s["used"] + x["size"]).otherwise(s["used"])
        return F.struct(F.when(fits, F.array_append(s["ids"], x["id"])).otherwise(s["ids"]).alias("ids"), size.alias("used"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(items, state, step, lambda s: s["ids"])


def waves(items: Column, most: int, most_bytes: int) -> Column:
    """Of an array of sizes, in order, the wave of each: a wave ends before the item that would be too much for it."""
    state = F.struct(F.array().cast("array<int>").alias("waves"), F.lit(0).alias("wave"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, size: Column) -> Column:
        new = (s["n"] >= most) | ((s["n"] > 0) & (s["used"] + size > most_bytes))
        wave = F.when(new, s["wave"] + 1).otherwise(s["wave"])
        return F.struct(F.array_append(s["waves"], wave).alias("waves"), wave.alias("wave"), F.when(new, F.lit(1)).otherwise(s["n"] + 1).alias("n"), F.when(new, size).otherwise(s["used"] + size).alias("used"))

    return F.aggregate(items, state, step, lambda s: s["waves"])
