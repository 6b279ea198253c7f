"""Rule selection: presets, rule overrides, only/except, ordered levels with forbid, per-path overrides.

The registry has some hundred rules, so the fold runs on the driver and its result is a small dimension.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("allow", "warn", "deny", "forbid")


class PolicyError(ValueError):
    pass


def resolve(rules: Iterable, presets: Iterable[str], overrides: dict[str, str] | None = None, levels: Iterable[tuple[str, str]] = (), only: Iterable[str] = (), without: Iterable[str] = ()) -> dict[str, str]:
    """{rule_id: severity} of the selected rules.

    Presets enable rules at their default severity; overrides by rule come next; then levels in order, each a (level,
    target) whose target is a rule, a preset or "warnings" (what is at warn just then). A forbidden rule can't be weakened later.
    """
    rules = list(rules)
    by_id = {r.rule_id: r for r in rules}
    known = {p for r in rules for p in r.presets}
    presets, only, without = set(presets), set(only), set(without)
    for name in (overrides or {}).keys() | only | without:
        if name not in by_id:
            raise PolicyError(f"unknown rule {name}")
    state = {r.rule_id: "warn" if presets & set(r.presets) else "allow" for r in rules} | (overrides or {})
    forbidden: set[str] = set()
    for level, target in levels:
        if level not in LEVELS:
            raise PolicyError(f"unknown level {level}")
        if target == "warnings":
            hit = [k for k, v in state.items() if v == "warn"]
        elif target in by_id:
            hit = [target]
        elif target in known:
            hit = [r.rule_id for r in rules if target in r.presets]
        else:
            raise PolicyError(f"unknown target {target}")
        for k in hit:
            if k in forbidden and level in ("allow", "warn"):
                raise PolicyError(f"{k} is forbidden and can't be set to {level}")
            state[k] = {"deny": "error", "forbid": "error"}.get(level, level)
        if level == "forbid":
            forbidden.update(hit)
    return {k: v for k, v in state.items() if v != "allow" and (not only or k in only) and k not in without}


def glob_pattern(glob: str) -> str:
    """A regular expression (for rlike) of a segment glob: ``**`` stands for any number of segments, ``*`` and ``?`` stay in one."""
    out = []
    parts = glob.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        out.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def last_match(paths: DataFrame, overrides: list[tuple[str, str, str]], path: str = "path") -> DataFrame:
    """path, rule_id, severity by the last of (glob, rule_id, severity) that matches. Overrides are few and go into the expression."""
    if not overrides:
        return paths.select(path).distinct().select(path, F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("severity")).limit(0)
    rules = list(dict.fromkeys(r for _, r, _ in overrides))

    def severity(rule: str) -> Column:
        own = [(g, s) for g, r, s in overrides if r == rule]
        out = F.lit(None).cast("string")
        for g, s in own:  # a later match wins, so it is asked first
            out = F.when(F.col(path).rlike(glob_pattern(g)), s).otherwise(out)
        return F.struct(F.lit(rule).alias("rule_id"), out.alias("severity"))

    each = paths.select(path).distinct().select(path, F.explode(F.array(*map(severity, rules))).alias("x"))
    return each.select(path, "x.*").filter("severity is not null")


def superset(base: dict[str, str], overrides: list[tuple[str, str, str]]) -> dict[str, str]:
    """What any path could enable: the policy that a scan runs under before per-path severities apply; errors stay."""
    rank = {"allow": 0, "warn": 1, "error": 2}
    out = dict(base)
    for _, rule, severity in overrides:
        if rank[severity] > rank[out.get(rule, "allow")]:
            out[rule] = severity
    return out


def ranked(column: str, order: tuple[str, ...]) -> Column:
    """The place of a value in an order, from 0."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(column)) - 1


def deepest(selection: DataFrame) -> DataFrame:
    """The deepest tier of the selected rules, which decides how much is loaded."""
    from tessera.schemas import TIERS

    return selection.agg(F.max(F.struct(ranked("tier", TIERS).alias("r"), "tier")).alias("m")).select(F.col("m.tier").alias("tier"))


def dominant(rows: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """The commonest value of each group, the first seen of equally common ones: group, value, n."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "_first"))
    return counts.withColumn("_r", rank).filter("_r = 1").select(*group, value, "n")
