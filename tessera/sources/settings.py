"""Settings files: project configuration (TOML) and baselines (JSON), read strictly.

They are small and steer a run, so they are read on the driver; their rules and entries become dimensions for joins.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Profiles with the presets that they switch on, and the rules that the second adds.
PROFILES = {
    "default": ("correctness",),
    "recommended": ("correctness",),
    "strict": ("correctness", "suspicious", "performance", "complexity", "style"),
    "pedantic": ("correctness", "suspicious", "performance", "complexity", "style", "pedantic"),
}
RECOMMENDED = (
    "almost-swapped defer-before-error-check defer-in-infinite-loop errors-is-arguments http-response-body-not-closed identical-branches ignored-append-result "
    "ineffective-value-receiver-assignment nil-error-wrap nilness overwritten-error resource-used-after-close shadowed-error subsumed-condition suspicious-range "
    "suspicious-string-conversion time-duration-unit typed-nil-error-return unchecked-rows-error unchecked-scanner-error"
).split()
SEVERITIES = ("off", "warn", "error")
#: Presets that are no groups: their rules are named one by one.
UNGROUPED = ("restriction", "migration")
PRESETS = ("correctness", "suspicious", "performance", "complexity", "style", "pedantic", "nursery", "restriction", "migration")
# The keys of each table and the types of their values.
TABLES = {
    "": {"version": int, "format": dict, "analysis": dict, "lint": dict, "cache": dict},
    "format": {"line-width": int, "tab-width": int},
    "analysis": {"build-tags": list, "goos": str, "goarch": str, "cgo-enabled": bool, "targets": list, "contract-files": list},
    "lint": {"profile": str, "preset": str, "presets": list, "warnings-as-errors": bool, "rules": dict, "rule-options": dict, "overrides": list, "suppressions": dict, "baseline": dict},
    "lint.overrides": {"paths": list, "rules": dict},
    "lint.suppressions": {"require-reason": bool, "expiry-cutoff": str},
    "lint.baseline": {"path": str, "report-stale": bool, "expiry-cutoff": str},
    "analysis.targets": {"tags": list, "goos": str, "goarch": str, "cgo-enabled": bool},
    "cache": {"enabled": bool, "max-entries": int, "max-bytes": int},
}
VERSION = 1


class SettingsError(ValueError):
    pass


def portable_path(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\\" not in path and all(s not in ("", ".", "..") for s in path.split("/"))


def strict_date(text: str) -> bool:
    try:
        return date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


@dataclass(frozen=True)
class Config:
    """A project's policy: presets, the rules a profile adds, rules set by name, options, overrides in order, and the rest as read."""

    presets: tuple[str, ...] = PROFILES["default"]
    profile: str = "default"
    profile_rules: tuple[str, ...] = ()
    rules: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    overrides: tuple[tuple[tuple[str, ...], dict], ...] = ()
    warnings_as_errors: bool = False
    require_reason: bool = False
    suppression_cutoff: str = ""
    baseline_path: str = ""
    report_stale: bool = False
    baseline_cutoff: str = ""
    tables: dict = field(default_factory=dict)


def _table(name: str, value: dict) -> dict:
    known = TABLES[name]
    for k, v in value.items():
        where = f"{name}.{k}".lstrip(".")
        if k not in known:
            raise SettingsError(f"{where}: unknown key")
        if not isinstance(v, known[k]) or known[k] is int and isinstance(v, bool):
            raise SettingsError(f"{where}: expected {known[k].__name__}")
    return value


def _severities(where: str, rules: dict, known: set[str]) -> dict:
    for rule, severity in rules.items():
        if rule not in known:
            raise SettingsError(f"{where}.{rule}: unknown rule")
        if severity not in SEVERITIES:
            raise SettingsError(f"{where}.{rule}: expected one of {', '.join(SEVERITIES)}")
    return dict(rules)


def config(text: str, registry: dict) -> Config:
    """The configuration of a file's text; ``registry`` are the rules by id. Unknown keys, wrong types and unknown rules are errors."""
    try:
        own = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SettingsError(str(e)) from None
    _table("", own)
    if own.get("version") != VERSION:
        raise SettingsError(f"version: expected {VERSION}")
    form, analysis, lint, cache = (_table(k, own.get(k, {})) for k in ("format", "analysis", "lint", "cache"))
    for table, keys in ((form, ("line-width", "tab-width")),):
        for k in keys:
            if table.get(k, 1) < 1:
                raise SettingsError(f"format.{k}: must be positive")
    for k in ("max-entries", "max-bytes"):
        if cache.get(k, 0) < 0:
            raise SettingsError(f"cache.{k}: must not be negative")
    if cache.get("enabled") and not (cache.get("max-entries") or cache.get("max-bytes")):
        raise SettingsError("cache: an enabled cache needs a bound")
    for t in analysis.get("targets", []):
        _table("analysis.targets", t)
    for tag in analysis.get("build-tags", []):
        if not isinstance(tag, str) or not re.fullmatch(r"[\w.]+", tag):
            raise SettingsError(f"analysis.build-tags: invalid tag {tag!r}")
    for p in analysis.get("contract-files", []):
        if not portable_path(p):
            raise SettingsError(f"analysis.contract-files: {p!r} is no path within the project")
    if sum(k in lint for k in ("profile", "preset", "presets")) > 1:
        raise SettingsError("lint: only one of profile, preset and presets")
    profile, extra = lint.get("profile", "default"), ()
    if profile not in PROFILES:
        raise SettingsError(f"lint.profile: unknown profile {profile}")
    presets = PROFILES[profile]
    if "preset" in lint or "presets" in lint:
        profile, presets = "", tuple(lint.get("presets", [lint["preset"]] if "preset" in lint else []))
        for p in presets:
            if p not in PRESETS or p in UNGROUPED:
                raise SettingsError(f"lint.presets: {p} can't be selected")
    elif profile == "recommended":
        extra = tuple(RECOMMENDED)
    known = set(registry)
    overrides = []
    for o in lint.get("overrides", []):
        _table("lint.overrides", o)
        for p in o.get("paths", []):
            if not isinstance(p, str) or not portable_path(p):
                raise SettingsError(f"lint.overrides.paths: {p!r} must be relative to the project")
        overrides.append((tuple(o.get("paths", ())), _severities("lint.overrides.rules", o.get("rules", {}), known)))
    options = lint.get("rule-options", {})
    for rule, values in options.items():
        if rule not in known:
            raise SettingsError(f"lint.rule-options.{rule}: unknown rule")
        for k, v in values.items():
            default = registry[rule].options.get(k)
            if default is None or type(v) is not type(default):
                raise SettingsError(f"lint.rule-options.{rule}.{k}: unknown option or wrong type")
            if type(v) is int and v < 1:
                raise SettingsError(f"lint.rule-options.{rule}.{k}: must be positive")
    waive, base = _table("lint.suppressions", lint.get("suppressions", {})), _table("lint.baseline", lint.get("baseline", {}))
    for where, table in (("lint.suppressions", waive), ("lint.baseline", base)):
        if "expiry-cutoff" in table and not strict_date(table["expiry-cutoff"]):
            raise SettingsError(f"{where}.expiry-cutoff: expected YYYY-MM-DD")
    if "path" in base and not portable_path(base["path"]):
        raise SettingsError("lint.baseline.path: must be relative to the project")
    return Config(
        presets, profile, extra, _severities("lint.rules", lint.get("rules", {}), known), options, tuple(overrides), lint.get("warnings-as-errors", False), waive.get("require-reason", False),
        waive.get("expiry-cutoff", ""), base.get("path", ""), base.get("report-stale", False), base.get("expiry-cutoff", ""), {"format": form, "analysis": analysis, "cache": cache},
    )


def severities(own: Config, registry: dict) -> dict[str, str]:
    """{rule_id: warn or error} of the rules that a configuration switches on; rules by name come after presets and profile."""
    out = {k: "warn" for k, r in registry.items() if set(own.presets) & set(r.presets)}
    out.update((k, "warn") for k in own.profile_rules if k in registry)
    out.update(own.rules)
    return {k: "error" if own.warnings_as_errors and v == "warn" else v for k, v in out.items() if v != "off"}


def profiles(spark: SparkSession, registry: dict) -> DataFrame:
    """profile, rule_id: what each profile switches on; a dimension of a few hundred rows."""
    rows = [(p, k) for p in PROFILES for k in severities(Config(PROFILES[p], p, tuple(RECOMMENDED) if p == "recommended" else ()), registry)]
    return spark.createDataFrame(rows, "profile string, rule_id string")


# -- baselines

ENTRY = "rule_id string, path string, message_key string, source_fingerprint string, count int, reason string, expires_on string"
KEY = ("rule_id", "path", "message_key", "source_fingerprint")


def _pairs(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise SettingsError("a key stands twice")
    return out


def baseline(text: str, known: Iterable[str] | None = None) -> list[dict]:
    """The entries of a baseline's text in canonical order. Unknown keys, wrong types, doubled entries and paths that aren't portable are errors."""
    try:
        own = json.loads(text, object_pairs_hook=_pairs)
    except json.JSONDecodeError as e:
        raise SettingsError(str(e)) from None
    if not isinstance(own, dict) or set(own) - {"schema_version", "entries"}:
        raise SettingsError("unknown key")
    if own.get("schema_version") != VERSION or not isinstance(own.get("entries"), list):
        raise SettingsError("unsupported version, or no list of entries")
    kinds = {"rule_id": str, "path": str, "message_key": str, "source_fingerprint": str, "count": int, "reason": str, "expires_on": str}
    known, seen = None if known is None else set(known), set()
    for i, e in enumerate(own["entries"]):
        if not isinstance(e, dict) or set(e) - set(kinds) or any(not isinstance(v, kinds[k]) or isinstance(v, bool) for k, v in e.items()):
            raise SettingsError(f"entry {i}: unknown key or wrong type")
        key = tuple(e.get(k, "") for k in KEY)
        problem = (
            "no rule" if not key[0] else "unknown rule" if known is not None and key[0] not in known else "path isn't portable" if not portable_path(key[1]) else "no message key" if not key[2]
            else "fingerprint is no digest" if not re.fullmatch("[0-9a-f]{64}", key[3]) else "count must be positive" if e.get("count", 0) <= 0
            else "expiry is no date" if e.get("expires_on") and not strict_date(e["expires_on"]) else "stands twice" if key in seen else None
        )
        if problem:
            raise SettingsError(f"entry {i}: {problem}")
        seen.add(key)
    return sorted(own["entries"], key=lambda e: (e["path"], e["rule_id"], e["message_key"], e["source_fingerprint"]))


def baseline_text(entries: Iterable[dict]) -> str:
    """A baseline's canonical text: sorted entries, two spaces, one newline at the end; it reads back as itself."""
    order = (*KEY, "count", "reason", "expires_on")
    rows = [{k: e[k] for k in order if e.get(k) not in (None, "")} for e in entries]
    rows.sort(key=lambda e: (e["path"], e["rule_id"], e["message_key"], e["source_fingerprint"]))
    text = json.dumps({"schema_version": VERSION, "entries": rows}, indent=2, ensure_ascii=False) + "\n"
    baseline(text)
    return text


def baseline_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], ENTRY)
