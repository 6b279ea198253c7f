"""Schemas of the core relations, always explicit."""

from __future__ import annotations

from pyspark.sql.types import StructType

EDIT = "struct<start:int,end:int,new_text:string>"
IMPORT = "struct<path:string,name:string>"
FIX = f"struct<name:string,safety:string,edits:array<{EDIT}>,imports:array<{IMPORT}>>"

DIAGNOSTICS = (
    "rule_id string, severity string, message_key string, message string, path string, digest string, start int, end int, targets array<string>, "
    f"related array<struct<start:int,end:int,message:string>>, notes array<string>, help string, fixes array<{FIX}>, "
    "withheld array<struct<name:string,reason:string,message:string>>"
)
BASELINE = "rule_id string, path string, message_key string, source_fingerprint string, count int, reason string, expires_on string"
SUPPRESSIONS = "ord int, scope string, rule_id string, path string, digest string, range_start int, range_end int, target_start int, target_end int, reason string, expires_on string"
RULES = "rule_id string, tier string, category string, presets array<string>, default_severity string, fixable boolean, summary string"
FILES = "path string, bytes binary, digest string, size long, newline string, bom boolean, final_newline boolean, generated boolean"

#: The order that makes any list of diagnostics the same list, whatever tasks made it.
CANONICAL = ("path", "digest", "start", "end", "rule_id", "severity", "message_key", "message", "targets", "related", "notes", "help", "fixes", "withheld")
#: Tiers from the cheapest to the deepest.
TIERS = ("lexical", "syntax", "types", "cfg", "ssa")
SEVERITIES = ("allow", "warn", "error")


def struct_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
