"""Rules over lines of texts, all evaluated in one scan: a text becomes an array of findings, which is exploded.

The rules stand in for lint rules over tables that hold prose; they show the algebra, not the Go rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "struct<rule_id:string,line:bigint,start:bigint,end:bigint,message_key:string>"


def finding(rule_id: str, line: Column, start: Column, end: Column, key: str) -> Column:
    parts = {"rule_id": F.lit(rule_id), "line": line.cast("long"), "start": start.cast("long"), "end": end.cast("long"), "message_key": F.lit(key)}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


@dataclass(frozen=True)
class Rule:
    """A rule of the registry. ``find`` maps a column of lines (array of strings) to an array of findings."""

    rule_id: str
    tier: str
    presets: tuple[str, ...]
    summary: str
    find: Callable[[Column], Column]
    fixable: bool = False


def per_line(rule_id: str, key: str, holds: Callable[[Column], Column], start: Callable[[Column], Column], end: Callable[[Column], Column]):
    def find(lines: Column) -> Column:
        found = F.transform(lines, lambda x, i: F.when(holds(x), finding(rule_id, i + 1, start(x), end(x), key)))
        return F.filter(found, lambda f: f.isNotNull())

    return find


LONG = 400
SECRET = r'token = "[0-9a-f]{40}"'
ADDRESS = r"[0-9A-Za-z.]+@[0-9a-z]+\.example\.com"
LICENSE = r"(licensed under|Licensed under|Released under|All rights reserved)"


def matched(pattern: str, *literals: str) -> tuple[Callable, Callable, Callable]:
    """(holds, start, end) of the first match of a pattern without groups of its own that capture. Every match holds one of the
    literals, which are sought first: nearly all lines have none, and the pattern isn't tried on them."""
    before = lambda x: F.length(F.regexp_extract(x, f"^(.*?)(?:{pattern})", 1))
    some = lambda x: reduce(lambda a, b: a | b, [x.contains(t) for t in literals])
    return (lambda x: some(x) & x.rlike(pattern)), before, (lambda x: before(x) + F.length(F.regexp_extract(x, f"^.*?({pattern})", 1)))


def duplicate_lines(lines: Column) -> Column:
    """The second occurrence only of each line of more than ten characters, from ``_placed``: the lines with their places, sorted once in ``scan``."""
    placed = F.col("_placed")
    same = lambda i, back: (i >= back) & (F.get(placed, i)["x"].eqNullSafe(F.get(placed, F.greatest(i - back, F.lit(0)))["x"]))
    return F.filter(
        F.transform(placed, lambda s, i: F.when((F.length(s["x"]) > 10) & same(i, 1) & ~same(i, 2), finding("duplicate-line", s["i"] + 1, F.lit(0), F.length(s["x"]), "duplicate"))),
        lambda f: f.isNotNull(),
    )


def adjacent_equal(lines: Column) -> Column:
    found = F.transform(lines, lambda x, i: F.when((F.length(x) > 10) & (x == F.get(lines, i + 1)), finding("adjacent-equal", i + 2, F.lit(0), F.length(x), "adjacent")))
    return F.filter(found, lambda f: f.isNotNull())


RULES = (
    Rule("long-line", "lexical", ("style",), "a line of more than 400 characters", per_line("long-line", "long", lambda x: F.length(x) > LONG, lambda x: F.lit(LONG), F.length)),
    Rule("trailing-space", "lexical", ("style",), "white space at the end of a line", per_line("trailing-space", "trailing", lambda x: x.rlike(r"[ \t]$"), lambda x: F.length(F.regexp_replace(x, r"[ \t]+$", "")), F.length), fixable=True),
    Rule("secret-like", "syntax", ("suspicious", "correctness"), "a literal that looks like a credential", per_line("secret-like", "secret", *matched(SECRET, 'token = "')), fixable=True),
    Rule("address-like", "syntax", ("suspicious",), "a mail address in a text", per_line("address-like", "address", *matched(ADDRESS, ".example.com")), fixable=True),
    Rule("license-line", "syntax", ("restriction",), "a line that states a licence", per_line("license-line", "license", *matched(LICENSE, "icensed under", "Released under", "All rights reserved"))),
    Rule("duplicate-line", "types", ("pedantic",), "a line that stands in the text before", duplicate_lines),
    Rule("adjacent-equal", "types", ("correctness",), "a line equal to the one before it", adjacent_equal),
)


def rules_dimension(spark, rules: Iterable[Rule] = RULES) -> DataFrame:
    rows = [(r.rule_id, r.tier, "text", list(r.presets), "warn", r.fixable, r.summary) for r in rules]
    from tessera.schemas import RULES as ddl

    return spark.createDataFrame(rows, ddl)


def scan(texts: DataFrame, rules: Iterable[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rule_id, line, start, end, message_key of all rules' findings, by one read of the texts."""
    lined = texts.filter(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("_lines"))
    # Kept apart from the rules by columns of their own: rules look at the arrays many times; they are split and sorted once.
    lined = lined.withColumn("_placed", F.array_sort(F.transform("_lines", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    own = [r.find(F.col("_lines")) for r in rules]
    found = F.concat(*own) if len(own) > 1 else own[0]
    return lined.select(key, F.explode(found.cast(f"array<{FINDING}>")).alias("f")).select(key, "f.*")


def with_severity(findings: DataFrame, selection: DataFrame) -> DataFrame:
    """Findings of selected rules, with the severity that the selection (rule_id, severity) gives; its size is that of the registry."""
    return findings.join(F.broadcast(selection.filter(F.col("severity") != "allow")), "rule_id")
