"""Comments that tools read: their kinds, and the suppressions among them with the ranges that they hold for."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from datetime import date

from tessera.goparse.scanner import Piece, rebuilt

TOOL = "tessera"
SCOPES = {"ignore": "next-line", "ignore-line": "line", "ignore-start": "range", "ignore-end": "range", "ignore-file": "file"}
_KINDS = [
    ("build-constraint", re.compile(r"//go:build(?:\s|$)|//\s*\+build(?:\s|$)")),
    ("go-generate", re.compile(r"//go:generate(?:\s|$)")),
    ("go-embed", re.compile(r"//go:embed(?:\s|$)")),
    ("line", re.compile(r"//line |/\*line ")),
    ("external-suppression", re.compile(r"//\s*nolint(?:[:\s]|$)")),
    ("compiler", re.compile(r"//go:")),
    ("generated", re.compile(r"// Code generated .* DO NOT EDIT\.$")),
]


def kind_of(comment: str, tool: str = TOOL) -> str | None:
    """The kind of directive that a comment is, or None for prose."""
    if comment.startswith(f"//{tool}:"):
        return "suppression"
    return next((k for k, p in _KINDS if p.match(comment)), None)


@dataclass(frozen=True)
class Suppression:
    scope: str
    rule_id: str
    start: int
    end: int
    target_start: int
    target_end: int
    reason: str
    expires_on: str


@dataclass(frozen=True)
class Problem:
    kind: str
    start: int
    end: int
    message: str


class _Bad(Exception):
    pass


@dataclass(frozen=True)
class _Read:
    """A directive's parts; ``reason`` is None where there is no ``--``."""

    piece: Piece
    label: str
    rule: str
    reason: str | None
    expiry: str = ""


def _shape(piece: Piece, text: str) -> _Read:
    """Label, rule and reason, apart by any white space; _Bad where the grammar is broken."""
    label, *rest = text.split(None, 1) or [""]
    if not rest:
        raise _Bad("malformed", "a suppression names a rule")
    if label not in SCOPES:
        raise _Bad("malformed", f"unknown suppression {label}")
    rule, dashes, reason = rest[0].partition("--")
    if len(rule.split()) != 1:
        raise _Bad("malformed", "a suppression names exactly one rule")
    return _Read(piece, label, rule.strip(), reason.strip() if dashes else None)


def _judged(own: _Read, known: set[str] | None, today: str | None, need_reason: bool) -> _Read:
    """The directive with its expiry taken out of the reason; _Bad for the first thing that is wrong with it."""
    if known is not None and own.rule not in known:
        raise _Bad("unknown-rule", f"no rule is called {own.rule}")
    if own.label == "ignore-end":
        if own.reason is not None:
            raise _Bad("malformed", "the end of a range has no reason")
        return own
    reason, expiry = own.reason, ""
    if reason is not None and reason.startswith("expires="):
        first, *more = reason.split(None, 1)
        expiry, reason = first.removeprefix("expires="), more[0] if more else ""
        try:
            if date.fromisoformat(expiry).isoformat() != expiry:
                raise ValueError
        except ValueError:
            raise _Bad("invalid-expiry", "an expiry is a date, YYYY-MM-DD") from None
    if reason == "" or need_reason and reason is None:
        raise _Bad("missing-reason", "a suppression says why")
    if today is not None and expiry and expiry <= today:
        raise _Bad("expired", f"the suppression of {own.rule} has expired")
    return _Read(own.piece, own.label, own.rule, reason or "", expiry)


def _ranges(own: list[_Read]):
    """Of one rule's starts and ends, in order: suppressions from a start to the next end, and the problems of those without a partner."""
    opened: _Read | None = None
    for d in own:
        if d.label == "ignore-start":
            if opened is None:
                opened = d
            else:
                yield Problem("nested-range", d.piece.start, d.piece.end, f"a range of {d.rule} is open")
        elif opened is None:
            yield Problem("unmatched-range-end", d.piece.start, d.piece.end, f"no range of {d.rule} is open")
        else:
            yield Suppression("range", d.rule, opened.piece.start, opened.piece.end, opened.piece.end, d.piece.start, opened.reason or "", opened.expiry)
            opened = None
    if opened is not None:
        yield Problem("unclosed-range", opened.piece.start, opened.piece.end, f"the range of {opened.rule} isn't closed")


def suppressions(pieces: list[Piece], size: int, known: set[str] | None = None, today: str | None = None, need_reason: bool = False, tool: str = TOOL) -> tuple[list[Suppression], list[Problem]]:
    """(suppressions by start and rule, problems by start, end, kind and message) of a file's pieces.

    A range opened twice, never opened or never closed is a problem; so is a file-wide one behind the package clause, an unknown rule, a reason
    that is empty or, if asked for, absent, and one at a range's end. An expired suppression is a problem and holds for nothing.
    """
    starts = [0, *(k + 1 for k, byte in enumerate(rebuilt(pieces)) if byte == 10)]
    package = next((p.start for p in pieces if p.kind == "keyword" and p.text == "package"), size)

    def line(offset: int, later: int) -> tuple[int, int]:
        k = bisect_right(starts, offset) - 1 + later
        return (size, size) if k >= len(starts) else (starts[k], starts[k + 1] - 1 if k + 1 < len(starts) else size)

    out: list[Suppression | Problem] = []
    ranges: dict[str, list[_Read]] = {}
    for p in pieces:
        if p.kind != "line_comment" or kind_of(p.text, tool) != "suppression":
            continue
        try:
            own = _judged(_shape(p, p.text[len(tool) + 3 :]), known, today, need_reason)
        except _Bad as e:
            out.append(Problem(e.args[0], p.start, p.end, e.args[1]))
            continue
        if SCOPES[own.label] == "range":
            ranges.setdefault(own.rule, []).append(own)
        elif own.label == "ignore-file" and p.start > package:
            out.append(Problem("misplaced-file-scope", p.start, p.end, "a file's suppression stands before the package clause"))
        else:
            target = (0, size) if own.label == "ignore-file" else line(p.start, int(own.label == "ignore"))
            out.append(Suppression(SCOPES[own.label], own.rule, p.start, p.end, *target, own.reason or "", own.expiry))
    for own in ranges.values():
        out += _ranges(own)
    found, problems = [x for x in out if isinstance(x, Suppression)], [x for x in out if isinstance(x, Problem)]
    return sorted(found, key=lambda s: (s.start, s.rule_id)), sorted(problems, key=lambda p: (p.start, p.end, p.kind, p.message))
