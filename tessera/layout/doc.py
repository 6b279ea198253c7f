"""Documents that choose their line breaks: text, groups, indents and lines, rendered within a width.

A group is set on one line if it and what follows up to the next possible break fit, else all of its own lines break.
Rendering goes through the document once; what is looked at to see whether something fits is bounded by the width.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Concat:
    parts: tuple


@dataclass(frozen=True)
class Group:
    body: object
    broken: bool = False


@dataclass(frozen=True)
class Indent:
    body: object


@dataclass(frozen=True)
class Line:
    """``flat`` is what stands for it in a group on one line; a hard one always breaks, and every group around it."""

    flat: str = " "
    hard: bool = False


@dataclass(frozen=True)
class IfBreak:
    broken: object
    flat: object


@dataclass(frozen=True)
class Suffix:
    """Held back to the end of the line: a comment."""

    value: str


@dataclass(frozen=True)
class BreakParent:
    """Breaks every group around it and prints nothing."""


@dataclass(frozen=True)
class Boundary:
    """A break if a suffix is waiting, else nothing."""


@dataclass(frozen=True)
class Verbatim:
    """Text with line ends of its own, printed as it is."""

    value: str


SOFT, SPACE, HARD = Line(""), Line(" "), Line("", True)
NOTHING = Text("")


def concat(*parts) -> Concat:
    return Concat(tuple(Text(p) if isinstance(p, str) else p for p in parts))


def group(*parts) -> Group:
    body = concat(*parts)
    return Group(body, forced(body))


def indent(*parts) -> Indent:
    return Indent(concat(*parts))


def joined(between, parts) -> Concat:
    out: list = []
    for p in parts:
        if out:
            out.append(between)
        out.append(p)
    return concat(*out)


def forced(doc) -> bool:
    """Whether a document holds what breaks the groups around it."""
    stack = [doc]
    while stack:
        d = stack.pop()
        if isinstance(d, BreakParent) or isinstance(d, Line) and d.hard or isinstance(d, Group) and d.broken or isinstance(d, Verbatim) and "\n" in d.value:
            return True
        if isinstance(d, Concat):
            stack.extend(d.parts)
        elif isinstance(d, (Group, Indent)):
            stack.append(d.body)
    return False


@dataclass
class _State:
    width: int
    tab: int
    out: list[str] = field(default_factory=list)
    column: int = 0
    suffixes: list[str] = field(default_factory=list)
    fresh: int | None = 0  # the indentation that the next text is to have, if the line is still empty

    def text(self, value: str) -> None:
        if not value:
            return
        if self.fresh is not None:
            self.out.append("\t" * self.fresh)
            self.column = self.fresh * self.tab
            self.fresh = None
        self.out.append(value)
        last = value.rpartition("\n")[2]
        self.column = len(last) if "\n" in value else self.column + len(value)

    def newline(self, level: int) -> None:
        for s in self.suffixes:
            self.text(s)
        self.suffixes.clear()
        self.out.append("\n")
        self.column, self.fresh = level * self.tab, level


def _fits(doc, rest: list, left: int) -> bool:
    """Whether a document on one line, and what follows up to the next break, fits into ``left`` columns."""
    stack = [(doc, True)]
    at = len(rest)
    while left >= 0:
        if not stack:
            if not at:
                return True
            at -= 1
            stack.append((rest[at][0], rest[at][2]))
            continue
        d, flat = stack.pop()
        if isinstance(d, Text):
            left -= len(d.value)
        elif isinstance(d, Verbatim):
            left -= len(d.value.partition("\n")[0])
            if "\n" in d.value:
                return left >= 0
        elif isinstance(d, Concat):
            stack.extend((p, flat) for p in reversed(d.parts))
        elif isinstance(d, Group):
            stack.append((d.body, flat and not d.broken))
        elif isinstance(d, Indent):
            stack.append((d.body, flat))
        elif isinstance(d, Line):
            if d.hard or not flat:
                return True
            left -= len(d.flat)
        elif isinstance(d, IfBreak):
            stack.append((d.flat if flat else d.broken, flat))
    return False


def render(doc, width: int = 100, tab: int = 4) -> str:
    """The text of a document; lines have no white space at their ends."""
    state = _State(width, tab)
    stack: list[tuple] = [(doc, 0, False)]
    while stack:
        d, level, flat = stack.pop()
        if isinstance(d, str):
            state.text(d)
        elif isinstance(d, (Text, Verbatim)):
            state.text(d.value)
        elif isinstance(d, Concat):
            stack.extend((p, level, flat) for p in reversed(d.parts))
        elif isinstance(d, Indent):
            stack.append((d.body, level + 1, flat))
        elif isinstance(d, Group):
            begun = state.column if state.fresh is None else state.fresh * state.tab
            one = not d.broken and (flat or _fits(d.body, stack, width - begun))
            stack.append((d.body, level, one))
        elif isinstance(d, IfBreak):
            stack.append((d.flat if flat else d.broken, level, flat))
        elif isinstance(d, Suffix):
            state.suffixes.append(d.value)
        elif isinstance(d, Boundary):
            if state.suffixes:
                state.newline(level)
        elif isinstance(d, Line):
            if flat and not d.hard:
                state.text(d.flat)
            else:
                state.newline(level)
    for s in state.suffixes:
        state.text(s)
    return "\n".join(x.rstrip(" \t") if "`" not in x else x for x in "".join(state.out).split("\n"))
