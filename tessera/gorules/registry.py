"""Rules over the trees of Go files: registration, dispatch by node kind, and one pass over each file.

A file is one row and needs nothing from other rows, so a rule runs in the task that holds the file and no shuffle is
needed to find anything. Rules of a package (receivers of one type in several files) are relations over what files tell; see ``package``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from tessera.goparse.facts import Facts
from tessera.goparse.syntax import GoSyntaxError, Node, Tree, parse

# The presets that can be asked for.
PRESETS = ("correctness", "suspicious", "performance", "complexity", "style", "pedantic", "nursery", "restriction", "migration")
GENERATED = re.compile(rb"^// Code generated .* DO NOT EDIT\.\r?$", re.M)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    tier: str
    presets: tuple[str, ...]
    summary: str
    kinds: tuple[str, ...]
    run: Callable[[Context, Node], Iterator[tuple]]
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Finding:
    """``fix``: name, safety and edits (start, end, new text), or nothing."""

    rule_id: str
    start: int
    end: int
    message_key: str
    fix: tuple | None = None


RULES: dict[str, Rule] = {}


def rule(rule_id: str, tier: str, presets: str, summary: str, kinds: str, **options):
    """Registers a function of (context, node) that yields (node or byte range, message key, optional fix)."""

    def registered(run):
        RULES[rule_id] = Rule(rule_id, tier, tuple(presets.split()), summary, tuple(kinds.split()), run, {k.replace("_", "-"): v for k, v in options.items()})
        return run

    return registered


class Context:
    """A file and what its rules ask for."""

    def __init__(self, path: str, tree: Tree, options: dict[str, dict]):
        self.path, self.tree, self._options = path, tree, options
        self._facts: Facts | None = None
        self.rule: Rule | None = None

    @property
    def facts(self) -> Facts:
        if self._facts is None:
            self._facts = Facts(self.tree)
        return self._facts

    @property
    def is_test(self) -> bool:
        return self.path.endswith("_test.go")

    def option(self, name: str):
        return self._options.get(self.rule.rule_id, {}).get(name, self.rule.options[name])

    def parent(self, n: Node) -> Node | None:
        return self.facts.parents.get(id(n))

    def above(self, n: Node) -> Iterator[Node]:
        while (n := self.parent(n)) is not None:
            yield n

    def function(self, n: Node) -> Node | None:
        return next((p for p in self.above(n) if p.kind in ("FuncDecl", "FuncLit")), None)

    def shape(self, n: Node | None) -> str:
        return self.tree.shape(n)

    def text(self, n: Node) -> str:
        return self.tree.text(n)

    def pure(self, n: Node) -> bool:
        """No call, receive or closure in it."""
        return not any(x.kind in ("Call", "FuncLit") or x.kind == "Unary" and x.word == "<-" for x in n.walk())

    def same(self, a: Node, b: Node) -> bool:
        """Equal code over the same names."""
        if self.shape(a) != self.shape(b):
            return False
        one, two = ([self.facts.uses.get(id(x)) for x in n.walk() if x.kind == "Ident"] for n in (a, b))
        return all(x is y for x, y in zip(one, two, strict=True))


def selected(names: Iterable[str] | None = None) -> list[Rule]:
    """Rules by id or preset; all but the restriction and migration presets' where nothing is named. Unknown names are an error."""
    if names is None:
        return [r for r in RULES.values() if not {"restriction", "migration"} >= set(r.presets)]
    out: dict[str, Rule] = {}
    for name in names:
        if name in RULES:
            out[name] = RULES[name]
        elif name in PRESETS and name not in ("restriction", "migration"):
            out.update((r.rule_id, r) for r in RULES.values() if name in r.presets)
        else:
            raise ValueError(f"no rule or selectable preset is called {name}")
    return list(out.values())


def generated(source: bytes) -> bool:
    """Whether a line before the package clause marks the file as generated."""
    found = GENERATED.search(source)
    package = re.search(rb"^package\s", source, re.M)
    return bool(found and (package is None or found.start() < package.start()))


def check(path: str, source: bytes, names: Iterable[str] | None = None, options: dict[str, dict] | None = None, include_generated: bool = False) -> tuple[list[Finding], str | None]:
    """(findings by start, end, rule and key; the syntax error that ended the parse) of a file."""
    try:
        tree = parse(source)
    except GoSyntaxError as e:
        return [], str(e)
    if not include_generated and generated(source):
        return [], None
    context = Context(path, tree, options or {})
    interested: dict[str, list[Rule]] = {}
    for r in selected(names):
        if context.is_test and r.options.get("include-tests") is False and not (options or {}).get(r.rule_id, {}).get("include-tests", False):
            continue
        for kind in r.kinds:
            interested.setdefault(kind, []).append(r)
    found: set[Finding] = set()
    for n in tree.root.walk():
        for r in interested.get(n.kind, ()):
            context.rule = r
            for at, key, *fix in r.run(context, n):
                start, end = (at.start, at.end) if isinstance(at, Node) else at
                found.add(Finding(r.rule_id, start, end, key, fix[0] if fix else None))
    return sorted(found, key=lambda f: (f.start, f.end, f.rule_id, f.message_key)), None


def loaded() -> dict[str, Rule]:
    """All rules, after their modules have been imported."""
    from tessera.gorules import bodies, calls, conventions, flow, structure, values  # noqa: F401

    return RULES
