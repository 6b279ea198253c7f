"""Fixes of a file: candidates checked, conflicts found, edits spliced into the bytes, the outcome parsed again, imports kept in order.

A file is fixed in the task that holds it. If its new text doesn't parse, none of its fixes is applied.
"""

from __future__ import annotations

from dataclasses import dataclass

from tessera.goparse.facts import Facts
from tessera.goparse.syntax import GoSyntaxError, Tree, parse

# Safety classes, and the reasons that refuse a fix, in the order in which they are looked for.
SAFETY = ("safe", "suggestion", "unsafe")
REASONS = ("missing-fix", "stale-source", "suggestion-not-selected", "unsafe", "invalid-safety", "invalid-range", "invalid-text", "conflict", "validation")


@dataclass(frozen=True)
class Candidate:
    rule_id: str
    name: str
    safety: str
    edits: tuple[tuple[int, int, str], ...]
    digest: str | None = None


def boundary(data: bytes, at: int) -> bool:
    return at == len(data) or (data[at] & 0xC0) != 0x80


def refused(c: Candidate, data: bytes, digest: str | None, allowed: tuple[str, ...]) -> str | None:
    """The first reason that refuses a candidate, or nothing."""
    if not c.edits:
        return "missing-fix"
    if c.digest is not None and c.digest != digest:
        return "stale-source"
    if c.safety not in SAFETY:
        return "invalid-safety"
    if c.safety not in allowed:
        return "suggestion-not-selected" if c.safety == "suggestion" else "unsafe"
    for a, b, text in c.edits:
        if not 0 <= a <= b <= len(data) or not (boundary(data, a) and boundary(data, b)):
            return "invalid-range"
        try:
            text.encode()
        except UnicodeEncodeError:
            return "invalid-text"
    return None


def conflicts(candidates: list[Candidate]) -> set[int]:
    """Places of the candidates with an edit that conflicts with another edit: replacements that overlap, insertions at one place, an insertion strictly inside."""
    edits = sorted((a, b, i) for i, c in enumerate(candidates) for a, b, _ in c.edits)
    out: set[int] = set()
    reach: list[tuple[int, int, int]] = []
    for a, b, i in edits:
        reach = [r for r in reach if r[1] > a or (r[0] == r[1] == a)]
        for p, q, j in reach:
            if (a < b and p < q and a < q and p < b) or (a == b == p == q) or (a == b and p < a < q) or (p == q and a < p < b):
                out |= {i, j}
        reach.append((a, b, i))
    return out


def spliced(data: bytes, edits: list[tuple[int, int, str]]) -> bytes:
    for a, b, text in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        data = data[:a] + text.encode() + data[b:]
    return data


def unused_imports(tree: Tree) -> set[tuple[str | None, str]]:
    """(name, path) of imports that nothing in the file uses; blank and dot imports always count as used."""
    facts = Facts(tree)
    used = {n.x.name for n in tree.root.walk() if n.kind == "Selector" and n.x.kind == "Ident" and id(n.x) not in facts.uses}
    out = set()
    for d in tree.root.decls:
        for s in d.specs if d.kind == "GenDecl" and d.word == "import" else ():
            local = s.name or next((k for k, p in facts.imports.items() if p == s.path), None)
            if local not in ("_", ".", None) and local not in used:
                out.add((s.name, s.path))
    return out


def without_imports(data: bytes, gone: set[tuple[str | None, str]]) -> bytes:
    """The file without some imports, and without the declarations that hold no other."""
    tree, cuts = parse(data), []
    for d in tree.root.decls:
        if d.kind != "GenDecl" or d.word != "import":
            continue
        own = [s for s in d.specs if (s.name, s.path) in gone]
        for n in [d] if own and len(own) == len(d.specs) else own:
            line = tree.line(n.start)
            start, end = tree.lines[line - 1], tree.line(n.end)
            stop = tree.lines[end] if end < len(tree.lines) else len(data)
            alone = not data[start : n.start].strip() and not data[n.end : stop].strip().replace(b";", b"")
            cuts.append((start, stop, "") if alone else (n.start, n.end, ""))
    return spliced(data, cuts)


def with_imports(data: bytes, wanted: list[tuple[str | None, str]]) -> bytes:
    """The file with those of the imports (name, path) that it lacks, behind its last import or its package clause."""
    tree = parse(data)
    specs = [s for d in tree.root.decls if d.kind == "GenDecl" and d.word == "import" for s in d.specs]
    have = {(s.name, s.path) for s in specs}
    new = [w for w in dict.fromkeys(wanted) if w not in have]
    if not new:
        return data
    lines = [(f"{name} " if name else "") + f'"{path}"' for name, path in new]
    last = next((d for d in reversed(tree.root.decls) if d.kind == "GenDecl" and d.word == "import"), None)
    if last is not None and last.grouped and last.specs:
        at = last.specs[-1].end
        return spliced(data, [(at, at, "".join(f"\n\t{x}" for x in lines))])
    at = last.end if last is not None else tree.root.name.end
    return spliced(data, [(at, at, ("\n" if last is None else "") + "".join(f"\nimport {x}" for x in lines))])


def fixed(data: bytes, candidates: list[Candidate], allowed: tuple[str, ...] = ("safe",), digest: str | None = None) -> tuple[bytes, list[Candidate], list[tuple[Candidate, str]]]:
    """(new bytes, applied candidates, refused ones with their reasons). Imports that the fixes leave unused go."""
    reasons = [refused(c, data, digest, allowed) for c in candidates]
    sound = [c for c, r in zip(candidates, reasons, strict=True) if r is None]
    clash = conflicts(sound)
    applied = [c for i, c in enumerate(sound) if i not in clash]
    out = [(c, r) for c, r in zip(candidates, reasons, strict=True) if r is not None] + [(sound[i], "conflict") for i in sorted(clash)]
    if not applied:
        return data, [], out
    try:
        before = unused_imports(parse(data))
        new = spliced(data, [e for c in applied for e in c.edits])
        gone = unused_imports(parse(new)) - before
        if gone:
            new = without_imports(new, gone)
            parse(new)
    except GoSyntaxError:
        return data, [], out + [(c, "validation") for c in applied]
    return new, applied, out
