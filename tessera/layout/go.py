"""Layout of Go files: one space where one belongs, indents by nesting, single blank lines; the breaks of lines stay as they are.

The outcome has to hold the same tokens and comments and its directives the same code, and laying it out again must change nothing; else it is refused.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from hashlib import sha256

from tessera.goparse.directives import suppressions
from tessera.goparse.scanner import Piece, scan
from tessera.goparse.syntax import GoSyntaxError, Node, Tree, parse

OPEN, CLOSE = frozenset("( [ {".split()), frozenset(") ] }".split())
#: Behind one of these a line goes on with a statement only within brackets.
NEUTRAL = frozenset("( [ { , : ;".split())


class Spaces:
    """Where tokens stand together: offsets before and behind which there is no space, and braces with none inside."""

    def __init__(self, tree: Tree, nodes: list[Node]):
        self.before: set[int] = set()
        self.behind: set[int] = set()
        self.plain: set[int] = set()  # braces without spaces inside
        starts = {t.start: i for i, t in enumerate(tree.tokens) if not t.inserted}
        tokens = tree.tokens

        def after(offset: int) -> Piece:
            """The first token from an offset on."""
            i = bisect_left(tree.token_starts, offset)
            while tokens[i].inserted:
                i += 1
            return tokens[i]

        def closing(i: int) -> int:
            depth = 0
            while True:
                depth += (tokens[i].text in OPEN) - (tokens[i].text in CLOSE)
                if not depth:
                    return i
                i += 1

        for n in nodes:
            k = n.kind
            if k in ("Unary", "Star", "Tilde"):
                self.behind.add(n.start)
            elif k == "Call":
                self.before.add(after(n.fun.end).start)
                if n.spread:
                    self.before.add(after(n.args[-1].end).start)
            elif k in ("Index", "Slice"):
                self.before.add(after(n.x.end).start)
                if k == "Slice":
                    inner = [p for p in n.parts if p is not None]
                    for t in tree.own_tokens(n.x.end, n.end):
                        if t.text == ":" and not any(p.start <= t.start < p.end for p in inner):
                            self.before.add(t.start)
                            self.behind.add(t.start)
            elif k == "MapType":
                self.before.add(after(n.start + 3).start)
                self.behind.add(after(n.key.end).start)
            elif k in ("SliceType", "ArrayType"):
                close = closing(starts[n.start])
                self.behind.add(tokens[close].start)
                if k == "ArrayType" and n.size is None:
                    self.before.add(after(n.start + 1).start)
            elif k == "ChanType":
                if n.way == "receive":
                    self.behind.add(n.start)
                elif n.way == "send":
                    self.before.add(after(n.start + 4).start)
            elif k == "FuncType":
                first = tokens[starts[n.start]]
                self.before.add(n.start if first.text == "(" else after(n.start + 4).start)
            elif k == "FuncDecl" and n.type_params or k == "TypeSpec" and n.params:
                self.before.add(after(n.name.end).start)
            elif k == "Composite":
                brace = after(n.type.end).start if n.type is not None else n.start
                if n.type is not None:
                    self.before.add(brace)
                self.plain.add(brace)
                self.plain.add(n.end - 1)
            elif k in ("StructType", "InterfaceType"):
                brace = after(n.start + (6 if k == "StructType" else 9)).start
                if tree.line(brace) == tree.line(n.end - 1):
                    self.before.add(brace)
            elif k == "KeyValue":
                self.before.add(after(n.key.end).start)
            elif k == "Clause" and "cases" in n.f:
                self.before.add(after(n.cases[-1].end if n.cases else n.start + 7).start)
            elif k == "Labeled":
                self.before.add(after(n.label.end).start)
            elif k == "Field" and n.variadic:
                self.behind.add(next(t.start for t in tree.own_tokens(n.start, n.end) if t.text == "..."))
            elif k == "IncDec":
                self.before.add(after(n.x.end).start)

    def between(self, a: Piece, b: Piece) -> str:
        if a.kind == "operator" and a.text == "." or b.kind == "operator" and b.text == ".":
            return ""
        if b.text in (",", ";", ")", "]") and b.kind in ("operator", "semicolon") or a.text in ("(", "[") and a.kind == "operator":
            return ""
        if b.start in self.before or a.start in self.behind:
            return ""
        if a.text == "{" and (b.text == "}" or a.start in self.plain) or b.text == "}" and b.start in self.plain:
            return ""
        return " "


def laid_out(source: bytes) -> bytes:
    """A file with its layout made even. A file that doesn't parse is an error."""
    return _laid_out(parse(source))


def _laid_out(tree: Tree) -> bytes:
    source, nodes = tree.source, list(tree.root.walk())
    spaces = Spaces(tree, nodes)
    labels = {n.start for n in nodes if n.kind == "Labeled"}
    pieces = [p for p in tree.pieces if p.kind not in ("space", "newline", "bom") and not (p.kind == "semicolon" and p.inserted)]
    out: list[str] = []
    opened: list[int] = []  # the line of each open bracket, as laid out
    line, blank_from, last, last_token = 0, 0, None, None
    ended = {a.end for a, b in zip(tree.tokens, tree.tokens[1:], strict=False) if b.inserted}
    headers = [(n.start, n.body.start if "body" in n.f else n.clauses[0].start if n.clauses else n.end) for n in nodes if n.kind in ("If", "For", "RangeStmt", "Switch", "TypeSwitch")]
    for i, p in enumerate(pieces):
        text = p.text.rstrip("\r")
        newlines = source.count(b"\n", blank_from, p.start)
        if p.text == ";" and p.kind == "semicolon" and _needless(tree, p) and not any(a <= p.start < b for a, b in headers):
            ended.add(last_token.end)
            blank_from = p.end
            continue
        if last is None or newlines or last.kind == "line_comment":
            if last is not None:
                closes = p.kind == "operator" and p.text in CLOSE
                opens = last.kind == "operator" and last.text in OPEN
                out.append("\n\n" if newlines > 1 and not closes and not opens else "\n")
                line += 1
            closers = 0  # with which the line begins
            while i + closers < len(pieces) and pieces[i + closers].kind == "operator" and pieces[i + closers].text in CLOSE and (not closers or b"\n" not in source[pieces[i + closers - 1].end : pieces[i + closers].start]):
                closers += 1
            level = len(set(opened[: max(0, len(opened) - closers)]))
            if p.kind == "keyword" and p.text in ("case", "default") or p.start in labels:
                level -= 1
            goes_on = last_token is not None and last_token.text not in NEUTRAL and last_token.end not in ended and last_token.text != "}" and p.kind not in ("line_comment", "block_comment")
            if goes_on and not (p.kind == "operator" and p.text in CLOSE):
                level += 1
            out.append("\t" * max(level, 0))
        elif p.kind in ("line_comment", "block_comment") or last.kind == "block_comment":
            out.append("" if last.kind == "block_comment" and p.text in (")", ",", ";") else " ")
        else:
            out.append(spaces.between(last, p))
        out.append(text)
        if p.kind == "operator" and p.text in OPEN:
            opened.append(line)
        elif p.kind == "operator" and p.text in CLOSE and opened:
            opened.pop()
        if p.kind not in ("line_comment", "block_comment"):
            last_token = p
        last, blank_from = p, p.end
    return ("".join(out) + "\n").encode("utf-8", "surrogateescape")


def _needless(tree: Tree, p: Piece) -> bool:
    """Whether a written semicolon stands at a line's end, where one is implied."""
    at = tree.source.find(b"\n", p.end)
    rest = tree.source[p.end : at if at >= 0 else None].strip()
    return not rest or rest.startswith(b"//")


def kept(source: bytes) -> tuple[list[str], list[str]]:
    return _kept(scan(source)[0])


def _kept(pieces: list[Piece]) -> tuple[list[str], list[str]]:
    """(tokens without semicolons that lines imply or repeat, comments): what a layout may not change."""
    tokens = [p.text for p in pieces if p.kind not in ("space", "newline", "bom", "line_comment", "block_comment", "semicolon")]
    return tokens, [p.text.rstrip("\r") for p in pieces if p.kind in ("line_comment", "block_comment")]


def owned(source: bytes) -> list[tuple]:
    return _owned(scan(source)[0], len(source))


def _owned(pieces: list[Piece], size: int) -> list[tuple]:
    """Of each suppression, its scope, rule and the tokens that it holds for."""
    if not any(p.kind in ("line_comment", "block_comment") for p in pieces):
        return []
    found, _ = suppressions(pieces, size)
    tokens = [p for p in pieces if p.kind not in ("space", "newline", "bom", "line_comment", "block_comment", "semicolon")]
    return [(s.scope, s.rule_id, sha256(" ".join(t.text for t in tokens if s.target_start <= t.start < s.target_end).encode("utf-8", "surrogateescape")).hexdigest()) for s in found]


@dataclass(frozen=True)
class Layout:
    """``error`` tells why a file was left as it is."""

    source: bytes
    changed: bool
    error: str | None = None


def checked(source: bytes) -> Layout:
    """The file laid out, if that keeps its tokens, comments and directives and is final; else as it is, with the reason."""
    try:
        tree = parse(source)
        new = _laid_out(tree)
        if new == source:  # nothing changes, so all is kept, and again
            return Layout(source, False)
        broken = None
        try:
            again = parse(new)
        except GoSyntaxError as e:  # told only if nothing else is wrong
            broken = e
        before, after = tree.pieces, scan(new)[0] if broken else again.pieces
        (own_tokens, own_comments), (tokens, comments) = _kept(before), _kept(after)
        problem = "tokens" if tokens != own_tokens else "comments" if comments != own_comments else "suppressions" if _owned(after, len(new)) != _owned(before, len(source)) else None
        if problem is None:
            if broken:
                raise broken
            problem = None if _laid_out(again) == new else "repeat"
    except GoSyntaxError as e:
        return Layout(source, False, str(e))
    return Layout(source, False, f"the layout would change the file's {problem}") if problem else Layout(new, new != source)


def fragment(source: str, kind: str) -> str:
    """A declaration, statement or expression laid out by itself, within a file made around it."""
    around = {"declaration": ("package p\n\n", ""), "statement": ("package p\n\nfunc f() {\n", "\n}\n"), "expression": ("package p\n\nvar x = ", "\n")}
    head, tail = around[kind]
    new = checked((head + source + tail).encode())
    if new.error:
        raise GoSyntaxError(0, new.error)
    text = new.source.decode()
    if kind == "statement":
        return "\n".join(x.removeprefix("\t") for x in text.split("\n")[3:-2])
    return text[len(head) :].rstrip("\n")


