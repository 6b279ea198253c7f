"""Go files as trees: a recursive descent over the scanner's tokens, with types read as expressions.

A ``Node`` has a kind, a byte range and named fields (nodes, lists of nodes, or plain values). Errors end the parse: the first one is
raised with its byte offset. ``rows`` flattens a tree for relational use.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from tessera.goparse.scanner import TRIVIA, scan

LEVELS = {"||": 1, "&&": 2, **dict.fromkeys("== != < <= > >=".split(), 3), **dict.fromkeys("+ - | ^".split(), 4), **dict.fromkeys("* / % << >> & &^".split(), 5)}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
LITERALS = frozenset("int float imag rune string".split())
#: Deepest nesting that is read; deeper files are an error, so no file ends a worker.
DEEPEST = 400


class GoSyntaxError(ValueError):
    def __init__(self, offset: int, message: str):
        super().__init__(f"{offset}: {message}")
        self.offset, self.message = offset, message


class Node:
    __slots__ = ("end", "f", "kind", "start")

    def __init__(self, kind: str, start: int, end: int, **f):
        self.kind, self.start, self.end, self.f = kind, start, end, f

    def __getattr__(self, name: str):
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(f"{self.kind} has no {name}") from None

    def get(self, name: str, other=None):
        return self.f.get(name, other)

    def kids(self) -> list[Node]:
        out: list[Node] = []
        for v in self.f.values():
            if type(v) is Node:
                out.append(v)
            elif type(v) is list:
                for x in v:
                    if type(x) is Node:
                        out.append(x)
        return out

    def walk(self, stop: tuple[str, ...] = ()) -> Iterator[Node]:
        """The node and all below it, in order; kinds in ``stop`` are given but not entered (the node itself is)."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if n is self or n.kind not in stop:
                kids = n.kids()
                kids.reverse()
                stack += kids

    def __repr__(self) -> str:
        return f"{self.kind}({self.start}:{self.end})"


class Tree:
    """A parsed file: its source, ``root``, tokens, comments, and lines."""

    def __init__(self, source: bytes):
        self.source = source
        pieces, errors = scan(source)
        if errors:
            at, _, message = errors[0].partition(": ")
            raise GoSyntaxError(int(at), message)
        self.pieces = pieces
        self.tokens = [p for p in pieces if p.kind not in TRIVIA]
        self.comments = [p for p in pieces if p.kind in ("line_comment", "block_comment")]
        self.lines = [0]
        while (at := source.find(b"\n", self.lines[-1])) >= 0:
            self.lines.append(at + 1)
        self.token_starts = [t.start for t in self.tokens]
        self.comment_starts = [c.start for c in self.comments]
        self.root = _Parser(self).file()

    def line(self, offset: int) -> int:
        return bisect_right(self.lines, offset)

    def text(self, node: Node) -> str:
        return self.source[node.start : node.end].decode("utf-8", "replace")

    def own_tokens(self, start: int, end: int):
        """Tokens within a byte range, without semicolons that line ends imply."""
        for t in self.tokens[bisect_right(self.token_starts, start - 1) :]:
            if t.start >= end:
                break
            if not t.inserted:
                yield t

    def shape(self, node: Node | None) -> str:
        """The node's tokens without white space, comments and implied semicolons: equal for equal code."""
        return "" if node is None else " ".join(t.text for t in self.own_tokens(node.start, node.end) if t.text != ";")

    def has_comment(self, start: int, end: int) -> bool:
        k = bisect_right(self.comment_starts, start - 1)
        return k < len(self.comments) and self.comments[k].start < end


class _Parser:
    def __init__(self, tree: Tree):
        self.tree, self.tokens, self.i, self.level, self.depth = tree, tree.tokens, 0, 0, 0
        self.toks = [p.text if p.kind in ("operator", "keyword") else ";" if p.kind == "semicolon" else p.kind for p in tree.tokens]
        self.toks.append("eof")
        self.ats = [*tree.token_starts, len(tree.source)]
        self._set()

    # -- tokens

    def _set(self) -> None:
        i = min(self.i, len(self.tokens))
        self.at, self.tok = self.ats[i], self.toks[i]

    def next(self) -> None:
        self.i += 1
        self._set()

    def ahead(self, n: int = 1) -> str:
        return self.toks[min(self.i + n, len(self.tokens))]

    @property
    def ended(self) -> int:
        return self.tokens[self.i - 1].end if self.i else 0

    def fail(self, message: str) -> GoSyntaxError:
        return GoSyntaxError(self.at, message)

    def expect(self, tok: str) -> int:
        if self.tok != tok:
            raise self.fail(f"expected {tok}, found {self.tok}")
        at = self.at
        self.next()
        return at

    def got(self, tok: str) -> bool:
        if self.tok == tok:
            self.next()
            return True
        return False

    def node(self, kind: str, start: int, **f) -> Node:
        return Node(kind, start, max(self.ended, start), **f)

    def enclosed(self, parse):
        """What ``parse`` reads within brackets, where composite literals are allowed again."""
        level, self.level = self.level, 0
        self.depth += 1
        if self.depth > DEEPEST:
            raise self.fail("nested too deeply")
        out = parse()
        self.depth -= 1
        self.level = level
        return out

    def header(self, parse):
        level, self.level = self.level, 1
        out = parse()
        self.level = level
        return out

    def tried(self, parse):
        """What ``parse`` reads, or None, and then nothing is read."""
        i, level, depth = self.i, self.level, self.depth
        try:
            return parse()
        except GoSyntaxError:
            self.i, self.level, self.depth = i, level, depth
            self._set()
            return None

    def end_statement(self, *closing: str) -> None:
        if self.tok not in closing:
            self.expect(";")

    # -- declarations

    def file(self) -> Node:
        self.expect("package")
        name = self.ident()
        self.end_statement("eof")
        decls: list[Node] = []
        while self.tok != "eof":
            decls.append(self.declaration(top=True))
            self.end_statement("eof")
        return Node("File", 0, len(self.tree.source), name=name, decls=decls)

    def declaration(self, top: bool = False) -> Node:
        if self.tok == "func" and top:
            return self.function()
        kinds = {"import": self.import_spec, "const": self.value_spec, "var": self.value_spec, "type": self.type_spec}
        if self.tok not in kinds:
            raise self.fail(f"expected a declaration, found {self.tok}")
        start, word = self.at, self.tok
        self.next()
        specs: list[Node] = []
        grouped = self.got("(")
        if grouped:
            while self.tok != ")":
                specs.append(kinds[word](len(specs)))
                self.end_statement(")")
            self.expect(")")
        else:
            specs.append(kinds[word](0))
        return self.node("GenDecl", start, word=word, specs=specs, grouped=grouped)

    def import_spec(self, _: int) -> Node:
        start, name = self.at, None
        if self.tok in ("ident", "."):
            name = self.tokens[self.i].text
            self.next()
        path = self.tokens[self.i].text if self.tok == "string" else None
        self.expect("string")
        return self.node("ImportSpec", start, name=name, path=path[1:-1])

    def value_spec(self, index: int) -> Node:
        start, names = self.at, self.idents()
        kind = self.type() if self.tok not in ("=", ";", ")") else None
        values = self.expressions() if self.got("=") else []
        return self.node("ValueSpec", start, names=names, type=kind, values=values, iota=index)

    def type_spec(self, _: int) -> Node:
        start, name, params = self.at, self.ident(), []
        if self.tok == "[" and self.ahead() == "ident" and self.ahead(2) not in ("]", "*", "+", "-", "/", "."):
            params = self.type_params()
        alias = self.got("=")
        return self.node("TypeSpec", start, name=name, params=params, alias=alias, type=self.type())

    def function(self) -> Node:
        start = self.expect("func")
        receiver = self.fields() if self.tok == "(" else []
        name = self.ident()
        params = self.type_params() if self.tok == "[" else []
        signature = self.signature(self.at)
        body = self.block() if self.tok == "{" else None
        return self.node("FuncDecl", start, receiver=receiver, name=name, type_params=params, type=signature, body=body)

    def signature(self, start: int) -> Node:
        params, results = self.fields(), []
        if self.tok == "(":
            results = self.fields()
        elif self.starts_type():
            kind = self.type()
            results = [Node("Field", kind.start, kind.end, names=[], type=kind, variadic=False, tag=None)]
        return self.node("FuncType", start, params=params, results=results)

    def type_params(self) -> list[Node]:
        self.expect("[")
        out = self.enclosed(lambda: self.field_list("]", union=True))
        self.expect("]")
        return out

    def fields(self) -> list[Node]:
        self.expect("(")
        out = self.enclosed(lambda: self.field_list(")"))
        self.expect(")")
        return out

    def field_list(self, close: str, union: bool = False) -> list[Node]:
        entries: list[tuple[int, Node, Node | None, bool]] = []  # start, name or type, type, variadic
        whole = self.union if union else self.type
        while self.tok != close:
            start, variadic, second = self.at, False, None
            if self.got("..."):
                first, variadic = whole(), True
            elif self.tok == "ident" and self.ahead() == "[":
                first, second = self.tried(lambda: (self.ident(), self.type())) or (whole(), None)
            else:
                first = whole()
                if self.tok not in (",", close):
                    variadic = self.got("...")
                    second = whole()
            entries.append((start, first, second, variadic))
            if not self.got(","):
                break
        if not any(second for _, _, second, _ in entries):
            return [Node("Field", s, a.end, names=[], type=a, variadic=v, tag=None) for s, a, _, v in entries]
        out, names, begun = [], [], None
        for s, a, b, v in entries:
            if a.kind != "Ident":
                raise GoSyntaxError(a.start, "mixed named and unnamed parameters")
            begun = s if begun is None else begun
            names.append(a)
            if b:
                out.append(Node("Field", begun, b.end, names=names, type=b, variadic=v, tag=None))
                names, begun = [], None
        if names:
            raise GoSyntaxError(names[0].start, "a parameter has no type")
        return out

    # -- types

    def starts_type(self) -> bool:
        return self.tok in ("ident", "*", "[", "map", "chan", "func", "struct", "interface", "<-")

    def type(self) -> Node:
        start, tok = self.at, self.tok
        if tok == "ident":
            out = self.ident()
            if self.got("."):
                out = self.node("Selector", start, x=out, name=self.ident())
            if self.tok == "[" and self.ahead() != "]":
                args = self.tried(self.type_args)
                if args:
                    out = self.node("Index", start, x=out, args=args)
            return out
        if tok == "*":
            self.next()
            return self.node("Star", start, x=self.type())
        if tok == "(":
            self.next()
            x = self.enclosed(self.type)
            self.expect(")")
            return self.node("Paren", start, x=x)
        if tok == "[":
            self.next()
            if self.got("]"):
                return self.node("SliceType", start, elem=self.type())
            size = None if self.got("...") else self.enclosed(self.expression)
            self.expect("]")
            return self.node("ArrayType", start, size=size, elem=self.type())
        if tok == "map":
            self.next()
            self.expect("[")
            key = self.enclosed(self.type)
            self.expect("]")
            return self.node("MapType", start, key=key, elem=self.type())
        if tok == "chan":
            self.next()
            way = "send" if self.got("<-") else "both"
            return self.node("ChanType", start, way=way, elem=self.type())
        if tok == "<-":
            self.next()
            self.expect("chan")
            return self.node("ChanType", start, way="receive", elem=self.type())
        if tok == "func":
            self.next()
            return self.signature(start)
        if tok == "struct":
            self.next()
            return self.node("StructType", start, fields=self.members(self.struct_field))
        if tok == "interface":
            self.next()
            return self.node("InterfaceType", start, elems=self.members(self.interface_elem))
        if tok == "~":
            self.next()
            return self.node("Tilde", start, x=self.type())
        raise self.fail(f"expected a type, found {tok}")

    def type_args(self) -> list[Node]:
        self.expect("[")
        out = self.enclosed(lambda: self.listed("]", self.type))
        if self.tok != "]" or not out:
            raise self.fail("expected ]")
        self.next()
        return out

    def union(self) -> Node:
        start, terms = self.at, [self.type()]
        while self.got("|"):
            terms.append(self.type())
        return terms[0] if len(terms) == 1 else self.node("Union", start, terms=terms)

    def members(self, member) -> list[Node]:
        self.expect("{")
        out = []

        def every():
            while self.tok != "}":
                out.append(member())
                self.end_statement("}")

        self.enclosed(every)
        self.expect("}")
        return out

    def struct_field(self) -> Node:
        start, names = self.at, []
        if self.tok == "ident" and self.ahead() not in (";", "}", "string", "."):
            if self.ahead() == "[":
                pair = self.tried(lambda: (self.ident(), self.type()))
                names, kind = ([pair[0]], pair[1]) if pair else ([], self.type())
            else:
                names = self.idents()
                kind = self.type()
        else:
            kind = self.type()
        tag = None
        if self.tok == "string":
            tag = Node("Literal", self.at, self.tokens[self.i].end, word="string", value=self.tokens[self.i].text)
            self.next()
        return self.node("Field", start, names=names, type=kind, variadic=False, tag=tag)

    def interface_elem(self) -> Node:
        start = self.at
        if self.tok == "ident" and self.ahead() == "(":
            name = self.ident()
            return self.node("Field", start, names=[name], type=self.signature(self.at), variadic=False, tag=None)
        kind = self.union()
        return self.node("Field", start, names=[], type=kind, variadic=False, tag=None)

    # -- statements

    def block(self) -> Node:
        start = self.expect("{")
        body = self.enclosed(lambda: self.statements("}"))
        self.expect("}")
        return self.node("Block", start, body=body)

    def statements(self, *closing: str) -> list[Node]:
        out = []
        while self.tok not in closing:
            if self.tok == "eof":
                raise self.fail("the file ends within a block")
            out.append(self.statement())
            self.end_statement(*closing)
        return out

    def statement(self) -> Node:
        start, tok = self.at, self.tok
        if tok in ("var", "const", "type"):
            return self.node("DeclStmt", start, decl=self.declaration())
        if tok == "{":
            return self.block()
        if tok == ";":
            return Node("Empty", start, start)
        special = {"if": self.if_, "for": self.for_, "switch": self.switch, "select": self.select}.get(tok)
        if special:
            return special()
        if tok == "return":
            self.next()
            return self.node("Return", start, values=self.expressions() if self.tok not in (";", "}") else [])
        if tok in ("go", "defer"):
            self.next()
            return self.node("Go" if tok == "go" else "Defer", start, call=self.expression())
        if tok in ("break", "continue", "goto", "fallthrough"):
            self.next()
            return self.node("Branch", start, word=tok, label=self.ident() if self.tok == "ident" else None)
        if tok == "ident" and self.ahead() == ":":
            label = self.ident()
            self.next()
            return self.node("Labeled", start, label=label, stmt=Node("Empty", self.at, self.at) if self.tok == "}" else self.statement())
        return self.simple()

    def simple(self, ranged: bool = False) -> Node:
        start = self.at
        if ranged and self.tok == "range":
            self.next()
            return self.node("Range", start, left=[], word=None, x=self.expression())
        left = self.expressions()
        word = self.tok
        if word in ASSIGN:
            at = self.at
            self.next()
            if ranged and word in ("=", ":=") and self.got("range"):
                return self.node("Range", start, left=left, word=word, x=self.expression())
            return self.node("Assign", start, left=left, word=word, at=at, right=self.expressions())
        if len(left) > 1:
            raise self.fail(f"expected an assignment, found {word}")
        if word in ("++", "--"):
            self.next()
            return self.node("IncDec", start, x=left[0], word=word)
        if word == "<-":
            self.next()
            return self.node("Send", start, chan=left[0], value=self.expression())
        return self.node("ExprStmt", start, x=left[0])

    def if_(self) -> Node:
        start = self.expect("if")

        def head():
            init = cond = None
            if self.tok == "{":
                raise self.fail("an if has no condition")
            if self.tok != ";":
                init = self.simple()
            if self.got(";"):
                cond = self.simple()
            else:
                init, cond = None, init
            if cond is None or cond.kind != "ExprStmt":
                raise self.fail("a condition is no expression")
            return init, cond.x

        init, cond = self.header(head)
        body, other = self.block(), None
        if self.got("else"):
            if self.tok not in ("if", "{"):
                raise self.fail("expected if or a block behind else")
            other = self.if_() if self.tok == "if" else self.block()
        return self.node("If", start, init=init, cond=cond, body=body, other=other)

    def for_(self) -> Node:
        start = self.expect("for")

        def head():
            if self.tok == "{":
                return None, None, None
            init = self.simple(ranged=True) if self.tok != ";" else None
            if init is not None and (init.kind == "Range" or self.tok == "{"):
                return init, None, None
            self.expect(";")
            cond = self.expression() if self.tok not in (";", "{") else None
            if self.tok != "{":
                self.expect(";")
            post = self.simple() if self.tok != "{" else None
            return Node("Clause", start, start, init=init), cond, post

        init, cond, post = self.header(head)
        if init is not None and init.kind == "Range":
            return self.node("RangeStmt", start, left=init.left, word=init.word, x=init.x, body=self.block())
        if init is not None and init.kind == "Clause":
            init = init.init
        elif init is not None:
            if init.kind != "ExprStmt":
                raise self.fail("a condition is no expression")
            init, cond = None, init.x
        return self.node("For", start, init=init, cond=cond, post=post, body=self.block())

    def switch(self) -> Node:
        start = self.expect("switch")

        def head():
            init = tag = None
            if self.tok != "{":
                if self.tok != ";":
                    tag = self.simple()
                if self.got(";"):
                    init, tag = tag, self.simple() if self.tok != "{" else None
            return init, tag

        init, tag = self.header(head)
        guard = tag and (tag.x if tag.kind == "ExprStmt" else tag.right[0] if tag.kind == "Assign" else None)
        typed = guard is not None and guard.kind == "TypeAssert" and guard.type is None
        clauses = self.clauses(lambda: self.listed(":", self.type_or_expression))
        if typed:
            return self.node("TypeSwitch", start, init=init, assign=tag, clauses=clauses)
        if tag is not None and tag.kind != "ExprStmt":
            raise self.fail("a switch tag is no expression")
        return self.node("Switch", start, init=init, tag=tag and tag.x, clauses=clauses)

    def select(self) -> Node:
        start = self.expect("select")
        return self.node("Select", start, clauses=self.clauses(lambda: [self.simple()]))

    def clauses(self, cases) -> list[Node]:
        self.expect("{")

        def every():
            out = []
            while self.tok != "}":
                start, default = self.at, self.tok == "default"
                if not default and self.tok != "case":
                    raise self.fail(f"expected case, found {self.tok}")
                self.next()
                own = [] if default else cases()
                self.expect(":")
                body = self.statements("case", "default", "}")
                out.append(self.node("Clause", start, default=default, cases=own, body=body))
            return out

        out = self.enclosed(every)
        self.expect("}")
        return out

    # -- expressions

    def ident(self) -> Node:
        if self.tok != "ident":
            raise self.fail(f"expected a name, found {self.tok}")
        out = Node("Ident", self.at, self.tokens[self.i].end, name=self.tokens[self.i].text)
        self.next()
        return out

    def idents(self) -> list[Node]:
        out = [self.ident()]
        while self.got(","):
            out.append(self.ident())
        return out

    def listed(self, close: str, item) -> list[Node]:
        out = []
        while self.tok != close:
            out.append(item())
            if not self.got(","):
                break
        return out

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.got(","):
            out.append(self.expression())
        return out

    def type_or_expression(self) -> Node:
        return self.expression()

    def expression(self, least: int = 1) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise self.fail("nested too deeply")
        left = self.unary()
        while LEVELS.get(self.tok, 0) >= least:
            word, at = self.tok, self.at
            self.next()
            right = self.expression(LEVELS[word] + 1)
            left = self.node("Binary", left.start, x=left, word=word, at=at, y=right)
        self.depth -= 1
        return left

    def unary(self) -> Node:
        start, tok = self.at, self.tok
        if tok == "<-" and self.ahead() == "chan":
            return self.primary(self.type())
        if tok in ("+", "-", "!", "^", "&", "<-", "~"):
            self.next()
            return self.node("Unary", start, word=tok, x=self.unary())
        if tok == "*":
            self.next()
            return self.node("Star", start, x=self.unary())
        return self.primary(self.operand())

    def operand(self) -> Node:
        start, tok = self.at, self.tok
        if tok == "ident":
            return self.ident()
        if tok in LITERALS:
            value = self.tokens[self.i].text
            self.next()
            return self.node("Literal", start, word=tok, value=value)
        if tok == "(":
            self.next()
            x = self.enclosed(self.expression)
            self.expect(")")
            return self.node("Paren", start, x=x)
        if tok == "func":
            self.next()
            kind = self.signature(start)
            if self.tok == "{":
                return self.node("FuncLit", start, type=kind, body=self.enclosed(self.block))
            return kind
        if tok in ("[", "struct", "map", "chan", "interface"):
            return self.type()
        raise self.fail(f"expected an expression, found {tok}")

    def primary(self, x: Node) -> Node:
        start = x.start
        while True:
            if self.tok == ".":
                self.next()
                if self.got("("):
                    if self.got("type"):
                        kind = None
                    else:
                        kind = self.enclosed(self.type)
                    self.expect(")")
                    x = self.node("TypeAssert", start, x=x, type=kind)
                else:
                    x = self.node("Selector", start, x=x, name=self.ident())
            elif self.tok == "[":
                self.next()
                x = self.enclosed(lambda x=x: self.index(x, start))
            elif self.tok == "(":
                self.next()
                args, spread = self.enclosed(self.arguments)
                self.expect(")")
                x = self.node("Call", start, fun=x, args=args, spread=spread)
            elif self.tok == "{" and self.takes_literal(x):
                x = self.node("Composite", start, type=x, elems=self.elements())
                x.end = self.ended
            else:
                return x

    def index(self, x: Node, start: int) -> Node:
        parts: list[Node | None] = [None if self.tok in (":", "]") else self.expression()]
        if self.tok == ":":
            while self.got(":"):
                parts.append(None if self.tok in (":", "]") else self.expression())
            self.expect("]")
            return self.node("Slice", start, x=x, parts=parts)
        if parts[0] is None:
            raise self.fail("an index is missing")
        while self.got(","):
            if self.tok == "]":
                break
            parts.append(self.expression())
        self.expect("]")
        return self.node("Index", start, x=x, args=parts)

    def arguments(self) -> tuple[list[Node], bool]:
        args, spread = [], False
        while self.tok != ")":
            args.append(self.expression())
            spread = self.got("...") or spread
            if not self.got(","):
                break
        return args, spread

    def takes_literal(self, x: Node) -> bool:
        if x.kind in ("SliceType", "ArrayType", "MapType", "StructType"):
            return True
        if self.level:
            return False
        return x.kind == "Ident" or x.kind == "Selector" and x.x.kind == "Ident" or x.kind == "Index" and x.x.kind in ("Ident", "Selector")

    def elements(self) -> list[Node]:
        self.expect("{")

        def value() -> Node:
            if self.tok != "{":
                return self.expression()
            start = self.at
            elems = self.elements()
            return self.node("Composite", start, type=None, elems=elems)

        def element() -> Node:
            start, x = self.at, value()
            return self.node("KeyValue", start, key=x, value=value()) if self.got(":") else x

        out = self.enclosed(lambda: self.listed("}", element))
        self.expect("}")
        return out


def parse(source: bytes) -> Tree:
    try:
        return Tree(source)
    except RecursionError:
        raise GoSyntaxError(0, "nested too deeply") from None


def rows(tree: Tree) -> list[tuple[int, int | None, int, str, int, int, int, str | None]]:
    """(id, parent, place among the parent's, kind, start, end, line, name) of every node, parents first."""
    out, stack = [], [(tree.root, None, 0)]
    while stack:
        n, parent, place = stack.pop()
        own = len(out)
        name = n.f.get("name")
        name = name.name if isinstance(name, Node) else name if isinstance(name, str) else n.f.get("word") if isinstance(n.f.get("word"), str) else None
        out.append((own, parent, place, n.kind, n.start, n.end, tree.line(n.start), name))
        stack.extend((k, own, i) for i, k in reversed(list(enumerate(n.kids()))))
    return out
