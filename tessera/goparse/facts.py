"""What a Go file tells about its names: imports, scopes, constants, and types as far as the file and the tables below show them.

Types are strings: ``int``, ``[]byte``, ``*os.File``; a type that the file declares is ``@Name``. What can't be told is None, and rules
that need it find nothing. Constants are evaluated exactly: integers have no bound, division truncates as in the language.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass
from fractions import Fraction

from tessera.goparse.syntax import Node, Tree

# Fixed values of the language and its standard library: predeclared names, and results of functions and methods that rules ask for.
BASIC = frozenset("bool string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr byte rune float32 float64 complex64 complex128 error any".split())
BUILTINS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())
SIZES = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "int": 64, "rune": 32, "uint8": 8, "byte": 8, "uint16": 16, "uint32": 32, "uint64": 64, "uint": 64, "uintptr": 64}
SAME = {"byte": "uint8", "rune": "int32", "interface{}": "any"}
RESULTS = {
    "bufio.NewReader": "*bufio.Reader", "bufio.NewScanner": "*bufio.Scanner", "bufio.NewWriter": "*bufio.Writer", "bytes.NewBuffer": "*bytes.Buffer", "bytes.NewBufferString": "*bytes.Buffer",
    "bytes.Equal": "bool", "compress/gzip.NewWriter": "*compress/gzip.Writer", "archive/tar.NewWriter": "*archive/tar.Writer", "archive/zip.NewWriter": "*archive/zip.Writer",
    "context.Background": "context.Context", "context.TODO": "context.Context", "context.WithCancel": "context.Context context.CancelFunc", "context.WithTimeout": "context.Context context.CancelFunc",
    "context.WithDeadline": "context.Context context.CancelFunc", "context.WithValue": "context.Context", "encoding/csv.NewWriter": "*encoding/csv.Writer", "encoding/json.Marshal": "[]byte error",
    "encoding/json.Unmarshal": "error", "errors.New": "error", "errors.Is": "bool", "errors.As": "bool", "errors.Join": "error", "fmt.Errorf": "error", "fmt.Sprint": "string", "fmt.Sprintf": "string", "fmt.Sprintln": "string",
    "io.Copy": "int64 error", "io.ReadAll": "[]byte error", "io.WriteString": "int error", "math.NaN": "float64", "math.Abs": "float64", "math.Floor": "float64", "math.Sqrt": "float64",
    "net.Dial": "net.Conn error", "net.Listen": "net.Listener error", "net.ParseIP": "net.IP", "net/http.Get": "*net/http.Response error", "net/http.Post": "*net/http.Response error", "net/http.Head": "*net/http.Response error",
    "net/http.NewRequest": "*net/http.Request error", "net/url.Parse": "*net/url.URL error", "os.Chdir": "error", "os.Chmod": "error", "os.Create": "*os.File error", "os.Getenv": "string", "os.Mkdir": "error", "os.MkdirAll": "error",
    "os.Open": "*os.File error", "os.OpenFile": "*os.File error", "os.ReadFile": "[]byte error", "os.Remove": "error", "os.RemoveAll": "error", "os.Rename": "error", "os.Setenv": "error", "os.Stat": "os.FileInfo error",
    "os.WriteFile": "error", "os.TempDir": "string", "os.UserHomeDir": "string error", "os.UserCacheDir": "string error", "os.UserConfigDir": "string error", "os/exec.Command": "*os/exec.Cmd", "os/exec.CommandContext": "*os/exec.Cmd",
    "regexp.Compile": "*regexp.Regexp error", "regexp.MustCompile": "*regexp.Regexp", "regexp.MatchString": "bool error", "strconv.Atoi": "int error", "strconv.Itoa": "string", "strconv.ParseInt": "int64 error",
    "strconv.ParseBool": "bool error", "strconv.ParseFloat": "float64 error", "strconv.ParseUint": "uint64 error", "strconv.Quote": "string", "strings.Contains": "bool", "strings.Fields": "[]string", "strings.HasPrefix": "bool", "strings.Join": "string",
    "strings.Repeat": "string", "strings.Replace": "string", "strings.ReplaceAll": "string", "strings.Split": "[]string", "strings.ToLower": "string", "strings.ToUpper": "string", "strings.TrimSpace": "string", "time.Now": "time.Time",
    "time.Parse": "time.Time error", "time.Since": "time.Duration", "time.Until": "time.Duration", "database/sql.Open": "*database/sql.DB error", "sync.NewCond": "*sync.Cond",
}
METHODS = {
    "(bytes.Buffer).Bytes": "[]byte", "(bytes.Buffer).String": "string", "(bytes.Buffer).WriteString": "int error", "(bytes.Buffer).Write": "int error", "(bytes.Buffer).WriteByte": "error", "(strings.Builder).String": "string",
    "(strings.Builder).WriteString": "int error", "(strings.Builder).Write": "int error", "(strings.Builder).WriteByte": "error", "(bufio.Writer).Flush": "error", "(bufio.Scanner).Err": "error", "(bufio.Scanner).Scan": "bool",
    "(compress/gzip.Writer).Close": "error", "(archive/tar.Writer).Close": "error", "(archive/zip.Writer).Close": "error", "(encoding/csv.Writer).Error": "error", "(encoding/csv.Writer).Write": "error",
    "(net/http.Client).Do": "*net/http.Response error", "(net/http.Client).Get": "*net/http.Response error", "(net/http.Request).Context": "context.Context", "(net/url.URL).Query": "net/url.Values", "(net/url.URL).String": "string",
    "(os.File).Close": "error", "(os.File).Write": "int error", "(os.File).WriteString": "int error", "(os.File).Sync": "error", "(os.File).Name": "string", "(os/exec.Cmd).Run": "error", "(os/exec.Cmd).Start": "error", "(os/exec.Cmd).Wait": "error",
    "(os/exec.Cmd).StdoutPipe": "io.ReadCloser error", "(os/exec.Cmd).StderrPipe": "io.ReadCloser error", "(time.Time).Sub": "time.Duration", "(time.Time).Add": "time.Time", "(time.Time).Unix": "int64", "(time.Time).Format": "string",
    "(error).Error": "string", "(database/sql.DB).Begin": "*database/sql.Tx error", "(database/sql.DB).Query": "*database/sql.Rows error", "(database/sql.Rows).Next": "bool", "(database/sql.Rows).Err": "error", "(database/sql.Rows).Close": "error",
    "(database/sql.Tx).Commit": "error", "(database/sql.Tx).Rollback": "error", "(net.IP).String": "string", "(io.ReadCloser).Close": "error", "(net.Conn).Close": "error", "(net.Listener).Close": "error",
}
VALUES = {"os.Args": "[]string", "os.Stdin": "*os.File", "os.Stdout": "*os.File", "os.Stderr": "*os.File", "net/http.DefaultClient": "*net/http.Client"}
FIELDS = {"(net/http.Response).Body": "io.ReadCloser", "(net/http.Request).Header": "net/http.Header", "(net/http.Response).Header": "net/http.Header", "(net/http.Request).URL": "*net/url.URL", "(net/http.Request).Body": "io.ReadCloser"}
NUMBERS = {f"math.{p}{n}": v for n in (8, 16, 32, 64) for p, v in (("MaxInt", 2 ** (n - 1) - 1), ("MinInt", -(2 ** (n - 1))), ("MaxUint", 2**n - 1))} | {"math.MaxInt": 2**63 - 1, "math.MinInt": -(2**63)}


@dataclass(eq=False)
class Decl:
    """A name: kind (import, const, var, param, result, range, func, type), its type and value, if they stand there; ``index`` among several values."""

    kind: str
    name: str
    node: Node
    type: Node | None = None
    value: Node | None = None
    index: int = 0
    of: int = 1
    top: bool = False
    function: Node | None = None


class Facts:
    def __init__(self, tree: Tree):
        self.tree = tree
        self.parents: dict[int, Node] = {}
        self.uses: dict[int, Decl] = {}
        self.declared: list[Decl] = []
        self.package: dict[str, Decl] = {}
        self.imports: dict[str, str] = {}
        self.methods: dict[tuple[str, str], Node] = {}
        self._types: dict[int, list[str | None]] = {}
        self._busy: set[int] = set()
        stack = [tree.root]
        while stack:
            n = stack.pop()
            for k in n.kids():
                self.parents[id(k)] = n
                stack.append(k)
        self._scopes: list[dict[str, Decl]] = [self.package]
        self._function: Node | None = None
        self._top()
        for d in tree.root.decls:
            self._visit(d)

    # -- scopes

    def _top(self) -> None:
        for d in self.tree.root.decls:
            if d.kind == "FuncDecl":
                if d.receiver:
                    base = self.base_name(d.receiver[0].type)
                    if base:
                        self.methods[base, d.name.name] = d
                elif d.name.name not in ("init", "_"):
                    self.package[d.name.name] = Decl("func", d.name.name, d.name, d.type, d, top=True)
                continue
            for s in d.specs:
                if s.kind == "ImportSpec":
                    parts = s.path.split("/")
                    last = parts[-2] if len(parts) > 1 and parts[-1][:1] == "v" and parts[-1][1:].isdigit() else parts[-1]
                    if s.name not in ("_", "."):
                        self.imports[s.name or last] = s.path
                elif s.kind == "TypeSpec":
                    self.package[s.name.name] = Decl("type", s.name.name, s.name, s.type, s, top=True)
                else:
                    self._values(d.word, s, self.package, top=True)

    def _values(self, word: str, s: Node, scope: dict[str, Decl], top: bool = False) -> None:
        for i, name in enumerate(s.names):
            value = s.values[i] if len(s.values) == len(s.names) else s.values[0] if s.values else None
            several = len(s.values) != len(s.names)
            own = Decl(word, name.name, name, s.type, value, i if several else 0, len(s.names) if several else 1, top, self._function if not top else None)
            self._declare(own, scope)

    def _declare(self, own: Decl, scope: dict[str, Decl] | None = None) -> None:
        self.uses[id(own.node)] = own
        self.declared.append(own)
        if own.name != "_":
            (self._scopes[-1] if scope is None else scope)[own.name] = own

    def _find(self, name: str) -> Decl | None:
        for scope in reversed(self._scopes):
            if name in scope:
                return scope[name]
        return None

    def _within(self, *nodes) -> None:
        self._scopes.append({})
        for n in nodes:
            if n is not None:
                self._visit(n)
        self._scopes.pop()

    def _fields(self, fields: list[Node], kind: str) -> None:
        for f in fields:
            self._visit(f.type)
            for name in f.names:
                self._declare(Decl(kind, name.name, name, f.type, f if f.variadic else None, function=self._function))

    def _visit(self, n: Node) -> None:
        kind = n.kind
        if kind in ("FuncDecl", "FuncLit"):
            outer, self._function = self._function, n
            self._scopes.append({})
            if kind == "FuncDecl":
                self._fields(n.receiver, "param")
                self._fields(n.type_params, "type")
            self._fields(n.type.params, "param")
            self._fields(n.type.results, "result")
            if n.body is not None:
                for s in n.body.body:
                    self._visit(s)
            self._scopes.pop()
            self._function = outer
        elif kind in ("Block", "Clause", "If", "For", "Switch", "Select"):
            self._within(*n.kids())
        elif kind == "TypeSwitch":
            self._scopes.append({})
            if n.init is not None:
                self._visit(n.init)
            guard = n.assign.right[0] if n.assign.kind == "Assign" else n.assign.x
            self._visit(guard.x)
            for c in n.clauses:
                self._scopes.append({})
                for case in c.cases:
                    self._visit(case)
                if n.assign.kind == "Assign":
                    name = n.assign.left[0]
                    self._scopes[-1][name.name] = Decl("var", name.name, name, c.cases[0] if len(c.cases) == 1 else None, None if len(c.cases) == 1 else guard.x, function=self._function)
                for s in c.body:
                    self._visit(s)
                self._scopes.pop()
            self._scopes.pop()
        elif kind == "RangeStmt":
            self._scopes.append({})
            self._visit(n.x)
            for i, x in enumerate(n.left):
                if n.word == ":=" and x.kind == "Ident":
                    self._declare(Decl("range", x.name, x, None, n.x, i, function=self._function))
                else:
                    self._visit(x)
            self._visit(n.body)
            self._scopes.pop()
        elif kind == "Assign":
            for x in n.right:
                self._visit(x)
            for i, x in enumerate(n.left):
                if n.word == ":=" and x.kind == "Ident" and (x.name == "_" or x.name not in self._scopes[-1]):
                    several = len(n.right) != len(n.left)
                    self._declare(Decl("var", x.name, x, None, n.right[0] if several else n.right[i], i if several else 0, len(n.left) if several else 1, function=self._function))
                else:
                    self._visit(x)
        elif kind == "GenDecl":
            for s in n.specs:
                if s.kind == "TypeSpec":
                    if len(self._scopes) > 1:
                        self._declare(Decl("type", s.name.name, s.name, s.type, s, function=self._function))
                    self._within(*s.params, s.type)
                elif s.kind == "ValueSpec":
                    for x in (s.type, *s.values):
                        if x is not None:
                            self._visit(x)
                    if len(self._scopes) > 1:
                        self._values(n.word, s, self._scopes[-1])
        elif kind == "Selector":
            self._visit(n.x)
        elif kind == "KeyValue":
            if n.key.kind != "Ident" or self._find(n.key.name) is not None and not self._struct_key(n):
                self._visit(n.key)
            self._visit(n.value)
        elif kind == "Field":
            self._visit(n.type)
        elif kind == "Labeled":
            self._visit(n.stmt)
        elif kind == "Ident":
            found = self._find(n.name)
            if found is not None:
                self.uses[id(n)] = found
        elif kind != "Branch":
            for k in n.kids():
                self._visit(k)

    def _struct_key(self, n: Node) -> bool:
        kind = self.parents[id(n)].get("type")
        return kind is None or kind.kind not in ("MapType", "SliceType", "ArrayType")

    # -- names and callees

    def base_name(self, kind: Node) -> str | None:
        """The name of a receiver's type."""
        while kind.kind in ("Star", "Paren"):
            kind = kind.x
        if kind.kind == "Index":
            kind = kind.x
        return kind.name if kind.kind == "Ident" else None

    def decl(self, n: Node) -> Decl | None:
        while n.kind == "Paren":
            n = n.x
        return self.uses.get(id(n))

    def symbol(self, n: Node | None) -> str | None:
        """``path.Name`` of a package's member, a predeclared name, or ``(type).Name`` of a method or field whose operand's type is known."""
        if n is None:
            return None
        if n.kind == "Paren":
            return self.symbol(n.x)
        if n.kind == "Ident":
            return n.name if id(n) not in self.uses and (n.name in BUILTINS or n.name in BASIC or n.name in ("nil", "true", "false", "iota")) else None
        if n.kind == "Index":
            return self.symbol(n.x)
        if n.kind == "Selector":
            if n.x.kind == "Ident" and id(n.x) not in self.uses and n.x.name in self.imports:
                return f"{self.imports[n.x.name]}.{n.name.name}"
            own = self.type_of(n.x)
            return f"({own.lstrip('*')}).{n.name.name}" if own else None
        return None

    def callee(self, call: Node) -> str | None:
        return self.symbol(call.fun) if call.kind == "Call" else None

    def is_type(self, n: Node) -> bool:
        while n.kind == "Paren":
            n = n.x
        if n.kind in ("SliceType", "ArrayType", "MapType", "ChanType", "FuncType", "InterfaceType", "StructType"):
            return True
        if n.kind == "Star":
            return self.is_type(n.x)
        if n.kind == "Ident":
            own = self.uses.get(id(n))
            return own.kind == "type" if own else n.name in BASIC
        return n.kind == "Selector" and self.symbol(n) in ("os.FileMode", "io/fs.FileMode", "time.Duration", "net.IP", "net/http.Header", "time.Month", "syscall.Signal", "sort.IntSlice", "sort.StringSlice")

    # -- types

    def type_string(self, n: Node | None) -> str | None:
        if n is None:
            return None
        k = n.kind
        if k == "Paren":
            return self.type_string(n.x)
        if k == "Ident":
            own = self.uses.get(id(n)) or (self.package.get(n.name) if n.name not in BASIC else None)
            if own is not None:
                return f"@{n.name}" if own.kind == "type" else None
            return SAME.get(n.name, n.name) if n.name in BASIC else f"@{n.name}"
        if k == "Selector":
            return f"{self.imports.get(n.x.name, n.x.name)}.{n.name.name}" if n.x.kind == "Ident" else None
        if k == "InterfaceType":
            return "any" if not n.elems else "interface{" + self.tree.shape(n) + "}"
        if k == "StructType":
            return "struct{" + self.tree.shape(n) + "}"
        if k == "FuncType":
            return "func(" + ",".join(self._listed(n.params)) + ")" + ",".join(self._listed(n.results))
        parts = {"Star": ("*", "x"), "SliceType": ("[]", "elem"), "Tilde": ("~", "x")}
        if k in parts:
            inner = self.type_string(n.f[parts[k][1]])
            return inner and parts[k][0] + inner
        if k == "ArrayType":
            inner, size = self.type_string(n.elem), self.constant(n.size) if n.size is not None else None
            return inner and f"[{'...' if size is None else size}]{inner}"
        if k == "MapType":
            key, elem = self.type_string(n.key), self.type_string(n.elem)
            return key and elem and f"map[{key}]{elem}"
        if k == "ChanType":
            inner = self.type_string(n.elem)
            return inner and {"both": "chan ", "send": "chan<- ", "receive": "<-chan "}[n.way] + inner
        if k == "Index":
            return self.type_string(n.x)
        return None

    def _listed(self, fields: list[Node]) -> list[str]:
        return [("..." if f.variadic else "") + (self.type_string(f.type) or "?") for f in fields for _ in range(max(1, len(f.names)))]

    def underlying(self, t: str | None) -> str | None:
        """The type itself or, of a type that the file declares, what it is declared as."""
        for _ in range(8):
            if not t or t[0] != "@":
                return t
            own = self.package.get(t[1:]) or next((d for d in self.declared if d.kind == "type" and d.name == t[1:]), None)
            if own is None or own.type is None or own.value is not None and own.value.kind == "Field":
                return None
            t = self.type_string(own.type)
        return None

    def struct(self, t: str | None) -> Node | None:
        """The struct type that a type (or a pointer to it) of the file is declared as."""
        name = (t or "").lstrip("*")
        own = self.package.get(name[1:]) if name[:1] == "@" else None
        while own is not None and own.type is not None and own.type.kind == "Ident":
            own = self.package.get(own.type.name)
        return own.type if own is not None and own.type is not None and own.type.kind == "StructType" else None

    def elem(self, t: str | None) -> str | None:
        t = self.underlying(t)
        if not t:
            return None
        if t[0] == "*" and t[1:2] == "[":
            t = t[1:]
        if t == "string":
            return "uint8"
        if t[0] == "[":
            return t[t.index("]") + 1 :]
        if t.startswith("map["):
            depth = 0
            for i, c in enumerate(t):
                depth += (c == "[") - (c == "]")
                if c == "]" and not depth:
                    return t[i + 1 :]
        for p in ("chan ", "chan<- ", "<-chan "):
            if t.startswith(p):
                return t[len(p) :]
        return None

    def type_of(self, n: Node | None) -> str | None:
        found = self.types_of(n) if n is not None else [None]
        return found[0] if len(found) == 1 else None

    def types_of(self, n: Node) -> list[str | None]:
        """The types of an expression's values: several for a call with several results."""
        if id(n) not in self._types:
            if id(n) in self._busy:
                return [None]
            self._busy.add(id(n))
            out = self._typed(n)
            self._busy.discard(id(n))
            self._types[id(n)] = out if isinstance(out, list) else [out]
        return self._types[id(n)]

    def _typed(self, n: Node):
        k = n.kind
        if k == "Literal":
            return "untyped " + {"int": "int", "float": "float", "imag": "complex", "rune": "rune", "string": "string"}[n.word]
        if k == "Ident":
            own = self.uses.get(id(n))
            if own is None:
                return {"true": "untyped bool", "false": "untyped bool", "nil": "untyped nil", "iota": "untyped int"}.get(n.name)
            return self.declared_type(own)
        if k == "Paren":
            return self.types_of(n.x)
        if k == "Star":
            t = self.type_of(n.x)
            return t[1:] if t and t[0] == "*" else None
        if k == "Unary":
            t = self.type_of(n.x)
            if n.word == "&":
                return t and "*" + t
            if n.word == "<-":
                return self.elem(t)
            return "untyped bool" if n.word == "!" and t is None else t
        if k == "Binary":
            if n.word in ("==", "!=", "<", "<=", ">", ">="):
                return "untyped bool"
            a, b = self.type_of(n.x), self.type_of(n.y)
            if n.word in ("<<", ">>"):
                return a
            if a and a.startswith("untyped") and b and not b.startswith("untyped"):
                return b
            if a and b and a.startswith("untyped") and b.startswith("untyped"):
                rank = ["untyped int", "untyped rune", "untyped float", "untyped complex"]
                return max(a, b, key=lambda t: rank.index(t) if t in rank else -1)
            return a if a and not a.startswith("untyped") else a if b else None
        if k == "Composite":
            return self.type_string(n.type)
        if k == "FuncLit":
            return self.type_string(n.type)
        if k == "TypeAssert":
            return self.type_string(n.type)
        if k == "Index":
            return self.elem(self.type_of(n.x))
        if k == "Slice":
            t = self.type_of(n.x)
            return "[]" + self.elem(t) if t and t[0] == "[" and self.elem(t) else "string" if t == "untyped string" else t
        if k == "Selector":
            name = self.symbol(n)
            if name in VALUES or name in FIELDS:
                return VALUES.get(name) or FIELDS[name]
            if name in NUMBERS:
                return "untyped int"
            inside = self.struct(self.type_of(n.x))
            for f in inside.fields if inside is not None else ():
                if any(x.name == n.name.name for x in f.names):
                    return self.type_string(f.type)
            return None
        if k == "Call":
            return self._called(n)
        return None

    def declared_type(self, own: Decl) -> str | None:
        if own.kind in ("func", "type"):
            return self.type_string(own.type) if own.kind == "func" else None
        if own.type is not None:
            t = self.type_string(own.type)
            return "[]" + t if t and own.kind == "param" and own.value is not None else t
        if own.value is None:
            return None
        if own.kind == "range":
            t = self.underlying(self.type_of(own.value))
            if t is None:
                return None
            if own.index == 1:
                return "int32" if t in ("string", "untyped string") else self.elem(t)
            if t.startswith("map["):
                return t[4 : t.index("]")]
            return self.elem(t) if "chan" in t.split(" ")[0] else t if t in SIZES else "int"
        found = self.types_of(own.value)
        t = found[own.index] if len(found) == own.of and own.index < len(found) else self._comma_ok(own)
        if own.kind != "const" and t and t.startswith("untyped"):
            t = {"untyped int": "int", "untyped float": "float64", "untyped string": "string", "untyped rune": "int32", "untyped bool": "bool", "untyped complex": "complex128"}.get(t)
        return t

    def _comma_ok(self, own: Decl) -> str | None:
        """Of the two values of an assertion, a map index or a receive."""
        if own.of != 2 or own.value.kind not in ("TypeAssert", "Index", "Unary"):
            return None
        return "bool" if own.index else self.type_of(own.value)

    def _called(self, n: Node):
        if self.is_type(n.fun):
            return self.type_string(n.fun)
        name = self.symbol(n.fun)
        if name in ("len", "cap", "copy"):
            return "int"
        if name == "make" and n.args:
            return self.type_string(n.args[0])
        if name == "new" and n.args:
            t = self.type_string(n.args[0])
            return t and "*" + t
        if name in ("append", "min", "max") and n.args:
            return self.type_of(n.args[0])
        if name in ("panic", "print", "println", "close", "delete", "clear"):
            return []
        found = RESULTS.get(name) or METHODS.get(name)
        if found:
            return found.split()
        fun = n.fun.x if n.fun.kind == "Paren" else n.fun
        own = self.decl(fun) if fun.kind == "Ident" else None
        if own is not None and own.kind == "func":
            return self._listed(own.type.results)
        if fun.kind == "FuncLit":
            return self._listed(fun.type.results)
        if fun.kind == "Selector":
            t = self.type_of(fun.x)
            method = self.methods.get((t.lstrip("*")[1:], fun.name.name)) if t and t.lstrip("*")[:1] == "@" else None
            if method is not None:
                return self._listed(method.type.results)
        t = self.underlying(self.type_of(fun)) if fun.kind in ("Ident", "Selector") else None
        if t and t.startswith("func("):
            depth = 0
            for i, c in enumerate(t[4:], 4):
                depth += (c == "(") - (c == ")")
                if not depth:
                    return [x for x in t[i + 1 :].split(",") if x]
        return None

    def signature(self, call: Node) -> Node | None:
        """The signature of a function or method of the file that a call goes to."""
        fun = call.fun
        if fun.kind == "Ident":
            own = self.decl(fun)
            return own.type if own is not None and own.kind == "func" else None
        if fun.kind == "Selector":
            t = self.type_of(fun.x)
            method = self.methods.get((t.lstrip("*")[1:], fun.name.name)) if t and t.lstrip("*")[:1] == "@" else None
            return method.type if method is not None else None
        return fun.type if fun.kind == "FuncLit" else None

    # -- constants

    def constant(self, n: Node | None):
        """The value of a constant expression: int, Fraction, str, bool; None if it isn't one or isn't known."""
        if n is None:
            return None
        k = n.kind
        if k == "Paren":
            return self.constant(n.x)
        if k == "Literal":
            return literal(n)
        if k == "Ident":
            own = self.uses.get(id(n))
            if own is None:
                return {"true": True, "false": False}.get(n.name)
            if own.kind != "const" or own.value is None or id(own.node) in self._busy:
                return None
            self._busy.add(id(own.node))
            out = self.constant(own.value)
            self._busy.discard(id(own.node))
            if own.value.kind == "Ident" and own.value.name == "iota" and id(own.value) not in self.uses:
                return self.parents[id(own.node)].iota
            return out
        if k == "Selector":
            return NUMBERS.get(self.symbol(n))
        if k == "Unary":
            x = self.constant(n.x)
            if isinstance(x, bool):
                return not x if n.word == "!" else None
            if isinstance(x, (int, Fraction)) and n.word in ("+", "-"):
                return -x if n.word == "-" else x
            return ~x if isinstance(x, int) and n.word == "^" else None
        if k == "Binary":
            return folded(n.word, self.constant(n.x), self.constant(n.y))
        if k == "Call" and len(n.args) == 1:
            name = self.symbol(n.fun)
            x = self.constant(n.args[0])
            if name == "len" and isinstance(x, str):
                return len(x.encode("utf-8", "surrogateescape"))
            if name in SIZES and isinstance(x, int) and not isinstance(x, bool):
                return x
            if name in ("float32", "float64") and isinstance(x, (int, Fraction)):
                return Fraction(x)
            return x if name == "string" and isinstance(x, str) else None
        return None


def literal(n: Node):
    text = n.value
    if n.word == "string":
        if text[0] == "`":
            return text[1:-1].replace("\r", "")
        try:
            return ast.literal_eval(text)
        except (SyntaxError, ValueError):
            return None
    if n.word == "rune":
        try:
            return ord(ast.literal_eval(text))
        except (SyntaxError, ValueError, TypeError):
            return None
    text = text.replace("_", "")
    try:
        if n.word == "int":
            return int(text, 8) if len(text) > 1 and text[0] == "0" and text.isdigit() else int(text, 0)
        if n.word == "float":
            return Fraction(float.fromhex(text)) if text[:2].lower() == "0x" else Fraction(text)
    except ValueError:
        pass
    return None


def folded(word: str, a, b):
    """The constant ``a word b``; None where it isn't defined. Integer division truncates towards zero."""
    if a is None or b is None or isinstance(a, bool) != isinstance(b, bool) or isinstance(a, str) != isinstance(b, str):
        return None
    if word in ("==", "!=", "<", "<=", ">", ">="):
        return {"==": a == b, "!=": a != b}[word] if word in ("==", "!=") else None if isinstance(a, bool) else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[word]
    if isinstance(a, bool):
        return {"&&": a and b, "||": a or b}.get(word)
    if isinstance(a, str):
        return a + b if word == "+" else None
    whole = isinstance(a, int) and isinstance(b, int)
    if word in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[word]
    if word in ("/", "%"):
        if not b:
            return None
        if not whole:
            return Fraction(a) / b if word == "/" else None
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return q if word == "/" else a - b * q
    if not whole:
        return None
    if word in ("<<", ">>"):
        return None if b < 0 or b > 10_000 else a << b if word == "<<" else a >> b
    return {"&": a & b, "|": a | b, "^": a ^ b, "&^": a & ~b}.get(word)
