"""Rules about the order of statements within a function."""

from __future__ import annotations

from tessera.gorules.calls import bare, called
from tessera.gorules.registry import Context, rule
from tessera.goparse.syntax import Node

# Calls that never return.
NO_RETURN = {"panic", "os.Exit", "runtime.Goexit", "syscall.Exit", *(f"log.{a}{b}" for a in ("Fatal", "Panic") for b in ("", "f", "ln")), *(f"(testing.{t}).{m}" for t in ("T", "B", "F", "TB") for m in ("FailNow", "Fatal", "Fatalf", "Skip", "Skipf", "SkipNow"))}


def breaks(body: list[Node], label: str | None = None) -> bool:
    """Whether a break in ``body`` leaves the statement that the body belongs to."""
    for s in body:
        if s.kind == "Branch" and s.word == "break" and (s.label is None or s.label.name == label):
            return True
        if s.kind == "Labeled":
            s = s.stmt
        inner = [s.body.body] if s.kind in ("For", "RangeStmt") else [x.body for x in s.clauses] if s.kind in ("Switch", "TypeSwitch", "Select") else None
        if inner is not None:
            # An unlabelled break in there belongs to the inner statement.
            if label is not None and any(x.kind == "Branch" and x.word == "break" and x.label is not None and x.label.name == label for b in inner for y in b for x in y.walk(stop=("FuncLit",))):
                return True
            continue
        parts = [s.body] if s.kind == "Block" else [s.body.body, [s.other] if s.other is not None else []] if s.kind == "If" else []
        if any(breaks(p, label) for p in parts):
            return True
    return False


def ends(c: Context, s: Node, label: str | None = None) -> bool:
    """Whether execution never goes on behind a statement."""
    if s.kind == "Return" or s.kind == "Branch" and s.word in ("break", "continue", "goto"):
        return True
    if s.kind == "ExprStmt":
        return s.x.kind == "Call" and c.facts.callee(s.x) in NO_RETURN
    if s.kind == "Block":
        return any(ends(c, x) for x in s.body)
    if s.kind == "Labeled":
        return ends(c, s.stmt, s.label.name)
    if s.kind == "If":
        return s.other is not None and ends(c, s.body) and ends(c, s.other)
    if s.kind == "For":
        return s.cond is None and not breaks(s.body.body, label)
    if s.kind in ("Switch", "TypeSwitch", "Select"):
        whole = s.kind == "Select" or any(x.default for x in s.clauses)
        return whole and all(not breaks(x.body, label) and x.body and (ends(c, x.body[-1]) or x.body[-1].kind == "Branch") or s.kind == "Select" and not s.clauses for x in s.clauses)
    return False


@rule("unreachable-code", "cfg", "correctness", "a statement can't be reached", "Block Clause")
def unreachable_code(c: Context, n: Node):
    for a, b in zip(n.body, n.body[1:], strict=False):
        if ends(c, a) and b.kind not in ("Empty", "Labeled") and not any(s.kind == "Labeled" for s in n.body[n.body.index(b) :]):
            last = n.body[-1]
            yield (b.start, last.end), "unreachable-code", ("remove-unreachable-code", "suggestion", ((b.start, last.end, ""),))
            return


@rule("infinite-recursion", "types", "correctness", "a function does nothing but call itself", "FuncDecl")
def infinite_recursion(c: Context, n: Node):
    if n.body is None or len(n.body.body) != 1:
        return
    s = n.body.body[0]
    call = s.x if s.kind == "ExprStmt" else s.values[0] if s.kind == "Return" and len(s.values) == 1 else None
    if call is None or call.kind != "Call":
        return
    if n.receiver:
        own = n.receiver[0]
        if call.fun.kind == "Selector" and call.fun.name.name == n.name.name and own.names and bare(call.fun.x).kind == "Ident" and c.facts.decl(call.fun.x) is c.facts.decl(own.names[0]):
            yield call, "infinite-recursion"
    elif call.fun.kind == "Ident":
        own = c.facts.decl(call.fun)
        if own is not None and own.kind == "func" and own.value is n:
            yield call, "infinite-recursion"


@rule("defer-in-infinite-loop", "cfg", "suspicious", "a deferred call in an endless loop never runs", "For")
def defer_in_infinite_loop(c: Context, n: Node):
    if n.cond is not None:
        return
    above = c.parent(n)
    label = above.label.name if above is not None and above.kind == "Labeled" else None
    inside = list(n.body.walk(stop=("FuncLit",)))
    leaves = breaks(n.body.body, label) or any(x.kind == "Return" or x.kind == "Branch" and x.word == "goto" or x.kind == "Branch" and x.label is not None and x.label.name != label or x.kind == "Call" and c.facts.callee(x) in ("panic", "runtime.Goexit") for x in inside)
    for x in inside if not leaves else ():
        if x.kind == "Defer":
            yield x, "defer-in-infinite-loop"


def one_name(c: Context, n: Node | None):
    return c.facts.decl(n) if n is not None and bare(n).kind == "Ident" else None


@rule("channel-used-after-close", "cfg", "correctness", "a local channel is sent to or closed after it has been closed", "Block Clause")
def channel_used_after_close(c: Context, n: Node):
    closed: set[int] = set()
    for s in n.body:
        for x in s.walk(stop=("FuncLit", "Go", "Defer")):
            own = one_name(c, x.chan) if x.kind == "Send" else one_name(c, x.args[0]) if called(c, x, "close") and len(x.args) == 1 else None
            if own is not None and id(own) in closed:
                yield x, "channel-used-after-close"
        if s.kind == "ExprStmt" and called(c, s.x, "close") and len(s.x.args) == 1 and (own := one_name(c, s.x.args[0])) is not None and own.kind == "var" and own.function is not None:
            closed.add(id(own))
        elif s.kind == "Assign":
            closed -= {id(one_name(c, x)) for x in s.left}


def state_rule(rule_id: str, summary: str, presets: str, types: tuple[str, ...], ending: tuple[str, ...], allowed: tuple[str, ...] = ()):
    """A rule that finds operations on a local value, in the statements behind the one that ends its use, of one block."""

    @rule(rule_id, "cfg", presets, summary, "Block Clause")
    def run(c: Context, n: Node):
        ended: set[int] = set()
        for s in n.body:
            if s.kind != "Defer":
                for x in s.walk(stop=("FuncLit", "Go", "Defer")):
                    if x.kind == "Selector" and id(one_name(c, x.x)) in ended and x.name.name not in allowed and c.parent(x).kind == "Call" and c.parent(x).fun is x:
                        yield c.parent(x), rule_id
            call = s.x if s.kind == "ExprStmt" else s.right[0] if s.kind == "Assign" and len(s.right) == 1 else None
            if call is not None and call.kind == "Call" and call.fun.kind == "Selector" and call.fun.name.name in ending:
                own = one_name(c, call.fun.x)
                if own is not None and own.function is not None and (c.facts.type_of(call.fun.x) or "").lstrip("*") in types:
                    ended.add(id(own))
            if s.kind == "Assign":
                ended -= {id(one_name(c, x)) for x in s.left}

    return run


state_rule("resource-used-after-close", "a closed file or connection is used", "suspicious", ("os.File", "net.Conn", "net.Listener", "database/sql.Rows", "compress/gzip.Writer"), ("Close",), ("Close", "Name", "Err", "LocalAddr", "RemoteAddr", "Addr"))
state_rule("sql-transaction-used-after-completion", "a transaction is used after commit or rollback", "correctness", ("database/sql.Tx",), ("Commit", "Rollback"), ("Rollback",))


@rule("dangerous-remove-all", "ssa", "suspicious", "a whole user or system directory is removed", "Call")
def dangerous_remove_all(c: Context, n: Node):
    if called(c, n, "os.RemoveAll") and len(n.args) == 1:
        x = bare(n.args[0])
        own = one_name(c, x)
        if own is not None:
            writes = sum(1 for y in c.tree.root.walk() if y.kind == "Assign" for z in y.left if one_name(c, z) is own)
            x = own.value if own.kind == "var" and own.index == 0 and writes <= 1 else None
        if x is not None and called(c, bare(x), "os.TempDir", "os.UserCacheDir", "os.UserConfigDir", "os.UserHomeDir"):
            yield n, "dangerous-remove-all"


@rule("finalizer-captures-object", "ssa", "correctness", "a finalizer holds on to what it finalizes", "Call")
def finalizer_captures_object(c: Context, n: Node):
    if called(c, n, "runtime.SetFinalizer") and len(n.args) == 2 and n.args[1].kind == "FuncLit":
        own = one_name(c, n.args[0])
        if own is not None and any(x.kind == "Ident" and c.facts.decl(x) is own for x in n.args[1].body.walk()):
            yield n.args[1], "finalizer-captures-object"


@rule("typed-nil-error-return", "ssa", "suspicious", "a nil pointer is returned as an error that isn't nil", "Return")
def typed_nil_error_return(c: Context, n: Node):
    fun = c.function(n)
    if fun is None:
        return
    results = c.facts._listed(fun.type.results)
    if len(n.values) != len(results):
        return
    for x, t in zip(n.values, results, strict=True):
        own = one_name(c, x)
        if t == "error" and own is not None and own.kind == "var" and own.function is fun and own.value is None and (c.facts.declared_type(own) or "").startswith("*"):
            if not any(y.kind == "Assign" and any(one_name(c, z) is own for z in y.left) or y.kind == "Unary" and y.word == "&" and one_name(c, y.x) is own for y in fun.body.walk()):
                yield x, "typed-nil-error-return"


@rule("overwritten-error", "ssa", "suspicious", "an error is overwritten before anything has looked at it", "Block Clause")
def overwritten_error(c: Context, n: Node):
    pending: dict[int, Node] = {}
    for s in n.body:
        plain = s.kind == "Assign" and s.word in ("=", ":=")
        reads = [x for part in (s.right if plain else [s]) for x in part.walk() if x.kind == "Ident"]
        reads += [x for y in (s.left if plain else []) if bare(y).kind != "Ident" for x in y.walk() if x.kind == "Ident"]
        for x in reads:
            pending.pop(id(c.facts.decl(x)), None)
        if not plain:
            if s.kind not in ("ExprStmt", "IncDec", "Send"):
                pending.clear()
            continue
        types = [t for y in s.right for t in c.facts.types_of(y)]
        for i, x in enumerate(s.left):
            own = one_name(c, x)
            if own is None or own.function is None or own.kind != "var" or len(types) != len(s.left) or types[i] != "error":
                continue
            if id(own) in pending:
                yield pending[id(own)], "overwritten-error"
            captured = any(y.kind == "Ident" and c.facts.decl(y) is own and c.function(y) is not own.function for y in own.function.walk())
            if not captured and any(y.kind == "Call" for y in s.right):
                pending[id(own)] = x
            else:
                pending.pop(id(own), None)
