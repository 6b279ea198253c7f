"""Rules about calls of the standard library and of builtins."""

from __future__ import annotations

import re

from tessera.gorules.registry import Context, rule
from tessera.goparse.syntax import Node


def called(c: Context, n: Node, *names: str) -> bool:
    return n.kind == "Call" and c.facts.callee(n) in names


def whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def bare(n: Node) -> Node:
    while n.kind == "Paren":
        n = n.x
    return n


# -- policies


def policy(rule_id: str, summary: str, symbols: set[str], presets: str = "restriction"):
    @rule(rule_id, "types", presets, summary, "Call", include_tests=False)
    def run(c: Context, n: Node):
        if c.facts.callee(n) in symbols:
            yield n.fun, rule_id

    return run


policy("direct-panic", "panic is called", {"panic"})
policy("process-exit", "the process is ended from library code", {"os.Exit", "log.Fatal", "log.Fatalf", "log.Fatalln"})
policy("context-background", "root work is begun with context.Background", {"context.Background"})
policy("context-todo", "a placeholder context is left", {"context.TODO"})

# The exported names of the deprecated package.
IOUTIL = frozenset("Discard NopCloser ReadAll ReadDir ReadFile TempDir TempFile WriteFile".split())


@rule("deprecated-ioutil", "types", "migration", "a name of io/ioutil is used", "Selector")
def deprecated_ioutil(c: Context, n: Node):
    name = c.facts.symbol(n) or ""
    if name.startswith("io/ioutil.") and name.rpartition(".")[2] in IOUTIL:
        yield n, "deprecated-ioutil"


# -- constant arguments


@rule("zero-replace-count", "types", "correctness", "Replace with a count of zero replaces nothing", "Call")
def zero_replace_count(c: Context, n: Node):
    if called(c, n, "strings.Replace", "bytes.Replace") and len(n.args) == 4 and whole(c.facts.constant(n.args[3])) and c.facts.constant(n.args[3]) == 0:
        yield n.args[3], "zero-replace-count"


# The methods with a limit.
FIND_ALL = tuple(f"(regexp.Regexp).FindAll{a}{b}{d}" for a in ("", "String") for b in ("", "Submatch") for d in ("", "Index"))


@rule("zero-regexp-match-limit", "types", "correctness", "FindAll with a limit of zero finds nothing", "Call")
def zero_regexp_match_limit(c: Context, n: Node):
    if called(c, n, *FIND_ALL) and len(n.args) == 2 and whole(c.facts.constant(n.args[1])) and c.facts.constant(n.args[1]) == 0:
        yield n.args[1], "zero-regexp-match-limit"


_FOREIGN = re.compile(r"\(\?(?:=|!|<=|<!|>|#|\()|\\[1-9]|[*+?}]\+|\\[kgGKRXZhHuN]")
MOST_REPEATS = 1000


def pattern_error(pattern: str) -> bool:
    """Whether a pattern isn't one of the linear-time syntax: no look-around, references, possessive or atomic groups, repeats up to 1000."""
    plain = re.sub(r"\\Q.*?(?:\\E|$)", "", pattern, flags=re.S)
    escaped = re.sub(r"\\\\", "", plain)
    if _FOREIGN.search(escaped) or any(int(x) > MOST_REPEATS for m in re.finditer(r"\{(\d+)(?:,(\d*))?\}", escaped) for x in m.groups() if x):
        return True
    # What only the linear-time syntax has is put into terms that the checker knows.
    plain = re.sub(r"\\[pP](?:\{\^?\w+\}|[A-Z])", "x", plain)
    plain = re.sub(r"\[\[:\^?\w+:\]\]", "[x]", plain)
    plain = re.sub(r"\[:\^?\w+:\]", "x", plain)
    plain = re.sub(r"\(\?P?<(\w+)>", "(", plain)
    plain = re.sub(r"\\z", r"\\Z", plain)
    plain = re.sub(r"\\x\{[0-9a-fA-F]+\}|\\C", "x", plain)
    plain = re.sub(r"\(\?([imsU]*)(?:-[imsU]+)?(:|\))", lambda m: "(?:" if m[2] == ":" else "", plain)
    try:
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(plain)
    except (re.error, RecursionError, OverflowError):
        return True
    return False


COMPILES = tuple(f"regexp.{x}" for x in "Compile MustCompile Match MatchReader MatchString CompilePOSIX MustCompilePOSIX".split())


@rule("invalid-regexp", "types", "correctness", "a constant regular expression can't be compiled", "Call")
def invalid_regexp(c: Context, n: Node):
    if called(c, n, *COMPILES) and n.args:
        pattern = c.facts.constant(n.args[0])
        if isinstance(pattern, str) and len(pattern) <= 4096 and pattern_error(pattern):
            yield n.args[0], "invalid-regexp"


def strconv_bounds(name: str) -> dict[int, tuple[str, object]]:
    """For arguments by place: the key of the finding, and a test that holds for allowed values."""
    base, base0 = ("base", lambda v: 2 <= v <= 36), ("base", lambda v: v == 0 or 2 <= v <= 36)
    bits, floats, complexes = ("bit-size", lambda v: 0 <= v <= 64), ("bit-size", lambda v: v in (32, 64)), ("bit-size", lambda v: v in (64, 128))
    form = ("format", lambda v: v in map(ord, "beEfgGxX"))
    return {
        "ParseInt": {1: base0, 2: bits}, "ParseUint": {1: base0, 2: bits}, "ParseFloat": {1: floats}, "ParseComplex": {1: complexes}, "FormatInt": {1: base}, "FormatUint": {1: base},
        "AppendInt": {2: base}, "AppendUint": {2: base}, "FormatFloat": {1: form, 3: floats}, "AppendFloat": {2: form, 4: floats}, "FormatComplex": {1: form, 3: complexes},
    }.get(name, {})


@rule("invalid-strconv-argument", "types", "correctness", "a constant argument is outside what strconv allows", "Call")
def invalid_strconv_argument(c: Context, n: Node):
    path, _, name = (c.facts.callee(n) or "").rpartition(".")
    if path == "strconv":
        for at, (key, allowed) in strconv_bounds(name).items():
            value = c.facts.constant(n.args[at]) if at < len(n.args) else None
            if whole(value) and not allowed(value):
                yield n.args[at], key


RANDOM = {*(f"math/rand.{x}" for x in "Intn Int31n Int63n".split()), *(f"math/rand/v2.{x}" for x in "N IntN Int32N Int64N UintN Uint32N Uint64N".split())}


@rule("invalid-random-bound", "types", "correctness", "a random bound panics or always gives zero", "Call")
def invalid_random_bound(c: Context, n: Node):
    if c.facts.callee(n) in RANDOM and len(n.args) == 1:
        value = c.facts.constant(n.args[0])
        if whole(value) and value <= 1:
            yield n.args[0], "constant-result" if value == 1 else "nonpositive"


@rule("time-duration-unit", "types", "suspicious", "a duration is a bare number", "Call")
def time_duration_unit(c: Context, n: Node):
    if called(c, n, *(f"time.{x}" for x in "Sleep After NewTimer NewTicker Tick AfterFunc".split())) and n.args:
        x = bare(n.args[0])
        x = bare(x.x) if x.kind == "Unary" and x.word in "+-" else x
        if x.kind == "Literal" and x.word == "int" and c.facts.constant(x) != 0:
            yield n.args[0], "time-duration-unit"


@rule("uncatchable-signal", "types", "correctness", "a signal is asked for that no process can catch", "Call")
def uncatchable_signal(c: Context, n: Node):
    first = {"os/signal.Ignore": 0, "os/signal.Reset": 0, "os/signal.Notify": 1, "os/signal.NotifyContext": 1}.get(c.facts.callee(n))
    for x in n.args[first:] if first is not None else ():
        y = bare(x)
        while y.kind == "Call" and len(y.args) == 1 and c.facts.is_type(y.fun):
            y = bare(y.args[0])
        if c.facts.symbol(y) in ("os.Kill", "syscall.SIGKILL", "syscall.SIGSTOP"):
            yield x, "uncatchable-signal"


MODES = {"os.OpenFile": 2, "os.Mkdir": 1, "os.MkdirAll": 1, "os.Chmod": 1, "os.WriteFile": 2, "io/ioutil.WriteFile": 2, "os.FileMode": 0, "io/fs.FileMode": 0}


@rule("non-octal-file-mode", "types", "suspicious", "a file mode looks octal and is decimal", "Call")
def non_octal_file_mode(c: Context, n: Node):
    name = c.facts.callee(n) or (f"{c.facts.type_string(n.fun)}" if c.facts.is_type(n.fun) else None)
    at = MODES.get(name)
    if at is None and c.facts.type_of(n.fun.x if n.fun.kind == "Selector" else None) == "*os.File" and n.fun.name.name == "Chmod":
        at = 0
    if at is not None and at < len(n.args):
        x = bare(n.args[at])
        if x.kind == "Literal" and re.fullmatch("[1-7][0-7][0-7]", x.value):
            yield x, "non-octal-file-mode", ("use-octal-file-mode", "suggestion", ((x.start, x.start, "0o"),))


@rule("time-layout", "types", "correctness", "a time layout puts the day before the month of an ISO date", "Call")
def time_layout(c: Context, n: Node):
    at = {"time.Parse": 0, "time.ParseInLocation": 0, "(time.Time).Format": 0, "(time.Time).AppendFormat": 1}.get(c.facts.callee(n))
    if at is not None and at < len(n.args) and isinstance(layout := c.facts.constant(n.args[at]), str) and "2006-02-01" in layout:
        x = bare(n.args[at])
        if x.kind == "Literal":
            yield x, "time-layout", ("correct-reference-layout", "suggestion", ((x.start, x.end, x.value.replace("2006-02-01", "2006-01-02")),))
        else:
            yield x, "time-layout"


# -- shapes of calls


@rule("append-no-values", "types", "correctness", "append is called without values", "Call")
def append_no_values(c: Context, n: Node):
    if called(c, n, "append") and len(n.args) == 1:
        yield n, "append-no-values"


@rule("nil-context", "types", "correctness", "nil is passed for a context", "Call", include_tests=False)
def nil_context(c: Context, n: Node):
    first = {"context.WithCancel", "context.WithTimeout", "context.WithDeadline", "context.WithValue", "net/http.NewRequestWithContext", "os/exec.CommandContext", "os/signal.NotifyContext"}
    places = {0} if c.facts.callee(n) in first else set()
    own = c.facts.signature(n)
    if own is not None:
        at = 0
        for f in own.params:
            for _ in range(max(1, len(f.names))):
                if c.facts.type_string(f.type) == "context.Context":
                    places |= set(range(at, len(n.args))) if f.variadic else {at}
                at += 1
    for at in sorted(places):
        if at < len(n.args) and n.args[at].kind == "Ident" and c.facts.symbol(n.args[at]) == "nil":
            yield n.args[at], "nil-context"


@rule("errors-is-arguments", "types", "suspicious", "errors.Is is given its arguments the wrong way round", "Call")
def errors_is_arguments(c: Context, n: Node):
    def sentinel(x: Node) -> bool:
        x = bare(x)
        return x.kind == "Selector" and x.x.kind == "Ident" and x.x.name in c.facts.imports and id(x.x) not in c.facts.uses and x.name.name[:1].isupper()

    if called(c, n, "errors.Is") and len(n.args) == 2 and sentinel(n.args[0]) and not sentinel(n.args[1]):
        yield n, "errors-is-arguments"


@rule("errors-as-target", "types", "correctness", "errors.As is given no pointer to an error type", "Call")
def errors_as_target(c: Context, n: Node):
    if called(c, n, "errors.As") and len(n.args) == 2:
        t = c.facts.type_of(n.args[1])
        inner = c.facts.underlying(t[1:]) if t and t[0] == "*" else None
        if t and (t[0] != "*" and t not in ("any",) and not t.startswith("interface") or inner in ("int", "string", "bool", "float64")):
            yield n.args[1], "errors-as-target"


@rule("regexp-compile-in-loop", "types", "performance", "a constant pattern is compiled in every turn of a loop", "For RangeStmt")
def regexp_compile_in_loop(c: Context, n: Node):
    def look(x: Node):
        if x.kind in ("For", "RangeStmt"):
            return
        if x.kind == "FuncLit" and not (c.parent(x).kind == "Call" and c.parent(x).fun is x):
            return
        if called(c, x, "regexp.Match", "regexp.MatchReader", "regexp.MatchString") and isinstance(c.facts.constant(x.args[0]) if x.args else None, str):
            yield x, "regexp-compile-in-loop"
        for k in x.kids():
            yield from look(k)

    for x in (n.get("cond"), n.get("post"), n.body):
        if x is not None:
            yield from look(x)


@rule("exec-pipe-run", "types", "correctness", "Run is called on a command whose pipe has been taken", "Block")
def exec_pipe_run(c: Context, n: Node):
    marked: set[int] = set()

    def command(x: Node | None):
        return c.facts.decl(x) if x is not None and bare(x).kind == "Ident" else None

    for s in n.body:
        for x in s.walk(stop=("FuncLit", "Block")):
            if x.kind == "Call" and x.fun.kind == "Selector" and (own := command(x.fun.x)) is not None:
                name = c.facts.callee(x)
                if name in ("(os/exec.Cmd).StdoutPipe", "(os/exec.Cmd).StderrPipe"):
                    marked.add(id(own))
                elif name == "(os/exec.Cmd).Run" and id(own) in marked:
                    yield x, "exec-pipe-run"
        if s.kind == "Assign":
            for x in s.left:
                if (own := command(x)) is not None and not any(called(c, y, "(os/exec.Cmd).StdoutPipe", "(os/exec.Cmd).StderrPipe") for y in s.right):
                    marked.discard(id(own))


@rule("deferred-time-since", "types", "correctness", "time.Since is worked out when a call is deferred, not when it runs", "Defer")
def deferred_time_since(c: Context, n: Node):
    if n.call.kind == "Call":
        for a in n.call.args:
            for x in a.walk(stop=("FuncLit",)):
                if called(c, x, "time.Since"):
                    yield x, "deferred-time-since"


@rule("deferred-function-not-called", "types", "suspicious", "a deferred call returns a function that nobody calls", "Defer")
def deferred_function_not_called(c: Context, n: Node):
    found = c.facts.types_of(n.call) if n.call.kind == "Call" else [None]
    if len(found) == 1 and ((c.facts.underlying(found[0]) or "").startswith("func(") or found[0] == "context.CancelFunc"):
        yield n.call, "deferred-function-not-called"


def lock_call(c: Context, n: Node | None):
    """(receiver's code, method) of a call of Lock or RLock."""
    if n is not None and n.kind == "Call" and not n.args and n.fun.kind == "Selector" and n.fun.name.name in ("Lock", "RLock"):
        t = (c.facts.type_of(n.fun.x) or "").lstrip("*")
        embeds = c.facts.struct(t)
        if t in ("sync.Mutex", "sync.RWMutex", "sync.Locker") or embeds is not None and any(not f.names and (c.facts.type_string(f.type) or "").lstrip("*") in ("sync.Mutex", "sync.RWMutex") for f in embeds.fields):
            return c.shape(n.fun.x), n.fun.name.name
    return None


@rule("deferred-lock", "types", "correctness", "a lock is taken and its taking, not its release, is deferred", "Block Clause")
def deferred_lock(c: Context, n: Node):
    for a, b in zip(n.body, n.body[1:], strict=False):
        if a.kind == "ExprStmt" and b.kind == "Defer" and (first := lock_call(c, a.x)) and lock_call(c, b.call) == first:
            yield b.call, "deferred-lock"


# What makes a value of its arguments and does nothing else.
PURE = {
    "errors.New", "fmt.Append", "fmt.Appendf", "fmt.Appendln", "fmt.Errorf", "fmt.Sprint", "fmt.Sprintf", "fmt.Sprintln", "slices.Clip", "slices.Compact", "slices.Delete", "slices.Grow", "slices.Insert", "slices.Replace", "sort.Reverse",
    "context.WithCancel", "context.WithDeadline", "context.WithTimeout", "context.WithValue", "maps.All", "maps.Keys", "maps.Values", "slices.All", "slices.Collect", "slices.Sorted", "slices.Values",
}


@rule("unused-result", "types", "correctness", "the result of a call without other effects is dropped", "ExprStmt")
def unused_result(c: Context, n: Node):
    if n.x.kind == "Call" and (c.facts.callee(n.x) in PURE or c.facts.callee(n.x) in ("(error).Error", "(time.Time).String", "(net/url.URL).String", "(bytes.Buffer).String", "(strings.Builder).String") and not n.x.args):
        yield n.x, "unused-result"


# Calls whose error result is always nil, or is told otherwise.
INFALLIBLE = ("(bytes.Buffer).", "(strings.Builder).", "fmt.Print", "fmt.Fprint", "(hash.")
FINALIZERS = {f"({t}).{m}" for t, m in (("bufio.Writer", "Flush"), ("compress/gzip.Writer", "Close"), ("archive/tar.Writer", "Close"), ("archive/zip.Writer", "Close"), ("compress/gzip.Writer", "Flush"), ("archive/tar.Writer", "Flush"))}


@rule("discarded-error", "types", "suspicious", "a call's error is dropped", "ExprStmt", include_tests=False)
def discarded_error(c: Context, n: Node):
    if n.x.kind == "Call":
        name = c.facts.callee(n.x) or ""
        if "error" in c.facts.types_of(n.x) and name not in FINALIZERS and name not in PURE and not name.startswith(INFALLIBLE):
            yield n.x, "discarded-error"


@rule("blank-error-discard", "types", "restriction", "an error is assigned to the blank name", "Assign ValueSpec", include_tests=False)
def blank_error_discard(c: Context, n: Node):
    left, right = (n.left, n.right) if n.kind == "Assign" else (n.names, n.values)
    if not right or n.kind == "Assign" and n.word not in ("=", ":="):
        return
    found = [t for x in right for t in c.facts.types_of(x)] if len(right) == len(left) or len(right) == 1 else []
    for i, x in enumerate(left):
        if x.kind == "Ident" and x.name == "_" and len(found) == len(left) and found[i] == "error":
            source = right[i] if len(right) == len(left) else right[0]
            name = (c.facts.callee(source) or "") if source.kind == "Call" else ""
            if name not in FINALIZERS and not name.startswith(INFALLIBLE):
                yield x, "blank-error-discard"


@rule("unchecked-writer-error", "types", "correctness", "the error of a buffered writer's end is dropped", "ExprStmt Defer Assign")
def unchecked_writer_error(c: Context, n: Node):
    x = n.x if n.kind == "ExprStmt" else n.call if n.kind == "Defer" else n.right[0] if len(n.left) == len(n.right) == 1 and n.left[0].kind == "Ident" and n.left[0].name == "_" else None
    if x is not None and x.kind == "Call" and c.facts.callee(x) in FINALIZERS:
        yield x, "unchecked-writer-error"


@rule("ignored-append-result", "types", "suspicious", "the result of append is thrown away", "Assign")
def ignored_append_result(c: Context, n: Node):
    if len(n.left) == len(n.right):
        for x, y in zip(n.left, n.right, strict=True):
            if x.kind == "Ident" and x.name == "_" and called(c, bare(y), "append"):
                yield y, "ignored-append-result"


@rule("atomic-update-assignment", "types", "correctness", "the result of an atomic update is assigned back", "Assign")
def atomic_update_assignment(c: Context, n: Node):
    if len(n.left) != len(n.right) or n.word not in ("=", ":="):
        return
    for x, y in zip(n.left, n.right, strict=True):
        name = (c.facts.callee(y) or "") if y.kind == "Call" else ""
        if re.fullmatch(r"sync/atomic\.Add(?:Int32|Int64|Uint32|Uint64|Uintptr)", name) and len(y.args) == 2:
            a = y.args[0]
            if a.kind == "Unary" and a.word == "&" and c.shape(a.x) == c.shape(x) or x.kind == "Star" and c.shape(x.x) == c.shape(a):
                yield n, "atomic-update-assignment"


@rule("unbuffered-signal-channel", "types", "correctness", "signals are sent to a channel without a buffer", "Call")
def unbuffered_signal_channel(c: Context, n: Node):
    if called(c, n, "os/signal.Notify") and n.args:
        x = bare(n.args[0])
        own = c.facts.decl(x) if x.kind == "Ident" else None
        made = own.value if own is not None and own.of == 1 and own.kind == "var" else x
        if made is not None and called(c, made, "make") and len(made.args) == 1:
            yield x, "unbuffered-signal-channel", ("buffer-signal-channel", "suggestion", ((made.args[0].end, made.args[0].end, ", 1"),))


@rule("time-since", "types", "pedantic", "time.Now().Sub can be time.Since", "Call")
def time_since(c: Context, n: Node):
    if n.fun.kind == "Selector" and n.fun.name.name == "Sub" and called(c, n.fun.x, "time.Now") and len(n.args) == 1:
        yield n, "time-since", ("use-time-since", "suggestion", ((n.fun.start, n.fun.end, f"{c.text(n.fun.x.fun.x)}.Since"),))


@rule("time-until", "types", "pedantic", "Sub(time.Now()) can be time.Until", "Call")
def time_until(c: Context, n: Node):
    if called(c, n, "(time.Time).Sub") and len(n.args) == 1 and called(c, n.args[0], "time.Now") and not called(c, n.fun.x, "time.Now"):
        now = n.args[0]
        yield n, "time-until", ("use-time-until", "suggestion", ((n.start, n.end, f"{c.text(now.fun.x)}.Until({c.text(n.fun.x)})"),))


@rule("unnecessary-format", "types", "pedantic", "a format call has a constant format without directives", "Call")
def unnecessary_format(c: Context, n: Node):
    if called(c, n, "fmt.Sprintf") and len(n.args) == 1 and not n.spread and isinstance(f := c.facts.constant(n.args[0]), str) and "%" not in f:
        lost = c.tree.has_comment(n.start, n.args[0].start) or c.tree.has_comment(n.args[0].end, n.end)
        yield (n, "unnecessary-format") if lost else (n, "unnecessary-format", ("use-format-operand", "suggestion", ((n.start, n.end, c.text(n.args[0])),)))


@rule("unnecessary-sprintf", "types", "pedantic", "Sprintf gives back a string as it is", "Call")
def unnecessary_sprintf(c: Context, n: Node):
    if called(c, n, "fmt.Sprintf") and len(n.args) == 2 and not n.spread and c.facts.constant(n.args[0]) == "%s":
        t = c.facts.type_of(n.args[1])
        if c.facts.underlying(t) in ("string", "untyped string", "[]uint8"):
            text = c.text(n.args[1])
            yield n, "unnecessary-sprintf", ("replace-unnecessary-sprintf", "suggestion", ((n.start, n.end, text if t in ("string", "untyped string") else f"string({text})"),))


@rule("inefficient-io-string-write", "types", "performance", "bytes are turned into a string to be written", "Call")
def inefficient_io_string_write(c: Context, n: Node):
    if called(c, n, "io.WriteString") and len(n.args) == 2:
        x = bare(n.args[1])
        if called(c, x, "string") and len(x.args) == 1 and c.facts.underlying(c.facts.type_of(x.args[0])) == "[]uint8":
            yield n, "inefficient-io-string-write"


@rule("ineffective-url-query-mutation", "types", "correctness", "a query's copy is changed and dropped", "Call")
def ineffective_url_query_mutation(c: Context, n: Node):
    if n.fun.kind == "Selector" and n.fun.name.name in ("Add", "Set", "Del") and called(c, bare(n.fun.x), "(net/url.URL).Query"):
        yield n, "ineffective-url-query-mutation"


@rule("http-canonical-header-key", "types", "suspicious", "a header map is indexed by a key that isn't canonical", "Index")
def http_canonical_header_key(c: Context, n: Node):
    if c.facts.type_of(n.x) == "net/http.Header" and len(n.args) == 1 and isinstance(key := c.facts.constant(n.args[0]), str):
        valid = bool(re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", key))
        if valid and "-".join(x[:1].upper() + x[1:].lower() for x in key.split("-")) != key:
            yield n.args[0], "http-canonical-header-key"


@rule("net-ip-bytes-equal", "types", "correctness", "addresses are compared as bytes", "Call")
def net_ip_bytes_equal(c: Context, n: Node):
    if called(c, n, "bytes.Equal") and len(n.args) == 2 and all(c.facts.type_of(a) == "net.IP" for a in n.args):
        a, b = n.args
        yield n, "net-ip-bytes-equal", ("use-net-ip-equal", "suggestion", ((n.start, n.end, f"{c.text(a)}.Equal({c.text(b)})"),))


@rule("non-slice-sort", "types", "correctness", "what is sorted is no slice", "Call")
def non_slice_sort(c: Context, n: Node):
    if called(c, n, "sort.Slice", "sort.SliceStable", "sort.SliceIsSorted") and n.args:
        t = c.facts.underlying(c.facts.type_of(n.args[0]))
        if t and not t.startswith("[]") and t not in ("any", "untyped nil") and not t.startswith("interface"):
            yield n.args[0], "non-slice-sort"


@rule("invalid-unmarshal-target", "types", "correctness", "what is unmarshalled into is no pointer", "Call")
def invalid_unmarshal_target(c: Context, n: Node):
    at = {"encoding/json.Unmarshal": 1, "encoding/xml.Unmarshal": 1, "(encoding/json.Decoder).Decode": 0, "(encoding/xml.Decoder).Decode": 0, "(encoding/gob.Decoder).Decode": 0}.get(c.facts.callee(n))
    if at is not None and at < len(n.args):
        t = c.facts.underlying(c.facts.type_of(n.args[at]))
        if t and t[0] != "*" and t not in ("any", "untyped nil") and not t.startswith("interface"):
            yield n.args[at], "invalid-unmarshal-target"


@rule("sync-pool-non-pointer", "types", "performance", "a pool is given values that it must copy", "Call")
def sync_pool_non_pointer(c: Context, n: Node):
    if called(c, n, "(sync.Pool).Put") and len(n.args) == 1:
        t = c.facts.underlying(c.facts.type_of(n.args[0]))
        if t and t[0] != "*" and not t.startswith(("map[", "chan", "func(", "interface", "any", "untyped nil", "<-chan")):
            yield n.args[0], "sync-pool-non-pointer"


@rule("context-key", "types", "suspicious", "a context key has a predeclared type", "Call")
def context_key(c: Context, n: Node):
    if called(c, n, "context.WithValue") and len(n.args) == 3:
        t = c.facts.type_of(n.args[1]) or ""
        if t.removeprefix("untyped ") in ("string", "int", "bool", "rune", "float", "int32", "int64", "uint8", "float64"):
            yield n.args[1], "context-key"


@rule("unsafe-host-port", "types", "correctness", "an address is formatted in a way that breaks IPv6 hosts", "Call")
def unsafe_host_port(c: Context, n: Node):
    at = {"net.Dial": 1, "net.DialTimeout": 1, "net.Listen": 1, "(net.Dialer).Dial": 1, "(net.Dialer).DialContext": 2}.get(c.facts.callee(n))
    if at is not None and at < len(n.args):
        x = bare(n.args[at])
        own = c.facts.decl(x) if x.kind == "Ident" else None
        x = own.value if own is not None and own.of == 1 and own.value is not None else x
        if called(c, x, "fmt.Sprintf") and len(x.args) == 3 and c.facts.constant(x.args[0]) in ("%s:%d", "%s:%s"):
            yield x, "unsafe-host-port"


@rule("http-response-before-error", "types", "correctness", "a response is used before its error is looked at", "Block Clause")
def http_response_before_error(c: Context, n: Node):
    for a, b in zip(n.body, n.body[1:], strict=False):
        if a.kind == "Assign" and len(a.left) == 2 and len(a.right) == 1 and c.facts.types_of(a.right[0]) == ["*net/http.Response", "error"] and a.left[0].kind == "Ident" and b.kind == "Defer":
            own = c.facts.decl(a.left[0])
            if own is not None and any(x.kind == "Ident" and c.facts.decl(x) is own for x in b.walk()):
                yield b, "http-response-before-error"


@rule("defer-before-error-check", "types", "suspicious", "clean-up is deferred before the error of what is cleaned is looked at", "Block Clause")
def defer_before_error_check(c: Context, n: Node):
    for a, b, d in zip(n.body, n.body[1:], n.body[2:], strict=False):
        if a.kind == "Assign" and len(a.left) == 2 and len(a.right) == 1 and all(x.kind == "Ident" for x in a.left) and b.kind == "Defer" and d.kind == "If" and b.call.kind == "Call" and b.call.fun.kind == "Selector":
            value, error = map(c.facts.decl, a.left)
            types = c.facts.types_of(a.right[0])
            if len(types) == 2 and types[1] == "error" and types[0] != "*net/http.Response" and error is not None and bare(b.call.fun.x).kind == "Ident" and c.facts.decl(b.call.fun.x) is value is not None and any(x.kind == "Ident" and c.facts.decl(x) is error for x in d.cond.walk()):
                yield b, "defer-before-error-check"


@rule("testing-goroutine-call", "types", "correctness", "a test is ended from another goroutine", "Go")
def testing_goroutine_call(c: Context, n: Node):
    if n.call.kind == "Call" and n.call.fun.kind == "FuncLit":
        for x in n.call.fun.body.walk(stop=("FuncLit",)):
            if x.kind == "Call" and re.fullmatch(r"\(testing\.(?:T|B|F|TB)\)\.(?:FailNow|Fatalf?|SkipNow|Skipf?)", c.facts.callee(x) or ""):
                yield x, "testing-goroutine-call"


@rule("waitgroup-misuse", "types", "correctness", "WaitGroup.Add is called within the goroutine that it counts", "Go")
def waitgroup_misuse(c: Context, n: Node):
    if n.call.kind != "Call":
        return
    fun = n.call.fun
    own = c.facts.decl(fun) if fun.kind == "Ident" else None
    todo, seen = [fun.body if fun.kind == "FuncLit" else own.value.body if own is not None and own.kind == "func" else None], set()
    while todo:  # the function and, through calls within the file, its helpers
        body = todo.pop()
        if body is None or id(body) in seen or len(seen) > 16:
            continue
        seen.add(id(body))
        for x in body.walk(stop=("FuncLit",)):
            if x.kind != "Call":
                continue
            value = c.facts.constant(x.args[0]) if len(x.args) == 1 else None
            if called(c, x, "(sync.WaitGroup).Add") and not (whole(value) and value <= 0):
                yield x, "waitgroup-misuse"
            helper = c.facts.decl(x.fun) if x.fun.kind == "Ident" else None
            if helper is not None and helper.kind == "func":
                todo.append(helper.value.body)


@rule("invalid-slog-arguments", "types", "correctness", "a log call's keys and values don't pair", "Call")
def invalid_slog_arguments(c: Context, n: Node):
    m = re.fullmatch(r"(?:log/slog\.|\(log/slog\.Logger\)\.)(Debug|Info|Warn|Error|With|DebugContext|InfoContext|WarnContext|ErrorContext)", c.facts.callee(n) or "")
    if not m or n.spread:
        return
    at = 0 if m[1] == "With" else 2 if m[1].endswith("Context") else 1
    while at < len(n.args):
        t = c.facts.type_of(n.args[at])
        if t == "log/slog.Attr" or n.args[at].kind == "Call" and (c.facts.callee(n.args[at]) or "").startswith("log/slog."):
            at += 1
            continue
        if t is None:
            return
        if t not in ("string", "untyped string"):
            yield n.args[at], "no-key"
            return
        if at + 1 >= len(n.args):
            yield n.args[at], "no-value"
        at += 2


# Printing functions, with the place of their format.
PRINTF = {"fmt.Printf": 0, "fmt.Sprintf": 0, "fmt.Errorf": 0, "fmt.Fprintf": 1, "fmt.Appendf": 1, "log.Printf": 0, "log.Fatalf": 0, "log.Panicf": 0, "(testing.T).Errorf": 0, "(testing.T).Fatalf": 0, "(testing.T).Logf": 0, "(testing.T).Skipf": 0}
_VERB = re.compile(r"%([-+# 0]*)(\[\d+\])?(\*|\d+)?(?:\.(\[\d+\])?(\*|\d*))?(\[\d+\])?(.|$)", re.S)
INTEGERS = "int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr".split()
ACCEPTS = {"d": "int", "b": "int float complex", "o": "int", "O": "int", "c": "int", "U": "int", "e": "float complex", "E": "float complex", "f": "float complex", "F": "float complex", "g": "float complex", "G": "float complex", "t": "bool", "q": "int string", "s": "string", "x": "int float complex string", "X": "int float complex string"}


def group(t: str | None) -> str | None:
    t = (t or "").removeprefix("untyped ")
    return "int" if t in INTEGERS or t in ("int", "rune") else "float" if t in ("float", "float32", "float64") else "complex" if t.startswith("complex") else t if t in ("bool", "string") else None


@rule("printf-arguments", "types", "correctness", "a format and its arguments don't go together", "Call")
def printf_arguments(c: Context, n: Node):
    at = PRINTF.get(c.facts.callee(n))
    if at is None or at >= len(n.args) or n.spread:
        return
    form = c.facts.constant(n.args[at])
    if not isinstance(form, str):
        t = c.facts.type_of(n.args[at])
        if len(n.args) == at + 1 and t == "string" and bare(n.args[at]).kind in ("Ident", "Call", "Selector"):
            yield n.args[at], "non-constant-format", ("insert-string-format", "suggestion", ((n.args[at].start, n.args[at].start, '"%s", '),))
        return
    values, used, indexed = n.args[at + 1 :], 0, False
    for m in _VERB.finditer(form):
        verb = m[7]
        if verb == "%" and not m[3]:
            continue
        if verb == "":
            yield n, "bad-format"
            return
        if m[2] or m[4] or m[6]:
            indexed = True
            continue
        used += (m[3] == "*") + (m[5] == "*")
        if not (verb in ACCEPTS or verb in "vTpw"):
            yield n, "unknown-verb"
            return
        if verb == "w" and c.facts.callee(n) != "fmt.Errorf":
            yield n, "wrap-verb"
            return
        if used < len(values) and verb in ACCEPTS:
            kind = group(c.facts.type_of(values[used]))
            if kind and kind not in ACCEPTS[verb].split():
                yield values[used], "wrong-type"
        used += 1
    if not indexed and used > len(values):
        yield n, "missing-argument"
    elif not indexed and used < len(values):
        yield values[used], "extra-argument"
