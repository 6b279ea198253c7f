"""Rules about expressions, comparisons, conversions and assignments."""

from __future__ import annotations

from tessera.gorules.calls import bare, called, whole
from tessera.gorules.registry import Context, rule
from tessera.goparse.facts import SIZES, folded
from tessera.goparse.syntax import Node

MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}
ORDERED = ("<", "<=", ">", ">=")


def operands(n: Node, word: str) -> list[Node]:
    """The operands of a chain of one operator, in order."""
    n = bare(n)
    return [*operands(n.x, word), *operands(n.y, word)] if n.kind == "Binary" and n.word == word else [n]


def against(c: Context, n: Node):
    """(operand, operator, constant) of a comparison with a constant, which is put on the right; None otherwise."""
    n = bare(n)
    if n.kind != "Binary" or n.word not in MIRROR:
        return None
    a, b = c.facts.constant(n.x), c.facts.constant(n.y)
    if (a is None) == (b is None):
        return None
    return (n.x, n.word, b) if a is None else (n.y, MIRROR[n.word], a)


def is_nil(c: Context, n: Node) -> bool:
    return bare(n).kind == "Ident" and c.facts.symbol(bare(n)) == "nil"


@rule("bad-bit-mask", "types", "correctness", "a masked value is compared with what it can't be", "Binary")
def bad_bit_mask(c: Context, n: Node):
    found = against(c, n)
    if found is None or found[1] not in ("==", "!=") or not whole(found[2]):
        return
    x, _, value = bare(found[0]), found[1], found[2]
    if x.kind == "Binary" and x.word in ("&", "|"):
        masks = [m for m in (c.facts.constant(x.x), c.facts.constant(x.y)) if whole(m)]
        if len(masks) == 1 and (value & ~masks[0] if x.word == "&" else masks[0] & ~value):
            yield n, "bad-bit-mask"


def limits(t: str | None) -> tuple[int, int] | None:
    bits = SIZES.get(t)
    if bits is None:
        return None
    return (0, 2**bits - 1) if t[0] == "u" or t == "byte" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


@rule("impossible-comparison", "types", "correctness", "a comparison with the end of a type's range is always the same", "Binary")
def impossible_comparison(c: Context, n: Node):
    found = against(c, n)
    if found is None or found[1] not in ORDERED or not whole(found[2]):
        return
    x, word, value = found
    own = limits(c.facts.underlying(c.facts.type_of(x)))
    if own and (word in ("<", ">=") and value == own[0] or word in (">", "<=") and value == own[1]):
        yield n, "impossible-comparison"


@rule("contradictory-condition", "types", "correctness", "a chain of comparisons is always true or always false", "Binary")
def contradictory_condition(c: Context, n: Node):
    above = c.parent(n)
    while above is not None and above.kind == "Paren":
        above = c.parent(above)
    if n.word not in ("&&", "||") or above is not None and above.kind == "Binary" and above.word == n.word:
        return
    wanted, seen = "==" if n.word == "&&" else "!=", {}
    for x in operands(n, n.word):
        found = against(c, x)
        if found and found[1] == wanted and c.pure(found[0]):
            other = seen.setdefault(c.shape(found[0]), found[2])
            if other != found[2]:
                yield n, "always-false" if wanted == "==" else "always-true"
                return


@rule("redundant-bool-comparison", "types", "style", "a truth value is compared with a constant", "Binary")
def redundant_bool_comparison(c: Context, n: Node):
    if n.word not in ("==", "!="):
        return
    for x, y in ((n.x, n.y), (n.y, n.x)):
        value = c.facts.constant(y)
        if isinstance(value, bool) and bare(y).kind == "Ident" and c.facts.constant(x) is None and (c.facts.underlying(c.facts.type_of(x)) or "").removeprefix("untyped ") == "bool":
            plain = (n.word == "==") == value
            text = c.text(x)
            text = text if plain else f"!{text}" if bare(x).kind in ("Ident", "Selector", "Call", "Index") else f"!({text})"
            fix = () if c.tree.has_comment(n.start, n.end) else (("simplify-comparison", "safe", ((n.start, n.end, text),)),)
            yield (n, "redundant-bool-comparison", *fix)
            return


@rule("nan-comparison", "types", "correctness", "a value is compared with NaN, which equals nothing", "Binary")
def nan_comparison(c: Context, n: Node):
    if n.word in ("==", "!=") and (called(c, bare(n.x), "math.NaN") or called(c, bare(n.y), "math.NaN")):
        yield n, "nan-comparison"


@rule("nil-function-comparison", "types", "correctness", "a declared function is compared with nil", "Binary")
def nil_function_comparison(c: Context, n: Node):
    if n.word in ("==", "!="):
        for x, y in ((n.x, n.y), (n.y, n.x)):
            own = c.facts.decl(x) if bare(x).kind == "Ident" else None
            if is_nil(c, y) and own is not None and own.kind == "func":
                yield n, "nil-function-comparison"


@rule("impossible-interface-nil-comparison", "types", "correctness", "a conversion of a concrete value to an interface is compared with nil", "Binary")
def impossible_interface_nil_comparison(c: Context, n: Node):
    if n.word in ("==", "!="):
        for x, y in ((n.x, n.y), (n.y, n.x)):
            x = bare(x)
            if is_nil(c, y) and x.kind == "Call" and len(x.args) == 1 and c.facts.is_type(x.fun):
                to, source = c.facts.underlying(c.facts.type_string(x.fun)), c.facts.underlying(c.facts.type_of(x.args[0]))
                if to and (to in ("any", "error") or to.startswith("interface")) and source and source not in ("any", "error", "untyped nil") and not source.startswith("interface"):
                    yield n, "impossible-interface-nil-comparison"


@rule("inefficient-string-comparison", "types", "pedantic", "strings are put into one case only to be compared", "Binary")
def inefficient_string_comparison(c: Context, n: Node):
    if n.word in ("==", "!="):
        a, b = bare(n.x), bare(n.y)
        for name in ("strings.ToLower", "strings.ToUpper"):
            if called(c, a, name) and called(c, b, name) and c.pure(a.args[0]) and c.pure(b.args[0]) and not c.same(a.args[0], b.args[0]):
                yield n, "inefficient-string-comparison"


@rule("redundant-nil-check", "types", "pedantic", "a nil check is implied by the check of the length", "Binary")
def redundant_nil_check(c: Context, n: Node):
    if n.word not in ("&&", "||"):
        return
    for first, second in ((n.x, n.y), (n.y, n.x)):
        a, b = bare(first), bare(second)
        if a.kind != "Binary" or a.word != ("!=" if n.word == "&&" else "==") or not (is_nil(c, a.y) or is_nil(c, a.x)):
            continue
        x = a.x if is_nil(c, a.y) else a.y
        found = against(c, b)
        if found is None or not called(c, bare(found[0]), "len") or not c.pure(x) or not c.same(bare(found[0]).args[0], x) or not whole(found[2]):
            continue
        t = c.facts.underlying(c.facts.type_of(x)) or ""
        if not t.startswith(("[]", "map[", "chan")):
            continue
        word, value = found[1], found[2]
        implied = (word == ">" and value >= 0 or word == ">=" and value > 0 or word == "==" and value > 0 or word == "!=" and value == 0) if n.word == "&&" else (word == "==" and value == 0)
        if implied:
            fix = () if c.tree.has_comment(n.start, n.end) else (("remove-redundant-nil-check", "safe", ((n.start, n.end, c.text(second)),)),)
            yield (first, "redundant-nil-check", *fix)
            return


@rule("oversized-shift", "types", "correctness", "a shift is as wide as the value or wider", "Binary Assign")
def oversized_shift(c: Context, n: Node):
    if n.kind == "Assign" and (n.word not in ("<<=", ">>=") or len(n.left) != 1) or n.kind == "Binary" and n.word not in ("<<", ">>"):
        return
    x, y = (n.left[0], n.right[0]) if n.kind == "Assign" else (n.x, n.y)
    bits, by = SIZES.get(c.facts.underlying(c.facts.type_of(x))), c.facts.constant(y)
    if bits and whole(by) and by >= bits and c.facts.constant(x) is None:
        yield n, "oversized-shift"


@rule("integer-division-before-conversion", "types", "suspicious", "a quotient is cut to an integer before it becomes a float", "Call")
def integer_division_before_conversion(c: Context, n: Node):
    if len(n.args) == 1 and c.facts.symbol(n.fun) in ("float32", "float64"):
        x = bare(n.args[0])
        if x.kind == "Binary" and x.word == "/" and c.facts.underlying(c.facts.type_of(x)) in SIZES and c.facts.constant(x) is None:
            yield n, "integer-division-before-conversion"


@rule("suspicious-string-conversion", "types", "suspicious", "a number becomes the character of that code", "Call")
def suspicious_string_conversion(c: Context, n: Node):
    if len(n.args) == 1 and c.facts.symbol(n.fun) == "string" and bare(n.args[0]).kind != "Literal":
        t = c.facts.underlying(c.facts.type_of(n.args[0]))
        if t in SIZES and t not in ("int32", "uint8", "rune", "byte") and c.facts.constant(n.args[0]) is None:
            x = n.args[0]
            yield n, "suspicious-string-conversion", ("convert-single-rune", "suggestion", ((x.start, x.start, "rune("), (x.end, x.end, ")")))


@rule("unnecessary-conversion", "types", "pedantic", "a value is converted to the type that it has", "Call")
def unnecessary_conversion(c: Context, n: Node):
    if len(n.args) == 1 and not n.spread and c.facts.is_type(n.fun):
        to, t = c.facts.type_string(n.fun), c.facts.type_of(n.args[0])
        if to and t == to and c.facts.constant(n.args[0]) is None:
            x = n.args[0]
            text = c.text(x) if bare(x).kind in ("Ident", "Selector", "Call", "Index") else f"({c.text(x)})"
            yield n, "unnecessary-conversion", ("remove-unnecessary-conversion", "suggestion", ((n.start, n.end, text),))


@rule("buffer-string-conversion", "types", "pedantic", "a buffer's content is converted though the buffer gives it", "Call")
def buffer_string_conversion(c: Context, n: Node):
    if len(n.args) != 1:
        return
    x = bare(n.args[0])
    if c.facts.symbol(n.fun) == "string" and called(c, x, "(bytes.Buffer).Bytes"):
        yield n, "use-string"
    elif c.facts.is_type(n.fun) and c.facts.type_string(n.fun) == "[]uint8" and called(c, x, "(bytes.Buffer).String"):
        yield n, "use-bytes"


@rule("string-range-rune-conversion", "types", "performance", "a string is turned into runes only to be ranged over", "RangeStmt")
def string_range_rune_conversion(c: Context, n: Node):
    x = bare(n.x)
    unused = not n.left or n.left[0].kind == "Ident" and n.left[0].name == "_"
    if unused and x.kind == "Call" and len(x.args) == 1 and c.facts.is_type(x.fun) and c.facts.type_string(x.fun) == "[]int32" and c.facts.underlying(c.facts.type_of(x.args[0])) in ("string", "untyped string"):
        yield x, "string-range-rune-conversion"


@rule("self-assignment", "types", "correctness", "a value is assigned to itself", "Assign")
def self_assignment(c: Context, n: Node):
    if n.word == "=" and len(n.left) == len(n.right):
        for x, y in zip(n.left, n.right, strict=True):
            if not (x.kind == "Ident" and x.name == "_") and c.pure(x) and c.same(x, y) and not (c.facts.type_of(x.x) or "x").startswith("map[") if x.kind == "Index" else not (x.kind == "Ident" and x.name == "_") and c.pure(x) and c.same(x, y):
                fix = (("remove-self-assignment", "suggestion", ((n.start, n.end, ""),)),) if len(n.left) == 1 else ()
                yield (n, "self-assignment", *fix)


@rule("almost-swapped", "types", "suspicious", "two assignments in a row fail to swap values", "Block Clause")
def almost_swapped(c: Context, n: Node):
    for a, b in zip(n.body, n.body[1:], strict=False):
        if all(s.kind == "Assign" and s.word == "=" and len(s.left) == len(s.right) == 1 for s in (a, b)):
            if all(x.kind in ("Ident", "Selector", "Index", "Star") and c.pure(x) for x in (a.left[0], a.right[0])) and c.same(a.left[0], b.right[0]) and c.same(a.right[0], b.left[0]) and not c.same(a.left[0], a.right[0]):
                yield (a.start, b.end), "almost-swapped"


@rule("manual-min-max", "types", "pedantic", "an if does what min or max does", "If")
def manual_min_max(c: Context, n: Node):
    if n.init is not None or n.other is not None or len(n.body.body) != 1:
        return
    s, cond = n.body.body[0], bare(n.cond)
    if s.kind == "Assign" and s.word == "=" and len(s.left) == len(s.right) == 1 and cond.kind == "Binary" and cond.word in ORDERED and all(bare(x).kind == "Ident" for x in (cond.x, cond.y, s.left[0], s.right[0])):
        x, y = s.left[0], s.right[0]
        if c.facts.type_of(x) in SIZES and c.facts.type_of(x) == c.facts.type_of(y) and (c.same(x, bare(cond.x)) and c.same(y, bare(cond.y)) or c.same(x, bare(cond.y)) and c.same(y, bare(cond.x))) and not c.tree.has_comment(n.start, n.end):
            yield n, "manual-min-max"


@rule("subsumed-condition", "types", "suspicious", "an else-if is covered by the branch before it", "If")
def subsumed_condition(c: Context, n: Node):
    after = n.other
    if after is None or after.kind != "If" or n.init is not None or after.init is not None:
        return
    one, two = against(c, n.cond), against(c, after.cond)
    if one and two and one[1] in ORDERED and two[1] in (*ORDERED, "==") and c.pure(one[0]) and c.same(one[0], two[0]) and whole(one[2]) and whole(two[2]):
        (_, w, a), (_, v, b) = one, two
        up, low = w in (">", ">="), w in ("<", "<=")
        edge = a + (w == ">") - (w == "<")  # the last integer that the first branch takes
        if up and (v in (">", ">=") and b + (v == ">") >= edge or v == "==" and b >= edge) or low and (v in ("<", "<=") and b - (v == "<") <= edge or v == "==" and b <= edge):
            yield after.cond, "subsumed-condition"


@rule("needless-blank-identifier", "types", "pedantic", "a blank name discards what is discarded anyway", "RangeStmt Assign")
def needless_blank_identifier(c: Context, n: Node):
    blank = lambda x: x.kind == "Ident" and x.name == "_"
    if n.kind == "RangeStmt":
        if n.left and blank(n.left[-1]):
            if all(map(blank, n.left)):
                yield n.left[0], "needless-blank-identifier", ("remove-blank-identifier", "suggestion", ((n.left[0].start, c.tree.source.index(b"range", n.left[-1].end), ""),))
            elif len(n.left) == 2:
                yield n.left[1], "needless-blank-identifier", ("remove-blank-identifier", "suggestion", ((n.left[0].end, n.left[1].end, ""),))
    elif len(n.right) == 1 and bare(n.right[0]).kind == "Unary" and bare(n.right[0]).word == "<-":
        if n.word == "=" and all(map(blank, n.left)):
            yield n.left[0], "needless-blank-identifier", ("remove-blank-identifier", "suggestion", ((n.start, n.right[0].start, ""),))
        elif len(n.left) == 2 and blank(n.left[1]) and not blank(n.left[0]):
            yield n.left[1], "needless-blank-identifier", ("remove-blank-identifier", "suggestion", ((n.left[0].end, n.left[1].end, ""),))


@rule("redundant-type-declaration", "types", "pedantic", "a variable's type is that of its value", "ValueSpec")
def redundant_type_declaration(c: Context, n: Node):
    if n.type is not None and len(n.names) == len(n.values) == 1 and c.parent(n).word == "var":
        to, t = c.facts.type_string(n.type), c.facts.type_of(n.values[0])
        default = {"untyped int": "int", "untyped float": "float64", "untyped string": "string", "untyped rune": "int32", "untyped bool": "bool"}.get(t, t)
        if to and default == to and not (t or "").startswith("untyped nil"):
            fix = () if c.tree.has_comment(n.start, n.end) else (("remove-redundant-type", "safe", ((n.names[0].end, n.type.end, ""),)),)
            yield (n.type, "redundant-type-declaration", *fix)


@rule("redundant-closure", "types", "pedantic", "a closure only passes its parameters on", "FuncLit")
def redundant_closure(c: Context, n: Node):
    above = c.parent(n)
    if above is not None and above.kind == "Call" and above.fun is n or len(n.body.body) != 1 or c.tree.has_comment(n.start, n.end):
        return
    s = n.body.body[0]
    call = s.values[0] if s.kind == "Return" and len(s.values) == 1 else s.x if s.kind == "ExprStmt" and not n.type.results else None
    if call is None or call.kind != "Call" or call.fun.kind != "Ident" and not (c.facts.symbol(call.fun) or "(").startswith(tuple("abcdefghijklmnopqrstuvwxyz")):
        return
    own = c.facts.decl(call.fun) if call.fun.kind == "Ident" else None
    names = [x.name for f in n.type.params for x in f.names]
    variadic = bool(n.type.params and n.type.params[-1].variadic)
    known = own is not None and own.kind == "func" and c.facts.type_string(own.type) == c.facts.type_string(n.type) or own is None and call.fun.kind == "Selector" and call.fun.x.name in c.facts.imports
    if known and names and variadic == call.spread and [x.name if x.kind == "Ident" else None for x in call.args] == names:
        yield n, "redundant-closure"


@rule("suspicious-range", "types", "suspicious", "a range value's copy is written to", "RangeStmt")
def suspicious_range(c: Context, n: Node):
    if n.word != ":=" or len(n.left) != 2 or n.left[1].kind != "Ident":
        return
    own = c.facts.decl(n.left[1])
    t = c.facts.underlying(c.facts.type_of(n.left[1])) or ""
    if own is None or not t.startswith("struct{") and not (t[:1] == "[" and t[1:2] != "]"):
        return
    writes, reads = [], False
    for x in n.body.walk():
        if x.kind in ("Assign", "IncDec"):
            for y in x.left if x.kind == "Assign" else [x.x]:
                base = y
                while base.kind in ("Selector", "Index", "Paren"):
                    base = base.x
                if base is not y and base.kind == "Ident" and c.facts.decl(base) is own:
                    writes.append((y, base))
    roots = {id(b) for _, b in writes}
    reads = any(x.kind == "Ident" and c.facts.decl(x) is own and id(x) not in roots for x in n.body.walk())
    for y, _ in writes if not reads else ():
        yield y, "suspicious-range"


@rule("nil-map-write", "types", "correctness", "a map that is still nil is written to", "Block")
def nil_map_write(c: Context, n: Node):
    nil: dict[int, object] = {}
    for s in n.body:
        if s.kind == "DeclStmt" and s.decl.word == "var":
            for spec in s.decl.specs:
                if spec.type is not None and not spec.values and (c.facts.underlying(c.facts.type_string(spec.type)) or "").startswith("map["):
                    nil.update((id(c.facts.decl(x)), x) for x in spec.names)
            continue
        if s.kind == "Assign":
            for x in s.left:
                if x.kind == "Index" and bare(x.x).kind == "Ident" and id(c.facts.decl(x.x)) in nil:
                    yield x, "nil-map-write"
        elif s.kind == "IncDec" and s.x.kind == "Index" and bare(s.x.x).kind == "Ident" and id(c.facts.decl(s.x.x)) in nil:
            yield s.x, "nil-map-write"
        # Whatever else names the map in a way that may set it ends what is known.
        for x in s.walk():
            if x.kind == "Assign":
                nil = {k: v for k, v in nil.items() if not any(y.kind == "Ident" and id(c.facts.decl(y)) == k for y in x.left)}
            elif x.kind == "Unary" and x.word == "&" and bare(x.x).kind == "Ident":
                nil.pop(id(c.facts.decl(x.x)), None)
            elif x.kind == "FuncLit":
                used = {id(c.facts.decl(y)) for y in x.walk() if y.kind == "Ident"}
                nil = {k: v for k, v in nil.items() if k not in used}


@rule("invalid-binary-write", "types", "correctness", "binary.Write is given a value without a fixed size", "Call")
def invalid_binary_write(c: Context, n: Node):
    def unfixed(t: str | None, depth: int = 0) -> bool:
        t = c.facts.underlying((t or "").lstrip("*")) or ""
        if t in ("int", "uint", "string", "untyped string", "untyped int", "uintptr") or t.startswith(("map[", "chan", "func(")):
            return True
        if t[:1] == "[" and depth < 8:
            inner = t[t.index("]") + 1 :]
            return inner.startswith("[]") or unfixed(inner, depth + 1)
        return False

    if called(c, n, "encoding/binary.Write") and len(n.args) == 3:
        t = c.facts.type_of(n.args[2])
        inside = c.facts.struct(t)
        if unfixed(t) or inside is not None and any(unfixed(c.facts.type_string(f.type)) or (c.facts.type_string(f.type) or "").startswith("[]") for f in inside.fields):
            yield n.args[2], "invalid-binary-write"


@rule("copied-lock", "types", "correctness", "a value that holds a lock is copied", "Assign FuncType RangeStmt Return Call")
def copied_lock(c: Context, n: Node):
    def locks(t: str | None, depth: int = 0) -> bool:
        if not t or depth > 8 or t[0] == "*":
            return False
        if t in ("sync.Mutex", "sync.RWMutex", "sync.WaitGroup", "sync.Once", "sync.Cond", "sync.Pool", "sync.Map"):
            return True
        if t[0] == "[" and t[1:2] != "]":
            return locks(t[t.index("]") + 1 :], depth + 1)
        inside = c.facts.struct(t)
        return inside is not None and any(locks(c.facts.type_string(f.type), depth + 1) for f in inside.fields)

    def copies(x: Node) -> bool:
        return bare(x).kind in ("Ident", "Selector", "Star", "Index") and locks(c.facts.type_of(x))

    if n.kind == "Assign" and len(n.left) == len(n.right):
        for x, y in zip(n.left, n.right, strict=True):
            if copies(y) and not (x.kind == "Ident" and x.name == "_"):
                yield y, "assigned"
    elif n.kind == "FuncType":
        for f in n.params:
            if locks(c.facts.type_string(f.type)):
                yield f, "parameter"
    elif n.kind == "RangeStmt" and len(n.left) == 2 and n.left[1].kind == "Ident" and locks(c.facts.type_of(n.left[1])):
        yield n.left[1], "range"
    elif n.kind == "Return":
        yield from ((x, "returned") for x in n.values if copies(x))
    elif n.kind == "Call" and not c.facts.is_type(n.fun) and c.facts.symbol(n.fun) not in ("len", "cap", "new", "make"):
        yield from ((x, "argument") for x in n.args if copies(x))


@rule("loop-capture", "types", "correctness", "a closure outlives a variable that every turn of a loop sets anew", "For RangeStmt")
def loop_capture(c: Context, n: Node):
    # Variables that the loop declares are each turn's own; those it reuses are declared before it.
    reused = [x for x in (n.left if n.kind == "RangeStmt" and n.word == "=" else n.init.left if n.kind == "For" and n.init is not None and n.init.kind == "Assign" and n.init.word == "=" else []) if x.kind == "Ident"]
    owns = {id(c.facts.decl(x)) for x in reused if c.facts.decl(x) is not None}
    for s in n.body.walk() if owns else ():
        if s.kind in ("Go", "Defer") and s.call.kind == "Call" and s.call.fun.kind == "FuncLit":
            for x in s.call.fun.body.walk():
                if x.kind == "Ident" and id(c.facts.decl(x)) in owns:
                    yield x, "loop-capture"


def always(c: Context, n: Node):
    """The value of a condition of constants; None if it has another part."""
    n = bare(n)
    if n.kind == "Binary":
        return folded(n.word, always(c, n.x), always(c, n.y))
    return c.facts.constant(n)


@rule("impossible-type-assertion", "types", "correctness", "no value has both interfaces: a method differs", "TypeAssert TypeSwitch")
def impossible_type_assertion(c: Context, n: Node):
    def methods(t: str | None) -> dict[str, str | None]:
        own = c.facts.package.get(t[1:]) if t and t[0] == "@" else None
        if own is None or own.type is None or own.type.kind != "InterfaceType":
            return {}
        return {f.names[0].name: c.facts.type_string(f.type) for f in own.type.elems if f.names}

    def differ(x: Node, to: Node) -> bool:
        a, b = methods(c.facts.type_of(x)), methods(c.facts.type_string(to))
        return any(a[k] and b[k] and a[k] != b[k] for k in a.keys() & b.keys())

    if n.kind == "TypeAssert":
        if n.type is not None and differ(n.x, n.type):
            yield n, "impossible-type-assertion"
    else:
        guard = n.assign.right[0] if n.assign.kind == "Assign" else n.assign.x
        yield from ((case, "impossible-type-assertion") for clause in n.clauses for case in clause.cases if differ(guard.x, case))
