"""Rules about what declarations are expected to look like."""

from __future__ import annotations

import re
from collections import Counter

from tessera.gorules.registry import Context, rule
from tessera.gorules.structure import arity
from tessera.goparse.syntax import Node

# Methods that other packages look for, with their parameters and results.
STANDARD = {
    "Format": ("fmt.State,int32", ""), "GobDecode": ("[]uint8", "error"), "GobEncode": ("", "[]uint8,error"), "MarshalJSON": ("", "[]uint8,error"), "MarshalXML": ("*encoding/xml.Encoder,encoding/xml.StartElement", "error"),
    "ReadByte": ("", "uint8,error"), "ReadFrom": ("io.Reader", "int64,error"), "ReadRune": ("", "int32,int,error"), "Scan": ("fmt.ScanState,int32", "error"), "Seek": ("int64,int", "int64,error"), "UnmarshalJSON": ("[]uint8", "error"),
    "UnmarshalXML": ("*encoding/xml.Decoder,encoding/xml.StartElement", "error"), "UnreadByte": ("", "error"), "UnreadRune": ("", "error"), "WriteByte": ("uint8", "error"), "WriteTo": ("io.Writer", "int64,error"),
}
#: Names that mean the interface only where the first type is the expected one.
ONLY_WITH = {"Format": 0, "Scan": 0, "MarshalXML": 0, "UnmarshalXML": 0, "ReadFrom": 0, "WriteTo": 0, "Seek": 0}


@rule("standard-method-signature", "types", "correctness", "a method has a known name and another signature", "FuncDecl")
def standard_method_signature(c: Context, n: Node):
    if not n.receiver or n.name.name not in STANDARD:
        return
    params, results = (",".join(c.facts._listed(x)) for x in (n.type.params, n.type.results))
    want = STANDARD[n.name.name]
    if n.name.name in ONLY_WITH and params.split(",")[0] != want[0].split(",")[0]:
        return
    if (params, results) != want:
        yield n.name, "standard-method-signature"


@rule("invalid-test-signature", "types", "correctness", "a test function has another signature than the tool runs", "FuncDecl")
def invalid_test_signature(c: Context, n: Node):
    if not c.is_test or n.receiver:
        return
    for prefix, kind in (("Test", "T"), ("Benchmark", "B"), ("Fuzz", "F")):
        rest = n.name.name.removeprefix(prefix)
        if n.name.name.startswith(prefix) and not (prefix == "Test" and rest == "Main"):
            types = c.facts._listed(n.type.params)
            if rest[:1].islower():
                if types == [f"*testing.{kind}"]:
                    yield n.name, "malformed-name"
            elif types != [f"*testing.{kind}"] or n.type.results or n.type_params:
                yield n.name, "wrong-signature"
    if n.name.name.startswith("Example"):
        if n.type.params or n.type.results:
            yield n.name, "wrong-signature"
        else:
            suffix = n.name.name.removeprefix("Example").rpartition("_")[2] if "_" in n.name.name else ""
            if suffix[:1].isupper() and n.name.name.count("_") >= 2:
                yield n.name, "malformed-name"


def tag_error(text: str) -> str | None:
    """What is wrong with a tag's grammar: key:"value" pairs with single spaces between them."""
    while text:
        m = re.match(r'([^\x00-\x20:"\x7f]+):("(?:\\.|[^"\\])*")', text)
        if not m:
            return "malformed-tag"
        text = text[m.end() :]
        if text and text[0] != " ":
            return "malformed-tag"
        if text and (text[1:2] in (" ", "") or not text.strip()):
            return "malformed-tag"
        text = text[1:]
    return None


@rule("invalid-struct-tag", "types", "correctness", "a field's tag is malformed, repeats a name or stands on a field that nobody sees", "StructType")
def invalid_struct_tag(c: Context, n: Node):
    seen: dict[tuple[str, str], Node] = {}
    for f in n.fields:
        if f.tag is None:
            continue
        text = c.facts.constant(f.tag)
        if not isinstance(text, str):
            continue
        if error := tag_error(text):
            yield f.tag, error
            continue
        for key, value in re.findall(r'([^\s:"]+):"((?:\\.|[^"\\])*)"', text):
            name = value.split(",")[0]
            if key in ("json", "xml") and name not in ("", "-"):
                if f.names and not f.names[0].name[:1].isupper():
                    yield f.tag, "unexported-field"
                elif (key, name) in seen:
                    yield f.tag, "repeated-name"
                else:
                    seen[key, name] = f


def receivers(c: Context) -> dict[str, list[tuple[Node, str | None, bool]]]:
    """For each type, its methods in order: receiver, its name, whether it is a pointer."""
    out: dict[str, list[tuple[Node, str | None, bool]]] = {}
    for d in c.tree.root.decls:
        if d.kind == "FuncDecl" and d.receiver:
            r = d.receiver[0]
            base = c.facts.base_name(r.type)
            if base:
                out.setdefault(base, []).append((r, r.names[0].name if r.names else None, r.type.kind == "Star"))
    return out


@rule("inconsistent-receiver-name", "types", "pedantic", "methods of one type call their receiver by different names", "File")
def inconsistent_receiver_name(c: Context, n: Node):
    for own in receivers(c).values():
        names = [(r, name) for r, name, _ in own if name not in (None, "_")]
        counts = Counter(name for _, name in names)
        if len(counts) > 1:
            usual = max(counts, key=counts.get)  # of equal ones the first seen
            yield from ((r.names[0], "inconsistent-receiver-name") for r, name in names if name != usual)


@rule("mixed-receiver-type", "types", "pedantic", "some methods of a type have pointer receivers and some don't", "File")
def mixed_receiver_type(c: Context, n: Node):
    for own in receivers(c).values():
        pointers = sum(p for _, _, p in own)
        if 0 < pointers < len(own):
            usual = own[0][2] if 2 * pointers == len(own) else 2 * pointers > len(own)
            yield from ((r, "mixed-receiver-type") for r, _, p in own if p != usual)


@rule("ineffective-value-receiver-assignment", "types", "suspicious", "a field of a receiver's copy is set and lost", "FuncDecl")
def ineffective_value_receiver_assignment(c: Context, n: Node):
    if not n.receiver or not n.receiver[0].names or n.receiver[0].type.kind == "Star" or n.body is None:
        return
    own = c.facts.decl(n.receiver[0].names[0])
    if own is None or c.facts.struct(c.facts.type_string(n.receiver[0].type)) is None:
        return
    writes: list[tuple[Node, Node]] = []
    for x in n.body.walk():
        for y in x.left if x.kind == "Assign" else [x.x] if x.kind == "IncDec" else []:
            if y.kind == "Selector" and y.x.kind == "Ident" and c.facts.decl(y.x) is own:
                writes.append((y, y.x))
    last = max((y.start for y, _ in writes), default=0)
    roots = {id(b) for _, b in writes}
    if not any(x.kind == "Ident" and c.facts.decl(x) is own and id(x) not in roots and x.start > last for x in n.body.walk()):
        yield from ((y, "ineffective-value-receiver-assignment") for y, _ in writes)


def parameters(n: Node) -> int:
    return arity(n.params)
