"""The Go scanner, directives and suppressions, and their relations."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.goparse.directives import kind_of, suppressions
from tessera.goparse.scanner import rebuilt, scan
from tessera.sources import gofiles

SOURCE = """// Code generated by x. DO NOT EDIT.
package sample

import "fmt" // why

func run(a, b int) (x float64) {
\tif a &^= 3; b <- c { return }
\treturn 0x1p-2 + 1_000i * .5e3 + 'é' + "q\\"" + `raw
line`
}
"""


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text(max_size=60).map(str.encode), st.lists(st.sampled_from(["func", " ", "\n", "\r\n", "/*", "*/", "//x", '"', "`", "'", "1", ".", "0x", "ä", "{", ")", "\\", "﻿", "<<", "="]), max_size=30).map(lambda x: "".join(x).encode())))
def test_pieces_put_together_are_the_file(data):
    pieces, _ = scan(data)
    assert rebuilt(pieces) == data
    at = 0
    for p in pieces:
        assert p.start == at and p.end >= at
        at = p.end
    assert at == len(data)


def test_tokens_and_semicolons():
    pieces, errors = scan(SOURCE.encode())
    assert not errors
    kinds = [(p.kind, p.text) for p in pieces if p.kind not in ("space", "newline")]
    assert ("float", "0x1p-2") in kinds and ("imag", "1_000i") in kinds and ("float", ".5e3") in kinds and ("rune", "'é'") in kinds and ("operator", "&^=") in kinds
    assert kinds[1:5] == [("keyword", "package"), ("ident", "sample"), ("semicolon", ""), ("keyword", "import")]
    assert kinds[5:8] == [("string", '"fmt"'), ("semicolon", ""), ("line_comment", "// why")]
    assert sum(p.inserted for p in pieces) == 5 and ("string", "`raw\nline`") in kinds
    assert scan(b"x \xff")[1] and scan(b"a\0")[1] and scan(b"return")[0][-1].inserted and not scan(b"")[0]


def test_directive_kinds():
    wanted = {"//go:build linux": "build-constraint", "// +build x": "build-constraint", "//go:generate x": "go-generate", "//go:embed a": "go-embed", "//go:noinline": "compiler", "//line x:1": "line", "/*line x:1*/": "line", "// Code generated by y DO NOT EDIT.": "generated", "//nolint:all": "external-suppression", "//tessera:ignore a -- b": "suppression", "// prose": None}
    assert {c: kind_of(c) for c in wanted} == wanted


def read(text, **options):
    data = text.encode()
    return suppressions(scan(data)[0], len(data), **options)


def test_suppressions_and_problems():
    text = "//tessera:ignore-file r1 -- all\npackage x\n//tessera:ignore r2 -- expires=2026-01-01 why\nvar ä = 1\nvar b = 2 //tessera:ignore-line r3\n//tessera:ignore-start r4 -- s\nvar c = 3\n//tessera:ignore-end r4\n"
    found, problems = read(text)
    assert not problems
    data = text.encode()
    assert [(s.scope, s.rule_id, data[s.target_start : s.target_end].decode()) for s in found] == [("file", "r1", text), ("next-line", "r2", "var ä = 1"), ("line", "r3", "var b = 2 //tessera:ignore-line r3"), ("range", "r4", "\nvar c = 3\n")]
    assert (found[1].reason, found[1].expires_on) == ("why", "2026-01-01")
    bad = "package x\n//tessera:ignore-file r\n//tessera:ignore\n//tessera:what r\n//tessera:ignore a b\n//tessera:ignore r -- expires=2026-02-30 x\n//tessera:ignore-end r\n//tessera:ignore-start r\n//tessera:ignore-start r\n//tessera:ignore zz\n"
    found, problems = read(bad, known={"r", "a"})
    assert not found and [p.kind for p in problems] == ["misplaced-file-scope", "malformed", "malformed", "malformed", "invalid-expiry", "unmatched-range-end", "unclosed-range", "nested-range", "unknown-rule"]
    assert [p.kind for p in read("//tessera:ignore r -- expires=2026-01-01 x\n", today="2026-01-01")[1]] == ["expired"]
    assert [p.kind for p in read("//tessera:ignore r\n", need_reason=True)[1]] == ["missing-reason"]


def test_relations(spark, tmp_path):
    for name, text in (("a.go", SOURCE), ("vendor/b.go", "package b\n"), ("sub/testdata/c.go", "package c\n"), ("sub/d.go", "//tessera:ignore-file r -- x\npackage d\n"), ("sub/e.txt", "no"), ("sub/empty.go", "")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = gofiles.discover(spark, str(tmp_path)).persist()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in files.collect()) == ["a.go", "d.go"]
    assert gofiles.discover(spark, str(tmp_path), fixtures=True).count() == 3
    rows = gofiles.pieces(files).orderBy("path", "ord").collect()
    assert "".join(r.text for r in rows if r.path.endswith("a.go")) == SOURCE
    assert [r.kind for r in gofiles.directives(files).orderBy("path").collect()] == ["generated", "suppression"]
    assert [(r.scope, r.rule_id, r.target_start) for r in gofiles.waivers(files).collect()] == [("file", "r", 0)]
