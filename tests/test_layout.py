"""Documents of groups and lines, and the layout of Go files."""

import pytest

from tessera.goparse.scanner import rebuilt, scan
from tessera.layout import doc
from tessera.layout.doc import HARD, SOFT, SPACE, Boundary, BreakParent, IfBreak, Suffix, Text, Verbatim, concat, group, indent, joined, render
from tessera.layout.go import checked, fragment, kept, laid_out, owned
from tessera.plans.gocases import cases


def call(*args):
    return group("f(", indent(SOFT, joined(concat(",", SPACE), args), IfBreak(Text(","), doc.NOTHING)), SOFT, ")")


def test_groups_break_where_they_do_not_fit():
    assert render(call("a", "b"), 10) == "f(a, b)"
    assert render(call("aaaa", "bbbb"), 10) == "f(\n\taaaa,\n\tbbbb,\n)"
    inner = call("xx", "yy")
    assert render(call(inner, "b"), 14) == "f(\n\tf(xx, yy),\n\tb,\n)"
    assert render(call(inner, "b"), 8, 4) == "f(\n\tf(\n\t\txx,\n\t\tyy,\n\t),\n\tb,\n)"


def test_what_follows_counts():
    assert render(concat(group("a", SPACE, "b"), "cccc"), 6) == "a\nbcccc"
    assert render(concat(group("a", SPACE, "b"), HARD, "cccc"), 6) == "a b\ncccc"


def test_forced_breaks():
    assert render(group("a", SPACE, BreakParent(), "b")) == "a\nb"
    assert render(group("a", SPACE, group("b", HARD, "c"))) == "a\nb\nc"
    assert render(group("a", SPACE, Verbatim("`x\n y`"))) == "a\n`x\n y`"


def test_suffixes_wait_for_the_line_end():
    assert render(concat("a", Suffix(" // x"), ",", HARD, "b")) == "a, // x\nb"
    assert render(concat("a", Suffix(" // x"), Boundary(), "b")) == "a // x\nb"
    assert render(concat("a", Boundary(), "b", Suffix(" // y"))) == "ab // y"


def test_no_white_space_at_line_ends():
    assert render(indent("a", HARD, HARD, "b")) == "a\n\n\tb"


UNEVEN = """package   p
import(
"fmt"
  x   "io"
)



type T[K comparable] struct{
a,b int `json:"a"`  // of it
m map[string][]  *T [ int ]
c <- chan int; d chan<- int
}
func (t*T[K])  F( a int,b ...string )(x int,err error){

if a:=b[1:2]; len(a)>0&&!ok{
return -x,nil };
for i:=0;i<10;i ++ {
f(b ...)
}
switch {
case a==1:
   g(func( ) { h( ) })
default :
goto L
}
L :
s:=[]T{{a:1,b :2},
{ 3,4 }}
v := a+
b *c
return
}
"""
EVEN = """package p
import (
\t"fmt"
\tx "io"
)

type T[K comparable] struct {
\ta, b int `json:"a"` // of it
\tm map[string][]*T[int]
\tc <-chan int; d chan<- int
}
func (t *T[K]) F(a int, b ...string) (x int, err error) {
\tif a := b[1:2]; len(a) > 0 && !ok {
\t\treturn -x, nil }
\tfor i := 0; i < 10; i++ {
\t\tf(b...)
\t}
\tswitch {
\tcase a == 1:
\t\tg(func() { h() })
\tdefault:
\t\tgoto L
\t}
L:
\ts := []T{{a: 1, b: 2},
\t\t{3, 4}}
\tv := a +
\t\tb * c
\treturn
}
"""


def test_layout():
    assert laid_out(UNEVEN.encode()).decode() == EVEN
    assert checked(UNEVEN.encode()).source.decode() == EVEN and checked(EVEN.encode()).changed is False


@pytest.mark.parametrize("rule", sorted(cases()))
def test_layout_of_cases(rule):
    """Every authored file, squeezed and stretched, comes to the same layout, with the same tokens, comments and suppressions."""
    for case in cases()[rule]:
        source = case.source.encode()
        own = checked(source)
        assert own.error is None, (own.error, case.source)
        pieces = scan(source)[0]
        stretched = b"".join(b"   " if p.kind == "space" else p.text.encode() for p in pieces)
        assert rebuilt(pieces) == source and checked(stretched).source == own.source
        assert kept(own.source) == kept(source) and owned(own.source) == owned(source)


def test_a_file_that_does_not_parse_stays():
    own = checked(b"package p\nfunc {")
    assert own.error and not own.changed and own.source == b"package p\nfunc {"


def test_suppressions_keep_their_code():
    source = b"package p\n\nfunc f( ) {\n//tessera:ignore a -- why\nx( 1 )\n y()  //tessera:ignore-line b -- why\n}\n"
    own = checked(source)
    assert own.error is None and [r for _, r, _ in owned(own.source)] == ["a", "b"] and b"\ty() //tessera" in own.source


def test_fragments():
    assert fragment("a+b(1 ,2)", "expression") == "a + b(1, 2)"
    assert fragment("if a{\nb( )\n}", "statement") == "if a {\n\tb()\n}"
    assert fragment("type  T  struct{ }", "declaration") == "type T struct{}"
    with pytest.raises(ValueError):
        fragment("a +", "expression")
