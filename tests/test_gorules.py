"""Every rule over authored code: what it finds and what it leaves alone."""

import pytest

from tessera.goparse.syntax import GoSyntaxError, parse, rows
from tessera.gorules import registry
from tessera.plans.gocases import OPTIONS, cases

RULES = registry.loaded()
CASES = [(rule, i, case) for rule, own in cases().items() for i, case in enumerate(own)]


@pytest.mark.parametrize("rule,i,case", CASES, ids=[f"{r}-{i}" for r, i, _ in CASES])
def test_case(rule, i, case):
    found, error = registry.check("p.go", case.source.encode(), [rule], OPTIONS)
    assert error is None, (error, case.source)
    lines = parse(case.source.encode())
    assert sorted(lines.line(f.start) for f in found) == sorted(case.lines), case.source


def test_every_rule_has_cases_of_both_kinds():
    own = cases()
    missing = {r for r in RULES if r not in own and r != "invalid-test-signature"}
    assert not missing and all(any(c.lines for c in x) and any(not c.lines for c in x) for x in own.values())


def test_test_signatures():
    code = b'package p\n\nimport "testing"\n\nfunc TestA(t *testing.T) {}\nfunc TestB(b *testing.B) {}\nfunc Testing(t *testing.T) {}\nfunc TestMain(m *testing.M) {}\nfunc ExampleA() int { return 1 }\n'
    found, _ = registry.check("p_test.go", code, ["invalid-test-signature"])
    assert [(code[f.start : f.end], f.message_key) for f in found] == [(b"TestB", "wrong-signature"), (b"Testing", "malformed-name"), (b"ExampleA", "wrong-signature")]
    assert registry.check("p.go", code, ["invalid-test-signature"])[0] == []


def test_tests_are_left_out_unless_asked_for():
    code = b'package p\n\nfunc f() { panic("x") }\n'
    assert registry.check("a_test.go", code, ["direct-panic"])[0] == []
    assert len(registry.check("a_test.go", code, ["direct-panic"], {"direct-panic": {"include-tests": True}})[0]) == 1
    assert len(registry.check("a.go", b"// Code generated by x. DO NOT EDIT.\n\n" + code, ["direct-panic"])[0]) == 0
    assert len(registry.check("a.go", b"// Code generated by x. DO NOT EDIT.\n\n" + code, ["direct-panic"], include_generated=True)[0]) == 1


def test_selection():
    assert {r.rule_id for r in registry.selected(["complexity"])} == {"excessive-nesting", "too-many-lines", "too-many-parameters", "too-many-results"}
    for bad in ("restriction", "nothing"):
        with pytest.raises(ValueError):
            registry.selected([bad])
    assert "direct-panic" not in {r.rule_id for r in registry.selected()}


@pytest.mark.parametrize("code", ["package", "package p\nfunc f( {", "package p\nvar x = ", "package p\nfunc f() { if { } }", "package p\nfunc f() { a, b }", "package p\nvar x = \x00", "package p\nvar x = " + "(" * 5000])
def test_errors(code):
    with pytest.raises(GoSyntaxError):
        parse(code.encode())
    found, error = registry.check("x.go", code.encode())
    assert found == [] and error


def test_nodes():
    code = b"""package p

type Set[K comparable, V any] map[K]V
type I interface { ~int | string; M(a int, b ...string) (x, y error) }

func (s *Set[K, V]) Get(k K) (v V, ok bool) { v, ok = (*s)[k]; return }

func g() {
L:
	for i, c := range []struct{ a, b int }{{1, 2}, {a: 3}} {
		switch x := any(c).(type) { case int, *T: continue L; default: _ = x }
		select { case v, ok := <-ch: f(v, ok); case ch <- i + 1: }
		if f := func(xs ...int) {}; len(a[1:2:3]) > 0 && !ok { go f(a...); defer func() {}() } else { goto L }
	}
	x, y := Map[int, string]{1: "a"}, [...]int{0: 1}
	for ; ; { break }
	var _ <-chan (chan<- int) = nil
}
"""
    out = rows(parse(code))
    kinds = {r[3] for r in out}
    assert kinds >= {"TypeSwitch", "Select", "Labeled", "RangeStmt", "Composite", "Slice", "Send", "Go", "Defer", "Union", "Tilde", "ChanType", "FuncLit", "Index"}
    assert out[0][1] is None and all(out[r[1]][4] <= r[4] and r[5] <= out[r[1]][5] for r in out[1:])
