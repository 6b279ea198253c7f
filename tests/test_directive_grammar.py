"""The grammar of suppressions, case by case, and the bounds of line differences."""

import pytest

from tessera.functions import diff
from tessera.goparse.directives import suppressions
from tessera.goparse.scanner import scan

HEAD = "package p\n\n"


def read(code, **options):
    data = (HEAD + code).encode()
    found, problems = suppressions(scan(data)[0], len(data), {"a", "b"}, **options)
    return data, found, problems


@pytest.mark.parametrize("text,kind", [
    ("ignore a", None), ("ignore\ta", None), ("ignore  a\t--  why", None), ("ignore a -- expires=2030-01-02 why", None), ("ignore-line a--why", None), ("ignore a\r", None),
    ("ignore", "malformed"), ("", "malformed"), ("skip a", "malformed"), ("ignore a b", "malformed"), ("ignore -- why", "malformed"), ("ignore c", "unknown-rule"), ("ignore c -- expires=x y", "unknown-rule"),
    ("ignore a --", "missing-reason"), ("ignore a -- expires=2030-01-02", "missing-reason"), ("ignore a -- expires=2030-1-2 why", "invalid-expiry"), ("ignore a -- expires=2030-02-30 why", "invalid-expiry"),
    ("ignore a -- expires=2020-01-01 why", "expired"), ("ignore-end a", "unmatched-range-end"), ("ignore-end a -- why", "malformed"), ("ignore-start a", "unclosed-range"), ("ignore-file a", "misplaced-file-scope"),
])
def test_grammar(text, kind):
    _, found, problems = read(f"//tessera:{text}\nvar x = 1\n", today="2025-06-01")
    assert [p.kind for p in problems] == ([kind] if kind else []) and len(found) == (not kind)


def test_a_reason_can_be_asked_for():
    assert [p.kind for p in read("//tessera:ignore a\n", need_reason=True)[2]] == ["missing-reason"]
    assert read("//tessera:ignore-start a -- why\n//tessera:ignore-end a\n", need_reason=True)[2] == []


def test_ranges_are_paired_by_rule():
    code = "//tessera:ignore-start a\nvar x = 1\n//tessera:ignore-start b -- why\n//tessera:ignore-start a\n//tessera:ignore-end a\nvar y = 1\n//tessera:ignore-end b\n//tessera:ignore-end b\n"
    data, found, problems = read(code)
    assert [(s.rule_id, s.reason) for s in found] == [("a", ""), ("b", "why")] and [p.kind for p in problems] == ["nested-range", "unmatched-range-end"]
    assert [data[s.target_start : s.target_end].count(b"var") for s in found] == [1, 1]
    assert data[found[1].target_start : found[1].target_end].strip().endswith(b"var y = 1")


def test_lines_within_raw_strings_are_lines():
    data, found, _ = read("var x = `one\ntwo` //tessera:ignore-line a\nvar y = `a\nb`\n//tessera:ignore b\nvar z = `c\nd`\n")
    assert [data[s.target_start : s.target_end] for s in found] == [b"two` //tessera:ignore-line a", b"var z = `c"]


def test_next_line_of_the_last_one():
    data, found, _ = read("//tessera:ignore a")
    assert (found[0].target_start, found[0].target_end) == (len(data), len(data))


def regions(n, size):
    one, two = [], []
    for k in range(n):
        one += [f"before{k}\n"] * size
        two += [f"after{k}\n"] * size
        one.append(f"anchor{k}\n")
        two.append(f"anchor{k}\n")
    return one, two


def test_work_is_bounded_from_the_first_line_on():
    a, b = [], []
    for k in range(7):
        own = [f"l{k}\n", f"r{k}\n"] * 400
        a += own + [f"anchor{k}\n"]
        b += [own[1], *own[:-1]] + [f"anchor{k}\n"]
    every, bounded = diff.matched(a, b, work=10**9), diff.matched(a, b)
    assert set(bounded) < set(every) and len(bounded) < len(every)
    assert [x for x in every if x[0] < 800] == [x for x in bounded if x[0] < 800] and max(i for i, _ in bounded) == max(i for i, _ in every)


def test_cells_count_the_borders():
    a, b = ["x\n", "y\n"] * 2, ["y\n", "x\n"] * 2
    assert diff.matched(a, b, cells=25) and not diff.matched(a, b, cells=24)


def test_depth_is_bounded():
    a, b = regions(3, 2)
    assert diff.matched(a, b, deepest=0) == [(8, 8)] and len(diff.matched(a, b, deepest=1)) == 3


def test_labels():
    assert diff.unified("a\n", "b\n", 'x\t"y"').startswith('--- "x\\t\\"y\\""\n')
    assert diff.unified("a\n", "b\n", 'x "y"').startswith('--- x "y"\n')
