"""Line differences: applying a difference gives the other text, and small cases are shortest."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.diff import lines, matched, unified, unified_column

TEXTS = st.lists(st.sampled_from(["a\n", "b\n", "c\n", "d\n", "\n", "e\r\n", "x"]), max_size=14).map("".join)


def applied(before: str, difference: str) -> str:
    a, out, at = lines(before), [], 0
    rows = difference.split("\n")
    k = 2
    while k < len(rows):
        m = re.fullmatch(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@", rows[k])
        if not m:
            k += 1
            continue
        start = int(m[1]) - (int(m[2]) > 0)
        out += a[at:start]
        at = start
        k += 1
        while k < len(rows) and rows[k][:1] in (" ", "+", "-"):
            bare = k + 1 < len(rows) and rows[k + 1].startswith("\\")
            text = rows[k][1:] + ("" if bare else "\n")
            if rows[k][0] != "-":
                out.append(text)
            if rows[k][0] != "+":
                assert a[at] == text
                at += 1
            k += 2 if bare else 1
    return "".join(out + a[at:])


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_applying_gives_the_other_text(before, after):
    assert "".join(lines(before)) == before
    assert applied(before, unified(before, after)) == after
    for cells in (0, 10**6):
        pairs = matched(lines(before), lines(after), cells)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
        assert all(lines(before)[i] == lines(after)[j] for i, j in pairs)


def test_small_cases():
    assert unified("a\n", "a\n") == ""
    assert unified("a\nb\nc\n", "a\nx\nc\n", "f") == "--- f\n+++ f\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n"
    assert unified("", "a", "f") == "--- f\n+++ f\n@@ -0,0 +1,1 @@\n+a\n\\ No newline at end of file\n"
    assert len(matched(list("aabbaabb"), list("abab"))) == 4


def test_column(spark):
    rows = spark.createDataFrame([("a\n", "b\n"), ("a", None), ("x", "x")], "a string, b string")
    assert [r.d for r in rows.select(unified_column(rows.a, rows.b).alias("d")).collect()] == ["--- \n+++ \n@@ -1,1 +1,1 @@\n-a\n+b\n", None, ""]
