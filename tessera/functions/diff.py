"""Line differences of two texts with bounded work, as unified hunks.

Lines that are unique on both sides anchor the alignment (patience); what stands between anchors is aligned by
a longest common subsequence where its table has at most ``CELLS`` cells, and replaced as a whole beyond that. All
of a difference's tables and all looks at lines add up to ``WORK`` at most, from the first line on, and anchors are sought ``DEEPEST`` levels deep; what is left then is replaced.
The bounds change results, so they are part of the definition.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS, WORK, DEEPEST = 1_000_000, 4_000_000, 128
CONTEXT = 3


def lines(text: str) -> list[str]:
    """Lines with their newlines; the last may have none."""
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + [x for x in parts[-1:] if x]


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of unique lines in an order that both sides share: a longest increasing run of places."""
    ca, cb = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if cb[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a) if ca[x] == 1 and x in at]
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        before[k] = last[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[p], last[p] = j, k
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(s, len(numbers)) for s in side]) for side in (a, b))
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)  # of the suffixes
    for i in range(len(a) - 1, -1, -1):
        row = np.maximum(table[i + 1, :-1], np.where(y == x[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def matched(a: list[str], b: list[str], cells: int = CELLS, work: int = WORK, deepest: int = DEEPEST) -> list[tuple[int, int]]:
    """Pairs of equal lines, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    done = 0
    while todo:
        i, n, j, m, depth = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        done += n - i + m - j
        if depth >= deepest or done > work:
            continue
        anchors = _anchors(a[i:n], b[j:m])
        if not anchors:
            size = (n - i + 1) * (m - j + 1)
            if size <= min(cells, work - done):
                done += size
                out += [(i + p, j + q) for p, q in _common(a[i:n], b[j:m])]
            continue
        out += [(i + p, j + q) for p, q in anchors]
        edges = [(i, j), *((i + p + 1, j + q + 1) for p, q in anchors)]
        ends = [*((i + p, j + q) for p, q in anchors), (n, m)]
        # The work that is left goes to the first stretches first.
        todo += [(p, pn, q, qn, depth + 1) for (p, q), (pn, qn) in reversed(list(zip(edges, ends, strict=True)))]
    return sorted(out)


def label(name: str) -> str:
    """A file's name as it stands in a header: quoted where it holds a tab or a line end."""
    if not any(c in name for c in "\t\r\n"):
        return name
    return '"' + "".join({"\t": "\\t", "\r": "\\r", "\n": "\\n", '"': '\\"', "\\": "\\\\"}.get(c, c) for c in name) + '"'


def unified(before: str, after: str, name: str = "", context: int = CONTEXT) -> str:
    """A unified difference, empty for equal texts."""
    if before == after:
        return ""
    a, b = lines(before), lines(after)
    steps: list[tuple[str, int, int]] = []  # sign, line before, line after
    i = j = 0
    for p, q in [*matched(a, b), (len(a), len(b))]:
        steps += [("-", k, j) for k in range(i, p)] + [("+", p, k) for k in range(j, q)]
        if p < len(a):
            steps.append((" ", p, q))
        i, j = p + 1, q + 1
    near = np.flatnonzero([s != " " for s, _, _ in steps])
    hunks: list[list[int]] = []
    for k in near:
        first, last = max(0, int(k) - context), min(len(steps), int(k) + context + 1)
        if hunks and first <= hunks[-1][1]:
            hunks[-1][1] = last
        else:
            hunks.append([first, last])
    out = [f"--- {label(name)}\n+++ {label(name)}\n"]
    for first, last in hunks:
        own = steps[first:last]
        n, m = sum(s != "+" for s, _, _ in own), sum(s != "-" for s, _, _ in own)
        out.append(f"@@ -{own[0][1] + (n > 0)},{n} +{own[0][2] + (m > 0)},{m} @@\n")
        for s, p, q in own:
            line = b[q] if s == "+" else a[p]
            out.append(f"{s}{line}" if line.endswith("\n") else f"{s}{line}\n\\ No newline at end of file\n")
    return "".join(out)


def unified_column(before: Column, after: Column) -> Column:
    """The unified difference of two text columns; null where either is null."""

    @F.pandas_udf("string")
    def run(a, b):
        import pandas as pd

        return pd.Series([None if x is None or y is None else unified(x, y) for x, y in zip(a, b, strict=True)])

    return run(before, after)
