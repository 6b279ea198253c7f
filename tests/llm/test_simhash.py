"""Fingerprints against a plain form, links and components against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, distance=2):
    """{fingerprint: smallest fingerprint of its component} of all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(fps)
    for i, a in enumerate(every):
        for b in every[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in every}


def test_fingerprints(rows):
    for r in rows:
        if len(r[1] or "") < 100_000:
            assert simhash.fingerprint(r[1]) == plain(r[1])
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("ÀA b") != simhash.fingerprint("àa b") and simhash.fingerprint("A B c d") == simhash.fingerprint("a b c d")


def test_native_hash_is_the_same(spark):
    found = spark.range(1).select(F.xxhash64(F.lit("the words são")).alias("h")).first()["h"]
    assert np.array([xxhash.xxh64_intdigest("the words são", 42)], np.uint64).view(np.int64)[0] == found


def clouds(seed, n, spread):
    """Signed fingerprints: random ones, and dense clouds about some centres."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)} | {0, 2**64 - 1, 1, 2**63}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(n):
            x = centre
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return [int(x) for x in np.array(sorted(out), np.uint64).view(np.int64)]


@pytest.mark.parametrize("dense", [1, 8, 10**6])
@pytest.mark.parametrize("partitions", [1, 2, 3, 4])
def test_links_lose_nothing(spark, dense, partitions):
    if partitions != 3 and dense != 8:
        pytest.skip("one density is enough for other partitions")
    fps = clouds(dense + partitions, 60, 4)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3).persist()
    edges = simhash.links(frame, 2, partitions, dense).collect()
    assert all(a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges)
    want = brute(fps)
    found = brute_of(fps, edges)
    assert found == want
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {f: roots.get(f, f) for f in fps} == want


def brute_of(fps, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for f in sorted(fps):
        if f not in out:
            todo = [f]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = f
                    todo += near[x]
    return out


def test_thresholds_are_the_cheapest():
    from itertools import product

    rng = np.random.default_rng(0)
    estimate = np.cumsum(rng.exponential(5, (3, 3, 200)), axis=1)
    widths = [22, 21, 21]
    found = simhash.allocated(estimate, widths, 2)
    assert (found.sum(axis=0) == 0).all()

    def cost(ts, k):
        return sum(estimate[i, t, k] + len(simhash._masks(widths[i], t)) for i, t in enumerate(ts) if t >= 0)

    choices = [t for t in product(range(-1, 3), repeat=3) if sum(t) == 0]
    for k in range(200):
        assert np.isclose(cost(found[:, k], k), min(cost(t, k) for t in choices))


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 64))
    for b in range(10):
        x[:, 54 + b] = x[:, b]
    groups = simhash.grouped_bits(4000, x.T.astype(float) @ x, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {21, 22}
    assert sum(any(b in g and 54 + b in g for g in groups) for b in range(10)) >= 8


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def expected(rows):
    fps = [plain(r[1]) for r in rows]
    root = brute(set(fps))
    first = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            first[root[f]] = min(first.get(root[f], r[0]), r[0])
    return [(r[0], f"{f:016x}", first.get(root[f])) for r, f in zip(rows, fps, strict=True)], root, fps


def key(x):
    return tuple((v is None, v) for v in x)


def test_frames(documents, nothing, rows):
    want, root, fps = expected(rows)
    found = [tuple(r) for r in simhash.components(documents, dense=3).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert simhash.components(nothing).collect() == []
    kept = simhash.keep_first(documents, dense=3)
    assert kept.columns == documents.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(set(root.values())) and set(got) <= set(rows)
    assert sorted((r[0] for r in got), key=lambda d: (d is None, d)) == sorted({c for _, _, c in want}, key=lambda d: (d is None, d))
    assert simhash.keep_first(nothing).collect() == []


def test_one_row_stays_of_rows_without_ids(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (None, "other words stand here now"), (5, "same"), (5, "same"), (6, "same")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.doc_id) for r in got) == [("one two three four", None), ("other words stand here now", None), ("same", 5)]


def test_partitions_follow_the_number_of_fingerprints():
    sizes = [10, 10**6, 10**8, 10**10, 10**13, 10**20]
    own = [simhash.partitions_for(n, 2) for n in sizes]
    assert own[0] == 3 and own[-1] == 1 and own == sorted(own, reverse=True) and set(own) == {1, 2, 3}
    for n in sizes:
        # No other number costs less: probes of one fingerprint, and what they meet where bits are even.
        cost = {1: 2081 * (1 + n / 2**64), 2: 33 * (1 + n / 2**32) + 1 + n / 2**32, 3: 3 * (1 + n / 2**21)}
        assert simhash.partitions_for(n, 2) == min(cost, key=cost.get)
