"""The bit-sliced index and the quality rules against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, topk


def brute(ids, vectors, queries, k):
    out = []
    for row in np.flatnonzero(np.isin(ids, queries)):
        scores = vectors @ vectors[row]
        best = [i for i in np.lexsort((ids, -scores)) if i != row][:k]
        out += [(int(ids[row]), r + 1, int(ids[i]), int(scores[i])) for r, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n,dims,spread", [(1, 3, 50), (63, 1, 1), (64, 4, 2), (200, 8, 300), (500, 16, 100_000), (130, 5, 0)])
def test_block_equals_brute_force(n, dims, spread):
    rng = np.random.default_rng(n)
    ids, vectors = rng.permutation(n * 3)[:n].astype(np.int64), rng.integers(-spread, spread + 1, (n, dims))
    block = topk.SlicedBlock(ids, vectors)
    for q in range(0, n, 7):
        found, scores = block.best(vectors[q], 5, int(ids[q]))
        assert [(int(ids[q]), i + 1, int(a), int(b)) for i, (a, b) in enumerate(zip(found, scores, strict=True))] == brute(ids, vectors, [ids[q]], 5)


def test_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 3, "x") for i in range(150)]
    rows += [(i, rows[10][1], 3, "x") for i in range(150, 190)]  # ties
    bad = [(200, None, 1, None), (250, [0.1, None] * 3, 1, None), (300, [float("nan")] * 6, 1, None), (350, [float("inf")] + [0.0] * 5, 1, None), (None, [0.5] * 6, 1, None)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int, rank string").repartition(3)
    ids = np.array([r[0] for r in rows])
    vectors = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    want = brute(ids, vectors, [i for i in ids if i % 50 == 0], 5)
    for block, asked in ((4096, 1024), (32, 2)):
        found = sorted(tuple(r) for r in topk.search(frame, F.col("vec_id") % 50 == 0, 5, block, asked).select("query_id", "rank", "vec_id", "score").collect())
        assert found == want
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (50, [])], "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in topk.search(few, F.col("vec_id") % 50 == 0).select("query_id", "vec_id", "score").collect())
    assert found == [(0, 1, 131072), (0, 1, 131072), (0, 50, 0), (50, 0, 0), (50, 1, 0), (50, 1, 0)]


def test_repeated_query_rows(spark):
    """Each row is asked, and only the row itself is no candidate."""
    rows = [(0, [1.0]), (0, [2.0]), (1, [3.0]), (2, [1.0]), (50, [-3.0]), (0, [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.search(frame, F.col("vec_id") % 50 == 0, 3).select("query_id", "rank", "vec_id", "score").collect())
    assert found == brute(np.array([r[0] for r in rows]), np.array([[int(256 * r[1][0])] for r in rows]), [0, 50], 3)


def test_large_components(spark):
    rows = [(0, [20_000.0, 1.0]), (1, [-30_000.0, 2.0]), (2, [16_384.0, 0.0]), (3, [0.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.search(frame, F.col("vec_id") == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert found == brute(np.arange(4), (256 * np.array([r[1] for r in rows])).astype(np.int64), [0], 5)
    huge = spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="might not fit"):
        topk.search(huge, F.col("vec_id") == 0).collect()


SPACE = r"[\x20\x09-\x0D]+"


def plain(rows, least, share, left, most=quality.MOST_DOCS):
    def words(t):
        return [w for w in re.split(SPACE, t) if w]

    def normal(line):
        return re.sub("[0-9]+", "0", re.sub(SPACE, " ", line.strip(" ").lower()))

    lines = {r: [x for x in (r[1] or "").split("\n") if words(x)] for r in set(rows)}
    texts, hosts = defaultdict(set), defaultdict(set)
    for r in set(rows):
        if r[1] is not None:
            hosts[r[3]].add(r[0])
            for x in lines[r]:
                texts[r[3], normal(x)].add(r[0])
    out = []
    for r in rows:
        t, w = r[1] or "", words(r[1] or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(windows)
        covered = {i + d for i, x in enumerate(windows) if twice[x] > 1 for d in range(3)}
        gone = sum(len(words(x)) for x in lines[r] if len(texts[r[3], normal(x)]) > least and len(texts[r[3], normal(x)]) > min(most, share * len(hosts[r[3]])))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines[r]) - len(set(lines[r])), len(covered), failed, not failed and len(w) - gone >= left * len(w), gone))
    return out


def key(x):
    return tuple((v is None, v) for v in x)


def test_quality_rules(spark, documents, nothing, rows):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    extra = []
    for i in range(60):
        body = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 12)))
        foot = "\nPage 12  of the Common Footer, which every page of this host has at its end" * (i % 3 == 0)
        extra.append((1000 + i, body + foot.replace("12", str(i)), None, "host" if i % 4 else None, None, 0.5, 7, "x#", "y", 1))
    frame = documents.unionByName(spark.createDataFrame(extra, documents.schema))
    found = sorted((tuple(r) for r in quality.judged(frame, least_docs=3, share=0.05).select(*names).collect()), key=key)
    want = sorted(plain([*rows, *extra], 3, 0.05, quality.LEFT), key=key)
    assert [(a, b) for a, b in zip(found, want, strict=True) if a != b][:3] == []
    assert any(r[-1] for r in want) and any(not r[6] and not r[7] for r in want) and any(r[7] for r in want)
    assert quality.judged(nothing).collect() == []
    assert sorted(r.doc_id for r in quality.judged(documents).filter("kept").collect()) == sorted(r[0] for r in plain(rows, 20, 0.02, 0.5) if r[7])
    found = sorted((tuple(r) for r in quality.judged(frame, least_docs=2, share=0.9, most_docs=6).select(*names).collect()), key=key)
    assert found == sorted(plain([*rows, *extra], 2, 0.9, quality.LEFT, 6), key=key)


def test_copies_count_as_documents(spark):
    """A line that only copies of one text have stands in as many documents."""
    body = "\n".join(f"line {'abcdefgh'[i]} " + " ".join(f"w{i}{'xyz'[j % 3] * (j + 1)}" for j in range(12)) for i in range(8))
    frame = spark.createDataFrame([(i, body, "h") for i in range(30)] + [(100 + i, f"own{'abcdefghij'[i]} " * 3 + body.replace("w", f"{'abcdefghij'[i]}v"), "h") for i in range(10)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(frame).collect()}
    assert not any(kept[i] for i in range(30)) and all(kept[100 + i] for i in range(10))


def test_main_path_is_native(documents):
    plan = quality.judged(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
