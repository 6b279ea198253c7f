"""Operators of the findings algebra: properties and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fixes, graph, policy, retention, targets, waivers
from tessera.operators.findings import RULES
from tessera.sources import texts
from tessera.streaming import versions


def conflicts(edits):
    out = set()
    for i, (p, c, s, e) in enumerate(edits):
        for p2, c2, s2, e2 in edits[:i]:
            if p != p2:
                continue
            a, b = s == e, s2 == e2
            if (not a and not b and s < e2 and s2 < e) or (a and b and s == s2) or (a and not b and s2 < s < e2) or (b and not a and s < s2 < e):
                out |= {(p, c), (p, c2)}
    return out


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(1)
    edits = []
    for p in range(400):
        for k in range(rng.randint(1, 7)):
            s = rng.randint(0, 12)
            edits.append((p, rng.randint(0, 3), s, s + rng.choice([0, 0, 1, 2, 5])))
    frame = spark.createDataFrame(edits, "path int, fix int, start int, end int")
    assert {tuple(r) for r in fixes.conflicted(frame, "path", "fix").collect()} == conflicts(edits)


def test_splice(spark):
    edits = "array<struct<start:int,end:int,new_text:string>>"
    frame = spark.createDataFrame([("abcdef", [(1, 3, "X"), (5, 5, "++"), (0, 1, "")]), ("äöü", [(1, 1, "漢"), (3, 3, "!")]), ("", [])], f"t string, e {edits}")
    assert [r.x for r in frame.select(fixes.spliced(F.col("t"), F.col("e")).alias("x")).collect()] == ["Xde++f", "ä漢öü!", ""]


def test_checks_take_the_first_reason(spark):
    rows = [("a", "b", "safe", None, 5), ("a", "a", "safe", None, 5), ("a", "a", "unsafe", [(9, 1, "")], 5), ("a", "a", "safe", [], 5), ("a", "a", "safe", [(1, 9, "")], 5), ("a", "a", "safe", [(1, 5, "")], 5)]
    frame = spark.createDataFrame(rows, "digest string, now_digest string, safety string, edits array<struct<start:int,end:int,new_text:string>>, size int")
    assert [r.reason for r in fixes.checked(frame, ["safe"]).collect()] == ["stale-source", "missing-fix", "not-authorised", "no-edits", "bad-range", None]


def test_baseline_hides_all_that_it_was_made_from(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 5), rng.choice("ab"), rng.randint(1, 50)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "doc_id int, rule_id string, line int")
    key = ["doc_id", "rule_id"]
    base = waivers.baseline_of(frame, key)
    assert waivers.apply_baseline(frame, base, key, ["line"]).filter("not hidden").isEmpty()
    dated = base.withColumn("expires_on", F.lit(None).cast("string"))
    assert waivers.stale(dated, frame, frame, key, "doc_id", F.lit("2026-01-01")).isEmpty()
    less = base.withColumn("count", F.lit(2).cast("long"))
    hidden = waivers.apply_baseline(frame, less, key, ["line"]).filter("hidden")
    assert {r["count"] for r in hidden.groupBy(*key).count().collect()} <= {1, 2} and waivers.apply_baseline(frame, base.limit(0), key, ["line"]).filter("hidden").isEmpty()


def test_suppressions_used_and_unused_are_all(spark):
    rng = random.Random(3)
    found = spark.createDataFrame([(rng.randint(0, 9), rng.randint(1, 30), i) for i in range(100)], "doc_id int, line int, i int")
    directives = [(d, o, a := rng.randint(1, 28), a + rng.randint(1, 6)) for d in range(12) for o in range(4)]
    frame = spark.createDataFrame(directives, "doc_id int, ord int, first int, last int")
    met = waivers.suppressed(found, frame, ["doc_id"])
    want = {}
    for r in found.collect():
        want[r.i] = min((o for d, o, a, b in directives if d == r.doc_id and a <= r.line < b), default=None)
    assert {r.i: r.directive for r in met.collect()} == want
    left = {(r.doc_id, r.ord) for r in waivers.unused(frame, met, ["doc_id"]).collect()}
    used = {(r.doc_id, r.directive) for r in met.collect() if r.directive is not None}
    assert left | used == {(d, o) for d, o, _, _ in directives} and not left & used


def test_ranges_and_ownership(spark):
    ranges = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (1, 6, 6), (1, 1, 9), (2, 5, 5), (2, 7, 8)], "doc_id int, first int, last int")
    assert sorted(map(tuple, waivers.merged_ranges(ranges, ["doc_id"]).collect())) == [(1, 1, 9), (2, 5, 5), (2, 7, 8)]
    own = spark.createDataFrame([(2, "a", [(5, 5), (7, 8)]), (2, "b", [(5, 6)]), (3, "c", [(1, 1)]), (2, "d", [])], "doc_id int, fix string, edits array<struct<first:int,last:int>>")
    assert sorted(r.fix for r in waivers.owned_fixes(own, ranges, ["doc_id"]).collect()) == ["a", "d"]


def test_policy():
    assert policy.resolve(RULES, ["style"])["long-line"] == "warn"
    assert policy.resolve(RULES, [], {"long-line": "error"}, only=["long-line"]) == {"long-line": "error"}
    assert policy.resolve(RULES, ["style"], levels=[("deny", "warnings"), ("allow", "long-line")]) == {"trailing-space": "error"}
    with pytest.raises(policy.PolicyError):
        policy.resolve(RULES, ["style"], levels=[("forbid", "style"), ("allow", "long-line")])
    with pytest.raises(policy.PolicyError):
        policy.resolve(RULES, [], levels=[("deny", "nothing-of-this-name")])
    assert policy.superset({"a": "error"}, [("x", "a", "warn"), ("y", "b", "warn")]) == {"a": "error", "b": "warn"}


@pytest.mark.parametrize("glob,path,want", [("**/*.go", "a/b/c.go", True), ("**/*.go", "c.go", True), ("*.go", "a/c.go", False), ("a/**", "a/b/c", True), ("a/**", "b/a/c", False), ("a?/x+y", "ab/x+y", True), ("a/**/b", "a/b", True)])
def test_globs(glob, path, want):
    import re

    assert bool(re.search(policy.glob_pattern(glob), path)) == want


def test_targets(spark):
    rows = spark.createDataFrame([("p", 1, "linux"), ("p", 1, "darwin"), ("p", 2, "linux"), ("p", 1, "linux")], "path string, line int, target string")
    assert sorted((r.line, r.targets) for r in targets.merged(rows).collect()) == [(1, ["darwin", "linux"]), (2, ["linux"])]
    with pytest.raises(Exception, match="different sources of p"):
        targets.one_digest(spark.createDataFrame([("p", "x"), ("p", "y")], "path string, digest string")).collect()


def test_cycles_are_told(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    with pytest.raises(graph.CycleError):
        graph.topological(nodes, spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int"))
    found = {r.node: r.level for r in graph.topological(nodes, spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")).collect()}
    assert found == {3: 0, 2: 1, 1: 2}
    loop = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src int, dst int")
    assert {(r.node, r.level) for r in graph.closure(spark.createDataFrame([(1, 1)], "origin int, node int"), loop).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_retention(spark):
    frame = spark.createDataFrame([([(1, 5), (2, 9), (3, 4)],), ([(1, 50)],), ([],)], "x array<struct<id:bigint,size:bigint>>")
    kept = [r.k for r in frame.select(retention.admitted(F.col("x"), 8, 10).alias("k")).collect()]
    assert kept == [[1, 3], [], []]
    assert [r.k for r in frame.select(retention.admitted(F.col("x"), 8, 10, always_first=True).alias("k")).collect()] == [[1, 3], [1], []]
    sizes = spark.createDataFrame([([3, 3, 3, 9, 1, 1, 1, 1],)], "x array<bigint>")
    assert sizes.select(retention.waves(F.col("x"), 3, 8).alias("w")).first().w == [0, 0, 1, 2, 3, 3, 3, 4]
    entries = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 2, 50), (1, "c", 3, 5)], "g int, key string, modified int, size long")
    assert {r.key: r.kept for r in retention.pruned(entries, 5, 20, ["g"]).collect()} == {"c": True, "b": False, "a": False}


def test_positions(spark):
    frame = spark.createDataFrame([("ä\nbc\n",), ("",), ("x\r\ny",)], "text string")
    starts = frame.select(texts.line_starts(F.col("text")).alias("s")).collect()
    assert [r.s for r in starts] == [[0, 3, 6], [0], [0, 3]]
    at = frame.limit(1).select(texts.position(texts.line_starts(F.col("text")), F.lit(4)).alias("p")).first().p
    assert (at.line, at.column) == (2, 2)
    styles = spark.createDataFrame([("a",), ("a\n",), ("a\r\nb\r\n",), ("a\r\nb\n",)], "text string").select(texts.newline_style(F.col("text")).alias("s")).collect()
    assert [r.s for r in styles] == ["none", "lf", "crlf", "mixed"]


def test_stream_of_versions(spark, tmp_path):
    schema = "uri string, version long, text string"
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "q")], schema).coalesce(1).write.json(str(source / "0"))
    out = []
    stream = spark.readStream.schema(schema).json(str(source / "*"))
    fresh = versions.latest_stream(stream, "uri", "version", {"text": "string"})
    query = versions.publish(fresh, lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "check"), "latest")
    query.awaitTermination()
    assert sorted(out) == [("a", 3, "z"), ("b", 2, "q")]
    spark.createDataFrame([("a", 2, "old"), ("b", 5, "new")], schema).coalesce(1).write.json(str(source / "1"))
    query = versions.publish(versions.latest_stream(spark.readStream.schema(schema).json(str(source / "*")), "uri", "version", {"text": "string"}), lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "check"), "latest2")
    query.awaitTermination()
    assert sorted(out) == [("a", 3, "z"), ("b", 2, "q"), ("b", 5, "new")]


def test_incremental(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string")
    cached = spark.createDataFrame([(x, 0) for x in "abcde"], "node string, r int")
    changed = spark.createDataFrame([("b",)], "node string")
    out = versions.incremental(changed, edges, cached, lambda n: n.withColumn("r", F.lit(1)))
    assert {r.node: r.r for r in out.collect()} == {"a": 1, "b": 1, "c": 0, "d": 0, "e": 0}
