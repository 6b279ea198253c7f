"""Queries of the Go rules against DuckDB."""

import os

import pytest
from test_catalogue import plain

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

from tessera.plans import goqueries  # noqa: E402
from tessera.sources import gofiles  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("supplier", "part", "nation"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def compared(spark, duck, name):
    got = goqueries.QUERIES[name](spark, SF)
    want = duck.execute(goqueries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want and want


@pytest.mark.parametrize("name", [n for n in goqueries.ORACLES if not n.startswith("rule_")])
def test_query_equals_its_sql(spark, duck, name):
    compared(spark, duck, name)


@pytest.mark.parametrize("name", ["rule_printf_arguments", "rule_exported_api_documentation", "rule_waitgroup_misuse"])
def test_rules_in_their_queries(spark, duck, name):
    compared(spark, duck, name)


def test_every_rule_query_in_one_pass(spark, duck):
    """All rule queries at once: one frame, as the queries differ by a rule's name and its files."""
    from functools import reduce

    names = [n for n in goqueries.ORACLES if n.startswith("rule_")]
    want = sorted(r for n in names for r in duck.execute(goqueries.ORACLES[n]).fetchall())
    got = []
    for at in range(0, len(names), 20):
        frames = [goqueries.QUERIES[n](spark, SF) for n in names[at : at + 20]]
        got += [tuple(r) for r in reduce(lambda a, b: a.unionByName(b), frames).collect()]
    assert sorted(got) == want and len(want) > 3000


def test_findings_with_options_and_severities(spark):
    files = spark.createDataFrame([("a.go", b"package p\n\nfunc f(a, b int) { a = a }\n"), ("b.go", b"package"), ("c.go", b""), ("d.go", None)], "path string, bytes binary")
    found = gofiles.findings(files, ["too-many-parameters", "self-assignment"], {"too-many-parameters": {"maximum": 1}}, {"self-assignment": "error"}).collect()
    assert sorted((r.path, r.rule_id, r.line, r.column, r.severity, r.fix_name) for r in found) == [("a.go", "self-assignment", 3, 20, "error", "remove-self-assignment"), ("a.go", "too-many-parameters", 3, 8, "warn", None)]
    assert gofiles.findings(files, ["self-assignment"], severities={"self-assignment": "off"}).collect() == []
    assert sorted(r.path for r in gofiles.failures(files).collect()) == ["b.go", "c.go"]
    assert gofiles.nodes(files).filter("parent is null").count() == 1
