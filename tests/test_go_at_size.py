"""What Go files cost: rows dealt over the cores, files scanned and parsed once, results given out in bounded batches."""

import os

import pytest

from tessera.goparse import syntax
from tessera.layout import go
from tessera.plans import goqueries
from tessera.sources import gofiles

SF = "/root/testdata/sf0.001"
FILES = [("a.go", b"package p\n\nfunc f(a int) {\n\tif a > 1 {\n\t\tg()\n\t}\n}\n"), ("b.go", b"package"), ("c.go", None), ("d.go", b"package p\n\nfunc h() { g(); g() }\n")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_parts_are_dealt_over_the_cores(spark):
    own = goqueries.parts(spark, SF)
    assert own.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and own.count() == spark.read.parquet(f"{SF}/part.parquet").count()


@pytest.mark.parametrize(("source", "most"), [(b"package p\n\nfunc f() {\n\tg()\n}\n", 1), (b"package   p\n\nfunc f( ){\n// tessera:ignore x\ng( a,b ) ;\n}", 2)])
def test_a_layout_scans_a_text_once(monkeypatch, source, most):
    seen, plain = [], syntax.scan
    for module in (syntax, go):
        monkeypatch.setattr(module, "scan", lambda data: seen.append(data) or plain(data))
    assert go.checked(source).error is None and len(seen) <= most


def test_node_counts(spark, monkeypatch):
    files = spark.createDataFrame([*FILES, ("a.go", FILES[0][1])], "path string, bytes binary")
    want = sorted(map(tuple, files.sparkSession.createDataFrame(gofiles.nodes(files).collect()).groupBy("path", "kind").count().collect()))
    assert sorted(map(tuple, gofiles.node_counts(files).collect())) == want and want
    monkeypatch.setattr(gofiles, "GIVEN_OUT", 3)
    assert gofiles.nodes(files).count() == sum(n for _, _, n in want)


def test_no_return_parses_once(spark, monkeypatch):
    files = spark.createDataFrame([(f"d/f{k}.go", f"package p\n\nfunc f{k}() {{ f{k + 1}() }}\n".encode()) for k in range(6)] + [("d/f6.go", b'package p\n\nimport "os"\n\nfunc f6() { os.Exit(1) }\n')], "path string, bytes binary")
    met, plain = spark.sparkContext.accumulator(0), gofiles.last_calls

    def counted(own):
        def run(batches):
            for b in batches:
                met.add(len(b))
                yield b

        out = plain(own)
        return out.mapInPandas(run, out.schema)

    monkeypatch.setattr(gofiles, "last_calls", counted)
    assert {r.name for r in gofiles.no_return(files).collect()} == {f"f{k}" for k in range(7)}
    assert met.value == 7
