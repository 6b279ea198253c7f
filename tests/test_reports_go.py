"""Reports over Go files and editor messages."""

import json

import pytest

from tessera.gorules import registry
from tessera.operators import rulebook
from tessera.sources import gofiles
from tessera.streaming import framing

FILES = [("a.go", b"package p\n\nfunc f(a int, b bool) { a = a; g(b == true) }\n"), ("b.go", b"package p\n\nfunc f(a int) {\n\t//tessera:ignore self-assignment -- known\n\ta = a\n}\n"), ("c.go", b"package  p\n")]
CHOSEN = {"self-assignment": "error", "redundant-bool-comparison": "warn"}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, bytes binary")


def documents(df):
    return {r.path: json.loads(r.document) for r in df.collect()}


def test_lint_documents(files):
    found = documents(rulebook.lint_documents(gofiles.lint(files, CHOSEN)))
    assert [(d["rule_id"], d["severity"], d["line"], d["column"]) for d in found["a.go"]["diagnostics"]] == [("self-assignment", "error", 3, 25), ("redundant-bool-comparison", "warn", 3, 34)]
    assert found["b.go"]["diagnostics"] == [] and found["b.go"]["suppressed"] == 1 and found["a.go"]["schema_version"] == 1


def test_fix_and_format_documents(files):
    fixed = documents(rulebook.fix_documents(gofiles.fixed(files, list(CHOSEN))))
    assert (fixed["a.go"]["status"], fixed["a.go"]["applied"], fixed["a.go"]["rejected"]) == ("fixed", 1, [{"rule_id": "self-assignment", "name": "remove-self-assignment", "reason": "suggestion-not-selected"}])
    assert fixed["c.go"]["status"] == "unchanged"
    form = documents(rulebook.format_documents(gofiles.formatted(files)))
    assert [form[p]["changed"] for p in sorted(form)] == [False, False, True]


def test_rule_lists(spark):
    rules = registry.loaded()
    frame = rulebook.dimension(spark, rules, ["self-assignment"])
    assert frame.count() == 127 and [r.rule_id for r in rulebook.listed(frame, fixable=True).collect()] == ["self-assignment"]
    assert {r.rule_id for r in rulebook.listed(frame, preset="complexity", tier="syntax").collect()} == {"excessive-nesting", "too-many-lines", "too-many-parameters", "too-many-results"}
    assert rulebook.list_text(frame.filter("rule_id = 'nan-comparison'")).first().out == "nan-comparison  types  correctness  a value is compared with NaN, which equals nothing"
    assert rulebook.markdown(frame.filter("rule_id = 'nan-comparison'")).first().out.startswith("| `nan-comparison` | types | correctness | no |")
    assert "option maximum: 7" in rulebook.explained(rules["too-many-parameters"])


def test_frames():
    one, two = {"jsonrpc": "2.0", "id": 1, "method": "é"}, {"jsonrpc": "2.0", "method": "x"}
    data = framing.framed(one) + b"content-length: 30\r\nContent-Type: x\r\n\r\n" + b'{"jsonrpc":"2.0","method":"x"}'
    assert framing.frames(data + framing.framed(two)[:-3]) == ([one, two], framing.framed(two)[:-3])
    assert framing.frames(b"") == ([], b"")
    for bad in (b"X: 1\r\n\r\n", b"Content-Length: x\r\n\r\n", b"Content-Length: 1\r\nContent-Length: 1\r\n\r\n{", b"Content-Length: 2\r\n\r\n[]", b"Content-Length: 99999999999\r\n\r\n", b"no colon\r\n\r\n", b"x" * 10_000):
        with pytest.raises(framing.FrameError):
            framing.frames(bad)


def test_published_positions():
    text = "a😀b\né c"
    message = framing.published("file:///x.go", 3, text, [{"start": 7, "end": 9, "rule_id": "r", "severity": "error", "message": "m"}, {"start": 5, "end": 6, "rule_id": "q", "severity": "warn", "message": "n"}])
    first, second = message["params"]["diagnostics"]
    assert first["range"] == {"start": {"line": 0, "character": 3}, "end": {"line": 0, "character": 4}} and first["severity"] == 2
    assert second["range"]["start"] == {"line": 1, "character": 0} and second["range"]["end"] == {"line": 1, "character": 1}


def test_files_by_name(spark, tmp_path):
    for p in ("testdata/a.go", "vendor/b.go", "c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("package p\n")
    assert [r.size for r in gofiles.named(spark, [f"{tmp_path}/testdata/a.go"] * 2).collect()] == [10]
    assert gofiles.discover(spark, str(tmp_path)).count() == 0
    for p in ("vendor/b.go", "c.txt"):
        with pytest.raises(ValueError):
            gofiles.named(spark, [f"{tmp_path}/{p}"])
