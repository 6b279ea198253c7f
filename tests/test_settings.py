"""Configuration and baseline files, read strictly; fixes of files."""

import pytest

from tessera.goparse.syntax import parse
from tessera.gorules import fixing, registry
from tessera.sources import settings

RULES = registry.loaded()
CONFIG = """
version = 1
[format]
line-width = 100
[lint]
profile = "recommended"
warnings-as-errors = true
[lint.rules]
direct-panic = "warn"
almost-swapped = "off"
[lint.rule-options.too-many-lines]
maximum = 50
[[lint.overrides]]
paths = ["cmd/**"]
[lint.overrides.rules]
direct-panic = "off"
[lint.suppressions]
require-reason = true
expiry-cutoff = "2030-01-02"
[lint.baseline]
path = "lint/baseline.json"
"""


def test_config():
    own = settings.config(CONFIG, RULES)
    assert own.profile == "recommended" and own.require_reason and own.baseline_path == "lint/baseline.json" and own.options == {"too-many-lines": {"maximum": 50}}
    found = settings.severities(own, RULES)
    assert found["direct-panic"] == "error" and "almost-swapped" not in found and found["identical-branches"] == "error" and "redundant-else" not in found
    assert set(settings.severities(settings.config("version = 1", RULES), RULES)) == {k for k, r in RULES.items() if "correctness" in r.presets}
    strict = settings.severities(settings.config('version = 1\n[lint]\npresets = ["complexity"]', RULES), RULES)
    assert set(strict) == {"excessive-nesting", "too-many-lines", "too-many-parameters", "too-many-results"}


@pytest.mark.parametrize("text", [
    "", "version = 2", "version = true", "version = 1\nother = 1", "version = 1\n[lint]\nprofile = 1", "version = 1\n[lint]\nprofile = 'none'", "version = 1\n[lint]\nprofile = 'strict'\npreset = 'style'",
    "version = 1\n[lint]\npreset = 'restriction'", "version = 1\n[lint.rules]\nnone = 'warn'", "version = 1\n[lint.rules]\ndirect-panic = 'loud'", "version = 1\n[format]\nline-width = 0", "version = 1\n[cache]\nenabled = true",
    "version = 1\n[cache]\nmax-entries = -1", "version = 1\n[lint.rule-options.too-many-lines]\nmaximum = true", "version = 1\n[lint.rule-options.too-many-lines]\nmaximum = 0", "version = 1\n[lint.baseline]\npath = '../x'",
    "version = 1\n[lint.suppressions]\nexpiry-cutoff = '2030-1-2'", "version = 1\n[[lint.overrides]]\npaths = ['/x']", "version = 1\n[analysis]\nbuild-tags = ['a b']", "version =",
])
def test_config_errors(text):
    with pytest.raises(settings.SettingsError):
        settings.config(text, RULES)


def entry(**own):
    return {"rule_id": "a", "path": "x/y.go", "message_key": "m", "source_fingerprint": "0" * 64, "count": 1} | own


def test_baseline_reads_back():
    entries = [entry(path="z.go"), entry(rule_id="b", reason="old", expires_on="2030-01-02"), entry()]
    text = settings.baseline_text(entries)
    assert [(e["path"], e["rule_id"]) for e in settings.baseline(text)] == [("x/y.go", "a"), ("x/y.go", "b"), ("z.go", "a")]
    assert settings.baseline_text(settings.baseline(text)) == text and text.endswith("}\n") and not text.endswith("\n\n")


@pytest.mark.parametrize("own", [dict(count=0), dict(count=True), dict(path="/x"), dict(path="a/../b"), dict(source_fingerprint="A" * 64), dict(source_fingerprint="0"), dict(expires_on="2030-1-1"), dict(other=1), dict(rule_id=""), dict(message_key="")])
def test_baseline_errors(own):
    import json

    with pytest.raises(settings.SettingsError):
        settings.baseline(json.dumps({"schema_version": 1, "entries": [entry(**own)]}))


@pytest.mark.parametrize("text", ["", "{}", "[]", '{"schema_version": 2, "entries": []}', '{"schema_version": 1, "entries": null}', '{"schema_version": 1, "entries": [], "x": 1}', '{"schema_version": 1, "entries": []} {}', '{"schema_version": 1, "schema_version": 1, "entries": []}'])
def test_baseline_shape(text):
    with pytest.raises(settings.SettingsError):
        settings.baseline(text)


def test_baseline_doubles_and_unknown_rules(spark):
    import json

    with pytest.raises(settings.SettingsError):
        settings.baseline(json.dumps({"schema_version": 1, "entries": [entry(), entry(count=2)]}))
    text = json.dumps({"schema_version": 1, "entries": [entry()]})
    with pytest.raises(settings.SettingsError):
        settings.baseline(text, ["b"])
    assert settings.baseline_frame(spark, settings.baseline(text, ["a"])).first()["count"] == 1


def candidate(*edits, safety="safe", **own):
    return fixing.Candidate("r", "n", safety, tuple(edits), **own)


def test_reasons():
    data = "package p // é\n".encode()
    for c, why in [
        (candidate(), "missing-fix"), (candidate((0, 0, "x"), digest="other"), "stale-source"), (candidate((0, 0, "x"), safety="suggestion"), "suggestion-not-selected"), (candidate((0, 0, "x"), safety="unsafe"), "unsafe"),
        (candidate((0, 0, "x"), safety="odd"), "invalid-safety"), (candidate((0, 99, "x")), "invalid-range"), (candidate((3, 2, "x")), "invalid-range"), (candidate((0, data.index(b"\xa9"), "")), "invalid-range"),
        (candidate((0, 0, "\ud800")), "invalid-text"), (candidate((0, 7, "")), "validation"),
    ]:
        assert fixing.fixed(data, [c], digest="d") == (data, [], [(c, why)])


def test_a_failed_fix_refuses_all():
    data = b"package p\n\nvar a, b = 1, 2\n"
    good, bad = candidate((15, 16, "c")), candidate((0, 7, ""))
    assert fixing.fixed(data, [good, bad]) == (data, [], [(good, "validation"), (bad, "validation")])
    assert fixing.fixed(data, [good])[0] == b"package p\n\nvar c, b = 1, 2\n"


@pytest.mark.parametrize("a,b,clash", [((0, 3), (2, 5), True), ((0, 3), (3, 5), False), ((1, 1), (1, 1), True), ((0, 3), (1, 1), True), ((0, 3), (0, 0), False), ((0, 3), (3, 3), False), ((0, 9), (3, 4), True)])
def test_conflicts(a, b, clash):
    one, two = candidate((*a, "x")), candidate((*b, "y"))
    assert bool(fixing.conflicts([one, two])) == clash == bool(fixing.conflicts([two, one]))


def test_imports():
    data = b'package p\n\nimport "fmt"\nimport (\n\t"os"\n\tx "io"\n\t_ "embed"\n)\n\nvar a = os.Args\n'
    assert fixing.unused_imports(parse(data)) == {(None, "fmt"), ("x", "io")}
    assert fixing.without_imports(data, {(None, "fmt"), ("x", "io")}) == b'package p\n\nimport (\n\t"os"\n\t_ "embed"\n)\n\nvar a = os.Args\n'
    assert b'\t_ "embed"\n\t"net"\n)' in fixing.with_imports(data, [(None, "net"), (None, "os"), (None, "net")])
    assert fixing.with_imports(b"package p\n", [("n", "net")]) == b'package p\n\nimport n "net"\n' and fixing.with_imports(data, [(None, "os")]) == data
    assert fixing.with_imports(b'package p\n\nimport "os"\n', [(None, "net")]) == b'package p\n\nimport "os"\nimport "net"\n'
