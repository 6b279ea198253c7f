"""Go files as relations: discovery, and the pieces, directives and suppressions of each file.

Files are read by Spark's binaryFile source; a file is parsed in the task that holds it, and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that hold other people's code or a version control system's data, and test fixtures.
EXCLUDED = ("vendor", ".git", ".hg", ".svn", ".bzr", ".jj")
FIXTURES = ("testdata",)
LARGEST = 64 << 20
PIECES = "path string, ord int, kind string, start int, end int, text string, inserted boolean"
DIRECTIVES = "path string, ord int, kind string, start int, end int, raw string"
NODES = "path string, node int, parent int, place int, kind string, start int, end int, line int, name string"
FINDINGS = "path string, rule_id string, start int, end int, line int, column int, message_key string, severity string, fix_name string, fix_safety string, edits array<struct<start:int,end:int,new_text:string>>"
FAILURES = "path string, error string"
RECEIVERS = "path string, package string, type string, method string, name string, pointer boolean, start int, end int, line int"
IMPORTS = "path string, ord int, name string, import_path string, line int"
FIXED = "path string, bytes binary, digest string, applied int, refused array<struct<rule_id:string,name:string,reason:string>>"
FORMATTED = "path string, bytes binary, digest string, changed boolean, error string, diff string"
CALLS = "path string, start int, end int, line int, callee string, caller string"
CONSTANTS = "path string, name string, line int, value string"
FUNCTIONS = "path string, name string, start int, line int, parameters int, results int, nesting int, logical_lines int"
WAIVERS = "path string, scope string, rule_id string, start int, end int, target_start int, target_end int, reason string, expires_on string, problem string"


def discover(spark: SparkSession, root: str, fixtures: bool = False) -> DataFrame:
    """path, bytes, size, digest, error of the .go files under a root; one over 64 MiB has an error and no bytes.

    Spark lists no file of length nothing, so empty files, which have no finding, have no row.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.go").load(root)
    inside = F.regexp_replace("path", r"^\w+:/+", "/")
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    relative = F.when(inside.startswith(base), F.substring(inside, len(base), 1 << 20)).otherwise(inside)
    skipped = EXCLUDED if fixtures else EXCLUDED + FIXTURES
    kept = found.filter(~relative.rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in skipped) + ")/")).dropDuplicates(["path"])
    large = F.col("length") > LARGEST
    return kept.select("path", F.when(~large, F.col("content")).alias("bytes"), F.col("length").alias("size"), F.when(~large, F.sha2("content", 256)).alias("digest"), F.when(large, "over 64 MiB").alias("error"))


def named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As ``discover``, for files given by name: fixtures are read too, but nothing in folders of other people's code."""
    inside = [p for p in dict.fromkeys(paths) if p.endswith(".go") and not set(p.split("/")[:-1]) & set(EXCLUDED)]
    refused = sorted(set(paths) - set(inside))
    if refused:
        raise ValueError(f"not to be read: {', '.join(refused)}")
    found = spark.read.format("binaryFile").load(inside)
    large = F.col("length") > LARGEST
    return found.select("path", F.when(~large, F.col("content")).alias("bytes"), F.col("length").alias("size"), F.when(~large, F.sha2("content", 256)).alias("digest"), F.when(large, "over 64 MiB").alias("error"))


#: Rows of a batch that a task gives out, where files have many rows each.
GIVEN_OUT = 20_000


def _batched(files: DataFrame, schema: str, rows) -> DataFrame:
    """Rows (path, ...) that ``rows(path, bytes)`` makes of each file, many files at a time, in the task that holds them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            out: list[tuple] = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(path, *r) for r in rows(path, data)]
                if len(out) >= GIVEN_OUT:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    return files.filter("bytes is not null").select("path", F.col("bytes").cast("binary").alias("bytes")).mapInArrow(run, schema)


def _mapped(files: DataFrame, schema: str, rows) -> DataFrame:
    return _batched(files, schema, lambda path, data: rows(data))


def pieces(files: DataFrame) -> DataFrame:
    """Rows of PIECES: tokens and trivia in order; their texts put together are the file."""
    from tessera.goparse.scanner import scan

    return _mapped(files, PIECES, lambda data: [(k, p.kind, p.start, p.end, p.text.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), p.inserted) for k, p in enumerate(scan(data)[0])])


def nodes(files: DataFrame) -> DataFrame:
    """Rows of NODES: every node of every file that parses, parents first; ``place`` is that among the parent's."""
    from tessera.goparse.syntax import GoSyntaxError, parse
    from tessera.goparse.syntax import rows as flat

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            return flat(parse(data))
        except GoSyntaxError:
            return []

    return _batched(files, NODES, rows)


def node_counts(files: DataFrame) -> DataFrame:
    """path, kind, n: the nodes of every file that parses, counted by kind in the task that holds it."""
    from collections import Counter

    from tessera.goparse.syntax import GoSyntaxError, parse

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            return list(Counter(n.kind for n in parse(data).root.walk()).items())
        except GoSyntaxError:
            return []

    return _batched(files, "path string, kind string, n bigint", rows).groupBy("path", "kind").agg(F.sum("n").alias("n"))


def functions(files: DataFrame) -> DataFrame:
    """Rows of FUNCTIONS: sizes of every declared function with a body."""
    from tessera.goparse.syntax import GoSyntaxError, parse
    from tessera.gorules import structure

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            tree = parse(data)
        except GoSyntaxError:
            return []
        own = [d for d in tree.root.decls if d.kind == "FuncDecl" and d.body is not None]
        return [(d.name.name, d.start, tree.line(d.start), structure.arity(d.type.params), structure.arity(d.type.results), structure.nesting(d.body.body, 0), structure.logical_lines(tree, d.body)) for d in own]

    return _batched(files, FUNCTIONS, rows)


def failures(files: DataFrame) -> DataFrame:
    """Rows of FAILURES: files that don't parse, with the byte offset and reason of the first error."""
    from tessera.goparse.syntax import GoSyntaxError, parse

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            parse(data)
        except GoSyntaxError as e:
            return [(str(e),)]
        return []

    return _batched(files, FAILURES, rows)


def findings(files: DataFrame, names: list[str] | None = None, options: dict[str, dict] | None = None, severities: dict[str, str] | None = None, include_generated: bool = False) -> DataFrame:
    """Rows of FINDINGS: what the rules find (by id or preset; all but policies where none is named). Files that don't parse have none; see ``failures``.

    One pass over each file runs all rules, each at the kinds of nodes that it asks for; severities (off, warn, error) are by rule.
    """
    from tessera.gorules.registry import loaded, selected

    loaded()
    wanted = [r.rule_id for r in selected(names) if (severities or {}).get(r.rule_id) != "off"]

    def rows(path: str, data: bytes) -> list[tuple]:
        from bisect import bisect_right

        from tessera.gorules.registry import check, loaded

        loaded()
        found, error = check(path, data, wanted, options, include_generated)
        if error or not found:
            return []
        starts = [0, *(k + 1 for k, b in enumerate(data) if b == 10)]
        out = []
        for f in found:
            line = bisect_right(starts, f.start)
            name, safety, edits = f.fix or (None, None, None)
            out.append((f.rule_id, f.start, f.end, line, f.start - starts[line - 1] + 1, f.message_key, (severities or {}).get(f.rule_id, "warn"), name, safety, None if edits is None else [{"start": a, "end": b, "new_text": t} for a, b, t in edits]))
        return out

    return _batched(files, FINDINGS, rows)


def fixed(files: DataFrame, names: list[str] | None = None, allowed: tuple[str, ...] = ("safe",)) -> DataFrame:
    """Rows of FIXED: every file that parses, with its findings' fixes of the allowed safety classes applied, and those that were refused."""
    from tessera.gorules.registry import loaded, selected

    loaded()
    wanted = [r.rule_id for r in selected(names)]

    def rows(path: str, data: bytes) -> list[tuple]:
        from hashlib import sha256

        from tessera.gorules.fixing import Candidate
        from tessera.gorules.fixing import fixed as done
        from tessera.gorules.registry import check, loaded

        loaded()
        found, error = check(path, data, wanted)
        if error:
            return []
        new, applied, refused = done(data, [Candidate(f.rule_id, *f.fix) for f in found if f.fix], allowed)
        return [(new, sha256(new).hexdigest(), len(applied), [{"rule_id": c.rule_id, "name": c.name, "reason": r} for c, r in refused])]

    return _batched(files, FIXED, rows)


def receivers(files: DataFrame) -> DataFrame:
    """Rows of RECEIVERS: every method's receiver; a package is a folder and the name in its files' package clauses."""
    from tessera.goparse.facts import Facts
    from tessera.goparse.syntax import GoSyntaxError, parse

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            tree = parse(data)
        except GoSyntaxError:
            return []
        facts, out = Facts(tree), []
        package = f"{path.rpartition('/')[0]}:{tree.root.name.name}"
        for d in tree.root.decls:
            if d.kind == "FuncDecl" and d.receiver:
                r = d.receiver[0]
                base, name = facts.base_name(r.type), r.names[0] if r.names else None
                if base:
                    at = name or r
                    out.append((package, base, d.name.name, name.name if name else None, r.type.kind == "Star", at.start, at.end, tree.line(at.start)))
        return out

    return _batched(files, RECEIVERS, rows)


def receiver_findings(files: DataFrame) -> DataFrame:
    """path, rule_id, start, line of receivers that differ from those of most methods of their type, over all files of a package.

    The most frequent name counts, of equally frequent ones the first in order of path and place; blank and absent names don't. Pointers
    against values likewise, where ties go to the first method. One type's methods are met by partial counts, so a large package is no task's own.
    """
    from pyspark.sql import Window

    own = receivers(files)
    place = F.struct("path", "start")
    out = []
    for rule, value, some in (("inconsistent-receiver-name", F.col("name"), F.col("name").isNotNull() & (F.col("name") != "_")), ("mixed-receiver-type", F.col("pointer").cast("string"), F.lit(True))):
        named = own.filter(some).withColumn("value", value)
        counts = named.groupBy("package", "type", "value").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        rank = F.row_number().over(Window.partitionBy("package", "type").orderBy(F.col("n").desc(), "first"))
        usual = counts.withColumn("rank", rank).filter("rank = 1").select("package", "type", F.col("value").alias("usual"))
        met = named.join(usual, ["package", "type"]).filter("value <> usual")
        out.append(met.select("path", F.lit(rule).alias("rule_id"), "start", "line"))
    return out[0].unionByName(out[1])


def imports(files: DataFrame) -> DataFrame:
    """Rows of IMPORTS: the imports of every file that parses, in the source's order: edges from files to packages."""
    from tessera.goparse.syntax import GoSyntaxError, parse

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            tree = parse(data)
        except GoSyntaxError:
            return []
        specs = [s for d in tree.root.decls if d.kind == "GenDecl" and d.word == "import" for s in d.specs]
        return [(i, s.name, s.path, tree.line(s.start)) for i, s in enumerate(specs)]

    return _batched(files, IMPORTS, rows)


def package_graph(files: DataFrame, module: str) -> DataFrame:
    """(src, dst) folders of one module, of which the first's files import the second: the graph for closures and orders."""
    own = imports(files).select(F.regexp_replace("path", "/?[^/]*$", "").alias("src"), "import_path")
    return own.filter(F.col("import_path").startswith(module + "/")).select("src", F.substring("import_path", len(module) + 2, 1 << 20).alias("dst")).distinct()


def last_calls(files: DataFrame) -> DataFrame:
    """path, package, name, callee: declared functions whose bodies end with a call, and what they call."""
    from tessera.goparse.facts import Facts
    from tessera.goparse.syntax import GoSyntaxError, parse

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            tree = parse(data)
        except GoSyntaxError:
            return []
        facts, out = Facts(tree), []
        for d in tree.root.decls:
            if d.kind == "FuncDecl" and not d.receiver and d.body is not None and d.body.body:
                s = d.body.body[-1]
                returns = any(x.kind == "Return" for x in d.body.walk(stop=("FuncLit",)))
                if s.kind == "ExprStmt" and s.x.kind == "Call" and not returns:
                    callee = facts.callee(s.x) or (s.x.fun.name if s.x.fun.kind == "Ident" else None)
                    if callee:
                        out.append((f"{path.rpartition('/')[0]}:{tree.root.name.name}", d.name.name, callee))
        return out

    return _batched(files, "path string, package string, name string, callee string", rows)


def no_return(files: DataFrame) -> DataFrame:
    """package, name: functions that never return, as they end with a call of what never returns: the library's ends, or others of the package, to a fixpoint."""
    from tessera.gorules.bodies import NO_RETURN
    from tessera.operators.graph import closure, cut

    own = cut(last_calls(files).select("package", "name", "callee").distinct())  # every step reads it, so files are parsed once
    key = lambda c: F.concat_ws("\n", "package", c)
    seeds = own.filter(F.col("callee").isin(*sorted(NO_RETURN))).select(key("name").alias("node")).distinct()
    edges = own.select(key("callee").alias("src"), key("name").alias("dst"))
    found = closure(seeds.select(F.lit(0).alias("origin"), "node"), edges)
    return found.select(F.split("node", "\n")[0].alias("package"), F.split("node", "\n")[1].alias("name")).distinct()


def formatted(files: DataFrame, context: int = 3, difference: bool = True) -> DataFrame:
    """Rows of FORMATTED: every file laid out, with the difference where it is asked for; a file whose layout would change more than white space stays and has an error."""

    def rows(path: str, data: bytes) -> list[tuple]:
        from hashlib import sha256

        from tessera.functions.diff import unified
        from tessera.layout.go import checked

        own = checked(data)
        text = unified(data.decode("utf-8", "replace"), own.source.decode("utf-8", "replace"), path, context) if difference and own.changed else None
        return [(own.source, sha256(own.source).hexdigest(), own.changed, own.error, text)]

    return _batched(files, FORMATTED, rows)


def check(files: DataFrame, severities: dict[str, str], options: dict[str, dict] | None = None) -> DataFrame:
    """path, kind (format, finding or error), rule_id, line, message: what layout and rules have to say about every file."""
    none = F.lit(None).cast("string")
    laid = formatted(files, difference=False)
    layout = laid.filter("changed").select("path", F.lit("format").alias("kind"), none.alias("rule_id"), F.lit(None).cast("int").alias("line"), F.lit("the layout isn't even").alias("message"))
    broken = laid.filter("error is not null").select("path", F.lit("error").alias("kind"), none.alias("rule_id"), F.lit(None).cast("int").alias("line"), F.col("error").alias("message"))
    found = lint(files, severities, options).filter("disposition = 'visible'").select("path", F.lit("finding").alias("kind"), "rule_id", "line", F.col("message_key").alias("message"))
    return layout.unionByName(broken).unionByName(found)


def calls(files: DataFrame) -> DataFrame:
    """Rows of CALLS: every call whose callee the file tells, by symbol, and the function that it stands in (null outside of one)."""
    from tessera.goparse.facts import Facts
    from tessera.goparse.syntax import GoSyntaxError, parse

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            tree = parse(data)
        except GoSyntaxError:
            return []
        facts, out = Facts(tree), []
        for d in tree.root.decls:
            caller = d.name.name if d.kind == "FuncDecl" else None
            for n in d.walk():
                if n.kind == "Call":
                    own = facts.decl(n.fun) if n.fun.kind == "Ident" else None
                    name = facts.callee(n) or (own.name if own is not None and own.kind == "func" else None)
                    if name is not None:
                        out.append((n.start, n.end, tree.line(n.start), name, caller))
        return out

    return _batched(files, CALLS, rows)


def constants(files: DataFrame) -> DataFrame:
    """Rows of CONSTANTS: declared constants whose values can be told, exactly."""
    from tessera.goparse.facts import Facts
    from tessera.goparse.syntax import GoSyntaxError, parse

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            tree = parse(data)
        except GoSyntaxError:
            return []
        facts = Facts(tree)
        found = [(d.name, tree.line(d.node.start), facts.constant(d.node)) for d in facts.declared if d.kind == "const" and d.name != "_"]
        return [(name, line, str(v).lower() if isinstance(v, bool) else str(v)) for name, line, v in found if v is not None]

    return _batched(files, CONSTANTS, rows)


def lint(files: DataFrame, severities: dict[str, str], options: dict[str, dict] | None = None, baseline: DataFrame | None = None, today: str | None = None) -> DataFrame:
    """Findings of all files with ``disposition``: suppressed by the first directive in the file that holds their start, baselined, or visible.

    ``baseline`` (rule_id, path, message_key, count) hides the first findings of its keys, in canonical order.
    """
    from pyspark.sql import Window

    from tessera.operators import waivers as waive

    found = findings(files, list(severities), options, severities)
    own = waivers(files, list(severities), today).filter("problem is null")
    order = F.row_number().over(Window.partitionBy("path").orderBy("start", "rule_id"))
    held = own.withColumn("ord", order).select("path", "rule_id", "ord", F.col("target_start").alias("first"), F.col("target_end").alias("last"))
    met = waive.suppressed(found, held, ["path", "rule_id"], "start")
    if baseline is None:
        return met.withColumn("disposition", F.when(F.col("directive").isNotNull(), "suppressed").otherwise("visible"))
    key = ["rule_id", "path", "message_key"]
    rest = waive.apply_baseline(met.filter("directive is null"), baseline, key, ["start", "end"])
    rest = rest.withColumn("disposition", F.when(F.col("hidden"), "baselined").otherwise("visible")).drop("hidden")
    return rest.unionByName(met.filter("directive is not null").withColumn("disposition", F.lit("suppressed")))


def directives(files: DataFrame, tool: str = "tessera") -> DataFrame:
    """Rows of DIRECTIVES: comments that tools read."""
    from tessera.goparse.directives import kind_of
    from tessera.goparse.scanner import scan

    def rows(data: bytes) -> list[tuple]:
        comments = [p for p in scan(data)[0] if p.kind in ("line_comment", "block_comment")]
        kinds = [(p, kind_of(p.text.rstrip("\r"), tool)) for p in comments]
        return [(k, kind, p.start, p.end, p.text) for k, (p, kind) in enumerate((p, kind) for p, kind in kinds if kind)]

    return _mapped(files, DIRECTIVES, rows)


def waivers(files: DataFrame, known: list[str] | None = None, today: str | None = None, need_reason: bool = False, tool: str = "tessera") -> DataFrame:
    """Rows of WAIVERS: suppressions, and problems (problem is their kind, reason their message)."""
    from tessera.goparse.directives import suppressions
    from tessera.goparse.scanner import scan

    def rows(data: bytes) -> list[tuple]:
        found, problems = suppressions(scan(data)[0], len(data), set(known) if known is not None else None, today, need_reason, tool)
        return [(s.scope, s.rule_id, s.start, s.end, s.target_start, s.target_end, s.reason, s.expires_on, None) for s in found] + [(None, None, p.start, p.end, None, None, p.message, None, p.kind) for p in problems]

    return _mapped(files, WAIVERS, rows)
