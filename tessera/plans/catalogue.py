"""Registered queries over the driver's tables, each with its DuckDB twin.

The tables hold prose, markup, events and star-schema rows, so the queries show the operators' algebra; none of
them claims to run a rule over Go source. Queries whose docstring begins with "Analogue" only resemble an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import findings as rules
from tessera.operators import fixes, graph, policy, reports, retention, targets, waivers
from tessera.plans import oracles
from tessera.sources import texts
from tessera.streaming import versions

QUERIES: dict = {}
ORACLES: dict = {}
PLACE = ["doc_id", "line", "start", "end"]
ORDER = [*PLACE, "rule_id", "message_key"]
KEY = ["doc_id", "rule_id", "message_key"]


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    own = [r for r in rules.RULES if not only or r.rule_id in only]
    return rules.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), own)


def selected(spark: SparkSession) -> DataFrame:
    chosen = policy.resolve(rules.RULES, ["style", "suspicious", "correctness", "pedantic", "restriction"], levels=[("deny", "secret-like")])
    return spark.createDataFrame(list(chosen.items()), "rule_id string, severity string")


def all_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_severity(scanned(spark, sf_dir), selected(spark))


# -- sources


@query(oracles.DOC_METADATA)
def doc_metadata(spark, sf_dir):
    return texts.metadata(read(spark, sf_dir, "documents")).select("doc_id", "chars", "bytes", "lines", "newline", "final_newline", "digest")


@query(oracles.DOC_LINES)
def doc_lines(spark, sf_dir):
    return texts.lines(read(spark, sf_dir, "documents")).select("doc_id", "line", F.length("t").cast("long").alias("n_chars"))


@query(oracles.LINE_POSITIONS)
def line_positions(spark, sf_dir):
    """The line and column of the byte in the middle of each text."""
    own = read(spark, sf_dir, "documents").select("doc_id", texts.line_starts(F.col("text")).alias("starts"), F.floor(F.octet_length("text") / 2).cast("int").alias("offset"))
    return own.select("doc_id", F.col("offset").cast("long").alias("offset"), texts.position(F.col("starts"), F.col("offset")).alias("p")).select("doc_id", "offset", "p.line", "p.column")


@query(oracles.OVERLAY)
def overlay_scan(spark, sf_dir):
    """Unsaved texts (pages, by id) in place of stored ones."""
    disk = read(spark, sf_dir, "documents").select("doc_id", "text")
    over = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("newer"))
    return disk.join(over, "doc_id", "left").select("doc_id", F.sha2(F.coalesce("newer", "text"), 256).alias("digest"), F.col("newer").isNotNull().alias("overlaid"))


# -- findings


def _finding(rule_id: str):
    def run(spark, sf_dir):
        if rule_id != "trailing-space":
            return scanned(spark, sf_dir, rule_id)
        # The tables' lines have no spaces at their ends: every third document gets some.
        spaced = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "\n", "  \n")).otherwise(F.col("text"))
        return rules.scan(read(spark, sf_dir, "documents").select("doc_id", spaced.alias("text")), [r for r in rules.RULES if r.rule_id == rule_id])

    run.__name__ = "finding_" + rule_id.replace("-", "_")
    return query(oracles.finding(rule_id))(run)


for _rule in rules.RULES:
    _finding(_rule.rule_id)


@query(oracles.DIAGNOSTICS_ALL)
def diagnostics_all(spark, sf_dir):
    """The flagship: all rules in one scan, severities of the policy, canonical order."""
    return all_diagnostics(spark, sf_dir).select(*PLACE, "rule_id", "severity", "message_key").orderBy(*ORDER)


@query(oracles.RULE_COUNTS)
def rule_counts(spark, sf_dir):
    met = waivers.in_scope(_suppressed(spark, sf_dir), _changed(spark, sf_dir), ["doc_id"])
    state = F.when(F.col("directive").isNotNull(), "suppressed").when(~F.col("changed"), "preexisting").otherwise("visible")
    return reports.dispositions(met.withColumn("disposition", state), rules.rules_dimension(spark))


@query(oracles.TIER_REASONS)
def tier_reasons(spark, sf_dir):
    out = reports.tier_reasons(rules.rules_dimension(spark).join(selected(spark), "rule_id"))
    return out.select("tier", F.array_join("rules", ",").alias("rules"))


@query(oracles.EXIT_CODE)
def exit_code(spark, sf_dir):
    return reports.exit_code(all_diagnostics(spark, sf_dir))


@query(oracles.SELECTED_TIER)
def selected_tier(spark, sf_dir):
    return policy.deepest(rules.rules_dimension(spark).join(selected(spark), "rule_id"))


# -- policy


@query(oracles.POLICY_RESOLVE)
def policy_resolve(spark, sf_dir):
    chosen = policy.resolve(rules.RULES, ["suspicious", "pedantic"], {"long-line": "error"}, [("deny", "suspicious"), ("allow", "address-like"), ("deny", "warnings"), ("warn", "long-line")], without=["duplicate-line"])
    return spark.createDataFrame(list(chosen.items()), "rule_id string, severity string")


OVERRIDES = [("src1*", "long-line", "error"), ("src?", "license-line", "allow"), ("**", "secret-like", "error"), ("src1?", "long-line", "warn"), ("src2", "license-line", "error")]


@query(oracles.PATH_OVERRIDES)
def path_override_last_match(spark, sf_dir):
    return policy.last_match(read(spark, sf_dir, "documents").select(F.col("source").alias("path")), OVERRIDES)


@query(oracles.DOMINANT)
def dominant_value(spark, sf_dir):
    """The commonest event of each user, the first seen of equally common ones."""
    return policy.dominant(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


# -- baselines


def _baseline(spark, sf_dir) -> DataFrame:
    return waivers.baseline_of(all_diagnostics(spark, sf_dir).filter("doc_id % 2 = 0 or line <= 2"), KEY)


@query(oracles.BASELINE_GENERATE)
def baseline_generate(spark, sf_dir):
    return _baseline(spark, sf_dir)


def _baselined(spark, sf_dir) -> DataFrame:
    return waivers.apply_baseline(all_diagnostics(spark, sf_dir), _baseline(spark, sf_dir), KEY, ORDER).select(*PLACE, "rule_id", "message_key", "hidden")


@query(oracles.baseline_apply(False))
def baseline_apply_visible(spark, sf_dir):
    return _baselined(spark, sf_dir).filter("not hidden").drop("hidden")


@query(oracles.baseline_apply(True))
def baseline_apply_hidden(spark, sf_dir):
    return _baselined(spark, sf_dir).filter("hidden").drop("hidden")


def _aged(spark, sf_dir) -> DataFrame:
    """Entries of the baseline with an expiry date by doc_id, and one finding more than there is."""
    date = F.when(F.col("doc_id") % 3 == 0, "2026-01-01").when(F.col("doc_id") % 3 == 1, "2027-01-01")
    return waivers.baseline_of(all_diagnostics(spark, sf_dir), KEY).withColumns({"count": F.col("count") + F.col("doc_id") % 2, "expires_on": date})


@query(oracles.BASELINE_STALE)
def baseline_stale(spark, sf_dir):
    analysed = read(spark, sf_dir, "documents").filter("doc_id % 5 <> 0").select("doc_id")
    return waivers.stale(_aged(spark, sf_dir), all_diagnostics(spark, sf_dir), analysed, KEY, "doc_id", F.lit("2026-08-01"))


@query(oracles.BASELINE_EXPIRED)
def baseline_expired(spark, sf_dir):
    analysed = read(spark, sf_dir, "documents").filter("doc_id % 5 <> 0").select("doc_id")
    return waivers.expired(_aged(spark, sf_dir), analysed, KEY, "doc_id", F.lit("2026-08-01"))


# -- suppressions, supersession, changed lines


def _directives(spark, sf_dir) -> DataFrame:
    """A file-scope directive for each toxic document, line ranges for the others, two of which overlap."""
    own = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    file = own.filter("toxic = 1").select("doc_id", F.lit(1).alias("first"), F.lit(1 << 30).alias("last"), F.lit(0).alias("ord"))
    first = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(o).alias("ord")) for o, (a, b) in enumerate([(1, 3), (2, 6), (5, 9)])))
    ranges = own.filter("toxic = 0").select("doc_id", F.inline(first))
    return file.unionByName(ranges).select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("ord").cast("long").alias("ord"))


def _suppressed(spark, sf_dir) -> DataFrame:
    return waivers.suppressed(all_diagnostics(spark, sf_dir), _directives(spark, sf_dir), ["doc_id"])


@query(oracles.SUPPRESS_APPLY)
def suppress_apply(spark, sf_dir):
    return _suppressed(spark, sf_dir).select(*PLACE, "rule_id", "message_key", "directive")


@query(oracles.SUPPRESS_UNUSED)
def suppress_unused(spark, sf_dir):
    return waivers.unused(_directives(spark, sf_dir), _suppressed(spark, sf_dir), ["doc_id"]).select("doc_id", "ord", "first", "last")


@query(oracles.SUPERSEDE)
def supersede(spark, sf_dir):
    return waivers.superseded(all_diagnostics(spark, sf_dir), [("adjacent-equal", "duplicate-line")], PLACE).select(*PLACE, "rule_id", "message_key")


def _changed(spark, sf_dir) -> DataFrame:
    """Changed ranges by a formula on doc_id, some of them adjacent."""
    own = read(spark, sf_dir, "documents").filter("doc_id % 4 <> 3").select("doc_id", F.explode(F.array(F.lit(1), F.lit(4), F.lit(8), F.lit(20))).alias("a"))
    return own.select("doc_id", F.col("a").cast("long").alias("first"), (F.col("a") + F.col("doc_id") % 4).cast("long").alias("last"))


def _scoped(spark, sf_dir) -> DataFrame:
    return waivers.in_scope(all_diagnostics(spark, sf_dir), _changed(spark, sf_dir), ["doc_id"]).select(*PLACE, "rule_id", "message_key", "changed")


@query(oracles.changed(True))
def changed_visible(spark, sf_dir):
    return _scoped(spark, sf_dir).filter("changed").drop("changed")


@query(oracles.changed(False))
def changed_preexisting(spark, sf_dir):
    return _scoped(spark, sf_dir).filter("not changed").drop("changed")


@query(oracles.MERGE_RANGES)
def merge_ranges(spark, sf_dir):
    return waivers.merged_ranges(_changed(spark, sf_dir), ["doc_id"])


@query(oracles.OWNED_FIXES)
def owned_fixes(spark, sf_dir):
    """Fixes of a document's findings of one rule, whose every line has to be changed."""
    edits = F.collect_list(F.struct(F.col("line").alias("first"), F.col("line").alias("last")))
    own = all_diagnostics(spark, sf_dir).groupBy("doc_id", "rule_id").agg(edits.alias("edits"))
    return waivers.owned_fixes(own, _changed(spark, sf_dir), ["doc_id"]).select("doc_id", "rule_id", F.size("edits").cast("long").alias("n_edits"))


# -- targets


def _per_target(spark, sf_dir) -> DataFrame:
    """Findings as seen by two build targets: by source, and by document number."""
    own = all_diagnostics(spark, sf_dir).select(*PLACE, "rule_id", "message_key")
    return own.withColumn("target", F.lit("linux")).unionByName(own.filter("doc_id % 3 <> 0").withColumn("target", F.lit("darwin")))


@query(oracles.TARGET_MERGE)
def target_merge(spark, sf_dir):
    return targets.merged(_per_target(spark, sf_dir)).withColumn("targets", F.array_join("targets", ","))


@query(oracles.TARGET_UNUSED)
def target_unused_intersect(spark, sf_dir):
    found, directives = _per_target(spark, sf_dir), _directives(spark, sf_dir)
    documents = read(spark, sf_dir, "documents").select("doc_id")
    seen = documents.withColumn("target", F.lit("linux")).unionByName(documents.filter("doc_id % 3 <> 0").withColumn("target", F.lit("darwin")))
    own = directives.join(seen, "doc_id")
    met = waivers.suppressed(found.filter("rule_id <> 'duplicate-line' or target = 'linux'"), own, ["doc_id", "target"])
    return targets.unused_everywhere(waivers.unused(own, met, ["doc_id", "target"]), seen, ["doc_id", "ord"], "doc_id")


@query(oracles.ONE_DIGEST)
def source_union(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest"))
    return targets.one_digest(own.unionByName(own.filter("path like '%1'")))


# -- fixes


def _edits(spark, sf_dir) -> DataFrame:
    """Five candidates a document: edits by formulas on doc_id, in its middle and at its end, insertions among them; those beyond a short text's end are left out."""
    own = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    d, size = F.col("doc_id"), F.length("text")
    half = F.floor(size / 2)
    parts = [("a", d % 7, d % 7 + d % 4, "<A>"), ("a", d % 5 + 12, d % 5 + 14, ""), ("b", d % 9 + 2, d % 9 + 2 + d % 3, "<B>"), ("c", d % 6 + 11, d % 6 + 11, "<C>"), ("d", half, half + 1, "<D>"), ("e", size, size, "<E>")]
    edit = F.array(*(F.struct(F.lit(c).alias("fix"), s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(t).alias("new_text")) for c, s, e, t in parts))
    return own.select("doc_id", "text", F.inline(edit)).filter(F.greatest("start", "end") <= size)


@query(oracles.FIX_CONFLICTS)
def fix_conflicts(spark, sf_dir):
    edits = _edits(spark, sf_dir).drop("text")
    every = edits.select("doc_id", "fix").distinct()
    bad = fixes.conflicted(edits, "doc_id", "fix").withColumn("conflicted", F.lit(True))
    return every.join(bad, ["doc_id", "fix"], "left").withColumn("conflicted", F.coalesce("conflicted", F.lit(False)))


@query(oracles.FIX_APPLIED)
def fix_applied_text(spark, sf_dir):
    edits = _edits(spark, sf_dir)
    good = edits.join(fixes.conflicted(edits.drop("text"), "doc_id", "fix"), ["doc_id", "fix"], "left_anti")
    grouped = good.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "new_text")).alias("edits"))
    whole = read(spark, sf_dir, "documents").select("doc_id", "text").join(grouped, "doc_id")
    done = whole.select("doc_id", fixes.spliced(F.col("text"), F.col("edits")).alias("t"), F.size("edits").cast("long").alias("n_edits"))
    return done.select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("chars"), "n_edits")


@query(oracles.IMPORT_CONFLICTS)
def import_conflicts(spark, sf_dir):
    """Analogue: parts as candidates that need a brand under a type's name."""
    own = read(spark, sf_dir, "part").select(F.col("p_size").alias("path"), F.col("p_partkey").alias("fix"), F.col("p_type").alias("name"), F.col("p_brand").alias("import_path"))
    return fixes.import_conflicts(own, "path", "fix")


# -- reports


@query(oracles.SHORT_TEXT)
def report_short_text(spark, sf_dir):
    own = all_diagnostics(spark, sf_dir).withColumns({"path": F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), "message": F.concat(F.col("message_key"), F.lit(" finding"))})
    return reports.short_text(own).select("doc_id", "line", "start", "rule_id", "out")


@query(oracles.ANNOTATIONS)
def report_annotations(spark, sf_dir):
    own = all_diagnostics(spark, sf_dir).withColumns({"path": F.concat(F.lit("doc:a,b/"), F.col("doc_id").cast("string")), "message": F.concat(F.lit("100% of "), F.col("message_key"), F.lit("\nhere"))})
    return reports.annotations(own).select("doc_id", "line", "start", "rule_id", "out")


@query(oracles.REPORT_JSON)
def report_json(spark, sf_dir):
    own = all_diagnostics(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    return reports.json_documents(own, ["path", "line", "start", "end", "rule_id", "severity", "message_key"])


@query()
def report_sarif(spark, sf_dir):
    own = all_diagnostics(spark, sf_dir).withColumns({"path": F.col("doc_id").cast("string"), "message": F.col("message_key")})
    return reports.sarif(own, rules.rules_dimension(spark))


@query(oracles.FRAMES)
def report_frames(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    found = reports.frames(scanned(spark, sf_dir, "secret-like"), texts.lines(documents), "doc_id")
    return found.select("doc_id", "line", "start", "shown", F.length("t").cast("long").alias("n_chars"))


# -- corpus reports


@query(oracles.CONTAMINATION)
def contamination_match(spark, sf_dir):
    """Analogue: documents and benchmark items that share a whole line (a fingerprint equi join)."""
    lines = texts.lines(read(spark, sf_dir, "documents")).select("doc_id", "t")
    items = texts.lines(read(spark, sf_dir, "benchmark"), "item_id").select("item_id", "t")
    return lines.filter("length(t) > 0").join(items, "t").select("doc_id", "item_id").distinct()


@query(oracles.ADJUDICATION)
def adjudication_cover(spark, sf_dir):
    found = all_diagnostics(spark, sf_dir).select("doc_id").distinct().withColumn("f", F.lit(1))
    labels = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("l", F.lit(1))
    both = found.join(labels, "doc_id", "full")
    return both.agg(*(F.sum(c.cast("long")).alias(n) for n, c in (("both", F.col("f").isNotNull() & F.col("l").isNotNull()), ("unjudged", F.col("l").isNull()), ("unfounded", F.col("f").isNull()))))


CLASSES = ["true-positive", "false-positive", "noise"]


@query(oracles.CLASSIFICATION)
def classification_counts(spark, sf_dir):
    """Counts in the dimension's order, zero rows dropped."""
    kind = F.when(F.col("toxic") == 1, "true-positive").when(F.col("quality") == 1, "false-positive").otherwise("noise")
    counts = read(spark, sf_dir, "labels").withColumn("classification", kind).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "classification").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ord", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("classification"))).orderBy("lang", "ord")


@query(oracles.GAPS)
def gap_counts(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "missing").otherwise("different")
    return read(spark, sf_dir, "lineitem").groupBy(kind.alias("kind"), F.col("l_linestatus").alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@query(oracles.RULE_QUEUE)
def rule_queue(spark, sf_dir):
    """Evidence of each (rule, disposition) in input order, not-actionable gaps dropped."""
    own = all_diagnostics(spark, sf_dir).filter("severity = 'error' or rule_id = 'license-line'").withColumn("disposition", F.when(F.col("doc_id") % 2 == 0, "open").when(F.col("doc_id") % 3 == 0, "not-actionable").otherwise("planned"))
    kept = own.filter("disposition <> 'not-actionable'")
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "line", "start")))
    out = kept.groupBy("rule_id", "disposition").agg(ordered.alias("e"))
    return out.select("rule_id", "disposition", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["line"].cast("string"))), ",").alias("evidence"))


@query(oracles.PROFILE)
def profile_summary(spark, sf_dir):
    """Analogue: sums and conditional counts of measurements by profile."""
    own = read(spark, sf_dir, "lineitem")
    return own.groupBy(F.col("l_returnflag").alias("profile")).agg(
        F.count(F.lit(1)).alias("repositories"), F.sum((F.col("l_quantity") > 25).cast("long")).alias("large"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        F.max("l_shipdate").alias("latest"),
    )


@query(oracles.MULTISET)
def multiset_except(spark, sf_dir):
    """Findings of rules by document less those of every second document's: the right multiset by counts."""
    own = all_diagnostics(spark, sf_dir).select("doc_id", "rule_id")
    return own.exceptAll(own.filter("doc_id % 2 = 0"))


# -- streams, in their batch forms


@query(oracles.LATEST)
def events_latest_version(spark, sf_dir):
    return versions.latest(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


@query(oracles.DEBOUNCE)
def events_debounce(spark, sf_dir):
    return versions.debounced(read(spark, sf_dir, "events"), "user_id", "ts", "2 HOURS", "event_id").select("event_id", "user_id", "ts")


@query(oracles.SESSIONS)
def events_sessions(spark, sf_dir):
    return versions.bursts(read(spark, sf_dir, "events"), "user_id", "ts", "2 hours")


@query(oracles.GENERATIONS)
def events_generation_drop(spark, sf_dir):
    """Results (events) that still belong to their user's newest generation."""
    own = read(spark, sf_dir, "events")
    newest = own.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return versions.current(own, newest, ["user_id", "event_id"]).select("event_id", "user_id", "event_type")


@query(oracles.COALESCED)
def events_coalesced(spark, sf_dir):
    own = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("path"))
    return versions.coalesced(own, "user_id", "path", 4).withColumn("paths", F.array_join("paths", ","))


# -- fixpoints and bounds


@query(oracles.CLOSURE)
def import_closure(spark, sf_dir):
    """Nations as packages that import the nations whose keys their own divides into and the next one."""
    keys = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    edges = keys.select("src", F.explode(F.array(F.col("src") * 2 + 1, F.col("src") * 3 + 2)).alias("dst")).join(keys.select(F.col("src").alias("dst")), "dst")
    return graph.closure(keys.select(F.col("src").alias("origin"), F.col("src").alias("node")), edges)


@query(oracles.TOPOLOGICAL)
def topological_order(spark, sf_dir):
    keys = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    edges = keys.select(F.col("node").alias("src"), F.floor(F.col("node") / 2).cast("int").alias("dst")).filter("src <> dst")
    return graph.topological(keys, edges)


@query(oracles.REVERSE)
def incremental_affected(spark, sf_dir):
    """Parts as packages that need the part of half their key: what is to be done again after two of them have changed."""
    keys = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = keys.select(F.col("node").alias("src"), F.floor(F.col("node") / 2).cast("long").alias("dst")).filter("src <> dst")
    return graph.affected(keys.filter("node in (3, 7)"), edges)


@query(oracles.PRUNE)
def cache_prune(spark, sf_dir):
    own = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("modified"), F.col("o_totalprice").cast("long").alias("size"))
    return retention.pruned(own, 8, 900_000, ["store"]).select("store", "key", "kept")


@query(oracles.LRU)
def lru_bound(spark, sf_dir):
    """Orders of a customer, most recent first; one that would overflow is skipped and the next is tried."""
    own = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("store")).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("long").alias("size"))), asc=False).alias("items"))
    kept = retention.admitted(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))), 3, 500_000)
    return own.select("store", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@query(oracles.WAVES)
def package_waves(spark, sf_dir):
    """Line items of an order packed into waves of at most three and sixty units."""
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("size")))).alias("x"))
    found = retention.waves(F.transform("x", lambda i: i["size"]), 3, 60)
    return own.select("l_orderkey", F.array_join(F.transform(found, lambda w: w.cast("string")), ",").alias("waves"))


@query(oracles.TURNS)
def conversation_turn_order(spark, sf_dir):
    """Analogue of sibling checks: turns with the role of the turn before."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(own).alias("before"))
    return turns.filter("role = before or (before is null and role <> 'user')").select("conv_id", "turn", "role")


@query(oracles.PAGE_TAGS)
def page_link_tokens(spark, sf_dir):
    """Analogue of a token rule: start tags of pages, counted."""
    tags = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1)).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
