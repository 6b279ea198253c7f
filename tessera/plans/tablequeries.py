"""Queries of scalar functions and of a run's summaries over the driver's tables, with their DuckDB twins.

Most make their input from a table's columns by a formula, so that the SQL can tell the outcome from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import summaries

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


# -- scalar functions


@query(r"SELECT doc_id, CAST(length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM (SELECT doc_id, text || repeat('😀', CAST(doc_id % 4 AS INTEGER)) || 'é' AS t FROM documents WHERE text IS NOT NULL)")
def utf16_positions(spark, sf_dir):
    own = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text(F.col("text"), F.repeat(F.lit("😀"), (F.col("doc_id") % 4).cast("int")), "é").alias("t"))
    return own.select("doc_id", scalars.utf16_units(F.col("t")).cast("long").alias("units"))


@query("SELECT p_partkey, CAST(2 * (p_size % 5) + length(p_name) + 1 AS BIGINT) AS cells FROM part")
def cell_widths(spark, sf_dir):
    own = text(F.repeat(F.lit("漢"), (F.col("p_size") % 5).cast("int")), F.col("p_name"), "e\u0301")
    return read(spark, sf_dir, "part").select("p_partkey", scalars.cell_width(own).cast("long").alias("cells"))


@query("SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) AS at, p_partkey % 7 IN (0, 1, 3, 6) AS fits, CASE WHEN p_partkey % 7 IN (0, 1, 3, 6) THEN CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 3 THEN 'aé' ELSE 'aé漢' END END AS head FROM part")
def byte_boundaries(spark, sf_dir):
    data, at = F.encode(F.lit("aé漢"), "UTF-8"), (F.col("p_partkey") % 7).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", at.alias("at"), scalars.at_boundary(data, at).alias("fits"), scalars.byte_slice(data, F.lit(0), at).alias("head"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS BIGINT) AS n, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def lines_kept_whole(spark, sf_dir):
    """Lines with their ends put together are the text."""
    own = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", scalars.lines_with_ends(F.col("text")).alias("x"))
    return own.select("doc_id", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", ""), 256).alias("digest"))


@query("SELECT s_suppkey, s_suppkey % 8 = 0 AS portable FROM supplier")
def portable_paths(spark, sf_dir):
    shapes = F.array(*(F.lit(x) for x in ("a/b.go", "/a/b.go", "a//b.go", "a/./b.go", "../b.go", "a\\b.go", "C:/b.go", "a/b\u0001.go")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", scalars.portable(F.element_at(shapes, (F.col("s_suppkey") % 8 + 1).cast("int"))).alias("portable"))


@query("SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS inside FROM supplier")
def paths_inside(spark, sf_dir):
    shapes = F.array(*(F.lit(x) for x in ("src/a", "src/a/b.go", "src/ab/c.go", "src")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", scalars.inside(F.element_at(shapes, (F.col("s_suppkey") % 4 + 1).cast("int")), F.lit("src/a")).alias("inside"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/x/' || p_size || '/' || p_partkey WHEN 1 THEN '../' || p_size WHEN 2 THEN '.' WHEN 3 THEN '/' || p_size ELSE 'a/' || p_size END AS path FROM part""")
def cleaned_paths(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    shapes = F.array(text("/x/", n, "/./y//../", k), text("a/../../", n, "/"), F.lit("a/.."), text("/../../", n), text("a/b/../", n, "/./"))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.cleaned(F.element_at(shapes, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("path"))


@query("SELECT n_nationkey, 'file:///tmp/' || replace(n_name, ' ', '%20') || '%20x%25/%C3%BC~.go' AS uri FROM nation")
def file_uris(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", scalars.file_uri(text("/tmp/", F.col("n_name"), " x%/ü~.go")).alias("uri"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size <= 21 WHEN 1 THEN p_size <= 5 WHEN 2 THEN true END AS fits FROM part")
def version_floor(spark, sf_dir):
    """Whether a rule's version is at most the file's."""
    n = F.col("p_size").cast("string")
    a = F.array(text("go1.", n), text("go1.21.", n), F.lit("v1.2"), F.lit("tip"))
    b = F.array(F.lit("go1.21.0"), F.lit("1.21.5"), F.lit("1.10"), F.lit("go1.21"))
    at = (F.col("p_partkey") % 4 + 1).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", scalars.not_newer(F.element_at(a, at), F.element_at(b, at)).alias("fits"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) <= DATE '1995-06-17' ELSE false END AS expired FROM orders""")
def strict_dates(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    shapes = F.array(d, text(" ", d), F.lit("1995-2-3"), F.lit("1995-02-30"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.expired(F.element_at(shapes, (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit("1995-06-17").cast("date")).alias("expired"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN 'b' || n_nationkey ELSE 'a' END AS x, 'a' AS y, CASE WHEN n_regionkey % 2 = 1 THEN 'b' || n_nationkey END AS z FROM nation")
def merged_maps(spark, sf_dir):
    first = F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("a"))
    second = F.create_map(F.when(F.col("n_regionkey") % 2 == 0, "x").otherwise("z"), text("b", F.col("n_nationkey").cast("string")))
    own = read(spark, sf_dir, "nation").select("n_nationkey", scalars.later_wins(first, second).alias("m"))
    return own.select("n_nationkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "xyz"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS maximum, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) + 5 END AS total FROM part")
def checked_numbers(spark, sf_dir):
    """Options within bounds; a sum that doesn't fit a long is null."""
    n = F.col("p_size").cast("long")
    other = F.when(F.col("p_partkey") % 2 == 0, F.lit(5).cast("long")).otherwise(F.lit(2**63 - 1).cast("long"))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.in_bounds(n, 1, 100, "maximum").alias("maximum"), scalars.added(n, other).alias("total"))


@query("SELECT n_nationkey, sha256(unhex(printf('%016x', strlen(n_name))) || encode(n_name) || unhex(printf('%016x', strlen(CAST(n_regionkey AS VARCHAR)))) || encode(CAST(n_regionkey AS VARCHAR))) AS key FROM nation")
def cache_keys(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", scalars.keyed(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("key"))


@query("SELECT s_suppkey, 'example.com/Team/r' || s_suppkey AS url FROM supplier")
def repository_urls(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    shapes = F.array(text("https://Example.com/Team/r", k), text("ssh://git@example.com/Team/r", k, ".git"), text("git@EXAMPLE.com/Team/r", k, "/"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", scalars.plain_url(F.element_at(shapes, (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("url"))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '\\x?', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def terminal_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2(scalars.escaped(F.col("text")), 256).alias("digest"))


# -- a run's summaries


@query("SELECT l_returnflag AS rule_id, l_linestatus AS tier, count(*) AS calls, CAST(sum(l_linenumber) AS BIGINT) AS duration, CAST(sum(l_orderkey) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL")
def rule_cost(spark, sf_dir):
    """Analogue: line items as calls of rules."""
    own = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule_id"), F.col("l_linestatus").alias("tier"), F.col("l_linenumber").cast("long").alias("duration"), F.col("l_orderkey").cast("long").alias("bytes"))
    return summaries.cost(own, "rule_id", "tier")


@query("""SELECT user_id, count(*) FILTER (WHERE k = 0) AS hits, count(*) FILTER (WHERE k = 1) AS misses, count(*) FILTER (WHERE k = 2) AS invalidations, count(*) FILTER (WHERE k = 3) AS writes,
  count(*) FILTER (WHERE k < 3) AS lookups FROM (SELECT user_id, event_id % 4 AS k FROM events) GROUP BY user_id""")
def cache_counts(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("hit", "miss", "invalidation", "write")))
    own = read(spark, sf_dir, "events").select("user_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("outcome"))
    return summaries.cache_outcomes(own, "user_id")


@query("SELECT count(*) AS findings, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, count(*) FILTER (WHERE l_returnflag <> 'R') AS warnings, count(DISTINCT l_orderkey) AS files, count(DISTINCT l_linestatus) AS rules FROM lineitem")
def run_summary(spark, sf_dir):
    """Analogue: line items as findings of an order's file."""
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linestatus").alias("rule_id"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warn").alias("severity"))
    return summaries.summary(own)


@query("""SELECT l_orderkey, CASE WHEN count(*) = count(s) AND min(s) = max(s) THEN min(s) END AS state FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 5 <> 0 THEN l_returnflag END AS s FROM lineitem) GROUP BY l_orderkey""")
def met_states(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").withColumn("s", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_returnflag")))
    return own.groupBy("l_orderkey").agg(summaries.met(F.col("s")).alias("state"))


@query("SELECT l_orderkey, bool_and(l_linestatus = 'F') AS always, bit_or(CAST(l_linenumber AS INTEGER)) AS kinds, bit_and(CAST(l_linenumber AS INTEGER)) AS guaranteed FROM lineitem GROUP BY l_orderkey")
def effect_summary(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linestatus") == "F").alias("happens"), F.col("l_linenumber").cast("int").alias("kinds"))
    return summaries.effects(own, "l_orderkey")


@query("SELECT 'f' || ps AS path, min('p' || l_suppkey) AS package FROM (SELECT l_partkey AS ps, l_suppkey FROM lineitem) GROUP BY ps")
def file_owners(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select(text("f", F.col("l_partkey").cast("string")).alias("path"), text("p", F.col("l_suppkey").cast("string")).alias("package"))
    return summaries.owners(own)


@query("""SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/x/a.go' AS path,
  CASE WHEN n_nationkey % 3 = 0 THEN 'r' || n_regionkey || '/n' || n_nationkey WHEN n_regionkey < 3 THEN 'r' || n_regionkey END AS root,
  CASE WHEN n_nationkey % 3 = 0 THEN '1.' || n_nationkey WHEN n_regionkey < 3 THEN '2.' || n_regionkey END AS value FROM nation""")
def version_roots(spark, sf_dir):
    """The nearest folder with a version of its own: some nations' and some regions'."""
    own = read(spark, sf_dir, "nation")
    r, n = (F.col(c).cast("string") for c in ("n_regionkey", "n_nationkey"))
    files = own.select(text("r", r, "/n", n, "/x/a.go").alias("path"))
    roots = own.filter("n_nationkey % 3 = 0").select(text("r", r, "/n", n).alias("folder"), text("1.", n).alias("value"))
    regions = read(spark, sf_dir, "region").filter("r_regionkey < 3").select(text("r", F.col("r_regionkey").cast("string")).alias("folder"), text("2.", F.col("r_regionkey").cast("string")).alias("value"))
    return summaries.nearest_ancestor(files, roots.unionByName(regions))


@query("SELECT l_orderkey, CAST(code AS INTEGER) AS code, min(l_linenumber) AS place FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS code, max(l_suppkey % 7) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE code = m GROUP BY ALL")
def worst_outcome(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), (F.col("l_suppkey") % 7).cast("int").alias("code"))
    return summaries.worst(own, "l_orderkey")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN p_name END AS value, CASE WHEN p_partkey % 6 = 0 THEN 'hit' ELSE 'miss' END AS outcome FROM part")
def cache_reads(spark, sf_dir):
    """Every third part is cached; odd ones' content has another digest."""
    own = read(spark, sf_dir, "part")
    digest = F.when(F.col("p_partkey") % 2 == 0, F.sha2("p_name", 256)).otherwise("x")
    entries = own.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), digest.alias("digest"))
    return summaries.cached(own.select(F.col("p_partkey").alias("key")), entries)


@query("SELECT p_partkey AS key, p_name AS value, CASE WHEN p_partkey % 3 <> 0 THEN 'written' WHEN p_partkey % 2 = 0 THEN 'kept' ELSE 'conflict' END AS status FROM part")
def cache_writes(spark, sf_dir):
    own = read(spark, sf_dir, "part")
    old = own.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("other").alias("value"))
    return summaries.put(old, own.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")))


@query("""SELECT l_orderkey AS path, '[' || string_agg('{"rule_id":"' || r || '","message_key":"' || m || '","source_fingerprint":"' || f || '","count":' || n || '}', ',' ORDER BY r, m, f, n) || ']' AS document
FROM (SELECT l_orderkey, l_linestatus AS r, l_returnflag AS m, CAST(l_suppkey AS VARCHAR) AS f, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def baseline_documents(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linestatus").alias("rule_id"), F.col("l_returnflag").alias("message_key"), F.col("l_suppkey").cast("string").alias("source_fingerprint")).agg(F.count(F.lit(1)).alias("count"))
    return summaries.rendered_baseline(own)


@query("""SELECT path, ord, "group" FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY path ORDER BY ord) AS INTEGER) AS "group" FROM (
  SELECT l_orderkey AS path, l_linenumber AS ord, CASE WHEN (l_linenumber * 2 - l_linenumber % 2) - lag(l_linenumber * 2 - l_linenumber % 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1 THEN 1 ELSE 0 END AS b FROM lineitem))""")
def import_blocks(spark, sf_dir):
    """Analogue: line items as import specs, some with a blank line before them."""
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") * 2 - F.col("l_linenumber") % 2).alias("line"), F.col("l_linestatus").alias("import_path"))
    return summaries.import_groups(own).select("path", "ord", "group")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 64 AS admitted FROM events")
def queue_bound(spark, sf_dir):
    return summaries.bounded_queue(read(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 64)


@query("""SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'run' WHEN event_id = max(CASE WHEN event_id % 3 <> 0 THEN event_id END) OVER (PARTITION BY user_id) THEN 'pending' ELSE 'cancelled' END AS state FROM events""")
def pending_requests(spark, sf_dir):
    own = read(spark, sf_dir, "events").select("event_id", "user_id")
    return summaries.at_most_one_pending(own, "user_id", "event_id", F.col("event_id") % 3 != 0)
