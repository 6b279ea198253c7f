"""DuckDB SQL for the registered queries, written from the operators' definitions and not from their Spark plans."""

from __future__ import annotations

LONG = 400
SECRET = 'token = "[0-9a-f]{40}"'
ADDRESS = "[0-9A-Za-z.]+@[0-9a-z]+\\.example\\.com"
LICENSE = "(?:licensed under|Licensed under|Released under|All rights reserved)"

_LINES = """
texts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line, l[i] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM texts))
"""


def _row(rule: str, key: str, start: str, end: str, source: str) -> str:
    return f"SELECT doc_id, '{rule}' AS rule_id, line, CAST({start} AS BIGINT) AS start, CAST({end} AS BIGINT) AS \"end\", '{key}' AS message_key FROM {source}"


def _match(rule: str, key: str, pattern: str) -> str:
    before = f"length(regexp_extract(t, '^(.*?)(?:{pattern})', 1))"
    return _row(rule, key, before, f"{before} + length(regexp_extract(t, '({pattern})', 1))", f"lines WHERE regexp_matches(t, '{pattern}')")


_RULES = {
    "long-line": _row("long-line", "long", str(LONG), "length(t)", f"lines WHERE length(t) > {LONG}"),
    "trailing-space": _row("trailing-space", "trailing", "length(regexp_replace(t, '[ \\t]+$', ''))", "length(t)", "lines WHERE regexp_matches(t, '[ \\t]$')"),
    "secret-like": _match("secret-like", "secret", SECRET),
    "address-like": _match("address-like", "address", ADDRESS),
    "license-line": _match("license-line", "license", LICENSE),
    "duplicate-line": _row("duplicate-line", "duplicate", "0", "length(t)", "(SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY line) AS k FROM lines) WHERE k = 2 AND length(t) > 10"),
    "adjacent-equal": _row("adjacent-equal", "adjacent", "0", "length(t)", "(SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM lines) WHERE t = b AND length(t) > 10"),
}
_FOUND = "found AS (" + " UNION ALL ".join(_RULES.values()) + ")"
_DIAGNOSTICS = f"{_LINES}, {_FOUND}, d AS (SELECT *, CASE WHEN rule_id = 'secret-like' THEN 'error' ELSE 'warn' END AS severity FROM found)"
_WITH = f"WITH {_DIAGNOSTICS}"
_PLACE = 'doc_id, line, start, "end"'


#: Texts with two spaces at the end of each line of every third document: the tables' own lines have none.
_SPACED = _LINES.replace("string_split(text, chr(10))", "string_split(CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), '  ' || chr(10)) ELSE text END, chr(10))")


def finding(rule_id: str) -> str:
    if rule_id == "trailing-space":
        return f"WITH {_SPACED} {_RULES[rule_id]}"
    return f"WITH {_LINES} {_RULES[rule_id]}"


DOC_METADATA = """
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines,
  CASE WHEN strpos(text, chr(10)) = 0 THEN 'none' WHEN strpos(text, chr(13) || chr(10)) = 0 THEN 'lf'
    WHEN NOT regexp_matches(text, '(^|[^\\r])\\n') THEN 'crlf' ELSE 'mixed' END AS newline,
  ends_with(text, chr(10)) AS final_newline, sha256(text) AS digest
FROM documents WHERE text IS NOT NULL
"""
DOC_LINES = f"WITH {_LINES} SELECT doc_id, line, CAST(length(t) AS BIGINT) AS n_chars FROM lines"
LINE_POSITIONS = f"""
WITH {_LINES}, starts AS (
  SELECT doc_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM lines
), wanted AS (SELECT doc_id, strlen(text) // 2 AS "offset" FROM documents)
SELECT w.doc_id, CAST(w."offset" AS BIGINT) AS "offset", max(s.line) AS line, w."offset" - max(s.s) + 1 AS "column"
FROM wanted w JOIN starts s ON s.doc_id = w.doc_id AND s.s <= w."offset" GROUP BY w.doc_id, w."offset"
"""
OVERLAY = """
SELECT d.doc_id, sha256(coalesce(p.html, d.text)) AS digest, p.html IS NOT NULL AS overlaid FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
"""
DIAGNOSTICS_ALL = f"{_WITH} SELECT {_PLACE}, rule_id, severity, message_key FROM d"

_DIRECTIVES = """
directives AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS first, CAST(1073741824 AS BIGINT) AS last, CAST(0 AS BIGINT) AS ord FROM labels WHERE toxic = 1
  UNION ALL
  SELECT l.doc_id, CAST(r.a AS BIGINT), CAST(r.b AS BIGINT), CAST(r.o AS BIGINT) FROM labels l, (VALUES (1, 3, 0), (2, 6, 1), (5, 9, 2)) r(a, b, o) WHERE l.toxic = 0
)
"""
_MET = """
met AS (SELECT d.*, (SELECT min(x.ord) FROM directives x WHERE x.doc_id = d.doc_id AND x.first <= d.line AND d.line < x.last) AS directive FROM d)
"""
_CHANGED = """
ranges AS (
  SELECT doc_id, CAST(a AS BIGINT) AS first, a + doc_id % 4 AS last FROM (SELECT doc_id, unnest([1, 4, 8, 20]) AS a FROM documents WHERE doc_id % 4 <> 3)
)
"""
SUPPRESS_APPLY = f"{_WITH}, {_DIRECTIVES}, {_MET} SELECT {_PLACE}, rule_id, message_key, directive FROM met"
SUPPRESS_UNUSED = f"""
{_WITH}, {_DIRECTIVES}, {_MET}
SELECT doc_id, ord, first, last FROM directives x WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.doc_id = x.doc_id AND met.directive = x.ord)
"""
RULE_COUNTS = f"""
{_WITH}, {_DIRECTIVES}, {_MET}, {_CHANGED}, states AS (
  SELECT rule_id, CASE WHEN directive IS NOT NULL THEN 'suppressed'
    WHEN EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = met.doc_id AND r.first <= met.line AND met.line <= r.last) THEN 'visible' ELSE 'preexisting' END AS s FROM met
), rules AS (SELECT unnest([{", ".join(f"'{r}'" for r in _RULES)}]) AS rule_id)
SELECT rules.rule_id, count(s) AS findings, count(s) FILTER (WHERE s = 'visible') AS visible, count(s) FILTER (WHERE s = 'preexisting') AS preexisting,
  count(s) FILTER (WHERE s = 'suppressed') AS suppressed, count(s) FILTER (WHERE s = 'baselined') AS baselined
FROM rules LEFT JOIN states USING (rule_id) GROUP BY rules.rule_id
"""
# The registry's rows, and what the policy of the catalogue selects of them.
_REGISTRY = """
registry(rule_id, tier, depth, presets) AS (VALUES ('long-line', 'lexical', 0, ['style']), ('trailing-space', 'lexical', 0, ['style']), ('secret-like', 'syntax', 1, ['suspicious', 'correctness']),
  ('address-like', 'syntax', 1, ['suspicious']), ('license-line', 'syntax', 1, ['restriction']), ('duplicate-line', 'types', 2, ['pedantic']), ('adjacent-equal', 'types', 2, ['correctness'])),
chosen AS (SELECT * FROM registry WHERE list_has_any(presets, ['style', 'suspicious', 'correctness', 'pedantic', 'restriction']))
"""
TIER_REASONS = f"WITH {_REGISTRY} SELECT tier, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM chosen GROUP BY tier"
EXIT_CODE = f"{_WITH} SELECT CAST(CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 1 ELSE 0 END AS INTEGER) AS code FROM d"
SELECTED_TIER = f"WITH {_REGISTRY} SELECT arg_max(tier, depth) AS tier FROM chosen"
POLICY_RESOLVE = """
WITH rules(rule_id, presets) AS (VALUES ('long-line', ['style']), ('trailing-space', ['style']), ('secret-like', ['suspicious', 'correctness']),
  ('address-like', ['suspicious']), ('license-line', ['restriction']), ('duplicate-line', ['pedantic']), ('adjacent-equal', ['correctness'])),
s0 AS (SELECT *, CASE WHEN rule_id = 'long-line' THEN 'error' WHEN len(list_intersect(presets, ['suspicious', 'pedantic'])) > 0 THEN 'warn' ELSE 'allow' END AS v FROM rules),
s1 AS (SELECT rule_id, presets, CASE WHEN list_contains(presets, 'suspicious') THEN 'error' ELSE v END AS v FROM s0),
s2 AS (SELECT rule_id, CASE WHEN rule_id = 'address-like' THEN 'allow' ELSE v END AS v FROM s1),
s3 AS (SELECT rule_id, CASE WHEN v = 'warn' THEN 'error' ELSE v END AS v FROM s2),
s4 AS (SELECT rule_id, CASE WHEN rule_id = 'long-line' THEN 'warn' ELSE v END AS severity FROM s3)
SELECT rule_id, severity FROM s4 WHERE severity <> 'allow' AND rule_id <> 'duplicate-line'
"""
PATH_OVERRIDES = """
WITH o(ord, pattern, rule_id, severity) AS (VALUES (0, '^src1[^/]*$', 'long-line', 'error'), (1, '^src[^/]$', 'license-line', 'allow'), (2, '.*', 'secret-like', 'error'),
  (3, '^src1[^/]$', 'long-line', 'warn'), (4, '^src2$', 'license-line', 'error'))
SELECT path, rule_id, arg_max(severity, ord) AS severity FROM (SELECT DISTINCT source AS path FROM documents) p JOIN o ON regexp_matches(p.path, o.pattern) GROUP BY path, rule_id
"""
DOMINANT = """
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1
"""
_BASELINE = "base AS (SELECT doc_id, rule_id, message_key, count(*) AS \"count\" FROM d WHERE doc_id % 2 = 0 OR line <= 2 GROUP BY ALL)"
BASELINE_GENERATE = f"{_WITH}, {_BASELINE} SELECT * FROM base"


def baseline_apply(hidden: bool) -> str:
    return f"""
{_WITH}, {_BASELINE}, ranked AS (
  SELECT d.*, row_number() OVER (PARTITION BY doc_id, rule_id, message_key ORDER BY line, start, "end") AS r FROM d
)
SELECT r.doc_id, r.line, r.start, r."end", r.rule_id, r.message_key FROM ranked r LEFT JOIN base b USING (doc_id, rule_id, message_key)
WHERE {'' if hidden else 'NOT '}(r.r <= coalesce(b."count", 0))
"""


_AGED = """
aged AS (
  SELECT doc_id, rule_id, message_key, count(*) + doc_id % 2 AS "count", CASE doc_id % 3 WHEN 0 THEN '2026-01-01' WHEN 1 THEN '2027-01-01' END AS expires_on FROM d GROUP BY doc_id, rule_id, message_key
), counts AS (SELECT doc_id, rule_id, message_key, count(*) AS n FROM d GROUP BY ALL)
"""
BASELINE_STALE = f"""
{_WITH}, {_AGED} SELECT doc_id, rule_id, message_key, "count" - coalesce(n, 0) AS remaining FROM aged LEFT JOIN counts USING (doc_id, rule_id, message_key)
WHERE doc_id % 5 <> 0 AND (expires_on IS NULL OR expires_on > '2026-08-01') AND "count" - coalesce(n, 0) > 0
"""
BASELINE_EXPIRED = f"{_WITH}, {_AGED} SELECT doc_id, rule_id, message_key, expires_on FROM aged WHERE doc_id % 5 <> 0 AND expires_on <= '2026-08-01'"
SUPERSEDE = f"""
{_WITH} SELECT {_PLACE}, rule_id, message_key FROM d WHERE NOT (rule_id = 'duplicate-line' AND EXISTS (
  SELECT 1 FROM d x WHERE x.rule_id = 'adjacent-equal' AND x.doc_id = d.doc_id AND x.line = d.line AND x.start = d.start AND x."end" = d."end"))
"""


def changed(visible: bool) -> str:
    return f"""
{_WITH}, {_CHANGED} SELECT {_PLACE}, rule_id, message_key FROM d
WHERE {'' if visible else 'NOT '}EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = d.doc_id AND r.first <= d.line AND d.line <= r.last)
"""


MERGE_RANGES = f"""
WITH {_CHANGED}, covered AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS x FROM ranges),
islands AS (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS g FROM covered)
SELECT doc_id, min(x) AS first, max(x) AS last FROM islands GROUP BY doc_id, g
"""
OWNED_FIXES = f"""
{_WITH}, {_CHANGED}, judged AS (SELECT doc_id, rule_id, EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = d.doc_id AND r.first <= d.line AND d.line <= r.last) AS own FROM d)
SELECT doc_id, rule_id, count(*) AS n_edits FROM judged GROUP BY doc_id, rule_id HAVING bool_and(own)
"""
_TARGETS = f"""
per AS (SELECT {_PLACE}, rule_id, message_key, 'linux' AS target FROM d UNION ALL SELECT {_PLACE}, rule_id, message_key, 'darwin' FROM d WHERE doc_id % 3 <> 0)
"""
TARGET_MERGE = f"{_WITH}, {_TARGETS} SELECT {_PLACE}, rule_id, message_key, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM per GROUP BY ALL"
TARGET_UNUSED = f"""
{_WITH}, {_TARGETS}, {_DIRECTIVES}, seen AS (SELECT doc_id, 'linux' AS target FROM documents UNION ALL SELECT doc_id, 'darwin' FROM documents WHERE doc_id % 3 <> 0),
used AS (
  SELECT p.doc_id, p.target, (SELECT min(x.ord) FROM directives x WHERE x.doc_id = p.doc_id AND x.first <= p.line AND p.line < x.last) AS ord
  FROM per p WHERE rule_id <> 'duplicate-line' OR target = 'linux'
), idle AS (SELECT x.doc_id, x.ord, s.target FROM directives x JOIN seen s USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = x.doc_id AND u.target = s.target AND u.ord = x.ord))
SELECT doc_id, ord FROM idle GROUP BY doc_id, ord HAVING count(*) = (SELECT count(*) FROM seen s WHERE s.doc_id = idle.doc_id)
"""
ONE_DIGEST = "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS digest FROM documents"

_EDITS = """
edits AS (
  SELECT doc_id, text, fix, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, n, k FROM (
    SELECT doc_id, text, 'a' AS fix, doc_id % 7 AS s, doc_id % 7 + doc_id % 4 AS e, '<A>' AS n, 1 AS k FROM documents
    UNION ALL SELECT doc_id, text, 'a', doc_id % 5 + 12, doc_id % 5 + 14, '', 2 FROM documents
    UNION ALL SELECT doc_id, text, 'b', doc_id % 9 + 2, doc_id % 9 + 2 + doc_id % 3, '<B>', 3 FROM documents
    UNION ALL SELECT doc_id, text, 'c', doc_id % 6 + 11, doc_id % 6 + 11, '<C>', 4 FROM documents
    UNION ALL SELECT doc_id, text, 'd', length(text) // 2, length(text) // 2 + 1, '<D>', 5 FROM documents
    UNION ALL SELECT doc_id, text, 'e', length(text), length(text), '<E>', 6 FROM documents) WHERE text IS NOT NULL AND length(text) >= greatest(s, e)
), bad AS (
  SELECT DISTINCT a.doc_id, a.fix FROM edits a JOIN edits b ON a.doc_id = b.doc_id AND a.k <> b.k AND (
    (a.s < a.e AND b.s < b.e AND a.s < b.e AND b.s < a.e) OR (a.s = a.e AND b.s = b.e AND a.s = b.s)
    OR (a.s = a.e AND b.s < a.s AND a.s < b.e) OR (b.s = b.e AND a.s < b.s AND b.s < a.e))
)
"""
FIX_CONFLICTS = f"WITH {_EDITS} SELECT DISTINCT e.doc_id, e.fix, b.fix IS NOT NULL AS conflicted FROM edits e LEFT JOIN bad b ON b.doc_id = e.doc_id AND b.fix = e.fix"
FIX_APPLIED = f"""
WITH RECURSIVE {_EDITS}, good AS (
  SELECT e.*, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, e DESC) AS r, count(*) OVER (PARTITION BY doc_id) AS total
  FROM edits e WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = e.doc_id AND b.fix = e.fix)
), steps AS (
  SELECT doc_id, text AS t, CAST(0 AS BIGINT) AS r, total FROM (SELECT DISTINCT doc_id, text, total FROM good)
  UNION ALL
  SELECT s.doc_id, substr(s.t, 1, g.s) || g.n || substr(s.t, g.e + 1), g.r, s.total FROM steps s JOIN good g ON g.doc_id = s.doc_id AND g.r = s.r + 1
)
SELECT doc_id, sha256(t) AS digest, CAST(length(t) AS BIGINT) AS chars, total AS n_edits FROM steps WHERE r = total
"""
IMPORT_CONFLICTS = """
WITH p AS (SELECT p_size AS path, p_partkey AS fix, p_type AS name, p_brand AS ip FROM part)
SELECT DISTINCT path, fix FROM p WHERE (SELECT count(DISTINCT q.ip) FROM p q WHERE q.path = p.path AND q.name = p.name) > 1
  OR (SELECT count(DISTINCT q.name) FROM p q WHERE q.path = p.path AND q.ip = p.ip) > 1
"""
SHORT_TEXT = f"""
{_WITH} SELECT doc_id, line, start, rule_id, 'doc/' || doc_id || ':' || line || ':' || (start + 1) || ': ' || severity || ': ' || message_key || ' finding [' || rule_id || ']' AS out FROM d
"""
ANNOTATIONS = f"""
{_WITH} SELECT doc_id, line, start, rule_id, '::' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=doc%3Aa%2Cb/' || doc_id || ',line=' || line || ',title=' || rule_id
  || '::100%25 of ' || message_key || '%0Ahere' AS out FROM d
"""
REPORT_JSON = f"""
{_WITH} SELECT CAST(doc_id AS VARCHAR) AS path, '{{"schema_version":1,"path":"' || doc_id || '","diagnostics":[' || string_agg(
  '{{"line":' || line || ',"start":' || start || ',"end":' || "end" || ',"rule_id":"' || rule_id || '","severity":"' || severity || '","message_key":"' || message_key || '"}}',
  ',' ORDER BY line, start, "end", rule_id) || ']}}' AS document FROM d GROUP BY doc_id
"""
FRAMES = f"""
{_WITH} SELECT d.doc_id, d.line, d.start, l.line AS shown, CAST(length(l.t) AS BIGINT) AS n_chars FROM d JOIN lines l ON l.doc_id = d.doc_id AND l.line BETWEEN d.line - 1 AND d.line + 1 WHERE d.rule_id = 'secret-like'
"""
CONTAMINATION = f"""
WITH {_LINES}, items AS (SELECT item_id, unnest(string_split(text, chr(10))) AS t FROM benchmark)
SELECT DISTINCT l.doc_id, i.item_id FROM lines l JOIN items i ON l.t = i.t WHERE length(l.t) > 0
"""
ADJUDICATION = f"""
{_WITH}, f AS (SELECT DISTINCT doc_id FROM d), l AS (SELECT DISTINCT doc_id FROM labels)
SELECT CAST(count(*) FILTER (WHERE f.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS BIGINT) AS both, CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS unjudged,
  CAST(count(*) FILTER (WHERE f.doc_id IS NULL) AS BIGINT) AS unfounded FROM f FULL JOIN l ON f.doc_id = l.doc_id
"""
CLASSIFICATION = """
WITH c AS (SELECT d.lang, CASE WHEN toxic = 1 THEN 'true-positive' WHEN quality = 1 THEN 'false-positive' ELSE 'noise' END AS classification FROM labels JOIN documents d USING (doc_id))
SELECT lang, classification, count(*) AS n, CAST(list_position(['true-positive', 'false-positive', 'noise'], classification) AS BIGINT) AS ord FROM c GROUP BY lang, classification
"""
GAPS = "SELECT CASE WHEN l_returnflag = 'R' THEN 'missing' ELSE 'different' END AS kind, l_linestatus AS disposition, count(*) AS n FROM lineitem GROUP BY ALL"
RULE_QUEUE = f"""
{_WITH}, q AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'open' WHEN doc_id % 3 = 0 THEN 'not-actionable' ELSE 'planned' END AS disposition FROM d WHERE severity = 'error' OR rule_id = 'license-line')
SELECT rule_id, disposition, string_agg(doc_id || ':' || line, ',' ORDER BY doc_id, line, start) AS evidence FROM q WHERE disposition <> 'not-actionable' GROUP BY rule_id, disposition
"""
PROFILE = """
SELECT l_returnflag AS profile, count(*) AS repositories, count(*) FILTER (WHERE l_quantity > 25) AS large, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, max(l_shipdate) AS latest FROM lineitem GROUP BY l_returnflag
"""
MULTISET = f"{_WITH} SELECT doc_id, rule_id FROM d EXCEPT ALL SELECT doc_id, rule_id FROM d WHERE doc_id % 2 = 0"
LATEST = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"
DEBOUNCE = """
SELECT event_id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n > ts + INTERVAL 2 HOURS
"""
SESSIONS = """
WITH m AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, g
"""
GENERATIONS = "SELECT event_id, user_id, event_type FROM events e WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)"
COALESCED = """
SELECT user_id, count(DISTINCT event_type) AS n, count(DISTINCT event_type) > 4 AS everything, CASE WHEN count(DISTINCT event_type) > 4 THEN '' ELSE string_agg(DISTINCT event_type, ',' ORDER BY event_type) END AS paths
FROM events GROUP BY user_id
"""
CLOSURE = """
WITH RECURSIVE e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey * 2 + 1, a.n_nationkey * 3 + 2)),
r AS (SELECT n_nationkey AS origin, n_nationkey AS node, 0 AS level FROM nation UNION SELECT r.origin, e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node WHERE r.level < 30)
SELECT origin, node, CAST(min(level) AS INTEGER) AS level FROM r GROUP BY origin, node
"""
TOPOLOGICAL = """
WITH RECURSIVE r AS (SELECT n_nationkey AS node, n_nationkey AS up, 0 AS level FROM nation UNION ALL SELECT node, up // 2, level + 1 FROM r WHERE up > 0)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY node
"""
REVERSE = """
WITH RECURSIVE r AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (3, 7) UNION SELECT p_partkey FROM part JOIN r ON p_partkey // 2 = r.node AND p_partkey <> r.node)
SELECT node FROM r
"""
PRUNE = """
WITH o AS (SELECT o_custkey AS store, o_orderkey AS key, o_orderdate AS m, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders),
f AS (SELECT *, row_number() OVER w <= 8 AND sum(size) OVER (PARTITION BY store ORDER BY m DESC, key DESC ROWS UNBOUNDED PRECEDING) <= 900000 AS fits FROM o WINDOW w AS (PARTITION BY store ORDER BY m DESC, key DESC))
SELECT store, key, bool_and(fits) OVER (PARTITION BY store ORDER BY m DESC, key DESC ROWS UNBOUNDED PRECEDING) AS kept FROM f
"""
LRU = """
WITH RECURSIVE o AS (SELECT o_custkey AS store, o_orderkey AS id, CAST(trunc(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
s AS (
  SELECT store, CAST(0 AS BIGINT) AS r, CAST('' AS VARCHAR) AS kept, CAST(0 AS BIGINT) AS used, 0 AS n FROM (SELECT DISTINCT store FROM o)
  UNION ALL
  SELECT s.store, o.r, CASE WHEN n < 3 AND used + size <= 500000 THEN kept || CASE WHEN n = 0 THEN '' ELSE ',' END || id ELSE kept END,
    CASE WHEN n < 3 AND used + size <= 500000 THEN used + size ELSE used END, CASE WHEN n < 3 AND used + size <= 500000 THEN n + 1 ELSE n END
  FROM s JOIN o ON o.store = s.store AND o.r = s.r + 1
)
SELECT store, arg_max(kept, r) AS kept FROM s GROUP BY store
"""
WAVES = """
WITH RECURSIVE o AS (SELECT l_orderkey AS k, CAST(trunc(l_quantity) AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem),
s AS (
  SELECT k, CAST(0 AS BIGINT) AS r, CAST('' AS VARCHAR) AS w, 0 AS wave, 0 AS n, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT k FROM o)
  UNION ALL
  SELECT s.k, o.r, w || CASE WHEN s.r = 0 THEN '' ELSE ',' END || (wave + CASE WHEN n >= 3 OR (n > 0 AND used + size > 60) THEN 1 ELSE 0 END),
    wave + CASE WHEN n >= 3 OR (n > 0 AND used + size > 60) THEN 1 ELSE 0 END, CASE WHEN n >= 3 OR (n > 0 AND used + size > 60) THEN 1 ELSE n + 1 END,
    CASE WHEN n >= 3 OR (n > 0 AND used + size > 60) THEN size ELSE used + size END
  FROM s JOIN o ON o.k = s.k AND o.r = s.r + 1
)
SELECT k AS l_orderkey, arg_max(w, r) AS waves FROM s GROUP BY k
"""
TURNS = """
SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE role = b OR (b IS NULL AND role <> 'user')
"""
PAGE_TAGS = "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY page_id, tag"
