"""DuckDB SQL of the registered queries, by plain definitions: exact grams instead of fingerprints, no kernels."""

from __future__ import annotations

from ..functions import constants as C
from ..functions.globs import compile_rules, expand_braces, rules_regex
from .corpus import PATHS

TOKEN = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def tokens_sql(rows: str, key: str, name: str = "tok") -> str:
    """CTEs that end in `name`(key, pos, token, line)."""
    return f"""
{name}_lines AS (SELECT {key} AS key, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM (SELECT {key}, string_split(coalesce(text, ''), chr(10)) AS ls FROM {rows})),
{name}_all AS (SELECT key, line, unnest(range(len(t))) AS i, unnest(t) AS token FROM (SELECT key, line, regexp_extract_all(body, '{TOKEN}') AS t FROM {name}_lines)),
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY line, i) - 1 AS pos, token, line FROM {name}_all)"""


def grams_sql(source: str, k: int, name: str) -> str:
    """CTE `name`(key, pos, gram): a digest of the k tokens from each place."""
    window = f"(PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    return f"{name} AS (SELECT key, pos, gram FROM (SELECT key, pos, count(*) OVER {window} AS n, md5(array_to_string(list(token) OVER {window}, ' ')) AS gram FROM {source}) WHERE n = {k})"


def runs_sql(left: str, right: str, condition: str, k: int, name: str = "runs") -> str:
    """CTE `name`(a, b, region, other, len): islands of equal k-grams on each diagonal."""
    return f"""
{name}_met AS (SELECT x.key AS a, y.key AS b, x.pos AS p, y.pos - x.pos AS d FROM {left} x JOIN {right} y ON x.gram = y.gram AND {condition}),
{name}_isles AS (SELECT a, b, d, p, p - row_number() OVER (PARTITION BY a, b, d ORDER BY p) AS isle FROM {name}_met),
{name} AS (SELECT a, b, min(p) AS region, min(p) + d AS other, count(*) + {k - 1} AS len FROM {name}_isles GROUP BY a, b, d, isle)"""


ITEMS = "(SELECT 'item' || item_id AS file, text FROM benchmark)"
DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS file, text FROM documents)"
PROBES = f"WITH {tokens_sql(ITEMS, 'file', 'it')}, {tokens_sql(DOCS, 'file', 'dt')}, {grams_sql('it', 20, 'ig')}, {grams_sql('dt', 20, 'dg')}, {runs_sql('ig', 'dg', 'x.key <> y.key', 20)}"


def _paths() -> str:
    listed = " UNION ALL ".join(f"SELECT {quoted(p)} AS path" for p in PATHS)
    return f"""paths AS ({listed}
  UNION ALL SELECT source || '/' || doc_id || '.' || lang FROM documents
  UNION ALL SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') FROM pages),
named AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base, string_split(path, '/')[1:-2] AS dirs FROM paths),
ext AS (SELECT *, CASE WHEN instr(substr(base, 2), '.') > 0 AND NOT regexp_full_match(base, '\\.\\.') THEN regexp_extract(base, '(\\.[^.]*)$', 1) ELSE '' END AS ext FROM named)"""


def _format(opted: dict[str, list[str]]) -> str:
    known = {e: f for f, names in C.FORMAT_EXTENSIONS.items() for e in names.split()}
    cases = "".join(f" WHEN e IN {any_of(x)} OR lower(e) IN {any_of(x)} THEN {quoted(f)}" for f, x in opted.items())
    plain = "".join(f" WHEN found = {quoted(e)} THEN {'NULL' if f in C.NON_CODE_FORMATS else quoted(f)}" for e, f in known.items())
    return f"""formats AS (SELECT *, CASE WHEN e = '' THEN NULL{cases} WHEN lower(e) IN {any_of(C.NON_CODE_MARKUP_EXTS)} THEN NULL{plain} END AS format
  FROM (SELECT *, substr(ext, 2) AS e, CASE WHEN substr(ext, 2) IN {any_of(list(known))} THEN substr(ext, 2) ELSE lower(substr(ext, 2)) END AS found FROM ext))"""


def _default_test(base: str = "base") -> str:
    structured = " OR ".join(f"regexp_matches(plain, {quoted(p)})" for p in C.TEST_PATHS)
    return f"""CASE WHEN lower(ext) IN {any_of(C.TEST_EXTENSIONS)} THEN true
    WHEN lower(base) IN {any_of(C.TEST_HELPERS)} THEN true
    WHEN list_has_any(list_transform(dirs, lambda x: lower(x)), {"[" + ", ".join(map(quoted, C.TEST_DIRECTORIES)) + "]"}) THEN true
    WHEN len(list_filter(dirs, lambda x: x <> '')) > 0 AND ({structured}) THEN true
    WHEN name = '' THEN false WHEN regexp_matches(name, {quoted(C.NOT_TESTS)}) THEN false
    ELSE regexp_matches(base, {quoted(C.TEST_PREFIX)}) OR regexp_matches(name, {quoted(C.TEST_PASCAL_PREFIX)}) OR regexp_matches(name, {quoted(C.TEST_SUFFIX)}) OR regexp_matches(name, {quoted(C.TEST_PASCAL_SUFFIX)}) END"""


def _rules(patterns: list[str]) -> str:
    return quoted(rules_regex(compile_rules([e for p in patterns for e in expand_braces(p)])))


#: Paths of the tables hold no backslash and no leading `./` but one; its own rules come out alike.
TESTS = "tests AS (SELECT *, regexp_replace(path, '^\\./', '') AS plain, substr(base, 1, length(base) - length(ext)) AS name FROM formats)"

SQL = {
    "tokenize_docs": f"""WITH {tokens_sql('documents', 'doc_id')}, marked AS (SELECT key, pos, line, min(pos) OVER (PARTITION BY key, token) AS first FROM tok)
SELECT d.doc_id, count(t.key)::BIGINT AS n_tokens, md5(coalesce(string_agg(t.line || ':' || t.first, ' ' ORDER BY t.pos), '')) AS digest FROM documents d LEFT JOIN marked t ON t.key = d.doc_id GROUP BY d.doc_id""",
    "token_hash": f"""WITH {tokens_sql('benchmark', 'item_id')}, words AS (SELECT DISTINCT token FROM tok),
fnv AS (SELECT token, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split('word', ''), lambda c: unicode(c)::BIGINT), [255::BIGINT], list_transform(string_split(token, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM words),
a AS (SELECT token, ((xor(h, h >> 16))::HUGEINT * 2246822507 % 4294967296)::BIGINT AS h FROM fnv),
b AS (SELECT token, ((xor(h, h >> 13))::HUGEINT * 3266489909 % 4294967296)::BIGINT AS h FROM a)
SELECT token, CASE WHEN xor(h, h >> 16) = 0 THEN 1 ELSE xor(h, h >> 16) END::BIGINT AS hash FROM b""",
    "line_spans": "SELECT doc_id, len(ls)::BIGINT AS n_lines, list_max(list_transform(ls, lambda x: length(x)))::BIGINT AS longest, len(list_filter(ls, lambda x: trim(x) = ''))::BIGINT AS blank FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)",
    "size_filter": "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 20000 THEN 'too-large' END AS reason FROM documents",
    "generated_filter": f"SELECT 'head' || i AS name, i IN (0, 1, 2, 4, 6, 7) AS is_generated FROM range(8) r(i) UNION ALL SELECT 'doc' || doc_id, regexp_matches(coalesce(text, ''), '{C.GENERATED_MARKER}') FROM documents",
    "path_classify": f"""WITH {_paths()}, {_format({})}, {TESTS}, judged AS (SELECT path, format, CASE
    WHEN regexp_matches(path, '^$|^\\.{{1,2}}$|^\\.{{0,2}}/|/$') THEN 'ignored'
    WHEN list_has_any(dirs, {"[" + ", ".join(map(quoted, C.IGNORED_DIRS)) + "]"}) THEN 'ignored'
    WHEN format IS NULL THEN 'unsupported-format'
    WHEN regexp_matches(path, {_rules([*C.NOISE_PATTERNS, "docs/", "*.{zig,sql}"])}) THEN 'ignored'
    WHEN {_default_test()} THEN 'ignored' END AS reason FROM tests)
SELECT path, CASE WHEN reason IS NULL THEN format END AS format, reason FROM judged""",
    "test_path_flag": f"""WITH {_paths()}, {_format({})}, {TESTS}
SELECT path, CASE WHEN plain IN ('', '.') THEN false WHEN plain NOT LIKE '/%' AND regexp_matches(plain, {_rules(["e2e/"])}) THEN false
  WHEN plain NOT LIKE '/%' AND regexp_matches(plain, {_rules(["lib/**/deep.*"])}) THEN true ELSE {_default_test()} END AS is_test FROM tests""",
    "format_detect": f"WITH {_paths()}, {_format({'markdown': ['md'], 'json': ['json']})} SELECT path, format FROM formats",
    "content_dedupe": "SELECT concat_ws(':', lang, md5(text)) AS content_key, count(*)::BIGINT AS n_files, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "kgram_hash": f"""WITH {tokens_sql(DOCS, 'file')}, {grams_sql('tok', 5, 'g')}, marked AS (SELECT key, pos, min(pos) OVER (PARTITION BY key, gram) AS first FROM g)
SELECT CAST(d.doc_id AS VARCHAR) AS file, count(t.key)::BIGINT AS n_grams, md5(coalesce(string_agg(CAST(t.first AS VARCHAR), ' ' ORDER BY t.pos), '')) AS digest FROM documents d LEFT JOIN marked t ON t.key = CAST(d.doc_id AS VARCHAR) GROUP BY d.doc_id""",
    "winnow_fingerprints": f"""WITH {tokens_sql(DOCS, 'file')} SELECT CAST(d.doc_id AS VARCHAR) AS file, greatest(0, count(t.key) - 9)::BIGINT AS windows, 0::BIGINT AS bare, 0::BIGINT AS wrong FROM documents d LEFT JOIN tok t ON t.key = CAST(d.doc_id AS VARCHAR) GROUP BY d.doc_id""",
    "cross_runs": f"WITH {tokens_sql(DOCS, 'file')}, {grams_sql('tok', 40, 'g')}, {runs_sql('g', 'g', 'x.key < y.key', 40)} SELECT a AS file, b AS other_file, region, other, len FROM runs",
    "benchmark_contamination": f"{PROBES} SELECT a AS file, b AS other_file, region, other, len FROM runs",
    "self_runs_all": f"""WITH {tokens_sql("(SELECT 'page' || page_id AS file, html AS text FROM pages)", 'file')}, {grams_sql('tok', 10, 'g')}, {runs_sql('g', 'g', 'x.key = y.key AND x.pos < y.pos', 10)},
clipped AS (SELECT a AS file, other AS region, region AS other, least(len, other - region) AS len FROM runs) SELECT * FROM clipped WHERE len >= 10""",
    "trim_partial_lines": f"""{PROBES}, own AS (SELECT DISTINCT a AS file, region, len FROM runs),
edges AS (SELECT key, line, min(pos) AS low, max(pos) AS high FROM it GROUP BY key, line),
spot AS (SELECT it.key, it.pos, e.low, e.high FROM it JOIN edges e ON e.key = it.key AND e.line = it.line),
lead AS (SELECT o.*, CASE WHEN s.low < region AND least(s.high, region + len - 1) - region + 1 <= region - s.low THEN least(s.high, region + len - 1) + 1 ELSE region END AS start, region + len AS stop FROM own o JOIN spot s ON s.key = o.file AND s.pos = region),
tail AS (SELECT l.*, CASE WHEN start < stop AND s.high >= stop AND stop - greatest(s.low, start) <= s.high - stop + 1 THEN greatest(s.low, start) ELSE stop END AS ending FROM lead l JOIN spot s ON s.key = l.file AND s.pos = stop - 1)
SELECT file, region, len, start, ending - start AS "left" FROM tail""",
    "append_edit_new_tokens": f"""WITH {tokens_sql('documents', 'doc_id')}, cut AS (SELECT doc_id, ceil(len(string_split(coalesce(text, ''), chr(10))) / 2) AS half FROM documents)
SELECT c.doc_id, count(t.key)::BIGINT AS n_new FROM cut c LEFT JOIN tok t ON t.key = c.doc_id AND t.line > c.half GROUP BY c.doc_id""",
    "match_key": f"""{PROBES} SELECT a AS file, b AS other_file, region, len, substr(md5(a || chr(1) || b || chr(1) || string_agg(t.token, ' ' ORDER BY t.pos)), 1, 16) AS key
FROM runs JOIN it t ON t.key = a AND t.pos >= region AND t.pos < region + len GROUP BY a, b, region, other, len""",
    "index_upsert_delete": "SELECT doc_id AS file, md5(CASE WHEN lang = 'de' THEN 'v2 ' || text ELSE text END) AS content FROM documents WHERE lang <> 'es'",
    "rescan_actions": "SELECT doc_id AS file, CASE lang WHEN 'fr' THEN 'new' WHEN 'es' THEN 'gone' WHEN 'de' THEN 'changed' ELSE 'same' END AS action FROM documents",
    "file_cap": """WITH known AS (SELECT count(*) AS n FROM documents WHERE lang = 'fr'), fresh AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE lang <> 'fr')
SELECT d.doc_id AS file, d.lang = 'fr' OR f.place <= greatest(0, 500 - (SELECT n FROM known)) AS indexed FROM documents d LEFT JOIN fresh f USING (doc_id)""",
    "edit_before_lookup": "SELECT conv_id AS session, turn AS seq, md5(lag(text) OVER w) AS before, CASE WHEN row_number() OVER w = 1 THEN 'absent' ELSE 'content' END AS before_kind FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "captured_before": """WITH RECURSIVE e AS (
  SELECT user_id AS session, event_id AS seq, event_type = 'click' AS ends, coalesce(json_extract_string(props, '$.k'), '') AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
  FROM events WHERE event_type IN ('view', 'click')),
walk AS (
  SELECT session, 0::BIGINT AS n, []::STRUCT(id VARCHAR, seq BIGINT)[] AS held, NULL::BIGINT AS seq, false AS ends, NULL::BIGINT AS got FROM (SELECT DISTINCT session FROM e)
  UNION ALL SELECT e.session, e.n,
    CASE WHEN e.ends THEN list_filter(w.held, lambda x: x.id <> e.call_id)
      WHEN len(list_filter(CASE WHEN len(w.held) >= 4 THEN w.held[2:] ELSE w.held END, lambda x: x.id = e.call_id)) > 0
      THEN list_transform(CASE WHEN len(w.held) >= 4 THEN w.held[2:] ELSE w.held END, lambda x: CASE WHEN x.id = e.call_id THEN {'id': x.id, 'seq': e.seq} ELSE x END)
      ELSE list_append(CASE WHEN len(w.held) >= 4 THEN w.held[2:] ELSE w.held END, {'id': e.call_id, 'seq': e.seq}) END,
    e.seq, e.ends, list_filter(w.held, lambda x: x.id = e.call_id)[1].seq
  FROM walk w JOIN e ON e.session = w.session AND e.n = w.n + 1)
SELECT session, seq, CAST(got AS VARCHAR) AS before, CASE WHEN got IS NULL THEN 'unknown' ELSE 'content' END AS before_kind FROM walk WHERE ends""",
    "ledger_first_seen": """WITH e AS (SELECT user_id AS session, event_id AS seq, event_type, event_type || ':' || json_extract_string(props, '$.k') AS key, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY session, epoch, key ORDER BY seq) AS n FROM e WHERE event_type <> 'signup') SELECT session, seq, key, epoch::BIGINT AS epoch FROM r WHERE n = 1""",
    "delivery_routing": f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'dropped' WHEN value * 20 <= 1500 AND event_type = 'click' THEN 'in-band' WHEN event_type = 'view' THEN 'next-turn' ELSE 'aside' END AS delivery, event_type NOT IN {any_of(C.READ_ONLY_EVENTS)} AS rescan FROM events",
    "report_top4": f"{PROBES} SELECT a AS edit_id, a AS file, least(count(*), 4)::BIGINT AS shown, greatest(count(*) - 4, 0)::BIGINT AS omitted FROM runs GROUP BY a",
    "excerpts": """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, len(ls) AS n, list_transform(ls[2:9], lambda x: CASE WHEN length(x) > 200 THEN substr(x, 1, 200) || '…' ELSE x END) AS cut FROM t WHERE len(ls) > 1)
SELECT doc_id, array_to_string(CASE WHEN n > 9 THEN list_append(cut, '… (' || (n - 9) || ' more lines)') ELSE cut END, chr(10)) AS excerpt FROM c""",
    "config_merge": "SELECT 10::BIGINT AS min_tokens, 7::BIGINT AS min_lines, 10000::BIGINT AS max_files, false AS ignore_tests, 'a/**|b.{ts,tsx}|c' AS patterns",
    "brace_expand": r"SELECT * FROM (VALUES ('src/*.{ts,tsx}', 'src/*.ts|src/*.tsx'), ('{a,b{c,d}}/x', 'a/x|bc/x|bd/x'), ('{x}', '{x}'), ('\{a,b}', '\{a,b}'), ('a{b,c}{d,e}', 'abd|abe|acd|ace')) v(pattern, expanded)",
    "status_counts": "SELECT count(*) FILTER (lang <> 'fr' AND octet_length(encode(text)) <= 5000 AND text <> '')::BIGINT AS indexed_files, count(*) FILTER (lang <> 'fr')::BIGINT AS candidate_files, count(*) FILTER (text = '')::BIGINT AS failed_files, false AS capped FROM documents",
    "edit_fan_out": """SELECT event_id, 0::BIGINT AS seq, 'a' || user_id AS file, NULL::VARCHAR AS before_path FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, 2, 'b' || user_id, 'c' || user_id FROM events UNION ALL SELECT event_id, 3, 'c' || user_id, NULL FROM events""",
    "tool_paths": "SELECT url AS path, NULL::VARCHAR AS resolved FROM pages UNION ALL SELECT * FROM (VALUES ('~/a.ts', '/home/user/a.ts'), (' ', NULL), ('src/x.ts', 'src/x.ts'), ('~b', '~b')) v(path, resolved)",
}
SQL["posting_lists"] = f"""WITH {tokens_sql(DOCS, 'file')}, least AS (SELECT token, count(*)::BIGINT AS n, count(DISTINCT key)::BIGINT AS n_files, min({{'file': key, 'pos': pos}}) AS first FROM tok GROUP BY token)
SELECT first.file AS first_file, first.pos AS first_pos, n, n_files FROM least"""

ADVICE = "Call or import the existing code, or move what both share into one helper. Leave it if the copy is meant."
SQL["report_text"] = f"""{PROBES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY len DESC, b, region, other) AS place, count(*) OVER (PARTITION BY a) AS n FROM runs),
lines AS (SELECT a, place, n, '- ' || a || ', lines ' || (region + 1) || ' to ' || (region + len) || ': as in ' || b || ', lines ' || (other + 1) || ' to ' || (other + len) || ' (' || len || ' lines)' AS line FROM ranked),
parts AS (SELECT a, n, 'What was just written to ' || a || ' is there already:' AS head, string_agg(line, chr(10) ORDER BY place) AS body, string_agg(line, chr(10) ORDER BY place) FILTER (place <= 4) AS top FROM lines GROUP BY a, n),
whole AS (SELECT *, CASE WHEN n > 4 THEN concat_ws(chr(10), head, body, {quoted(ADVICE)}) END AS artifact FROM parts),
named AS (SELECT *, substr(sha256(artifact), 1, 16) AS artifact_id FROM whole)
SELECT a AS edit_id, concat_ws(chr(10), head, top, CASE WHEN n > 4 THEN '(' || (n - 4) || ' more not shown; all of them: artifact://' || artifact_id || ')' END, {quoted(ADVICE)}) AS text, artifact_id, artifact FROM named"""

# New files: all runs to other files and within the file, trimmed to whole lines, kept in order unless a kept one overlaps by over half.
GREEDY = f"""{PROBES.replace("WITH ", "WITH RECURSIVE ", 1)}, {runs_sql('ig', 'ig', 'x.key = y.key AND x.pos < y.pos', 20, 'self')},
found AS (SELECT a, b, false AS own, region, other, len FROM runs UNION ALL SELECT a, a, true, other, region, least(len, other - region) FROM self WHERE least(len, other - region) >= 20),
edges AS (SELECT key, line, min(pos) AS low, max(pos) AS high FROM it GROUP BY key, line),
spot AS (SELECT it.key, it.pos, it.line, e.low, e.high FROM it JOIN edges e ON e.key = it.key AND e.line = it.line),
lead AS (SELECT o.*, CASE WHEN s.low < region AND least(s.high, region + len - 1) - region + 1 <= region - s.low THEN least(s.high, region + len - 1) + 1 ELSE region END AS start, region + len AS stop FROM found o JOIN spot s ON s.key = o.a AND s.pos = region),
tail AS (SELECT l.*, CASE WHEN start < stop AND s.high >= stop AND stop - greatest(s.low, start) <= s.high - stop + 1 THEN greatest(s.low, start) ELSE stop END AS ending FROM lead l JOIN spot s ON s.key = l.a AND s.pos = stop - 1),
cut AS (SELECT a, b, own, start, other + start - region AS there, ending - start AS n FROM tail WHERE ending - start >= 20),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, own, b, start, there) AS rn FROM cut),
walk AS (
  SELECT a, 0::BIGINT AS rn, []::STRUCT(r BIGINT, n BIGINT, rn BIGINT)[] AS kept FROM (SELECT DISTINCT a FROM ranked)
  UNION ALL SELECT w.a, c.rn, CASE WHEN len(list_filter(w.kept, lambda k: (least(k.r + k.n, c.start + c.n) - greatest(k.r, c.start)) * 2 > c.n)) > 0 THEN w.kept ELSE list_append(w.kept, {{'r': c.start, 'n': c.n, 'rn': c.rn}}) END
  FROM walk w JOIN ranked c ON c.a = w.a AND c.rn = w.rn + 1),
chosen AS (SELECT a, unnest(kept).rn AS rn FROM (SELECT a, arg_max(kept, rn) AS kept FROM walk GROUP BY a)),
lined AS (SELECT key, pos, line FROM it UNION ALL SELECT key, pos, line FROM dt),
told AS (SELECT c.a, c.b, c.n, c.start, s1.line AS start_line, s2.line AS end_line, o1.line AS other_start, o2.line AS other_end FROM ranked c JOIN chosen USING (a, rn)
  JOIN it s1 ON s1.key = c.a AND s1.pos = c.start JOIN it s2 ON s2.key = c.a AND s2.pos = c.start + c.n - 1
  JOIN lined o1 ON o1.key = c.b AND o1.pos = c.there JOIN lined o2 ON o2.key = c.b AND o2.pos = c.there + c.n - 1)"""
SQL["greedy_matches"] = f"""{GREEDY}
SELECT CAST(substr(a, 5) AS BIGINT) AS edit_id, a AS file, b AS other_file, start_line, end_line, other_start, other_end, n AS tokens, row_number() OVER (PARTITION BY a ORDER BY start_line, b, other_start, start) AS place FROM told"""
# A key is the file, the other one and the tokens, so that equal ones of one edit count once.
SQL["session_warnings"] = f"""{GREEDY}, keyed AS (SELECT DISTINCT t.a, t.b, (SELECT string_agg(it.token, ' ' ORDER BY it.pos) FROM it WHERE it.key = t.a AND it.pos >= t.start AND it.pos < t.start + t.n) AS body FROM told t),
counted AS (SELECT CAST(substr(a, 5) AS BIGINT) AS item, a AS file, count(*)::BIGINT AS n_told FROM keyed GROUP BY a)
SELECT item % 8 AS session, item AS seq, file, 0::BIGINT AS epoch, n_told FROM counted UNION ALL SELECT 0, item + 1000000, file, 1, n_told FROM counted WHERE item % 8 = 0"""
