"""DuckDB SQL for the registered queries, written from the rules, not from the Spark plans."""

from __future__ import annotations

from ..functions.hidden import CATEGORIES, HIDDEN, NAMES, PICTOGRAPHIC, ranges
from ..operators.lint import REQUIRED, US_SPELLINGS
from . import dims
from .queries_data import GENERATOR_CYCLE, MARKER_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def held(cp: str, spec: str) -> str:
    return "(" + " OR ".join(f"{cp} = {a}" if a == b else f"{cp} BETWEEN {a} AND {b}" for a, b in ranges(spec)) + ")"


def category(cp: str, field: int) -> str:
    return "CASE " + " ".join(f"WHEN {held(cp, r[2])} THEN {q(r[field])}" for r in HIDDEN) + " END"


def named(cp: str) -> str:
    return "CASE " + " ".join(f"WHEN {held(cp, spec)} THEN {q(name)}" for name, spec in NAMES) + " END"


def listed(key: str, values: list[str]) -> str:
    return f"[{', '.join(values)}][CAST({key} % {len(values)} AS INT) + 1]"


PIC = lambda cp: f"coalesce({held(cp, PICTOGRAPHIC)}, false)"
HAN = "coalesce(regexp_full_match(before, '\\p{Han}'), false)"
ANY_SPEC = " ".join(r[2] for r in HIDDEN)
MARKED = f"marked AS (SELECT doc_id, lang, source, substring(text, 1, 3) || {listed('doc_id', MARKER_SQL)} || substring(text, 4) AS text FROM documents)"
CHARS = f"""{MARKED}, chars AS (SELECT doc_id, lang, i - 1 AS idx, c[i] AS ch, c[i - 1] AS before, c[i + 1] AS after FROM
 (SELECT doc_id, lang, c, unnest(generate_series(1, len(c))) AS i FROM (SELECT doc_id, lang, string_split(text, '') AS c FROM marked))),
 cps AS (SELECT *, unicode(ch) AS cp FROM chars),
 seen AS (SELECT doc_id, lang, idx, ch, cp, {category('cp', 0)} AS category, {category('cp', 1)} AS risk,
 CASE WHEN cp = 8205 THEN {PIC('unicode(before)')} AND {PIC('unicode(after)')} WHEN cp IN (65038, 65039) THEN {PIC('unicode(before)')} WHEN cp BETWEEN 917760 AND 917999 THEN {HAN} ELSE false END AS legitimate FROM cps)"""
SPACE_CLASS = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
INVISIBLE_CLASS = r"[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE_CLASS}+', ''), '{SPACE_CLASS}+$', '')"


def visible(x: str) -> str:
    return f"regexp_replace({x}, '{INVISIBLE_CLASS}', '', 'g')"


def shown(x: str) -> str:
    clean = trimmed(f"regexp_replace({visible(x)}, '{SPACE_CLASS}+', ' ', 'g')")
    return f"CASE WHEN length({clean}) > 300 THEN substring({clean}, 1, 300) || chr(8230) ELSE {clean} END"


def role(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN ({', '.join(map(q, keys.split()))}) THEN {q(r)}" for r, keys in dims.ROLES.items()) + " ELSE 'other' END"


MD = f"""md AS (SELECT doc_id, text AS body, CASE WHEN doc_id % 11 = 0 THEN ['generator: tool', 'date: 2026-01-01'] ELSE
 list_concat(['title: Doc ' || doc_id, 'author: ' || source, 'generator: ' || {listed('doc_id', [q(x) for x in GENERATOR_CYCLE])}, 'date: 2026-01-0' || (doc_id % 9 + 1)],
 CASE WHEN doc_id % 3 = 0 THEN ['prompt: |', '  line one', '  line two'] ELSE [] END, CASE WHEN doc_id % 7 = 0 THEN ['base: &anchor x'] ELSE [] END, ['layout: post']) END AS lines,
 chr(10) || text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '<!-- generated by tool -->' ELSE '' END AS tail, doc_id % 7 = 0 AND doc_id % 11 <> 0 AS unsafe FROM documents),
 keys AS (SELECT doc_id, unsafe, n, line, length(regexp_extract(x, '^\\s*')) AS indent, lower(regexp_extract(x, '^\\s*([A-Za-z_][A-Za-z0-9_.-]*)\\s*:', 1)) AS key, trim(regexp_extract(x, '^\\s*[A-Za-z_][A-Za-z0-9_.-]*\\s*:(.*)$', 1)) AS value
 FROM (SELECT doc_id, unsafe, len(lines) AS n, unnest(generate_series(1, len(lines))) - 1 AS line, unnest(lines) AS x FROM md) WHERE regexp_matches(x, '^\\s*[A-Za-z_][A-Za-z0-9_.-]*\\s*:')),
 entries AS (SELECT k.doc_id, k.line, k.indent, k.key, k.value, {role('k.key')} AS role, coalesce((SELECT min(o.line) FROM keys o WHERE o.doc_id = k.doc_id AND o.line > k.line AND o.indent <= k.indent), k.n) - 1 AS last, k.unsafe FROM keys k)"""
PAGES = """p AS (SELECT page_id, url, html || CASE WHEN page_id % 4 = 0 THEN '<script type="application/ld+json"> {"@type":"X"} </script>' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '<meta name="generator" content="Gen 1">' ELSE '' END
 || CASE WHEN page_id % 5 = 0 THEN '<body onload="x()">' ELSE '' END || CASE WHEN page_id % 6 = 0 THEN '<img src="https://t.example/p.png">' ELSE '' END || CASE WHEN page_id % 2 = 0 THEN '<!-- exported by model 7 -->' ELSE '' END AS html FROM pages)"""
SIGNALS = "signals AS (SELECT * FROM (VALUES " + ", ".join(f"({q(s[0])}, {q(s[1])}, {q(s[2])}, {s[3]}, {s[4]}, {s[5]}, {i})" for i, s in enumerate(dims.SIGNALS)) + ") t(signal_id, category, axis, detect, remove, verify, ord))"


def facts(name: str, shift: int) -> str:
    return f"{name} AS (SELECT doc_id AS item_id, signal_id, ord, remove, axis, CASE WHEN NOT verify AND NOT detect THEN 'unable_to_verify' WHEN (doc_id * 7 + ord * 3 + {shift}) % 5 < 2 THEN 'detected' ELSE 'not_detected' END AS status FROM documents, signals)"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{SPACE_CLASS}+'), lambda x: x <> ''))"


LINT_RULES = [
    *[("ERROR", f"missing {k}", f"NOT list_bool_or(list_transform(lines, lambda x: regexp_matches(x, '^{k}\\s*:')))") for k in REQUIRED],
    ("ERROR", "unquoted colon", "list_bool_or(list_transform(lines, lambda x: regexp_matches(x, '^[A-Za-z_][\\w.-]*:[ \\t]+[^\"''\\[{|>\\s].*: ')))"),
    ("WARN", "few words", f"{words('tail')} < 600"),
    ("WARN", "many words", f"{words('tail')} > 2200"),
    ("ERROR", "no internal link", "NOT contains(tail, '](/')"),
    ("ERROR", "US spelling", f"regexp_matches(regexp_replace(tail, 'https?://\\S+', ' ', 'g'), '(?i)\\b(?:{US_SPELLINGS.replace(' ', '|')})\\b')"),
]
LINTED = f"WITH {MD}, found AS (" + " UNION ALL ".join(f"SELECT doc_id, {q(level)} AS level, {q(name)} AS rule FROM md WHERE {when}" for level, name, when in LINT_RULES) + ")"
MIB, KIB = "1048576", "1024"

ORACLES: dict[str, str] = {
    "hidden_scan": f"WITH {CHARS}, per AS (SELECT lang, doc_id, count(category) AS total, count(*) FILTER (category IS NOT NULL AND legitimate) AS legitimate, count(*) FILTER (category IS NOT NULL AND NOT legitimate) AS removable, "
    + ", ".join(f"count(*) FILTER (category = {q(c)}) AS n_{c.replace('-', '_')}" for c in CATEGORIES)
    + " FROM seen GROUP BY lang, doc_id) SELECT lang, count(*) AS docs, count(*) FILTER (removable > 0) AS flagged, sum(total)::BIGINT AS total, sum(legitimate)::BIGINT AS legitimate, sum(removable)::BIGINT AS removable, "
    + ", ".join(f"sum(n_{c.replace('-', '_')})::BIGINT AS n_{c.replace('-', '_')}" for c in CATEGORIES)
    + " FROM per GROUP BY lang",
    "hidden_findings": f"WITH {CHARS} SELECT doc_id, idx::INT AS idx, cp::INT AS cp, 'U+' || CASE WHEN length(upper(to_hex(cp))) < 4 THEN lpad(upper(to_hex(cp)), 4, '0') ELSE upper(to_hex(cp)) END AS code, {named('cp')} AS name, category, risk, legitimate FROM seen WHERE category IS NOT NULL",
    "hidden_clean": f"WITH {CHARS} SELECT doc_id, md5(string_agg(CASE WHEN category = 'unusual-space' THEN ' ' WHEN category IS NULL OR legitimate THEN ch ELSE '' END, '' ORDER BY idx)) AS cleaned, md5(string_agg(CASE WHEN category = 'unusual-space' THEN ' ' WHEN category IS NULL THEN ch ELSE '' END, '' ORDER BY idx)) AS aggressive, md5(string_agg(CASE WHEN category = 'unusual-space' OR category IS NULL OR legitimate THEN ch ELSE '' END, '' ORDER BY idx)) AS spaces_kept FROM seen GROUP BY doc_id",
    "hidden_runs": f"WITH {CHARS}, edge AS (SELECT doc_id, idx, category IS NOT NULL AS hidden, CASE WHEN (category IS NOT NULL) = lag(category IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM seen WHERE idx < 4000), runs AS (SELECT doc_id, hidden, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM edge) SELECT doc_id, (run - 1)::INT AS pos, count(*)::INT AS len, hidden FROM runs GROUP BY doc_id, run, hidden",
    "text_clean_verify": f"WITH {CHARS}, per AS (SELECT doc_id, count(*) FILTER (category IS NOT NULL AND NOT legitimate) AS removable FROM seen GROUP BY doc_id) SELECT 'hidden-unicode' AS signal_id, CASE WHEN removable > 0 THEN 'detected' ELSE 'not_detected' END AS before_status, 'not_detected' AS after_status, CASE WHEN removable > 0 THEN 'removed' ELSE 'absent' END AS outcome, count(*) AS n FROM per GROUP BY ALL UNION ALL SELECT 'claude-watermark', 'unable_to_verify', 'unable_to_verify', 'unverifiable', count(*) FROM per",
    "sanitize_values": f"WITH v AS (SELECT conv_id, turn, {shown('x')} AS v FROM (SELECT conv_id, turn, ' ' || chr(8203) || ' ' || text || chr(9) || chr(12288) || chr(65279) AS x FROM conversations)) SELECT conv_id, turn, length(v)::INT AS len, md5(v) AS value FROM v",
    "filename_ops": f"WITH n AS (SELECT page_id, {trimmed('regexp_replace(' + visible('x') + ', ' + q('[\"<>|:*?]') + ', ' + q('') + ', ' + q('g') + ')')} AS n FROM (SELECT page_id, list_last(regexp_split_to_array(url || '?a<b>|:c\"*.v1.html', '[/\\\\]')) AS x FROM pages)), m AS (SELECT page_id, CASE WHEN length(n) > 0 THEN substring(n, 1, 120) ELSE 'image' END AS name FROM n), s AS (SELECT *, length(name) - strpos(reverse(name), '.') + 1 AS dot FROM m) SELECT page_id, name, CASE WHEN contains(name, '.') AND dot > 1 THEN substring(name, 1, dot - 1) ELSE name END AS base, CASE WHEN contains(name, '.') AND dot > 1 THEN substring(name, dot + 1) ELSE '' END AS ext, CASE WHEN contains(name, '.') AND dot > 1 THEN substring(name, 1, dot - 1) ELSE name END || '-clean.jpg' AS cleaned FROM s",
    "size_format": f"WITH s AS (SELECT doc_id, n_chars * (doc_id % 1500) AS n FROM documents), t AS (SELECT doc_id, n, CASE WHEN n < {MIB} THEN (n * 20 + {KIB}) // (2 * {KIB}) ELSE (n * 20 + {MIB}) // (2 * {MIB}) END AS tenths FROM s) SELECT doc_id, CASE WHEN n < {KIB} THEN n || ' B' ELSE (tenths // 10) || '.' || (tenths % 10) || CASE WHEN n < {MIB} THEN ' KB' ELSE ' MB' END END AS shown FROM t",
    "strip_tags": f"SELECT page_id, md5({trimmed('regexp_replace(html, ' + q('<[^>]*>') + ', ' + q(' ') + ', ' + q('g') + ')')}) AS plain, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages",
    "word_numbers": f"SELECT doc_id, {words('text')}::BIGINT AS words FROM documents",
    "digests": """WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
 b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), bytes AS (SELECT doc_id, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS v FROM b)
 SELECT doc_id, list_reduce(list_prepend(0::BIGINT, v), lambda h, c: (h * 31 + c) % 4294967296) AS digest, len(v)::BIGINT AS length,
  xor(list_reduce(list_prepend(4294967295::BIGINT, v), lambda h, c: xor(h >> 8, crc[(xor(h, c) & 255) + 1])), 4294967295) AS crc32 FROM bytes, t""",
    "detect_formats": f"SELECT doc_id, CASE WHEN doc_id % 50 = 13 THEN 'unknown' ELSE f END AS format, CASE WHEN doc_id % 50 = 13 THEN 'empty' WHEN f NOT IN ({', '.join(q(f[0]) for f in dims.FORMATS)}) THEN 'unsupported-format' END AS error FROM (SELECT doc_id, {listed('doc_id', [q(x) for x in 'jpeg png webp gif pdf bmp tiff tiff avif heic svg markdown'.split()])} AS f FROM documents)",
    "format_registry": f"WITH f AS (SELECT CASE WHEN doc_id % 50 = 13 THEN 'unknown' ELSE {listed('doc_id', [q(x) for x in 'jpeg png webp gif pdf bmp tiff tiff avif heic svg markdown'.split()])} END AS format FROM documents) SELECT format, count(*) AS files, label, mime, extension, kind, support FROM f LEFT JOIN (VALUES " + ", ".join("(" + ", ".join(map(q, f)) + ")" for f in dims.FORMATS) + ") t(format, label, mime, extension, kind, support) USING (format) GROUP BY ALL",
    "signal_verdicts": f"WITH {SIGNALS}, {facts('f', 0)} SELECT signal_id, s.category, s.axis, CASE WHEN NOT s.detect THEN 'unable_to_verify' WHEN NOT s.remove THEN 'detect_only' WHEN s.verify THEN 'removable_verified' ELSE 'removable_unverified' END AS verdict, status, count(*) AS files FROM f JOIN signals s USING (signal_id) GROUP BY ALL",
    "presets_valid": f"WITH {SIGNALS}, {facts('f', 0)}, n AS (SELECT signal_id, count(*) AS files FROM f WHERE status = 'detected' GROUP BY signal_id), b AS (SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {q(b)})" for p, bs in dims.PRESETS for b in bs) + ") t(preset, signal_id)) SELECT preset, count(*) AS blocks, bool_and(remove) AS removable, sum(coalesce(files, 0))::BIGINT AS signals FROM b JOIN signals USING (signal_id) LEFT JOIN n USING (signal_id) GROUP BY preset",
    "generator_match": "WITH g AS (SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {q(n)})" for n in needles) + f" THEN {q(name)}" for name, needles in dims.GENERATORS) + " END AS generator, array_to_string(list_sort(list_filter([" + ", ".join(q(n) for _, needles in dims.GENERATORS for n in needles) + "], lambda n: contains(lower(text), n))), ',') AS needles FROM documents) SELECT * FROM g WHERE generator IS NOT NULL",
    "png_keys": f"SELECT key, count(*) AS files, generator FROM (SELECT {listed('doc_id', [q(k) for k in [*dims.PNG_KEYS, 'Title']])} AS key FROM documents) JOIN (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in dims.PNG_KEYS.items()) + ", ('Title', NULL)) t(key, generator) USING (key) GROUP BY ALL",
    "fm_keys": f"WITH {MD} SELECT doc_id, line::INT AS line, indent::INT AS indent, key, value, role, last::BIGINT AS last, unsafe FROM entries",
    "fm_clean": f"WITH {MD}, gone AS (SELECT DISTINCT doc_id, unnest(generate_series(line, last)) AS line FROM entries WHERE role <> 'other' AND NOT unsafe), kept AS (SELECT doc_id, list(x ORDER BY line) AS ls FROM (SELECT doc_id, unnest(generate_series(1, len(lines))) - 1 AS line, unnest(lines) AS x FROM md) ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id) SELECT m.doc_id, md5(CASE WHEN k.ls IS NULL THEN m.tail ELSE '---' || chr(10) || array_to_string(k.ls, chr(10)) || chr(10) || '---' || chr(10) || m.tail END) AS cleaned FROM md m LEFT JOIN kept k USING (doc_id)",
    "html_comments": f"WITH {PAGES}, c AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), lambda x: {trimmed('x')}) AS c FROM p) SELECT page_id, len(c)::INT AS all_comments, coalesce(array_to_string(list_filter(c, lambda x: regexp_matches(x, '(?i)generat|created\\s+with|produced\\s+by|exported|written\\s+by|\\bai\\b|model|prompt')), '|'), '') AS told FROM c",
    "html_meta": f"WITH {PAGES}, t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')) AS t FROM p), m AS (SELECT page_id, lower(regexp_extract(t, '(?i)\\bname\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS name, regexp_extract(t, '(?i)\\bcontent\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS content FROM t) SELECT page_id, name, content, {role('name')} AS role FROM m WHERE name <> '' AND {role('name')} <> 'other'",
    "html_json_ld": f"WITH {PAGES} SELECT page_id, coalesce(array_to_string(list_transform(regexp_extract_all(html, '(?is)<script\\b[^>]*type\\s*=\\s*[\"'']application/ld\\+json[\"''][^>]*>(.*?)</script\\s*>', 1), lambda x: {trimmed('x')}), '|'), '') AS json_ld FROM p",
    "html_active": f"WITH {PAGES} SELECT page_id, len(regexp_extract_all(html, '(?i)<[a-z][^>]*\\son[a-z]+\\s*='))::INT AS handlers, len(regexp_extract_all(html, '(?i)\\b(?:src|href)\\s*=\\s*[\"''](?:https?:)?//[^\"'']+[\"'']'))::INT AS remote FROM p",
    "compare_outcomes": f"WITH {SIGNALS}, {facts('b', 0)}, {facts('a', 2)}, j AS (SELECT b.item_id, b.signal_id, b.ord, b.remove, b.status AS before_status, coalesce(a.status, 'unknown') AS after_status FROM b LEFT JOIN a ON a.item_id = b.item_id AND a.signal_id = b.signal_id AND (a.item_id + a.ord) % 13 <> 0) SELECT signal_id, before_status, after_status, CASE WHEN before_status = 'unable_to_verify' OR after_status = 'unable_to_verify' THEN 'unverifiable' WHEN before_status <> 'detected' THEN 'absent' WHEN after_status = 'not_detected' THEN 'removed' WHEN signal_id = 'exif' AND item_id % 2 = 0 THEN 'kept' WHEN NOT remove THEN 'kept' WHEN signal_id IN ('iptc', 'c2pa', 'embedded-text') THEN 'kept' ELSE 'remaining' END AS outcome, count(*) AS n FROM j GROUP BY ALL",
    "exposure_axes": f"WITH {SIGNALS}, {facts('f', 0)} SELECT item_id, axis, count(*) FILTER (status = 'detected') AS detected, count(*) FILTER (status = 'unable_to_verify') AS unverifiable, count(*) AS total, count(*) FILTER (status = 'detected') = 0 AND count(*) FILTER (status = 'unable_to_verify') > 0 AS void FROM f GROUP BY item_id, axis",
    "audit_tallies": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS large_n, round(100.0::DOUBLE * count(*) FILTER (value > 100) / count(*), 1) AS large_pct, count(*) FILTER (user_id % 7 = 0) AS seventh_n, round(100.0::DOUBLE * count(*) FILTER (user_id % 7 = 0) / count(*), 1) AS seventh_pct FROM events GROUP BY event_type",
    "audit_quantiles": "WITH l AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type) SELECT event_type, len(v)::BIGINT AS n, v[least(len(v) - 1, floor(len(v) * 0.5)::INT) + 1] AS p50, v[least(len(v) - 1, floor(len(v) * 0.95)::INT) + 1] AS p95, v[-1] AS most FROM l",
    "audit_histogram": "SELECT regexp_replace(event_type || ' at offset ' || user_id, '\\d+', 'N', 'g') AS label, count(*) AS n FROM events GROUP BY 1",
    "audit_gate": "SELECT count(*) AS n, count(*) FILTER (event_id % 12 = 0) AS bad, CASE WHEN count(*) FILTER (event_id % 12 = 0) * 10 <= count(*) THEN 'pass' ELSE 'fail' END AS verdict FROM events",
    "count_buckets": "WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id) SELECT CASE WHEN c = 0 THEN '0' WHEN c <= 3 THEN '1-3' WHEN c <= 10 THEN '4-10' ELSE '11+' END AS bucket, count(*) AS users FROM u GROUP BY 1",
    "lint_documents": f"{LINTED} SELECT level, rule, count(*) AS n FROM found GROUP BY level, rule",
    "lint_duplicates": "WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents) SELECT doc_id, sharing, first FROM (SELECT doc_id, count(*) OVER (PARTITION BY title) AS sharing, min(doc_id) OVER (PARTITION BY title) AS first FROM t) WHERE sharing > 1",
    "lint_summary": f"{LINTED} SELECT count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARN') AS warnings, count(DISTINCT doc_id) AS items FROM found",
    "limiter_fixed_bucket": "WITH a AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 3600) ORDER BY ts, event_id) > 2 AS over FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 86400), over ORDER BY ts, event_id) > 10 AS day FROM a) SELECT event_id, NOT over AND NOT day AS admitted, CASE WHEN over THEN 3600 WHEN day THEN 86400 END::INT AS denied_by FROM b",
    "revision_overlay": "WITH o AS (SELECT o_custkey, o_orderkey % 5 AS obj, (o_orderkey * 7919) % 1000003 AS rev, o_orderkey FROM orders) SELECT o_custkey, obj, min(rev) AS rev, arg_min(o_orderkey, rev) AS o_orderkey FROM o WHERE rev >= 1000 GROUP BY o_custkey, obj",
    "reachability": "WITH RECURSIVE walk(node, depth) AS (SELECT 3::BIGINT, 0 UNION ALL SELECT (node * 2 + 1) % 25, depth + 1 FROM walk WHERE depth < (SELECT count(*) FROM nation)) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node",
    "renumber_offsets": "SELECT o_custkey, o_orderkey, row_number() OVER w::INT AS new_number, coalesce(sum(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "interval_apply": "SELECT doc_id, md5(substring(text, 1, (doc_id % 17)::INT + 2) || substring(text, (doc_id % 17)::INT + 10, 0) || substring(text, (doc_id % 17)::INT + 13)) AS left_over FROM documents",
    "related_links": "WITH l AS (SELECT p_partkey, unnest([0, 1, 2])::INT AS pos, unnest([p_partkey + 1, p_partkey * 2, p_partkey - 1]) AS t FROM part) SELECT l.p_partkey, pos, p.p_name AS title FROM l JOIN part p ON p.p_partkey = l.t",
    "image_clean_verify": """WITH s(signal_id, k) AS (VALUES ('exif', 3), ('embedded-text', 2), ('icc', 5), ('xmp', 0), ('iptc', 0), ('c2pa', 0)),
 d AS (SELECT signal_id, k > 0 AND doc_id % greatest(k, 1) = 0 AS hit FROM documents, s)
 SELECT signal_id, CASE WHEN hit THEN 'detected' ELSE 'not_detected' END AS before_status, CASE WHEN hit AND signal_id = 'icc' THEN 'detected' ELSE 'not_detected' END AS after_status,
 CASE WHEN NOT hit THEN 'absent' WHEN signal_id = 'icc' THEN 'kept' ELSE 'removed' END AS outcome, count(*) AS n FROM d GROUP BY ALL""",
}
