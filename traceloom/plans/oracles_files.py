"""DuckDB SQL for the queries over made files: what the files were made with, by id, not by reading them.

Expected values stand here as text; none are taken from the code that they check.
"""

from __future__ import annotations

from .oracles import facts, q
from .oracles import SIGNALS as SIGNAL_TABLE

PROSE = "translate(coalesce(text, ''), '<&', '()')"


def m(n: int, text: str, key: str = "doc_id") -> str:
    """The text where the id is a multiple of n, else ''."""
    return f"CASE WHEN {key} % {n} = 0 THEN {q(text)} ELSE '' END"


#: Documents as guides in parts: what stays of the front matter, and what of the body.
FRONT = "'---\n' || 'title: Doc ' || doc_id || '\n' || 'meta:\n  layout: post\n' || '---\n'"
MARKDOWN = f"""SELECT doc_id, md5(CASE WHEN doc_id % 13 = 0 THEN replace({FRONT}, chr(10), chr(13) || chr(10)) ELSE {FRONT} END || '# Head' || chr(10) || {m(6, '<!-- a plain remark -->')} || '<meta name="viewport" content="w">' || {PROSE} || {m(9, 'ab')}) AS cleaned,
 CASE WHEN doc_id % 2 = 0 THEN 'author,' ELSE '' END || 'meta.date' || CASE WHEN doc_id % 7 = 0 THEN ',prompt' ELSE '' END AS removed_keys,
 (doc_id % 3 = 0)::INT AS comments, (doc_id % 4 = 0)::INT AS json_ld, (doc_id % 5 = 0)::INT AS meta_tags, (doc_id % 9 = 0)::INT AS hidden FROM documents"""
PATHS = """SELECT path, role, count(*) AS n, max(lines)::INT AS most_lines FROM (SELECT doc_id, unnest([{'p': 'title', 'r': 'other', 'l': 0, 'n': 1}, {'p': 'author', 'r': 'author', 'l': 2, 'n': 2}, {'p': 'author.name', 'r': 'other', 'l': 0, 'n': 2}, {'p': 'author.mail', 'r': 'other', 'l': 0, 'n': 2},
 {'p': 'meta', 'r': 'other', 'l': 2, 'n': 1}, {'p': 'meta.date', 'r': 'timestamp', 'l': 0, 'n': 1}, {'p': 'meta.layout', 'r': 'other', 'l': 0, 'n': 1}, {'p': 'prompt', 'r': 'ai', 'l': 1, 'n': 7}]) AS e FROM documents), LATERAL (SELECT e.p AS path, e.r AS role, e.l AS lines) WHERE doc_id % e.n = 0 GROUP BY path, role"""
SVG_SCAN = f"""SELECT doc_id AS item_id, (doc_id % 6 = 0)::BIGINT AS metadata, 0::BIGINT AS xmpmeta, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS title, 0::BIGINT AS "desc", (doc_id % 8 = 0)::BIGINT AS script, (doc_id % 2 = 0)::BIGINT AS comments, (doc_id % 2 = 0)::BIGINT AS generator_comments,
 (doc_id % 3 = 0)::BIGINT AS editor_namespace, (doc_id % 3 = 0)::BIGINT AS editor, (doc_id % 5 = 0)::BIGINT AS event, (doc_id % 7 = 0)::BIGINT AS remote, 0::BIGINT AS image,
 array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN [' Generator: X '] ELSE [] END, CASE WHEN doc_id % 4 = 0 THEN ['A', 'B'] ELSE [] END, CASE WHEN doc_id % 6 = 0 THEN ['x'] ELSE [] END, CASE WHEN doc_id % 8 = 0 THEN ['alert(1)'] ELSE [] END), chr(10)) AS shown FROM documents"""
SVG_CLEAN = f"""SELECT doc_id AS item_id, NULL::VARCHAR AS reason, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<svg xmlns="http://www.w3.org/2000/svg" width="10"><rect style="a > b" width="10" /><![CDATA[<title>]]>' || {m(7, '<image width="1"/>')} || '<text>' || {PROSE} || '</text></svg>') AS cleaned FROM documents"""
XMP = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN coalesce(source, 'none') || ' & ' || chr(169) WHEN 1 THEN coalesce(source, 'none') || ' <x>' END AS creator, CASE doc_id % 4 WHEN 0 THEN 'http://x/print' WHEN 1 THEN 'http://x/trainedAlgorithmicMedia' END AS source_type, NULL::VARCHAR AS creator_tool,
 CASE doc_id % 4 WHEN 0 THEN 'Scanned from a print' WHEN 1 THEN 'Created by a generative AI model' END AS source_label, doc_id % 4 = 1 AS indicates_ai, CASE WHEN doc_id % 5 = 0 THEN 'ComfyUI' END AS generator, 'u1,u2' AS namespaces, false AS mentions_c2pa FROM documents"""
LABELS = "['Normal', 'Mirrored horizontally', 'Rotated 180°', 'Mirrored vertically', 'Mirrored and rotated 90° CCW', 'Rotated 90° CW', 'Mirrored and rotated 90° CW', 'Rotated 90° CCW']"
LAT, LON = "(doc_id % 90 + 0.5)::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN -1 ELSE 1 END", "(doc_id % 180 + 0.25)::DOUBLE * CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END"
SHOWN = "printf('%.5f° %s, %.5f° %s', (doc_id % 90 + 0.5)::DOUBLE, CASE WHEN doc_id % 2 = 0 THEN 'S' ELSE 'N' END, (doc_id % 180 + 0.25)::DOUBLE, CASE WHEN doc_id % 3 = 0 THEN 'W' ELSE 'E' END)"
MAKE = "lpad((doc_id % 1000)::VARCHAR, 4, '0') || 'cam'"
EXIF = f"""SELECT doc_id, {MAKE} AS make, (doc_id % 9)::BIGINT AS orientation, doc_id % 9 BETWEEN 2 AND 8 AS turned, CASE WHEN doc_id % 9 > 0 THEN {LABELS}[(doc_id % 9)::INT] END AS label, {LAT} AS lat, {LON} AS lon, {SHOWN} AS shown, 7::INT AS tag_count FROM documents"""
PNG = f"""SELECT doc_id AS item_id, (doc_id % 100 + 1)::INT AS width, 7::INT AS height, false AS animated, array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['Title=' || coalesce(source, '') || '=tEXt'] ELSE [] END, CASE WHEN doc_id % 3 = 0 THEN ['parameters=Steps: 20, Sampler: Euler a, Seed: 7=zTXt'] ELSE [] END), ';') AS records,
 CASE WHEN doc_id % 7 = 0 THEN '2026-03-04 05:06:07' END AS modified, CASE WHEN doc_id % 5 = 0 THEN 'A & B' END AS creator, CASE WHEN doc_id % 11 = 0 THEN {MAKE} END AS make, CASE WHEN doc_id % 4 = 0 THEN 'prVt' ELSE '' END AS unknown,
 CASE WHEN doc_id % 5 = 0 THEN 'Midjourney' WHEN doc_id % 3 = 0 THEN 'Stable Diffusion (AUTOMATIC1111)' END AS generator FROM documents"""
# the packet's and the claim's lengths are those of the made files
JPEG_SIGNALS = f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Midjourney' WHEN doc_id % 5 = 0 THEN 'Adobe Firefly' WHEN doc_id % 4 = 0 THEN 'Google Gemini / Imagen' END AS generator FROM documents),
 s AS (SELECT doc_id, generator, unnest([
 {{'g': 'provenance', 's': 'c2pa', 'd': doc_id % 5 = 0, 'v': CASE WHEN doc_id % 5 = 0 THEN '108 B manifest · Adobe_Firefly' END}},
 {{'g': 'provenance', 's': 'ai-generator', 'd': generator IS NOT NULL, 'v': CASE WHEN doc_id % 3 = 0 THEN 'Created by a generative AI model · ' || generator ELSE generator END}},
 {{'g': 'provenance', 's': 'synthid', 'd': NULL, 'v': NULL}},
 {{'g': 'metadata', 's': 'exif', 'd': doc_id % 2 = 0, 'v': CASE WHEN doc_id % 2 = 0 THEN '7 fields' END}},
 {{'g': 'metadata', 's': 'xmp', 'd': doc_id % 3 = 0, 'v': CASE WHEN doc_id % 3 = 0 THEN '347 B · extended' END}},
 {{'g': 'metadata', 's': 'iptc', 'd': false, 'v': NULL}},
 {{'g': 'metadata', 's': 'embedded-text', 'd': doc_id % 4 = 0, 'v': CASE WHEN doc_id % 4 = 0 THEN 'Comment' END}},
 {{'g': 'metadata', 's': 'icc', 'd': false, 'v': NULL}},
 {{'g': 'privacy', 's': 'gps', 'd': doc_id % 2 = 0, 'v': CASE WHEN doc_id % 2 = 0 THEN {SHOWN} END}},
 {{'g': 'privacy', 's': 'timestamp', 'd': false, 'v': NULL}},
 {{'g': 'privacy', 's': 'device', 'd': doc_id % 2 = 0, 'v': CASE WHEN doc_id % 2 = 0 THEN {MAKE} END}},
 {{'g': 'privacy', 's': 'software', 'd': doc_id % 3 = 0, 'v': CASE WHEN doc_id % 3 = 0 THEN 'Midjourney v6' END}},
 {{'g': 'privacy', 's': 'author', 'd': doc_id % 3 = 0, 'v': CASE WHEN doc_id % 3 = 0 THEN 'A & B' END}},
 {{'g': 'hidden', 's': 'hidden-unicode', 'd': doc_id % 4 = 0, 'v': CASE WHEN doc_id % 4 = 0 THEN '1 in embedded text' END}}]) AS x, unnest(generate_series(0, 13)) AS ord FROM f)
 SELECT doc_id AS item_id, x.g AS "group", ord::INT AS ord, x.s AS signal_id, CASE WHEN x.d IS NULL THEN 'unable_to_verify' WHEN x.d THEN 'detected' ELSE 'not_detected' END AS status, x.v AS value FROM s"""
ORACLES: dict[str, str] = {
    "markdown_clean": MARKDOWN,
    "fm_paths": PATHS,
    "svg_scan": SVG_SCAN,
    "svg_clean": SVG_CLEAN,
    "xmp_facts": XMP,
    "exif_facts": EXIF,
    "png_records": PNG,
    "jpeg_signals": JPEG_SIGNALS,
    "signal_groups": f"WITH r AS ({JPEG_SIGNALS}), g AS (SELECT item_id, \"group\", count(*) FILTER (status = 'detected') AS found, count(*) AS total FROM r GROUP BY ALL) SELECT \"group\", found, total, count(*) AS files FROM g GROUP BY ALL",
    "jpeg_notes": f"SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 9 BETWEEN 2 AND 8 THEN 'Orientation: ' || {LABELS}[(doc_id % 9)::INT] ELSE '' END AS notes FROM documents",
    "embedded_merge": f"""SELECT doc_id // 10 AS item_id, arg_min({MAKE}, doc_id) FILTER (doc_id % 2 = 0) AS make, max(CASE WHEN doc_id % 3 = 0 THEN 'Midjourney v6' END) AS creator_tool, max(CASE WHEN doc_id % 5 = 0 THEN 'Adobe_Firefly' END) AS claim,
 bool_or(doc_id % 3 = 0) AS extended, count(*) FILTER (doc_id % 4 = 0)::INT AS texts, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0) AS carriers FROM documents GROUP BY doc_id // 10""",
    "files_clean": """WITH k AS (SELECT doc_id, ['jpeg', 'png', 'svg', 'markdown', 'gif'][(doc_id % 5 + 1)::INT] AS format, doc_id % 9 AS o FROM documents),
 c AS (SELECT format, CASE WHEN format = 'gif' THEN 'unsupported-format' END AS reason, CASE WHEN o BETWEEN 2 AND 8 AND ((format = 'jpeg' AND doc_id % 2 = 0) OR (format = 'png' AND doc_id % 11 = 0)) THEN o END::BIGINT AS orientation, CASE WHEN format IN ('jpeg', 'png') THEN 0 END::INT AS records, CASE WHEN format IN ('jpeg', 'png') THEN false END AS xmp FROM k)
 SELECT *, count(*) AS files, count(*) FILTER (format <> 'gif') AS cleaned FROM c GROUP BY ALL""",
    "outcome_lists": f"""WITH {SIGNAL_TABLE}, {facts('b', 0)}, {facts('a', 2)}, j AS (SELECT b.item_id, b.signal_id, b.ord, b.remove, b.status AS before_status, coalesce(a.status, 'unknown') AS after_status FROM b LEFT JOIN a ON a.item_id = b.item_id AND a.signal_id = b.signal_id AND (a.item_id + a.ord) % 13 <> 0),
 o AS (SELECT *, CASE WHEN before_status = 'unable_to_verify' OR after_status = 'unable_to_verify' THEN 'unverifiable' WHEN before_status <> 'detected' THEN 'absent' WHEN after_status = 'not_detected' THEN 'removed' WHEN NOT remove THEN 'kept' WHEN signal_id IN ('iptc', 'c2pa', 'embedded-text') THEN 'kept' ELSE 'remaining' END AS outcome FROM j)
 SELECT item_id, coalesce(string_agg(signal_id, ',' ORDER BY ord) FILTER (outcome = 'removed'), '') AS removed, coalesce(string_agg(signal_id, ',' ORDER BY ord) FILTER (outcome IN ('remaining', 'unverifiable', 'kept')), '') AS remaining, coalesce(string_agg(signal_id, ',' ORDER BY ord) FILTER (outcome = 'remaining'), '') AS stubborn,
 count(*) FILTER (before_status = 'detected') AS before, count(*) FILTER (outcome = 'removed') AS gone FROM o GROUP BY item_id""",
    "lint_guides": """WITH g AS (SELECT doc_id AS d, doc_id % 17 = 0 AS none, 1 AS title, 2 AS l_title, 3 AS l_desc, 4 AS l_sum FROM documents), p AS (SELECT d, none, 5 + (d % 5 <> 0)::INT AS l_order FROM g),
 n AS (SELECT *, CASE WHEN d % 7 = 0 OR d % 11 = 0 THEN l_order + 1 END AS l_type, l_order + (d % 7 = 0 OR d % 11 = 0)::INT AS a FROM p), o AS (SELECT *, a + (d % 4 = 0)::INT AS b FROM n), r AS (SELECT *, b + 3 * (d % 6 = 0)::INT AS c FROM o),
 s AS (SELECT *, c + (d % 9 = 0)::INT AS e FROM r), t AS (SELECT *, e + (d % 10 = 0)::INT AS f FROM s), u AS (SELECT *, f + (d % 8 = 0)::INT AS h FROM t), v AS (SELECT *, h + (d % 12 = 0)::INT + 2 AS body FROM u),
 x AS (SELECT d, none, unnest([
 {'w': d % 5 = 0, 'line': 1, 'level': 'ERROR', 'rule': 'missing publishDate', 'detail': NULL}, {'w': d % 7 <> 0 AND d % 11 = 0, 'line': l_type, 'level': 'ERROR', 'rule': 'contentType', 'detail': 'essay'}, {'w': d % 7 = 0, 'line': l_type, 'level': 'ERROR', 'rule': 'lastTested', 'detail': NULL},
 {'w': d % 2 <> 0, 'line': 3, 'level': 'ERROR', 'rule': 'description length', 'detail': '5'}, {'w': d % 2 <> 0 AND d % 3 = 0, 'line': 4, 'level': 'ERROR', 'rule': 'summary is description', 'detail': NULL}, {'w': d % 4 = 0, 'line': b, 'level': 'ERROR', 'rule': 'metaTitle length', 'detail': '66'},
 {'w': true, 'line': body, 'level': 'WARN', 'rule': 'few words', 'detail': '10'}, {'w': false, 'line': body, 'level': 'ERROR', 'rule': 'no internal link', 'detail': NULL}, {'w': d % 6 = 0, 'line': b + 1, 'level': 'WARN', 'rule': 'few questions', 'detail': '1'},
 {'w': d % 12 <> 0, 'line': 1, 'level': 'WARN', 'rule': 'nothing related', 'detail': NULL}, {'w': d % 9 = 0, 'line': e, 'level': 'ERROR', 'rule': 'unquoted colon', 'detail': 'note'}, {'w': d % 10 = 0, 'line': f, 'level': 'ERROR', 'rule': 'apostrophe', 'detail': 'quote'}, {'w': d % 8 = 0, 'line': h, 'level': 'WARN', 'rule': 'unrecognised line', 'detail': NULL},
 {'w': d % 3 = 0, 'line': body + 1, 'level': 'WARN', 'rule': 'claim', 'detail': '''undetectable'''}, {'w': d % 3 = 0, 'line': body + 1, 'level': 'ERROR', 'rule': 'US spelling', 'detail': 'behavior'}, {'w': d % 2 <> 0, 'line': body, 'level': 'ERROR', 'rule': 'raw slug', 'detail': '[/x]('}]) AS k FROM v)
 SELECT d AS doc_id, k.line::INT AS line, k.level AS level, k.rule AS rule, k.detail AS detail FROM x WHERE k.w AND NOT none UNION ALL SELECT d, 1, 'ERROR', 'no front matter', NULL FROM g WHERE none""",
    "guide_collection": """SELECT doc_id, 'Doc' AS title, 'the house' AS author, CASE WHEN doc_id % 7 = 0 THEN 'lab' WHEN doc_id % 11 = 0 THEN 'essay' ELSE 'guide' END AS content_type, CASE WHEN doc_id % 5 <> 0 THEN DATE '2026-01-02' END AS publish_date, 3.0::DOUBLE AS "order", (doc_id % 6 = 0)::INT AS n_faq,
 array_to_string(list_concat(CASE WHEN doc_id % 5 = 0 THEN ['publishDate'] ELSE [] END, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN ['contentType'] ELSE [] END, CASE WHEN doc_id % 7 = 0 THEN ['lastTested', 'sources'] ELSE [] END), ',') AS problems FROM documents WHERE doc_id % 17 <> 0""",
    "refusals": "WITH r AS (SELECT ['encrypted', 'unsupported structure', 'output did not parse', 'output had extra revisions', 'metadata survived', 'xmp survived', 'value found in output bytes', 'other'][(event_id % 8 + 1)::INT] AS label, count(*) AS n FROM events GROUP BY 1) SELECT 'refusals' AS section, label, n, printf('%.1f%%', 100.0::DOUBLE * n / sum(n) OVER ()) AS share FROM r",
    "size_ratios": "WITH r AS (SELECT event_type, list(round(value / 100, 2) ORDER BY round(value / 100, 2)) AS v FROM events GROUP BY event_type) SELECT event_type, len(v)::BIGINT AS n, v[len(v) // 2 + 1] AS p50, v[-1] AS most FROM r",
    "preservation": """WITH o AS (SELECT o_orderkey AS k, o_custkey = o_orderkey % 9 AS twins FROM orders) SELECT count(*) AS files, count(*) FILTER (k % 10 <> 0 AND k % 7 <> 0) AS same_pages, count(*) FILTER (k % 10 <> 0 AND k % 7 <> 0 AND (k % 6 <> 0 OR twins)) AS same_contents, count(*) FILTER (k % 10 = 0) AS lost FROM o""",
    "pasted_texts": "SELECT doc_id, length(text) > 1000 AS truncated, md5(substring(text, 1, 1000)) AS text FROM documents",
    "scalars": """SELECT doc_id, ['string', 'int', 'float', 'boolean', 'null', 'string'][(doc_id % 6 + 1)::INT] AS kind, CASE doc_id % 6 WHEN 0 THEN 'it''s ' || doc_id WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN doc_id || '.5' WHEN 3 THEN 'true' WHEN 5 THEN 'a "b"' END AS value, 'string:x, y|int:' || doc_id || '|string:z' AS items FROM documents""",
    "newest_guides": "SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS shown FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 6",
}
