"""DuckDB SQL for scans of made files: which signal a file has, and its value, by what it was made with."""

from __future__ import annotations

from .oracles import SIGNALS as SIGNAL_TABLE
from .oracles import facts, words
from .oracles_files import MAKE, SHOWN


def by(n: int, value: str) -> str:
    return f"CASE WHEN doc_id % {n} = 0 THEN {value} END"


STATUS = "CASE WHEN d IS NULL THEN 'unable_to_verify' WHEN d THEN 'detected' ELSE 'not_detected' END"
NEVER = "false"


def _signals(rows: list[tuple[str, str, str, str]]) -> str:
    """(group, signal, whether it is there, value), in order; NULL for what nothing can verify."""
    each = ", ".join(f"{{'g': '{g}', 's': '{s}', 'd': {d}, 'v': {v}}}" for g, s, d, v in rows)
    return f"""SELECT item_id, x.g AS "group", ord::INT AS ord, x.s AS signal_id, {STATUS.replace(' d ', ' x.d ')} AS status, x.v AS value
 FROM (SELECT doc_id AS item_id, unnest([{each}]) AS x, unnest(generate_series(0, {len(rows) - 1})) AS ord FROM documents)"""


SVG_ROWS = [
    ("provenance", "c2pa", "doc_id % 15 = 0", by(15, "'108 B manifest · Adobe_Firefly'")),
    ("provenance", "ai-generator", "doc_id % 3 = 0", by(3, "'Created by a generative AI model · Midjourney'")),
    ("provenance", "synthid", "NULL", "NULL"),
    ("metadata", "exif", "doc_id % 6 = 0", by(6, "'7 fields'")),
    ("metadata", "xmp", "doc_id % 3 = 0", by(3, "'347 B'")),
    ("metadata", "iptc", NEVER, "NULL"),
    ("metadata", "embedded-text", "doc_id % 2 = 0 OR doc_id % 7 = 0 OR doc_id % 12 = 0", f"nullif(concat_ws(', ', {by(2, repr('Title'))}, {by(7, repr('inkscape:version'))}, {by(12, repr('Comment'))}), '')"),
    ("metadata", "icc", NEVER, "NULL"),
    ("privacy", "gps", "doc_id % 6 = 0", by(6, SHOWN)),
    ("privacy", "timestamp", NEVER, "NULL"),
    ("privacy", "device", "doc_id % 6 = 0", by(6, MAKE)),
    ("privacy", "software", "doc_id % 3 = 0", by(3, "'Midjourney v6'")),
    ("privacy", "author", "doc_id % 3 = 0", by(3, "'A & B'")),
    ("privacy", "active-content", "doc_id % 5 = 0", by(5, "'1 script or handler'")),
    ("privacy", "remote-reference", NEVER, "NULL"),
    ("hidden", "hidden-unicode", "doc_id % 12 = 0", by(12, "'1 in embedded text'")),
]
_MADE_BY = "CASE WHEN doc_id % 5 = 0 THEN 'ChatGPT / DALL·E (OpenAI)' WHEN doc_id % 13 = 0 THEN 'Midjourney' WHEN doc_id % 17 = 0 THEN 'Adobe Firefly' END"
MARKDOWN_ROWS = [
    ("provenance", "ai-generator", "doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0", f"nullif(concat_ws(' · ', {_MADE_BY}, {by(7, repr('2 frontmatter keys'))}), '')"),
    ("provenance", "claude-watermark", "NULL", "NULL"),
    ("metadata", "embedded-text", "doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0", f"nullif(concat_ws(', ', {by(11, repr('1 comment'))}, {by(17, repr('1 structured-data block'))}, {by(13, repr('1 meta tag'))}), '')"),
    ("privacy", "author", "doc_id % 2 = 0", by(2, "'A B'")),
    ("privacy", "timestamp", "doc_id % 3 = 0", by(3, "'2026-01-02'")),
    ("privacy", "software", "doc_id % 5 = 0", by(5, "'ChatGPT 5'")),
    ("hidden", "hidden-unicode", "doc_id % 9 = 0", by(9, "'1 in the text'")),
]
#: Of the other formats: the signals that some files have, and of which ids; the rest they never have.
IMAGES = {
    "png": (1, {"ai-generator": "doc_id % 5 = 0 OR doc_id % 3 = 0", "author": "doc_id % 5 = 0", "software": "doc_id % 5 = 0", "xmp": "doc_id % 5 = 0", "device": "doc_id % 11 = 0", "exif": "doc_id % 11 = 0", "gps": "doc_id % 11 = 0", "embedded-text": "doc_id % 2 = 0 OR doc_id % 3 = 0"}),
    "webp": (4, {"ai-generator": "doc_id % 3 = 0", "author": "doc_id % 3 = 0", "software": "doc_id % 3 = 0", "xmp": "doc_id % 3 = 0", "device": "doc_id % 2 = 0", "exif": "doc_id % 2 = 0"}),
    "jpeg": (5, {"c2pa": "doc_id % 5 = 0", "ai-generator": "doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0", "author": "doc_id % 3 = 0", "software": "doc_id % 3 = 0", "xmp": "doc_id % 3 = 0", "exif": "doc_id % 2 = 0", "gps": "doc_id % 2 = 0", "device": "doc_id % 2 = 0", "embedded-text": "doc_id % 4 = 0", "hidden-unicode": "doc_id % 4 = 0"}),
}
IMAGE_SIGNALS = ["c2pa", "ai-generator", "synthid", "exif", "xmp", "iptc", "embedded-text", "icc", "gps", "timestamp", "device", "software", "author", "hidden-unicode"]


def _files() -> str:
    parts = [(f, f"doc_id % 7 = {k}", s, "NULL" if s == "synthid" else there.get(s, NEVER)) for f, (k, there) in IMAGES.items() for s in IMAGE_SIGNALS]
    parts += [("svg", "doc_id % 7 = 2", s, d) for _, s, d, _ in SVG_ROWS] + [("markdown", "doc_id % 7 = 3", s, d) for _, s, d, _ in MARKDOWN_ROWS]
    parts += [("markdown", "doc_id % 7 = 0 AND (doc_id // 7) % 4 = 3", s, "NULL" if d == "NULL" else NEVER) for _, s, d, _ in MARKDOWN_ROWS]
    rows = [f"SELECT '{f}' AS format, '{s}' AS signal_id, ({d})::BOOLEAN AS d, NULL AS reason FROM documents WHERE {where}" for f, where, s, d in parts]
    rows += [f"SELECT '{f}', NULL, NULL, '{reason}' FROM documents WHERE {where}" for f, reason, where in (("unknown", "unsupported-format", "doc_id % 7 = 0 AND (doc_id // 7) % 4 = 0"), ("svg", "corrupt", "doc_id % 7 = 0 AND (doc_id // 7) % 4 IN (1, 2)"), ("gif", "unsupported-format", "doc_id % 7 = 6"))]
    return f"SELECT format, signal_id, CASE WHEN signal_id IS NOT NULL THEN {STATUS} END AS status, reason, count(*) AS files FROM ({' UNION ALL '.join(rows)}) GROUP BY ALL"


ORACLES = {
    "svg_signals": _signals(SVG_ROWS),
    "markdown_signals": _signals(MARKDOWN_ROWS),
    "files_scan": _files(),
    "svg_refusals": "SELECT doc_id AS item_id, ['utf-16', 'not utf-8', 'other encoding', 'no svg element'][(doc_id // 7) % 4 + 1] AS reason, true AS left_alone FROM documents",
}


def _tags(parts: list[tuple[int, str]]) -> str:
    """Tags of the parts that an id has, in order: (of which multiples, tags)."""
    return "concat_ws(' ', " + ", ".join(by(n, f"'{tags}'") for n, tags in parts) + ")"


SEGMENTS = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'jpeg' ELSE 'png' END AS kind, len(string_split(tags, ' '))::BIGINT AS parts, tags FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0
 THEN {_tags([(1, 'E0'), (2, 'E1'), (3, 'E1 E1 E1'), (4, 'FE'), (5, 'EB'), (1, 'C0 DA')])} ELSE {_tags([(1, 'IHDR'), (2, 'tEXt'), (3, 'zTXt'), (5, 'iTXt'), (7, 'tIME'), (11, 'eXIf'), (4, 'prVt'), (1, 'IDAT IEND')])} END AS tags FROM documents)"""
PREVIEW = """SELECT doc_id, '{' || chr(10) || '  "title": "Doc \\"' || doc_id || '\\"",' || chr(10) || '  "order": ' || doc_id || ',' || chr(10) || '  "weight": ' || doc_id || '.5,' || chr(10)
 || '  "draft": ' || ['true', 'false', 'null'][doc_id % 3 + 1] || ',' || chr(10) || '  "source": ' || coalesce('"' || source || '"', 'null') || chr(10) || '}' AS preview,
 'STRING,BIGINT,DECIMAL,' || CASE WHEN doc_id % 3 < 2 THEN 'BOOLEAN' ELSE 'VOID' END || CASE WHEN source IS NULL THEN ',VOID' ELSE ',STRING' END AS kinds FROM documents"""
ORACLES |= {
    "segments_sql": SEGMENTS,
    "rollup_documents": f"SELECT source, lang, grouping_id(source, lang)::BIGINT AS level, count(*) AS documents, sum({words('text')})::BIGINT AS words FROM documents GROUP BY ROLLUP (source, lang)",
    "cube_statuses": f"WITH {SIGNAL_TABLE}, {facts('f', 0)} SELECT axis, status, grouping_id(axis, status)::BIGINT AS level, count(*) AS facts FROM f GROUP BY CUBE (axis, status)",
    "distinct_users": "SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 1",
    "front_matter_json": PREVIEW,
}
