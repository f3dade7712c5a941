"""DuckDB SQL for object graphs, revisions and boxes: what the made files were made with, by id, and recursion instead of rounds."""

from __future__ import annotations

OBJECT_GRAPHS = """
WITH RECURSIVE o AS (SELECT o_custkey AS item, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 r AS (SELECT o.item, o.node AS src, l_linenumber AS position, coalesce(t.node, -1) AS dst
  FROM lineitem JOIN o ON l_orderkey = o.node LEFT JOIN o t ON t.item = o.item AND t.p = (o.p + 1 + l_partkey % 7) % (o.n + 1)),
 walk(item, node, depth, n) AS (SELECT item, node, 0, n FROM o WHERE p = 0 UNION SELECT w.item, r.dst, w.depth + 1, w.n FROM walk w JOIN r ON r.item = w.item AND r.src = w.node WHERE r.dst >= 0 AND w.depth < w.n),
 reached AS (SELECT item, node, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL),
 sized AS (SELECT *, count(*) OVER (PARTITION BY item) AS objects, row_number() OVER (PARTITION BY item ORDER BY node) AS number FROM reached),
 kept AS (SELECT * FROM sized WHERE objects <= 12),
 targets AS (SELECT s.item, s.node, string_agg(coalesce(d.number::VARCHAR, 'null'), ',' ORDER BY r.position, d.number NULLS FIRST) AS targets
  FROM kept s JOIN r ON r.item = s.item AND r.src = s.node LEFT JOIN kept d ON d.item = r.item AND d.node = r.dst GROUP BY ALL)
SELECT item, node, number AS new_number, depth, coalesce(targets, '') AS targets, NULL AS reason FROM kept LEFT JOIN targets USING (item, node)
UNION ALL SELECT DISTINCT item, NULL, NULL, NULL, NULL, 'too many objects' FROM sized WHERE objects > 12
"""


def _revision(r: int) -> str:
    """The columns of revision r from those before: places of its two objects and its section, and the file up to its end."""
    b, at = f"b{r - 1}", lambda x: f"lpad(({x})::VARCHAR, 10, '0')"
    first, second = f"strlen({b})", f"strlen({b}) + 20"
    section = f"strlen({b}) + 40"
    before = f"' /Prev ' || x{r - 1}" if r > 1 else "CASE WHEN doc_id % 5 = 0 THEN ' /Prev ' || (strlen(b0) + 40) WHEN doc_id % 7 = 0 THEN ' /Prev 3' ELSE '' END"
    file = f"{b} || '1 0 obj\\n(r{r})\\nendobj\\n' || '{r + 1} 0 obj\\n(r{r})\\nendobj\\n' || 'xref\\n0 2\\n0000000000 65535 f \\n' || {at(first)} || ' 00000 n \\n{r + 1} 1\\n' || {at(second)} || ' 00000 n \\n' || 'trailer\\n<< /Size 9 /Root 1 0 R' || {before} || ' >>\\nstartxref\\n' || ({section}) || '\\n%%EOF\\n'"
    return f"{first} AS f{r}, {second} AS s{r}, {section} AS x{r}, " + file.replace("\\n", "' || chr(10) || '") + f" AS b{r}"


def _revisions() -> str:
    steps = ["SELECT doc_id, 1 + doc_id % 4 AS n, '%PDF-1.4' || chr(10) || coalesce(text, '') || chr(10) AS b0 FROM documents"]
    for r in range(1, 5):
        steps.append(f"SELECT *, {_revision(r)} FROM t{r - 1}")
    tables = ", ".join(f"t{i} AS ({s})" for i, s in enumerate(steps))
    rows = " UNION ALL ".join(f"SELECT doc_id, n, n - {r} AS revision, {o} AS object, {c}{r} AS \"offset\", {seen} AS visible FROM t4 WHERE n >= {r}" for r in range(1, 5) for o, c, seen in ((1, "f", f"n = {r}"), (r + 1, "s", "true")))
    return f"WITH {tables} SELECT doc_id, n AS revisions, CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'degraded' ELSE 'whole' END AS state, revision::BIGINT AS revision, object::BIGINT AS object, \"offset\", visible FROM ({rows})"


#: path, depth, kind, start and stop from where the outer box starts, reason; by what the id leaves when divided by 4.
BOXES = (
    (0, "0", 0, "jumb", 0, 60, None), (0, "0/0", 1, "jumd", 8, 24, None), (0, "0/1", 1, "jumb", 24, 48, None), (0, "0/1/0", 2, "jumd", 32, 48, None), (0, "0/2", 1, "cbor", 48, 60, None),
    (1, "0", 0, "jumb", 0, 40, None), (1, "0/0", 1, "jumd", 8, 24, None), (1, "0/1", 1, "cbor", 24, 40, "longer than its parent"),
    (2, "0", 0, "jumb", 0, 30, None), (2, "0/0", 1, "jumd", 8, 24, None), (2, "0/1", 1, None, 24, 30, "no room for a header"),
    (3, "0", 0, "jumb", 0, 40, None), (3, "0/0", 1, "jumd", 8, 24, None), (3, "0/1", 1, "json", 24, 40, "shorter than its header"),
)


def _boxes() -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    rows = ", ".join(f"({', '.join(map(q, b))})" for b in BOXES)
    start = "strlen(coalesce(text, ''))"
    return f"SELECT doc_id, path, depth::BIGINT AS depth, kind, {start} + a AS start, {start} + z AS stop, reason FROM documents JOIN (VALUES {rows}) b(m, path, depth, kind, a, z, reason) ON doc_id % 4 = m"


ORACLES = {"object_graphs": OBJECT_GRAPHS, "revision_chains": _revisions(), "box_trees": _boxes()}
