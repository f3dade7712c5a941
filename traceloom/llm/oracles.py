"""DuckDB SQL for the operators that SQL can express whole."""

from __future__ import annotations

import re

from .license_texts import PHRASES, TEMPLATES
from .licenses import COVERED, LONGER, NEIGHBOURS, VOTES
from .mixing import ORDERED, SHARD_BLOCKS, WEIGHTS

GAP = r"[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"


def _templates() -> str:
    rows = [(label, base, " ".join(re.findall("[a-z0-9]+", text.lower()))) for base, entries in ((True, PHRASES), (False, TEMPLATES)) for label, text in entries]
    return ", ".join(f"('{label}', {base}, '{text}')" for label, base, text in rows)


LICENSES = rf"""
WITH template(label, base, w) AS (SELECT label, base, string_split(text, ' ') FROM (VALUES {_templates()}) t(label, base, text)),
 grams AS (SELECT label, base, least(3, len(w)) AS k, len(w) AS size, i - 1 AS pos, w[i] AS w0, w[i + 1] AS w1, CASE WHEN len(w) > 2 THEN w[i + 2] END AS w2
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM template)),
 d AS (SELECT row_number() OVER () AS key, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda x: x <> '') AS w FROM documents),
 rolled AS (SELECT key, i - 1 AS place, w[i] AS d0, w[i + 1] AS d1, w[i + 2] AS d2 FROM (SELECT key, w, unnest(generate_series(1, len(w))) AS i FROM d)),
 hits AS (SELECT key, label, base, k, size, pos, place FROM rolled JOIN grams ON d0 = w0 AND d1 = w1 AND (w2 IS NULL OR w2 = d2)),
 votes AS (SELECT *, count(*) OVER (PARTITION BY key, label, base, place - pos) AS n FROM hits),
 diagonals AS (SELECT DISTINCT key, label, base, place - pos AS diagonal FROM votes WHERE base OR n >= {VOTES}),
 steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER line <= CASE WHEN base THEN 0 ELSE {NEIGHBOURS} END THEN 0 ELSE 1 END AS step FROM diagonals WINDOW line AS (PARTITION BY key, label, base ORDER BY diagonal)),
 passages AS (SELECT *, sum(step) OVER (PARTITION BY key, label, base ORDER BY diagonal) AS passage FROM steps),
 spans AS (SELECT h.key, h.label, h.base, h.k, h.size, passage, list({{'place': h.place, 'at': h.pos}} ORDER BY h.place, h.pos) AS hits
  FROM hits h JOIN passages p ON h.key = p.key AND h.label = p.label AND h.base = p.base AND h.place - h.pos = p.diagonal GROUP BY ALL),
 read AS (SELECT key, label, base, k, size, hits[1].place AS start, hits[-1].place + k AS stop,
  list_reduce(list_transform(hits, lambda h: {{'place': h.place::BIGINT, 'at': h.at::BIGINT, 'words': k::BIGINT}}), lambda s, h: CASE WHEN least(h.words, h.at - s.at, h.place - s.place) > 0
   THEN {{'place': h.place, 'at': h.at, 'words': s.words + least(h.words, h.at - s.at, h.place - s.place)}} ELSE s END, {{'place': -9::BIGINT, 'at': -9::BIGINT, 'words': 0::BIGINT}}).words AS words FROM spans),
 good AS (SELECT *, words / size AS covered FROM read WHERE words / size >= {COVERED} AND stop - start <= {LONGER} * size),
 per AS (SELECT key, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM good GROUP BY key)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per USING (key)
"""


def mixing(block: int, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> str:
    """The sources' targets by resharing, quotas by highest quotients, seeded blocks, and each document's part of these."""

    def seeded(*parts: str) -> str:
        return f"('0x' || substring(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 15))::BIGINT"

    return rf"""
WITH r AS (SELECT doc_id, coalesce('0' || source, '1') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x{{20}}\x{{09}}-\x{{0D}}]+'))::BIGINT AS size,
  {seeded("coalesce(doc_id::VARCHAR, '')", "coalesce(text, '')")} AS key FROM documents),
 sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM r GROUP BY skey),
 weighed AS (SELECT *, source_size * {cap}::DOUBLE AS most, {list(WEIGHTS)}[((row_number() OVER (ORDER BY skey) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS w FROM sizes),
 levels AS (SELECT *, most / w AS ratio, (sum(source_size) OVER () * {share}::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 common AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
 targets AS (SELECT skey, source_size, coalesce(least(most, common.level * w), most) AS target, ceil(source_size / {block})::BIGINT AS blocks FROM levels LEFT JOIN common ON true),
 quotients AS (SELECT skey, target / (2 * s - 1) AS quotient, s FROM (SELECT skey, target, unnest(generate_series(1, floor(blocks * {cap})::BIGINT)) AS s FROM targets)),
 won AS (SELECT skey, count(*) AS seats FROM (SELECT skey FROM quotients WHERE quotient > 0 ORDER BY quotient DESC, skey, s LIMIT (SELECT round(sum(target) / {block})::BIGINT FROM targets)) GROUP BY skey),
 quota AS (SELECT skey, source_size, target, blocks, CASE WHEN blocks > 0 THEN coalesce(seats, 0) // blocks ELSE 0 END AS whole, CASE WHEN blocks > 0 THEN coalesce(seats, 0) % blocks ELSE 0 END AS extra FROM targets LEFT JOIN won USING (skey)),
 shards AS (SELECT skey, extra, shard, least({SHARD_BLOCKS}, blocks - shard * {SHARD_BLOCKS}) AS has FROM (SELECT *, unnest(generate_series(0, (blocks - 1) // {SHARD_BLOCKS})) AS shard FROM quota WHERE blocks > 0)),
 ranked AS (SELECT skey, shard, extra, row_number() OVER (PARTITION BY skey ORDER BY has / (2 * s - 1) DESC, shard, s) AS rank FROM (SELECT *, unnest(generate_series(1, has)) AS s FROM shards)),
 places AS (SELECT skey, shard, count(*) AS seats FROM ranked WHERE rank <= extra GROUP BY ALL),
 numbered AS (SELECT skey, shard, seats, block, row_number() OVER (PARTITION BY skey, shard ORDER BY {seeded("skey", "block::VARCHAR")}, block) AS rank
  FROM (SELECT s.skey, s.shard, seats, unnest(generate_series(s.shard * {SHARD_BLOCKS}, s.shard * {SHARD_BLOCKS} + has - 1)) AS block FROM shards s JOIN places USING (skey, shard))),
 chosen AS (SELECT skey, block FROM numbered WHERE rank <= seats),
 stream AS (SELECT *, row_number() OVER () AS row, sum(size) OVER (PARTITION BY skey ORDER BY key % (SELECT greatest(1, least(65536, count(*) // {ORDERED})) FROM r), key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM r WHERE size > 0),
 parts AS (SELECT row, skey, start, size, unnest(generate_series((start // {block})::BIGINT, ((start + size - 1) // {block})::BIGINT)) AS block FROM stream),
 more AS (SELECT row, sum(least(start + size, (block + 1) * {block}) - greatest(start, block * {block})) AS more FROM parts JOIN chosen USING (skey, block) GROUP BY row),
 taken AS (SELECT doc_id, skey, size, coalesce(more, 0) AS more FROM stream LEFT JOIN more USING (row) UNION ALL SELECT doc_id, skey, size, 0 FROM r WHERE size = 0)
SELECT doc_id, size, source_size, target, (size * whole + more)::BIGINT AS taken FROM taken JOIN quota USING (skey)
"""


TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')"

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS w FROM documents),
 full_ AS (SELECT *, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
 totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM full_),
 postings AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM full_) GROUP BY ALL),
 asked AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
 weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term),
 norms AS (SELECT row, doc_id, 25 + (75 * n * docs) // length AS m FROM full_, totals),
 scores AS (SELECT item, item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN norms USING (row) GROUP BY ALL),
 ranked AS (SELECT item, item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

RESAMPLING = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
 d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS} AS w FROM documents),
 own AS (SELECT row, unnest(w) AS word FROM d),
 aim AS (SELECT unnest({TERMS}) AS word FROM benchmark),
 bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
   lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT word FROM own UNION SELECT word FROM aim), t),
 s AS (SELECT bucket, count(*) AS s FROM own JOIN bucket USING (word) GROUP BY bucket),
 a AS (SELECT bucket, count(*) AS t FROM aim JOIN bucket USING (word) GROUP BY bucket),
 totals AS (SELECT (SELECT count(*) FROM own) AS all_s, (SELECT count(*) FROM aim) AS all_t),
 gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN a USING (bucket), totals),
 sums AS (SELECT row, sum(gain)::BIGINT AS sum FROM own JOIN bucket USING (word) JOIN gains USING (bucket) GROUP BY row),
 weighed AS (SELECT row, doc_id, len(w)::BIGINT AS n_features, CASE WHEN sum IS NULL THEN 0 ELSE (sum - ((sum % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (row)),
 scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS eligible FROM weighed),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST) AS rank, 10 * count(*) OVER (PARTITION BY eligible) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND rank <= drawn THEN rank END::BIGINT AS rank FROM ranked
"""
