"""Comparison SQL (DuckDB) for the operators that SQL can express."""

from __future__ import annotations

from tidebook.llm import collocations, lines, merkle, mixing, rollups

# One row per placed block: a released block (release <= slot) with the earliest deadline goes next.
MIXING = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce('s' || source, '-') AS key, coalesce(length(text), 0) AS size, coalesce(md5(doc_id::VARCHAR), '') AS ord FROM documents
), totals AS (
  SELECT key, sum(size)::BIGINT AS chars, pow(sum(size)::DOUBLE, {mixing.POWER}) AS weight FROM rows_ GROUP BY key
), scaled AS (
  SELECT key, chars // {mixing.BLOCK_CHARS} + 1 AS blocks, CASE WHEN max(weight) OVER () > 0 THEN weight / max(weight) OVER () ELSE 1.0 END AS u FROM totals
), whole AS (
  SELECT key, blocks, floor(u / sum(u) OVER () * {mixing.SCALE})::HUGEINT AS w FROM scaled
), params AS (
  SELECT list(w ORDER BY key) AS ws, list(blocks ORDER BY key) AS bs, list(key ORDER BY key) AS ks, sum(w)::HUGEINT AS total, count(*) AS n FROM whole WHERE w > 0
), placed AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS pick, 0::BIGINT AS block, list_transform(ws, lambda w: 0::BIGINT) AS done, false AS real, ws, bs, total, n FROM params
  UNION ALL
  SELECT slot, pick, done[pick + 1] AS block, list_transform(done, lambda d, i: d + (i = pick + 1)::BIGINT), true, ws, bs, total, n FROM (
    SELECT * EXCLUDE (slot, pick, soonest), now_ AS slot,
      (list_min(list_transform(done, lambda d, i: CASE WHEN d < bs[i] AND d * total // ws[i] <= now_ THEN ((d + 1) * total + ws[i] - 1) // ws[i] * n + i - 1 END)) % n)::BIGINT AS pick
    FROM (SELECT *, greatest(slot + 1, soonest)::BIGINT AS now_ FROM (SELECT *, list_min(list_transform(done, lambda d, i: CASE WHEN d < bs[i] THEN d * total // ws[i] END)) AS soonest FROM placed) WHERE soonest IS NOT NULL))
), slots AS (
  SELECT ks[pick + 1] AS key, block, slot FROM placed CROSS JOIN params WHERE real
  UNION ALL  -- sources of weight 0 come last
  SELECT key, block, coalesce((SELECT max(slot) + 1 FROM placed WHERE real), 0) + row_number() OVER (ORDER BY key, block) - 1
  FROM (SELECT key, unnest(range(0, blocks)) AS block FROM whole WHERE w = 0)
), started AS (
  SELECT doc_id, source, key, coalesce(sum(size) OVER (PARTITION BY key ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM rows_
)
SELECT a.doc_id, a.source, s.block::BIGINT AS block, s.slot::BIGINT AS slot, a.start FROM started a JOIN slots s ON s.key = a.key AND s.block = a.start // {mixing.BLOCK_CHARS}
"""

LINES = f"""
WITH texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
split AS (SELECT text, string_split(text, chr(10)) AS ls FROM texts),
each_ AS (SELECT text, ls, unnest(range(1, len(ls) + 1)) AS no FROM split),
raw AS (
  SELECT text, no, ls[no] AS line, CASE WHEN no > 1 THEN 'p' || ls[no - 1] ELSE '-' END || chr(10) || CASE WHEN no < len(ls) THEN 'n' || ls[no + 1] ELSE '-' END AS place FROM each_
), tokens AS (
  SELECT text, no, place, line, list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''),
    lambda w: CASE WHEN regexp_matches(w, '[0-9@]|://') THEN '{lines.WILDCARD}' ELSE w END) AS t
  FROM raw
), leafed AS (
  SELECT * EXCLUDE (r), len(t) AS size, CASE WHEN len(t) >= {lines.MIN_TOKENS} THEN t[1:{lines.LEADING}] ELSE r END AS lead
  FROM (SELECT *, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS r FROM tokens) WHERE len(t) > 0
), spread AS (
  SELECT size, lead, text, no, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM leafed
), copies AS (
  SELECT coalesce(text, '') AS text, count(*) AS rows_ FROM documents GROUP BY 1
), constant AS (
  SELECT size, lead, pos, token FROM spread JOIN copies USING (text) WHERE token <> '{lines.WILDCARD}'
  GROUP BY size, lead, pos, token HAVING sum(rows_) >= {lines.MIN_PLACES}
), generalised AS (
  SELECT s.size, s.lead, s.text, s.no, list(CASE WHEN c.token IS NULL THEN '{lines.WILDCARD}' ELSE s.token END ORDER BY s.pos) AS g, count(c.token) AS known, list(s.token ORDER BY s.pos) AS t
  FROM spread s LEFT JOIN constant c ON c.size = s.size AND c.lead = s.lead AND c.pos = s.pos AND c.token = s.token
  GROUP BY s.size, s.lead, s.text, s.no
), templates AS (
  SELECT size, lead, text, no, CASE WHEN size < {lines.MIN_TOKENS} THEN list_prepend('s', lead) WHEN known >= {lines.MIN_CONSTANT} AND known >= {lines.CONSTANT_SHARE} * size THEN list_prepend('+', g) ELSE list_prepend('-', t) END AS template FROM generalised
), placed AS MATERIALIZED (
  SELECT m.*, l.place, l.line, md5(l.line) AS raw FROM templates m JOIN leafed l ON l.text = m.text AND l.no = m.no
), counts AS (
  SELECT size, lead, template, count(DISTINCT place) AS places, count(DISTINCT text) AS texts FROM placed GROUP BY ALL
), often AS MATERIALIZED (
  SELECT p.* FROM placed p JOIN counts c ON c.size = p.size AND c.lead = p.lead AND c.template = p.template WHERE c.texts >= {lines.MIN_PLACES}
), common AS (
  SELECT text, list(DISTINCT raw) AS common, sum(length(line)) AS taken, min(raw) AS first FROM often GROUP BY text
), own AS (
  SELECT c.*, length(replace(c.text, chr(10), '')) AS len, list_min(list_filter(list_transform(list_filter(s.ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')), lambda x: md5(x)), lambda h: NOT list_contains(c.common, h))) AS own
  FROM common c JOIN split s ON s.text = c.text
), origins AS (
  SELECT text, CASE WHEN own IS NOT NULL AND len - taken >= {lines.MIN_OWN} * len THEN 'own' || own ELSE 'copy' || first END AS origin FROM own
), documents_ AS (
  SELECT size, lead, template, count(DISTINCT origin) AS docs FROM often JOIN origins USING (text) GROUP BY ALL
), recurring AS (
  SELECT size, lead, template FROM counts WHERE places >= {lines.MIN_PLACES} AND 2 * places >= texts
  UNION SELECT size, lead, template FROM documents_ WHERE docs >= {lines.MIN_PLACES}
), gone AS (
  SELECT m.text, list(m.no) AS nos FROM templates m JOIN recurring r ON r.size = m.size AND r.lead = m.lead AND r.template = m.template GROUP BY m.text
), kept AS (
  SELECT s.text, len(s.ls) AS n, CASE WHEN g.nos IS NULL THEN s.ls ELSE list_transform(list_filter(range(1, len(s.ls) + 1), lambda i: NOT list_contains(g.nos, i)), lambda i: s.ls[i]) END AS k
  FROM split s LEFT JOIN gone g ON g.text = s.text
)
SELECT d.doc_id, k.n::BIGINT AS n_lines, (k.n - len(k.k))::BIGINT AS n_dropped,
  length(coalesce(array_to_string(k.k, chr(10)), ''))::BIGINT AS kept_chars, md5(coalesce(array_to_string(k.k, chr(10)), '')) AS kept_md5
FROM documents d JOIN kept k ON k.text = coalesce(d.text, '')
"""

REMARK = "Released under the MIT License."

ROLLUP = f"""
WITH kept AS (
  SELECT source, lang, replace(coalesce(text, ''), '{REMARK}', '') AS t FROM documents
  QUALIFY coalesce(doc_id, 9223372036854775807) = min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY coalesce(text, ''))
), counted AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '{rollups.WORDS}')) AS n FROM kept
  UNION ALL SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '{rollups.PIECES}')) FROM kept
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM counted GROUP BY ALL
"""

# The checksum of an id is folded bit by bit: a byte enters by xor, then eight shifts (-1).
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"""


def _fields(n_chars: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))


def _tree(name: str, start: str) -> str:
    """Nodes of every level, and each bottom node's siblings as L, R or N (none) and the hash, bottom up."""
    return f"""
{name} AS (
  SELECT grp, 0 AS lvl, pos, n, h FROM {start}
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 2, n
), {name}_top AS (
  SELECT grp, h AS top FROM {name} WHERE n = 1
), {name}_path AS (
  SELECT s.grp, s.pos, list(CASE WHEN b.h IS NULL THEN 'N' WHEN b.pos < (s.pos >> a.lvl) THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY a.lvl) AS path
  FROM {start} s JOIN {name} a ON a.grp = s.grp AND a.pos = s.pos >> a.lvl AND a.n > 1
  LEFT JOIN {name} b ON b.grp = a.grp AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1) GROUP BY s.grp, s.pos
)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, sha256({_fields('n_chars')}) AS h,
    CASE WHEN doc_id IS NOT NULL AND {CRC32} % {merkle.EVERY} = 0 THEN sha256({_fields('(n_chars + 1)')}) END AS tampered
  FROM documents
), bottom AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), {_tree('low', 'bottom')}, langs AS (
  SELECT '' AS grp, grp AS member, top AS h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low_top
), {_tree('high', 'langs')}, whole AS (
  SELECT b.doc_id, b.h AS leaf, coalesce(b.tampered, b.h) AS start, l.h AS subroot, (SELECT top FROM high_top) AS root,
    list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
  FROM bottom b JOIN langs l ON l.member = b.grp LEFT JOIN low_path p ON p.grp = b.grp AND p.pos = b.pos LEFT JOIN high_path q ON q.pos = l.pos
), folded AS (
  SELECT *, list_reduce(list_prepend(start, path), lambda h, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || h) WHEN 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s[2:]), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.NO_LANG}') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists
), f AS (
  SELECT lang, words, list_aggregate(ws[i : i + words - 1], 'string_agg', ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS words) WHERE i + words - 1 <= len(ws) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= {collocations.LEAST}
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = list_aggregate(c.ws[1 : k], 'string_agg', ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = list_aggregate(c.ws[k + 1 :], 'string_agg', ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, list_aggregate(ws[i : i + size - 1], 'string_agg', ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, words - size + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS size FROM candidates)) GROUP BY ALL
), kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < {collocations.SHARE} * a
)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM kept k JOIN total t ON t.lang = k.lang WHERE rank <= {collocations.TOP}
"""
