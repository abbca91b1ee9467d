"""SQL of the operators on conversations, shards and manifests."""

from __future__ import annotations


def _crc_table() -> str:
    """The checksum's table for half bytes, from its polynomial."""
    found = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        found.append(str(value))
    return f"([{', '.join(found)}]::BIGINT[])"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, which DuckDB lacks."""

    def half(c: str) -> str:
        return f"xor(({c}) >> 4, {_crc_table()}[(({c}) & 15) + 1])"

    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (
        f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {octets}),"
        f" lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"
    )


def coded(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LEAST = "CASE WHEN {0} IS NULL THEN NULL ELSE {{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}} END"


def _way(state: str, cost: str, letter: str) -> str:
    return LEAST.format(state, cost, letter)


def _from(states: str, cost: str, letter: str) -> str:
    return ", ".join(_way(f"s{x}", cost, letter) for x in states)


# States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
REPAIR_SQL = f"""
WITH RECURSIVE
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM said, generate_series(1, CASE WHEN draw = 3 THEN 2 ELSE 1 END)
  WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         left(role, 1) AS initial, trim(text, {SPACES}) AS words
  FROM damaged),
seen AS (
  SELECT *, words = '' AS blank,
         words <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate
  FROM placed),
judged AS (
  SELECT *, NOT blank AND NOT duplicate AND right(words, 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) AS n
  FROM judged GROUP BY conv_id),
pairs AS (
  SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM judged)
  GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS pos, {{'c': 0::BIGINT, 'a': ''}} AS s0,
         NULL::STRUCT(c BIGINT, a VARCHAR) AS s1,
         {{'c': 5::BIGINT, 'a': 'I'}} AS s2, {{'c': 10::BIGINT, 'a': 'II'}} AS s3
  FROM facts
  UNION ALL
  SELECT conv_id, pos, s0, s1, s2, list_min([s3, {_way('s2', '5', 'I')}]) AS s3
  FROM (
    SELECT conv_id, pos, s0, s1, list_min([s2, {_from('013', '5', 'I')}]) AS s2, s3
    FROM (
      SELECT w.conv_id, j.pos, {_way('s0', '2', 'D')} AS s0,
             list_min([{_way('s1', '2', 'D')}, CASE WHEN ok AND initial = 's' THEN {_way('s0', 'dear', 'K')} END]) AS s1,
             list_min([{_way('s2', '2', 'D')}] || CASE WHEN ok THEN [{_from('013', 'dear + 1', 'R')}] ELSE [] END
                      || CASE WHEN ok AND initial = 'u' THEN [{_from('013', 'dear', 'K')}] ELSE [] END) AS s2,
             list_min([{_way('s3', '2', 'D')}] || CASE WHEN ok THEN [{_way('s2', 'dear + 1', 'R')}] ELSE [] END
                      || CASE WHEN ok AND initial = 'a' THEN [{_way('s2', 'dear', 'K')}] ELSE [] END) AS s3
      FROM walk w
      JOIN (SELECT conv_id, pos, initial, NOT blank AND NOT duplicate AS ok,
                   CASE WHEN truncated THEN 5 ELSE 0 END AS dear FROM judged) j
        ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1))),
best AS (
  SELECT w.conv_id, list_min([w.s0, w.s3]) AS b
  FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.pos),
letters AS (
  SELECT conv_id, unnest(string_split(b.a, '')) AS letter, generate_subscripts(string_split(b.a, ''), 1) AS nth
  FROM best WHERE b.a <> ''),
steps AS (
  SELECT conv_id, letter,
         sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nth) AS pos,
         sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nth) AS place
  FROM letters),
turns AS (
  SELECT s.conv_id, s.letter, s.place, j.role, CASE WHEN s.letter = 'I' THEN '' ELSE j.text END AS text,
         bool_or(s.letter = 'K' AND s.place = 1 AND j.initial = 's') OVER (PARTITION BY s.conv_id) AS led
  FROM steps s LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.pos = s.pos
  WHERE s.letter <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user'
                                  ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS lines
  FROM turns GROUP BY conv_id)
SELECT i.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
       coalesce(f.truncated, 0) AS truncated, coalesce(p.illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost,
       coalesce(b.b.a, '') AS audit, sha256(coalesce(r.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""

SHARDS = 40


def _best_shard(shards: int) -> str:
    draw = f"-1.0 / ln((('0x' || left(md5({coded('doc_id')} || '/' || i), 13))::BIGINT + 0.5) / 4503599627370496.0)"
    return (
        f"-list_max(list_transform(range({shards}), lambda i: {{'draw': {draw}, 'shard': -i}})).shard"
    )


SHARD_SQL = f"""
SELECT doc_id, size, {crc32("whole")} AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, grown_shard
FROM (
  SELECT doc_id, coalesce(text, '') AS whole, strlen(coalesce(text, '')) + 16 AS size,
         CAST({_best_shard(SHARDS)} AS INTEGER) AS shard, CAST({_best_shard(SHARDS + 1)} AS INTEGER) AS grown_shard
  FROM documents)
"""


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(coded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS changed
  FROM documents),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
node AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM ordered
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
  FROM node WHERE n > 1 GROUP BY lang, level, i // 2, n),
named AS (
  SELECT lang, h AS subroot, level AS levels, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, i, subroot AS h, n FROM named
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2, n),
-- One list of nodes: a tree's levels, and on top of them those of the tree of subroots.
way AS (
  SELECT o.lang, o.i AS id, 0 AS level, o.i, n.levels, n.i AS of, coalesce(o.changed, o.leaf) AS h, '' AS proof
  FROM ordered o JOIN named n ON n.lang IS NOT DISTINCT FROM o.lang
  UNION ALL
  SELECT w.lang, w.id, w.level + 1, (CASE WHEN w.level >= w.levels THEN w.of ELSE w.i END) // 2, w.levels,
         CASE WHEN w.level >= w.levels THEN w.of // 2 ELSE w.of END,
         sha256(CASE WHEN x.i < (CASE WHEN w.level >= w.levels THEN w.of ELSE w.i END) THEN x.h || w.h ELSE w.h || coalesce(x.h, '') END),
         w.proof || coalesce(x.h, '')
  FROM way w LEFT JOIN (
    SELECT lang, level, i, h, false AS upper FROM node UNION ALL
    SELECT n.lang, t.level + n.levels, t.i, t.h, true FROM top t, named n) x
    ON x.lang IS NOT DISTINCT FROM w.lang AND x.level = w.level AND x.upper = (w.level >= w.levels)
       AND x.i = xor(CASE WHEN w.level >= w.levels THEN w.of ELSE w.i END, 1)
  WHERE w.level < w.levels + (SELECT max(level) FROM top)),
folded AS (
  SELECT lang, id, h, proof FROM way WHERE level = levels + (SELECT max(level) FROM top))
SELECT o.doc_id, o.leaf, n.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM ordered o
JOIN named n ON n.lang IS NOT DISTINCT FROM o.lang
JOIN folded f ON f.lang IS NOT DISTINCT FROM o.lang AND f.id = o.i
CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""
