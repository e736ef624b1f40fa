"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

_SPACE = r"[^\x20\x09-\x0D]"
_CRC = """list_reduce([4294967295::UBIGINT] || list_transform(string_split(key, ''), lambda ch: ascii(ch)::UBIGINT),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (a & 1::UBIGINT))))"""

#: Cost and audit of every grammar state, from a conversation's last row to its first.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hit AS (SELECT *, xor({_CRC}, 4294967295::UBIGINT) % 20 AS h FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         regexp_extract(text, '(?s)({_SPACE})[\\x20\\x09-\\x0D]*$', 1) AS last FROM damaged
), counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed
), faults AS (
  SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial,
         CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM counted
), facts AS (
  SELECT conv_id, list(initial ORDER BY pos) AS initials, list(fault ORDER BY pos) AS faults,
         string_agg(initial, '' ORDER BY pos) AS line, count(*) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated
  FROM faults GROUP BY conv_id
), walk AS (
  SELECT conv_id, n AS pos, {{'c': 0, 'a': ''}} AS v0, {{'c': 10, 'a': 'II'}} AS v1, {{'c': 5, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3,
         initials, faults FROM facts
  UNION ALL
  SELECT conv_id, pos,
         least(w0, {{'c': 5 + w2.c, 'a': 'I' || w2.a}}, {{'c': 10 + w3.c, 'a': 'II' || w3.a}}),
         least(w1, {{'c': 5 + w2.c, 'a': 'I' || w2.a}}, {{'c': 10 + w3.c, 'a': 'II' || w3.a}}),
         least(w2, {{'c': 5 + w3.c, 'a': 'I' || w3.a}}), least(w3, {{'c': 5 + w2.c, 'a': 'I' || w2.a}}), initials, faults
  FROM (
    SELECT conv_id, pos - 1 AS pos, initials, faults,
           least({{'c': 2 + v0.c, 'a': 'D' || v0.a}}, {{'c': stay + 1 + v2.c, 'a': 'R' || v2.a}},
                 {{'c': stay + CASE i WHEN 'u' THEN v2.c WHEN 's' THEN v1.c ELSE 1000000 END, 'a': 'K' || CASE i WHEN 's' THEN v1.a ELSE v2.a END}}) AS w0,
           least({{'c': 2 + v1.c, 'a': 'D' || v1.a}}, {{'c': stay + 1 + v2.c, 'a': 'R' || v2.a}},
                 {{'c': stay + CASE i WHEN 'u' THEN v2.c ELSE 1000000 END, 'a': 'K' || v2.a}}) AS w1,
           least({{'c': 2 + v2.c, 'a': 'D' || v2.a}}, {{'c': stay + 1 + v3.c, 'a': 'R' || v3.a}},
                 {{'c': stay + CASE i WHEN 'a' THEN v3.c ELSE 1000000 END, 'a': 'K' || v3.a}}) AS w2,
           least({{'c': 2 + v3.c, 'a': 'D' || v3.a}}, {{'c': stay + 1 + v2.c, 'a': 'R' || v2.a}},
                 {{'c': stay + CASE i WHEN 'u' THEN v2.c ELSE 1000000 END, 'a': 'K' || v2.a}}) AS w3
    FROM (SELECT *, initials[pos] AS i, CASE faults[pos] WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000 END AS stay FROM walk WHERE pos > 0)
  )
), best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM walk WHERE pos = 0
), steps AS (
  SELECT conv_id, p, audit[p] AS edit,
         length(replace(audit[1:p], 'I', '')) AS source, length(replace(audit[1:p], 'D', '')) AS place
  FROM best, unnest(range(1, length(audit) + 1)) AS positions(p)
), kept AS (
  SELECT s.conv_id, s.place, s.edit, f.role, CASE WHEN s.edit = 'I' THEN '' ELSE f.text END AS text, f.initial,
         max(CASE WHEN s.place = 1 AND s.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led
  FROM steps s LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.source AND s.edit <> 'I'
  WHERE s.edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                             chr(10) ORDER BY place) AS body
  FROM kept GROUP BY conv_id
), everyone AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
       coalesce(f.truncated, 0) AS truncated,
       coalesce(list_sum(list_transform(range(1, length(f.line)), lambda k: CASE WHEN f.line[k:k + 1] IN ('su', 'ua', 'au') THEN 0 ELSE 1 END)), 0)::BIGINT AS illegal,
       coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM everyone e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _lloyd(rounds: int = 4, entries: int = 256) -> str:
    """A full scan of every codebook in every round."""
    steps = [
        f"""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS row FROM kept
), parts AS (
  SELECT row, part, v[(part * (len(v) // 4) + 1):((part + 1) * (len(v) // 4))] AS x FROM numbered, unnest(range(4)) AS of_part(part)
), book0 AS (SELECT part, row AS entry, x AS e FROM parts WHERE row < {entries})"""
    ]
    for turn in range(rounds + 1):
        steps.append(
            f"""near{turn} AS (
  SELECT row, part, any_value(x) AS x,
         min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, e) + list_dot_product(e, e), 'j': entry}}) AS best
  FROM parts JOIN book{turn} USING (part) GROUP BY row, part
)"""
        )
        if turn < rounds:
            steps.append(
                f"""sums{turn} AS (
  SELECT part, best.j AS entry, pos, floor(sum(x[pos]) / count(*)) AS mean FROM near{turn}, unnest(range(1, len(x) + 1)) AS places(pos) GROUP BY ALL
), means{turn} AS (SELECT part, entry, list(mean ORDER BY pos) AS e FROM sums{turn} GROUP BY ALL
), book{turn + 1} AS (SELECT part, entry, coalesce(m.e, b.e) AS e FROM book{turn} b LEFT JOIN means{turn} m USING (part, entry))"""
            )
    return f"""
WITH {", ".join(steps)}, coded AS (
  SELECT row, string_agg(lower(printf('%02x', best.j)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM numbered JOIN coded USING (row), digest
"""


VECTOR_CODES = _lloyd()
