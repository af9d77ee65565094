"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_DIVERGENCE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
seen AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM seen GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM seen SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + s.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
lang_counts AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term),
lang_shares AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + v) AS q
  FROM lang_counts JOIN sizes USING (lang)
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
telling AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM telling)
)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 200
"""

_FILL_IN_MIDDLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
cut AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(regexp_extract_all(t, '[^\n]*\n|[^\n]+')) + 1) AS u1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(regexp_extract_all(t, '[^\n]*\n|[^\n]+')) + 1) AS u2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4
  FROM docs
),
parts AS (
  SELECT doc_id, t, len(units)::BIGINT AS n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 100 THEN 'plain'
         WHEN r4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(u1, u2)], '') AS prefix,
    array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS middle,
    array_to_string(units[greatest(u1, u2) + 1:], '') AS suffix
  FROM cut
),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM parts
),
back AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(split_part(output, '<P>', 2), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<P>', 1) END AS restored
  FROM made
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM back
"""

ORACLES: dict[str, str] = {
    "op11_divergence": _DIVERGENCE,
    "op12_fill_in_middle": _FILL_IN_MIDDLE,
}
