"""DuckDB SQL for the rows of those queries that SQL can express.

The others need hashes, token ids, trained weights or a parsed page, and are
tested against plain Python on small tables.
"""

from __future__ import annotations

from tallyframe.llm.chat import CONTROLS, END, SAYS, TURN

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM wins
), places AS (
  SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), met AS (
  SELECT doc_id, item_id, p, places.size FROM places JOIN wins USING (s, size)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(len(w), 5) - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS low FROM d
  UNION
  SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node
), comp AS (
  SELECT node, min(low) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.node = d.doc_id
"""

REPEATS = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), chunks AS (
  SELECT doc_id, 400 * c AS base, len(h) // 2 - 400 AS last, substr(h, 800 * c + 1, 1600) AS part
  FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 400) // 400 + 1)) AS c FROM d WHERE len(h) >= 800)
), starts AS (
  SELECT doc_id, base + i AS i, md5(substr(part, 2 * i + 1, 800)) AS m
  FROM (SELECT doc_id, base, part, unnest(range(0, least(400, last - base + 1))) AS i FROM chunks)
), again AS (
  SELECT doc_id, i FROM starts WHERE m IN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1)
), islands AS (
  SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM again)
), spans AS (
  SELECT doc_id, g, min(i) AS s, max(i) + 400 AS e FROM islands GROUP BY doc_id, g
), kept AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS k
  FROM d JOIN (
    SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS z FROM spans
    UNION ALL
    SELECT doc_id, max(e), 1000000000 FROM spans GROUP BY doc_id
  ) o USING (doc_id) GROUP BY d.doc_id
), sums AS (
  SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_CONTROL = "|".join("".join(f"\\{c}" if c in "|[]<>/" else c for c in word) for word in CONTROLS).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/")
_TURN_CHARS = len(TURN) + len(SAYS) + len(END)

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({_TURN_CHARS} + length(role) + len(regexp_extract_all(role, '{_CONTROL}'))
    + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), occ AS (
  SELECT r, lang, source, unnest(w) AS t FROM d
), kept AS (
  SELECT lang, t, CAST(count(*) AS HUGEINT) AS c FROM occ GROUP BY lang, t HAVING count(DISTINCT r) >= 3
), used AS (
  SELECT lang, source, t, CAST(count(*) AS HUGEINT) AS c FROM occ GROUP BY lang, source, t
), langs AS (
  SELECT lang, count(*) AS v, sum(c) AS n, FROM kept GROUP BY lang
), own AS (
  SELECT lang, source, sum(used.c) AS n FROM used JOIN kept USING (lang, t) GROUP BY lang, source
), groups AS (
  SELECT g.lang, g.source, coalesce(own.n, 0) AS n, coalesce(langs.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own ON own.lang = g.lang AND own.source = g.source LEFT JOIN langs ON langs.lang = g.lang
), grid AS (
  SELECT g.lang, g.source, k.t, coalesce(u.c, 0) AS c, 1 + 1000000000 * (coalesce(u.c, 0) + 1) // (g.n + g.v) AS p,
    1 + 1000000000 * (k.c + 1) // (l.n + l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.t = k.t
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM grid WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

INFILL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, z + 1) || '<M>' || substr(t, a + 1, z - a)
    ELSE '<S>' || substr(t, z + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, z - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
