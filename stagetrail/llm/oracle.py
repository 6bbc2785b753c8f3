"""DuckDB SQL of the corpus queries that SQL can express."""

CHAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *,
    length(replace(text, '\\', '\\\\')) + length(regexp_replace(text, '<\\|turn\\|>|<\\|text\\|>|<\\|and\\|>|<\\|end\\|>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>', chr(1) || '\\0', 'g')) - length(text)
    + CASE WHEN before IS NOT DISTINCT FROM role THEN 7 ELSE 16 + length(role) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 7 END AS chars
  FROM placed
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

WARC = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), r AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(digest, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM r
"""

NEGATIVES = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
WHERE 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
t AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM n) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, t GROUP BY term, big_n),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN f USING (term), t GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50
"""

SQL: dict[str, str] = {"op2_relational_chat": CHAT, "op6_warc_chunks": WARC, "op11_anchor_lists": NEGATIVES, "op13_automaton_scan": SEARCH}
