"""The derivations of `workloads.tables`, and the text helpers, in DuckDB SQL."""

from __future__ import annotations

BLANK = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{BLANK}+|{BLANK}+\z', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}+'), lambda w: w <> '')"


def by_presence(got: str, want: str, both: str) -> str:
    return (
        f"CASE WHEN {got} = 0 AND {want} = 0 THEN 1.0 "
        f"WHEN {got} = 0 OR {want} = 0 THEN 0.0 ELSE {both} END"
    )


SAMPLES = """
samples AS (
  SELECT 'd' || (a.conv_id % 4) AS dataset, a.conv_id * 1000000000 + a.turn AS sample_idx,
         a.text AS input, b.text AS reference, a.conv_id, a.turn
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'
)"""

_HALF = (
    f"array_to_string(list_slice({words('reference')}, 1, len({words('reference')}) // 2), ' ')"
)

CONVERSATION_PAIRS = f"""{SAMPLES},
pairs AS (
  SELECT 'echo' AS model, dataset, sample_idx, input, reference,
         CASE (conv_id + turn) % 6
           WHEN 0 THEN reference
           WHEN 1 THEN chr(12288) || reference || chr(9)
           WHEN 2 THEN {_HALF}
           WHEN 3 THEN replace(reference, 'e', 'E')
           WHEN 4 THEN input || ' ' || reference
           ELSE '' END AS prediction,
         (conv_id + turn) % 6 = 2 AS failed
  FROM samples
)"""

NUMERIC_PAIRS = """
pairs AS (
  SELECT event_id AS sample_idx,
         CASE event_id % 11
           WHEN 6 THEN translate(value::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩')
           WHEN 7 THEN repeat('7', 20000) || 'x'
           WHEN 8 THEN '1' || repeat('_1', 2500) || '_'
           WHEN 9 THEN '0.1' || repeat('_1', 2500)
           WHEN 1 THEN value::VARCHAR || '0'
           WHEN 2 THEN chr(12288) || ' ' || value::VARCHAR || chr(10)
           WHEN 3 THEN '1_0' || value::VARCHAR
           WHEN 4 THEN value::VARCHAR || 'd'
           WHEN 5 THEN 'nan' ELSE value::VARCHAR END AS prediction,
         CASE event_id % 11
           WHEN 3 THEN '10' || value::VARCHAR || 'e0'
           WHEN 8 THEN repeat('1', 2501) WHEN 9 THEN '.' || repeat('1', 2501)
           WHEN 5 THEN 'NaN' ELSE value::VARCHAR END AS reference
  FROM events
)"""

DOCUMENT_PAIRS = """
pairs AS (
  SELECT lang AS dataset, doc_id AS sample_idx, text AS reference,
         array_to_string(
           list_filter(string_split(text, chr(10)), lambda line, place: place % 3 <> 0), chr(10)
         ) AS prediction
  FROM documents
)"""

PASSAGE_PAIRS = """
pairs AS (
  SELECT d.doc_id AS sample_idx, d.text AS prediction,
         CASE WHEN d.doc_id % 2 = 0 THEN ' ' || list_last(string_split(d.text, chr(10)))
              ELSE b.text END AS reference
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
)"""

PART_PAIRS = """
pairs AS (
  SELECT p_partkey AS sample_idx,
         CASE p_partkey % 4
           WHEN 0 THEN lower(p_type) || ' ' || p_name
           WHEN 1 THEN p_brand || ', ' || p_name
           WHEN 2 THEN chr(12288) || p_name || ' ' || p_type
           ELSE p_brand END AS prediction,
         p_name || ' ' || p_type AS reference
  FROM part
)"""

LISTED_PAIRS = """
pairs AS (
  SELECT p_partkey AS sample_idx,
         CASE p_partkey % 4
           WHEN 0 THEN p_type || chr(10) || p_name || chr(10) || p_brand
           WHEN 1 THEN p_name || chr(10) || ' ' || p_brand || chr(10) || ' ' || p_brand
           WHEN 2 THEN ' ' || p_name || chr(10) || p_brand || chr(10) || p_type || chr(10)
           ELSE lower(p_name) || chr(10) || chr(10) || p_type END AS prediction,
         p_name || chr(10) || p_brand || chr(10) || p_type AS reference
  FROM part
)"""

JSON_PAIRS = """
pairs AS (
  SELECT event_id AS sample_idx, props AS reference,
         CASE event_id % 8
           WHEN 1 THEN replace(props, '}', ', "extra": [1, 2]}')
           WHEN 2 THEN replace(props, '"k"', '"other"')
           WHEN 3 THEN replace(props, '}', '')
           WHEN 4 THEN '[' || props || ']'
           WHEN 5 THEN replace(props, '"', '''')
           WHEN 6 THEN '{}'
           WHEN 7 THEN props || ' trailing' ELSE props END AS prediction
  FROM events
)"""

RAW_RESPONSES = """
responses AS (
  SELECT event_id,
         CASE event_id % 9
           WHEN 5 THEN '{"choices":[{"message":null}]}'
           WHEN 6 THEN '{"choices":[null]}'
           WHEN 7 THEN '{"choices":[{"message":{}}]} ' || event_type || ' ' || value
           WHEN 8 THEN '{"choices":[{"message":{"content":null}}]}'
           WHEN 1 THEN '{"choices":[{}]}'
           WHEN 2 THEN '{"choices":[]}'
           WHEN 3 THEN '{"error":"' || event_type || ' ' || value || '"}'
           WHEN 4 THEN '{"choices":[{"message":{"content":"' || event_type || ' ' || value
           ELSE '{"choices":[{"message":{"content":"' || event_type || ' ' || value || '"}}]}'
         END AS raw
  FROM events
)"""

# One row per sample of every dataset document, with the document's settings.
DOCUMENT_SAMPLES = f"""{SAMPLES},
placed AS (
  SELECT *, conv_id // 16 AS number, turn // 8 AS stretch
  FROM samples
),
numbered AS (
  SELECT number, 'set_' || number || '_' || stretch AS dataset, input, reference,
         row_number() OVER (PARTITION BY number, stretch ORDER BY sample_idx) - 1 AS sample_idx
  FROM placed
),
documents_made AS (
  SELECT dataset, any_value(number) AS number, count(*) AS sample_total,
         'Answer set ' || any_value(number) || '。' AS instruction,
         (any_value(number) % 5)::INTEGER AS output_length,
         CASE WHEN any_value(number) % 2 = 0 THEN ['exact_match', 'rouge_l']
              ELSE ['word_count_similarity', 'contains_answer'] END AS metrics,
         least(any_value(number) % 4, count(*)) AS few_shot_total
  FROM numbered GROUP BY dataset
)"""

SCORE_LOG = """
log AS (
  SELECT 'm' || (user_id % 2) AS model, 'u' || (user_id % 10) AS dataset,
         json_extract_string(props, '$.k')::BIGINT AS sample_idx, event_type AS metric,
         value AS score, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS updated_at,
         event_id AS seq, value > 60 AS is_builtin
  FROM events
),
first_part AS (SELECT * FROM log WHERE updated_at < '2024-01-16'),
changes AS (SELECT * FROM log WHERE updated_at >= '2024-01-16'),
current_scores AS (
  SELECT model, dataset, sample_idx, metric,
         list_last(list(score ORDER BY updated_at, seq)) AS score,
         min(updated_at) AS created_at, max(updated_at) AS updated_at,
         max(is_builtin::INT) = 1 AS is_builtin, min(score) >= 3 AS is_active
  FROM first_part GROUP BY ALL
),
merged AS (
  SELECT coalesce(c.model, n.model) AS model, coalesce(c.dataset, n.dataset) AS dataset,
         coalesce(c.sample_idx, n.sample_idx) AS sample_idx,
         coalesce(c.metric, n.metric) AS metric,
         coalesce(n.score, c.score) AS score,
         coalesce(c.created_at, n.created_at) AS created_at,
         coalesce(n.updated_at, c.updated_at) AS updated_at,
         coalesce(c.is_builtin, false) OR coalesce(n.is_builtin, false) AS is_builtin,
         coalesce(c.is_active, true) AS is_active
  FROM current_scores c FULL JOIN (
    SELECT model, dataset, sample_idx, metric,
           list_last(list(score ORDER BY updated_at, seq)) AS score,
           min(updated_at) AS created_at, max(updated_at) AS updated_at,
           max(is_builtin::INT) = 1 AS is_builtin
    FROM changes GROUP BY ALL
  ) n ON c.model = n.model AND c.dataset = n.dataset
     AND c.sample_idx = n.sample_idx AND c.metric = n.metric
)"""

# Longest common subsequence of the token lists a and b of table `lists(id, a, b)`, row
# by row over anti-diagonals: a cell only needs the two diagonals before its own.
LCS = """
walk(id, a, b, step, before, last) USING KEY (id) AS (
  SELECT id, a, b, 1, list_transform(range(0, len(a) + 1), lambda k: 0),
         list_transform(range(0, len(a) + 1), lambda k: 0)
  FROM lists
  UNION ALL
  SELECT id, a, b, step + 1, last,
         list_prepend(0, list_transform(range(1, len(a) + 1), lambda k:
           CASE WHEN step + 1 - k BETWEEN 1 AND len(b)
                THEN greatest(last[k], last[k + 1],
                              before[k] + (a[k] = b[step + 1 - k])::INT)
                ELSE last[k + 1] END))
  FROM walk WHERE step < len(a) + len(b)
),
lcs AS (
  SELECT id, len(a) AS size_a, len(b) AS size_b, last[len(a) + 1] AS common
  FROM walk WHERE step = len(a) + len(b)
)"""
