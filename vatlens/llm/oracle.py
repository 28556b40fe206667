"""DuckDB SQL for the queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

SQL["op4_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
         unnest([list_slice(w, i, i + least(len(w), 10) - 1)
                 for i in range(1, len(w) - least(len(w), 10) + 2)]) AS win
       FROM b WHERE len(w) > 0),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w
       FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT r, i, bw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = list_slice(w, i, i + dw.n - 1)),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

SQL["op5_chat"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS m,
        string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                   ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS text
      FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, m, n, any_value(text) AS text FROM c GROUP BY m, n),
p AS (SELECT DISTINCT list_slice(m, 1, k) AS m FROM (SELECT m, unnest(range(1, n)) AS k FROM u))
SELECT conv_id, n AS n_turns, text FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.m = u.m)
"""
