"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, run)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT sha1(h) AS sha, min(page_id) AS first, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS sha, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * i + 1, 1) AS INT) * 16 + CAST(substr(bits, 5 * i + 2, 1) AS INT) * 8
         + CAST(substr(bits, 5 * i + 3, 1) AS INT) * 4 + CAST(substr(bits, 5 * i + 4, 1) AS INT) * 2 + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN n > 1 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND first <> page_id THEN first END AS refers_to
FROM b JOIN f USING (sha)
"""

OP6 = """
WITH t AS (SELECT conv_id AS pair_id, list(struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS a FROM conversations GROUP BY conv_id),
k AS (SELECT pair_id, a, coalesce(list_max([i FOR i IN range(1, len(a) + 1) IF a[i].role = 'assistant']), 0) AS last FROM t),
b AS (SELECT pair_id, a, [struct_pack(role := a[i].role, body := CASE WHEN i = last THEN split_part(a[i].body, '.', 1) || '.' ELSE a[i].body END) FOR i IN range(1, len(a) + 1)] AS b FROM k),
n AS (SELECT pair_id, a, b, coalesce(list_min([i FOR i IN range(1, len(a) + 1) IF a[i] <> b[i]]) - 1, len(a)) AS n FROM b),
r AS (SELECT pair_id, n, ['<|' || x.role || '|>' || chr(10) || x.body || '<|end|>' || chr(10) FOR x IN a] AS ta, ['<|' || x.role || '|>' || chr(10) || x.body || '<|end|>' || chr(10) FOR x IN b] AS tb, a, b FROM n)
SELECT pair_id, CAST(n AS BIGINT) AS n_prompt_turns, coalesce(array_to_string(ta[1:n], ''), '') AS prompt,
       coalesce(array_to_string(ta[n + 1:], ''), '') AS chosen_text, coalesce(array_to_string(tb[n + 1:], ''), '') AS rejected_text,
       coalesce(array_to_string([(coalesce(list_sum([len(ta[j]) FOR j IN range(n + 1, i)]), 0) + len(a[i].role) + 5)::BIGINT::VARCHAR || ':' || (list_sum([len(ta[j]) FOR j IN range(n + 1, i + 1)]))::BIGINT::VARCHAR
         FOR i IN range(n + 1, len(a) + 1) IF a[i].role = 'assistant'], ','), '') AS chosen_spans,
       coalesce(array_to_string([(coalesce(list_sum([len(tb[j]) FOR j IN range(n + 1, i)]), 0) + len(b[i].role) + 5)::BIGINT::VARCHAR || ':' || (list_sum([len(tb[j]) FOR j IN range(n + 1, i + 1)]))::BIGINT::VARCHAR
         FOR i IN range(n + 1, len(b) + 1) IF b[i].role = 'assistant'], ','), '') AS rejected_spans
FROM r
"""

_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
size AS (SELECT row, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
q AS (SELECT row, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS row, item_id, {_TERMS.format("coalesce(text, '')")} AS w FROM benchmark)),
tf AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
impact AS (SELECT size.row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS s
           FROM tf JOIN size USING (row) JOIN weight USING (term), total),
score AS (SELECT q.row AS q, any_value(item_id) AS item_id, impact.row, any_value(doc_id) AS doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN impact USING (term) GROUP BY q.row, impact.row),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES = {"op6_preference": OP6, "op4_warc_zip": OP4, "op7_decontaminate": OP7, "op12_ranked_search": OP12}
