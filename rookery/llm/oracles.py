"""DuckDB SQL for the operators that SQL can express."""

from rookery.llm.license_scan import CONTAINMENT, LICENSE_NOTICES, LICENSE_TEXTS, PART, SLACK

_WORDS = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, sizes.n, unnest(range(1, len(w) - sizes.n + 2)) AS p, w FROM d, sizes WHERE len(w) >= sizes.n),
hits AS (SELECT DISTINCT dp.doc_id, dp.n, dp.p, win.item_id FROM (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM dp) dp JOIN win ON dp.n = win.n AND dp.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(c.n_hit, 0)::bigint AS n_hit, coalesce(f.n_items, 0)::bigint AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_NOTICES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in (LICENSE_NOTICES | LICENSE_TEXTS).items())
# every shingle of a part asks for the region of its tile
LICENSES = rf"""
WITH d AS (SELECT doc_id, string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS sh FROM d WHERE len(w) >= 3),
t0 AS (SELECT l, string_split_regex(regexp_replace(lower(x), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+$', ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (VALUES {_NOTICES}) v(l, x)),
t1 AS (SELECT l, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS q FROM t0),
t2 AS (SELECT l, unnest(range(0, len(q), {PART})) AS part, q FROM t1),
t3 AS (SELECT l, part, list_slice(q, part + 1, part + {PART}) AS seq FROM t2),
t AS (SELECT l, part, len(seq) AS size, list_distinct(seq) AS t, sum(len(list_distinct(seq))) OVER (PARTITION BY l) AS of FROM t3),
ts AS (SELECT l, part, size, of, t, unnest(t) AS g FROM t),
occ AS (SELECT doc_id, sh, unnest(range(0, len(sh))) AS p, unnest(sh) AS g FROM s),
hit AS (SELECT DISTINCT doc_id, sh, l, part, size, of, t, p // size AS tile FROM occ JOIN ts USING (g)),
reg AS (SELECT doc_id, l, part, of, t, greatest(0, (tile - 1) * size - {SLACK}) AS start, list_slice(sh, greatest(0, (tile - 1) * size - {SLACK}) + 1, (tile + 2) * size + {SLACK}) AS region FROM hit),
c AS (SELECT doc_id, l, part, of, len(list_intersect(region, t)) AS n, start + list_position(list_transform(region, lambda x: list_contains(t, x)), true) - 1 AS first_word FROM reg),
b AS (SELECT doc_id, l, part, of, max(n) AS n, min(first_word) AS first_word FROM c GROUP BY doc_id, l, part, of)
SELECT doc_id, l AS license, (sum(n) / of)::double AS containment, min(first_word)::int AS first_word
FROM b GROUP BY doc_id, l, of HAVING sum(n) / of >= {CONTAINMENT}
"""

ORACLES = {"op1_license_scan": LICENSES, "op3_exact_top_k": TOP_K, "op7_benchmark_decontamination": DECONTAMINATION}
