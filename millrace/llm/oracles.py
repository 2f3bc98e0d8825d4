"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

_OP3 = "SELECT doc_id, text, lang, source, n_chars FROM documents"

_OP4 = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
base AS (SELECT doc_id, host, t, ls, len(ws) AS n_words, ws,
                coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
g AS (SELECT doc_id, t, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS gram
      FROM (SELECT doc_id, t, ws, unnest(range(1, n_words - 1)) AS i FROM base)),
dup AS (SELECT doc_id, t, unnest([i, i + 1, i + 2]) AS k FROM (SELECT doc_id, t, i, count(*) OVER (PARTITION BY doc_id, t, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, t, count(DISTINCT k) AS n_repeat_words FROM dup GROUP BY ALL),
texts AS (SELECT DISTINCT host, t, ls FROM base),
lines AS (SELECT host, t, array_to_string(list_filter(string_split_regex(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS n
          FROM (SELECT host, t, unnest(ls) AS l FROM texts)),
hot AS (SELECT host, n FROM lines GROUP BY host, n HAVING count(DISTINCT t) > 100),
gone AS (SELECT host, t, sum(len(string_split(n, ' '))) AS removed_words FROM lines SEMI JOIN hot USING (host, n) GROUP BY host, t),
j AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words,
             n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
      FROM base b LEFT JOIN rep ON rep.doc_id = b.doc_id AND rep.t = b.t LEFT JOIN gone ON gone.host = b.host AND gone.t = b.t)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, removed_words::BIGINT AS removed_words, base_failed,
       NOT base_failed AND NOT (removed_words > 0 AND (100 * removed_words > 50 * n_words OR n_words - removed_words < 25)) AS kept
FROM j
"""

_OP6 = r"""
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                  (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)) - 1 AS i FROM conversations),
a AS (SELECT pair_id, max(i) AS last, min(i) AS first FROM t WHERE role = 'assistant' GROUP BY pair_id),
c AS (SELECT t.*, a.last, a.first FROM t JOIN a USING (pair_id) WHERE i <= last),
w AS (SELECT pair_id, max(text) FILTER (i = last) AS good, coalesce(max(text) FILTER (i = first AND first < last), '') AS bad, max(last) AS last FROM c GROUP BY pair_id),
p AS (SELECT pair_id, coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (i < last), '') AS before FROM c GROUP BY pair_id),
x AS (SELECT pair_id, good, bad, before, last, '<|im_start|>assistant' || chr(10) || good || '<|im_end|>' || chr(10) AS g, '<|im_start|>assistant' || chr(10) || bad || '<|im_end|>' || chr(10) AS b FROM w JOIN p USING (pair_id))
SELECT pair_id, (CASE WHEN good = bad THEN last + 1 ELSE last END)::BIGINT AS n_prompt_turns,
       CASE WHEN good = bad THEN before || g ELSE before END AS prompt,
       CASE WHEN good = bad THEN '' ELSE g END AS chosen, CASE WHEN good = bad THEN '' ELSE b END AS rejected,
       CASE WHEN good = bad THEN '' ELSE '22:' || length(g) END AS chosen_mask, CASE WHEN good = bad THEN '' ELSE '22:' || length(b) END AS rejected_mask
FROM x
"""

_OP7 = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
      FROM v q JOIN v p ON q.row <> p.row WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

_OP8 = """
WITH RECURSIVE sizes AS (SELECT coalesce('=' || source, '') AS s, sum(greatest(coalesce(length(text), 0), 1))::DOUBLE AS size FROM documents GROUP BY 1),
rates AS (SELECT s, round(pow(size, 0.5) / sum(pow(size, 0.5)) OVER () / (size / sum(size) OVER ()), 9) AS rate FROM sizes),
terms AS (SELECT s, rate, 0 AS k, -rate AS logp, exp(-rate) AS c FROM rates
          UNION ALL SELECT s, rate, k + 1, logp + ln(rate) - ln((k + 1)::DOUBLE), c + exp(logp + ln(rate) - ln((k + 1)::DOUBLE)) FROM terms WHERE k < ceil(rate + 10 * sqrt(rate) + 24)),
u AS (SELECT *, ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (terms.c <= u.u) AS n FROM u JOIN terms ON terms.s = coalesce('=' || u.source, '') GROUP BY ALL)
SELECT doc_id, unnest(range(n))::INT AS copy, text, lang, source, n_chars FROM n
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, substring(t, 1, p) AS pre, substring(t, p + 1, q - p) AS mid, substring(t, q + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (q - p)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

_OP13 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM w GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY 1, 2),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
m AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM n, s),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN v USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

SQL = {
    "op3_tiered_shards": _OP3,
    "op4_quality_rules": _OP4,
    "op5_ngram_jaccard": _OP5,
    "op6_preference_chat": _OP6,
    "op7_exact_topk": _OP7,
    "op8_poisson_mix": _OP8,
    "op12_fill_in_middle": _OP12,
    "op13_ranked_search": _OP13,
}
