"""DuckDB counterparts of queries that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM (SELECT doc_id, {_LOWER} AS text FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
    least(w.doc_id, coalesce(m.b, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON w.doc_id = m.a
"""


def _quality_rules() -> str:
    from candorlake.llm import rules

    without = lambda p: f"length(text) - length(regexp_replace(text, '{p}', '', 'g'))"
    classes = [without(p.replace("'", "''")) for p in rules.CLASSES.values()]
    size = len(classes) + 4
    total = ", ".join(f"sum(chars[{i}])" for i in range(1, size + 1))
    half = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    both = lambda p, q: f"({half(p, f'(({p} + {q}) / 2)')} + {half(q, f'(({p} + {q}) / 2)')})"
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
f AS MATERIALIZED (SELECT doc_id, lang, len(ws) AS n_words, length(text) AS n_chars, strlen(text) AS bytes, {without('[\\x20\\x09-\\x0D]').replace('length(text) - ', '')} AS word_chars, {without('[#*$%&|<>]')} AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, [{', '.join(classes)}] AS cls FROM w),
h AS MATERIALIZED (SELECT *, list_concat(cls, [n_chars - word_chars, n_symbols, bytes - n_chars, bytes - list_sum(cls) - (n_chars - word_chars) - n_symbols - (bytes - n_chars)]) AS chars FROM f),
runs AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS run, unnest(range(1, len(ws) - 6)) AS pos FROM w WHERE len(ws) > 8),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS k FROM runs) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT pos + s) AS n FROM twice, range(0, 8) t(s) GROUP BY doc_id),
of_doc AS MATERIALIZED (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(ws) AS word FROM w) GROUP BY ALL),
langs AS MATERIALIZED (SELECT ref, n, list_transform(sums, lambda x: x / all_bytes) AS char_ref FROM (SELECT lang AS ref, sum(n_words) AS n, [{total}] AS sums, sum(bytes) AS all_bytes FROM h WHERE lang IN (SELECT lang FROM w WHERE len(ws) > 0 GROUP BY lang HAVING count(*) >= {rules.LEAST_TEXTS}) GROUP BY lang)),
common AS MATERIALIZED (SELECT ref, word, k / langs.n AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, word) AS rn FROM (SELECT lang, word, sum(n) AS k FROM of_doc GROUP BY lang, word)) JOIN langs ON lang = ref WHERE rn <= {rules.COMMON}),
whole AS (SELECT ref, sum(q) AS q_common FROM common GROUP BY ref),
met AS (SELECT h.doc_id, ref, sum(of_doc.n) AS k, sum({both('(of_doc.n / h.n_words)', 'q')} - q) AS more FROM of_doc JOIN common USING (word) JOIN h ON h.doc_id = of_doc.doc_id GROUP BY ALL),
sums AS (SELECT h.doc_id, ref, chars, bytes, char_ref, (n_words - coalesce(k, 0)) / greatest(n_words, 1) AS p_rest, 1 - q_common AS q_rest, q_common + coalesce(more, 0) AS of_common FROM h CROSS JOIN langs JOIN whole USING (ref) LEFT JOIN met USING (doc_id, ref)),
d AS (SELECT doc_id, ref, sqrt(greatest(0, (of_common + {both('p_rest', 'q_rest')}) / 2)) AS wd,
  sqrt(greatest(0, list_sum(list_transform(range(1, {size} + 1), lambda i: {both('(chars[i] / greatest(bytes, 1))', 'char_ref[i]')})) / 2)) AS cd FROM sums),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(wd, 12), ref) AS rn FROM d) WHERE rn = 1),
v AS (SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_chars, ref, cd, wd, n_words < {rules.LEAST_BASE_WORDS} OR 100 * coalesce(rep.n, 0) > {rules.REPEATED_PERCENT} * n_words AS base_failed
  FROM h LEFT JOIN rep USING (doc_id) LEFT JOIN best USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {rules.LEAST_CHARS} AND cd > {rules.CHAR_LIMIT}::DOUBLE + {rules.CHAR_CHANCE}::DOUBLE / sqrt(greatest(n_chars, 1)), false)
  AND NOT coalesce(n_words >= {rules.LEAST_WORDS} AND wd > {rules.WORD_LIMIT}::DOUBLE + {rules.WORD_CHANCE}::DOUBLE / sqrt(greatest(n_words, 1)), false) AS kept,
  ref AS closest_lang, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM v
"""


QUALITY_RULES = _quality_rules()
