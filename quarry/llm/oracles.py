"""SQL for DuckDB that must give the rows of the queries that SQL can express."""

_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda d, i: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

MERKLE = f"""WITH RECURSIVE d AS (
    SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
        CASE WHEN ({_CRC}) % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
    FROM documents
), p AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), t AS (
    SELECT s, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM p
    UNION ALL
    SELECT s, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY s, lvl, pos // 16
), sub AS (SELECT s, h AS subroot FROM t WHERE n = 1),
u AS (
    SELECT 0 AS lvl, s AS pos, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
    UNION ALL
    SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, pos // 16
), w AS (
    SELECT p.r, t.lvl AS step, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.pos >> (4 * t.lvl)), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.pos >> (4 * t.lvl)), '') AS b
    FROM p JOIN t ON t.s = p.s AND t.n > 1 AND t.pos >> 4 = p.pos >> (4 * t.lvl + 4) GROUP BY p.r, p.pos, t.lvl
    UNION ALL
    SELECT p.r, 100 + u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < p.s >> (4 * u.lvl)), ''), coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > p.s >> (4 * u.lvl)), '')
    FROM p JOIN u ON u.n > 1 AND u.pos >> 4 = p.s >> (4 * u.lvl + 4) GROUP BY p.r, p.s, u.lvl
), path AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM w GROUP BY r),
k AS (SELECT r, a, b, row_number() OVER (PARTITION BY r ORDER BY step) AS i FROM w),
f AS (
    SELECT r, 0 AS i, coalesce(other, leaf) AS h FROM p
    UNION ALL
    SELECT f.r, k.i, sha256(k.a || f.h || k.b) FROM f JOIN k ON k.r = f.r AND k.i = f.i + 1
), z AS (SELECT r, arg_max(h, i) AS folded FROM f GROUP BY r),
g AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p JOIN sub USING (s) JOIN z USING (r) LEFT JOIN path USING (r) CROSS JOIN g"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED = f"""WITH q AS (
    SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_FOLD.format("text")}, '{_TERM}')) AS t FROM benchmark) GROUP BY ALL
), d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("text")}, '{_TERM}') AS terms FROM documents),
c AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t),
s AS (
    SELECT i, any_value(item_id) AS item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
    FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY i, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM d),
g AS (SELECT r, pos, string_agg(w, ' ') OVER x AS seq, count(*) OVER x AS n FROM w WINDOW x AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
a AS (SELECT r, unnest(list(pos)) AS pos FROM g WHERE n = 8 GROUP BY r, seq HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM a, range(8) AS t(k) GROUP BY r),
l AS (SELECT r, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
k AS (SELECT r, source, text, line, array_to_string(regexp_extract_all({_FOLD.format("line")}, '{_WORD}'), ' ') AS norm, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l),
m AS (SELECT source, norm, count(DISTINCT text) AS texts FROM k WHERE n > 0 GROUP BY source, norm HAVING texts > 10),
x AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM k WHERE n > 0 GROUP BY r),
y AS (SELECT r, sum(n) AS gone, count(*) AS n_lines_removed FROM k JOIN m ON k.norm = m.norm AND k.source IS NOT DISTINCT FROM m.source WHERE n > 0 GROUP BY r),
b AS (
    SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, (len(words) - coalesce(gone, 0))::BIGINT AS n_words_left
    FROM d LEFT JOIN rep USING (r) LEFT JOIN x USING (r) LEFT JOIN y USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT base_failed AND n_words_left >= 5 AND 100 * n_words_left >= 20 * n_words AS kept FROM b"""

SQL = {"op11_merkle_manifest": MERKLE, "op12_ranked_search": RANKED, "op13_quality_rules": QUALITY}
