"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

_REACH = """reach AS (SELECT id, id AS seen FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) AS l ON l.a = r.seen),
comps AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id AS id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM w),
nodes AS (SELECT id, len(s) AS n FROM s), t AS (SELECT id, unnest(s) AS x FROM s),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM t a JOIN t b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM c JOIN nodes p ON p.id = c.a JOIN nodes q ON q.id = c.b WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)), {_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN comps USING (id)"""

OP4 = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, embedding::double[] AS e FROM embeddings),
links AS (SELECT p.id AS a, q.id AS b FROM nodes p JOIN nodes q ON p.label = q.label AND p.id < q.id AND list_cosine_similarity(p.e, q.e) >= 0.93),
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id), {_REACH}
SELECT id AS vec_id, coalesce(counts.n, 0) AS n_links, component_id, id = component_id AS kept FROM comps LEFT JOIN counts USING (id)"""

OP5 = """WITH v AS (SELECT vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP6 = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint & 1073741823 AS h FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), left(bin(size), 6), h % 16, h, doc_id) AS place FROM d),
s AS (SELECT source, sum(size)::bigint AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS weight FROM d GROUP BY source),
o AS (SELECT *, source_size * 2.0::double AS cap, row_number() OVER (ORDER BY source_size * 2.0::double / weight, source NULLS LAST) AS k, sum(source_size) OVER () * 1.5::double AS total, sum(weight) OVER () AS every FROM s),
f AS (SELECT *, every - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM o),
l AS (SELECT arg_min((total - filled) / remains, k) AS level FROM f WHERE (total - filled) / remains <= cap / weight),
g AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM f LEFT JOIN l ON true),
e AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END::double AS each,
(('0x' || substr(md5(coalesce(p.source, '~') || '/offset'), 1, 8))::bigint & 1073741823) / 1073741824.0::double AS start FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, greatest(0, least(floor(start + each * place) - floor(start + each * (place - 1)), 2))::bigint * size AS taken FROM e"""

OP9 = """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, list_filter(string_split(translate(lower(value), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '') AS w FROM l),
s AS (SELECT doc_id, line, row_number() OVER (ORDER BY doc_id, line) AS place, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) END AS s FROM w),
t AS (SELECT place, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT b.place, a.n AS m, b.n AS n, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.place < b.place GROUP BY a.place, b.place, a.n, b.n),
gone AS (SELECT DISTINCT place FROM c WHERE k >= 0.8::double * (m + n - k) - 1e-9)
SELECT doc_id, line::int AS line, place NOT IN (SELECT place FROM gone) AS kept FROM s"""


def _op11() -> str:
    near = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    steps = [f"""a{k} AS MATERIALIZED (SELECT id, part, x, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY d, entry) AS r
FROM (SELECT p.id, p.part, p.x, b.entry, {near} AS d FROM p JOIN b{k} b ON p.part = b.part)) WHERE r = 1),
m{k} AS (SELECT part, entry, list(v ORDER BY pos) AS c FROM (SELECT part, entry, pos, floor(sum(v) / count(*)) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM a{k}) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m{k}.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} ON m{k}.part = b.part AND m{k}.entry = b.entry)""" for k in range(5)]
    return f"""WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding::double[], lambda x: floor(1024 * x)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, e[part * len(e) // 4 + 1:(part + 1) * len(e) // 4] AS x FROM v, unnest([0, 1, 2, 3]) AS u(part)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x AS c FROM p WHERE id <= 256), {', '.join(steps)},
f AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a4 GROUP BY id),
s AS (SELECT sha256(string_agg(n::bigint::varchar, ',' ORDER BY part, entry, pos)) AS h FROM (SELECT part, entry, unnest(c) AS n, unnest(range(0, len(c))) AS pos FROM b4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, h AS codebooks_sha256 FROM v JOIN f USING (id), s"""


_ALNUM = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP12 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark), z AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM z)),
g AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM x))),
h AS (SELECT id, i, g.n, item_id FROM g JOIN x ON g.n = x.n AND g.x = x.x),
hit AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM h) GROUP BY id),
o AS (SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS items FROM h GROUP BY id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (id) LEFT JOIN o USING (id)"""

OP13 = """WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
g AS (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, unnest([1, 2, 3, 4]) AS u(k))),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::bigint AS n FROM w GROUP BY lang),
c AS (SELECT c.lang, c.k, c.p, c.f AS a, j, x.f AS l, y.f AS r, ((2000000::hugeint * c.f) // (x.f + y.f))::bigint AS score
FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1:]),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS o FROM c) WHERE o = 1),
i AS (SELECT lang, p[a:a + m - 1] AS p, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS a FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
o AS (SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM s LEFT JOIN i ON i.lang = s.lang AND i.p = s.p WHERE longer IS NULL OR 100::hugeint * longer < 80::hugeint * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES = {
    "op3_minhash": OP3,
    "op4_near_vectors": OP4,
    "op5_top_k": OP5,
    "op6_mixing": OP6,
    "op9_line_dedup": OP9,
    "op11_vector_codes": _op11(),
    "op12_decontaminate": OP12,
    "op13_collocations": OP13,
}
