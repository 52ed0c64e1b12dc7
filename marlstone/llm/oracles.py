"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {
    "op1_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to, 'whole' AS state
        FROM g
    """,
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             d AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op7_prefix_free_parsing": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
             w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, generate_series(0, n - 50) AS t(i)),
             f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
             l AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS new FROM w JOIN f USING (s) WHERE doc_id > m),
             r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l),
             s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
             g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM s),
             k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS pieces FROM g JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN last IS NULL THEN h ELSE pieces || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM w, generate_series(1, greatest(len(w) - 4, 1)) AS t(i) WHERE len(w) > 0),
             n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
             e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
             u AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
             r AS (SELECT DISTINCT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node WHERE r.root < u.y),
             c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
    """,
    "op11_pareto_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
             w AS (SELECT *, [3.0::DOUBLE, 1, 2][place % 3 + 1] AS weight FROM s),
             l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
                   FROM w WINDOW f AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             b AS (SELECT min_by(level, (source_size / weight, place)) AS best FROM l WHERE level * weight <= 2 * source_size),
             t AS (SELECT source, place, source_size, CASE WHEN best IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, best * weight) END AS target FROM l, b),
             c AS (SELECT t.*, size, sum(size)::DOUBLE AS words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY ALL),
             h AS (SELECT place, size, (target - 2 * (source_size - sum(words) OVER u)) / sum(words * pow(size, 0.5)) OVER u AS theta FROM c WINDOW u AS (PARTITION BY place ORDER BY size ROWS UNBOUNDED PRECEDING)),
             th AS (SELECT place, max_by(theta, size) AS theta FROM h WHERE theta * pow(size, 0.5) <= 2 GROUP BY place),
             e AS (SELECT d.doc_id, d.size, t.*, CASE WHEN size = 0 THEN 0 ELSE least(2.0::DOUBLE, coalesce(theta * pow(size, 0.5), 2.0::DOUBLE)) END AS copies,
                          (('0x' || substr(sha256('11:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN th USING (place)),
             q AS (SELECT *, floor(copies) AS whole, CASE WHEN copies > floor(copies) THEN (u / (1 - u)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS rank FROM e),
             r AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY place) AS remaining, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY place ORDER BY rank NULLS LAST, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q),
             g AS (SELECT place, max(remaining) - coalesce(max(upto) FILTER (rank IS NOT NULL AND upto <= remaining), 0) AS gap FROM r GROUP BY place),
             z AS (SELECT place, min_by(upto, (abs(size - gap), upto)) AS closing FROM r JOIN g USING (place) WHERE rank IS NOT NULL AND upto > remaining AND abs(size - gap) < gap GROUP BY place)
        SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rank IS NOT NULL AND (upto <= remaining OR upto IS NOT DISTINCT FROM closing) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r LEFT JOIN z USING (place)
    """,
    "op12_prefix_trie": r"""
        WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS place, sha256(length(role) || ':' || role || text) AS digest, length(text) AS chars FROM o),
             c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
                          xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
                                          lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, i: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT)::BIGINT % 6 AS h
                   FROM (SELECT DISTINCT conv_id FROM n)),
             k AS (SELECT conv_id, base, h, least(h, n_base) AS heads FROM (SELECT c.*, count(n.place) AS n_base FROM c LEFT JOIN n ON n.conv_id = base GROUP BY ALL)),
             m AS (SELECT k.conv_id, place AS depth, digest, chars FROM k JOIN n ON n.conv_id = base AND place <= h
                   UNION ALL SELECT conv_id, heads + place - h, digest, chars FROM k JOIN n USING (conv_id) WHERE place > h),
             p AS (SELECT conv_id, depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, max(depth) OVER (PARTITION BY conv_id) AS last FROM m
                   UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM m WHERE m.conv_id = k.conv_id), 0) FROM k),
             v AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '') AS ends FROM p GROUP BY key, depth),
             j AS (SELECT v.*, u.conv_id AS parent_conv_id FROM v LEFT JOIN v u ON u.depth = v.depth - 1 AND u.key = left(v.key, 64 * (v.depth - 1)::INT)),
             w AS (SELECT key, count(*) AS n_children FROM (SELECT left(key, 64 * (depth - 1)::INT) AS key FROM v WHERE depth > 0) GROUP BY key),
             s AS (SELECT p.key, count(*) FILTER (w.key IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved_tokens FROM v x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth LEFT JOIN w ON w.key = x.key GROUP BY p.key)
        SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
        FROM j LEFT JOIN w USING (key) JOIN s USING (key)
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
             h AS (SELECT *, len(u) AS n, [('0x' || substr(x, 8 * i + 1, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM d),
             c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
             p AS (SELECT *, coalesce(array_to_string(u[:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
}
