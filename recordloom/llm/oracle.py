"""SQL counterparts of the corpus queries that SQL can express."""

#: zlib's checksum of a text ``s`` in a relation ``keys``: a table by byte, folded over the bytes.
_CRC = """
    crc_table AS (
        SELECT list(list_reduce(list_prepend(b, range(8)),
                    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
        FROM range(256) g(b)
    ),
    key_bytes AS (SELECT s, hex(encode(s)) AS h FROM keys),
    crcs AS (
        SELECT s, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, length(h)::BIGINT, 2), lambda i: (
                (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)::BIGINT)),
            lambda c, o: xor(c >> 8, t[1 + (xor(c, o) & 255)])), 4294967295) AS crc
        FROM key_bytes, crc_table
    )"""

ORACLE = {
    "op8_exact_dedup": """
        WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               text_sha256
        FROM rows WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op11_top_products": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ),
        pairs AS (
            SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
            FROM vectors q JOIN vectors r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 5
    """,
    "op12_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        keys AS (SELECT DISTINCT conv_id::VARCHAR AS s FROM own),
        {_CRC},
        convs AS (SELECT s::BIGINT AS conv_id, s::BIGINT - s::BIGINT % 20 AS base, crc % 4 AS h FROM crcs),
        lengths AS (SELECT conv_id AS base, count(*) AS has FROM own GROUP BY conv_id),
        rebuilt AS (
            SELECT c.conv_id, o.place - h + least(h, coalesce(has, 0)) AS place, digest, text
            FROM convs c JOIN own o ON o.conv_id = c.conv_id AND place >= h LEFT JOIN lengths l ON l.base = c.base
            UNION ALL
            SELECT c.conv_id, place, digest, text FROM convs c JOIN own o ON o.conv_id = c.base AND place < h
        ),
        members AS (
            SELECT conv_id, place + 1 AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place) AS key,
                   len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
            FROM rebuilt
            UNION ALL SELECT conv_id, 0, '', 0 FROM convs
        ),
        nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM members GROUP BY ALL),
        children AS (SELECT depth - 1 AS depth, left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        valued AS (
            SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key
        ),
        sums AS (
            SELECT a AS depth, left(key, 64 * a) AS key, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS leaves
            FROM valued, unnest(range(0, depth + 1)) AS u(a) GROUP BY ALL
        ),
        lasts AS (SELECT conv_id, max_by(key, depth) AS key, max(depth) AS depth FROM members GROUP BY conv_id),
        ends AS (SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM lasts GROUP BY ALL)
        SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, leaves AS n_leaves,
               saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM valued v JOIN sums s ON s.depth = v.depth AND s.key = v.key
        LEFT JOIN ends e ON e.depth = v.depth AND e.key = v.key
        LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.key = left(v.key, 64 * (v.depth - 1))
    """,
    "op13_spelling": f"""
        WITH RECURSIVE found AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents
        ),
        runs AS (
            SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
            FROM found GROUP BY ALL
        ),
        keys AS (SELECT DISTINCT id || ':' || run AS s FROM runs),
        {_CRC},
        damaged AS (
            SELECT CASE WHEN crc % 199 = 0
                        THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2)
                        ELSE run END AS word, c
            FROM runs JOIN crcs ON s = id || ':' || run
        ),
        words AS (
            SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
        ),
        shortened AS (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM words, unnest(range(1, length(word)::BIGINT + 1)) AS u(i)
        ),
        indels AS (SELECT DISTINCT s.word AS a, w.word AS b FROM shortened s JOIN words w ON s.rest = w.word),
        near AS (
            SELECT a.word AS a, b.word AS b FROM shortened a JOIN shortened b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a, b FROM indels UNION SELECT b, a FROM indels
        ),
        ranked AS (
            SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place
            FROM near JOIN words ON word = b
        ),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
                   CASE WHEN r.n >= 5 * w.n THEN b END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
            FROM words w LEFT JOIN ranked r ON a = w.word AND place = 1
        ),
        steps AS (
            SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
            UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
        ),
        last AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
        SELECT f.word, n, n_near, form, form_n, coalesce(root, f.word) AS root FROM formed f LEFT JOIN last USING (word)
    """,
}
