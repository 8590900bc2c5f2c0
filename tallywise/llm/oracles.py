"""SQL twins of the registered queries of the text operators, where SQL can express them."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op13_collocations"] = r"""
WITH pieces AS (
    SELECT g, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS g,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
), worded AS (
    SELECT g, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spans AS (
    SELECT g, w, unnest([1, 2, 3, 4]) AS k FROM worded WHERE len(w) > 0
), grams AS (
    SELECT g, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM spans WHERE len(w) >= k
), f AS (
    SELECT g, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM grams GROUP BY 1, 2, 3
), sizes AS (
    SELECT g, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY g
), c AS (
    SELECT g, phrase, words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 30
), cuts AS (
    SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, words)) AS k FROM c)
), scored AS (
    SELECT c.g, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a // (x.n + y.n))::BIGINT AS score
    FROM cuts c JOIN f x ON x.g = c.g AND x.phrase = c.head JOIN f y ON y.g = c.g AND y.phrase = c.tail
), lowest AS (
    SELECT g, phrase, a, l, r, score FROM scored
    QUALIFY row_number() OVER (PARTITION BY g, phrase ORDER BY score, k) = 1
), inner_spans AS (
    SELECT g, a, w, words, unnest(range(2, words)) AS k FROM c WHERE words > 2
), inner_phrases AS (
    SELECT g, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, words - k + 2)) AS i FROM inner_spans) GROUP BY 1, 2
), ranked AS (
    SELECT g, phrase, a, l, r, score,
           row_number() OVER (PARTITION BY g ORDER BY score DESC, a DESC, encode(phrase)) AS rank
    FROM lowest LEFT JOIN inner_phrases USING (g, phrase)
    WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)
)
SELECT g AS lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (g) WHERE rank <= 2000
"""

ORACLE_SQL["op11_merkle_manifest"] = """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i:
        CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t
), named AS (
    SELECT *, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS crc
    FROM documents, crc
), fields AS (
    SELECT doc_id, lang, n_chars, crc,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail FROM named
), hashed AS (
    SELECT doc_id, lang,
           sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           CASE WHEN crc % 7 = 0 THEN
               sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS tampered
    FROM fields
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM hashed
), lower_tree AS (
    SELECT 0 AS level, g, pos, leaf AS d, n FROM leaves
    UNION ALL
    SELECT level + 1, g, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
    FROM lower_tree WHERE n > 1 GROUP BY level, g, pos // 2, n
), subroots AS (
    SELECT g, d, level AS height, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), upper_tree AS (
    SELECT 0 AS level, g AS pos, d, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
    FROM upper_tree WHERE n > 1 GROUP BY level, pos // 2, n
), nodes AS (
    SELECT g, level, pos, d, n FROM lower_tree WHERE n > 1
    UNION ALL
    SELECT s.g, s.height + u.level, u.pos, u.d, u.n FROM upper_tree u, subroots s WHERE u.n > 1
), folds AS (
    SELECT l.g, l.pos AS leaf_pos, 0 AS level, l.pos, coalesce(l.tampered, l.leaf) AS d, '' AS siblings FROM leaves l
    UNION ALL
    SELECT f.g, f.leaf_pos, f.level + 1,
           CASE WHEN f.level + 1 = s.height THEN f.g ELSE f.pos // 2 END,
           sha256(CASE WHEN o.d IS NULL THEN f.d WHEN f.pos % 2 = 0 THEN f.d || o.d ELSE o.d || f.d END),
           f.siblings || coalesce(o.d, '')
    FROM (SELECT f.g, f.leaf_pos, f.level, f.d, f.siblings,
                 CASE WHEN s.height = 0 AND f.level = 0 THEN f.g ELSE f.pos END AS pos
          FROM folds f JOIN subroots s ON s.g = f.g) f
    JOIN subroots s ON s.g = f.g
    JOIN nodes own ON own.g = f.g AND own.level = f.level AND own.pos = f.pos
    LEFT JOIN nodes o ON o.g = f.g AND o.level = f.level AND o.pos = xor(f.pos, 1)
), ends AS (
    SELECT g, leaf_pos, arg_max(d, level) AS folded, arg_max(siblings, level) AS siblings FROM folds GROUP BY 1, 2
), top AS (
    SELECT d AS root FROM upper_tree WHERE n = 1
)
SELECT doc_id, leaf, s.d AS subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves l JOIN ends e ON e.g = l.g AND e.leaf_pos = l.pos JOIN subroots s ON s.g = l.g, top
"""
