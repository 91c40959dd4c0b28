"""SQL of the queries that SQL can express, for the same parquet tables."""

# Fixed values of the contracts, as SQL.
_KEY = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINES = f"""
    lines AS (
        SELECT doc_id, pos, line, {_KEY} AS k
        FROM (
            SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
        )
    ),
    repeated AS (
        SELECT k, min(doc_id) AS holder FROM lines WHERE length(k) >= 10
        GROUP BY k HAVING count(DISTINCT doc_id) > 1
    )"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Spans of the secret kinds: matches stand between two marks; pieces at odd places are matches.
_SECRETS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "owned": "[A-Za-z0-9+/_-]{20,}",
}


def _secret_spans() -> str:
    parts = []
    for k, (name, pattern) in enumerate(_SECRETS.items()):
        value = f"regexp_extract(p, '{pattern}', 1)" if k == 0 else "p"
        least = {0: 6, 1: 20, 2: 24, 3: 20}[k]
        mixed = " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"
        parts.append(f"""
            SELECT doc_id, source, {k} AS k, off AS start, off + length(p) AS stop, v FROM (
                SELECT *, {value} AS v FROM (
                    SELECT doc_id, source, p, i, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
                    FROM (SELECT doc_id, source, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
                        SELECT doc_id, source,
                            string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS ps
                        FROM texts))
                ) WHERE i % 2 = 1
            ) WHERE length(v) >= {least}{mixed if k == 3 else ''}""")
    return " UNION ALL ".join(parts)


ORACLE: dict[str, str] = {
    "op4_suffix_array_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (
          SELECT doc_id, i, md5(array_slice(h, 2 * i + 1, 2 * i + 200)) AS k
          FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS i FROM t)
        ),
        hit AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        numbered AS (
          SELECT doc_id, i, sum(CASE WHEN i - prev <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
          FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM hit)
        ),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, g),
        per AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS xs, list(b ORDER BY a) AS ys FROM runs GROUP BY doc_id),
        whole AS (
          SELECT doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            list_prepend(0, coalesce(ys, [])) AS s, list_append(coalesce(xs, []), len(h) // 2) AS e
          FROM t LEFT JOIN per USING (doc_id)
        )
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, n_removed, n_spans,
          sha256(unhex(array_to_string(list_transform(range(1, len(s) + 1), lambda j: array_slice(h, 2 * s[j] + 1, 2 * e[j])), ''))) AS kept_sha256
        FROM whole
    """,
    "op6_ngram_jaccard_join": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
            FROM words
        ),
        tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
            GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
        ),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id
        FROM sets
    """,
    "op8_secret_scans": f"""
        WITH texts AS (
            SELECT doc_id, source, translate(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents
        ),
        every AS ({_secret_spans()}),
        found AS (
            SELECT * FROM every e WHERE k < 3 OR NOT EXISTS (
                SELECT 1 FROM every b WHERE b.doc_id = e.doc_id AND b.k < 3 AND b.start < e.stop AND e.start < b.stop)
        ),
        counts AS (
            SELECT v, count(DISTINCT coalesce(source, '')) AS owners FROM found GROUP BY v
        ),
        listed AS (
            SELECT doc_id, k, start, ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s
            FROM found JOIN counts USING (v) WHERE k < 3 OR owners <= 1
        ),
        per AS (
            SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
                count(*) FILTER (WHERE k = 2) AS n_hex,
                string_agg(s, ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base,
                string_agg(s, ',' ORDER BY start, k) AS spans
            FROM listed GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN per USING (doc_id)
    """,
    "op9_url_filters": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut
        ),
        rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fit AS (
            SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id
                ORDER BY length(rhost) DESC, length(rpath) DESC) AS place
            FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (page_id)
    """,
    "op10_benchmark_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark
        ),
        sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
        ),
        sizes AS (SELECT DISTINCT k FROM sized),
        places AS (
            SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)
        ),
        hits AS (SELECT doc_id, item_id, k, i FROM places JOIN windows USING (k, s)),
        covered AS (
            SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id
        ),
        named AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM named GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
    "op11_spelling_variants": rf"""
        WITH RECURSIVE tab AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8),
                lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
        ),
        runs AS (
            SELECT doc_id, w, count(*) AS m FROM (
                SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
            GROUP BY ALL
        ),
        bytes AS (
            SELECT w, m, hex(encode(CAST(doc_id AS VARCHAR) || ':' || w)) AS x FROM runs
        ),
        hashed AS (
            SELECT w, m, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2),
                    lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1),
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h
            FROM bytes, tab
        ),
        cut AS (
            SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, m FROM hashed
        ),
        vocabulary AS (
            SELECT word, CAST(sum(m) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5
        ),
        shorter AS (
            SELECT word, i, word[:i] || word[i + 2:] AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM vocabulary)
        ),
        pairs AS (
            SELECT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word FROM shorter a JOIN vocabulary b ON a.d = b.word
            UNION SELECT b.word, a.word FROM shorter a JOIN vocabulary b ON a.d = b.word
        ),
        near AS (
            SELECT a AS word, x.n, b, y.n AS bn FROM pairs JOIN vocabulary x ON x.word = a JOIN vocabulary y ON y.word = b
        ),
        best AS (
            SELECT word, CASE WHEN bn >= 5 * n THEN b END AS form, CASE WHEN bn >= 5 * n THEN bn END AS form_n
            FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY bn DESC, encode(b)) = 1
        ),
        steps AS (
            SELECT word, word AS stop, 0 AS k FROM vocabulary
            UNION ALL
            SELECT steps.word, best.form, k + 1 FROM steps JOIN best ON best.word = steps.stop WHERE best.form IS NOT NULL
        ),
        roots AS (SELECT word, arg_max(stop, k) AS root FROM steps GROUP BY word),
        counted AS (SELECT word, count(DISTINCT b) AS n_near FROM near GROUP BY word)
        SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n
        FROM vocabulary LEFT JOIN best USING (word) LEFT JOIN counted USING (word) LEFT JOIN roots USING (word)
    """,
    "op13_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scores AS (
            SELECT a.vec_id AS anchor, a.label AS mine, b.vec_id AS other, b.label AS theirs,
                CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS s
            FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ),
        positives AS (
            SELECT anchor, other, s FROM scores WHERE mine = theirs
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, other) <= 5
        )
        SELECT p.anchor AS anchor_id, p.other AS positive_id,
            row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.s DESC, n.other) AS rank,
            n.other AS negative_id, p.s AS positive_score, n.s AS negative_score
        FROM positives p JOIN scores n ON p.anchor = n.anchor AND n.mine <> n.theirs AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
        QUALIFY rank <= 3
    """,
    "op7_line_dedup": f"""
        WITH {_LINES}
        SELECT doc_id, count(*) AS n_lines,
            count(*) FILTER (WHERE holder IS NOT NULL AND holder <> doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
        FROM lines LEFT JOIN repeated ON repeated.k = lines.k
        GROUP BY doc_id
    """,
}
