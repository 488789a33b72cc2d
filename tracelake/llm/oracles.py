"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tracelake.llm.shared import UPPER

LOWER_TEXT = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op4_nearest": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), d AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM d
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op7_url_filter": r"""
        WITH p AS (
            SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
                   regexp_extract(url, '^[a-z]+://(?:[^/?#:]*\.)?([^/?#:.]+\.[^/?#:.]+)(?:[/?#:]|$)', 1) AS parent,
                   regexp_extract(url, '^[a-z]+://([^/?#:]*/[^/?#]+)', 1) AS path,
                   regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS whole_path,
                   1704067200 + page_id * 7919 % 525600 * 60 AS fetched
            FROM pages
        ), e AS (
            SELECT 'spam' AS list_name, 'domain' AS kind, host AS pattern, min(page_id) AS m, 3 AS every, 31 AS step
            FROM p WHERE host <> '' GROUP BY host
            UNION ALL
            SELECT 'parked', 'domain', parent, min(page_id), 1, 17 FROM p WHERE parent <> '' GROUP BY parent
            UNION ALL
            SELECT 'adult', 'path', path, min(page_id), 5, 53 FROM p WHERE path <> '' GROUP BY path
            UNION ALL
            SELECT 'takedown', 'url', url, min(page_id), 11, 13 FROM p WHERE url <> '' GROUP BY url
        ), c AS (
            SELECT list_name, kind, pattern, true AS listed, m * step % 400000 AS minute FROM e WHERE m % every = 0
            UNION ALL
            SELECT list_name, kind, pattern, false, m * step % 400000 + 86400 FROM e WHERE m % every = 0
            UNION ALL
            SELECT list_name, kind, pattern, m % 2 = 0, m * step % 400000 + 129600 FROM e WHERE m % every = 0
        ), i AS (
            SELECT list_name, kind, pattern, listed, 1704067200 + minute * 60 AS since,
                   lead(1704067200 + minute * 60, 1, 9999999999)
                       OVER (PARTITION BY list_name, kind, pattern ORDER BY minute) AS until
            FROM c
        ), l AS (
            SELECT page_id, url, host, fetched, string_split(host, '.') AS labels,
                   list_filter(string_split(whole_path, '/'), lambda x: x <> '') AS segments
            FROM p
        ), k AS (
            SELECT page_id, fetched, 'domain' AS kind, n AS rank,
                   array_to_string(labels[len(labels) - n + 1 : len(labels)], '.') AS pattern
            FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS n FROM l)
            UNION ALL
            SELECT page_id, fetched, 'path', 1000 + n, host || '/' || array_to_string(segments[1 : n], '/')
            FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS n FROM l)
            UNION ALL
            SELECT page_id, fetched, 'url', 1000000, url FROM l
        ), met AS (
            SELECT page_id, list_name, i.kind, i.pattern, since,
                   count(*) OVER (PARTITION BY page_id) AS n_active,
                   row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, list_name) AS place
            FROM k JOIN i ON k.kind = i.kind AND k.pattern = i.pattern AND since <= fetched AND fetched < until
            WHERE listed
        )
        SELECT p.page_id, coalesce(n_active, 0) AS n_active, n_active IS NOT NULL AS blocked,
               list_name, kind, pattern, since
        FROM p LEFT JOIN met ON met.page_id = p.page_id AND place = 1
    """,
    "op9_line_dedup": f"""
        WITH d AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
                   string_split({LOWER_TEXT.replace("text", "coalesce(text, '')", 1)}, chr(10)) AS lowered
            FROM documents
        ), l AS (
            SELECT doc_id, place, lines[place] AS line, trim(lowered[place], {BLANK_CHARS}) AS key
            FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS place FROM d)
        ), frequent AS (
            SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT doc_id, key FROM l WHERE length(key) >= 40)
            GROUP BY key HAVING count(*) >= 5
        ), marked AS (
            SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM l LEFT JOIN frequent USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_near_duplicates": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({LOWER_TEXT}, '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle
            FROM w WHERE len(words) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * common >= 75 * (x.n + y.n - common)
        ), ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT ways.b, reached.root FROM reached JOIN ways ON reached.doc_id = ways.a
        )
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id,
               r.doc_id = min(root) AS kept
        FROM reached r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op11_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -7, n, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) m(n, role)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(15 + length(regexp_replace(role || text, '([\\<>])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op13_conversation_repair": f"""
        WITH RECURSIVE crc AS (
            SELECT list(v ORDER BY n) AS steps FROM (
                SELECT n, list_reduce(
                    list_prepend(n, list_transform(range(8), lambda x: CAST(x AS BIGINT))),
                    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))
        ), k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(
                       list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                           lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind
            FROM conversations, crc
        ), d AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM k WHERE kind <> 0
        ), n AS (
            SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
            FROM d
        ), f AS (
            SELECT *, left(role, 1) AS i, right(rtrim(text, {BLANK_CHARS}), 1) AS bare,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
            FROM n
        ), r AS (
            SELECT *, bare = '' OR seen AS gone, CASE WHEN bare <> '' AND NOT seen AND bare NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut
            FROM f
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (bare = '') AS blank, count(*) FILTER (bare <> '' AND seen) AS duplicate,
                   count(*) FILTER (cut > 0) AS truncated,
                   count(*) FILTER (pos > 1 AND (before || '|' || i) NOT IN ('s|u', 'u|a', 'a|u')) AS illegal, count(*) AS size
            FROM r GROUP BY conv_id
        ), dp(conv_id, pos, p0, p1, p2, p3) AS (
            SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}},
                   {{'c': CAST(3 AS BIGINT), 'a': 'I'}}, {{'c': CAST(6 AS BIGINT), 'a': 'II'}}
            FROM counts
            UNION ALL
            SELECT conv_id, pos, n0, n1,
                   list_min([n2, {{'c': n0.c + 3, 'a': n0.a || 'I'}}, {{'c': n1.c + 3, 'a': n1.a || 'I'}},
                             {{'c': n3.c + 3, 'a': n3.a || 'I'}}]),
                   list_min([n3, {{'c': n2.c + 3, 'a': n2.a || 'I'}}, {{'c': n0.c + 6, 'a': n0.a || 'II'}},
                             {{'c': n1.c + 6, 'a': n1.a || 'II'}}])
            FROM (
                SELECT dp.conv_id, r.pos, {{'c': p0.c + 4, 'a': p0.a || 'D'}} AS n0,
                       list_min([{{'c': p1.c + 4, 'a': p1.a || 'D'}},
                                 {{'c': p0.c + CASE WHEN i = 's' AND NOT gone THEN cut ELSE 1000000000 END, 'a': p0.a || 'K'}}]) AS n1,
                       list_min([{{'c': p2.c + 4, 'a': p2.a || 'D'}},
                                 {{'c': u.c + CASE WHEN i = 'u' AND NOT gone THEN cut ELSE 1000000000 END, 'a': u.a || 'K'}},
                                 {{'c': u.c + CASE WHEN gone THEN 1000000000 ELSE 3 + cut END, 'a': u.a || 'R'}}]) AS n2,
                       list_min([{{'c': p3.c + 4, 'a': p3.a || 'D'}},
                                 {{'c': p2.c + CASE WHEN i = 'a' AND NOT gone THEN cut ELSE 1000000000 END, 'a': p2.a || 'K'}},
                                 {{'c': p2.c + CASE WHEN gone THEN 1000000000 ELSE 3 + cut END, 'a': p2.a || 'R'}}]) AS n3
                FROM (SELECT *, list_min([p0, p1, p3]) AS u FROM dp) dp
                JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1
            )
        ), best AS (
            SELECT counts.*, list_min([p0, p3]).c AS cost, list_min([p0, p3]).a AS audit
            FROM counts JOIN dp ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.pos = size
        ), pieces AS (
            SELECT conv_id, size, regexp_extract_all(audit, 'I*[KRD]') AS piece, length(audit) - length(rtrim(audit, 'I')) AS tail,
                   length(replace(audit, 'D', '')) AS made
            FROM best
        ), lines AS (
            SELECT r.conv_id, r.pos, list_concat(list_concat(
                       list_transform(range(length(own) - 1), lambda m: CASE (number + m) % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END),
                       CASE right(own, 1) WHEN 'K' THEN [role || ':' || text] WHEN 'D' THEN CAST([] AS VARCHAR[])
                       ELSE [CASE (number + length(own) - 1) % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END || text] END),
                       list_transform(range(CASE WHEN r.pos = size THEN tail ELSE 0 END),
                                      lambda m: CASE (made + made % 2 - tail + m) % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END)) AS line
            FROM r JOIN (
                SELECT *, unnest(range(1, size + 1)) AS place, piece[place] AS own,
                       length(replace(array_to_string(piece[1 : place - 1], ''), 'D', '')) + made % 2 AS number
                FROM pieces
            ) p ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.place
        ), texts AS (
            SELECT conv_id, string_agg(array_to_string(line, chr(10)), chr(10) ORDER BY pos) FILTER (len(line) > 0) AS repaired
            FROM lines GROUP BY conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
