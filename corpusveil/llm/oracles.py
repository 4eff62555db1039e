"""The same results as SQL, where SQL can express them."""

from __future__ import annotations

from corpusveil.llm.lines import NEAR_CHARS
from corpusveil.llm.queries import INJECTION

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), sizes AS (SELECT doc_id, len(sh) AS n FROM s),
one AS (SELECT doc_id, unnest(sh) AS t FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM one a JOIN one b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, n AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = doc_id) AS component_id FROM sizes
"""

# the escaped length of a text: two characters for each control string, and for the escape sign
_CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_escaped = "replace({0}, '~', '~0')"
for _n, _c in enumerate(_CONTROLS, 1):
    _escaped = f"replace({_escaped}, '{_c}', '~{_n}')"

OP3 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{INJECTION}' UNION ALL SELECT -7, 1, 'assistant', '{INJECTION}'
), sized AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(7 + length({_escaped.format("role")}) + 3 + length({_escaped.format("text")}) + 8) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(stop) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_reduce(list_transform(range(5), lambda k: ((position(substr(hex, CAST((5 * i + k) // 4 + 1 AS INT), 1) IN '0123456789abcdef') - 1) >> (3 - (5 * i + k) % 4)) & 1), lambda x, y: 2 * x + y) + 1, 1)), '') AS d
  FROM p
), t AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM b)
SELECT page_id, strlen(html) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""

OP6 = f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM parts),
lines AS (SELECT *, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '')) = '' AS blank FROM every),
uniq AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS place FROM lines WHERE NOT blank GROUP BY line),
halves AS (
  SELECT line, n, place, unnest([left(line, m1) || chr(1) || m1, right(line, m1) || chr(2) || m1, left(line, m2) || chr(1) || m2, right(line, m2) || chr(2) || m2]) AS h
  FROM (SELECT *, n // 2 AS m1, (n - 1) // 2 AS m2 FROM uniq WHERE n >= {NEAR_CHARS})
),
near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b ON a.h = b.h AND b.place < a.place AND abs(a.n - b.n) <= 1
  WHERE levenshtein(a.line, b.line) <= 1
),
stay AS (
  SELECT l.doc_id, l.pos, l.line, l.blank FROM lines l LEFT JOIN uniq u ON u.line = l.line
  WHERE l.blank OR ((l.doc_id, l.pos) = u.place AND NOT EXISTS (SELECT 1 FROM near WHERE near.line = l.line))
),
made AS (
  SELECT doc_id, count(*) FILTER (NOT blank) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS text FROM stay GROUP BY doc_id
),
total AS (SELECT doc_id, count(*) FILTER (NOT blank) AS n_lines FROM lines GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN coalesce(n_kept, 0) = 0 THEN '' ELSE made.text END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept
FROM documents d LEFT JOIN made USING (doc_id) LEFT JOIN total USING (doc_id)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12 = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), plain AS (
  SELECT conv_id, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM turns GROUP BY conv_id
), plan AS (SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS source, h, least(h, coalesce((SELECT n FROM plain s WHERE s.conv_id = c.conv_id - c.conv_id % 5), 0)) AS k FROM plain c),
rebuilt AS (
  SELECT p.conv_id, t.idx AS place, role, text FROM plan p JOIN turns t ON t.conv_id = p.source AND t.idx < p.k
  UNION ALL SELECT p.conv_id, p.k + t.idx - p.h, role, text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.idx >= p.h
), paths AS (
  SELECT conv_id, place + 1 AS depth, strlen(text) AS bytes,
    list(sha256(strlen(role) || ':' || role || strlen(text) || ':' || text)) OVER (PARTITION BY conv_id ORDER BY place) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM plan
), nodes AS (SELECT path, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY path),
last AS (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM last GROUP BY path),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
above AS (SELECT unnest(list_transform(range(CAST(depth + 1 AS BIGINT)), lambda i: path[:i])) AS path, n_children, (n_convs - 1) * bytes AS saved FROM own),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(digest, sha256('')) AS ends_sha256
FROM own o JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[:o.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": OP1, "op3_chat_formatting": OP3, "op5_arc_to_warc": OP5, "op6_line_dedup": OP6, "op7_top_k": OP7,
        "op12_prefix_trie": OP12,
    }
