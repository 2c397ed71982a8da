"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


def _level(parent: list[str], keys: list[str], weights: str, above: str, source: str) -> str:
    """One step of the water filling, done by trying every number of full children instead of one pass in order."""
    names, up = ", ".join(keys), " AND ".join([f"n.{k} = a.{k}" for k in parent] or ["true"])
    by = ", ".join(f"n.{k}" for k in parent)
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    return f"""
        SELECT {names}, CASE WHEN place <= n_full THEN cap
               ELSE (rest * (upto - heavy_full)) // (heavy - heavy_full) - (rest * (upto - weight - heavy_full)) // (heavy - heavy_full) END AS given
        FROM (SELECT *, coalesce(max(CASE WHEN cap * (heavy - upto + weight) <= (given - below) * weight THEN place END) OVER ({part}), 0) AS n_full,
                     given - coalesce(max(CASE WHEN cap * (heavy - upto + weight) <= (given - below) * weight THEN below + cap END) OVER ({part}), 0) AS rest,
                     coalesce(max(CASE WHEN cap * (heavy - upto + weight) <= (given - below) * weight THEN upto END) OVER ({part}), 0) AS heavy_full
              FROM (SELECT n.*, a.given, {weights} AS weight, sum({weights}) OVER (PARTITION BY {by or '1'})::BIGINT AS heavy,
                           row_number() OVER w AS place, sum({weights}) OVER w AS upto, sum(cap) OVER w - cap AS below
                    FROM (SELECT {names}, sum(tokens * 3)::BIGINT AS cap FROM {source} GROUP BY {names}) n JOIN {above} a ON {up}
                    WINDOW w AS (PARTITION BY {by or '1'} ORDER BY cap / {weights}, {', '.join(f'n.{k}' for k in keys)})))"""


_MIXING = rf"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, len({_WORDS})::BIGINT AS n_tokens,
         coalesce('domain' || (nullif(regexp_extract(source, '([0-9]+)$', 1), '')::INT % 4), '') AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
docs AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
top AS (SELECT (sum(tokens) * 60 // 100)::BIGINT AS given FROM leaves),
l1 AS ({_level([], ["domain"], "CASE n.domain WHEN 'domain0' THEN 10 WHEN 'domain1' THEN 10 WHEN 'domain2' THEN 5 WHEN 'domain3' THEN 90 ELSE 10 END", "top", "leaves")}),
l2 AS ({_level(["domain"], ["domain", "lang"], "CASE n.domain || '/' || n.lang WHEN 'domain0/en' THEN 20 WHEN 'domain0/de' THEN 40 WHEN 'domain3/fr' THEN 60 ELSE 10 END", "l1", "leaves")}),
l3 AS ({_level(["domain", "lang"], ["domain", "lang", "source"], "CASE n.domain || '/' || n.lang || '/' || n.source WHEN 'domain1/en/src1' THEN 80 ELSE 10 END", "l2", "leaves")}),
plan AS (SELECT l.*, given::BIGINT // tokens AS whole, given::BIGINT % tokens AS rest FROM leaves l JOIN l3 USING (domain, lang, source)),
placed AS (SELECT docs.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY
             ('0x' || substr(md5('1:' || whole || ':' || id), 1, 13))::BIGINT, id) - n_tokens AS start
           FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, epoch::BIGINT AS epoch,
       (CASE WHEN epoch < whole THEN n_tokens ELSE least(n_tokens, rest - start) END)::BIGINT AS taken
FROM placed, range(whole + 1) e(epoch) WHERE epoch < whole OR start < rest
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, octet_length(encode(body)) AS size, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, size::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM s
"""

_URLS = r"""
WITH events(entry, action, since, category) AS (VALUES
  ('spam-farm.example.org', 'add', DATE '2024-01-10', 'spam'), ('spam-farm.example.org', 'remove', DATE '2024-06-01', 'spam'),
  ('spam-farm.example.org', 'add', DATE '2024-09-01', 'malware'), ('cheap-pills.example.com', 'add', DATE '2024-03-01', 'pharmacy'),
  ('adult-x.example.net', 'add', DATE '2023-11-05', 'adult'), ('m.adult-x.example.net', 'remove', DATE '2024-02-01', 'adult'),
  ('example.org/en', 'add', DATE '2024-05-01', 'never'), ('blog.ththan.example.net/en', 'add', DATE '2024-04-01', 'blog'),
  ('blog.ththan.example.net/en', 'remove', DATE '2024-11-01', 'blog'), ('ththan.example.net', 'add', DATE '2024-07-01', 'site')),
captures AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched,
  regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
-- the last event of an entry up to the fetch time says whether it is listed
dated AS (SELECT c.page_id, e.*, row_number() OVER (PARTITION BY c.page_id, e.entry ORDER BY e.since DESC, e.action DESC) AS back
  FROM captures c JOIN events e ON e.since <= c.fetched AND (c.host = e.entry OR ends_with(c.host, '.' || e.entry)
    OR starts_with(c.host || c.path || '/', e.entry || '/'))),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry DESC) AS place
  FROM dated WHERE back = 1 AND action = 'add')
SELECT c.page_id, c.url, c.fetched, b.entry IS NOT NULL AS listed, b.entry, b.category, b.since
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.place = 1
"""

_NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles FROM w),
sizes AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
each AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
reach(node, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other),
parts AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN parts ON node = doc_id
"""

_TAILS = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\])"
_CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[]){_TAILS}', '\1\\\2', 'g'))
        + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other),
parts AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN parts ON node = v.vec_id
"""

_TRIE = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS head, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v % 2)))), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (SELECT h.c, 0 AS own, p, r, x FROM h JOIN t ON t.c = head AND p <= h UNION ALL SELECT h.c, 1, p, r, x FROM h JOIN t ON t.c = h.c AND p > h),
place AS (SELECT c, row_number() OVER w AS d, length(x) AS size,
                 string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, p)),
long AS (SELECT c, max(d) AS d FROM place GROUP BY c),
member AS (SELECT c, d, size, k FROM place UNION ALL SELECT c, 0, 0, '' FROM h),
node AS (SELECT k, m.d, min(m.c) AS conv_id, count(*) AS n, any_value(size) AS size,
                sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (m.d = coalesce(long.d, 0)), '')) AS ends_sha256
         FROM member m LEFT JOIN long USING (c) GROUP BY k, m.d),
link AS (SELECT DISTINCT a.k, b.k AS parent FROM member a JOIN member b ON a.c = b.c AND b.d = a.d - 1),
kids AS (SELECT parent AS k, count(*) AS n_children FROM link GROUP BY parent),
below AS (SELECT a.k, sum((b.n - 1) * b.size)::BIGINT AS saved_tokens, count(*) FILTER (b.k NOT IN (SELECT k FROM kids)) AS n_leaves
          FROM node a JOIN node b ON starts_with(b.k, a.k) AND b.d >= a.d GROUP BY a.k)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node LEFT JOIN link USING (k) LEFT JOIN node up ON up.k = parent LEFT JOIN kids ON kids.k = node.k JOIN below ON below.k = node.k
"""

ORACLE = {"op1_mixing": _MIXING, "op4_warc_index": _WARC, "op5_url_lists": _URLS, "op6_hyperminhash": _NEAR,
          "op9_reply_trees": _CHAT, "op10_embedding_tiles": _VECTORS, "op11_prefix_trie": _TRIE}
