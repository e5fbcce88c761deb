"""DuckDB SQL of the queries that SQL can express."""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rhost, rpath, rverdict)),
fits AS (
  SELECT s.page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM split s JOIN rules r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, CASE WHEN s.host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND f.k = 1
"""

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS body,
         count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM words),
first AS (SELECT body, min(doc_id) AS low FROM windows WHERE n = 13 GROUP BY body HAVING min(doc_id) < max(doc_id)),
later AS (SELECT windows.doc_id, windows.pos FROM windows JOIN first ON windows.body = first.body WHERE windows.n = 13 AND windows.doc_id > first.low),
gone AS (SELECT DISTINCT later.doc_id, later.pos + k.k AS pos FROM later CROSS JOIN (SELECT unnest(range(13)) AS k) k),
kept AS (
  SELECT words.doc_id, string_agg(words.word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS body, count(gone.pos) AS n_removed
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT k, item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, least(13, len(ws)) AS size FROM (SELECT row_number() OVER () AS k, * FROM i)),
ir AS (
  SELECT item_id, size, string_agg(word, ' ') OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS body,
         count(*) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM iw),
items AS (SELECT DISTINCT item_id, size, body FROM ir WHERE n = size),
dw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
dr AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS body,
         count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM dw),
found AS (SELECT dr.doc_id, dr.pos, items.item_id, items.size FROM dr JOIN items ON dr.body = items.body WHERE dr.n = items.size {short}),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT found.doc_id, found.pos + k.k AS pos FROM found JOIN (SELECT unnest(range(13)) AS k) k ON k.k < found.size) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN names ON d.doc_id = names.doc_id
""".replace(" {short}", "")

PREFIX_TRIE = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
tab AS (
  SELECT list(v ORDER BY k) AS tab FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda v, s: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM (SELECT unnest(range(256)) AS k))),
ids AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                            lambda crc, b: xor(crc // 256, tab[xor(crc, b) % 256 + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t), tab),
rebuilt AS (
  SELECT ids.c, 0 AS section, t.pos, r, x FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.pos <= ids.h
  UNION ALL
  SELECT ids.c, 1, t.pos, r, x FROM ids JOIN t ON t.c = ids.c AND t.pos > ids.h),
p AS (
  SELECT c, row_number() OVER w AS d, md5(string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER w) AS prefix,
         CAST(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY section, pos)
  UNION ALL
  SELECT c, 0, '', 0 FROM ids),
q AS (SELECT *, lag(prefix) OVER (PARTITION BY c ORDER BY d) AS above, max(d) OVER (PARTITION BY c) AS size FROM p),
nodes AS (
  SELECT d, prefix, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = size), '')) AS ends_sha256
  FROM q GROUP BY d, prefix),
kids AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, above),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.d = kids.d AND nodes.prefix = kids.prefix),
sums AS (
  SELECT a.d, a.prefix, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM full_nodes v JOIN p a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.d, a.prefix)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON n.d = s.d AND n.prefix = s.prefix LEFT JOIN nodes u ON u.d = n.d - 1 AND u.prefix = n.above
"""

RANKED_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
totals AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ws) AS term FROM d) GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
m AS (SELECT k, doc_id, 75 + (25 * len(ws) * n) // l AS m FROM d, totals WHERE len(ws) > 0),
asked AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest(ws) AS term FROM i) GROUP BY q, term),
scores AS (
  SELECT q, k, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (k) GROUP BY q, k, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 20
"""
