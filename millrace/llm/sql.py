"""DuckDB SQL with the rows of those queries that SQL can express."""

SPACE_WORD, ALNUM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

MIXING = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}')) AS size, md5('42:' || doc_id) AS ord,
    ('0x' || substr(md5('42s:' || doc_id), 1, 8))::BIGINT AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM docs GROUP BY source
), w AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), goals AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target,
    ceil(docs / 4096.0)::BIGINT AS shards FROM l
), k1 AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS place
  FROM goals, unnest(range(1, ceil(target / 32)::BIGINT + 64)) AS t(k) WHERE target > 0
), q1 AS (SELECT source, count(*) AS seats FROM k1 WHERE place <= (SELECT round(sum(target) / 32) FROM goals) GROUP BY source
), dealt AS (SELECT d.*, g.source_size, g.target, coalesce(q1.seats, 0) AS seats, d.h % g.shards AS shard
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN q1 ON d.source IS NOT DISTINCT FROM q1.source
), sh AS (SELECT source, shard, any_value(seats) AS seats, sum(size) AS words, ceil(sum(size) / 32)::BIGINT AS n FROM dealt GROUP BY source, shard
), k2 AS (
  SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard, k) AS place
  FROM sh, unnest(range(1, least(seats, 3 * n + 64) + 1)) AS t(k) WHERE words > 0
), q2 AS (SELECT source, shard, count(*) AS quota FROM k2 WHERE place <= seats GROUP BY source, shard
), full_ AS (
  SELECT d.*, sh.n, least(coalesce(q2.quota, 0), 2 * sh.n) AS quota,
    (sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS e,
    ('0x' || substr(md5('42b:' || coalesce(d.source, '') || ':' || d.shard), 1, 8))::BIGINT AS o
  FROM dealt d JOIN sh ON d.source IS NOT DISTINCT FROM sh.source AND d.shard = sh.shard
  LEFT JOIN q2 ON d.source IS NOT DISTINCT FROM q2.source AND d.shard = q2.shard
)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range((e - size) // 32, (e - 1) // 32 + 1),
  lambda j: (quota // n + CASE WHEN (j * 2147483647 + o) % n < quota % n THEN 1 ELSE 0 END) * (least(e, (j + 1) * 32) - greatest(e - size, j * 32)))) END::BIGINT AS taken
FROM full_
"""

CONTAMINATION = f"""
WITH iw AS (SELECT item_id, regexp_extract_all({LOWER.format("text")}, '{ALNUM_WORD}') AS w FROM benchmark WHERE text IS NOT NULL
), wins AS (
  SELECT item_id, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS n
  FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0
), dw AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM_WORD}') AS w FROM documents
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dw, (SELECT DISTINCT n FROM wins), unnest(range(1, len(w) - n + 2)) AS t(p)
), occ AS (SELECT doc_id, p, n, item_id FROM places JOIN wins USING (win, n)
), hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM occ), unnest(range(p, p + n)) AS u(pos) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) + 14 AS n FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SUBSTRINGS = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w FROM documents
), win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM dw, unnest(range(1, len(w) - 33)) AS t(p)
), again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (SELECT DISTINCT doc_id, pos FROM win JOIN again USING (h), unnest(range(p, p + 35)) AS u(pos)
), places AS (SELECT doc_id, pos, w[pos] AS word FROM dw, unnest(range(1, len(w) + 1)) AS t(pos)
), kept AS (SELECT doc_id, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY pos)) AS sha FROM places ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, coalesce(sha, sha256('')) AS kept_sha256 FROM dw LEFT JOIN kept USING (doc_id)
"""

#: These tables' pages have their main text in an article element, and few kinds of character references.
HTML = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages
), b AS (SELECT page_id, url, regexp_replace(replace(x, '<b>', ''), '<[^>]*>', ' ', 'g') AS x FROM a
), c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS x FROM b
), d AS (SELECT page_id, url, trim(regexp_replace(x, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

SPELLING = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS tab
), said AS (
  SELECT doc_id, {LOWER.format("w")} AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL
), coded AS (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM said
), hashed AS (
  SELECT w, c, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) AS h FROM coded, crc
), made AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM hashed
), words AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), cut AS (SELECT word, n, length(word) AS l, k, word[:k - 1] || word[k + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(k)
), near AS (
  SELECT DISTINCT a.word, b.word AS other FROM cut a JOIN cut b ON a.l = b.l AND a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT cut.word, w.word FROM cut JOIN words w ON w.word = cut.rest
  UNION SELECT DISTINCT w.word, cut.word FROM cut JOIN words w ON w.word = cut.rest
), best AS (
  SELECT near.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(o.word, (-o.n, o.word)) AS form FROM near JOIN words o ON o.word = near.other GROUP BY near.word
), known AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n, CASE WHEN form_n >= 10 * n THEN form END AS form FROM words LEFT JOIN best USING (word)
), path AS (
  WITH RECURSIVE r AS (SELECT word, word AS root FROM known UNION ALL SELECT r.word, known.form FROM r JOIN known ON known.word = r.root WHERE known.form IS NOT NULL)
  SELECT r.word, r.root FROM r JOIN known ON known.word = r.root WHERE known.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM known JOIN path USING (word)
"""

SQL = {"op3_topk": TOPK, "op4_mixing": MIXING, "op6_decontamination": CONTAMINATION, "op7_chat": CHAT, "op10_substrings": SUBSTRINGS, "op12_html": HTML, "op13_spelling": SPELLING}
