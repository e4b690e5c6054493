"""SQL for the queries that SQL can express, on the same tables."""

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM sources),
levels AS (
  SELECT *, most / weight AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS asked,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, source_no LIMIT 1),
targets AS (
  SELECT source, source_no, source_size, coalesce(least(most::DOUBLE, weight * (SELECT level FROM found)), most::DOUBLE) AS target,
         floor(asked / 16 + 0.5)::BIGINT AS house, greatest(1, ceil(source_size / 1048576.0))::BIGINT AS n_shards
  FROM levels),
quotients AS (
  SELECT source_no, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source_no, k) <= house AS won
  FROM (SELECT *, unnest(range(0, (target / 16)::BIGINT + (SELECT count(*) FROM targets) + 3)) AS k FROM targets WHERE target > 0)),
seats AS (
  SELECT t.*, coalesce(w.blocks, 0) AS blocks
  FROM targets t LEFT JOIN (SELECT source_no, count(*) AS blocks FROM quotients WHERE won GROUP BY 1) w USING (source_no)),
dealt AS (
  SELECT s.doc_id, s.size, s.digest, t.source_no, t.source_size, t.target, t.blocks,
         ('0x' || substr(s.digest, 1, 12))::BIGINT % t.n_shards AS shard
  FROM sizes s JOIN seats t ON s.source IS NOT DISTINCT FROM t.source),
shards AS (SELECT source_no, shard, blocks, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL),
shard_quotients AS (
  SELECT source_no, shard, row_number() OVER (PARTITION BY source_no ORDER BY words / (2 * k + 1) DESC, shard, k) <= blocks AS won
  FROM (SELECT *, unnest(range(0, words * 2 // 16 + 8)) AS k FROM shards WHERE words > 0)),
quotas AS (
  SELECT s.source_no, s.shard, s.words, least(coalesce(q.quota, 0) * 16, 2 * s.words) AS wanted
  FROM shards s LEFT JOIN (SELECT source_no, shard, count(*) AS quota FROM shard_quotients WHERE won GROUP BY 1, 2) q USING (source_no, shard)),
streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source_no, shard ORDER BY digest, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dealt)
SELECT doc_id, size, source_size, target,
       CASE WHEN words = 0 THEN 0
            ELSE wanted // words * size + greatest(0, least(size, wanted - wanted // words * words - before)) END::BIGINT AS taken
FROM streams JOIN quotas USING (source_no, shard)
"""

CHATS = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
said AS (
  SELECT conv_id, turn, role, text, coalesce('r' || md5(role), '-') || coalesce('t' || md5(text), '-') AS part,
         '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS line
  FROM turns),
prefixes AS (
  SELECT conv_id, row_number() OVER w AS n, string_agg(part, ';') OVER w AS prefix, string_agg(line, '') OVER w AS rendered
  FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lasts AS (SELECT *, n = max(n) OVER (PARTITION BY conv_id) AS is_last FROM prefixes),
whole AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies, min(n) AS n_turns, min(rendered) AS rendered
  FROM lasts WHERE is_last GROUP BY prefix)
SELECT conv_id, n_turns::BIGINT AS n_turns, n_copies, rendered FROM whole
WHERE prefix NOT IN (SELECT prefix FROM lasts WHERE NOT is_last)
"""

TOP_K = r"""
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: The remainders h are crc32 by its bits: the table has no such function in SQL.
TRIE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda x, c: list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.role, t.text, t.pos, 0 AS part FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.role, t.text, t.pos, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT conv_id, length(text) AS chars, row_number() OVER w AS depth, string_agg(md5(role) || md5(text), '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
members AS (
  SELECT conv_id, depth, path, chars FROM paths UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS len FROM members GROUP BY 1),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends_sha256
  FROM members JOIN lengths USING (conv_id) GROUP BY 1, 2),
children AS (
  SELECT depth - 1 AS depth, left(path, -64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, path)),
below AS (
  SELECT m.depth, m.path, sum((y.n_children = 0)::BIGINT) AS n_leaves, sum((y.n_convs - 1) * y.chars) AS saved_tokens
  FROM counted y JOIN members m ON m.conv_id = y.conv_id AND m.depth <= y.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b USING (depth, path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND n.depth > 0 AND p.path = left(n.path, -64)
"""

HARD_NEGATIVES = r"""
WITH vectors AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.v AS anchor, a.label AS anchor_label, c.vec_id, c.label,
         CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, c.v) END::BIGINT AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, anchor, anchor_label, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor, anchor_label ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.anchor, p.anchor_label, p.positive_id, p.positive_score
                            ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND p.anchor = s.anchor AND p.anchor_label = s.anchor_label
    AND s.label <> p.anchor_label AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

ORACLES = {
    "op2_top_k_search": TOP_K,
    "op8_mixing": MIXING,
    "op10_chat_formatting": CHATS,
    "op12_hard_negative_mining": HARD_NEGATIVES,
    "op13_conversation_prefix_trie": TRIE,
}
