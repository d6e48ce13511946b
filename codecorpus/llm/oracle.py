"""DuckDB SQL of the queries of this subpackage that SQL can express."""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS bigint) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS integer) AS rank, vec_id, score FROM r WHERE k <= 5
"""

MIXING = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
p AS (SELECT greatest(1000, 2 * count(*)) AS period, count(*) AS sources, sum(sqrt(n)) AS total FROM n),
share AS (SELECT source, period, sources, round(sqrt(n) / total, 12) * CAST(period - sources AS double) AS share FROM n, p),
w0 AS (SELECT source, period, floor(share) AS whole,
              row_number() OVER (ORDER BY round(share - floor(share), 6) DESC, source NULLS LAST) AS rank,
              period - sources - sum(floor(share)) OVER () AS spare FROM share),
w AS (SELECT source, CAST(period AS bigint) AS period,
             CAST(1 + whole + CASE WHEN rank <= spare THEN 1 ELSE 0 END AS bigint) AS weight FROM w0),
a AS (SELECT list(source ORDER BY source NULLS LAST) AS s, list(weight ORDER BY source NULLS LAST) AS a, max(period) AS period FROM w),
sim AS (
  SELECT CAST(-1 AS bigint) AS t, list_transform(a, lambda x: CAST(0 AS bigint)) AS done, CAST(0 AS bigint) AS pick, a, period FROM a
  UNION ALL
  SELECT t, list_transform(done, lambda k, i: k + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, a, period
  FROM (SELECT t + 1 AS t, done, a, period,
               list_min(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN done[i] * period // a[i] <= t + 1
                        THEN (((done[i] + 1) * period + a[i] - 1) // a[i]) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS pick
        FROM sim WHERE t + 1 < period)),
pattern AS (SELECT a.s[sim.pick] AS source, t AS slot, row_number() OVER (PARTITION BY sim.pick ORDER BY t) - 1 AS turn
            FROM sim, a WHERE t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST) - 1 AS i FROM documents),
b AS (SELECT doc_id, d.source, i // 64 AS block, i % 64 AS rank, weight, period FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, b.source AS source, CAST(block AS bigint) AS block, CAST(block * period // weight AS bigint) AS release,
       CAST(((block + 1) * period + weight - 1) // weight AS bigint) AS deadline,
       CAST(period * (block // weight) + slot AS bigint) AS slot, CAST(rank AS bigint) AS rank
FROM b JOIN pattern ON b.source IS NOT DISTINCT FROM pattern.source AND block % weight = turn
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

RANKED = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS bigint) AS l FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(n AS double) + 2) / (2 * CAST(df AS double) + 1))) AS bigint) AS w FROM f, s),
m AS (SELECT doc_id, 100 - 25 + (25 * len(t) * n) // l AS m FROM d, s),
c AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS bigint) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS integer) AS rank, doc_id, score FROM r WHERE rank <= 20
"""

TRIE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS varchar), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
      FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(steps, lambda x: CAST(x AS bigint))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h
  FROM k),
r AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i <= h
      UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h),
l AS (SELECT conv_id, list([role, text] ORDER BY part, i) AS turns FROM r GROUP BY conv_id),
v AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN l ON l.conv_id = c.conv_id),
e AS (SELECT conv_id, len(turns) AS n_turns, turns, unnest(range(0, len(turns) + 1)) AS depth FROM v),
n AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (depth = n_turns), '')) AS ends_sha256
  FROM e GROUP BY ALL),
p AS (SELECT n.*, u.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.path[n.depth][2]) END AS saved
      FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]),
b AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
o AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN b ON b.parent_conv_id = p.conv_id AND b.depth = p.depth),
up AS (SELECT path, depth, saved, n_children, unnest(range(0, depth + 1)) AS above FROM o),
s AS (SELECT path[1:above] AS path, above AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
      FROM up GROUP BY ALL)
SELECT o.conv_id, CAST(o.depth AS bigint) AS depth, o.parent_conv_id, o.n_convs, CAST(o.n_children AS bigint) AS n_children,
       CAST(s.n_leaves AS bigint) AS n_leaves, CAST(s.saved_tokens AS bigint) AS saved_tokens, o.ends_sha256
FROM o JOIN s ON s.depth = o.depth AND s.path = o.path
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS span FROM (SELECT item_id, {_TERMS} AS w FROM benchmark) WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, array_to_string(w[a:a + span - 1], ' ') AS win, span
      FROM (SELECT *, unnest(generate_series(1, len(w) - span + 1)) AS a FROM b)),
p AS (SELECT doc_id, a, span, array_to_string(w[a:a + span - 1], ' ') AS win
      FROM (SELECT doc_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS a FROM d, (SELECT DISTINCT span FROM x))),
h AS (SELECT * FROM p WHERE win IN (SELECT win FROM x)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(a, a + span - 1)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM h JOIN x ON x.win = h.win WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""

ORACLE = {"op5_topk": TOPK, "op10_mixing": MIXING, "op11_ranked_search": RANKED, "op12_prefix_trie": TRIE, "op13_decontamination": DECONTAMINATION}
