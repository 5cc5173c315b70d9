"""DuckDB SQL of the queries that SQL can express."""

MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s:' || source, 'n:') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 1 AS r FROM d
), size AS (
  SELECT greatest(64, CAST(ceil(count(*) / 1048576) AS BIGINT)) AS size FROM d
), w AS (
  SELECT src, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.7) AS w FROM d GROUP BY src
), e AS (
  SELECT src, n, round(w / sum(w) OVER () * 4294967296, 6) AS exact FROM w
), f AS (
  SELECT src, n, CAST(floor(exact) AS BIGINT) AS low, 4294967296 - sum(CAST(floor(exact) AS BIGINT)) OVER () AS room,
         row_number() OVER (ORDER BY exact - floor(exact) DESC, src) AS turn FROM e
), share AS (
  SELECT src, CAST(low + CASE WHEN turn <= room THEN 1 ELSE 0 END AS BIGINT) AS share, CAST((n + size - 1) // size AS BIGINT) AS blocks FROM f, size
), one AS (
  SELECT list(src ORDER BY src) AS srcs, list(share ORDER BY src) AS ps, list(blocks ORDER BY src) AS blocks, CAST(sum(blocks) AS BIGINT) AS length FROM share
), sched AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(ps, lambda x: CAST(0 AS BIGINT)) AS done, list_transform(ps, lambda x: CAST(0 AS BIGINT)) AS base, CAST(0 AS BIGINT) AS start, ps AS ws,
         {'deadline': CAST(0 AS BIGINT), 'k': CAST(0 AS BIGINT), 'release': CAST(0 AS BIGINT)} AS p FROM one
  UNION ALL
  SELECT slot + 1, done, CASE WHEN ended THEN done ELSE base END, CASE WHEN ended THEN slot + 2 ELSE start END,
         CASE WHEN NOT ended THEN ws WHEN list_sum(rest) > 0 THEN rest ELSE list_transform(done, lambda x, i: CAST(CASE WHEN x < blocks[i] THEN 1 ELSE 0 END AS BIGINT)) END, p FROM (
    SELECT *, done[p.k] = blocks[p.k] AS ended, list_transform(done, lambda x, i: CASE WHEN x < blocks[i] THEN ps[i] ELSE 0 END) AS rest FROM (
      SELECT slot, base, start, ws, blocks, ps, p, list_transform(done, lambda x, i: CASE WHEN i = p.k THEN x + 1 ELSE x END) AS done FROM (
        SELECT slot, done, base, start, ws, blocks, ps,
          list_min(list_filter(list_transform(range(1, len(ps) + 1), lambda i:
            CASE WHEN ws[i] > 0 AND ((done[i] - base[i]) * whole) // ws[i] <= slot + 1 - start
                 THEN {'deadline': start + ((done[i] - base[i] + 1) * whole + ws[i] - 1) // ws[i], 'k': i,
                       'release': start + ((done[i] - base[i]) * whole) // ws[i]} END), lambda x: x IS NOT NULL)) AS p
        FROM (SELECT sched.*, one.*, CAST(list_sum(ws) AS BIGINT) AS whole FROM sched, one WHERE slot + 1 < length))))
), turns AS (
  SELECT srcs[p.k] AS src, p.release AS release, p.deadline AS deadline, row_number() OVER (PARTITION BY p.k ORDER BY slot) - 1 AS block, slot
  FROM sched, one WHERE slot >= 0
)
SELECT b.doc_id, b.source, CAST(t.block AS BIGINT) AS mix_block, t.release AS mix_release, t.deadline AS mix_deadline, t.slot AS mix_slot, CAST(t.slot * size + b.r % size AS BIGINT) AS mix_position
FROM ranked b, size JOIN turns t ON t.src = b.src AND t.block = b.r // size
"""

TOP_PRODUCTS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
