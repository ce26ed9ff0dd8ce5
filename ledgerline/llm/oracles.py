"""DuckDB statements of the training-data queries that SQL can express."""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(ws) AS n, array_to_string(ws, ' ') AS win FROM
         (SELECT item, w[i:least(i + 12, len(w))] AS ws FROM
            (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
         (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, win)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

OP2_SQL = r"""
WITH RECURSIVE sized AS (SELECT doc_id, source IS NULL AS src_null, coalesce(source, '') AS src,
                      CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                      CAST('0x' || substr(md5(concat_ws(':', '20240', CAST(doc_id AS VARCHAR))), 1, 12) AS BIGINT) AS h FROM documents),
placed AS (SELECT *, h % (SELECT greatest(1, (count(*) + 2047) // 2048) FROM sized) AS shard FROM sized),
cells AS (SELECT src_null, src, shard, CAST(sum(size) AS BIGINT) AS words FROM placed GROUP BY ALL),
s0 AS (SELECT src_null, src, CAST(sum(words) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src_null, src) AS rnk FROM cells GROUP BY src_null, src),
s1 AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lvl
       FROM s2 WINDOW before AS (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT lvl FROM s3 WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1),
s4 AS (SELECT *, least(CAST(cap AS DOUBLE), weight * (SELECT lvl FROM lv)) AS target FROM s3),
s5 AS (SELECT *, CAST(coalesce(greatest(1, least(256, floor((SELECT min(target) FROM s4 WHERE target > 0) / 200))), 1) AS BIGINT) AS block FROM s4),
s6 AS (SELECT *, CAST(round(sum(target) OVER () / block) AS BIGINT) AS seats, sum(target) OVER () AS v, count(*) OVER () AS parties FROM s5),
q0 AS (SELECT rnk, target AS votes, seats, target / nullif(v, 0) AS share, parties FROM s6),
q1 AS (SELECT rnk, votes, seats, unnest(range(0, CAST(ceil(coalesce(share, 0) * (seats + parties)) + 2 AS BIGINT))) AS k FROM q0),
q2 AS (SELECT rnk, votes, seats, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, rnk, k) AS place FROM q1),
q3 AS (SELECT rnk, count(*) FILTER (WHERE place <= seats AND votes > 0) AS quota FROM q2 GROUP BY rnk),
plan AS (SELECT *, quota // nullif(n, 0) AS passes, quota - n * coalesce(quota // nullif(n, 0), 0) AS rest FROM
           (SELECT s6.*, (source_size + block - 1) // block AS n, least(quota, 3 * ((source_size + block - 1) // block)) AS quota FROM s6 JOIN q3 USING (rnk))),
c1 AS (SELECT cells.*, rnk, source_size, target, block, coalesce(passes, 0) AS passes, rest,
              CAST(coalesce(sum(words) OVER (PARTITION BY rnk ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
       FROM cells JOIN plan USING (src_null, src)),
c2 AS (SELECT *, (off + words + block - 1) // block - (off + block - 1) // block AS n, (off + block - 1) // block * block - off AS head FROM c1),
p1 AS (SELECT rnk, shard, CAST(n AS DOUBLE) AS votes, rest, unnest(range(0, n + 1)) AS k FROM c2),
p2 AS (SELECT *, row_number() OVER (PARTITION BY rnk ORDER BY votes / (2 * k + 1) DESC, shard, k) AS place FROM p1),
p3 AS (SELECT rnk, shard, count(*) FILTER (WHERE place <= rest AND votes > 0) AS quota FROM p2 GROUP BY rnk, shard),
c3 AS (SELECT c2.*, quota, CASE WHEN n > 0 THEN CAST('0x' || substr(md5(concat_ws(':', '20240', src, CAST(shard AS VARCHAR))), 1, 12) AS BIGINT) % n ELSE 0 END AS phase
       FROM c2 JOIN p3 USING (rnk, shard)),
c4 AS (SELECT *, coalesce(last_value(CASE WHEN n > 0 THEN (n * quota + phase) // n - ((n - 1) * quota + phase) // n END IGNORE NULLS)
                 OVER (PARTITION BY rnk ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM c3),
run AS (SELECT *, CAST(sum(size) OVER (PARTITION BY src_null, src, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM placed),
pts AS (SELECT doc_id, size, source_size, target, passes, x, sgn, n, quota, phase, head, carry, block, h, rid FROM
          (SELECT *, row_number() OVER () AS rid FROM run JOIN c4 USING (src_null, src, shard)) t, LATERAL (SELECT unnest([e, e - size]) AS x, unnest([1, -1]) AS sgn)),
g AS (SELECT *, sgn * CASE WHEN n > 0 AND x >= head THEN
          carry * head + block * (((x - head) // block * quota + phase) // n)
          + (x - head) % block * ((((x - head) // block + 1) * quota + phase) // n - ((x - head) // block * quota + phase) // n)
        ELSE carry * least(x, head) END AS part FROM pts)
SELECT doc_id, size, source_size, target, CAST(size * passes + sum(part) AS BIGINT) AS taken
FROM g GROUP BY rid, doc_id, size, source_size, target, passes
"""

OP3_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
nodes AS (SELECT shard, replica, CAST('0x' || substr(md5('node:' || shard || ':' || replica), 1, 4) AS BIGINT) AS hi
                         FROM range(16) a(shard), range(64) b(replica)),
ring AS (SELECT shard, hi, row_number() OVER w AS arc, lag(hi) OVER w AS before FROM nodes WINDOW w AS (ORDER BY hi, shard, replica)),
steps AS (SELECT a.arc, b.shard, min((b.arc - a.arc + 1024) % 1024) AS dist FROM ring a, ring b GROUP BY a.arc, b.shard),
prefs AS (SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY dist) AS choice FROM steps),
keys AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, text,
                CAST('0x' || substr(md5('key:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS BIGINT) AS pos FROM documents),
wrapped AS (SELECT *, CASE WHEN pos > (SELECT max(hi) FROM ring) THEN pos - 65536 ELSE pos END AS place FROM keys),
ranked AS (SELECT *, row_number() OVER (ORDER BY place, doc_id) - 1 AS rnk FROM wrapped),
arced AS (SELECT ranked.*, (SELECT min(arc) FROM ring WHERE hi >= ranked.place) AS arc FROM ranked),
loads AS (SELECT ring.arc, count(arced.arc) AS load FROM ring LEFT JOIN arced ON arced.arc = ring.arc GROUP BY ring.arc),
total AS (SELECT count(*) AS n FROM keys),
walk AS (SELECT 0 AS arc, shard, CAST((SELECT n FROM total) // 16 + CASE WHEN shard < (SELECT n FROM total) % 16 THEN 1 ELSE 0 END AS BIGINT) AS room,
                CAST(0 AS BIGINT) AS take, CAST(0 AS BIGINT) AS ahead FROM range(16) r(shard)
         UNION ALL
         SELECT arc, shard, CAST(room - take AS BIGINT), CAST(take AS BIGINT), CAST(ahead AS BIGINT) FROM
           (SELECT arc, shard, room, least(room, greatest(load - ahead, 0)) AS take, ahead FROM
              (SELECT p.arc, p.shard, w.room, l.load, coalesce(sum(w.room) OVER (ORDER BY p.choice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
               FROM walk w JOIN prefs p ON p.arc = w.arc + 1 AND p.shard = w.shard JOIN loads l ON l.arc = p.arc))),
starts AS (SELECT arc, load, sum(load) OVER (ORDER BY arc) - load AS begins FROM loads),
pieces AS (SELECT w.arc, w.shard, s.begins + w.ahead AS from_rank, s.begins + w.ahead + w.take AS to_rank,
                  sum(w.take) OVER (PARTITION BY w.shard ORDER BY w.arc) - w.take AS slot
           FROM walk w JOIN starts s USING (arc) WHERE w.take > 0)
SELECT a.doc_id, CAST(a.size AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || b AS BIGINT) for b in regexp_extract_all(hex(encode(coalesce(a.text, ''))), '..')]),
                                  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32, 'rows' AS law, CAST(p.shard AS INTEGER) AS shard,
       CAST(p.slot + a.rnk - p.from_rank AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM crc_table, arced a JOIN pieces p ON p.arc = a.arc AND a.rnk >= p.from_rank AND a.rnk < p.to_rank
"""

OP1_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

ORACLE_SQL = {"op1_warc_archive": OP1_SQL, "op2_mix_sources": OP2_SQL, "op3_consistent_hash_shards": OP3_SQL,
              "op4_decontaminate": OP4_SQL}
