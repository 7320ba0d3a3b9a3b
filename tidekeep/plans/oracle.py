"""The same queries as SQL for DuckDB."""

from __future__ import annotations

_OLOG = "olog AS (SELECT o_orderkey AS seq, CAST(o_custkey AS INTEGER) AS key, CAST(floor(o_totalprice) AS INTEGER) AS value FROM orders)"
_ELOG = "elog AS (SELECT event_id AS seq, CAST(user_id AS INTEGER) AS key, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(round(value * 100) AS INTEGER) END AS value FROM events)"
_ST = f"{_OLOG}, st AS (SELECT key, max_by(value, seq) AS value FROM olog GROUP BY key)"
_ES = f"{_ELOG}, es AS (SELECT key, max_by(value, seq) AS value FROM elog GROUP BY key)"
_RUNS = "r AS (SELECT CAST(floor(o_orderkey / 1000.0) AS INTEGER) AS run, CAST(o_orderkey AS INTEGER) AS key FROM orders), m AS (SELECT run, min(key) AS min_key, max(key) AS max_key, count(*) AS num_pairs FROM r GROUP BY run)"
_WIDE = f"{_OLOG}, r AS (SELECT DISTINCT CAST(floor(seq * 8 / ((SELECT max(seq) FROM olog) + 1)) AS INTEGER) AS run, key FROM olog), m AS (SELECT run, min(key) AS min_key, max(key) AS max_key, count(*) AS num_pairs FROM r GROUP BY run)"
_H = "h AS (SELECT * FROM (VALUES (0), (1), (2)) v(i))"
_LAST = "(SELECT max(seq) + 1 FROM {0})"


def _pos(key: str, bits: str) -> str:
    return f"((CAST({key} AS BIGINT) & 4294967295) + i * (xor(CAST({key} AS BIGINT), 2654435769) & 4294967295)) % ({bits} * 10)"


def _part(name: str, log: str, low: float, high: float) -> str:
    last = _LAST.format(log)
    return f"{name} AS (SELECT key, max_by(value, seq) AS value FROM {log} WHERE CAST(seq AS DOUBLE) / {last} >= {low} AND CAST(seq AS DOUBLE) / {last} < {high} GROUP BY key)"


_BITS = f"bits AS (SELECT DISTINCT r.run, {_pos('r.key', 'm.num_pairs')} AS pos FROM r JOIN m ON r.run = m.run CROSS JOIN h)"
_MAYBE = f"""p AS (SELECT DISTINCT key + 1 AS key FROM olog), z AS (SELECT p.key, m.run, m.num_pairs FROM p JOIN m ON p.key BETWEEN m.min_key AND m.max_key),
pp AS (SELECT DISTINCT z.key, z.run, {_pos('z.key', 'z.num_pairs')} AS pos FROM z CROSS JOIN h),
maybe AS (SELECT pp.key, pp.run FROM pp LEFT JOIN bits ON pp.run = bits.run AND pp.pos = bits.pos GROUP BY pp.key, pp.run HAVING count(bits.pos) = count(*))"""
_RANKED = f"{_ST}, x AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rn FROM st)"
_LEVELS = f"""WITH RECURSIVE {_RANKED}, leaf AS (SELECT CAST(floor(rn / 16.0) AS INTEGER) AS node, max(key) AS max_key FROM x GROUP BY 1),
lv AS (SELECT 0 AS level, node, max_key FROM leaf
  UNION ALL SELECT level + 1, node, max_key FROM (
    SELECT level, CAST(floor(node / 5.0) AS INTEGER) AS node, max(max_key) AS max_key, sum(count(*)) OVER () AS below FROM lv GROUP BY 1, 2) WHERE below > 1)"""
_W = "w AS MATERIALIZED (SELECT o_orderkey AS seq, CAST(o_custkey AS INTEGER) AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)"
_EPOCHS = f"""WITH RECURSIVE {_W},
ep AS (SELECT 0 AS e, (SELECT min(seq) FROM w) AS s, (SELECT list(seq ORDER BY seq)[64] FROM w WHERE p IS NULL) AS t
  UNION ALL SELECT e + 1, t + 1, (SELECT list(seq ORDER BY seq)[64] FROM w WHERE w.seq > ep.t AND (p IS NULL OR p < ep.t + 1)) FROM ep WHERE t IS NOT NULL),
rows AS (SELECT ep.e AS epoch, min(w.seq) AS first_seq, min(w.k) AS min_key, max(w.k) AS max_key, CAST(count(DISTINCT w.k) AS INTEGER) AS num_keys, count(*) AS num_writes
  FROM ep JOIN w ON w.seq >= ep.s AND (ep.t IS NULL OR w.seq <= ep.t) GROUP BY ep.e)"""
_ONE_STORE = """w{0} AS MATERIALIZED (SELECT o_orderkey AS seq, o_custkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders WHERE ascii(o_orderpriority) - 48 = {0}),
ep{0} AS (SELECT 0 AS e, (SELECT list(seq ORDER BY seq)[64] FROM w{0} WHERE p IS NULL) AS t
  UNION ALL SELECT e + 1, (SELECT list(seq ORDER BY seq)[64] FROM w{0} WHERE seq > ep{0}.t AND (p IS NULL OR p <= ep{0}.t)) FROM ep{0} WHERE t IS NOT NULL)"""
_STORES = "WITH RECURSIVE " + ",\n".join(_ONE_STORE.format(k) for k in range(1, 6)) + "\n" + " UNION ALL ".join(
    f"SELECT {k} AS store, (SELECT count(*) FROM ep{k} WHERE t IS NOT NULL AND t < (SELECT max(seq) FROM w{k})) AS flushes, (SELECT count(*) FROM w{k}) AS writes" for k in range(1, 6)
)

_NATIONS = "nw AS (SELECT n_nationkey AS seq, CAST(n_nationkey % 20 AS INTEGER) AS key, CAST(CASE WHEN n_regionkey = 0 THEN -1 ELSE 100 * n_regionkey + n_nationkey END AS INTEGER) AS value FROM nation), ns AS (SELECT key, max_by(value, seq) AS value FROM nw GROUP BY key)"
#: A cache of 4 slots, one access after another: `slot` gets the page or has it, `passed` is how many the hand clears first.
_CLOCK = """WITH RECURSIVE t AS MATERIALIZED (SELECT CAST(user_id AS INTEGER) AS trace_id, CAST(event_id AS INTEGER) AS step, concat('p', CAST(floor(value) % 12 AS INTEGER)) AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT DISTINCT trace_id, 0::BIGINT AS n, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS page, false AS hit, CAST(NULL AS VARCHAR) AS evicted, ['', '', '', ''] AS pages, [false, false, false, false] AS bits, 0::BIGINT AS hand, 0::BIGINT AS filled FROM t
  UNION ALL
  SELECT trace_id, n, step, page, hit, CASE WHEN full_miss THEN pages[slot + 1] END,
    [CASE WHEN j = slot THEN page ELSE pages[j + 1] END FOR j IN range(0, 4)],
    [CASE WHEN j = slot THEN true WHEN full_miss AND (j - hand + 4) % 4 < passed THEN false ELSE bits[j + 1] END FOR j IN range(0, 4)],
    CASE WHEN full_miss THEN (slot + 1) % 4 ELSE hand END, CASE WHEN hit OR full_miss THEN filled ELSE filled + 1 END
  FROM (SELECT *, CASE WHEN hit THEN list_position(pages, page) - 1 WHEN full_miss THEN (hand + passed) % 4 ELSE filled END AS slot
    FROM (SELECT t.trace_id, t.n, t.step, t.page, pages, bits, hand, filled, list_contains(pages, t.page) AS hit, filled = 4 AND NOT list_contains(pages, t.page) AS full_miss,
        CASE WHEN NOT bits[hand + 1] THEN 0 WHEN NOT bits[(hand + 1) % 4 + 1] THEN 1 WHEN NOT bits[(hand + 2) % 4 + 1] THEN 2 WHEN NOT bits[(hand + 3) % 4 + 1] THEN 3 ELSE 4 END AS passed
      FROM c JOIN t ON t.trace_id = c.trace_id AND t.n = c.n + 1)))"""

#: What the hash makes of a word, and the turn of what it has so far with the next.
_SCRAMBLE = "((((({0} * 3432918353 % 4294967296) << 15) % 4294967296) + (({0} * 3432918353 % 4294967296) >> 17)) * 461845907 % 4294967296)"
_TURN13 = "(((xor(h, x) << 13) % 4294967296) + (xor(h, x) >> 19))"

ORACLE_SQL: dict[str, str] = {
    "state_latest": f"WITH {_ST} SELECT * FROM st",
    "state_with_tombstones": f"WITH {_ES} SELECT * FROM es",
    "point_get": f"WITH {_ST} SELECT * FROM st WHERE key = 42",
    "range_scan": f"WITH {_ST} SELECT * FROM st WHERE key BETWEEN 100 AND 200",
    "range_inverted": f"WITH {_ST} SELECT * FROM st WHERE key BETWEEN 200 AND 100",
    "sorted_scan": f"WITH {_ST} SELECT * FROM st ORDER BY key",
    "live_scan": f"WITH {_ES} SELECT * FROM es WHERE value <> -1",
    "scan_counts": f"WITH {_ES} SELECT count(*) AS found_n, count(CASE WHEN value <> -1 THEN 1 END) AS shown_n, count(CASE WHEN value = -1 THEN 1 END) AS hidden_n FROM es WHERE key BETWEEN 20 AND 90",
    "multi_get_classify": f"WITH {_ES}, p AS (SELECT DISTINCT CAST(event_id AS INTEGER) AS key FROM events) SELECT p.key, CASE WHEN es.value IS NULL THEN 'not_found' WHEN es.value = -1 THEN 'deleted' ELSE 'found' END AS status, es.value FROM p LEFT JOIN es ON p.key = es.key",
    "inorder_values": f"WITH {_ST} SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS pos, value FROM st",
    "pair_order": f"WITH {_OLOG} SELECT key, value FROM olog ORDER BY key, value",
    "merge_two_runs": f"WITH {_OLOG}, {_part('a', 'olog', 0.5, 1.0)}, {_part('b', 'olog', 0.0, 0.5)} SELECT coalesce(a.key, b.key) AS key, coalesce(a.value, b.value) AS value FROM a FULL OUTER JOIN b ON a.key = b.key",
    "merge_last_level": f"WITH {_ELOG}, {_part('a', 'elog', 0.5, 1.0)}, {_part('b', 'elog', 0.0, 0.5)}, c AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.value, b.value) AS value FROM a FULL OUTER JOIN b ON a.key = b.key) SELECT * FROM c WHERE value <> -1",
    "level_priority_read": f"WITH {_OLOG}, {_part('a', 'olog', 0.8, 1.0)}, {_part('b', 'olog', 0.5, 0.8)}, {_part('c', 'olog', 0.0, 0.5)}, u AS (SELECT *, 0 AS level FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 3 FROM c), x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level) AS rn FROM u) SELECT key, value, level FROM x WHERE rn = 1",
    "priority_union": f"WITH {_OLOG}, {_part('a', 'olog', 0.95, 1.0)}, {_part('b', 'olog', 0.0, 0.95)}, u AS (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 FROM b), x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source) AS rn FROM u) SELECT key, value, source FROM x WHERE rn = 1",
    "run_manifest": f"WITH {_RUNS} SELECT * FROM m",
    "zone_contains": f"WITH {_RUNS}, p AS (SELECT DISTINCT CAST(o_custkey * 11 AS INTEGER) AS key FROM orders) SELECT p.key, m.run FROM p JOIN m ON p.key BETWEEN m.min_key AND m.max_key",
    "zone_overlap": f"WITH {_RUNS} SELECT run FROM m WHERE max_key >= 2500 AND min_key <= 4500",
    "manifest_lines": f"WITH {_RUNS} SELECT concat_ws(',', '0', CAST(run AS VARCHAR), concat('sst_', CAST(run AS VARCHAR), '.txt'), CAST(min_key AS VARCHAR), CAST(max_key AS VARCHAR), CAST(num_pairs AS VARCHAR)) AS line FROM m",
    "manifest_parse": """
WITH t AS (SELECT * FROM (VALUES ('# runs of a small store'), (''), ('next_sst_number=9'), ('#'), ('0,8,sst_8.txt,3,77,61'), ('1,6,sst_6.txt,-4,70,118'), ('1,6,short.txt'), ('1,6,long.txt,1,2,3,4'),
  ('zero,6,word.txt,1,2,3'), ('3,31,sst_31.txt,-900,901,1802'), ('0,7,wide.txt,99999999999,1,1'), ('-1,7,below.txt,1,2,2'), ('  2,9,edges.txt,1,2,2  '), ('2, 9,inner.txt,1,2,2')) v(line)),
x AS (SELECT string_split(trim(line), ',') AS a FROM t WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE 'next_sst_number=%'),
y AS (SELECT try_cast(a[1] AS INTEGER) AS level, try_cast(a[2] AS INTEGER) AS sst_number, a[3] AS file_name, try_cast(a[4] AS INTEGER) AS min_key, try_cast(a[5] AS INTEGER) AS max_key, try_cast(a[6] AS BIGINT) AS num_pairs FROM x
  WHERE len(a) = 6 AND regexp_full_match(a[1] || a[2] || a[4] || a[5] || a[6], '[-+0-9]+'))
SELECT * FROM y WHERE level IS NOT NULL AND sst_number IS NOT NULL AND min_key IS NOT NULL AND max_key IS NOT NULL AND num_pairs IS NOT NULL AND level >= 0""",
    "manifest_round_trip": f"WITH {_RUNS} SELECT run AS sst_number, min_key, max_key, num_pairs FROM m",
    "flush_epochs": f"{_EPOCHS} SELECT * FROM rows",
    "flush_epochs_by_store": _STORES,
    "level_shape": "WITH f AS (SELECT CAST(floor((count(*) - 1) / 64.0) AS BIGINT) AS n FROM orders), b AS (SELECT CAST(unnest(range(0, 31)) AS INTEGER) AS level) SELECT level, CAST(64 * (1::BIGINT << level) AS BIGINT) AS num_pairs FROM b, f WHERE (f.n >> level) & 1 = 1",
    "memtable_status": f"{_EPOCHS} SELECT num_keys AS size, 64 AS capacity, round(num_keys * 100.0 / 64, 1)::DOUBLE AS fill_percent FROM rows WHERE epoch = (SELECT max(epoch) FROM rows)",
    "bloom_positions": f"WITH {_RUNS}, {_H} SELECT DISTINCT r.run, {_pos('r.key', 'm.num_pairs')} AS pos FROM r JOIN m ON r.run = m.run CROSS JOIN h",
    "bloom_size": f"WITH {_RUNS} SELECT run, num_pairs * 10 AS num_bits, CAST(ceil(num_pairs * 10 / 8.0) AS BIGINT) AS num_bytes FROM m",
    "bloom_probe": f"WITH {_WIDE}, {_H}, {_BITS}, {_MAYBE} SELECT key, run FROM maybe",
    "bloom_quality": f"WITH {_WIDE}, {_H}, {_BITS}, {_MAYBE} SELECT (SELECT count(*) FROM z) AS probe_n, count(*) AS maybe_n, count(CASE WHEN r.key IS NULL THEN 1 END) AS false_n FROM maybe LEFT JOIN r ON r.key = maybe.key AND r.run = maybe.run",
    "leaf_pages": f"WITH {_RANKED} SELECT CAST(floor(rn / 512.0) AS INTEGER) AS page, min(key) AS min_key, max(key) AS max_key, count(*) AS num_pairs FROM x GROUP BY 1",
    "internal_levels": f"{_LEVELS} SELECT * FROM lv",
    "internal_separators": f"""{_LEVELS}, c AS (SELECT level + 1 AS level, CAST(floor(node / 5.0) AS INTEGER) AS parent, node, max_key, row_number() OVER (PARTITION BY level, CAST(floor(node / 5.0) AS INTEGER) ORDER BY node DESC) AS back FROM lv)
SELECT lv.level, lv.node, coalesce((SELECT string_agg(CAST(c.max_key AS VARCHAR), ',' ORDER BY c.node) FROM c WHERE c.level = lv.level AND c.parent = lv.node AND c.back > 1), '') AS keys FROM lv WHERE lv.level > 0""",
    "route_key": f"WITH {_RANKED}, pg AS (SELECT CAST(floor(rn / 64.0) AS INTEGER) AS page, max(key) AS max_key FROM x GROUP BY 1), p AS (SELECT DISTINCT CAST(o_custkey + 3 AS INTEGER) AS key FROM orders) SELECT p.key, min(pg.page) AS page FROM p LEFT JOIN pg ON pg.max_key >= p.key GROUP BY p.key",
    "page_locality": f"WITH {_RANKED} SELECT CAST(floor(rn / 64.0) AS INTEGER) AS page, count(*) AS keys_hit FROM x WHERE key IN (SELECT CAST(o_custkey + 3 AS INTEGER) FROM orders) GROUP BY 1",
    "leaf_search": f"WITH {_RANKED}, pg AS (SELECT CAST(floor(rn / 64.0) AS INTEGER) AS page, max(key) AS max_key FROM x GROUP BY 1), p AS (SELECT DISTINCT CAST(o_custkey + 3 AS INTEGER) AS key FROM orders), q AS (SELECT p.key, min(pg.page) AS page FROM p LEFT JOIN pg ON pg.max_key >= p.key GROUP BY p.key) SELECT q.key, q.page, st.value FROM q LEFT JOIN st ON st.key = q.key",
    "run_read_path": f"""WITH {_WIDE}, {_H}, {_BITS}, {_MAYBE}, v AS (SELECT CAST(floor(seq * 8 / ((SELECT max(seq) FROM olog) + 1)) AS INTEGER) AS run, key, max_by(value, seq) AS value FROM olog GROUP BY 1, 2)
SELECT p.key, max_by(v.value, v.run) AS value, max(v.run) AS run, count(z.run) AS zone_n, count(maybe.run) AS maybe_n FROM p LEFT JOIN z ON z.key = p.key LEFT JOIN maybe ON maybe.key = z.key AND maybe.run = z.run LEFT JOIN v ON v.key = z.key AND v.run = z.run GROUP BY p.key""",
    "run_file_headers": f"""WITH {_RUNS}, l AS (SELECT *, CAST(ceil(num_pairs / 512.0) AS INTEGER) AS leaves FROM m), g AS (SELECT *, CASE WHEN leaves > 1 THEN 1 ELSE 0 END AS nodes FROM l)
SELECT run, CAST(4096 * (1 + nodes) + 8 * num_pairs + ceil(num_pairs * 10 / 8.0) AS BIGINT) AS file_bytes, 1 + nodes AS height, leaves, CAST(num_pairs - 512 * (leaves - 1) AS INTEGER) AS last_leaf_pairs, min_key, max_key, num_pairs, num_pairs * 10 AS num_bits, 1 + nodes AS first_leaf_page FROM g""",
    "run_file_pairs": "SELECT CAST(floor(o_orderkey / 1000.0) AS INTEGER) AS run, CAST(o_orderkey AS INTEGER) AS key, CAST(floor(o_totalprice) AS INTEGER) AS value FROM orders",
    "store_multi_get": f"WITH {_ST}, p AS (SELECT DISTINCT CAST(o_custkey * 2 + 1 AS INTEGER) AS key FROM orders) SELECT p.key, CASE WHEN st.value IS NULL THEN 'not_found' WHEN st.value = -1 THEN 'deleted' ELSE 'found' END AS status, st.value FROM p LEFT JOIN st ON p.key = st.key",
    "store_point_writes": f"WITH {_NATIONS} SELECT * FROM ns",
    "store_live_scan": f"WITH {_NATIONS} SELECT * FROM ns WHERE key BETWEEN 2 AND 17 AND value <> -1",
    "store_point_levels": f"WITH {_NATIONS}, x AS (SELECT key, CASE CAST(floor(seq / 8.0) AS INTEGER) WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS level FROM nw) SELECT CAST(level AS INTEGER) AS level, min(key) AS min_key, max(key) AS max_key, count(DISTINCT key) AS num_pairs FROM x GROUP BY level",
    "store_added_runs": f"WITH {_ES} SELECT * FROM es",
    "clock_trace": f"{_CLOCK} SELECT trace_id, step, page, hit, evicted FROM c WHERE n > 0",
    "clock_hits": f"{_CLOCK} SELECT trace_id, count(*) AS accesses, count(CASE WHEN hit THEN 1 END) AS hits, count(evicted) AS evictions FROM c WHERE n > 0 GROUP BY trace_id",
    "seq_load": "SELECT CAST(k AS INTEGER) AS key, CAST(k AS INTEGER) AS value FROM range(10, 1001, 3) t(k)",
    "bulk_load": "WITH n AS (SELECT count(*) AS n FROM orders) SELECT n AS num_pairs, 1 AS min_key, CAST(n AS INTEGER) AS max_key, CAST(n * (n + 1) / 2 AS BIGINT) AS total FROM n",
    "store_reopened": f"WITH {_ST} SELECT * FROM st",
    "store_levels": f"""WITH {_OLOG}, x AS (SELECT CASE WHEN seq * 5 >= 4 * (SELECT max(seq) + 1 FROM olog) THEN 0 ELSE 2 END AS level, key FROM olog)
SELECT CAST(level AS INTEGER) AS level, min(key) AS min_key, max(key) AS max_key, count(DISTINCT key) AS num_pairs FROM x GROUP BY level""",
    "bucket_stats": f"""WITH {_RUNS}, pg AS (SELECT concat('sst_', CAST(run AS VARCHAR), '.txt:', CAST(k * 4096 AS VARCHAR)) AS t FROM m, range(0, 8) u(k)),
d AS (SELECT t, length(t) AS n, length(t) // 4 AS whole FROM pg),
w AS (SELECT t, n, whole, [CAST(ascii(t[4 * k + 1]) + 256 * ascii(t[4 * k + 2]) + 65536 * ascii(t[4 * k + 3]) + 16777216 * CAST(ascii(t[4 * k + 4]) AS BIGINT) AS HUGEINT) for k in range(0, whole)] AS words,
  [CAST(ascii(t[4 * whole + j + 1]) AS HUGEINT) * (1 << (8 * j)) for j in range(0, n % 4)] AS rest FROM d),
s AS (SELECT t, n, [{_SCRAMBLE.format('x')} for x in words] AS words, CASE WHEN n % 4 = 0 THEN 0::HUGEINT ELSE {_SCRAMBLE.format('list_sum(rest)::HUGEINT')} END AS tail FROM w),
b AS (SELECT t, n, tail, list_reduce(list_prepend(0::HUGEINT, words), lambda h, x: ({_TURN13} * 5 + 3864292196) % 4294967296) AS h FROM s),
f0 AS (SELECT xor(xor(h, tail), n::HUGEINT) AS h FROM b), f1 AS (SELECT xor(h, h >> 16) * 2246822507 % 4294967296 AS h FROM f0), f2 AS (SELECT xor(h, h >> 13) * 3266489909 % 4294967296 AS h FROM f1),
c AS (SELECT xor(h, h >> 16) % 4096 AS bucket, count(*) AS chain FROM f2 GROUP BY 1)
SELECT CAST(sum(chain) AS BIGINT) AS size, 4096 AS num_buckets, sum(chain) / 4096.0::DOUBLE AS load_factor, max(chain) AS max_chain, avg(chain) AS mean_chain, 4096 - count(*) AS empty_buckets FROM c""",
    "tombstone_share": f"WITH {_ES} SELECT count(*) AS num_keys, count(CASE WHEN value = -1 THEN 1 END) AS num_deleted FROM es",
}
