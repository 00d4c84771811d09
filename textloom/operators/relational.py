"""The relational surface on the star schema and on events (survey 2.14)."""

_REV = "round(sum(l_extendedprice * (1 - l_discount)), 2)"

QUERIES = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM @lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "join_chain": f"SELECT n_name, {_REV} AS revenue FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM @customer LEFT JOIN @orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_full": "SELECT coalesce(c_nationkey, s_nationkey) AS nation, n_c, n_s FROM (SELECT c_nationkey, count(*) AS n_c FROM @customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n_s FROM @supplier GROUP BY s_nationkey) s ON c_nationkey = s_nationkey",
    "join_semi": "SELECT o_orderkey FROM @orders WHERE EXISTS (SELECT 1 FROM @lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "join_anti": "SELECT c_custkey FROM @customer WHERE NOT EXISTS (SELECT 1 FROM @orders WHERE o_custkey = c_custkey)",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM @lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM @orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM @customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "pivot": "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM @orders GROUP BY o_orderpriority",
    "window_topk": "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM @orders) WHERE k <= 3",
    "window_moving": "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS moving, count(*) OVER (PARTITION BY user_id) AS n FROM @events",
    "set_intersect": "SELECT c_nationkey AS k FROM @customer INTERSECT SELECT s_nationkey AS k FROM @supplier",
    "set_except": "SELECT p_partkey AS k FROM @part EXCEPT SELECT l_partkey AS k FROM @lineitem WHERE l_quantity < 3",
    "set_union_all": "SELECT 'c' AS kind, c_nationkey AS k, count(*) AS n FROM @customer GROUP BY c_nationkey UNION ALL SELECT 's' AS kind, s_nationkey AS k, count(*) AS n FROM @supplier GROUP BY s_nationkey",
    "range_join": "SELECT a.user_id, a.event_id, count(b.event_id) AS within_hour FROM @events a LEFT JOIN @events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR GROUP BY a.user_id, a.event_id",
    "asof_last": "SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM @events",
    "tumbling_window": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM @events GROUP BY event_type, date_trunc('hour', ts)",
    "session_window": "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, sum(CASE WHEN ts <= before + INTERVAL '30' MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM @events)) GROUP BY user_id, session",
    "distinct_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM @lineitem GROUP BY l_returnflag",
    "label_join": "SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id GROUP BY source",
    "conversation_turns": "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT role) AS roles FROM @conversations GROUP BY conv_id",
}
