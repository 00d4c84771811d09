"""Permutations, ranks and run labels (survey 2.4, second half)."""

_SRC = "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM @documents"
_LABEL = f"SELECT source, doc_id, pos, n_chars, sum(CASE WHEN n_chars >= before THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM (SELECT *, lag(n_chars) OVER (PARTITION BY source ORDER BY pos) AS before FROM ({_SRC}))"
_REG = f"SELECT source, pos, n_chars BETWEEN 200 AND 4000 AS ok FROM ({_SRC})"

QUERIES = {
    "run_labels": f"SELECT source, doc_id, CAST(label AS BIGINT) AS label FROM ({_LABEL})",
    "run_labels_inverse": f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY label, n_chars DESC, pos) AS place FROM ({_LABEL})",
    "run_lengths": f"SELECT source, CAST(label AS BIGINT) AS label, count(*) AS n FROM ({_LABEL}) GROUP BY source, label",
    "missing_ids": "SELECT a.id FROM (SELECT explode(sequence(lo, hi)) AS id FROM (SELECT min(l_partkey) AS lo, max(l_partkey) AS hi FROM @lineitem)) a LEFT JOIN (SELECT DISTINCT l_partkey FROM @lineitem WHERE l_quantity > 45) b ON a.id = b.l_partkey WHERE b.l_partkey IS NULL",
    "id_gaps": "SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM @orders",
    "block_sort": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY substr(text, 20, 40), doc_id) AS place FROM @documents",
    "revid_rank": f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, pos) - 1 AS r FROM ({_SRC})",
    "lehmer_small": f"SELECT a.source, a.doc_id, count(b.doc_id) AS smaller_later FROM ({_SRC}) a LEFT JOIN ({_SRC}) b ON a.source = b.source AND b.pos > a.pos AND b.n_chars < a.n_chars GROUP BY a.source, a.doc_id",
    "class_plan": "SELECT p.event_type, p.event_id, b.event_id AS partner FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM @events) p JOIN (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k FROM @events) b ON p.event_type = b.event_type AND p.k = b.k",
    "used_ranks": "SELECT u.o_custkey, r.c_custkey FROM (SELECT o_custkey, o_custkey % 50 AS g, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_custkey) AS j FROM (SELECT DISTINCT o_custkey FROM @orders)) u JOIN (SELECT c_custkey, c_custkey % 50 AS g, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_acctbal, c_custkey) AS j FROM @customer) r ON u.g = r.g AND u.j = r.j",
    "longest_regular_run": f"SELECT source, first_pos, n FROM (SELECT source, first_pos, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_pos) AS k FROM (SELECT source, min(pos) AS first_pos, count(*) AS n FROM (SELECT source, pos, pos - row_number() OVER (PARTITION BY source ORDER BY pos) AS island FROM ({_REG}) WHERE ok) GROUP BY source, island)) WHERE k = 1",
    "reorder_plan": "SELECT d.source, d.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS part, row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END, l.quality DESC, d.doc_id) AS place FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id",
    "varint_size": "SELECT o_orderkey, CAST(greatest(1, ceil(length(regexp_replace(bin_of(o_orderkey), '^0+', '')) / 7.0)) AS BIGINT) AS n_bytes FROM @orders",
    "restore_order": "SELECT o_orderpriority, o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM @orders",
}
