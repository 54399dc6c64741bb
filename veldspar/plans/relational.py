"""Joins, windows, sets, aggregates and rules as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from .registry import both

# --- projections, filters, ordered rules -------------------------------------------------------------------------------------------------
both("projection_defaults", "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM {documents}")
both("eligibility_filter", "SELECT doc_id, lang FROM {documents} WHERE source LIKE 'src1%' OR lang IN ('de', 'es')")
both("status_and_complement", "SELECT quality, count(*) AS n, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS exceptions FROM {labels} GROUP BY quality")
both("period_filter", "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type")
both(
    "triage_case",
    """SELECT bucket, count(*) AS n, CAST(sum(priority) AS BIGINT) AS priority FROM (
    SELECT CASE WHEN o_orderstatus = 'P' THEN 'acquisition_exception' WHEN o_totalprice >= 300000 THEN 'priority_review' WHEN o_totalprice >= 150000 AND o_orderpriority < '3' THEN 'possible'
    WHEN o_totalprice < 50000 THEN 'low_signal' ELSE 'manual_review' END AS bucket, CASE WHEN o_totalprice >= 300000 THEN 1 WHEN o_totalprice >= 150000 THEN 2 ELSE 3 END AS priority FROM {orders}) x GROUP BY bucket""",
)
both(
    "acquisition_status",
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'failed' WHEN length(text) >= 500 THEN 'acquired_extracted' WHEN length(text) > 0 THEN 'acquired_short' ELSE 'acquired_empty' END AS status FROM {documents}) x GROUP BY status",
)
both(
    "quality_disposition",
    """SELECT disposition, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN missing THEN 'missing' WHEN sum(n) OVER (PARTITION BY h) > 1 THEN 'repeated_text' WHEN short THEN 'short' ELSE 'ok' END AS disposition, n
    FROM (SELECT sha2(text, 256) AS h, text IS NULL OR text = '' AS missing, n_chars < 300 AS short, count(*) AS n FROM {documents} GROUP BY 1, 2, 3) x) y GROUP BY disposition""",
)
both("low_confidence", "SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'error' OR (event_type = 'view' AND value < 12.0) GROUP BY user_id")
both(
    "class_rule_decision",
    """SELECT d.decision, count(*) AS n FROM {documents} t JOIN (SELECT 'en' AS lang, 'include' AS decision UNION ALL SELECT 'fr', 'include' UNION ALL SELECT 'de', 'review' UNION ALL SELECT 'es', 'exclude') d ON t.lang = d.lang GROUP BY d.decision""",
)
both(
    "allow_list_decision",
    """SELECT coalesce(d.decision, 'pending') AS decision, count(*) AS n FROM {customer} c LEFT JOIN (SELECT 1 AS id, 'include' AS decision UNION ALL SELECT 2, 'exclude' UNION ALL SELECT 3, 'include') d ON c.c_custkey = d.id GROUP BY coalesce(d.decision, 'pending')""",
)

# --- joins -------------------------------------------------------------------------------------------------------------------------------
both("join_inner", "SELECT d.lang, l.quality, count(*) AS n FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang, l.quality")
both("join_left_default", "SELECT coalesce(l.quality, -1) AS quality, count(*) AS n FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY coalesce(l.quality, -1)")
both("join_semi", "SELECT source, count(*) AS n FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY source")
both("join_anti", "SELECT source, count(*) AS n FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id) GROUP BY source")
both(
    "join_unique_override",
    """SELECT c.c_custkey, o.o_orderkey AS override_key FROM {customer} c JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM {orders} WHERE o_totalprice > 250000 GROUP BY o_custkey HAVING count(*) = 1) o ON c.c_custkey = o.o_custkey""",
)
both("join_known_flag", "SELECT known, count(*) AS n FROM (SELECT e.user_id, k.user_id IS NOT NULL AS known FROM {events} e LEFT JOIN (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'purchase') k ON e.user_id = k.user_id) x GROUP BY known")
both(
    "join_grid",
    """SELECT r.r_name, s.threshold, count_if(n.n_nationkey >= s.threshold) AS n FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey CROSS JOIN (SELECT 5 AS threshold UNION ALL SELECT 10 UNION ALL SELECT 15) s GROUP BY r.r_name, s.threshold""",
)
both("join_upper_pairs", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")

# --- aggregates --------------------------------------------------------------------------------------------------------------------------
both("group_count", "SELECT lang, count(*) AS n FROM {documents} GROUP BY lang")
both("two_key_count", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY lang, source")
both("conditional_counts", "SELECT count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic, count_if(quality = 1 AND toxic = 0) AS clean FROM {labels}")
both("group_mean", "SELECT event_type, round(avg(value), 6) AS mean_value FROM {events} GROUP BY event_type")
both("label_share", "SELECT toxic, round(avg(CAST(quality AS DOUBLE)), 8) AS share FROM {labels} GROUP BY toxic")
both("split_by_dimension", "SELECT d.lang, count_if(l.toxic = 0) AS resistant, count_if(l.toxic = 1) AS pro FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang")
both("distinct_counts", "SELECT count(DISTINCT sha2(text, 256)) AS texts, count(DISTINCT source) AS sources FROM {documents}")
both("sum_of_sizes", "SELECT lang, CAST(sum(coalesce(try_cast(CAST(n_chars AS VARCHAR(20)) AS BIGINT), 0)) AS BIGINT) AS chars FROM {documents} GROUP BY lang")
both("grid_ranges", "SELECT l_returnflag, min(l_discount) AS low, max(l_discount) AS high, round(max(l_discount) - min(l_discount), 8) AS width FROM {lineitem} GROUP BY l_returnflag")
both(
    "partition_accounting",
    """SELECT count(*) AS total, count_if(q = 1 AND t = 0) AS good, count_if(q = 1 AND t = 1) AS good_toxic, count_if(q = 0) AS bad, count_if(q IS NULL) AS unlabelled,
    count(*) = count_if(q = 1 AND t = 0) + count_if(q = 1 AND t = 1) + count_if(q = 0) + count_if(q IS NULL) AS balanced FROM (SELECT d.doc_id, l.quality AS q, l.toxic AS t FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) x""",
)
both("max_abs_difference", "SELECT round(max(abs(l_discount - l_tax)), 8) AS difference FROM {lineitem}")
both(
    "hash_collisions",
    """SELECT text_key, CAST(count(*) AS BIGINT) AS size, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM (SELECT substring(sha2(text, 256), 1, 12) AS text_key, source FROM {documents}) x GROUP BY text_key HAVING count(DISTINCT source) > 1""",
    """SELECT text_key, CAST(count(*) AS BIGINT) AS size, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM (SELECT substring(sha256(text), 1, 12) AS text_key, source FROM documents) x GROUP BY text_key HAVING count(DISTINCT source) > 1""",
)

# --- windows -----------------------------------------------------------------------------------------------------------------------------
both(
    "keeper_earliest",
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}) x WHERE rn = 1""",
)
both("first_seen_flag", "SELECT event_id, rn > 1 AS repeated FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM {events}) x")
both(
    "qualified_ids",
    """SELECT doc_id, CASE WHEN r.h IS NOT NULL THEN concat('dup__', CAST(doc_id AS VARCHAR(20))) ELSE CAST(doc_id AS VARCHAR(20)) END AS qualified
    FROM (SELECT doc_id, sha2(text, 256) AS h FROM {documents}) d LEFT JOIN (SELECT sha2(text, 256) AS h FROM {documents} GROUP BY 1 HAVING count(*) > 1) r ON d.h = r.h""",
)
both(
    "pair_keep_drop",
    """SELECT min(doc_id) AS keep_id, max(doc_id) AS drop_id FROM {documents} GROUP BY sha2(text, 256) HAVING count(*) = 2""",
)
both(
    "argmax_margin",
    """SELECT user_id, event_type, round(top, 6) AS top, round((top - coalesce(second, 0.0)) / greatest(top, 1.0), 6) AS margin FROM (
    SELECT user_id, event_type, score AS top, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS second, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rn
    FROM (SELECT user_id, event_type, round(sum(value), 4) AS score FROM {events} GROUP BY user_id, event_type) s) x WHERE rn = 1""",
)
both(
    "transitive_guard",
    """SELECT count(*) AS both_kept_and_dropped FROM (SELECT min(doc_id) AS id FROM {documents} GROUP BY sha2(text, 256) HAVING count(*) > 1) k
    JOIN (SELECT d.doc_id AS id FROM (SELECT doc_id, sha2(text, 256) AS h FROM {documents}) d JOIN (SELECT sha2(text, 256) AS h, min(doc_id) AS first_id FROM {documents} GROUP BY 1) f ON d.h = f.h WHERE d.doc_id > f.first_id) g ON k.id = g.id""",
)
both("context_rows", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM {conversations}")

# --- order and limits --------------------------------------------------------------------------------------------------------------------
both("mixed_order", "SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_regionkey DESC, n_name ASC) AS place FROM {nation}")
both("first_of_each", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}) x WHERE rn <= 3")

# --- sets --------------------------------------------------------------------------------------------------------------------------------
both("tagged_union", "SELECT origin, count(*) AS n FROM (SELECT 'labels' AS origin, doc_id FROM {labels} UNION ALL SELECT 'documents', doc_id FROM {documents}) x GROUP BY origin")
both("set_difference", "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}")
both("intersection", "SELECT count(*) AS n FROM (SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}) x")
both("groups_disjoint", "SELECT count(*) AS in_both FROM (SELECT id FROM (SELECT doc_id AS id FROM {labels} WHERE toxic = 1 UNION ALL SELECT doc_id FROM {labels} WHERE toxic = 0) u GROUP BY id HAVING count(*) > 1) x")
both("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
both("latest_decision", "SELECT user_id, max_by(event_type, event_id) AS decision, max(event_id) AS decided_by FROM {events} GROUP BY user_id")
