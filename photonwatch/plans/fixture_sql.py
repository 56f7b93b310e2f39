"""The network tables as SQL over the driver tables, for the checks only."""

from __future__ import annotations

import re

_N = "(SELECT count(*) FROM supplier)"
_LO = "(SELECT min(s_suppkey) FROM supplier)"

VIEWS = {
    "nodes": """
SELECT s_suppkey AS id, concat('NODE_', CAST(s_suppkey AS VARCHAR)) AS node_id,
       CASE WHEN s_suppkey % 4 = 3 THEN 'Switch' ELSE 'QKD' END AS type,
       CASE WHEN s_suppkey % 5 = 0 THEN 'Offline' ELSE 'Online' END AS status,
       CASE WHEN s_suppkey % 7 = 0 THEN 'Temporary' ELSE 'Created' END AS state,
       abs(s_acctbal) AS key_pool_remaining, s_nationkey AS site
FROM supplier""",
    "links": f"""
SELECT e.src * 2 + CASE WHEN e.d = 1 THEN 0 ELSE 1 END AS id,
       concat('LINK_', CAST(e.src AS VARCHAR), '_', CAST(e.dst AS VARCHAR)) AS link_id,
       e.src AS source_node, e.dst AS destination_node,
       CASE WHEN e.src % 4 <> 3 AND e.dst % 4 <> 3 THEN 'Quantum' ELSE 'Classical' END AS link_type,
       CAST((e.src * 37 + e.d * 11) % 130 AS DOUBLE) / 10 AS qber,
       80 + CAST((e.src * 53 + e.d * 7) % 200 AS DOUBLE) / 10 AS visibility,
       CAST((e.src * 29 + e.d * 3) % 150 AS DOUBLE) / 10 AS key_rate,
       CAST((e.src * 17 + e.d * 5) % 400 AS DOUBLE) / 10 AS photon_loss
FROM (SELECT s.s_suppkey AS src, o.d AS d, ((s.s_suppkey - {_LO} + o.d) % {_N}) + {_LO} AS dst
      FROM supplier s CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 7 AS d) o) e""",
    "sessions": f"""
SELECT o_orderkey AS id, concat('S_', CAST(o_orderkey AS VARCHAR)) AS session_id,
       (o_custkey % {_N}) + {_LO} AS source_node, ((o_custkey * 3 + 1) % {_N}) + {_LO} AS destination_node,
       CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Failed' ELSE 'Closed' END AS status,
       o_orderdate AS start_time
FROM orders""",
    "session_path": f"""
SELECT p.session_id, p.step_order,
       (CASE WHEN p.session_id % 2 = 0 THEN (p.base + p.step_order - 1) % {_N}
             ELSE ((p.base - p.step_order) % {_N} + {_N}) % {_N} END + {_LO}) * 2 AS link_id
FROM (SELECT l.l_orderkey AS session_id, o.o_custkey % {_N} AS base,
             CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS BIGINT) AS step_order
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) p""",
    "faults": f"""
SELECT o_orderkey AS id,
       concat('FLT_', CASE WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0')
                           ELSE CAST(o_orderkey AS VARCHAR) END) AS fault_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Link' ELSE 'Node' END AS component_type,
       CASE WHEN o_orderkey % 3 = 0 THEN ((o_custkey % {_N}) + {_LO}) * 2 ELSE (o_custkey % {_N}) + {_LO} END AS component_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Critical' WHEN o_orderpriority = '2-HIGH' THEN 'Warning' ELSE 'Info' END AS severity,
       CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Ongoing' ELSE 'Resolved' END AS status,
       o_orderdate AS detected_at,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '3' HOUR END AS acknowledged_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '9' HOUR
            WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '30' HOUR END AS resolved_at,
       CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS acknowledged_by,
       CASE WHEN o_orderstatus <> 'O' THEN o_custkey + 1 END AS assigned_to,
       CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 END AS resolved_by,
       CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS alert_id
FROM orders""",
    "users": """
SELECT c_custkey AS uuid, c_name AS name, c_custkey % 6 AS role_id,
       CASE c_custkey % 5 WHEN 0 THEN 'Online' WHEN 1 THEN 'Offline' WHEN 2 THEN 'Locked' WHEN 3 THEN 'Deactivated' ELSE 'Invited' END AS status,
       CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '1998-06-17 12:00:00' - (c_custkey % 60) * INTERVAL '1' DAY END AS last_login
FROM customer""",
    "roles": """
SELECT CAST(id AS BIGINT) AS id, role_name FROM (VALUES (0, 'Super Admin'), (1, 'System Automation'),
 (2, 'Administrator'), (3, 'Operator'), (4, 'Analyst'), (5, 'Viewer')) v(id, role_name)""",
    "permissions": """
SELECT CAST(id AS BIGINT) AS id, permission_name FROM (VALUES (1, 'fault.acknowledge'), (2, 'fault.resolve'),
 (3, 'alert.escalate'), (4, 'policy.view')) v(id, permission_name)""",
    "roles_permissions": """
SELECT CAST(r.id AS BIGINT) AS role_id, CAST(p.id AS BIGINT) AS permission_id
FROM (SELECT unnest([0,1,2,3,4,5]) AS id) r CROSS JOIN (SELECT unnest([1,2,3,4]) AS id) p
WHERE r.id <= 2 OR (r.id = 3 AND p.id <= 2) OR p.id = 4""",
    "role_requests": """
SELECT o_orderkey AS id, o_custkey AS assigned_to, o_custkey + o_orderkey % 2 AS requested_by, o_orderkey % 6 AS role_id,
       CASE WHEN o_orderstatus = 'P' THEN 'Pending Approval' ELSE 'Approved' END AS status
FROM orders""",
    "user_sessions": """
SELECT user_id, concat('TOK_', CAST(event_id AS VARCHAR)) AS session_token, ts AS created_at, ts + INTERVAL '30' MINUTE AS expires_at
FROM events WHERE event_type = 'purchase'""",
    "policies": """
SELECT p_partkey AS id, p_name AS policy_name,
       CASE p_partkey % 3 WHEN 0 THEN 'Weightage' WHEN 1 THEN 'Threshold' ELSE 'Security' END AS policy_type,
       CASE p_size % 3 WHEN 0 THEN 'Global' WHEN 1 THEN 'Node' ELSE 'Link' END AS scope,
       CASE WHEN p_size % 2 = 0 THEN 'Active' ELSE 'Inactive' END AS status,
       p_partkey % 4 + 1 AS priority, p_partkey % 10 = 0 AS is_deleted,
       CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 1000 END AS created_by
FROM part""",
    "policy_rules": """
SELECT l_partkey AS policy_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'QBER' WHEN 1 THEN 'Visibility' WHEN 2 THEN 'Photon Loss' ELSE 'Key Rate' END AS metric,
       l_quantity AS value, l_discount AS weight
FROM lineitem""",
    "policy_target": """
SELECT l_partkey AS policy_id, CASE l_linenumber % 3 WHEN 0 THEN 'Node' WHEN 1 THEN 'Link' ELSE 'Site' END AS target_type,
       l_suppkey AS target_id
FROM lineitem""",
    "keys_summaries": """
SELECT l_shipdate AS timestamp, l_quantity AS keys_generated, l_quantity * (1 - l_discount) AS keys_consumed,
       l_quantity * l_tax AS keys_expired, l_tax * 100 AS avg_retention_time
FROM lineitem""",
    "alerts": f"""
SELECT event_id AS id, concat('ALR_', CAST(event_id AS VARCHAR)) AS alert_id,
       CASE event_id % 4 WHEN 0 THEN 'Low Visibility' WHEN 1 THEN 'Low Key Pool' WHEN 2 THEN 'High Photon Loss' ELSE 'QBER Spike' END AS type,
       CASE WHEN value > 40 THEN 'Critical' WHEN value > 15 THEN 'Warning' ELSE 'Info' END AS severity,
       CASE user_id % 3 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'Escalated' ELSE 'Open' END AS status,
       CASE WHEN event_id % 3 = 0 THEN 'Link' ELSE 'Node' END AS component_type,
       CASE WHEN event_id % 3 = 0 THEN (event_id % {_N} + {_LO}) * 2 ELSE event_id % {_N} + {_LO} END AS component_id,
       ts AS detected_at,
       concat('Reading ', props, ' beyond limit. Raised by user ', CAST(user_id AS VARCHAR)) AS description
FROM events WHERE event_type = 'error'""",
    "audit_log": f"""
SELECT event_id AS id, ts AS timestamp, event_type AS action_type, user_id AS performed_by,
       event_id % 2500 AS policy_id, event_id * 3 % 30000 AS fault_id, event_id AS alert_id,
       CASE event_id % 3 WHEN 0 THEN 'Node' WHEN 1 THEN 'Link' ELSE 'Site' END AS component_type,
       CASE WHEN event_id % 3 = 1 THEN (event_id % {_N} + {_LO}) * 2 ELSE event_id % {_N} + {_LO} END AS component_id,
       CASE WHEN event_id % 4 = 0 THEN 'Failed' ELSE 'Success' END AS outcome, props AS notes
FROM events""",
    "login_log": """
SELECT event_id, user_id, ts, event_type = 'purchase' AS success FROM events WHERE event_type IN ('error', 'purchase')""",
    "service_log": """
SELECT event_id, user_id AS service_id, ts,
       CASE event_type WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'failed' ELSE event_type END AS state
FROM events""",
    "tele_nodes": """
SELECT DISTINCT concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name,
       CASE WHEN user_id % 12 = 11 THEN 'Switch' ELSE 'QKD' END AS node_type FROM events""",
    "tele_links": """
SELECT DISTINCT concat('T', CAST(user_id % 9 AS VARCHAR)) AS link_name, concat('N', CAST(user_id % 9 AS VARCHAR)) AS source_node,
       concat('N', CAST(((user_id % 9) * 5 + 2) % 12 AS VARCHAR)) AS destination_node,
       CASE WHEN user_id % 9 = 8 THEN 'Classical' ELSE 'Quantum' END AS link_type FROM events""",
    "node_metrics": """
SELECT concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp,
       avg(CASE WHEN event_type = 'view' THEN least(value, 100) END) AS cpu_usage,
       avg(CASE WHEN event_type = 'click' THEN least(value * 2, 100) END) AS memory_usage,
       avg(20 + least(value, 60)) AS temperature, avg(value) * 10 AS aggregated_key_rate,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count
FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2""",
    "link_metrics": """
SELECT concat('T', CAST(user_id % 9 AS VARCHAR)) AS link_name, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp,
       least(avg(value) / 1000, 0.1) AS qber, 1 - least(avg(value) / 500, 0.3) AS visibility,
       2000 - least(avg(value) * 10, 1900) AS key_rate, 5 + least(avg(value) / 10, 10) AS laser_power,
       avg(value) AS attenuation, least(avg(value), 60) AS photon_loss, CAST(0.1 AS DOUBLE) AS detector_efficiency,
       0.9 * (2000 - least(avg(value) * 10, 1900)) AS secure_key_rate
FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2""",
    "library": """
SELECT min(doc_id) AS id, source AS filename, count(*) AS chunk_count, CAST(sum(n_chars) AS BIGINT) AS size_bytes,
       CASE WHEN min(doc_id) % 7 = 3 THEN 'deleted' ELSE 'active' END AS status
FROM documents GROUP BY source""",
    "chunks": """
SELECT d.doc_id AS id, d.source AS filename, d.text AS content, e.embedding AS embedding,
       CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS BIGINT) AS chunk_index,
       CASE WHEN l.toxic = 1 THEN 'inactive' ELSE 'active' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "questions": "SELECT item_id AS query_id, text AS query FROM benchmark",
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views; a leading WITH in it is joined on."""
    body = body.strip()
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in names.split()]
    if not parts:
        return body
    joined = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if joined:
        recursive = "RECURSIVE " if joined.group(1) else ""
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + body[joined.end():]
    return "WITH " + ",\n".join(parts) + "\n" + body
