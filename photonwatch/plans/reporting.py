"""Registered queries: faults, alerts, indicators, access, audit, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonwatch.operators import access, audit, filters, incidents, kpi, topology
from photonwatch.plans.fixtures import AS_OF_OPS, Tables, at
from photonwatch.plans.registry import query

_SPINE = "spine AS (SELECT CAST(TIMESTAMP '1998-06-17' - d * INTERVAL '1' DAY AS DATE) AS day FROM (SELECT unnest([0,1,2,3,4]) AS d))"

# -- faults and alerts -----------------------------------------------------


@query("d1_active_fault_stats", views="faults", sql="""
SELECT count(*) AS num_active, CAST(sum(CASE WHEN severity = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
       CAST(sum(CASE WHEN severity = 'Warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning,
       CAST(sum(CASE WHEN alert_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS escalated
FROM faults WHERE status <> 'Resolved'""")
def _(t: Tables):
    return incidents.active_fault_stats(t.faults)


@query("d2_mean_times", views="faults", sql="""
SELECT coalesce(round(avg(epoch(resolved_at - detected_at)) / 3600, 2), 0) AS mttr_hours,
       coalesce(round(avg(epoch(acknowledged_at - detected_at)) / 3600, 2), 0) AS mtta_hours
FROM faults WHERE status = 'Resolved'""")
def _(t: Tables):
    return incidents.mean_times(t.faults)


@query("d3_faults_per_day", views="faults", sql=f"""
WITH {_SPINE} SELECT s.day, count(f.detected_at) AS num_faults
FROM spine s LEFT JOIN faults f ON CAST(f.detected_at AS DATE) = s.day GROUP BY s.day""")
def _(t: Tables):
    return incidents.faults_per_day(t.faults, at(AS_OF_OPS))


@query("d4_resolved_per_day", views="faults", sql=f"""
WITH {_SPINE} SELECT s.day, count(f.resolved_at) AS num_resolved
FROM spine s LEFT JOIN faults f ON CAST(f.resolved_at AS DATE) = s.day AND f.status = 'Resolved' GROUP BY s.day""")
def _(t: Tables):
    return incidents.resolved_per_day(t.faults, at(AS_OF_OPS))


@query("d5_keys_per_day", views="keys_summaries", sql=f"""
WITH {_SPINE} SELECT s.day, round(coalesce(sum(k.keys_generated), 0), 4) AS keys_generated,
       round(coalesce(sum(k.keys_consumed), 0), 4) AS keys_consumed
FROM spine s LEFT JOIN keys_summaries k ON CAST(k.timestamp AS DATE) = s.day GROUP BY s.day""")
def _(t: Tables):
    days = incidents.keys_per_day(t.keys_summaries, at(AS_OF_OPS))
    return days.select("day", *[F.round(c, 4).alias(c) for c in ("keys_generated", "keys_consumed")])


@query("d6_alerts_per_day", views="alerts", sql="""
WITH spine AS (SELECT CAST(TIMESTAMP '2024-01-28' - d * INTERVAL '1' DAY AS DATE) AS day FROM (SELECT unnest([0,1,2,3,4]) AS d))
SELECT s.day, count(a.detected_at) AS total_alerts,
       CAST(sum(CASE WHEN a.type = 'Low Visibility' THEN 1 ELSE 0 END) AS BIGINT) AS low_visibility_count,
       CAST(sum(CASE WHEN a.type = 'Low Key Pool' THEN 1 ELSE 0 END) AS BIGINT) AS low_key_pool_count,
       CAST(sum(CASE WHEN a.type = 'High Photon Loss' THEN 1 ELSE 0 END) AS BIGINT) AS high_photon_loss_count,
       CAST(sum(CASE WHEN a.type = 'QBER Spike' THEN 1 ELSE 0 END) AS BIGINT) AS high_qber_count
FROM spine s LEFT JOIN alerts a ON CAST(a.detected_at AS DATE) = s.day GROUP BY s.day""")
def _(t: Tables):
    return incidents.alerts_per_day(t.alerts, at("2024-01-28 00:00:00"))


@query("d7_top_components", views="faults links nodes", sql="""
SELECT component, count(*) AS num_faults FROM (
  SELECT CASE WHEN f.component_type = 'Link' THEN l.link_id ELSE n.node_id END AS component
  FROM faults f LEFT JOIN links l ON f.component_type = 'Link' AND l.id = f.component_id
  LEFT JOIN nodes n ON f.component_type <> 'Link' AND n.id = f.component_id WHERE f.status <> 'Resolved')
GROUP BY component ORDER BY num_faults DESC, component LIMIT 3""")
def _(t: Tables):
    return incidents.top_components(t.faults, t.links, t.nodes)


@query("c5_c6_fault_list", views="faults links nodes users", sql="""
SELECT f.id, f.fault_id, f.severity, f.status, f.detected_at,
       CASE WHEN f.component_type = 'Link' THEN l.link_id ELSE n.node_id END AS component,
       coalesce(a.name, 'Not acknowledged') AS acknowledged_by_name, coalesce(r.name, 'Not resolved') AS resolved_by_name,
       coalesce(s.name, 'Not assigned') AS assigned_to_name
FROM faults f LEFT JOIN links l ON f.component_type = 'Link' AND l.id = f.component_id
LEFT JOIN nodes n ON f.component_type <> 'Link' AND n.id = f.component_id
LEFT JOIN users a ON a.uuid = f.acknowledged_by LEFT JOIN users r ON r.uuid = f.resolved_by
LEFT JOIN users s ON s.uuid = f.assigned_to""")
def _(t: Tables):
    return incidents.fault_list(t.faults, t.links, t.nodes, t.users).select(
        "id", "fault_id", "severity", "status", "detected_at", "component",
        "acknowledged_by_name", "resolved_by_name", "assigned_to_name",
    )


@query("c12_day_spine", sql=f"WITH {_SPINE} SELECT day FROM spine WHERE (SELECT count(*) FROM orders) > 0")
def _(t: Tables):
    orders = t.raw("orders")
    seen = incidents.per_day(orders, "o_orderdate", at(AS_OF_OPS), [F.count(F.lit(1)).alias("n")])
    return seen.select("day")


@query("d11_open_alert_stats", views="alerts", sql="""
SELECT count(*) AS num_alerts, CAST(sum(CASE WHEN severity = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
       CAST(sum(CASE WHEN severity = 'Warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning
FROM alerts WHERE status <> 'Resolved'""")
def _(t: Tables):
    return incidents.open_alert_stats(t.alerts)


@query("d28_alarm_summary", views="faults", sql="""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Open') AS open, count(*) FILTER (WHERE status = 'Ongoing') AS ongoing,
       count(*) FILTER (WHERE status = 'Resolved') AS resolved, count(*) FILTER (WHERE severity = 'Critical') AS critical,
       count(*) FILTER (WHERE severity = 'Warning') AS warning, count(*) FILTER (WHERE severity = 'Info') AS info,
       count(*) FILTER (WHERE severity = 'Critical' AND status <> 'Resolved') AS unresolved_critical FROM faults""")
def _(t: Tables):
    return incidents.alarm_summary(t.faults)


@query("c5_open_alerts", views="alerts links nodes", sql="""
SELECT a.id, a.type, a.severity, a.status, a.detected_at, CASE WHEN a.component_type = 'Link' THEN l.link_id ELSE n.node_id END AS component
FROM alerts a LEFT JOIN links l ON a.component_type = 'Link' AND l.id = a.component_id
LEFT JOIN nodes n ON a.component_type <> 'Link' AND n.id = a.component_id WHERE a.status <> 'Resolved'""")
def _(t: Tables):
    still = t.alerts.filter(F.col("status") != "Resolved")
    return incidents.with_component(still, t.links, t.nodes).select(
        "id", "type", "severity", "status", "detected_at", "component"
    )


# -- indicators --------------------------------------------------------------


@query("d8_network_means", views="links nodes", sql="""
SELECT round(avg(qber), 2) AS average_qber, round(avg(visibility), 2) AS average_visibility, round(avg(key_rate), 2) AS average_keyrate,
       (SELECT round(sum(key_pool_remaining), 2) FROM nodes WHERE type = 'QKD') AS key_pool_remaining,
       (SELECT count(*) FROM nodes WHERE type = 'QKD') AS number_of_nodes
FROM links WHERE link_type = 'Quantum'""")
def _(t: Tables):
    means = kpi.network_means(t.links, t.nodes)
    return means.withColumn("key_pool_remaining", F.round("key_pool_remaining", 2))


@query("d9_key_summary", views="keys_summaries", sql="""
SELECT round(g, 4) AS total_keys_generated, round(c, 4) AS total_keys_consumed, round(e, 4) AS total_keys_expired,
       CASE WHEN coalesce(g, 0) <> 0 THEN round(c / g * 100, 2) ELSE 0 END AS key_efficiency,
       CASE WHEN coalesce(g, 0) <> 0 THEN round(w / g, 2) ELSE 0 END AS weighted_avg_retention_time
FROM (SELECT sum(keys_generated) AS g, sum(keys_consumed) AS c, sum(keys_expired) AS e, sum(avg_retention_time * keys_generated) AS w
      FROM keys_summaries WHERE CAST(timestamp AS DATE) = DATE '1998-06-17')""")
def _(t: Tables):
    day = kpi.key_summary(t.keys_summaries, at(AS_OF_OPS))
    return day.withColumns({c: F.round(c, 4) for c in day.columns if c.startswith("total_")})


@query("d10_breach_counters", views="links nodes", sql="""
SELECT count(*) FILTER (WHERE qber > 8) AS qber_breaches, count(*) FILTER (WHERE visibility < 85) AS visibility_breaches,
       count(*) FILTER (WHERE photon_loss > 20) AS photon_loss_breaches, count(*) FILTER (WHERE key_rate < 15) AS key_rate_breaches,
       (SELECT count(*) FROM nodes WHERE type = 'QKD' AND key_pool_remaining < 3000) AS key_pool_remaining_breaches
FROM links WHERE link_type = 'Quantum'""")
def _(t: Tables):
    return kpi.breach_counters(t.links, t.nodes)


@query("d16_device_counts", views="nodes", sql="""
SELECT count(*) FILTER (WHERE state = 'Created') AS created, count(*) FILTER (WHERE state = 'Created' AND status = 'Online') AS online,
       count(*) FILTER (WHERE state = 'Temporary') AS temporary FROM nodes""")
def _(t: Tables):
    return kpi.device_counts(t.nodes)


@query("d32_document_totals", views="library", sql="""
SELECT count(*) AS documents, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM library WHERE status = 'active'""")
def _(t: Tables):
    return kpi.document_totals(t.library)


@query("b16_document_listing", views="library", sql="""
SELECT id, filename, chunk_count, status, round(size_bytes / 1048576.0, 2) AS size_mb FROM library WHERE status = 'active'""")
def _(t: Tables):
    return filters.document_listing(t.library)


@query("b16_document_listing_all", views="library", sql="""
SELECT id, filename, chunk_count, status, round(size_bytes / 1048576.0, 2) AS size_mb FROM library""")
def _(t: Tables):
    return filters.document_listing(t.library, active_only=False)


# -- access ------------------------------------------------------------------


@query("c7_users_with_permission", views="users roles roles_permissions permissions", sql="""
SELECT u.name, u.uuid FROM users u JOIN roles r ON u.role_id = r.id JOIN roles_permissions rp ON r.id = rp.role_id
JOIN permissions p ON rp.permission_id = p.id WHERE p.permission_name = 'fault.resolve'
AND u.status IN ('Online', 'Offline', 'Locked') AND r.role_name <> 'Super Admin'""")
def _(t: Tables):
    return access.users_with_permission(t.users, t.roles, t.roles_permissions, t.permissions, "fault.resolve")


@query("c8_permission_sets", views="users roles_permissions permissions", sql="""
SELECT u.uuid, u.name, string_agg(DISTINCT p.permission_name, ',' ORDER BY p.permission_name) AS permissions
FROM users u JOIN roles_permissions rp ON u.role_id = rp.role_id JOIN permissions p ON p.id = rp.permission_id GROUP BY u.uuid, u.name""")
def _(t: Tables):
    return access.permission_sets(t.users, t.roles_permissions, t.permissions)


@query("c9_live_sessions", views="user_sessions users", sql="""
SELECT s.session_token, s.user_id, u.name, u.status, s.expires_at FROM user_sessions s JOIN users u ON u.uuid = s.user_id
WHERE s.expires_at > TIMESTAMP '2024-01-15 12:00:00'""")
def _(t: Tables):
    return access.live_sessions(t.user_sessions, t.users, at("2024-01-15 12:00:00"))


@query("c19_pending_role_requests", views="users role_requests roles", sql="""
SELECT u.uuid, u.name, q.id AS request_id, r.role_name AS role_requested,
       CASE WHEN q.id IS NULL OR q.requested_by = 7 THEN false ELSE true END AS approval
FROM users u LEFT JOIN role_requests q ON q.assigned_to = u.uuid AND q.status = 'Pending Approval' LEFT JOIN roles r ON r.id = q.role_id""")
def _(t: Tables):
    return access.pending_role_requests(t.users, t.role_requests, t.roles, viewer=7)


@query("d12_user_stats", views="users", sql="""
SELECT count(name) AS total_users, count(*) FILTER (WHERE status = 'Locked') AS locked,
       count(*) FILTER (WHERE status = 'Deactivated') AS deactivated,
       count(*) FILTER (WHERE last_login < TIMESTAMP '1998-06-17' - INTERVAL '30' DAY) AS inactive_30_days,
       count(*) FILTER (WHERE CAST(last_login AS DATE) = DATE '1998-06-17') AS logged_in_today FROM users""")
def _(t: Tables):
    return access.user_stats(t.users, at(AS_OF_OPS))


@query("d13_role_stats", views="users roles", sql="""
SELECT r.role_name, count(u.name) AS user_count, count(*) FILTER (WHERE u.last_login >= TIMESTAMP '1998-06-10') AS active_count,
       count(*) FILTER (WHERE u.last_login IS NULL OR u.last_login < TIMESTAMP '1998-06-10') AS inactive_count
FROM users u JOIN roles r ON u.role_id = r.id WHERE r.role_name NOT IN ('Super Admin', 'System Automation') GROUP BY r.role_name""")
def _(t: Tables):
    return access.role_stats(t.users, t.roles, at(AS_OF_OPS))


@query("d14_permissions_per_role", views="roles roles_permissions permissions users", sql="""
SELECT r.role_name, count(rp.permission_id) AS permission_count, (SELECT count(*) FROM users u WHERE u.role_id = r.id) AS holders
FROM roles r JOIN roles_permissions rp ON r.id = rp.role_id JOIN permissions p ON rp.permission_id = p.id
WHERE r.role_name NOT IN ('Super Admin', 'System Automation') GROUP BY r.id, r.role_name""")
def _(t: Tables):
    rights = access.permissions_per_role(t.roles, t.roles_permissions, t.permissions)
    holders = t.users.groupBy(F.col("role_id").alias("id")).agg(F.count(F.lit(1)).alias("holders"))
    named = t.roles.join(holders, "id", "left").select("role_name", F.coalesce("holders", F.lit(0)).alias("holders"))
    return rights.join(named, "role_name")


@query("d15_c11_role_catalogue", views="roles users roles_permissions permissions", sql="""
SELECT r.id, r.role_name, coalesce(p.n, 0) AS permission_count, coalesce(u.n, 0) AS user_count, coalesce(p.names, '') AS permissions
FROM roles r LEFT JOIN (SELECT rp.role_id, count(*) AS n, string_agg(pm.permission_name, ',' ORDER BY pm.permission_name) AS names
  FROM roles_permissions rp JOIN permissions pm ON pm.id = rp.permission_id GROUP BY rp.role_id) p ON p.role_id = r.id
LEFT JOIN (SELECT role_id, count(name) AS n FROM users GROUP BY role_id) u ON u.role_id = r.id
WHERE r.role_name NOT IN ('Super Admin', 'System Automation')""")
def _(t: Tables):
    return access.role_catalogue(t.roles, t.users, t.roles_permissions, t.permissions)


@query("e12_lockouts", views="login_log", sql="""
SELECT l.user_id, count(*) AS failures, max(l.ts) AS last_failure FROM login_log l
LEFT JOIN (SELECT user_id, max(struct_pack(a := ts, b := event_id)) AS good FROM login_log WHERE success GROUP BY user_id) g USING (user_id)
WHERE NOT l.success AND (g.good IS NULL OR l.ts > g.good.a OR (l.ts = g.good.a AND l.event_id > g.good.b))
GROUP BY l.user_id HAVING count(*) >= 3""")
def _(t: Tables):
    return access.lockouts(t.login_log, limit=3)


@query("e12_failure_streaks", views="login_log", sql="""
WITH runs AS (SELECT *, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM login_log),
numbered AS (SELECT user_id, run, ts, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt,
  count(*) OVER (PARTITION BY user_id, run) AS failures FROM runs WHERE NOT success)
SELECT user_id, run, failures, ts AS locked_at FROM numbered WHERE attempt = 5""")
def _(t: Tables):
    return access.failure_streaks(t.login_log)


@query("d34_policy_detail", views="policies policy_rules policy_target nodes links", sql="""
SELECT p.id AS policy_id, p.policy_name, p.policy_type, p.scope, i.item, i.label, i.value
FROM policies p JOIN (
  SELECT policy_id, 'rule' AS item, metric AS label, value FROM policy_rules
  UNION ALL SELECT t.policy_id, 'target', coalesce(CASE WHEN t.target_type = 'Node' THEN n.node_id WHEN t.target_type = 'Link' THEN l.link_id END, 'Unknown'), NULL
  FROM policy_target t LEFT JOIN nodes n ON n.id = t.target_id AND n.type = 'QKD' LEFT JOIN links l ON l.id = t.target_id AND l.link_type = 'Quantum') i
ON i.policy_id = p.id WHERE NOT p.is_deleted""")
def _(t: Tables):
    return access.policy_detail(t.policies, t.policy_rules, t.policy_target, t.nodes, t.links)


@query("c17_rules_of_policies", views="policies policy_rules", sql="""
SELECT policy_id, metric, value, weight FROM policy_rules WHERE policy_id IN
 (SELECT id FROM policies WHERE NOT is_deleted AND policy_type = 'Weightage')""")
def _(t: Tables):
    wanted = t.policies.filter(~F.col("is_deleted") & (F.col("policy_type") == "Weightage"))
    return access.rules_of(t.policy_rules, wanted)


@query("d35_weight_check", views="policy_rules", sql="""
SELECT policy_id, round(sum(weight), 6) AS weight_sum, abs(sum(weight) - 1) <= 0.00001 AS valid FROM policy_rules GROUP BY policy_id""")
def _(t: Tables):
    return access.weight_check(t.policy_rules)


@query("h12_condition_text", views="policy_rules", sql="""
SELECT policy_id, sign, concat(metric, ' ', sign, ' ', CAST(v AS VARCHAR), ' for 30 seconds') AS clear_condition, count(*) AS n
FROM (SELECT policy_id, lower(metric) AS metric, CAST(value AS BIGINT) AS v,
      CASE WHEN metric IN ('QBER', 'Photon Loss') THEN '>' ELSE '<' END AS sign FROM policy_rules) GROUP BY ALL""")
def _(t: Tables):
    rules = t.policy_rules.select("policy_id", F.lower("metric").alias("metric"), F.col("value").cast("bigint").alias("value"))
    sign, clear = access.condition_text("metric", "value")
    return (
        rules.select("policy_id", sign.alias("sign"), clear.alias("clear_condition"))
        .groupBy("policy_id", "sign", "clear_condition")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# -- filters and logs ----------------------------------------------------------


@query("b4_b5_fault_filters", views="faults", sql="""
SELECT id, severity, status, detected_at FROM faults WHERE status IN ('Open', 'Ongoing') AND severity IN ('Critical', 'Warning')
AND detected_at BETWEEN TIMESTAMP '1998-06-10' AND TIMESTAMP '1998-06-17'""")
def _(t: Tables):
    rows = filters.multi_select(t.faults, {"status": ["Open", "Ongoing"], "severity": ["Critical", "Warning"]})
    return filters.window_preset(rows, "detected_at", "7d", at(AS_OF_OPS)).select("id", "severity", "status", "detected_at")


@query("b6_b7_session_search", views="sessions nodes", sql="""
SELECT s.session_id, s.status, a.node_id AS source_node_id, b.node_id AS destination_node_id, s.start_time
FROM sessions s JOIN nodes a ON s.source_node = a.id JOIN nodes b ON s.destination_node = b.id
WHERE (s.status ILIKE '%node_1%' OR a.node_id ILIKE '%node_1%' OR b.node_id ILIKE '%node_1%' OR s.session_id ILIKE '%node_1%')
AND s.start_time BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'""")
def _(t: Tables):
    rows = audit.session_listing(t.sessions, t.nodes)
    rows = filters.between_times(rows, "start_time", at("1997-01-01 00:00:00"), at("1998-12-31 00:00:00"))
    found = filters.contains_any(rows, "node_1", audit.SEARCH_COLUMNS["sessions"])
    return found.select("session_id", "status", "source_node_id", "destination_node_id", "start_time")


@query("b6_accent_search", sql="""
SELECT doc_id, source FROM documents WHERE contains(strip_accents(lower(text)), 'elle la')""")
def _(t: Tables):
    found = filters.contains_any(t.raw("documents"), "ELLE LA", ["text"], accents=False)
    return found.select("doc_id", "source")


@query("b8_session_page", views="sessions nodes", sql="""
SELECT s.id, s.session_id, s.status, a.node_id AS source_node_id, b.node_id AS destination_node_id
FROM sessions s JOIN nodes a ON s.source_node = a.id JOIN nodes b ON s.destination_node = b.id ORDER BY s.id DESC LIMIT 10 OFFSET 20""")
def _(t: Tables):
    rows = audit.session_listing(t.sessions, t.nodes).select(
        "id", "session_id", "status", "source_node_id", "destination_node_id"
    )
    return filters.page(rows, [F.col("id").desc()], 3, 10)


@query("b8_page_count", views="sessions", sql="SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM sessions")
def _(t: Tables):
    return filters.page_count(t.sessions, 10)


@query("b14_b15_alert_labels", views="alerts", sql="""
SELECT id, concat('FLT_', CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 3, '0') ELSE CAST(id AS VARCHAR) END) AS code,
       split_part(description, '.', 1) AS headline, strftime(detected_at, '%d-%m-%Y') AS day,
       CASE WHEN severity = 'Info' THEN 'Non Service Affecting' ELSE 'Service Affecting' END AS affecting FROM alerts""")
def _(t: Tables):
    code = F.when(F.col("severity") == "Info", "NON_SERVICE_AFFECTING").otherwise("SERVICE_AFFECTING")
    return t.alerts.select(
        "id",
        filters.padded_code("FLT_", "id").alias("code"),
        filters.first_sentence("description").alias("headline"),
        filters.day_label("detected_at").alias("day"),
        filters.title_case(code).alias("affecting"),
    )


@query("c13_policy_audit", views="audit_log policies users", sql="""
SELECT l.id, l.timestamp, l.action_type, l.outcome, coalesce(p.policy_name, 'Unknown Policy') AS policy_name, u.name AS changed_by_name
FROM audit_log l LEFT JOIN policies p ON p.id = l.policy_id LEFT JOIN users u ON u.uuid = l.performed_by""")
def _(t: Tables):
    log = audit.policy_audit(t.audit_log, t.policies, t.users)
    return log.select("id", "timestamp", "action_type", "outcome", "policy_name", "changed_by_name")


@query("c13_topology_audit", views="audit_log users links nodes", sql="""
SELECT l.id, l.timestamp, l.action_type, u.name AS performed_by_name,
       coalesce(CASE l.component_type WHEN 'Node' THEN n.node_id WHEN 'Link' THEN k.link_id END, 'Unknown Component') AS component
FROM audit_log l LEFT JOIN users u ON u.uuid = l.performed_by
LEFT JOIN nodes n ON l.component_type = 'Node' AND n.id = l.component_id
LEFT JOIN links k ON l.component_type = 'Link' AND k.id = l.component_id""")
def _(t: Tables):
    log = audit.topology_audit(t.audit_log, t.users, t.links, t.nodes)
    return log.select("id", "timestamp", "action_type", "performed_by_name", "component")


@query("c13_fault_audit", views="audit_log faults users links nodes", sql="""
SELECT l.id, l.timestamp, l.outcome, coalesce(f.fault_id, 'Unknown Fault') AS fault_code, u.name AS performed_by_name,
       CASE WHEN f.component_type = 'Link' THEN k.link_id ELSE n.node_id END AS component
FROM audit_log l LEFT JOIN faults f ON f.id = l.fault_id JOIN users u ON u.uuid = l.performed_by
LEFT JOIN links k ON f.component_type = 'Link' AND k.id = f.component_id
LEFT JOIN nodes n ON f.component_type <> 'Link' AND n.id = f.component_id""")
def _(t: Tables):
    log = audit.fault_audit(t.audit_log, t.faults, t.users, t.links, t.nodes)
    return log.select("id", "timestamp", "outcome", "fault_code", "performed_by_name", "component")


@query("c13_alert_audit", views="audit_log alerts users links nodes", sql="""
SELECT l.id, l.timestamp, l.outcome, coalesce(a.alert_id, 'Unknown Alert') AS alert_code, u.name AS performed_by_name,
       CASE WHEN a.component_type = 'Link' THEN k.link_id ELSE n.node_id END AS component
FROM audit_log l LEFT JOIN alerts a ON a.id = l.alert_id JOIN users u ON u.uuid = l.performed_by
LEFT JOIN links k ON a.component_type = 'Link' AND k.id = a.component_id
LEFT JOIN nodes n ON a.component_type <> 'Link' AND n.id = a.component_id""")
def _(t: Tables):
    log = audit.alert_audit(t.audit_log, t.alerts, t.users, t.links, t.nodes)
    return log.select("id", "timestamp", "outcome", "alert_code", "performed_by_name", "component")


@query("c13_a10_user_audit_export", views="audit_log users", sql="""
SELECT l.timestamp, l.action_type, l.outcome, l.notes, u.name AS performed_by_name FROM audit_log l JOIN users u ON u.uuid = l.performed_by
WHERE (l.action_type ILIKE '%fail%' OR u.name ILIKE '%fail%' OR l.notes ILIKE '%fail%' OR l.outcome ILIKE '%fail%')""")
def _(t: Tables):
    log = audit.user_audit(t.audit_log.select("id", "timestamp", "action_type", "performed_by", "outcome", "notes"), t.users)
    found = filters.contains_any(log, "fail", audit.SEARCH_COLUMNS["user"])
    return audit.export_view(found, "user").drop("performed_by")


@query("f1_newest_alerts", views="alerts", sql="SELECT id, detected_at, severity FROM alerts ORDER BY detected_at DESC, id DESC LIMIT 50")
def _(t: Tables):
    return filters.newest_first(t.alerts, "detected_at", "id", 50).select("id", "detected_at", "severity")


# -- topology --------------------------------------------------------------------

_SCORED = """
scored AS (SELECT l.link_id, s.node_id AS source_node_id, d.node_id AS destination_node_id,
  coalesce(c.n, 0) AS active_session_count, round(x * 100, 2) AS instability_score, round(100 - x * 100, 2) AS qlqi
FROM (SELECT *, 0.4 * least(qber / 11, 1) + 0.3 * (1 - visibility / 100) + 0.1 * greatest(1 - key_rate / 10, 0) + 0.2 * (photon_loss / 100) AS x FROM links) l
JOIN nodes s ON s.id = l.source_node JOIN nodes d ON d.id = l.destination_node
LEFT JOIN (SELECT sp.link_id, count(DISTINCT se.id) AS n FROM sessions se JOIN session_path sp ON sp.session_id = se.id
  WHERE se.status = 'Active' GROUP BY sp.link_id) c ON c.link_id = l.id WHERE l.link_type = 'Quantum')"""


def _scored(t: Tables):
    return topology.scored_links(t.links, t.nodes, t.sessions, t.session_path)


@query("c1_links_with_ends", views="links nodes", sql="""
SELECT l.link_id, l.link_type, s.node_id AS source_node_id, d.node_id AS destination_node_id
FROM links l JOIN nodes s ON s.id = l.source_node JOIN nodes d ON d.id = l.destination_node""")
def _(t: Tables):
    return topology.links_with_ends(t.links, t.nodes).select("link_id", "link_type", "source_node_id", "destination_node_id")


@query("c2_node_link_incidence", views="links nodes", sql="""
SELECT n.node_id, count(*) AS links, count(*) FILTER (WHERE l.link_type = 'Quantum') AS quantum_links
FROM nodes n JOIN links l ON l.source_node = n.id OR l.destination_node = n.id GROUP BY n.node_id""")
def _(t: Tables):
    ends = topology.incidence(t.links, "id_at").select(F.col("id_at").alias("nid"), "link_type")
    return (
        t.nodes.join(ends, F.col("id") == F.col("nid"))
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("link_type") == "Quantum").alias("quantum_links"))
    )


@query("c15_h11_new_links", views="links nodes", sql="""
WITH asked AS (SELECT event_id AS request_id, concat('NODE_', CAST(user_id AS VARCHAR)) AS source,
  concat('NODE_', CAST(event_id % 120 AS VARCHAR)) AS destination FROM events)
SELECT q.request_id, a.id AS source_node, b.id AS destination_node, CASE WHEN a.type = 'QKD' AND b.type = 'QKD' THEN 'Quantum' ELSE 'Classical' END AS link_type
FROM asked q JOIN nodes a ON a.node_id = q.source JOIN nodes b ON b.node_id = q.destination
WHERE q.source <> q.destination AND NOT EXISTS (SELECT 1 FROM links l WHERE (l.source_node = a.id AND l.destination_node = b.id)
 OR (l.source_node = b.id AND l.destination_node = a.id))""")
def _(t: Tables):
    asked = t.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("NODE_"), F.col("user_id").cast("string")).alias("source"),
        F.concat(F.lit("NODE_"), (F.col("event_id") % 120).cast("string")).alias("destination"),
    )
    return topology.new_links(asked, t.nodes, t.links)


@query("d17_session_counts", views="sessions session_path", sql="""
SELECT sp.link_id, count(DISTINCT s.id) AS active_session_count FROM sessions s JOIN session_path sp ON sp.session_id = s.id
WHERE s.status = 'Active' GROUP BY sp.link_id""")
def _(t: Tables):
    return topology.session_counts(t.sessions, t.session_path)


@query("h1_h2_scored_links", views="links nodes sessions session_path", sql=f"""
WITH {_SCORED} SELECT *, CASE WHEN qlqi < 40 THEN 'Critical' WHEN qlqi < 70 THEN 'Warning' ELSE 'Healthy' END AS severity FROM scored""")
def _(t: Tables):
    return _scored(t)


@query("d18_link_health", views="links nodes sessions session_path", sql=f"""
WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE instability_score < 30) AS total_healthy,
 count(*) FILTER (WHERE instability_score >= 30 AND instability_score < 60) AS total_warning,
 count(*) FILTER (WHERE instability_score >= 60) AS total_critical FROM scored WHERE active_session_count > 0)
SELECT *, CASE WHEN total_critical > 0 THEN concat(CAST(total_critical AS VARCHAR), ' Critical')
 WHEN total_warning > 0 THEN concat(CAST(total_warning AS VARCHAR), ' Warning')
 WHEN total_healthy > 0 THEN 'All Links Healthy' ELSE 'No Links Found' END AS headline FROM c""")
def _(t: Tables):
    return topology.link_health(_scored(t))


@query("f2_most_degraded_links", views="links nodes sessions session_path", sql=f"""
WITH {_SCORED} SELECT link_id, instability_score, qlqi FROM scored ORDER BY instability_score DESC, link_id LIMIT 5""")
def _(t: Tables):
    return topology.most_degraded(_scored(t)).select("link_id", "instability_score", "qlqi")


@query("d19_failed_sessions", views="sessions", sql="SELECT count(*) AS blocked_sessions FROM sessions WHERE status = 'Failed'")
def _(t: Tables):
    return topology.failed_sessions(t.sessions)


_WALK = """
steps AS (SELECT sp.session_id, row_number() OVER (PARTITION BY sp.session_id ORDER BY sp.step_order) AS i, sp.step_order, l.source_node AS s, l.destination_node AS d
  FROM session_path sp JOIN links l ON l.id = sp.link_id {filter}),
walk AS (SELECT st.session_id, st.i, st.step_order, {start} AS from_node, CASE WHEN st.s = {start} THEN st.d ELSE st.s END AS to_node
  FROM steps st {join} WHERE st.i = 1
  UNION ALL SELECT st.session_id, st.i, st.step_order, w.to_node, CASE WHEN st.s = w.to_node THEN st.d ELSE st.s END
  FROM walk w JOIN steps st ON st.session_id = w.session_id AND st.i = w.i + 1)"""
_FROM_SESSION = _WALK.format(start="se.source_node", join="JOIN sessions se ON se.id = st.session_id", filter="")
_FROM_FIRST = _WALK.format(
    start="st.s", join="", filter="JOIN sessions se ON se.id = sp.session_id AND se.status = 'Active'"
)


@query("e7_path_hops", views="links sessions session_path", sql=f"""
WITH RECURSIVE {_FROM_SESSION} SELECT session_id, step_order, from_node, to_node FROM walk""")
def _(t: Tables):
    steps = topology.session_steps(t.session_path, t.links)
    starts = t.sessions.select(F.col("id").alias("session_id"), F.col("source_node").alias("start_node"))
    return topology.path_hops(steps, starts).drop("_bucket")


@query("e7_session_page_paths", views="links sessions session_path nodes", sql=f"""
WITH RECURSIVE {_FROM_SESSION},
page AS (SELECT id FROM sessions ORDER BY id DESC LIMIT 10),
places AS (SELECT session_id, i AS position, to_node AS node FROM walk UNION ALL SELECT session_id, 0, from_node FROM walk WHERE i = 1)
SELECT p.session_id, string_agg(n.node_id, ' > ' ORDER BY p.position) AS path FROM places p JOIN page ON page.id = p.session_id
JOIN nodes n ON n.id = p.node GROUP BY p.session_id""")
def _(t: Tables):
    page = filters.page(t.sessions, [F.col("id").desc()], 1, 10)
    steps = topology.session_steps(t.session_path, t.links, page)
    starts = page.select(F.col("id").alias("session_id"), F.col("source_node").alias("start_node"))
    return topology.path_text(topology.path_hops(steps, starts), t.nodes)


@query("e8_busiest_segments", views="links sessions session_path nodes", sql=f"""
WITH RECURSIVE {_FROM_FIRST},
runs AS (SELECT DISTINCT b.session_id, list_sort([a.from_node, b.from_node, b.to_node]) AS seg FROM walk a JOIN walk b ON b.session_id = a.session_id AND b.i = a.i + 1),
top AS (SELECT seg, count(*) AS num_sessions FROM runs GROUP BY seg ORDER BY num_sessions DESC, seg LIMIT 3)
SELECT a.node_id AS node_1, b.node_id AS node_2, c.node_id AS node_3, num_sessions FROM top
JOIN nodes a ON a.id = seg[1] JOIN nodes b ON b.id = seg[2] JOIN nodes c ON c.id = seg[3]""")
def _(t: Tables):
    active = t.sessions.filter(F.col("status") == "Active")
    steps = topology.session_steps(t.session_path, t.links, active)
    return topology.busiest_segments(topology.path_hops(steps), t.nodes)
