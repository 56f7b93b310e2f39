"""Registered queries: controller payloads, request mining, state-changing jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.operators import alarms, history, lifecycle, mining, transitions
from photonwatch.operators.filters import display_time, title_case
from photonwatch.plans.fixtures import AS_OF_TELE, Tables, at
from photonwatch.plans.registry import query

# -- nested payloads built from the event stream -----------------------------------

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _alarm_payloads(t: Tables) -> DataFrame:
    k, value, user = F.col("event_id"), F.col("value"), F.col("user_id")
    severity = (
        F.when(value > 60, "CRITICAL").when(value > 40, "MAJOR").when(value > 20, "MINOR").when(value > 10, "WARNING").otherwise("INFO")
    )
    fields = {
        "alarm-id": k.cast("string"),
        "device-name": F.concat(F.lit("C01-S32-"), F.lpad((user % 20).cast("string"), 2, "0")),
        "device-type": F.when(user % 3 == 0, "6500").when(user % 3 == 1, "5164").otherwise("NMS"),
        "ip-address": F.concat(F.lit("10.0.0."), (user % 20).cast("string")),
        "condition-severity": severity,
        "state": F.when(k % 3 == 0, "CLEARED").otherwise("ACTIVE"),
        "native-condition-type": F.col("event_type"),
        "native-condition-type-qualifier": F.when(k % 2 == 0, F.concat(F.lit("Condition "), F.col("event_type"))),
        "service-affecting": F.when(k % 4 == 0, "SERVICE_AFFECTING").otherwise("NON_SERVICE_AFFECTING"),
        "acknowledge-state": F.when(k % 5 != 0, "NOT_ACKNOWLEDGED"),
        "last-raise-time": F.date_format("ts", _ISO),
        "number-of-occurrences": (k % 7).cast("string"),
    }
    attributes = F.struct(*[column.alias(name) for name, column in fields.items()])
    payload = F.struct(F.array(F.struct(attributes.alias("attributes"))).alias("data"))
    return t.raw("events").select(F.to_json(payload).alias("payload"))


def _alarms(t: Tables) -> DataFrame:
    return alarms.alarms(_alarm_payloads(t))


_ALARMS = """
alarms AS (SELECT CAST(event_id AS VARCHAR) AS alarm_id, concat('C01-S32-', lpad(CAST(user_id % 20 AS VARCHAR), 2, '0')) AS device_name,
 CASE user_id % 3 WHEN 0 THEN '6500' WHEN 1 THEN '5164' ELSE 'NMS' END AS device_type, concat('10.0.0.', CAST(user_id % 20 AS VARCHAR)) AS ip_address,
 CASE WHEN value > 60 THEN 'CRITICAL' WHEN value > 40 THEN 'MAJOR' WHEN value > 20 THEN 'MINOR' WHEN value > 10 THEN 'WARNING' ELSE 'INFO' END AS severity,
 CASE WHEN event_id % 3 = 0 THEN 'CLEARED' ELSE 'ACTIVE' END AS state, event_type AS condition,
 CASE WHEN event_id % 2 = 0 THEN concat('Condition ', event_type) END AS qualifier,
 CASE WHEN event_id % 4 = 0 THEN 'SERVICE_AFFECTING' ELSE 'NON_SERVICE_AFFECTING' END AS service_affecting,
 CASE WHEN event_id % 5 <> 0 THEN 'NOT_ACKNOWLEDGED' ELSE 'Unknown' END AS acknowledge_state,
 date_trunc('millisecond', ts) AS last_raise_time, event_id % 7 AS occurrences FROM events)"""
_ALARM_COLUMNS = ["alarm_id", "device_name", "device_type", "ip_address", "severity", "state", "condition", "qualifier", "acknowledge_state", "last_raise_time", "occurrences"]


@query("a9_alarms", sql=f"WITH {_ALARMS} SELECT {', '.join(_ALARM_COLUMNS)} FROM alarms")
def _(t: Tables):
    return _alarms(t).select(*_ALARM_COLUMNS)


@query("b15_alarm_labels", sql=f"""
WITH {_ALARMS} SELECT alarm_id, CASE WHEN service_affecting = 'SERVICE_AFFECTING' THEN 'Service Affecting' ELSE 'Non Service Affecting' END AS affecting,
 CASE WHEN acknowledge_state = 'NOT_ACKNOWLEDGED' THEN 'Not Acknowledged' ELSE 'Unknown' END AS acknowledged, strftime(last_raise_time, '%b %d, %Y %H:%M:%S') AS raised FROM alarms""")
def _(t: Tables):
    return _alarms(t).select(
        "alarm_id",
        title_case("service_affecting").alias("affecting"),
        title_case("acknowledge_state").alias("acknowledged"),
        display_time(F.date_format("last_raise_time", _ISO)).alias("raised"),
    )


@query("b12_alarm_filters", sql=f"""
WITH {_ALARMS} SELECT alarm_id, device_name, severity, last_raise_time FROM alarms WHERE state = 'ACTIVE' AND severity IN ('CRITICAL', 'MAJOR')
 AND device_type IN ('6500', 'NMS') AND service_affecting = 'NON_SERVICE_AFFECTING' AND last_raise_time >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR""")
def _(t: Tables):
    kept = alarms.filtered(
        _alarms(t), state=["ACTIVE"], severity=["CRITICAL", "MAJOR"], device_type=["6500", "NMS"],
        service_affecting=False, hours_ago=240, as_of=at(AS_OF_TELE),
    )
    return kept.select("alarm_id", "device_name", "severity", "last_raise_time")


@query("b12_f4_sorted_page", sql=f"""
WITH {_ALARMS} SELECT alarm_id, severity, last_raise_time FROM alarms WHERE severity = 'CRITICAL' AND device_name = 'C01-S32-07' ORDER BY last_raise_time DESC, alarm_id LIMIT 20""")
def _(t: Tables):
    found = alarms.find_alarms(_alarms(t), severity=["CRITICAL"], device_name="C01-S32-07", sort="-last-raise-time")
    return found.select("alarm_id", "severity", "last_raise_time")


@query("d29_severity_counts", sql=f"""
WITH {_ALARMS} SELECT severity, count(*) AS alarms, CAST(list_position(['CRITICAL', 'MAJOR', 'MINOR', 'WARNING', 'INFO'], severity) AS INTEGER) AS place FROM alarms GROUP BY severity""")
def _(t: Tables):
    return alarms.severity_counts(_alarms(t))


@query("d29_busiest_devices", sql=f"""
WITH {_ALARMS} SELECT device_name, count(*) AS alarms FROM alarms GROUP BY 1 ORDER BY alarms DESC, device_name LIMIT 3""")
def _(t: Tables):
    return alarms.busiest_devices(_alarms(t))


@query("d29_recent_alarms", sql=f"""
WITH {_ALARMS} SELECT alarm_id, severity, coalesce(qualifier, condition) AS condition, device_name, strftime(last_raise_time, '%b %d %H:%M') AS raised
FROM alarms ORDER BY last_raise_time DESC, alarm_id LIMIT 5""")
def _(t: Tables):
    return alarms.recent_alarms(_alarms(t))


def _service_payloads(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    endpoint = [
        F.struct(F.concat(F.lit("N"), (k % 50 + i).cast("string")).alias("node"), F.lit(str(3 + i)).alias("port"), F.lit(role).alias("role"))
        for i, role in enumerate(["A", "Z"])
    ]
    properties = F.struct(
        F.when(k % 6 != 0, F.concat(F.lit("svc"), k.cast("string"))).alias("name"),
        F.when(k % 4 == 0, "EPL").when(k % 4 == 1, "EVPL").when(k % 4 == 2, "WAVE").alias("serviceType"),
        F.col("o_orderpriority").alias("customerName"),
        F.array(*endpoint).alias("endpoints"),
    )
    item = F.struct(
        k.cast("string").alias("id"),
        F.concat(F.lit("label"), k.cast("string")).alias("label"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("requested").alias("orchState"),
        F.concat(F.lit("P"), (k % 11).cast("string")).alias("productId"),
        properties.alias("properties"),
    )
    return t.raw("orders").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))


def _services(t: Tables) -> DataFrame:
    return alarms.services(_service_payloads(t))


_SERVICES = """
services AS (SELECT CAST(o_orderkey AS VARCHAR) AS service_id, CASE o_orderkey % 4 WHEN 0 THEN 'EPL' WHEN 1 THEN 'EVPL' WHEN 2 THEN 'WAVE' ELSE 'Unknown' END AS service_type,
 concat(CASE WHEN o_orderkey % 6 <> 0 THEN 'svc' ELSE 'label' END, CAST(o_orderkey AS VARCHAR)) AS name,
 CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'requested' END AS state, concat('P', CAST(o_orderkey % 11 AS VARCHAR)) AS product_id FROM orders)"""


@query("a9_services", sql=f"WITH {_SERVICES} SELECT service_id, service_type, name, state, product_id FROM services")
def _(t: Tables):
    return _services(t).drop("endpoints")


@query("a9_service_endpoints", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS service_id, concat('N', CAST(o_orderkey % 50 + i AS VARCHAR)) AS node, CAST(3 + i AS VARCHAR) AS port,
 CASE i WHEN 0 THEN 'A' ELSE 'Z' END AS role FROM orders, (SELECT unnest([0, 1]) AS i)""")
def _(t: Tables):
    return alarms.service_endpoints(_services(t))


@query("d30_service_inventory", sql=f"WITH {_SERVICES} SELECT service_type, count(*) AS services FROM services GROUP BY 1")
def _(t: Tables):
    return alarms.service_inventory(_services(t))


@query("d30_e9_first_services", sql=f"""
WITH {_SERVICES} SELECT service_id, service_type, name, CAST(r AS INTEGER) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY service_type ORDER BY CAST(service_id AS BIGINT)) AS r FROM services) WHERE r <= 10""")
def _(t: Tables):
    return alarms.first_services(_services(t)).select("service_id", "service_type", "name", "rank")


@query("d31_product_ids", sql=f"WITH {_SERVICES} SELECT product_id, count(*) AS services FROM services WHERE service_type = 'EPL' GROUP BY 1")
def _(t: Tables):
    return alarms.product_ids(_services(t))


@query("e11_state_changes", views="service_log", sql="""
SELECT service_id, event_id, state, CAST(floor(epoch_us(ts) / 1000000.0 - epoch_us(begin) / 1000000.0) AS BIGINT) AS elapsed, state IN ('active', 'failed') AS terminal FROM
 (SELECT *, lag(state) OVER (PARTITION BY service_id ORDER BY ts, event_id) AS before, min(ts) OVER (PARTITION BY service_id) AS begin FROM service_log)
WHERE before IS DISTINCT FROM state""")
def _(t: Tables):
    return alarms.state_changes(t.service_log)


@query("e11_provisioning_outcome", views="service_log", sql="""
WITH w AS (SELECT *, min(ts) OVER (PARTITION BY service_id) AS begin FROM service_log),
c AS (SELECT * FROM w WHERE epoch_us(ts) - epoch_us(begin) < 86400000000)
SELECT service_id, arg_max(state, struct_pack(a := ts, b := event_id)) AS last_state,
 coalesce(arg_min(state, struct_pack(a := ts, b := event_id)) FILTER (WHERE state IN ('active', 'failed')), 'timeout') AS outcome FROM c GROUP BY 1""")
def _(t: Tables):
    return alarms.provisioning_outcome(t.service_log, max_wait=86400)


@query("e14_last_exchanges", sql="""
SELECT conv_id, turn, role, text FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2 DESC) AS r FROM conversations) WHERE r <= 3""")
def _(t: Tables):
    return history.last_exchanges(t.raw("conversations"))


# -- request mining ------------------------------------------------------------------


def _messages(t: Tables) -> DataFrame:
    k, user = F.col("event_id"), F.col("user_id")
    n = (user % 20).cast("string")
    kinds = [
        F.concat(F.lit("help me retrieve alarm with id "), k.cast("string")),
        F.concat(F.lit("show Critical and MAJOR alarms, top "), n),
        F.concat(F.lit("get alarms for device C01-S32-"), F.lpad(n, 2, "0")),
        F.lit("service affecting alarms from 6500 devices"),
        F.concat(F.lit("non-service affecting alarms from last "), n, F.lit(" hours")),
        F.lit("latest waveserver ai alarms from today"),
        F.concat(F.lit("cleared warning alarms on 10.0.0."), n, F.lit(" yesterday")),
        F.concat(F.lit("oldest NMS info alarms, limit "), n),
    ]
    text = kinds[-1]
    for i, kind in reversed(list(enumerate(kinds[:-1]))):
        text = F.when(k % len(kinds) == i, kind).otherwise(text)
    return t.raw("events").select(k.alias("message_id"), text.alias("message"))


_MINED = """
m AS (SELECT event_id AS message_id, event_id % 8 AS kind, user_id % 20 AS n, CAST(event_id AS VARCHAR) AS k, CAST(user_id % 20 AS VARCHAR) AS s FROM events),
parsed AS (SELECT message_id, CASE WHEN kind = 0 THEN k END AS alarm_id,
 CASE kind WHEN 1 THEN 'CRITICAL,MAJOR' WHEN 6 THEN 'WARNING' WHEN 7 THEN 'INFO' END AS severity,
 CASE WHEN kind = 0 THEN NULL WHEN kind = 6 THEN 'CLEARED' ELSE 'ACTIVE' END AS state,
 CASE WHEN kind = 2 THEN concat('C01-S32-', lpad(s, 2, '0')) END AS device_name,
 CASE kind WHEN 3 THEN '6500' WHEN 5 THEN 'WAVESERVER AI' WHEN 7 THEN 'NMS' END AS device_type,
 CASE WHEN kind = 6 THEN concat('10.0.0.', s) END AS ip_address,
 CASE kind WHEN 3 THEN true WHEN 4 THEN false END AS service_affecting,
 CAST(CASE kind WHEN 4 THEN n WHEN 5 THEN 24 WHEN 6 THEN 48 END AS INTEGER) AS hours_ago,
 CASE kind WHEN 5 THEN '-last-raise-time' WHEN 7 THEN 'last-raise-time' END AS sort,
 CAST(CASE kind WHEN 1 THEN n WHEN 4 THEN n WHEN 7 THEN n END AS INTEGER) AS page_size FROM m)"""


@query("k9_alarm_requests", sql=f"WITH {_MINED} SELECT * FROM parsed")
def _(t: Tables):
    return mining.alarm_requests(_messages(t))


@query("k9_request_summary", sql=f"""
WITH {_MINED} SELECT count(*) AS requests, count(alarm_id) AS alarm_id, count(severity) AS severity, count(device_name) AS device_name, count(device_type) AS device_type,
 count(ip_address) AS ip_address, count(service_affecting) AS service_affecting, count(hours_ago) AS hours_ago, count(sort) AS sort, count(page_size) AS page_size FROM parsed""")
def _(t: Tables):
    return mining.request_summary(mining.alarm_requests(_messages(t)))


@query("k10_circuit_requests", sql="""
WITH m AS (SELECT event_id AS message_id, event_id % 5 AS kind, concat('C01-5164-', lpad(CAST(user_id % 30 AS VARCHAR), 2, '0')) AS a,
 concat('C02-5164-', lpad(CAST(event_id % 30 AS VARCHAR), 2, '0')) AS z, CAST(user_id % 60 AS INTEGER) AS pa, CAST(event_id % 50 AS INTEGER) AS pz FROM events),
p AS (SELECT message_id, CASE WHEN kind = 4 THEN NULL ELSE a END AS endpoint_a, CASE WHEN kind IN (2, 4) THEN 3 ELSE pa END AS port_a,
 CASE WHEN kind = 4 THEN NULL ELSE z END AS endpoint_z, CASE WHEN kind IN (2, 4) THEN 3 ELSE pz END AS port_z FROM m)
SELECT *, CASE WHEN endpoint_a IS NULL THEN 'Could not identify endpoints' WHEN port_a NOT BETWEEN 1 AND 48 THEN concat('Port ', CAST(port_a AS VARCHAR), ' out of range (1-48)')
 WHEN port_z NOT BETWEEN 1 AND 48 THEN concat('Port ', CAST(port_z AS VARCHAR), ' out of range (1-48)') END AS error FROM p""")
def _(t: Tables):
    k, user = F.col("event_id"), F.col("user_id")
    a = F.concat(F.lit("C01-5164-"), F.lpad((user % 30).cast("string"), 2, "0"))
    z = F.concat(F.lit("C02-5164-"), F.lpad((k % 30).cast("string"), 2, "0"))
    pa, pz = (user % 60).cast("string"), (k % 50).cast("string")
    kinds = [
        F.concat(F.lit("create circuit between "), a, F.lit(" port "), pa, F.lit(" and "), z, F.lit(" port "), pz),
        F.concat(F.lit("provision eline from "), a, F.lit(":"), pa, F.lit(" to "), z, F.lit(":"), pz),
        F.concat(F.lit("establish link between "), a, F.lit(" and "), z),
        F.concat(F.lit("provision circuit from node "), a, F.lit(" port "), pa, F.lit(" to node "), z, F.lit(" port "), pz),
        F.lit("connect the two sites"),
    ]
    text = kinds[-1]
    for i, kind in reversed(list(enumerate(kinds[:-1]))):
        text = F.when(k % len(kinds) == i, kind).otherwise(text)
    return mining.circuit_requests(t.raw("events").select(k.alias("message_id"), text.alias("message")))


# -- state-changing jobs ---------------------------------------------------------------


def _fault_requests(t: Tables) -> DataFrame:
    k = F.col("event_id")
    number = (k * 7 % 16000).cast("string")
    return t.raw("events").select(
        k.alias("request_id"),
        F.concat(F.lit("FLT_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("fault_id"),
        F.col("user_id").alias("actor"),
        (k % 1500 + 1).alias("assignee"),
        F.concat(F.lit("note "), k.cast("string")).alias("notes"),
        F.col("ts").alias("requested_at"),
    )


_FAULT_REQUESTS = """
req AS (SELECT event_id AS request_id, concat('FLT_', CASE WHEN event_id * 7 % 16000 < 100 THEN lpad(CAST(event_id * 7 % 16000 AS VARCHAR), 3, '0') ELSE CAST(event_id * 7 % 16000 AS VARCHAR) END) AS fault_id,
 user_id AS actor, event_id % 1500 + 1 AS assignee, concat('note ', CAST(event_id AS VARCHAR)) AS notes, ts AS requested_at FROM events)"""
_ACK = f"""{_FAULT_REQUESTS},
holders AS (SELECT u.uuid, p.permission_name FROM users u JOIN roles r ON u.role_id = r.id AND r.role_name <> 'Super Admin' JOIN roles_permissions rp ON rp.role_id = r.id
 JOIN permissions p ON p.id = rp.permission_id WHERE u.status IN ('Online', 'Offline', 'Locked')),
first_look AS (SELECT q.*, CASE WHEN f.status IS NULL THEN 'Fault does not exist' WHEN f.status <> 'Open' THEN 'You can only acknowledge an open fault'
 WHEN q.actor NOT IN (SELECT uuid FROM holders WHERE permission_name = 'fault.acknowledge') THEN 'You do not have permission to acknowledge faults'
 WHEN q.assignee NOT IN (SELECT uuid FROM holders WHERE permission_name = 'fault.resolve') THEN 'The assignee does not have permission to resolve faults' END AS why
 FROM req q LEFT JOIN faults f ON f.fault_id = q.fault_id),
judged AS (SELECT *, CASE WHEN coalesce(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY fault_id ORDER BY requested_at, request_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'You can only acknowledge an open fault' ELSE why END AS reason FROM first_look)"""
_ACK_VIEWS = "faults users roles roles_permissions permissions"


def _acknowledged(t: Tables) -> transitions.Outcome:
    return transitions.acknowledge_faults(_fault_requests(t), t.faults, t.users, t.roles, t.roles_permissions, t.permissions)


@query("l1_acknowledge_log", views=_ACK_VIEWS, sql=f"""
WITH {_ACK} SELECT request_id, requested_at AS timestamp, 'Acknowledged' AS action_type, fault_id, actor AS performed_by,
 CASE WHEN reason IS NULL THEN 'Success' ELSE 'Failed' END AS outcome, coalesce(reason, notes) AS notes FROM judged""")
def _(t: Tables):
    return _acknowledged(t).log


@query("l1_acknowledged_faults", views=_ACK_VIEWS, sql=f"""
WITH {_ACK} SELECT f.id, f.fault_id, CASE WHEN j.fault_id IS NULL THEN f.status ELSE 'Ongoing' END AS status, coalesce(j.requested_at, f.acknowledged_at) AS acknowledged_at,
 coalesce(j.actor, f.acknowledged_by) AS acknowledged_by, coalesce(j.assignee, f.assigned_to) AS assigned_to
FROM faults f LEFT JOIN judged j ON j.fault_id = f.fault_id AND j.reason IS NULL""")
def _(t: Tables):
    return _acknowledged(t).table.select("id", "fault_id", "status", "acknowledged_at", "acknowledged_by", "assigned_to")


def _resolve_requests(t: Tables) -> DataFrame:
    """Every user who owns a fault asks to resolve it; some forms are incomplete, some ask twice."""
    k = F.col("id")
    forms = t.faults.select(
        "fault_id",
        k.alias("request_id"),
        F.when(k % 4 == 0, 1).otherwise(F.coalesce("assigned_to", F.lit(1))).alias("actor"),
        (k % 13 != 0).alias("confirmed"),
        F.when(k % 17 != 0, F.lit("cleared")).alias("clearing_condition"),
        F.when(k % 19 != 0, F.repeat(F.lit("x"), F.when(k % 23 == 0, 300).otherwise(20).cast("int"))).alias("remediation"),
        F.col("detected_at").alias("requested_at"),
    )
    again = forms.filter(F.col("request_id") % 3 == 0).withColumn("request_id", F.col("request_id") + 1_000_000_000)
    return forms.unionByName(again)


_RESOLVE = """
forms AS (SELECT fault_id, id AS request_id, CASE WHEN id % 4 = 0 THEN 1 ELSE coalesce(assigned_to, 1) END AS actor, id % 13 <> 0 AS confirmed, id % 17 <> 0 AS has_clear,
 CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN 300 ELSE 20 END AS rem, detected_at AS requested_at, status, assigned_to, alert_id FROM faults),
req AS (SELECT * FROM forms UNION ALL SELECT * REPLACE (request_id + 1000000000 AS request_id) FROM forms WHERE request_id % 3 = 0),
early AS (SELECT *, CASE WHEN NOT confirmed THEN 'Failed to acknowledge the fault.' WHEN NOT has_clear THEN 'Failed to provide clearing condition'
 WHEN rem IS NULL THEN 'Failed to provide remediation' WHEN rem > 255 THEN 'Remediation must be less than 255 characters.' END AS form_error FROM req),
first_look AS (SELECT *, coalesce(form_error, CASE WHEN status <> 'Ongoing' THEN 'Attempt to resolve a fault that is not ongoing.'
 WHEN assigned_to IS DISTINCT FROM actor THEN 'Unauthorised attempt to resolve a fault not assigned to the user.' END) AS why FROM early),
judged AS (SELECT *, CASE WHEN form_error IS NULL AND coalesce(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY fault_id ORDER BY requested_at, request_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'Attempt to resolve a fault that is not ongoing.' ELSE why END AS reason FROM first_look)"""


@query("l2_resolve_log", views="faults", sql=f"""
WITH {_RESOLVE} SELECT request_id, fault_id, actor AS performed_by, CASE WHEN reason IS NULL THEN 'Success' ELSE 'Failed' END AS outcome,
 coalesce(reason, concat('Resolved the fault ', fault_id, ' successfully.')) AS notes FROM judged""")
def _(t: Tables):
    faults, _ = transitions.resolve_faults(_resolve_requests(t), t.faults, t.alerts)
    return faults.log.select("request_id", "fault_id", "performed_by", "outcome", "notes")


@query("l2_resolved_faults", views="faults", sql=f"""
WITH {_RESOLVE} SELECT f.id, CASE WHEN j.fault_id IS NULL THEN f.status ELSE 'Resolved' END AS status, coalesce(j.requested_at, f.resolved_at) AS resolved_at,
 coalesce(j.actor, f.resolved_by) AS resolved_by FROM faults f LEFT JOIN judged j ON j.fault_id = f.fault_id AND j.reason IS NULL""")
def _(t: Tables):
    faults, _ = transitions.resolve_faults(_resolve_requests(t), t.faults, t.alerts)
    return faults.table.select("id", "status", "resolved_at", "resolved_by")


@query("l2_cascaded_alerts", views="faults alerts", sql=f"""
WITH {_RESOLVE} SELECT a.id, CASE WHEN a.id IN (SELECT alert_id FROM judged WHERE reason IS NULL AND alert_id IS NOT NULL) THEN 'Resolved' ELSE a.status END AS status FROM alerts a""")
def _(t: Tables):
    _, alerts = transitions.resolve_faults(_resolve_requests(t), t.faults, t.alerts)
    return alerts.table.select("id", "status")


def _escalations(t: Tables):
    k = F.col("event_id")
    asked = t.raw("events").select(
        k.alias("request_id"),
        F.concat(F.lit("ALR_"), F.floor(k / 2).cast("string")).alias("alert_id"),
        F.col("user_id").alias("actor"),
        F.col("ts").alias("requested_at"),
    )
    return transitions.escalate_alerts(asked, t.alerts, t.faults)


_ESCALATE = """
req AS (SELECT event_id AS request_id, concat('ALR_', CAST(event_id // 2 AS VARCHAR)) AS alert_id, user_id AS actor, ts AS requested_at FROM events),
first_look AS (SELECT q.*, CASE WHEN a.status IS NULL THEN 'Attempt to escalate a non-existent alert.' WHEN a.status = 'Escalated' THEN 'Attempt to escalate an alert that has been escalated already.'
 WHEN a.status = 'Resolved' THEN 'Attempt to escalate a resolved alert.' WHEN a.severity = 'Info' THEN 'Attempt to escalate an info alert.' END AS why FROM req q LEFT JOIN alerts a ON a.alert_id = q.alert_id),
judged AS (SELECT *, CASE WHEN coalesce(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY alert_id ORDER BY requested_at, request_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'Attempt to escalate an alert that has been escalated already.' ELSE why END AS reason FROM first_look)"""


@query("l3_escalation_log", views="alerts", sql=f"""
WITH {_ESCALATE} SELECT request_id, alert_id, actor AS performed_by, CASE WHEN reason IS NULL THEN 'Success' ELSE 'Failed' END AS outcome,
 coalesce(reason, 'Alert has been escalated to a fault successfully.') AS notes FROM judged""")
def _(t: Tables):
    return _escalations(t)[0].log.select("request_id", "alert_id", "performed_by", "outcome", "notes")


@query("l3_escalated_alerts", views="alerts", sql=f"""
WITH {_ESCALATE} SELECT a.id, CASE WHEN j.alert_id IS NOT NULL THEN 'Escalated' ELSE a.status END AS status,
 j.actor AS performed_by, j.requested_at AS escalated_at FROM alerts a
LEFT JOIN judged j ON j.alert_id = a.alert_id AND j.reason IS NULL""")
def _(t: Tables):
    return _escalations(t)[0].table.select("id", "status", "performed_by", "escalated_at")


@query("l3_new_faults", views="alerts faults", sql=f"""
WITH {_ESCALATE}, n AS (SELECT a.*, row_number() OVER (ORDER BY j.requested_at, j.request_id) + (SELECT max(id) FROM faults) AS new_id
 FROM judged j JOIN alerts a ON a.alert_id = j.alert_id WHERE j.reason IS NULL)
SELECT new_id AS id, concat('FLT_', CASE WHEN new_id < 100 THEN lpad(CAST(new_id AS VARCHAR), 3, '0') ELSE CAST(new_id AS VARCHAR) END) AS fault_id, component_type, component_id, severity,
 'Open' AS status, detected_at, split_part(description, '.', 1) AS description, id AS alert_id, 'Escalated from Alert' AS raising_condition FROM n""")
def _(t: Tables):
    return _escalations(t)[1]


def _mixed_requests(t: Tables) -> DataFrame:
    """Five requests on every fault in the order of their events: two acknowledge, two resolve, one escalates the alert it came from."""
    k, of = F.col("event_id"), F.floor(F.col("event_id") / 5)
    number = (of * 7 % 16000).cast("string")
    kind = F.when(k % 5 < 2, "acknowledge").when(k % 5 < 4, "resolve").otherwise("escalate")
    rows = t.raw("events").select(
        k.alias("request_id"), kind.alias("kind"), F.concat(F.lit("FLT_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("fault_id"),
        "user_id", (of % 1500 + 1).alias("assignee"), F.concat(F.lit("note "), k.cast("string")).alias("notes"), (k % 13 != 0).alias("confirmed"),
        F.when(k % 17 != 0, F.lit("cleared")).alias("clearing_condition"),
        F.when(k % 19 != 0, F.repeat(F.lit("x"), F.when(k % 23 == 0, 300).otherwise(20).cast("int"))).alias("remediation"), F.col("ts").alias("requested_at"),
    )
    known = t.faults.select("fault_id", F.col("assigned_to").alias("_owner"), F.col("alert_id").alias("_alert"))
    actor = F.when(k % 5 == 2, F.col("assignee")).when(k % 5 == 3, F.coalesce("_owner", "user_id")).otherwise(F.col("user_id"))
    rows = rows.withColumn("event_id", F.col("request_id")).join(known, "fault_id", "left")
    return rows.withColumns({"actor": actor, "alert": F.coalesce("_alert", F.col("request_id"))}).drop("event_id", "user_id", "_owner", "_alert")


_MIXED = """
raw AS (SELECT *, event_id // 5 AS part FROM events),
req AS (SELECT event_id AS request_id, CASE WHEN event_id % 5 < 2 THEN 'acknowledge' WHEN event_id % 5 < 4 THEN 'resolve' ELSE 'escalate' END AS kind,
 concat('FLT_', CASE WHEN part * 7 % 16000 < 100 THEN lpad(CAST(part * 7 % 16000 AS VARCHAR), 3, '0') ELSE CAST(part * 7 % 16000 AS VARCHAR) END) AS fault_id,
 user_id, part % 1500 + 1 AS assignee, concat('note ', CAST(event_id AS VARCHAR)) AS notes, event_id % 13 <> 0 AS confirmed, event_id % 17 <> 0 AS has_clear,
 CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 300 ELSE 20 END AS rem, ts AS requested_at FROM raw),
full_req AS (SELECT q.*, f.status AS fault_status, f.assigned_to AS fault_owner, f.alert_id AS fault_alert, coalesce(f.alert_id, q.request_id) AS alert,
 CASE WHEN request_id % 5 = 2 THEN assignee WHEN request_id % 5 = 3 THEN coalesce(f.assigned_to, user_id) ELSE user_id END AS actor FROM req q LEFT JOIN faults f USING (fault_id)),
holders AS (SELECT u.uuid, p.permission_name FROM users u JOIN roles r ON u.role_id = r.id AND r.role_name <> 'Super Admin' JOIN roles_permissions rp ON rp.role_id = r.id
 JOIN permissions p ON p.id = rp.permission_id WHERE u.status IN ('Online', 'Offline', 'Locked')),
steps AS (SELECT *, actor IN (SELECT uuid FROM holders WHERE permission_name = 'fault.acknowledge') AS may_ack, assignee IN (SELECT uuid FROM holders WHERE permission_name = 'fault.resolve') AS may_own,
 row_number() OVER (PARTITION BY fault_id ORDER BY requested_at, request_id) AS n FROM full_req WHERE kind <> 'escalate'),
walk AS (SELECT DISTINCT fault_id, CAST(0 AS BIGINT) AS n, fault_status AS status, fault_owner AS owner, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reason, NULL::TIMESTAMP AS acked, NULL::TIMESTAMP AS ended FROM steps
 UNION ALL SELECT fault_id, n, CASE WHEN why IS NULL THEN CASE kind WHEN 'acknowledge' THEN 'Ongoing' ELSE 'Resolved' END ELSE status END,
  CASE WHEN why IS NULL AND kind = 'acknowledge' THEN assignee ELSE owner END, request_id, why,
  CASE WHEN why IS NULL AND kind = 'acknowledge' THEN requested_at ELSE acked END, CASE WHEN why IS NULL AND kind = 'resolve' THEN requested_at ELSE ended END
 FROM (SELECT w.fault_id, s.n, w.status, w.owner, w.acked, w.ended, s.kind, s.request_id, s.assignee, s.requested_at,
  CASE WHEN s.kind = 'acknowledge' THEN CASE WHEN w.status IS NULL THEN 'Fault does not exist' WHEN w.status <> 'Open' THEN 'You can only acknowledge an open fault'
    WHEN NOT may_ack THEN 'You do not have permission to acknowledge faults' WHEN NOT may_own THEN 'The assignee does not have permission to resolve faults' END
   ELSE CASE WHEN NOT confirmed THEN 'Failed to acknowledge the fault.' WHEN NOT has_clear THEN 'Failed to provide clearing condition'
    WHEN rem IS NULL THEN 'Failed to provide remediation' WHEN rem > 255 THEN 'Remediation must be less than 255 characters.'
    WHEN w.status IS NULL THEN 'Attempt to resolve a non-existent fault.' WHEN w.status <> 'Ongoing' THEN 'Attempt to resolve a fault that is not ongoing.'
    WHEN w.owner IS DISTINCT FROM s.actor THEN 'Unauthorised attempt to resolve a fault not assigned to the user.' END END AS why
  FROM walk w JOIN steps s ON s.fault_id = w.fault_id AND s.n = w.n + 1)),
verdicts AS (SELECT s.*, w.reason FROM steps s JOIN walk w ON w.fault_id = s.fault_id AND w.n = s.n),
turns AS (SELECT alert, requested_at, request_id, 'escalate' AS what, actor FROM full_req WHERE kind = 'escalate'
 UNION ALL SELECT fault_alert, requested_at, request_id, 'cascade', actor FROM verdicts WHERE kind = 'resolve' AND reason IS NULL AND fault_alert IS NOT NULL),
numbered AS (SELECT t.*, a.status, a.severity, row_number() OVER (PARTITION BY alert ORDER BY requested_at, request_id) AS n FROM turns t LEFT JOIN alerts a ON a.id = t.alert),
course AS (SELECT DISTINCT alert, CAST(0 AS BIGINT) AS n, status, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS what, CAST(NULL AS VARCHAR) AS reason FROM numbered
 UNION ALL SELECT alert, n, CASE WHEN status IS NULL THEN NULL WHEN what = 'cascade' THEN 'Resolved' WHEN why IS NULL THEN 'Escalated' ELSE status END, request_id, what, why FROM
  (SELECT c.alert, x.n, c.status, x.request_id, x.what, CASE WHEN x.what = 'escalate' THEN CASE WHEN c.status IS NULL THEN 'Attempt to escalate a non-existent alert.'
    WHEN c.status = 'Escalated' THEN 'Attempt to escalate an alert that has been escalated already.' WHEN c.status = 'Resolved' THEN 'Attempt to escalate a resolved alert.'
    WHEN x.severity = 'Info' THEN 'Attempt to escalate an info alert.' END END AS why FROM course c JOIN numbered x ON x.alert = c.alert AND x.n = c.n + 1))"""
_MIXED_VIEWS = "faults alerts users roles roles_permissions permissions"


def _mixed(t: Tables) -> lifecycle.Course:
    return lifecycle.take_requests(_mixed_requests(t), t.faults, t.alerts, t.users, t.roles, t.roles_permissions, t.permissions)


@query("l1_l2_l3_mixed_log", views=_MIXED_VIEWS, sql=f"""
WITH RECURSIVE {_MIXED}
SELECT request_id, CASE kind WHEN 'acknowledge' THEN 'Acknowledged' ELSE 'Resolved' END AS action_type, fault_id AS item, actor AS performed_by, CASE WHEN reason IS NULL THEN 'Success' ELSE 'Failed' END AS outcome,
 coalesce(reason, CASE kind WHEN 'acknowledge' THEN notes ELSE concat('Resolved the fault ', fault_id, ' successfully.') END) AS notes FROM verdicts
UNION ALL SELECT c.request_id, 'Escalated', CAST(c.alert AS VARCHAR), q.actor, CASE WHEN c.reason IS NULL THEN 'Success' ELSE 'Failed' END, coalesce(c.reason, 'Alert has been escalated to a fault successfully.')
 FROM course c JOIN full_req q USING (request_id) WHERE c.what = 'escalate'
UNION ALL SELECT request_id, 'Resolved', CAST(fault_alert AS VARCHAR), actor, 'Success', concat('Alert resolved successfully due to resolution of fault ', fault_id, '.')
 FROM verdicts WHERE kind = 'resolve' AND reason IS NULL AND fault_alert IS NOT NULL""")
def _(t: Tables):
    return _mixed(t).log.drop("timestamp")


@query("l1_l2_mixed_faults", views=_MIXED_VIEWS, sql=f"""
WITH RECURSIVE {_MIXED}, last AS (SELECT fault_id, arg_max(status, n) AS status, arg_max(owner, n) AS owner, max(acked) AS acked, max(ended) AS ended FROM walk GROUP BY 1)
SELECT f.id, coalesce(l.status, f.status) AS status, CASE WHEN l.fault_id IS NULL THEN f.assigned_to ELSE l.owner END AS assigned_to, coalesce(acked, f.acknowledged_at) AS acknowledged_at,
 coalesce(ended, f.resolved_at) AS resolved_at FROM faults f LEFT JOIN last l USING (fault_id)""")
def _(t: Tables):
    return _mixed(t).faults.select("id", "status", "assigned_to", "acknowledged_at", "resolved_at")


@query("l2_l3_mixed_alerts", views=_MIXED_VIEWS, sql=f"""
WITH RECURSIVE {_MIXED}, last AS (SELECT alert, arg_max(status, n) AS status FROM course GROUP BY 1)
SELECT a.id, coalesce(l.status, a.status) AS status FROM alerts a LEFT JOIN last l ON l.alert = a.id""")
def _(t: Tables):
    return _mixed(t).alerts.select("id", "status")


def _policy_requests(t: Tables) -> DataFrame:
    k = F.col("event_id")
    action = F.when(k % 7 == 0, "Deleted").when(k % 2 == 0, "Activated").otherwise("Deactivated")
    return t.raw("events").select(
        k.alias("request_id"),
        (k * 13 % 700).alias("policy_id"),
        action.alias("action"),
        F.col("user_id").alias("actor"),
        F.col("ts").alias("requested_at"),
    )


_POLICY = """
req AS (SELECT event_id AS request_id, event_id * 13 % 700 AS policy_id, CASE WHEN event_id % 7 = 0 THEN 'Deleted' WHEN event_id % 2 = 0 THEN 'Activated' ELSE 'Deactivated' END AS action,
 user_id AS actor, row_number() OVER (PARTITION BY event_id * 13 % 700 ORDER BY ts, event_id) AS i FROM events),
steps AS (SELECT q.*, p.priority, p.status = 'Active' AS active, coalesce(p.is_deleted, true) AS gone FROM req q LEFT JOIN policies p ON p.id = q.policy_id),
walk AS (SELECT policy_id, CAST(0 AS BIGINT) AS i, active, gone, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reason FROM steps WHERE i = 1
 UNION ALL SELECT s.policy_id, s.i,
  CASE WHEN s.priority = 1 OR w.gone OR s.action = 'Deleted' THEN w.active ELSE s.action = 'Activated' END,
  w.gone OR (s.action = 'Deleted' AND s.priority <> 1), s.request_id,
  CASE WHEN s.priority = 1 THEN 'Attempt to change a default policy.' WHEN w.gone THEN 'Attempt to change a non-existent policy.'
       WHEN s.action = 'Activated' AND w.active THEN 'Attempt to activate an already active policy.'
       WHEN s.action = 'Deactivated' AND NOT w.active THEN 'Attempt to deactivate an already deactivated policy.' END
 FROM walk w JOIN steps s ON s.policy_id = w.policy_id AND s.i = w.i + 1)"""


@query("l4_policy_log", views="policies", sql=f"""
WITH RECURSIVE {_POLICY} SELECT w.request_id, s.action AS action_type, w.policy_id, s.actor AS performed_by, CASE WHEN w.reason IS NULL THEN 'Success' ELSE 'Failed' END AS outcome,
 coalesce(w.reason, 'Policy changed successfully.') AS notes FROM walk w JOIN steps s ON s.request_id = w.request_id""")
def _(t: Tables):
    log = transitions.change_policies(_policy_requests(t), t.policies).log
    return log.select("request_id", "action_type", "policy_id", "performed_by", "outcome", "notes")


@query("l4_changed_policies", views="policies", sql=f"""
WITH RECURSIVE {_POLICY}, ends AS (SELECT policy_id, arg_max(active, i) AS active, arg_max(gone, i) AS gone FROM walk GROUP BY 1)
SELECT p.id, CASE WHEN e.active IS NULL THEN p.status WHEN e.active THEN 'Active' ELSE 'Inactive' END AS status, coalesce(e.gone, p.is_deleted) AS is_deleted
FROM policies p LEFT JOIN ends e ON e.policy_id = p.id""")
def _(t: Tables):
    return transitions.change_policies(_policy_requests(t), t.policies).table.select("id", "status", "is_deleted")
