"""State-changing jobs against a plain sequential loop."""

import datetime as dt
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from photonwatch.operators import transitions
from photonwatch.sources import tables

START = dt.datetime(2024, 1, 1)


def test_acknowledge_is_sequential(spark):
    rng = random.Random(4)
    users = [(u, f"u{u}", u % 4, "Online" if u % 5 else "Deactivated") for u in range(1, 21)]
    roles = [(0, "Super Admin"), (1, "Administrator"), (2, "Operator"), (3, "Viewer")]
    grants = [(0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    faults = [(i, f"F{i}", rng.choice(["Open", "Open", "Resolved"]), None, None, None) for i in range(1, 8)]
    # one fault draws a third of all requests
    asked = [(r, f"F{rng.choice([1, 1, 1, rng.randint(1, 9)])}", rng.randint(1, 20), rng.randint(1, 20), f"n{r}", START + dt.timedelta(minutes=rng.randint(0, 300))) for r in range(120)]
    may = {p: {u for u, _, role, s in users if s != "Deactivated" and role != 0 and (role, p) in grants} for p in (1, 2)}
    state = {f[1]: f[2] for f in faults}
    want = {}
    for r, fault, actor, assignee, _, _ in sorted(asked, key=lambda a: (a[5], a[0])):
        if fault not in state:
            want[r] = "Fault does not exist"
        elif state[fault] != "Open":
            want[r] = "You can only acknowledge an open fault"
        elif actor not in may[1]:
            want[r] = "You do not have permission to acknowledge faults"
        elif assignee not in may[2]:
            want[r] = "The assignee does not have permission to resolve faults"
        else:
            state[fault], want[r] = "Ongoing", f"n{r}"
    out = transitions.acknowledge_faults(
        spark.createDataFrame(asked, "request_id long, fault_id string, actor long, assignee long, notes string, requested_at timestamp_ntz"),
        spark.createDataFrame(faults, "id long, fault_id string, status string, acknowledged_at timestamp_ntz, acknowledged_by long, assigned_to long"),
        spark.createDataFrame(users, "uuid long, name string, role_id long, status string"),
        spark.createDataFrame(roles, "id long, role_name string"),
        spark.createDataFrame(grants, "role_id long, permission_id long"),
        spark.createDataFrame([(1, "fault.acknowledge"), (2, "fault.resolve")], "id long, permission_name string"),
    )
    assert {r.request_id: r.notes for r in out.log.collect()} == want
    assert {r.fault_id: r.status for r in out.table.collect()} == state


@pytest.mark.parametrize("seed", [1, 2])
def test_policy_changes_are_sequential(spark, seed):
    rng = random.Random(seed)
    policies = [(i, rng.choice(["Active", "Inactive"]), rng.randint(1, 3), rng.random() < 0.2) for i in range(6)]
    asked = [(r, rng.choice([0, 0, 0, rng.randint(0, 7)]), rng.choice(["Activated", "Deactivated", "Activated", "Deactivated", "Deleted"]) if rng.random() < 0.3 else rng.choice(["Activated", "Deactivated"]), 1, START + dt.timedelta(minutes=37 * rng.randint(0, 90))) for r in range(90)]
    state = {i: [s == "Active", p, gone] for i, s, p, gone in policies}
    ok = {}
    for r, policy, action, _, _ in sorted(asked, key=lambda a: (a[4], a[0])):
        active, priority, gone = state.get(policy, (None, None, True))
        ok[r] = not (priority == 1 or gone or (action == "Activated" and active) or (action == "Deactivated" and not active))
        if ok[r]:
            if action == "Deleted":
                state[policy][2] = True
            else:
                state[policy][0] = action == "Activated"
    out = transitions.change_policies(
        spark.createDataFrame(asked, "request_id long, policy_id long, action string, actor long, requested_at timestamp_ntz"),
        spark.createDataFrame(policies, "id long, status string, priority long, is_deleted boolean"),
    )
    assert {r.request_id: r.outcome == "Success" for r in out.log.collect()} == ok
    assert {r.id: (r.status == "Active", r.is_deleted) for r in out.table.collect()} == {i: (a, g) for i, (a, _, g) in state.items()}


def test_history_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown data source"):
        tables.history(spark, "ftp")
    bad = tmp_path / "bad"
    spark.createDataFrame([("n", 1)], "Node string, x int").write.option("header", True).csv(str(bad))
    with pytest.raises(ValueError, match="DateTime, qkdKeyRate"):
        tables.csv_history(spark, str(bad))
    frame = spark.range(1).withColumn("Node", F.lit("n"))
    assert tables.history(spark, "snmp", database=frame) is frame


def test_a_batch_stored_again_replaces_itself(spark, tmp_path):
    from photonwatch.operators import text
    from photonwatch.sources import sinks

    docs = spark.createDataFrame([(1, "a", "One two. " * 80, "h1"), (2, "b", "", "h2")], "id long, filename string, text string, content_hash string")
    for _ in range(2):
        sinks.store_documents(docs, partial(text.fixed_chunked, size=200, overlap=20), str(tmp_path), batch=3)
    rows = {r.id: r.chunk_count for r in spark.read.parquet(f"{tmp_path}/documents").collect()}
    assert rows[2] == 0 and rows[1] == spark.read.parquet(f"{tmp_path}/document_chunks").count() > 3


def test_models_of_one_key_are_replaced(spark, tmp_path):
    from photonwatch.sources import sinks

    first = spark.createDataFrame([("N1", "m", 1), ("N2", "m", 1)], "node_name string, metric string, points int")
    sinks.save_models(first, str(tmp_path / "m"), F.lit("monday"))
    sinks.save_models(first.filter("node_name = 'N1'").withColumn("points", F.lit(2)), str(tmp_path / "m"), F.lit("tuesday"))
    rows = {(r.node_name, r.points, r.trained_at) for r in sinks.load_models(spark, str(tmp_path / "m")).collect()}
    assert rows == {("N1", 2, "tuesday"), ("N2", 1, "monday")}


def test_ingest_goes_on_after_a_restart(spark, tmp_path):
    from photonwatch.operators import text
    from photonwatch.sources import sinks
    from photonwatch.streaming import monitors

    def store(rows, path, batch):
        sinks.store_documents(rows, partial(text.fixed_chunked, size=200, overlap=20), path, batch=batch)

    schema = "id long, filename string, text string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(i, f"f{i}", "some text here"), (9, "same", "text")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = monitors.file_stream(spark, source, spark.createDataFrame([], schema).schema)
        monitors.ingest_stream(stream, target, store)
    stored = spark.read.parquet(f"{target}/documents")
    assert sorted(r.filename for r in stored.collect()) == ["f0", "f1", "f2", "same"]
    assert stored.select("batch").distinct().count() == 3


def test_mixed_requests_on_one_hot_fault(spark):
    """A third of all requests on one fault, all kinds in a random order, against a plain loop."""
    import random

    from photonwatch.operators import lifecycle

    rng = random.Random(6)
    users = spark.createDataFrame([(1, "ann", 1, "Online"), (2, "bob", 1, "Offline"), (3, "eve", 2, "Online")], "uuid long, name string, role_id long, status string")
    roles = spark.createDataFrame([(1, "Operator"), (2, "Guest")], "id long, role_name string")
    permissions = spark.createDataFrame([(1, "fault.acknowledge"), (2, "fault.resolve")], "id long, permission_name string")
    grants = spark.createDataFrame([(1, 1), (1, 2)], "role_id long, permission_id long")
    states = {f"F{k}": ["Open", rng.choice(["Open", "Ongoing", "Resolved"]), None][0 if k == 0 else 1] for k in range(40)}
    owners = {f: 2 if s == "Ongoing" else None for f, s in states.items()}
    of = {f: 100 + k for k, f in enumerate(states)}
    alert_states = {100 + k: rng.choice(["Active", "Active", "Resolved", "Escalated"]) for k in range(40)} | {100: "Active"}
    severe = {a: rng.choice(["Critical", "Info"]) for a in alert_states} | {100: "Critical"}
    t = "timestamp_ntz"
    faults = spark.createDataFrame(
        [(k, f, s, owners[f], of[f], None, None, None, None) for k, (f, s) in enumerate(states.items())],
        f"id long, fault_id string, status string, assigned_to long, alert_id long, acknowledged_at {t}, acknowledged_by long, resolved_at {t}, resolved_by long",
    )
    alerts = spark.createDataFrame([(a, s, severe[a]) for a, s in alert_states.items()], "id long, status string, severity string")
    rows = []
    for k in range(600):
        fault = "F0" if rng.random() < 0.33 else rng.choice([*states, "F99"])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(300))
        rows.append((k, rng.choice(["acknowledge", "resolve", "escalate"]), fault, of.get(fault, 999), rng.choice([1, 2, 3]), rng.choice([1, 2, 3]), f"n{k}", rng.random() < 0.8, "c", rng.choice(["r", "r", None]), at))
    columns = f"request_id long, kind string, fault_id string, alert long, actor long, assignee long, notes string, confirmed boolean, clearing_condition string, remediation string, requested_at {t}"
    got = lifecycle.take_requests(spark.createDataFrame(rows, columns), faults, alerts, users, roles, grants, permissions)
    want = []
    for k, kind, fault, alert, actor, assignee, notes, confirmed, _, remediation, _ in sorted(rows, key=lambda r: (r[10], r[0])):
        why = None
        if kind == "acknowledge":
            why = (
                lifecycle.NO_FAULT if fault not in states else lifecycle.NOT_OPEN if states[fault] != "Open"
                else lifecycle.MAY_NOT_ACKNOWLEDGE if actor == 3 else lifecycle.MAY_NOT_RESOLVE if assignee == 3 else None
            )
            if why is None:
                states[fault], owners[fault] = "Ongoing", assignee
            want.append((k, "Acknowledged", fault, why or notes))
        elif kind == "resolve":
            why = (
                lifecycle.UNCONFIRMED if not confirmed else lifecycle.NO_REMEDIATION if remediation is None
                else lifecycle.NO_SUCH_FAULT if fault not in states else lifecycle.NOT_ONGOING if states[fault] != "Ongoing"
                else lifecycle.NOT_OWNER if owners[fault] != actor else None
            )
            want.append((k, "Resolved", fault, why or f"Resolved the fault {fault} successfully."))
            if why is None:
                states[fault] = alert_states[alert] = "Resolved"
                want.append((k, "Resolved", str(alert), f"Alert resolved successfully due to resolution of fault {fault}."))
        else:
            state = alert_states.get(alert)
            why = (
                lifecycle.NO_ALERT if state is None else lifecycle.ESCALATED_BEFORE if state == "Escalated"
                else lifecycle.RESOLVED_BEFORE if state == "Resolved" else lifecycle.INFO_ALERT if severe[alert] == "Info" else None
            )
            if why is None:
                alert_states[alert] = "Escalated"
            want.append((k, "Escalated", str(alert), why or lifecycle.ESCALATED))
    assert sorted((r.request_id, r.action_type, r.item, r.notes) for r in got.log.collect()) == sorted(want)
    assert {r.fault_id: (r.status, r.assigned_to) for r in got.faults.collect()} == {f: (s, owners[f]) for f, s in states.items()}
    assert {r.id: r.status for r in got.alerts.collect()} == alert_states
