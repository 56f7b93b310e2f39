"""State-changing batch jobs: requests plus current table give a new table and log rows.

Each job judges every request, lets the first acceptable request per item (by
time, then id) through and refuses those after it, then builds the new table
by a join.  Inputs are never overwritten.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.operators.access import users_with_permission
from photonwatch.operators.filters import first_sentence, padded_code


class Outcome(NamedTuple):
    table: DataFrame
    log: DataFrame


def _judged(requests: DataFrame, item: str, reason: Column, later: str) -> DataFrame:
    """Add ``reason``: null for the one request per item that goes through."""
    rows = requests.withColumn("reason", reason)
    place = F.struct("requested_at", "request_id")
    winners = rows.filter(F.col("reason").isNull()).groupBy(item).agg(F.min(place).alias("_winner"))
    rows = rows.join(winners, item, "left")
    too_late = F.col("_winner").isNotNull() & (place > F.col("_winner"))
    # a request that fails before the state of the item is looked at keeps its reason
    return rows.withColumn(
        "reason", F.when(too_late & F.coalesce(F.col("_rank_of_reason") >= 1, F.lit(True)), F.lit(later)).otherwise(F.col("reason"))
    ).drop("_winner", "_rank_of_reason")


def _reasons(*checks: tuple[Column, str], state_from: int = 0) -> tuple[Column, Column]:
    """First failing check as text, and whether it comes at or after the state check."""
    reason, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (failed, text) in reversed(list(enumerate(checks))):
        bad = F.coalesce(failed, F.lit(False))
        reason = F.when(bad, F.lit(text)).otherwise(reason)
        rank = F.when(bad, F.lit(1 if i >= state_from else 0)).otherwise(rank)
    return reason, rank


def holders_of(users: DataFrame, roles: DataFrame, grants: DataFrame, permissions: DataFrame, permission: str, key: str) -> DataFrame:
    names = users_with_permission(users, roles, grants, permissions, permission)
    return names.select(F.col("uuid").alias(key), F.lit(True).alias(f"_{key}_ok"))


def _log(judged: DataFrame, item: str, action: str, success: Column) -> DataFrame:
    return judged.select(
        "request_id",
        F.col("requested_at").alias("timestamp"),
        F.lit(action).alias("action_type"),
        item,
        F.col("actor").alias("performed_by"),
        F.when(F.col("reason").isNull(), "Success").otherwise("Failed").alias("outcome"),
        F.coalesce("reason", success).alias("notes"),
    )


def acknowledge_faults(
    requests: DataFrame, faults: DataFrame, users: DataFrame, roles: DataFrame, grants: DataFrame, permissions: DataFrame
) -> Outcome:
    """Open faults become Ongoing.  ``requests``: request_id, fault_id, actor, assignee, notes, requested_at."""
    known = faults.select("fault_id", F.col("status").alias("_status"))
    rows = (
        requests.join(known, "fault_id", "left")
        .join(holders_of(users, roles, grants, permissions, "fault.acknowledge", "actor"), "actor", "left")
        .join(holders_of(users, roles, grants, permissions, "fault.resolve", "assignee"), "assignee", "left")
    )
    not_open = "You can only acknowledge an open fault"
    reason, rank = _reasons(
        (F.col("_status").isNull(), "Fault does not exist"),
        (F.col("_status") != "Open", not_open),
        (F.col("_actor_ok").isNull(), "You do not have permission to acknowledge faults"),
        (F.col("_assignee_ok").isNull(), "The assignee does not have permission to resolve faults"),
        state_from=1,
    )
    judged = _judged(rows.withColumn("_rank_of_reason", rank), "fault_id", reason, not_open)
    done = judged.filter(F.col("reason").isNull()).select(
        "fault_id", F.col("actor").alias("_actor"), F.col("assignee").alias("_assignee"), F.col("requested_at").alias("_at")
    )
    hit = F.col("_at").isNotNull()
    table = (
        faults.join(done, "fault_id", "left")
        .withColumns(
            {
                "status": F.when(hit, "Ongoing").otherwise(F.col("status")),
                "acknowledged_at": F.when(hit, F.col("_at")).otherwise(F.col("acknowledged_at")),
                "acknowledged_by": F.when(hit, F.col("_actor")).otherwise(F.col("acknowledged_by")),
                "assigned_to": F.when(hit, F.col("_assignee")).otherwise(F.col("assigned_to")),
            }
        )
        .select(*faults.columns)
    )
    return Outcome(table, _log(judged, "fault_id", "Acknowledged", F.col("notes")))


def resolve_faults(requests: DataFrame, faults: DataFrame, alerts: DataFrame) -> tuple[Outcome, Outcome]:
    """Ongoing faults become Resolved, and so do the alerts they came from.

    ``requests``: request_id, fault_id, actor, confirmed, clearing_condition, remediation, requested_at.
    """
    known = faults.select("fault_id", F.col("status").alias("_status"), F.col("assigned_to").alias("_owner"), F.col("alert_id").alias("_alert"))
    rows = requests.join(known, "fault_id", "left")
    not_ongoing = "Attempt to resolve a fault that is not ongoing."
    reason, rank = _reasons(
        (~F.col("confirmed"), "Failed to acknowledge the fault."),
        (F.col("clearing_condition").isNull(), "Failed to provide clearing condition"),
        (F.col("remediation").isNull(), "Failed to provide remediation"),
        (F.length("remediation") > 255, "Remediation must be less than 255 characters."),
        (F.length("clearing_condition") > 255, "Clearing condition must be less than 255 characters."),
        (F.col("_status").isNull(), "Attempt to resolve a non-existent fault."),
        (F.col("_status") != "Ongoing", not_ongoing),
        (~F.col("_owner").eqNullSafe(F.col("actor")), "Unauthorised attempt to resolve a fault not assigned to the user."),
        state_from=6,
    )
    judged = _judged(rows.withColumn("_rank_of_reason", rank), "fault_id", reason, not_ongoing)
    done = judged.filter(F.col("reason").isNull())
    resolved = done.select("fault_id", F.col("actor").alias("_actor"), F.col("requested_at").alias("_at"))
    hit = F.col("_at").isNotNull()
    table = (
        faults.join(resolved, "fault_id", "left")
        .withColumns(
            {
                "status": F.when(hit, "Resolved").otherwise(F.col("status")),
                "resolved_at": F.when(hit, F.col("_at")).otherwise(F.col("resolved_at")),
                "resolved_by": F.when(hit, F.col("_actor")).otherwise(F.col("resolved_by")),
            }
        )
        .select(*faults.columns)
    )
    success = F.concat(F.lit("Resolved the fault "), "fault_id", F.lit(" successfully."))
    cascade = done.filter(F.col("_alert").isNotNull())
    ended = cascade.groupBy(F.col("_alert").alias("id")).agg(F.min("requested_at").alias("_at"))
    alert_table = (
        alerts.join(ended, "id", "left")
        .withColumn("status", F.when(F.col("_at").isNotNull(), "Resolved").otherwise(F.col("status")))
        .select(*alerts.columns)
    )
    note = F.concat(F.lit("Alert resolved successfully due to resolution of fault "), "fault_id", F.lit("."))
    alert_log = _log(cascade.withColumn("alert", F.col("_alert")), "alert", "Resolved", note)
    return Outcome(table, _log(judged, "fault_id", "Resolved", success)), Outcome(alert_table, alert_log)


def escalate_alerts(requests: DataFrame, alerts: DataFrame, faults: DataFrame) -> tuple[Outcome, DataFrame]:
    """Alerts become Escalated, each with a new Open fault.

    ``requests``: request_id, alert_id, actor, requested_at.  Returns the alert
    outcome, whose table tells who escalated (``performed_by``) and when
    (``escalated_at``), and the new fault rows, numbered on from the highest fault id.
    """
    known = alerts.select("alert_id", F.col("status").alias("_status"), F.col("severity").alias("_severity"))
    escalated = "Attempt to escalate an alert that has been escalated already."
    reason, rank = _reasons(
        (F.col("_status").isNull(), "Attempt to escalate a non-existent alert."),
        (F.col("_status") == "Escalated", escalated),
        (F.col("_status") == "Resolved", "Attempt to escalate a resolved alert."),
        (F.col("_severity") == "Info", "Attempt to escalate an info alert."),
        state_from=1,
    )
    rows = requests.join(known, "alert_id", "left").withColumn("_rank_of_reason", rank)
    judged = _judged(rows, "alert_id", reason, escalated)
    done = judged.filter(F.col("reason").isNull()).select("alert_id", "request_id", F.col("requested_at").alias("_at"), F.col("actor").alias("_by"))
    new = {"performed_by": F.col("_by"), "escalated_at": F.col("_at")}
    before = {c: F.col(c) if c in alerts.columns else F.lit(None) for c in new}
    table = (
        alerts.join(done.drop("request_id"), "alert_id", "left")
        .withColumn("status", F.when(F.col("_at").isNotNull(), "Escalated").otherwise(F.col("status")))
        .withColumns({c: F.coalesce(v, before[c]) for c, v in new.items()})
        .select(*dict.fromkeys([*alerts.columns, *new]))
    )
    numbered = scale.split_row_number(
        # buckets of a second: a batch of requests usually lies within one hour
        done.withColumns({"_all": F.lit(1), "_bucket": F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / 1_000_000)}),
        ["_all"],
        "_bucket",
        [F.col("_at"), F.col("request_id")],
        "_i",
    )
    new_id = F.col("_i") + faults.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new_faults = numbered.join(alerts, "alert_id").select(
        new_id.alias("id"),
        padded_code("FLT_", new_id).alias("fault_id"),
        "component_type",
        "component_id",
        "severity",
        F.lit("Open").alias("status"),
        "detected_at",
        first_sentence("description").alias("description"),
        F.col("id").alias("alert_id"),
        F.lit("Escalated from Alert").alias("raising_condition"),
    )
    success = F.lit("Alert has been escalated to a fault successfully.")
    return Outcome(table, _log(judged, "alert_id", "Escalated", success)), new_faults


def change_policies(requests: DataFrame, policies: DataFrame) -> Outcome:
    """Activate, deactivate or delete policies.

    ``requests``: request_id, policy_id, action (Activated, Deactivated,
    Deleted), actor, requested_at.  Requests on one policy in a batch are taken
    in order, each seeing the state the earlier ones left.
    """
    known = policies.select(
        F.col("id").alias("policy_id"),
        F.col("priority").alias("_priority"),
        F.col("is_deleted").alias("_gone"),
        (F.col("status") == "Active").alias("_active"),
    )
    rows = requests.join(known, "policy_id", "left").withColumns(
        {
            "_bucket": scale.hour_bucket("requested_at"),
            "_delete": F.when(F.col("action") == "Deleted", 1).otherwise(0).cast("bigint"),
            "_switch": F.when(F.col("action") != "Deleted", F.col("action") == "Activated"),
        }
    )
    order = [F.col("requested_at"), F.col("request_id")]
    rows = scale.spread(rows, ["policy_id"], "_bucket")
    # a switch sets the state whether it was needed or not, so the state before a
    # request is that of the last switch before it; a delete ends the policy
    rows = scale.split_running_sum(rows, ["policy_id"], "_bucket", order, "_delete", "_deletes")
    rows = scale.split_fill(rows, ["policy_id"], "_bucket", ["requested_at", "request_id"], ["_switch"], suffix="_now")
    rows = scale.split_lag(rows, ["policy_id"], "_bucket", ["requested_at", "request_id"], {"_switch_now": "_switch_before"})
    before = F.coalesce("_switch_before", "_active")
    gone = F.col("_priority").isNull() | F.col("_gone") | (F.col("_deletes") - F.col("_delete") > 0)
    reason, _ = _reasons(
        (F.col("_priority") == 1, "Attempt to change a default policy."),
        (gone, "Attempt to change a non-existent policy."),
        ((F.col("action") == "Activated") & before, "Attempt to activate an already active policy."),
        ((F.col("action") == "Deactivated") & ~before, "Attempt to deactivate an already deactivated policy."),
    )
    judged = rows.withColumn("reason", reason)
    done = judged.filter(F.col("reason").isNull())
    last = done.groupBy(F.col("policy_id").alias("id")).agg(
        F.max_by("_switch", F.when(F.col("_switch").isNotNull(), F.struct("requested_at", "request_id"))).alias("_on"),
        F.max("_delete").alias("_deleted"),
    )
    table = (
        policies.join(last, "id", "left")
        .withColumns(
            {
                "status": F.when(F.col("_on"), "Active").when(~F.col("_on"), "Inactive").otherwise(F.col("status")),
                "is_deleted": F.col("is_deleted") | (F.coalesce("_deleted", F.lit(0)) > 0),
            }
        )
        .select(*policies.columns)
    )
    log = judged.select(
        "request_id",
        F.col("requested_at").alias("timestamp"),
        F.col("action").alias("action_type"),
        "policy_id",
        F.col("actor").alias("performed_by"),
        F.when(F.col("reason").isNull(), "Success").otherwise("Failed").alias("outcome"),
        F.coalesce("reason", F.lit("Policy changed successfully.")).alias("notes"),
    )
    return Outcome(table, log)


def delete_documents(library: DataFrame, deletions: DataFrame) -> DataFrame:
    """Soft delete: active documents named by id or file name become inactive."""
    by_id = deletions.filter(F.col("id").isNotNull()).select("id").distinct().withColumn("_by_id", F.lit(True))
    by_name = deletions.filter(F.col("filename").isNotNull()).select("filename").distinct().withColumn("_by_name", F.lit(True))
    hit = (F.col("status") == "active") & (F.coalesce("_by_id", "_by_name", F.lit(False)))
    return (
        library.join(by_id, "id", "left")
        .join(by_name, "filename", "left")
        .withColumn("status", F.when(hit, "inactive").otherwise(F.col("status")))
        .select(*library.columns)
    )
