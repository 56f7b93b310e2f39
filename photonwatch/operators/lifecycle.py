"""Requests of several kinds on faults and alerts, taken in their order.

A fault goes from Open to Ongoing to Resolved and never back, so its course
within a batch is known from two moments: its first acceptable acknowledgement
and the first acceptable resolution after that.  An alert's course follows from
its first acceptable escalation and the first resolution of a fault that came
from it.  Such moments are grouped minima with partial minima in the tasks: a
fault that gets a third of all requests is no more work for one task than any
other, and every request is then judged by the state before it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.operators.transitions import holders_of
from photonwatch.session import cut_lineage

# What a refused or done request says.
NO_FAULT, NOT_OPEN = "Fault does not exist", "You can only acknowledge an open fault"
MAY_NOT_ACKNOWLEDGE = "You do not have permission to acknowledge faults"
MAY_NOT_RESOLVE = "The assignee does not have permission to resolve faults"
UNCONFIRMED, NO_CLEARING = "Failed to acknowledge the fault.", "Failed to provide clearing condition"
NO_REMEDIATION = "Failed to provide remediation"
LONG_REMEDIATION, LONG_CLEARING = "Remediation must be less than 255 characters.", "Clearing condition must be less than 255 characters."
NO_SUCH_FAULT, NOT_ONGOING = "Attempt to resolve a non-existent fault.", "Attempt to resolve a fault that is not ongoing."
NOT_OWNER = "Unauthorised attempt to resolve a fault not assigned to the user."
NO_ALERT = "Attempt to escalate a non-existent alert."
ESCALATED_BEFORE, RESOLVED_BEFORE = "Attempt to escalate an alert that has been escalated already.", "Attempt to escalate a resolved alert."
INFO_ALERT, ESCALATED = "Attempt to escalate an info alert.", "Alert has been escalated to a fault successfully."
ACTIONS = {"acknowledge": "Acknowledged", "resolve": "Resolved", "escalate": "Escalated"}


class Course(NamedTuple):
    """Tables after a batch, and what became of every request and cascade."""

    faults: DataFrame
    alerts: DataFrame
    log: DataFrame


def _first_failing(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for failed, text in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), F.lit(text)).otherwise(out)
    return out


def _before(moment: str) -> Column:
    """Whether the moment lies before the row's own; a missing one never does."""
    return F.coalesce(F.col(moment)["place"] < F.col("place"), F.lit(False))


def _acknowledge_error(status: Column) -> Column:
    return _first_failing(
        (F.col("_status").isNull(), NO_FAULT), (status != "Open", NOT_OPEN),
        (F.col("_actor_ok").isNull(), MAY_NOT_ACKNOWLEDGE), (F.col("_assignee_ok").isNull(), MAY_NOT_RESOLVE),
    )


def _resolve_error(status: Column, owner: Column) -> Column:
    return _first_failing(
        (~F.col("confirmed"), UNCONFIRMED), (F.col("clearing_condition").isNull(), NO_CLEARING), (F.col("remediation").isNull(), NO_REMEDIATION),
        (F.length("remediation") > 255, LONG_REMEDIATION), (F.length("clearing_condition") > 255, LONG_CLEARING),
        (F.col("_status").isNull(), NO_SUCH_FAULT), (status != "Ongoing", NOT_ONGOING), (~owner.eqNullSafe(F.col("actor")), NOT_OWNER),
    )


def _judged_faults(requests: DataFrame, faults: DataFrame, may_acknowledge: DataFrame, may_resolve: DataFrame) -> DataFrame:
    """Acknowledgements and resolutions with ``reason`` (null: done), and the fault's two moments, ``_ack`` and ``_end``."""
    known = faults.select("fault_id", F.col("status").alias("_status"), F.col("assigned_to").alias("_owner"), F.col("alert_id").alias("_alert"))
    asked = requests.select("fault_id").distinct().join(known, "fault_id", "left")
    rows = scale.beside(requests.withColumn("place", F.struct("requested_at", "request_id")), asked, ["fault_id"])
    rows = rows.join(may_acknowledge, "actor", "left").join(may_resolve, "assignee", "left")
    rows = cut_lineage(rows)
    ack, end = F.col("kind") == "acknowledge", F.col("kind") == "resolve"
    first = rows.filter(ack & _acknowledge_error(F.col("_status")).isNull()).groupBy("fault_id")
    moments = asked.select("fault_id").join(first.agg(F.min_by(F.struct("place", "actor", "assignee"), "place").alias("_ack")), "fault_id", "left")
    placed = cut_lineage(scale.beside(rows, cut_lineage(moments), ["fault_id"]))
    going = F.when(_before("_ack"), "Ongoing").otherwise(F.col("_status"))
    owner = F.when(_before("_ack"), F.col("_ack")["assignee"]).otherwise(F.col("_owner"))
    done = placed.filter(end & _resolve_error(going, owner).isNull()).groupBy("fault_id")
    ends = moments.select("fault_id").join(done.agg(F.min_by(F.struct("place", "actor"), "place").alias("_end")), "fault_id", "left")
    placed = scale.beside(placed, cut_lineage(ends), ["fault_id"])
    status = F.when(_before("_end"), "Resolved").otherwise(going)
    return placed.withColumn("reason", F.when(ack, _acknowledge_error(status)).otherwise(_resolve_error(status, owner)))


def _judged_alerts(requests: DataFrame, alerts: DataFrame, cascades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Escalations with ``reason``, and per alert its two moments: ``_up`` (escalated) and ``_off`` (its fault was resolved)."""
    known = alerts.select(F.col("id").alias("alert"), F.col("status").alias("_state"), F.col("severity").alias("_severity"))
    off = cascades.groupBy("alert").agg(F.min("place").alias("place")).select("alert", F.struct("place").alias("_off"))
    asked = requests.select("alert").union(off.select("alert")).distinct().join(known, "alert", "left").join(off, "alert", "left")
    asked = cut_lineage(asked)
    rows = cut_lineage(scale.beside(requests.withColumn("place", F.struct("requested_at", "request_id")), asked, ["alert"]))

    def error(state: Column) -> Column:
        return _first_failing(
            (F.col("_state").isNull(), NO_ALERT), (state == "Escalated", ESCALATED_BEFORE), (state == "Resolved", RESOLVED_BEFORE), (F.col("_severity") == "Info", INFO_ALERT)
        )

    still = F.when(_before("_off"), "Resolved").otherwise(F.col("_state"))
    up = rows.filter(error(still).isNull()).groupBy("alert").agg(F.min_by(F.struct("place", "actor"), "place").alias("_up"))
    moments = cut_lineage(asked.select("alert", "_off").join(up, "alert", "left"))
    placed = scale.beside(rows.drop("_off"), moments, ["alert"])
    state = F.when(_before("_off"), "Resolved").when(_before("_up"), "Escalated").otherwise(F.col("_state"))
    return placed.withColumn("reason", error(state)), moments


def take_requests(
    requests: DataFrame, faults: DataFrame, alerts: DataFrame, users: DataFrame, roles: DataFrame, grants: DataFrame, permissions: DataFrame
) -> Course:
    """Acknowledge, resolve and escalate in one batch, in the order of (requested_at, request_id).

    ``requests``: request_id, kind (acknowledge, resolve, escalate), fault_id or
    alert (an id of ``alerts``), actor, assignee, notes, confirmed,
    clearing_condition, remediation, requested_at.  A request meets the state that
    those before it left: an acknowledged fault can be resolved by its new owner in
    the same batch, and an alert whose fault was resolved can no longer be escalated.
    The log has a row per request, and one per alert that a resolution resolved.
    """
    may_acknowledge = holders_of(users, roles, grants, permissions, "fault.acknowledge", "actor")
    may_resolve = holders_of(users, roles, grants, permissions, "fault.resolve", "assignee")
    on_faults = cut_lineage(_judged_faults(requests.filter(F.col("kind").isin("acknowledge", "resolve")).drop("alert"), faults, may_acknowledge, may_resolve))
    done = on_faults.filter(F.col("reason").isNull())
    cascades = done.filter((F.col("kind") == "resolve") & F.col("_alert").isNotNull()).select(
        "request_id", "requested_at", "actor", "fault_id", F.col("_alert").alias("alert"), "place"
    )
    on_alerts, courses = _judged_alerts(requests.filter("kind = 'escalate'").drop("fault_id"), alerts, cascades)
    ack = done.filter("kind = 'acknowledge'").select("fault_id", *[F.col(c).alias(f"_{c}") for c in ("actor", "assignee", "requested_at")])
    end = done.filter("kind = 'resolve'").select("fault_id", F.col("actor").alias("_by"), F.col("requested_at").alias("_at"))
    taken, over = F.col("_requested_at").isNotNull(), F.col("_at").isNotNull()
    changed = {
        "status": F.when(over, "Resolved").when(taken, "Ongoing").otherwise(F.col("status")),
        "acknowledged_at": F.coalesce("_requested_at", "acknowledged_at"), "acknowledged_by": F.when(taken, F.col("_actor")).otherwise(F.col("acknowledged_by")),
        "assigned_to": F.when(taken, F.col("_assignee")).otherwise(F.col("assigned_to")),
        "resolved_at": F.coalesce("_at", "resolved_at"), "resolved_by": F.when(over, F.col("_by")).otherwise(F.col("resolved_by")),
    }
    new_faults = faults.join(ack, "fault_id", "left").join(end, "fault_id", "left").withColumns(changed).select(*faults.columns)
    state = F.when(F.col("_off").isNotNull(), "Resolved").when(F.col("_up").isNotNull(), "Escalated").otherwise(F.col("status"))
    new_alerts = alerts.join(courses, alerts["id"] == courses["alert"], "left").withColumn("status", state).select(*alerts.columns)
    said = F.when(F.col("kind") == "acknowledge", F.col("notes")).otherwise(F.concat(F.lit("Resolved the fault "), "fault_id", F.lit(" successfully.")))

    def log(rows: DataFrame, item: Column, action: Column, note: Column) -> DataFrame:
        outcome = F.when(F.col("reason").isNull(), "Success").otherwise("Failed")
        return rows.select(
            "request_id", F.col("requested_at").alias("timestamp"), action.alias("action_type"), item.cast("string").alias("item"),
            F.col("actor").alias("performed_by"), outcome.alias("outcome"), F.coalesce("reason", note).alias("notes"),
        )

    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    note = F.concat(F.lit("Alert resolved successfully due to resolution of fault "), "fault_id", F.lit("."))
    parts = [
        log(on_faults, F.col("fault_id"), actions[F.col("kind")], said),
        log(on_alerts, F.col("alert"), actions[F.col("kind")], F.lit(ESCALATED)),
        log(cascades.withColumn("reason", F.lit(None).cast("string")), F.col("alert"), F.lit("Resolved"), note),
    ]
    return Course(new_faults, new_alerts, parts[0].unionByName(parts[1]).unionByName(parts[2]))
