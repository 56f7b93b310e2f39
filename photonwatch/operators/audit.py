"""Audit logs: names joined in, searched, paged, exported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.operators.filters import placeholder
from photonwatch.operators.incidents import with_component

# Columns a search looks at, per log.
SEARCH_COLUMNS = {
    "sessions": ["status", "source_node_id", "destination_node_id", "session_id"],
    "policy": ["action_type", "changed_by_name", "notes", "outcome"],
    "topology": ["action_type", "performed_by_name", "notes"],
    "alert": ["action_type", "performed_by_name", "notes", "outcome"],
    "fault": ["fault_code", "performed_by_name", "notes", "outcome"],
    "user": ["action_type", "performed_by_name", "notes", "outcome"],
}

# Internal columns an export leaves out, per log.
EXPORT_DROPS = {
    "sessions": ["id"],
    "policy": ["id", "policy_id", "changed_by"],
    "topology": ["id", "performed_by", "component_id", "component_type"],
    "alert": ["id", "user_id"],
    "fault": ["id", "user_id"],
    "user": ["id", "user_id"],
}


def _people(users: DataFrame, key: str, name: str) -> DataFrame:
    return users.select(F.col("uuid").alias(key), F.col("name").alias(name))


def policy_audit(log: DataFrame, policies: DataFrame, users: DataFrame) -> DataFrame:
    """Left joins on both sides; a lost policy is shown as unknown."""
    named = policies.select(F.col("id").alias("policy_id"), "policy_name")
    return (
        log.withColumnRenamed("performed_by", "changed_by")
        .join(named, "policy_id", "left")
        .join(_people(users, "changed_by", "changed_by_name"), "changed_by", "left")
        .withColumn("policy_name", placeholder("policy_name", "Unknown Policy"))
    )


def topology_audit(log: DataFrame, users: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    named = log.join(_people(users, "performed_by", "performed_by_name"), "performed_by", "left")
    return with_component(named, links, nodes, unknown="Unknown Component")


def _referenced_audit(
    log: DataFrame, things: DataFrame, users: DataFrame, links: DataFrame, nodes: DataFrame, kind: str
) -> DataFrame:
    """A log about faults or alerts: unknown things stay, unknown users go."""
    key, code = f"{kind}_id", f"{kind}_code"
    refs = things.select(
        F.col("id").alias(key), F.col(key).alias(code), "component_type", "component_id"
    )
    named = (
        log.drop("component_type", "component_id")
        .join(refs, key, "left")
        .join(_people(users, "performed_by", "performed_by_name"), "performed_by")
        .withColumn(code, placeholder(code, f"Unknown {kind.title()}"))
    )
    return with_component(named, links, nodes)


def fault_audit(log: DataFrame, faults: DataFrame, users: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    return _referenced_audit(log, faults, users, links, nodes, "fault")


def alert_audit(log: DataFrame, alerts: DataFrame, users: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    return _referenced_audit(log, alerts, users, links, nodes, "alert")


def user_audit(log: DataFrame, users: DataFrame) -> DataFrame:
    return log.join(_people(users, "performed_by", "performed_by_name"), "performed_by")


def session_listing(sessions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sessions with the names of both ends."""
    src = nodes.select(F.col("id").alias("source_node"), F.col("node_id").alias("source_node_id"))
    dst = nodes.select(F.col("id").alias("destination_node"), F.col("node_id").alias("destination_node_id"))
    return sessions.join(src, "source_node").join(dst, "destination_node")


def export_view(df: DataFrame, log: str) -> DataFrame:
    return df.drop(*EXPORT_DROPS[log])
