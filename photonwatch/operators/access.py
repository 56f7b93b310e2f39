"""Users, roles, permissions, sessions, logins and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions.rules import SYSTEM_ROLES


def users_with_permission(
    users: DataFrame, roles: DataFrame, grants: DataFrame, permissions: DataFrame, permission: str
) -> DataFrame:
    """Usable accounts whose role carries the permission, Super Admin left out."""
    allowed = (
        roles.filter(F.col("role_name") != "Super Admin")
        .select(F.col("id").alias("role_id"))
        .join(grants, "role_id")
        .join(
            permissions.filter(F.col("permission_name") == permission).select(F.col("id").alias("permission_id")),
            "permission_id",
        )
        .select("role_id")
    )
    usable = users.filter(F.col("status").isin("Online", "Offline", "Locked"))
    return usable.join(allowed, "role_id", "left_semi").select("name", "uuid")


def permission_sets(users: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """Permission names of every user, as one sorted text.

    The set is built once per role (its size is the permission catalogue) and
    then joined to the users.
    """
    named = grants.join(permissions.select(F.col("id").alias("permission_id"), "permission_name"), "permission_id")
    sets = named.groupBy("role_id").agg(
        F.array_join(F.sort_array(F.collect_set("permission_name")), ",").alias("permissions")
    )
    return users.join(sets, "role_id").select("uuid", "name", "permissions")


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    return (
        sessions.filter(F.col("expires_at") > as_of)
        .join(users.select(F.col("uuid").alias("user_id"), "name", "status"), "user_id")
        .select("session_token", "user_id", "name", "status", "expires_at")
    )


def user_stats(users: DataFrame, as_of: Column) -> DataFrame:
    login = F.col("last_login")
    return users.agg(
        F.count("name").alias("total_users"),
        F.count_if(F.col("status") == "Locked").alias("locked"),
        F.count_if(F.col("status") == "Deactivated").alias("deactivated"),
        F.count_if(login < as_of - F.expr("interval 30 days")).alias("inactive_30_days"),
        F.count_if(login.cast("date") == as_of.cast("date")).alias("logged_in_today"),
    )


def role_stats(users: DataFrame, roles: DataFrame, as_of: Column) -> DataFrame:
    """Users per role, active within 7 days or not; never logged in is inactive."""
    week = F.date_sub(as_of.cast("date"), 7).cast("timestamp_ntz")
    counted = users.groupBy("role_id").agg(
        F.count("name").alias("user_count"),
        F.count_if(F.col("last_login") >= week).alias("active_count"),
        F.count_if(F.col("last_login").isNull() | (F.col("last_login") < week)).alias("inactive_count"),
    )
    named = roles.filter(~F.col("role_name").isin(SYSTEM_ROLES)).select(F.col("id").alias("role_id"), "role_name")
    return counted.join(named, "role_id").select("role_name", "user_count", "active_count", "inactive_count")


def permissions_per_role(roles: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    known = grants.join(permissions.select(F.col("id").alias("permission_id")), "permission_id", "left_semi")
    named = roles.filter(~F.col("role_name").isin(SYSTEM_ROLES)).select(F.col("id").alias("role_id"), "role_name")
    return known.join(named, "role_id").groupBy("role_name").agg(F.count(F.lit(1)).alias("permission_count"))


def role_catalogue(roles: DataFrame, users: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """Roles with permission and user counts (0 if none) and the permission list."""
    named = grants.join(permissions.select(F.col("id").alias("permission_id"), "permission_name"), "permission_id")
    rights = named.groupBy(F.col("role_id").alias("id")).agg(
        F.count(F.lit(1)).alias("permission_count"),
        F.array_join(F.sort_array(F.collect_set("permission_name")), ",").alias("permissions"),
    )
    people = users.groupBy(F.col("role_id").alias("id")).agg(F.count("name").alias("user_count"))
    return (
        roles.filter(~F.col("role_name").isin(SYSTEM_ROLES))
        .join(rights, "id", "left")
        .join(people, "id", "left")
        .select(
            "id",
            "role_name",
            F.coalesce("permission_count", F.lit(0)).alias("permission_count"),
            F.coalesce("user_count", F.lit(0)).alias("user_count"),
            F.coalesce("permissions", F.lit("")).alias("permissions"),
        )
    )


def pending_role_requests(users: DataFrame, requests: DataFrame, roles: DataFrame, viewer: int) -> DataFrame:
    """Users with their pending request; ``approval`` is false if the viewer raised it."""
    pending = (
        requests.filter(F.col("status") == "Pending Approval")
        .join(roles.select(F.col("id").alias("role_id"), F.col("role_name").alias("role_requested")), "role_id", "left")
        .select(
            F.col("assigned_to").alias("uuid"),
            F.col("id").alias("request_id"),
            "role_requested",
            "requested_by",
        )
    )
    return users.join(pending, "uuid", "left").select(
        "uuid",
        "name",
        "request_id",
        "role_requested",
        F.when(F.col("request_id").isNull() | (F.col("requested_by") == viewer), False).otherwise(True).alias("approval"),
    )


def lockouts(logins: DataFrame, limit: int = 5) -> DataFrame:
    """Users whose failures since the last success reach ``limit``.

    Two partial aggregates and one join that keeps a busy user's rows spread; no ordered window.
    """
    last = logins.groupBy("user_id").agg(
        F.max(F.when(F.col("success"), F.struct("ts", "event_id"))).alias("_good")
    )
    good = F.col("_good")
    after = (F.struct("ts", "event_id") > good) | good.isNull()
    return (
        scale.beside(logins.filter(~F.col("success")), last, ["user_id"])
        .filter(after)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last_failure"))
        .filter(F.col("failures") >= limit)
    )


def failure_streaks(logins: DataFrame, limit: int = 5) -> DataFrame:
    """Every run of failures between successes that reached ``limit``, and when it did."""
    timed = logins.withColumns(
        {"_bucket": scale.hour_bucket("ts"), "_good": F.col("success").cast("bigint")}
    )
    order = [F.col("ts"), F.col("event_id")]
    timed = scale.spread(timed, ["user_id"], "_bucket")
    marked = scale.split_running_sum(timed, ["user_id"], "_bucket", order, "_good", "run")
    failed = marked.filter(~F.col("success"))
    numbered = scale.split_row_number(failed, ["user_id", "run"], "_bucket", order, "attempt", total="failures")
    return numbered.filter(F.col("attempt") == limit).select(
        "user_id", "run", "failures", F.col("ts").alias("locked_at")
    )


def policy_detail(
    policies: DataFrame, rules: DataFrame, targets: DataFrame, nodes: DataFrame, links: DataFrame
) -> DataFrame:
    """Live policies with their rules and targets, one row per rule or target.

    Row form on purpose: a policy may own any number of rules.  Target names
    come from QKD nodes and quantum links, else ``Unknown``.
    """
    live = policies.filter(~F.col("is_deleted")).select(
        F.col("id").alias("policy_id"), "policy_name", "policy_type", "scope"
    )
    rule_rows = rules.select(
        "policy_id", F.lit("rule").alias("item"), F.col("metric").alias("label"), F.col("value")
    )
    names = (
        nodes.filter(F.col("type") == "QKD")
        .select(F.lit("Node").alias("target_type"), F.col("id").alias("target_id"), F.col("node_id").alias("label"))
        .unionByName(
            links.filter(F.col("link_type") == "Quantum").select(
                F.lit("Link").alias("target_type"), F.col("id").alias("target_id"), F.col("link_id").alias("label")
            )
        )
    )
    target_rows = targets.join(names, ["target_type", "target_id"], "left").select(
        "policy_id",
        F.lit("target").alias("item"),
        F.coalesce("label", F.lit("Unknown")).alias("label"),
        F.lit(None).cast("double").alias("value"),
    )
    return live.join(rule_rows.unionByName(target_rows), "policy_id")


def rules_of(rules: DataFrame, policies: DataFrame) -> DataFrame:
    """Rules whose policy is listed (the IN-list fetch as a semi join)."""
    return rules.join(policies.select(F.col("id").alias("policy_id")), "policy_id", "left_semi")


def weight_check(rules: DataFrame, weight: str = "weight", tolerance: float = 1e-5) -> DataFrame:
    """Do the weights of a policy add up to one?"""
    return rules.groupBy("policy_id").agg(
        F.round(F.sum(weight), 6).alias("weight_sum"),
        (F.abs(F.sum(weight) - 1) <= tolerance).alias("valid"),
    )


def condition_text(metric: str, value: str, seconds: int = 30) -> tuple[Column, Column]:
    """Sign of a policy rule and its clear condition: QBER and photon loss rise, the rest fall."""
    sign = F.when(F.lower(metric).isin("qber", "photon loss"), ">").otherwise("<")
    clear = F.concat_ws(" ", F.col(metric), sign, F.col(value).cast("string"), F.lit(f"for {seconds} seconds"))
    return sign, clear


def restrict(df: DataFrame, column: str, wanted: DataFrame | Sequence) -> DataFrame:
    """Keep rows whose column is in a list or in a one-column frame."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.toDF(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(wanted)))
