"""Faults and alerts: lookups, day series, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch.operators.filters import placeholder


def with_component(df: DataFrame, links: DataFrame, nodes: DataFrame, unknown: str | None = None) -> DataFrame:
    """Name of a polymorphic component: a link, a node, else ``unknown``.

    Without ``unknown`` every type other than Link is read as a node.
    """
    link_names = links.select(
        F.lit("Link").alias("component_type"), F.col("id").alias("component_id"), F.col("link_id").alias("component")
    )
    kind = F.col("component_type")
    if unknown is None:
        df = df.withColumn("_kind", F.when(kind == "Link", kind).otherwise("Node"))
    else:
        df = df.withColumn("_kind", kind)
    names = link_names.unionByName(
        nodes.select(
            F.lit("Node").alias("component_type"), F.col("id").alias("component_id"), F.col("node_id").alias("component")
        )
    ).withColumnRenamed("component_type", "_kind")
    out = df.join(names, ["_kind", "component_id"], "left").drop("_kind")
    return out if unknown is None else out.withColumn("component", placeholder("component", unknown))


def with_user_names(df: DataFrame, users: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Left-join a user name per column: source -> (new column, placeholder)."""
    for source, (name, missing) in columns.items():
        people = users.select(F.col("uuid").alias(source), F.col("name").alias(name))
        df = df.join(people, source, "left").withColumn(name, placeholder(name, missing))
    return df


def fault_list(faults: DataFrame, links: DataFrame, nodes: DataFrame, users: DataFrame) -> DataFrame:
    """Every fault with component and the three people involved by name."""
    return with_user_names(
        with_component(faults, links, nodes),
        users,
        {
            "acknowledged_by": ("acknowledged_by_name", "Not acknowledged"),
            "resolved_by": ("resolved_by_name", "Not resolved"),
            "assigned_to": ("assigned_to_name", "Not assigned"),
        },
    )


def day_spine(df: DataFrame, as_of: Column, days: int = 5) -> DataFrame:
    """The last ``days`` dates, oldest first, as a one-column frame."""
    last = as_of.cast("date")
    return df.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")
    )


def per_day(facts: DataFrame, ts: str, as_of: Column, measures: list[Column], days: int = 5) -> DataFrame:
    """Aggregate facts on each of the last days; days without facts stay.

    Facts are cut to the span first (pushed to the scan) and aggregated before
    the spine is joined, so that only ``days`` rows meet.
    """
    last = as_of.cast("date")
    span = (F.col(ts) >= F.date_sub(last, days - 1).cast("timestamp_ntz")) & (
        F.col(ts) < F.date_add(last, 1).cast("timestamp_ntz")
    )
    daily = facts.filter(span).groupBy(F.col(ts).cast("date").alias("day")).agg(*measures)
    return day_spine(facts, as_of, days).join(daily, "day", "left")


def faults_per_day(faults: DataFrame, as_of: Column) -> DataFrame:
    return per_day(faults, "detected_at", as_of, [F.count(F.lit(1)).alias("num_faults")]).fillna(0, ["num_faults"])


def resolved_per_day(faults: DataFrame, as_of: Column) -> DataFrame:
    done = faults.filter(F.col("status") == "Resolved")
    return per_day(done, "resolved_at", as_of, [F.count(F.lit(1)).alias("num_resolved")]).fillna(0, ["num_resolved"])


def keys_per_day(keys: DataFrame, as_of: Column) -> DataFrame:
    out = per_day(
        keys,
        "timestamp",
        as_of,
        [F.sum("keys_generated").alias("keys_generated"), F.sum("keys_consumed").alias("keys_consumed")],
    )
    return out.fillna(0.0, ["keys_generated", "keys_consumed"])


ALERT_TYPES = {
    "Low Visibility": "low_visibility_count",
    "Low Key Pool": "low_key_pool_count",
    "High Photon Loss": "high_photon_loss_count",
    "QBER Spike": "high_qber_count",
}


def alerts_per_day(alerts: DataFrame, as_of: Column) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("total_alerts")]
    measures += [F.count_if(F.col("type") == kind).alias(name) for kind, name in ALERT_TYPES.items()]
    return per_day(alerts, "detected_at", as_of, measures).fillna(0)


def active_fault_stats(faults: DataFrame) -> DataFrame:
    """Unresolved faults; the sums are null when there are none."""
    return faults.filter(F.col("status") != "Resolved").agg(
        F.count(F.lit(1)).alias("num_active"),
        F.sum(F.when(F.col("severity") == "Critical", 1).otherwise(0)).alias("critical"),
        F.sum(F.when(F.col("severity") == "Warning", 1).otherwise(0)).alias("warning"),
        F.sum(F.when(F.col("alert_id").isNotNull(), 1).otherwise(0)).alias("escalated"),
    )


def hours_between(start: str, end: str) -> Column:
    micros = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return micros / F.lit(3.6e9)


def mean_times(faults: DataFrame) -> DataFrame:
    """Mean hours to resolve and to acknowledge resolved faults; 0 when none."""
    done = faults.filter(F.col("status") == "Resolved")

    def mean(end: str) -> Column:
        return F.coalesce(F.round(F.avg(hours_between("detected_at", end)), 2), F.lit(0.0))

    return done.agg(mean("resolved_at").alias("mttr_hours"), mean("acknowledged_at").alias("mtta_hours"))


def top_components(faults: DataFrame, links: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """Components with most unresolved faults; counted by id first, named after."""
    counted = (
        faults.filter(F.col("status") != "Resolved")
        .groupBy("component_type", "component_id")
        .agg(F.count(F.lit(1)).alias("num_faults"))
    )
    return (
        with_component(counted, links, nodes)
        .groupBy("component")
        .agg(F.sum("num_faults").alias("num_faults"))
        .orderBy(F.col("num_faults").desc(), "component")
        .limit(k)
    )


def open_alert_stats(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") != "Resolved").agg(
        F.count(F.lit(1)).alias("num_alerts"),
        F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.count_if(F.col("severity") == "Warning").alias("warning"),
    )


def alarm_summary(faults: DataFrame) -> DataFrame:
    """Counts by status and severity in one pass."""
    return faults.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Open", "Ongoing", "Resolved")],
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "Warning", "Info")],
        F.count_if((F.col("severity") == "Critical") & (F.col("status") != "Resolved")).alias("unresolved_critical"),
    )
