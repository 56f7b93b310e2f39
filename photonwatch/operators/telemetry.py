"""Telemetry: history, joins of node and link series, gap filling, trends, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions.rules import FEATURES, READING_DEFAULTS
from photonwatch.operators.filters import default_if_empty, since, since_latest
from photonwatch.operators.topology import incidence

# Telemetry column -> name used by rules and models.
NODE_NAMES = {
    "cpu_usage": "neCpuLoad",
    "memory_usage": "neMemUsage",
    "temperature": "neTemperature",
    "aggregated_key_rate": "nodeKeyRate",
}
LINK_NAMES = {
    "qber": "qkdQber",
    "key_rate": "qkdKeyRate",
    "visibility": "qkdVisibility",
    "laser_power": "qkdLaserPower",
    "attenuation": "attenuation",
    "photon_loss": "nodePhotonLoss",
    "detector_efficiency": "detectorEfficiency",
    "secure_key_rate": "secureKeyRate",
}
FORECAST_LINK_NAMES = {
    "qber": "qkdQber",
    "key_rate": "qkdKeyRate",
    "visibility": "qkdVisibility",
    "laser_power": "qkdLaserPower",
    "secure_key_rate": "secure_key_rate",
}
FORECAST_NODE_NAMES = {
    "temperature": "temperature",
    "cpu_usage": "cpu_load",
    "memory_usage": "memory_usage",
    "aggregated_key_rate": "aggregated_key_rate",
}
TREND_METRICS = ["qkdQber", "qkdKeyRate", "neCpuLoad", "neTemperature"]


def qkd_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type") == "QKD").select("node_name").distinct().orderBy("node_name")


def link_names(links: DataFrame) -> DataFrame:
    return links.select("link_name").distinct().orderBy("link_name")


def nodes_with_telemetry(nodes: DataFrame, node_metrics: DataFrame) -> DataFrame:
    reporting = node_metrics.select("node_name").distinct()
    return nodes.filter(F.col("node_type") == "QKD").join(reporting, "node_name", "left_semi").select("node_name")


def node_history(node_metrics: DataFrame, as_of: Column, hours: int, node: str | None = None) -> DataFrame:
    """Rows of one node (or all) since ``as_of`` minus ``hours``; both filters reach the scan."""
    rows = since(node_metrics, "timestamp", as_of, hours)
    return rows if node is None else rows.filter(F.col("node_name") == node)


def _ends(links: DataFrame, link_type: str | None) -> DataFrame:
    kept = links if link_type is None else links.filter(F.col("link_type") == link_type)
    return incidence(kept, "node_name").select("node_name", "link_name")


def link_history(
    links: DataFrame,
    link_metrics: DataFrame,
    as_of: Column,
    hours: int,
    node: str | None = None,
    link_type: str | None = None,
) -> DataFrame:
    """Readings of all links that touch a node, one row per node and reading."""
    ends = _ends(links, link_type)
    if node is not None:
        ends = ends.filter(F.col("node_name") == node)
    return since(link_metrics, "timestamp", as_of, hours).join(ends, "link_name")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def mean_link_series(links: DataFrame, link_metrics: DataFrame, names: dict[str, str], link_type: str | None) -> DataFrame:
    """Mean link readings per node and time."""
    rows = link_metrics.join(_ends(links, link_type), "link_name")
    return rows.groupBy("node_name", "timestamp").agg(*[F.avg(c).alias(n) for c, n in names.items()])


def mean_node_series(node_metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    return node_metrics.groupBy("node_name", "timestamp").agg(*[F.avg(c).alias(n) for c, n in names.items()])


def training_frame(
    nodes: DataFrame, links: DataFrame, node_metrics: DataFrame, link_metrics: DataFrame, as_of: Column, hours: int = 720
) -> DataFrame:
    """Node readings with the mean of their quantum links at exactly the same time.

    Link readings are averaged per (node, time) before the join, so that a node
    with many links does not multiply its own rows.
    """
    means = mean_link_series(links, since(link_metrics, "timestamp", as_of, hours), LINK_NAMES, "Quantum")
    qkd = nodes.filter(F.col("node_type") == "QKD").select("node_name")
    rows = since(node_metrics, "timestamp", as_of, hours).join(qkd, "node_name", "left_semi")
    rows = rows.select("node_name", "timestamp", *[F.col(c).alias(n) for c, n in NODE_NAMES.items()])
    return rows.join(means, ["node_name", "timestamp"], "left")


def recent_readings(
    links: DataFrame, node_metrics: DataFrame, link_metrics: DataFrame, hours: int, link_type: str | None = "Quantum"
) -> DataFrame:
    """Node rows of the last hours before each node's newest row, with the mean of
    link readings less than 60 seconds away (a band join on minute buckets)."""
    rows = since_latest(node_metrics, "node_name", "timestamp", hours)
    minute = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(60_000_000))
    near = (
        link_metrics.join(_ends(links, link_type), "link_name")
        .select(
            "node_name",
            F.col("timestamp").alias("_link_ts"),
            *[F.col(c).alias(n) for c, n in LINK_NAMES.items()],
            F.explode(F.array(minute - 1, minute, minute + 1)).alias("_minute"),
        )
    )
    rows = rows.withColumn("_minute", minute).alias("n")
    near = near.alias("l")
    apart = F.abs(
        F.unix_micros(F.col("n.timestamp").cast("timestamp")) - F.unix_micros(F.col("l._link_ts").cast("timestamp"))
    )
    same = (F.col("n.node_name") == F.col("l.node_name")) & (F.col("n._minute") == F.col("l._minute"))
    joined = rows.join(near, same & (apart < 60_000_000), "left")
    return joined.groupBy(F.col("n.node_name").alias("node_name"), F.col("n.timestamp").alias("timestamp")).agg(
        *[F.first(f"n.{c}").alias(n) for c, n in NODE_NAMES.items()],
        F.first("n.error_count").alias("errorCount"),
        *[F.avg(f"l.{n}").alias(n) for n in LINK_NAMES.values()],
    )


def _reading_defaults(df: DataFrame) -> DataFrame:
    """Null or zero readings take their default; rates fall back on the node's own rate."""
    fixed = {
        c: default_if_empty(c, F.lit(READING_DEFAULTS[c])).alias(c)
        for c in ("qkdQber", "qkdVisibility", "qkdLaserPower", "attenuation", "detectorEfficiency", "nodePhotonLoss", "errorCount")
        if c in df.columns
    }
    return df.withColumns(
        {
            **fixed,
            "qkdKeyRate": default_if_empty("qkdKeyRate", F.col("nodeKeyRate")),
            "secureKeyRate": default_if_empty("secureKeyRate", F.col("nodeKeyRate") * 0.9),
        }
    )


def recent_with_defaults(recent: DataFrame) -> DataFrame:
    return _reading_defaults(recent)


def latest_per_node(node_metrics: DataFrame) -> DataFrame:
    """Newest row of each node, by partial aggregation."""
    columns = [c for c in node_metrics.columns if c != "node_name"]
    newest = node_metrics.groupBy("node_name").agg(F.max_by(F.struct(*columns), "timestamp").alias("_row"))
    return newest.select("node_name", "_row.*")


def at_own_latest(link_metrics: DataFrame) -> DataFrame:
    """Every row at its link's newest time (ties stay)."""
    newest = link_metrics.groupBy("link_name").agg(F.max("timestamp").alias("timestamp"))
    return link_metrics.join(newest, ["link_name", "timestamp"])


def latest_link_means(links: DataFrame, link_metrics: DataFrame) -> DataFrame:
    """Per node: means over its quantum links' newest rows, in the newest time group only."""
    rows = at_own_latest(link_metrics).join(_ends(links, "Quantum"), "link_name")
    groups = rows.groupBy("node_name", "timestamp").agg(
        *[F.avg(c).alias(n) for c, n in LINK_NAMES.items()],
        F.count_distinct("link_name").alias("linkCount"),
        F.array_join(F.sort_array(F.collect_set("link_name")), ",").alias("connectedLinks"),
    )
    return scale.top_k(groups, ["node_name"], [F.col("timestamp").desc()], 1).drop("rank", "timestamp")


def snapshot(links: DataFrame, node_metrics: DataFrame, link_metrics: DataFrame) -> DataFrame:
    """Current readings of every node with defaults for what is missing."""
    node = latest_per_node(node_metrics).select(
        "node_name",
        "timestamp",
        *[F.col(c).alias(n) for c, n in NODE_NAMES.items()],
        F.col("error_count").alias("errorCount"),
    )
    joined = node.join(latest_link_means(links, link_metrics), "node_name", "left")
    return _reading_defaults(joined).withColumns(
        {
            "linkCount": F.coalesce("linkCount", F.lit(0)),
            "connectedLinks": F.coalesce("connectedLinks", F.lit("")),
        }
    )


def filled(df: DataFrame, columns: Sequence[str], key: str = "node_name", ts: str = "timestamp", newest_first: bool = False) -> DataFrame:
    """Forward then backward fill by time within each key; ``newest_first`` swaps the two."""
    rows = df.withColumn("_bucket", F.unix_date(F.col(ts).cast("date")))
    rows = scale.spread(rows, [key], "_bucket")
    return scale.split_fill_both(rows, [key], "_bucket", [ts], columns, newest_first).drop("_bucket")


def filled_with_mean(df: DataFrame, columns: Sequence[str], key: str = "node_name") -> DataFrame:
    """What is still missing takes the key's mean."""
    means = df.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return (
        df.join(means, key)
        .withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns})
        .drop(*[f"_m_{c}" for c in columns])
    )


def feature_matrix(frame: DataFrame, newest_first: bool = False) -> DataFrame:
    """The model features of a training frame, gaps filled.

    Filling in both directions leaves a gap only where a node never reported
    the feature, and then there is no mean either: the third step,
    :func:`filled_with_mean`, cannot change anything here and is left out.
    """
    rows = frame.select("node_name", "timestamp", *FEATURES)
    return filled(rows, FEATURES, newest_first=newest_first)


def forecast_series(
    links: DataFrame,
    node_metrics: DataFrame,
    link_metrics: DataFrame,
    as_of: Column,
    hours: int = 168,
    link_type: str | None = None,
) -> DataFrame:
    """Link and node means per node and time, outer-joined, fallbacks set, gaps filled."""
    link = mean_link_series(links, since(link_metrics, "timestamp", as_of, hours), FORECAST_LINK_NAMES, link_type)
    node = mean_node_series(since(node_metrics, "timestamp", as_of, hours), FORECAST_NODE_NAMES)
    merged = link.join(node, ["node_name", "timestamp"], "full_outer")
    linked = link.select("node_name").distinct().withColumn("_linked", F.lit(True))
    merged = merged.join(linked, "node_name", "left")
    alone = F.col("_linked").isNull()
    merged = merged.withColumns(
        {
            "qkdKeyRate": F.when(alone, F.coalesce("aggregated_key_rate", F.lit(1000.0))).otherwise(F.col("qkdKeyRate")),
            "qkdQber": F.when(alone, F.lit(0.025)).otherwise(F.col("qkdQber")),
            "qkdVisibility": F.when(alone, F.lit(0.97)).otherwise(F.col("qkdVisibility")),
        }
    ).drop("_linked")
    columns = [*FORECAST_LINK_NAMES.values(), *FORECAST_NODE_NAMES.values()]
    return filled(merged, columns)


def long_form(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(node_name, timestamp, metric, value) with nulls left out."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select("node_name", "timestamp", F.inline(pairs)).filter(F.col("value").isNotNull())


def half_split_trend(recent: DataFrame, metrics: Sequence[str] = tuple(TREND_METRICS)) -> DataFrame:
    """Older half against newer half per node and metric, with the direction rule of the metric.

    Rows are taken oldest first; ``current`` is the newest value.
    """
    rows = long_form(recent, metrics).withColumn("_bucket", F.unix_date(F.col("timestamp").cast("date")))
    keys = ["node_name", "metric"]
    rows = scale.split_row_number(rows, keys, "_bucket", [F.col("timestamp")], "_i", total="_n")
    mid = F.floor(F.col("_n") / 2)
    old, new = F.col("_older"), F.col("_newer")
    halves = (
        rows.filter(F.col("_n") >= 2)
        .groupBy(*keys)
        .agg(
            F.avg(F.when(F.col("_i") <= mid, F.col("value"))).alias("_older"),
            F.avg(F.when(F.col("_i") > mid, F.col("value"))).alias("_newer"),
            F.max_by("value", "timestamp").alias("current"),
            F.avg("value").alias("average"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    up, down = new > old * 1.1, new < old * 0.9
    direction = (
        F.when(
            F.col("metric") == "qkdQber",
            F.when(up, "deteriorating").when(down, "improving").otherwise("stable"),
        )
        .when(
            F.col("metric") == "qkdKeyRate",
            F.when(down, "deteriorating").when(up, "improving").otherwise("stable"),
        )
        .otherwise(F.when(F.abs(new - old) / (old + 0.001) > 0.2, "deteriorating").otherwise("stable"))
    )
    return halves.withColumn("direction", direction).drop("_older", "_newer")


def overall_trend(trends: DataFrame) -> DataFrame:
    worse = F.count_if(F.col("direction") == "deteriorating")
    better = F.count_if(F.col("direction") == "improving")
    vote = F.when(worse >= 2, "deteriorating").when(better >= 2, "improving").otherwise("stable")
    return trends.groupBy("node_name").agg(vote.alias("overall"), F.count(F.lit(1)).alias("metrics"))


def mean_of_last(series: DataFrame, n: int = 24) -> DataFrame:
    """Mean of the newest ``n`` values per node and metric (long form in)."""
    last = scale.top_k(series, ["node_name", "metric"], [F.col("timestamp").desc()], n)
    return last.groupBy("node_name", "metric").agg(F.avg("value").alias("current_avg"))


def series_stats(series: DataFrame) -> DataFrame:
    """Mean, sample deviation, range per node and metric (long form in)."""
    return series.groupBy("node_name", "metric").agg(
        F.count(F.lit(1)).alias("points"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def feature_ranges(matrix: DataFrame) -> DataFrame:
    return long_form(matrix, FEATURES).groupBy("node_name", "metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )


def coverage(metrics: DataFrame, entity: str) -> DataFrame:
    """Rows, distinct entities, first and last time."""
    return metrics.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(entity).alias("entities"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )
