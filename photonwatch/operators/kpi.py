"""Network indicators and device counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch.functions.rules import RULE_SETS


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row aggregates side by side."""
    columns = [right.select(c).scalar().alias(c) for c in right.columns]
    return left.select("*", *columns)


def network_means(links: DataFrame, nodes: DataFrame) -> DataFrame:
    quality = links.filter(F.col("link_type") == "Quantum").agg(
        F.round(F.avg("qber"), 2).alias("average_qber"),
        F.round(F.avg("visibility"), 2).alias("average_visibility"),
        F.round(F.avg("key_rate"), 2).alias("average_keyrate"),
    )
    pools = nodes.filter(F.col("type") == "QKD").agg(
        F.sum("key_pool_remaining").alias("key_pool_remaining"), F.count(F.lit(1)).alias("number_of_nodes")
    )
    return _beside(quality, pools)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """Quotient, or 0 when the divisor is null or zero."""
    return F.when(F.coalesce(bottom, F.lit(0)) != 0, top / bottom).otherwise(F.lit(0.0))


def key_summary(keys: DataFrame, as_of: Column) -> DataFrame:
    """Totals of one day, efficiency in percent, retention weighted by keys generated."""
    day = as_of.cast("date")
    today = (F.col("timestamp") >= day.cast("timestamp_ntz")) & (
        F.col("timestamp") < F.date_add(day, 1).cast("timestamp_ntz")
    )
    sums = keys.filter(today).agg(
        F.sum("keys_generated").alias("total_keys_generated"),
        F.sum("keys_consumed").alias("total_keys_consumed"),
        F.sum("keys_expired").alias("total_keys_expired"),
        F.sum(F.col("avg_retention_time") * F.col("keys_generated")).alias("_weighted"),
    )
    made = F.col("total_keys_generated")
    return sums.select(
        "total_keys_generated",
        "total_keys_consumed",
        "total_keys_expired",
        F.round(guarded_ratio(F.col("total_keys_consumed"), made) * 100, 2).alias("key_efficiency"),
        F.round(guarded_ratio(F.col("_weighted"), made), 2).alias("weighted_avg_retention_time"),
    )


def breach_counters(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many quantum links and key pools stand beyond the overview limits."""
    limits = {rule.metric: rule for rule in RULE_SETS["security_overview"]}

    def breaches(metric: str) -> Column:
        rule, value = limits[metric], F.col(metric)
        return F.count_if(value > rule.limit if rule.kind == "max" else value < rule.limit).alias(f"{metric}_breaches")

    on_links = links.filter(F.col("link_type") == "Quantum").agg(
        *[breaches(m) for m in ("qber", "visibility", "photon_loss", "key_rate")]
    )
    on_nodes = nodes.filter(F.col("type") == "QKD").agg(breaches("key_pool_remaining"))
    return _beside(on_links, on_nodes)


def device_counts(nodes: DataFrame) -> DataFrame:
    created = F.col("state") == "Created"
    return nodes.agg(
        F.count_if(created).alias("created"),
        F.count_if(created & (F.col("status") == "Online")).alias("online"),
        F.count_if(F.col("state") == "Temporary").alias("temporary"),
    )


def document_totals(library: DataFrame) -> DataFrame:
    return library.filter(F.col("status") == "active").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")
    )
