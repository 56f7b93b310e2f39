"""Fixed rule tables: thresholds, weights, recommendation texts, labels."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Limit(NamedTuple):
    metric: str
    kind: str  # "max" or "min"
    limit: float


# Five threshold sets, kept apart because they disagree.
RULE_SETS: dict[str, list[Limit]] = {
    "config_production": [
        Limit("qkdQber", "max", 0.05),
        Limit("qkdKeyRate", "min", 1000.0),
        Limit("qkdVisibility", "min", 0.90),
        Limit("qkdLaserPower", "min", 0.8),
        Limit("neCpuLoad", "max", 70.0),
        Limit("neMemUsage", "max", 85.0),
        Limit("neTemperature", "max", 65.0),
    ],
    "fault_default": [
        Limit("qkdQber", "max", 0.06),
        Limit("qkdKeyRate", "min", 900.0),
        Limit("qkdVisibility", "min", 0.85),
        Limit("qkdLaserPower", "min", 0.5),
        Limit("neCpuLoad", "max", 80.0),
        Limit("neMemUsage", "max", 90.0),
        Limit("neTemperature", "max", 75.0),
    ],
    "security_overview": [
        Limit("qber", "max", 8.0),
        Limit("visibility", "min", 85.0),
        Limit("photon_loss", "max", 20.0),
        Limit("key_rate", "min", 15.0),
        Limit("key_pool_remaining", "min", 3000.0),
    ],
    "forecast_rate": [
        Limit("critical", "min", 300.0),
        Limit("warning", "min", 600.0),
        Limit("optimal", "min", 1000.0),
    ],
}


class AlertRule(NamedTuple):
    entity: str  # "link" or "node"
    metric: str
    limit: float
    severity: str
    alert_type: str
    message: str


# Telemetry alert rules.
ALERT_RULES = [
    AlertRule("link", "qber", 0.04, "Critical", "High QBER", "QBER exceeded critical threshold"),
    AlertRule("node", "temperature", 45.0, "Warning", "High Temperature", "Node temperature above threshold"),
]

# Advice per violated metric.
ADVICE: dict[str, list[str]] = {
    "qkdQber": ["Check fiber optic alignment and cleanliness", "Verify laser stability and power levels"],
    "qkdKeyRate": ["Inspect photon detectors for degradation", "Check quantum channel attenuation"],
    "qkdVisibility": ["Recalibrate optical components", "Check for environmental vibrations"],
    "neTemperature": ["Check cooling system operation", "Verify thermal paste and heat sink contact"],
    "neCpuLoad": ["Review running processes and optimize", "Consider system resource upgrade"],
    "neMemUsage": ["Review running processes and optimize", "Consider system resource upgrade"],
}
ADVICE_HIGH_FIRST = "IMMEDIATE ACTION REQUIRED"
ADVICE_HIGH_LAST = "Consider emergency maintenance"
ADVICE_MEDIUM_LAST = "Schedule maintenance within 24 hours"
ADVICE_DEGRADING = [
    "Monitor system closely - trends showing degradation",
    "Schedule preventive maintenance",
]
ADVICE_NONE = "System operating normally"

# Which part of the network a metric speaks for.
LINK_METRICS = ["qkdQber", "qkdVisibility", "qkdLaserPower"]
NODE_METRICS = ["neCpuLoad", "neMemUsage", "neTemperature"]

# Defaults for readings that are missing or zero.
READING_DEFAULTS = {
    "powerConsumption": 100.0,
    "errorCount": 0,
    "qkdQber": 0.025,
    "qkdVisibility": 0.97,
    "qkdLaserPower": 10.0,
    "attenuation": 15.0,
    "detectorEfficiency": 0.1,
    "darkCountRate": 50.0,
    "nodePhotonLoss": 20.0,
}

# Defaults for model features that are absent when scoring.
FEATURE_DEFAULTS = {"attenuation": 15.0, "detectorEfficiency": 0.1, "secureKeyRate": 1000.0}

# Model features, and how many must be present to train.
FEATURES = [
    "qkdQber",
    "qkdKeyRate",
    "qkdVisibility",
    "qkdLaserPower",
    "neCpuLoad",
    "neMemUsage",
    "neTemperature",
    "attenuation",
    "detectorEfficiency",
    "secureKeyRate",
]
MIN_FEATURES = 7

# System-owned roles left out of reports.
SYSTEM_ROLES = ["Super Admin", "System Automation"]

# Alarm severities in display order.
ALARM_SEVERITIES = ["CRITICAL", "MAJOR", "MINOR", "WARNING", "INFO"]


def inline(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small constant table as a local relation (no Python job behind it)."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    types = [part.strip().split()[1] for part in schema.split(",")]
    values = F.array(
        *[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows]
    )
    return spark.range(1).select(F.inline(values))


def limit_structs(limits: Sequence[Limit]) -> Column:
    """One struct (metric, value, threshold, type, broken) per limit, over metric columns."""
    items = []
    for rule in limits:
        value = F.col(rule.metric).cast("double")
        broken = value > rule.limit if rule.kind == "max" else value < rule.limit
        items.append(
            F.struct(
                F.lit(rule.metric).alias("metric"),
                value.alias("value"),
                F.lit(float(rule.limit)).alias("threshold"),
                F.lit("exceeds" if rule.kind == "max" else "below").alias("type"),
                F.coalesce(broken, F.lit(False)).alias("broken"),
            )
        )
    return F.array(*items)
