"""Scores, bands and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and caps of the link score.
WEIGHTS = {"qber": 0.4, "visibility": 0.3, "key_rate": 0.1, "photon_loss": 0.2}
QBER_CAP = 11.0
KEY_RATE_CAP = 10.0


def _raw_instability(qber: Column, visibility: Column, key_rate: Column, loss: Column) -> Column:
    bad_qber = F.least(qber / QBER_CAP, F.lit(1.0))
    bad_visibility = 1 - visibility / 100
    bad_rate = F.greatest(1 - key_rate / KEY_RATE_CAP, F.lit(0.0))
    return (
        bad_qber * WEIGHTS["qber"]
        + bad_visibility * WEIGHTS["visibility"]
        + bad_rate * WEIGHTS["key_rate"]
        + loss / 100 * WEIGHTS["photon_loss"]
    ) * 100


def instability(qber="qber", visibility="visibility", key_rate="key_rate", photon_loss="photon_loss") -> Column:
    """0 (calm) to 100 (unstable), two decimals."""
    return F.round(_raw_instability(*map(F.col, (qber, visibility, key_rate, photon_loss))), 2)


def quality_index(qber="qber", visibility="visibility", key_rate="key_rate", photon_loss="photon_loss") -> Column:
    """The complement of the instability, two decimals."""
    return F.round(100 - _raw_instability(*map(F.col, (qber, visibility, key_rate, photon_loss))), 2)


def quality_band(index: Column) -> Column:
    return F.when(index < 40, "Critical").when(index < 70, "Warning").otherwise("Healthy")


def instability_band(score: Column) -> Column:
    return F.when(score < 30, "Healthy").when(score < 60, "Warning").otherwise("Critical")


def fault_status(score: Column, is_outlier: Column, violations: Column) -> tuple[Column, Column]:
    """Status and severity from the anomaly decision and the number of broken limits."""
    fault = is_outlier | (violations > 0)
    severity = (
        F.when(~fault, "NONE")
        .when((score < -0.3) | (violations >= 3), "HIGH")
        .when((score < -0.1) | (violations >= 1), "MEDIUM")
        .otherwise("LOW")
    )
    return F.when(fault, "fault").otherwise("normal"), severity


def anomaly_confidence(score: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(score) * 2)


def rate_verdict(percent: Column) -> Column:
    return F.when(percent > 10, "high").when(percent < 5, "low").otherwise("moderate")


def change_percent(current: Column, predicted: Column) -> Column:
    return F.when(current > 0, (predicted - current) / current * 100).otherwise(F.lit(0.0))


def link_type_of(source_type: Column, destination_type: Column) -> Column:
    both = (source_type == "QKD") & (destination_type == "QKD")
    return F.when(both, "Quantum").otherwise("Classical")
