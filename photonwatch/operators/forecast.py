"""Forecasts of many series at once, and the rules that read them.

A model is additive: a piecewise-linear trend plus daily and weekly Fourier
terms.  Fitting needs only sums of products per (node, metric), so a series may
hold any share of the rows: tasks sum what they see and Spark adds the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions.rules import RULE_SETS
from photonwatch.functions.scores import change_percent

# Metrics that get a forecast, and the rows a fit needs.
METRICS = ["qkdKeyRate", "qkdQber", "qkdVisibility", "temperature", "cpu_load", "memory_usage"]
MIN_POINTS, MIN_POINTS_KEY_RATE = 10, 48

# Model shape and priors.
CHANGE_POINTS, CHANGE_RANGE, CHANGE_PRIOR = 25, 0.8, 0.05
DAILY_ORDER, WEEKLY_ORDER, SEASON_PRIOR, TREND_PRIOR = 4, 3, 10.0, 5.0
INTERVAL_Z = 1.2816  # 80 %
DAY, WEEK = 86_400.0, 604_800.0

_BREAKS = [CHANGE_RANGE * (i + 1) / CHANGE_POINTS for i in range(CHANGE_POINTS)]
_WAVES = [(DAY, k) for k in range(1, DAILY_ORDER + 1)] + [(WEEK, k) for k in range(1, WEEKLY_ORDER + 1)]
TERMS = _SIZE = 2 + CHANGE_POINTS + 2 * len(_WAVES)

MODEL_SCHEMA = (
    "node_name string, metric string, points bigint, begin_s double, end_s double, y_scale double, "
    "coefficients array<double>, sigma double, change_size double"
)


def _design(x: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Model terms, one row per time: level, slope, slope changes, waves."""
    columns = [np.ones_like(x), x, *[np.maximum(x - b, 0.0) for b in _BREAKS]]
    for period, k in _WAVES:
        phase = 2.0 * np.pi * k * (seconds % period) / period
        columns += [np.sin(phase), np.cos(phase)]
    return np.column_stack(columns)


def _terms(x: Column, seconds: Column) -> list[Column]:
    """The same terms as column expressions."""
    terms = [F.lit(1.0), x, *[F.greatest(x - b, F.lit(0.0)) for b in _BREAKS]]
    for period, k in _WAVES:
        phase = F.lit(2.0 * np.pi * k / period) * (seconds % period)
        terms += [F.sin(phase), F.cos(phase)]
    return terms


def epoch_seconds(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1e6


def fit_models(series: DataFrame) -> DataFrame:
    """One model per (node, metric) from the long series (node_name, timestamp, metric, value)."""
    keys = ["node_name", "metric"]
    rows = series.withColumn("_s", epoch_seconds("timestamp"))
    ranges = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("_s").alias("begin_s"),
        F.max("_s").alias("end_s"),
        F.max(F.abs("value")).alias("_top"),
    )
    enough = F.when(F.col("metric") == "qkdKeyRate", MIN_POINTS_KEY_RATE).otherwise(MIN_POINTS)
    ranges = ranges.filter((F.col("points") >= enough) & (F.col("end_s") > F.col("begin_s"))).withColumn(
        "y_scale", F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    ).drop("_top")
    ready = scale.beside(rows, ranges, keys).select(
        *keys,
        "_s",
        ((F.col("_s") - F.col("begin_s")) / (F.col("end_s") - F.col("begin_s"))).alias("_x"),
        (F.col("value") / F.col("y_scale")).alias("_y"),
    )
    upper = np.triu_indices(_SIZE + 1)

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = [(*key, total[upper]) for key, total in sums.items()]
            sums.clear()
            return pd.DataFrame(out, columns=[*keys, "sums"])

        for part in parts:
            for key, rows in part.groupby(keys, sort=False):
                terms = _design(rows["_x"].to_numpy(), rows["_s"].to_numpy())
                both = np.column_stack([terms, rows["_y"].to_numpy()])
                sums[key] = sums.get(key, 0.0) + both.T @ both
            if len(sums) > 2_000:
                yield flush()
        if sums:
            yield flush()

    partial = ready.mapInPandas(products, "node_name string, metric string, sums array<double>")
    summed = (
        partial.select(*keys, F.posexplode("sums").alias("place", "part"))
        .groupBy(*keys, "place")
        .agg(F.sum("part").alias("total"))
        .join(ranges, keys)
    )

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((_SIZE + 1, _SIZE + 1))
        total[upper] = pdf.sort_values("place")["total"].to_numpy()
        total = total + np.triu(total, 1).T
        first = pdf.iloc[0]
        coefficients, sigma = _solve(total[:-1, :-1], total[:-1, -1], total[-1, -1], int(first["points"]))
        changes = np.abs(coefficients[2 : 2 + CHANGE_POINTS])
        return pd.DataFrame(
            [
                {
                    "node_name": key[0],
                    "metric": key[1],
                    **{c: first[c] for c in ("points", "begin_s", "end_s", "y_scale")},
                    "coefficients": coefficients,
                    "sigma": sigma,
                    "change_size": float(changes.mean()),
                }
            ]
        )

    return summed.groupBy(*keys).applyInPandas(solve, MODEL_SCHEMA)


_SPARSE = np.arange(2, 2 + CHANGE_POINTS)
_DENSE = np.setdiff1d(np.arange(_SIZE), _SPARSE)


def _sparse_changes(products: np.ndarray, aims: np.ndarray, price: float, start: np.ndarray) -> np.ndarray:
    """Slope changes by coordinate descent: each takes its best value, pulled to zero by ``price``, until none moves."""
    changes, slopes = start.copy(), np.diag(products)
    for _ in range(2_000):
        most = 0.0
        for j in np.flatnonzero(slopes > 0):
            pull = aims[j] - products[j] @ changes + slopes[j] * changes[j]
            new = np.sign(pull) * max(abs(pull) - price, 0.0) / slopes[j]
            most = max(most, abs(new - changes[j]))
            changes[j] = new
        if most < 1e-9:
            break
    return changes


def _solve(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple[np.ndarray, float]:
    """Most likely coefficients: Laplace prior on slope changes, normal priors on level, slope and waves.

    For given changes the rest has a closed form, so it is taken out of the
    products first and only the changes are searched.  Most of them become
    exactly zero.  The noise level that scales the priors is found by iteration.
    """
    spread = np.where(_DENSE < 2, TREND_PRIOR, SEASON_PRIOR)
    noise, changes = max(yy / n, 1e-12) * 0.01, np.zeros(CHANGE_POINTS)
    across, coefficients = xx[np.ix_(_SPARSE, _DENSE)], np.zeros(_SIZE)
    for _ in range(5):
        dense = xx[np.ix_(_DENSE, _DENSE)] + np.diag(noise / spread**2) + 1e-10 * np.eye(len(_DENSE))
        inner = np.linalg.solve(dense, np.column_stack([across.T, xy[_DENSE]]))
        left = xx[np.ix_(_SPARSE, _SPARSE)] - across @ inner[:, :-1] + 1e-10 * np.eye(CHANGE_POINTS)
        changes = _sparse_changes(left, xy[_SPARSE] - across @ inner[:, -1], noise / CHANGE_PRIOR, changes)
        coefficients[_SPARSE], coefficients[_DENSE] = changes, inner[:, -1] - inner[:, :-1] @ changes
        rest = yy - 2 * coefficients @ xy + coefficients @ xx @ coefficients
        noise = max(rest / n, 1e-12)
    return coefficients, float(np.sqrt(noise))


def predict(models: DataFrame, days: int = 7) -> DataFrame:
    """Hourly forecast from one hour after the last training row: step, ds, yhat and its 80 % range.

    Column expressions only.  The range covers the noise and the chance of
    further slope changes, as many per time and as large as seen in training.
    """
    step = F.col("step")
    rows = models.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days * 24))))
    seconds = F.col("end_s") + step * 3600.0
    rows = rows.withColumns(
        {"_s": seconds, "_x": (seconds - F.col("begin_s")) / (F.col("end_s") - F.col("begin_s"))}
    )
    value = F.lit(0.0)
    for i, term in enumerate(_terms(F.col("_x"), F.col("_s"))):
        value = value + F.col("coefficients")[i] * term
    ahead = F.col("_x") - 1.0
    rate = CHANGE_POINTS / CHANGE_RANGE
    drift = 2.0 * rate * F.pow("change_size", F.lit(2.0)) * F.pow(ahead, F.lit(3.0)) / 3.0
    reach = INTERVAL_Z * F.sqrt(F.pow("sigma", F.lit(2.0)) + drift)
    size = F.col("y_scale")
    return rows.select(
        "node_name",
        "metric",
        "step",
        F.timestamp_micros((F.col("_s") * 1e6).cast("bigint")).cast("timestamp_ntz").alias("ds"),
        (value * size).alias("yhat"),
        ((value - reach) * size).alias("yhat_lower"),
        ((value + reach) * size).alias("yhat_upper"),
    )


def missing_models(series: DataFrame, models: DataFrame, force: bool = False) -> DataFrame:
    """The series that have no stored model yet (all of them with ``force``)."""
    return series if force else series.join(models.select("node_name", "metric"), ["node_name", "metric"], "left_anti")


# -- reading forecasts -----------------------------------------------------------


def outlook(forecast: DataFrame, current: DataFrame) -> DataFrame:
    """Per node and metric: current and predicted mean, change in percent, lowest bound.

    ``current``: node_name, metric, current_avg (the mean of the last 24 rows).
    """
    ahead = forecast.groupBy("node_name", "metric").agg(
        F.avg("yhat").alias("predicted_avg"), F.min("yhat_lower").alias("min_predicted")
    )
    return ahead.join(current, ["node_name", "metric"]).withColumn(
        "change_pct", change_percent(F.col("current_avg"), F.col("predicted_avg"))
    )


def forecast_direction(forecast: DataFrame, band: float = 0.02) -> DataFrame:
    """First half of the forecast against the second, stable within ``band``."""
    steps = forecast.groupBy("node_name", "metric").agg(F.max("step").alias("_n"))
    half = F.floor(F.col("_n") / 2)
    means = (
        forecast.join(steps, ["node_name", "metric"])
        .groupBy("node_name", "metric")
        .agg(
            F.avg(F.when(F.col("step") <= half, F.col("yhat"))).alias("first_half"),
            F.avg(F.when(F.col("step") > half, F.col("yhat"))).alias("second_half"),
        )
    )
    first, second = F.col("first_half"), F.col("second_half")
    trend = (
        F.when(first.isNull() | (F.abs(second - first) / first < band), "stable")
        .when(second > first, "increasing")
        .otherwise("decreasing")
    )
    return means.withColumn("trend", trend)


def network_summary(forecast: DataFrame, current: DataFrame) -> DataFrame:
    """Key rate per node: now, predicted, trend, change."""
    rate = F.col("metric") == "qkdKeyRate"
    return (
        outlook(forecast.filter(rate), current)
        .join(forecast_direction(forecast.filter(rate)), ["node_name", "metric"])
        .select(
            "node_name",
            F.round("current_avg", 2).alias("current_rate"),
            F.round("predicted_avg", 2).alias("predicted_rate"),
            "trend",
            F.round("change_pct", 2).alias("change_pct"),
        )
    )


def _texts(*options: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*options)), "; ")


def rate_summary(outlooks: DataFrame) -> DataFrame:
    """Trend, strength, risk, insights and recommendations for the key rate of each node."""
    limits = {rule.metric: rule.limit for rule in RULE_SETS["forecast_rate"]}
    critical, warning = limits["critical"], limits["warning"]
    change, predicted, low = F.col("change_pct"), F.col("predicted_avg"), F.col("min_predicted")
    trend = F.when(F.abs(change) < 2, "stable").when(change > 2, "increasing").otherwise("decreasing")
    strength = (
        F.when(F.abs(change) < 2, "weak")
        .when((change > 10) | (change < -10), "strong")
        .otherwise("moderate")
    )
    rows = outlooks.filter(F.col("metric") == "qkdKeyRate").withColumns({"trend": trend, "trend_strength": strength})
    falls = predicted < F.col("current_avg") * 0.8
    risk = F.when(low < critical, "critical").when(low < warning, "high").when(falls, "medium").otherwise("low")
    factor = (
        F.when(low < critical, "Key-rate may drop below critical threshold")
        .when(low < warning, "Key-rate approaching minimum operational levels")
        .when(falls, "Significant decrease in key generation predicted")
        .otherwise("")
    )
    size = F.format_string("%.1f", F.abs(change))
    headline = (
        F.when(
            F.col("trend") == "stable",
            F.concat(F.lit("Key-rate expected to remain stable around "), F.format_string("%.0f", predicted), F.lit(" bps")),
        )
        .when(F.col("trend") == "increasing", F.concat(F.lit("Key-rate predicted to increase by "), size, F.lit("% over forecast period")))
        .otherwise(F.concat(F.lit("Key-rate predicted to decrease by "), size, F.lit("% over forecast period")))
    )
    level = F.when(predicted < critical, "CRITICAL: Predicted key-rate may fall below minimum operational threshold").when(
        predicted < warning, "WARNING: Key-rate trending toward lower operational range"
    )
    down = F.col("trend") == "decreasing"
    return rows.select(
        "node_name",
        "trend",
        "trend_strength",
        F.round(change, 2).alias("change_percentage"),
        risk.alias("risk"),
        factor.alias("risk_factors"),
        F.round(low, 2).alias("min_predicted_rate"),
        _texts(headline, level).alias("insights"),
        _texts(
            F.when(down, "Schedule maintenance check to address declining performance"),
            F.when(down, "Monitor quantum channel parameters closely"),
            F.when(predicted < critical, "URGENT: Plan for backup key distribution methods"),
            F.when(predicted < critical, "Alert network operations team immediately"),
            F.when((predicted >= critical) & (predicted < warning), "Prepare contingency protocols"),
        ).alias("recommendations"),
    )


def _wide(outlooks: DataFrame) -> DataFrame:
    """One row per node: predicted mean and change of every metric."""
    return outlooks.groupBy("node_name").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{short}")
            for m in METRICS
            for c, short in (("predicted_avg", "p"), ("change_pct", "c"))
        ]
    )


def insights(outlooks: DataFrame) -> DataFrame:
    """Warnings, advice and risk per node over all metrics.

    ``risk`` keeps the rule order, where a later rule replaces an earlier one;
    ``max_risk`` is the highest level any rule gave.
    """
    p = {m: F.col(f"{m}_p") for m in METRICS}
    c = {m: F.col(f"{m}_c") for m in METRICS}
    drop, rise = c["qkdKeyRate"] < -10, c["qkdKeyRate"] > 10
    qber_high = p["qkdQber"] > 0.05
    qber_rise = ~qber_high & (c["qkdQber"] > 20)
    hot = p["temperature"] > 60
    warming = ~hot & (c["temperature"] > 15)
    cpu, memory = p["cpu_load"] > 80, p["memory_usage"] > 85
    together = (c["temperature"] > 10) & (c["qkdQber"] > 10)

    def shown(before: str, value: Column, digits: int, after: str) -> Column:
        return F.concat(F.lit(before), F.format_string(f"%.{digits}f", value), F.lit(after))

    warnings = _texts(
        F.when(drop, shown("Key rate predicted to drop by ", F.abs(c["qkdKeyRate"]), 1, "%")),
        F.when(qber_high, shown("QBER trending toward critical level: ", p["qkdQber"], 4, "")),
        F.when(qber_rise, shown("QBER increasing by ", c["qkdQber"], 1, "%")),
        F.when(hot, shown("Temperature approaching critical: ", p["temperature"], 1, "°C")),
        F.when(warming, shown("Temperature rising by ", c["temperature"], 1, "%")),
        F.when(cpu, shown("CPU load approaching maximum: ", p["cpu_load"], 1, "%")),
        F.when(memory, shown("Memory usage critical: ", p["memory_usage"], 1, "%")),
        F.when(together, "Temperature and QBER both increasing - possible correlation"),
    )
    advice = _texts(
        F.when(drop, "Monitor quantum channel parameters closely"),
        F.when(qber_high, "Schedule quantum channel maintenance"),
        F.when(hot, "Check cooling systems immediately"),
        F.when(warming, "Monitor cooling system performance"),
        F.when(cpu, "Consider load balancing or system optimization"),
        F.when(memory, "Investigate memory leaks or increase capacity"),
        F.when(together, "Priority: Address temperature issues to prevent QBER degradation"),
    )
    calm = F.concat(F.lit("All metrics stable for "), "node_name")
    summary = F.when(rise, shown("Key rate improving by ", c["qkdKeyRate"], 1, "%"))
    risk = (
        F.when(memory, "high").when(cpu, "medium").when(hot, "high").when(qber_high, "high").when(qber_rise, "medium").when(drop, "high")
    )
    top = F.when(memory | hot | qber_high | drop, "high").when(cpu | qber_rise, "medium")
    out = _wide(outlooks).select(
        "node_name",
        summary.alias("_summary"),
        warnings.alias("warnings"),
        advice.alias("recommendations"),
        F.coalesce(risk, F.lit("low")).alias("risk"),
        F.coalesce(top, F.lit("low")).alias("max_risk"),
    )
    text = F.coalesce("_summary", F.when(F.col("warnings") == "", calm).otherwise(""))
    return out.withColumn("summary", text).drop("_summary")


def short_insights(outlooks: DataFrame) -> DataFrame:
    """Shorter rule set: risk by the number of warnings."""
    p = {m: F.col(f"{m}_p") for m in METRICS}
    hits = {
        "qber": p["qkdQber"] > 0.05,
        "temperature": p["temperature"] > 45,
        "cpu": p["cpu_load"] > 80,
        "rate": F.col("qkdKeyRate_c") < -10,
    }
    count = sum((F.coalesce(hit, F.lit(False)).cast("int") for hit in hits.values()), F.lit(0))
    risk = F.when(count > 2, "high").when(count > 0, "medium").otherwise("low")
    rows = _wide(outlooks).withColumns({"warnings": count, "risk": risk})
    return rows.select(
        "node_name",
        "warnings",
        "risk",
        _texts(
            F.when(F.col("risk") != "low", "Schedule system maintenance check"),
            F.when(hits["qber"], "Check optical alignment and clean components"),
            F.when(hits["temperature"], "Verify cooling system operation"),
        ).alias("recommendations"),
    )


def model_freshness(models: DataFrame, as_of: Column) -> DataFrame:
    """Age of every model (column ``trained_at``) and what to do about it."""
    age = (epoch_seconds(as_of) - epoch_seconds("trained_at")) / 3600.0
    rows = models.select("node_name", "metric", age.alias("age_hours"))
    hours = F.col("age_hours")
    return rows.withColumns(
        {
            "stale": hours > 24,
            "advice": F.when(hours > 168, "URGENT").when(hours > 72, "Recommended").otherwise(""),
        }
    )


def freshness_summary(freshness: DataFrame) -> DataFrame:
    out = freshness.agg(F.count(F.lit(1)).alias("total_models"), F.count_if("stale").alias("stale_models"))
    return out.withColumn("status", F.when(F.col("stale_models") > 0, "needs_retraining").otherwise("up_to_date"))


def numbered(series: DataFrame) -> DataFrame:
    """Number the rows of a long series by time (``step`` from 1)."""
    rows = series.withColumn("_bucket", F.unix_date(F.col("timestamp").cast("date")))
    rows = scale.spread(rows, ["node_name", "metric"], "_bucket")
    return scale.split_row_number(rows, ["node_name", "metric"], "_bucket", [F.col("timestamp")], "step").drop("_bucket")
