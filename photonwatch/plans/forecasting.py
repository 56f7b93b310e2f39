"""Registered queries: forecast models, predictions, and the rules that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.operators import forecast, telemetry
from photonwatch.plans.fixtures import AS_OF_TELE, Tables, at
from photonwatch.plans.monitoring import _SERIES, _TELE, _series, rounded
from photonwatch.plans.registry import query
from photonwatch.session import cut_lineage
from photonwatch.sources import sinks

_METRICS = ", ".join(f'"{m}"' for m in forecast.METRICS)

# A stand-in forecast that SQL can state as well: the series itself, numbered,
# with a range of ten percent.  The fitted forecasts are checked in the tests.
_TOY = f"""
{_SERIES}, long AS (UNPIVOT series ON {_METRICS} INTO NAME metric VALUE value),
toy AS (SELECT node_name, metric, row_number() OVER (PARTITION BY node_name, metric ORDER BY timestamp) AS step, value AS yhat, value * 0.9 AS yhat_lower FROM long),
cur AS (SELECT node_name, metric, avg(value) AS current_avg FROM (SELECT *, row_number() OVER (PARTITION BY node_name, metric ORDER BY timestamp DESC) AS r FROM long) WHERE r <= 24 GROUP BY 1, 2),
ahead AS (SELECT node_name, metric, avg(yhat) AS predicted_avg, min(yhat_lower) AS min_predicted FROM toy GROUP BY 1, 2),
look AS (SELECT *, CASE WHEN current_avg > 0 THEN (predicted_avg - current_avg) / current_avg * 100 ELSE 0 END AS change_pct FROM ahead JOIN cur USING (node_name, metric)),
halves AS (SELECT node_name, metric, avg(yhat) FILTER (WHERE step <= n // 2) AS first_half, avg(yhat) FILTER (WHERE step > n // 2) AS second_half
  FROM (SELECT *, max(step) OVER (PARTITION BY node_name, metric) AS n FROM toy) GROUP BY 1, 2),
dir AS (SELECT *, CASE WHEN first_half IS NULL OR abs(second_half - first_half) / first_half < 0.02 THEN 'stable' WHEN second_half > first_half THEN 'increasing' ELSE 'decreasing' END AS trend FROM halves)"""


def _long(t: Tables) -> DataFrame:
    return telemetry.long_form(_series(t), forecast.METRICS)


def _toy(t: Tables) -> tuple[DataFrame, DataFrame]:
    long = cut_lineage(_long(t))
    rows = forecast.numbered(long).select(
        "node_name", "metric", "step", F.col("value").alias("yhat"), (F.col("value") * 0.9).alias("yhat_lower")
    )
    return rows, telemetry.mean_of_last(long)


def _toy_outlook(t: Tables) -> DataFrame:
    return forecast.outlook(*_toy(t))


@query("e10_forecast_direction", views=_TELE, sql=f"""
WITH {_TOY} SELECT node_name, metric, round(first_half, 9) AS first_half, round(second_half, 9) AS second_half, trend FROM dir""")
def _(t: Tables):
    return rounded(forecast.forecast_direction(_toy(t)[0]))


@query("i11_e6_outlook", views=_TELE, sql=f"""
WITH {_TOY} SELECT node_name, metric, round(predicted_avg, 6) AS predicted_avg, round(min_predicted, 6) AS min_predicted,
 round(current_avg, 6) AS current_avg, round(change_pct, 6) AS change_pct FROM look""")
def _(t: Tables):
    return rounded(_toy_outlook(t), 6)


@query("i12_network_summary", views=_TELE, sql=f"""
WITH {_TOY} SELECT l.node_name, round(current_avg, 2) AS current_rate, round(predicted_avg, 2) AS predicted_rate, trend, round(change_pct, 2) AS change_pct
FROM look l JOIN dir d USING (node_name, metric) WHERE metric = 'qkdKeyRate'""")
def _(t: Tables):
    return forecast.network_summary(*_toy(t))


@query("h7_rate_summary", views=_TELE, sql=f"""
WITH {_TOY}, s AS (SELECT *, CASE WHEN abs(change_pct) < 2 THEN 'stable' WHEN change_pct > 2 THEN 'increasing' ELSE 'decreasing' END AS trend,
 CASE WHEN abs(change_pct) < 2 THEN 'weak' WHEN abs(change_pct) > 10 THEN 'strong' ELSE 'moderate' END AS trend_strength FROM look WHERE metric = 'qkdKeyRate')
SELECT node_name, trend, trend_strength, round(change_pct, 2) AS change_percentage,
 CASE WHEN min_predicted < 300 THEN 'critical' WHEN min_predicted < 600 THEN 'high' WHEN predicted_avg < current_avg * 0.8 THEN 'medium' ELSE 'low' END AS risk,
 CASE WHEN min_predicted < 300 THEN 'Key-rate may drop below critical threshold' WHEN min_predicted < 600 THEN 'Key-rate approaching minimum operational levels'
  WHEN predicted_avg < current_avg * 0.8 THEN 'Significant decrease in key generation predicted' ELSE '' END AS risk_factors,
 round(min_predicted, 2) AS min_predicted_rate,
 CASE trend WHEN 'stable' THEN printf('Key-rate expected to remain stable around %.0f bps', predicted_avg) WHEN 'increasing' THEN printf('Key-rate predicted to increase by %.1f%% over forecast period', change_pct)
  ELSE printf('Key-rate predicted to decrease by %.1f%% over forecast period', abs(change_pct)) END
 || CASE WHEN predicted_avg < 300 THEN '; CRITICAL: Predicted key-rate may fall below minimum operational threshold' WHEN predicted_avg < 600 THEN '; WARNING: Key-rate trending toward lower operational range' ELSE '' END AS insights,
 array_to_string(list_filter([CASE WHEN trend = 'decreasing' THEN 'Schedule maintenance check to address declining performance' END,
  CASE WHEN trend = 'decreasing' THEN 'Monitor quantum channel parameters closely' END, CASE WHEN predicted_avg < 300 THEN 'URGENT: Plan for backup key distribution methods' END,
  CASE WHEN predicted_avg < 300 THEN 'Alert network operations team immediately' END, CASE WHEN predicted_avg >= 300 AND predicted_avg < 600 THEN 'Prepare contingency protocols' END], lambda x: x IS NOT NULL), '; ') AS recommendations
FROM s""")
def _(t: Tables):
    return forecast.rate_summary(_toy_outlook(t))


_WIDE = "wide AS (SELECT node_name, " + ", ".join(
    f"max(predicted_avg) FILTER (WHERE metric = '{m}') AS p{i}, max(change_pct) FILTER (WHERE metric = '{m}') AS c{i}" for i, m in enumerate(forecast.METRICS)
) + " FROM look GROUP BY 1)"


@query("h8_insights", views=_TELE, sql=f"""
WITH {_TOY}, {_WIDE}, w AS (SELECT *, coalesce(c0 < -10, false) AS dropping, coalesce(p1 > 0.05, false) AS qh, coalesce(p1 <= 0.05 AND c1 > 20, false) AS qr, coalesce(p3 > 60, false) AS hot,
  coalesce(p3 <= 60 AND c3 > 15, false) AS warm, coalesce(p4 > 80, false) AS cpu, coalesce(p5 > 85, false) AS mem, coalesce(c3 > 10 AND c1 > 10, false) AS tog FROM wide),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN dropping THEN printf('Key rate predicted to drop by %.1f%%', abs(c0)) END, CASE WHEN qh THEN printf('QBER trending toward critical level: %.4f', p1) END,
  CASE WHEN qr THEN printf('QBER increasing by %.1f%%', c1) END, CASE WHEN hot THEN printf('Temperature approaching critical: %.1f°C', p3) END, CASE WHEN warm THEN printf('Temperature rising by %.1f%%', c3) END,
  CASE WHEN cpu THEN printf('CPU load approaching maximum: %.1f%%', p4) END, CASE WHEN mem THEN printf('Memory usage critical: %.1f%%', p5) END,
  CASE WHEN tog THEN 'Temperature and QBER both increasing - possible correlation' END], lambda v: v IS NOT NULL), '; ') AS warnings,
 array_to_string(list_filter([CASE WHEN dropping THEN 'Monitor quantum channel parameters closely' END, CASE WHEN qh THEN 'Schedule quantum channel maintenance' END, CASE WHEN hot THEN 'Check cooling systems immediately' END,
  CASE WHEN warm THEN 'Monitor cooling system performance' END, CASE WHEN cpu THEN 'Consider load balancing or system optimization' END, CASE WHEN mem THEN 'Investigate memory leaks or increase capacity' END,
  CASE WHEN tog THEN 'Priority: Address temperature issues to prevent QBER degradation' END], lambda v: v IS NOT NULL), '; ') AS recommendations FROM w)
SELECT node_name, warnings, recommendations,
 CASE WHEN mem THEN 'high' WHEN cpu THEN 'medium' WHEN hot THEN 'high' WHEN qh THEN 'high' WHEN qr THEN 'medium' WHEN dropping THEN 'high' ELSE 'low' END AS risk,
 CASE WHEN mem OR hot OR qh OR dropping THEN 'high' WHEN cpu OR qr THEN 'medium' ELSE 'low' END AS max_risk,
 CASE WHEN c0 > 10 THEN printf('Key rate improving by %.1f%%', c0) WHEN warnings = '' THEN concat('All metrics stable for ', node_name) ELSE '' END AS summary FROM x""")
def _(t: Tables):
    return forecast.insights(_toy_outlook(t))


@query("h9_short_insights", views=_TELE, sql=f"""
WITH {_TOY}, {_WIDE}, w AS (SELECT *, coalesce(p1 > 0.05, false) AS q, coalesce(p3 > 45, false) AS h, coalesce(p4 > 80, false) AS c, coalesce(c0 < -10, false) AS r FROM wide),
x AS (SELECT *, CAST(q AS INTEGER) + CAST(h AS INTEGER) + CAST(c AS INTEGER) + CAST(r AS INTEGER) AS warnings FROM w)
SELECT node_name, warnings, CASE WHEN warnings > 2 THEN 'high' WHEN warnings > 0 THEN 'medium' ELSE 'low' END AS risk,
 array_to_string(list_filter([CASE WHEN warnings > 0 THEN 'Schedule system maintenance check' END, CASE WHEN q THEN 'Check optical alignment and clean components' END,
  CASE WHEN h THEN 'Verify cooling system operation' END], lambda v: v IS NOT NULL), '; ') AS recommendations FROM x""")
def _(t: Tables):
    return forecast.short_insights(_toy_outlook(t))


def _models(t: Tables) -> DataFrame:
    """Fitted models, saved and loaded as a service would."""
    folder = sinks.scratch_folder(t.spark, "models")
    sinks.save_models(forecast.fit_models(_long(t)), folder, at(AS_OF_TELE))
    return sinks.load_models(t.spark, folder)


@query("i8_fitted_models")
def _(t: Tables):
    return _models(t).select("node_name", "metric", "points", F.round("sigma", 6).alias("sigma"), F.size("coefficients").alias("terms"))


SERIES_VIEWS = _TELE
SERIES_SQL = f"{_SERIES}, long AS (UNPIVOT series ON {_METRICS} INTO NAME metric VALUE value)"


@query("i8_i9_model_and_forecast_shape", views=SERIES_VIEWS, sql=f"""
WITH {SERIES_SQL} SELECT node_name, metric, count(*) AS points, CAST({forecast.TERMS} AS BIGINT) AS terms, CAST(168 AS BIGINT) AS steps,
 max(timestamp) + INTERVAL '1' HOUR AS first_hour, max(timestamp) + INTERVAL '168' HOUR AS last_hour, true AS in_range
FROM long GROUP BY 1, 2 HAVING count(*) >= CASE WHEN metric = 'qkdKeyRate' THEN {forecast.MIN_POINTS_KEY_RATE} ELSE {forecast.MIN_POINTS} END AND max(timestamp) > min(timestamp)""")
def _(t: Tables):
    models = _models(t)
    ahead = forecast.predict(models).groupBy("node_name", "metric").agg(
        F.count(F.lit(1)).alias("steps"),
        F.min("ds").alias("first_hour"),
        F.max("ds").alias("last_hour"),
        F.bool_and((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("in_range"),
    )
    sizes = models.select("node_name", "metric", "points", F.size("coefficients").cast("bigint").alias("terms"))
    return sizes.join(ahead, ["node_name", "metric"])


@query("i9_hourly_forecast")
def _(t: Tables):
    return rounded(forecast.predict(_models(t)), 4)


@query("i11_h8_all_metric_forecast")
def _(t: Tables):
    long = cut_lineage(_long(t))
    ahead = forecast.predict(_models(t))
    return forecast.insights(forecast.outlook(ahead, telemetry.mean_of_last(long)))


@query("i13_missing_models", views=_TELE, sql=f"""
WITH {_SERIES}, long AS (UNPIVOT series ON {_METRICS} INTO NAME metric VALUE value)
SELECT node_name, metric, count(*) AS rows FROM long WHERE NOT (metric = 'temperature' AND node_name IN (SELECT node_name FROM tele_nodes WHERE node_type = 'QKD')) GROUP BY 1, 2""")
def _(t: Tables):
    known = t.tele_nodes.filter(F.col("node_type") == "QKD").select("node_name", F.lit("temperature").alias("metric"))
    return forecast.missing_models(_long(t), known).groupBy("node_name", "metric").agg(F.count(F.lit(1)).alias("rows"))


def _trained(t: Tables) -> DataFrame:
    """A model table whose training time is the newest link reading of an entity."""
    return t.link_metrics.select(
        F.col("link_name").alias("node_name"), F.date_format("timestamp", "yyyy-MM-dd HH").alias("metric"), F.col("timestamp").alias("trained_at")
    )


@query("d36_model_freshness", views="link_metrics", sql="""
WITH m AS (SELECT link_name AS node_name, strftime(timestamp, '%Y-%m-%d %H') AS metric, (epoch(TIMESTAMP '2024-01-31') - epoch(timestamp)) / 3600 AS age_hours FROM link_metrics)
SELECT node_name, metric, round(age_hours, 4) AS age_hours, age_hours > 24 AS stale, CASE WHEN age_hours > 168 THEN 'URGENT' WHEN age_hours > 72 THEN 'Recommended' ELSE '' END AS advice FROM m""")
def _(t: Tables):
    return rounded(forecast.model_freshness(_trained(t), at(AS_OF_TELE)), 4)


@query("d36_freshness_summary", views="link_metrics", sql="""
SELECT count(*) AS total_models, count(*) FILTER (WHERE timestamp < TIMESTAMP '2024-01-30') AS stale_models,
 CASE WHEN count(*) FILTER (WHERE timestamp < TIMESTAMP '2024-01-30') > 0 THEN 'needs_retraining' ELSE 'up_to_date' END AS status FROM link_metrics""")
def _(t: Tables):
    return forecast.freshness_summary(forecast.model_freshness(_trained(t), at(AS_OF_TELE)))
