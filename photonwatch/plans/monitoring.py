"""Registered queries: telemetry, rules, anomaly models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.functions.rules import FEATURES, RULE_SETS
from photonwatch.operators import anomaly, telemetry
from photonwatch.plans.fixtures import AS_OF_TELE, Tables, at
from photonwatch.plans.registry import query
from photonwatch.session import cut_lineage
from photonwatch.sources import sinks


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double so that two engines agree to the last digit shown."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_ENDS = "ends AS (SELECT link_name, source_node AS node_name, link_type FROM tele_links UNION SELECT link_name, destination_node, link_type FROM tele_links)"
_LINK_AVG = """avg(lm.qber) AS "qkdQber", avg(lm.key_rate) AS "qkdKeyRate", avg(lm.visibility) AS "qkdVisibility",
 avg(lm.laser_power) AS "qkdLaserPower", avg(lm.attenuation) AS attenuation, avg(lm.photon_loss) AS "nodePhotonLoss",
 avg(lm.detector_efficiency) AS "detectorEfficiency", avg(lm.secure_key_rate) AS "secureKeyRate" """
_NODE_COLS = """nm.cpu_usage AS "neCpuLoad", nm.memory_usage AS "neMemUsage", nm.temperature AS "neTemperature", nm.aggregated_key_rate AS "nodeKeyRate" """
_LINK_OUT = ["qkdQber", "qkdKeyRate", "qkdVisibility", "qkdLaserPower", "attenuation", "nodePhotonLoss", "detectorEfficiency", "secureKeyRate"]
_NODE_OUT = ["neCpuLoad", "neMemUsage", "neTemperature", "nodeKeyRate"]


def _r(names, digits: int = 9) -> str:
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)


_TRAINING = f"""
training AS (SELECT n.node_name, nm.timestamp, {_NODE_COLS}, {_LINK_AVG}
FROM node_metrics nm JOIN tele_nodes n ON nm.node_name = n.node_name
LEFT JOIN tele_links l ON (l.source_node = n.node_name OR l.destination_node = n.node_name) AND l.link_type = 'Quantum'
LEFT JOIN link_metrics lm ON lm.link_name = l.link_name AND lm.timestamp = nm.timestamp
WHERE nm.timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR AND n.node_type = 'QKD'
GROUP BY n.node_name, nm.timestamp, nm.cpu_usage, nm.memory_usage, nm.temperature, nm.aggregated_key_rate)"""

_RECENT = f"""
recent AS (SELECT nm.node_name, nm.timestamp, first({_NODE_COLS.replace(' AS ', ') AS ').replace(', nm.', ', first(nm.')},
 first(nm.error_count) AS "errorCount", {_LINK_AVG}
FROM node_metrics nm JOIN (SELECT node_name, max(timestamp) AS newest FROM node_metrics GROUP BY node_name) x ON x.node_name = nm.node_name
LEFT JOIN tele_links l ON (l.source_node = nm.node_name OR l.destination_node = nm.node_name) AND l.link_type = 'Quantum'
LEFT JOIN link_metrics lm ON lm.link_name = l.link_name AND abs(epoch_us(nm.timestamp) - epoch_us(lm.timestamp)) < 60000000
WHERE nm.timestamp >= x.newest - INTERVAL 48 HOUR GROUP BY nm.node_name, nm.timestamp)"""

_DEFAULTED = """
SELECT node_name, timestamp, "neCpuLoad", "neMemUsage", "neTemperature", "nodeKeyRate",
 CASE WHEN coalesce("errorCount", 0) = 0 THEN 0 ELSE "errorCount" END AS "errorCount",
 CASE WHEN coalesce("qkdQber", 0) = 0 THEN 0.025 ELSE "qkdQber" END AS "qkdQber",
 CASE WHEN coalesce("qkdKeyRate", 0) = 0 THEN "nodeKeyRate" ELSE "qkdKeyRate" END AS "qkdKeyRate",
 CASE WHEN coalesce("qkdVisibility", 0) = 0 THEN 0.97 ELSE "qkdVisibility" END AS "qkdVisibility",
 CASE WHEN coalesce("qkdLaserPower", 0) = 0 THEN 10.0 ELSE "qkdLaserPower" END AS "qkdLaserPower",
 CASE WHEN coalesce(attenuation, 0) = 0 THEN 15.0 ELSE attenuation END AS attenuation,
 CASE WHEN coalesce("nodePhotonLoss", 0) = 0 THEN 20.0 ELSE "nodePhotonLoss" END AS "nodePhotonLoss",
 CASE WHEN coalesce("detectorEfficiency", 0) = 0 THEN 0.1 ELSE "detectorEfficiency" END AS "detectorEfficiency",
 CASE WHEN coalesce("secureKeyRate", 0) = 0 THEN "nodeKeyRate" * 0.9 ELSE "secureKeyRate" END AS "secureKeyRate" """

_SNAPSHOT = f"""
{_ENDS},
newest AS (SELECT lm.*, e.node_name FROM link_metrics lm JOIN ends e ON e.link_name = lm.link_name AND e.link_type = 'Quantum'
  WHERE lm.timestamp = (SELECT max(timestamp) FROM link_metrics m WHERE m.link_name = lm.link_name)),
groups AS (SELECT node_name, lm.timestamp, {_LINK_AVG}, count(DISTINCT link_name) AS "linkCount",
  string_agg(DISTINCT link_name, ',' ORDER BY link_name) AS "connectedLinks" FROM newest lm GROUP BY node_name, lm.timestamp),
latest AS (SELECT * FROM groups g WHERE timestamp = (SELECT max(timestamp) FROM groups h WHERE h.node_name = g.node_name)),
node_now AS (SELECT node_name, nm.timestamp, {_NODE_COLS}, nm.error_count AS "errorCount" FROM node_metrics nm
  WHERE nm.timestamp = (SELECT max(timestamp) FROM node_metrics m WHERE m.node_name = nm.node_name)),
snap0 AS (SELECT n.*, g.* EXCLUDE (node_name, timestamp) FROM node_now n LEFT JOIN latest g ON g.node_name = n.node_name),
snap AS ({_DEFAULTED}, coalesce("linkCount", 0) AS "linkCount", coalesce("connectedLinks", '') AS "connectedLinks" FROM snap0)"""

_TELE = "tele_nodes tele_links node_metrics link_metrics"


def _training(t: Tables) -> DataFrame:
    return telemetry.training_frame(t.tele_nodes, t.tele_links, t.node_metrics, t.link_metrics, at(AS_OF_TELE))


def _snapshot(t: Tables) -> DataFrame:
    return telemetry.snapshot(t.tele_links, t.node_metrics, t.link_metrics)


def _recent(t: Tables, hours: int = 48) -> DataFrame:
    return telemetry.recent_readings(t.tele_links, t.node_metrics, t.link_metrics, hours)


# -- scans and joins -----------------------------------------------------------


@query("b1_c16_reporting_nodes", views="tele_nodes node_metrics", sql="""
SELECT DISTINCT n.node_name FROM tele_nodes n JOIN node_metrics m ON m.node_name = n.node_name WHERE n.node_type = 'QKD'""")
def _(t: Tables):
    return telemetry.nodes_with_telemetry(t.tele_nodes, t.node_metrics)


@query("b1_qkd_nodes", views="tele_nodes", sql="SELECT DISTINCT node_name FROM tele_nodes WHERE node_type = 'QKD'")
def _(t: Tables):
    return telemetry.qkd_nodes(t.tele_nodes)


@query("b1_link_names", views="tele_links", sql="SELECT DISTINCT link_name FROM tele_links")
def _(t: Tables):
    return telemetry.link_names(t.tele_links)


@query("a2_b2_node_history", views="node_metrics", sql="""
SELECT node_name, timestamp, round(cpu_usage, 9) AS cpu_usage, round(temperature, 9) AS temperature FROM node_metrics
WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR""")
def _(t: Tables):
    rows = telemetry.node_history(t.node_metrics, at(AS_OF_TELE), 168).select("node_name", "timestamp", "cpu_usage", "temperature")
    return rounded(rows)


@query("a3_link_history", views="tele_links link_metrics", sql=f"""
WITH {_ENDS} SELECT e.node_name, lm.link_name, lm.timestamp, round(lm.qber, 9) AS qber, round(lm.key_rate, 9) AS key_rate
FROM link_metrics lm JOIN ends e ON e.link_name = lm.link_name WHERE lm.timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR""")
def _(t: Tables):
    rows = telemetry.link_history(t.tele_links, t.link_metrics, at(AS_OF_TELE), 168)
    return rounded(rows.select("node_name", "link_name", "timestamp", "qber", "key_rate"))


@query("b3_since_latest_row", views="node_metrics", sql="""
SELECT n.node_name, n.timestamp, round(n.temperature, 9) AS temperature FROM node_metrics n
WHERE n.timestamp >= (SELECT max(timestamp) FROM node_metrics m WHERE m.node_name = n.node_name) - INTERVAL 6 HOUR""")
def _(t: Tables):
    rows = telemetry.since_latest(t.node_metrics, "node_name", "timestamp", 6)
    return rounded(rows.select("node_name", "timestamp", "temperature"))


@query("d22_c2_c3_training_frame", views=_TELE, sql=f"WITH {_TRAINING} SELECT node_name, timestamp, {_r(_NODE_OUT + _LINK_OUT)} FROM training")
def _(t: Tables):
    return rounded(_training(t))


@query("c4_band_join_recent", views=_TELE, sql=f"""
WITH {_RECENT} SELECT node_name, timestamp, "errorCount", {_r(_NODE_OUT + _LINK_OUT)} FROM recent""")
def _(t: Tables):
    return rounded(_recent(t))


@query("b9_b10_recent_defaults", views=_TELE, sql=f"""
WITH {_RECENT}, filled AS ({_DEFAULTED} FROM recent) SELECT node_name, timestamp, "errorCount", {_r(_NODE_OUT + _LINK_OUT)} FROM filled""")
def _(t: Tables):
    return rounded(telemetry.recent_with_defaults(_recent(t)))


@query("e1_latest_per_node", views="node_metrics", sql="""
SELECT node_name, timestamp, round(temperature, 9) AS temperature, error_count FROM node_metrics n
WHERE timestamp = (SELECT max(timestamp) FROM node_metrics m WHERE m.node_name = n.node_name)""")
def _(t: Tables):
    return rounded(telemetry.latest_per_node(t.node_metrics).select("node_name", "timestamp", "temperature", "error_count"))


@query("e2_link_own_latest", views="link_metrics", sql="""
SELECT link_name, timestamp, round(qber, 9) AS qber FROM link_metrics l
WHERE timestamp = (SELECT max(timestamp) FROM link_metrics m WHERE m.link_name = l.link_name)""")
def _(t: Tables):
    return rounded(telemetry.at_own_latest(t.link_metrics).select("link_name", "timestamp", "qber"))


@query("d23_snapshot", views=_TELE, sql=f"""
WITH {_SNAPSHOT} SELECT node_name, timestamp, "errorCount", "linkCount", "connectedLinks", {_r(_NODE_OUT + _LINK_OUT)} FROM snap""")
def _(t: Tables):
    return rounded(_snapshot(t))


@query("b11_feature_defaults", views=_TELE, sql=f"""
WITH {_TRAINING} SELECT node_name, timestamp, round(coalesce(attenuation, 15), 9) AS attenuation,
 round(coalesce("detectorEfficiency", 0.1), 9) AS "detectorEfficiency", round(coalesce("secureKeyRate", 1000), 9) AS "secureKeyRate",
 round(coalesce("neCpuLoad", 0), 9) AS "neCpuLoad" FROM training""")
def _(t: Tables):
    rows = anomaly.with_feature_defaults(_training(t))
    return rounded(rows.select("node_name", "timestamp", "attenuation", "detectorEfficiency", "secureKeyRate", "neCpuLoad"))


# -- series ----------------------------------------------------------------------

_FC_LINK = "qber key_rate visibility laser_power secure_key_rate".split()


@query("d20_link_means_per_time", views="tele_links link_metrics", sql=f"""
WITH {_ENDS} SELECT e.node_name, lm.timestamp, round(avg(qber), 9) AS "qkdQber", round(avg(key_rate), 9) AS "qkdKeyRate",
 round(avg(visibility), 9) AS "qkdVisibility", round(avg(laser_power), 9) AS "qkdLaserPower", round(avg(secure_key_rate), 9) AS secure_key_rate
FROM link_metrics lm JOIN ends e ON e.link_name = lm.link_name GROUP BY e.node_name, lm.timestamp""")
def _(t: Tables):
    return rounded(telemetry.mean_link_series(t.tele_links, t.link_metrics, telemetry.FORECAST_LINK_NAMES, None))


@query("d21_node_means_per_time", views="node_metrics", sql="""
SELECT node_name, timestamp, round(avg(temperature), 9) AS temperature, round(avg(cpu_usage), 9) AS cpu_load,
 round(avg(memory_usage), 9) AS memory_usage, round(avg(aggregated_key_rate), 9) AS aggregated_key_rate FROM node_metrics GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(telemetry.mean_node_series(t.node_metrics, telemetry.FORECAST_NODE_NAMES))


_SERIES_COLS = ["qkdQber", "qkdKeyRate", "qkdVisibility", "qkdLaserPower", "secure_key_rate", "temperature", "cpu_load", "memory_usage", "aggregated_key_rate"]


def _fill_sql(columns, source, forward_first=True) -> str:
    first, second = ("ASC", "DESC") if forward_first else ("DESC", "ASC")
    one = ", ".join(
        f'last_value("{c}" IGNORE NULLS) OVER (PARTITION BY node_name ORDER BY timestamp {first} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "{c}"'
        for c in columns
    )
    two = ", ".join(
        f'last_value("{c}" IGNORE NULLS) OVER (PARTITION BY node_name ORDER BY timestamp {second} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "{c}"'
        for c in columns
    )
    return f"SELECT node_name, timestamp, {two} FROM (SELECT node_name, timestamp, {one} FROM {source})"


_SERIES = f"""
{_ENDS},
lk AS (SELECT e.node_name, lm.timestamp, avg(qber) AS "qkdQber", avg(key_rate) AS "qkdKeyRate", avg(visibility) AS "qkdVisibility",
  avg(laser_power) AS "qkdLaserPower", avg(secure_key_rate) AS secure_key_rate FROM link_metrics lm JOIN ends e ON e.link_name = lm.link_name
  WHERE lm.timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR GROUP BY 1, 2),
nd AS (SELECT node_name, timestamp, avg(temperature) AS temperature, avg(cpu_usage) AS cpu_load, avg(memory_usage) AS memory_usage,
  avg(aggregated_key_rate) AS aggregated_key_rate FROM node_metrics WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR GROUP BY 1, 2),
merged0 AS (SELECT * FROM lk FULL JOIN nd USING (node_name, timestamp)),
merged AS (SELECT * REPLACE (
  CASE WHEN node_name IN (SELECT node_name FROM lk) THEN "qkdKeyRate" ELSE coalesce(aggregated_key_rate, 1000) END AS "qkdKeyRate",
  CASE WHEN node_name IN (SELECT node_name FROM lk) THEN "qkdQber" ELSE 0.025 END AS "qkdQber",
  CASE WHEN node_name IN (SELECT node_name FROM lk) THEN "qkdVisibility" ELSE 0.97 END AS "qkdVisibility") FROM merged0),
series AS ({_fill_sql(_SERIES_COLS, 'merged')})"""


def _series(t: Tables) -> DataFrame:
    return telemetry.forecast_series(t.tele_links, t.node_metrics, t.link_metrics, at(AS_OF_TELE), 720)


@query("i10_c10_e3_forecast_series", views=_TELE, sql=f"WITH {_SERIES} SELECT node_name, timestamp, {_r(_SERIES_COLS)} FROM series")
def _(t: Tables):
    return rounded(_series(t))


_FEATURE_LIST = ", ".join(f'"{f}"' for f in FEATURES)
_MATRIX = f"""
{_TRAINING},
gaps AS ({_fill_sql(FEATURES, 'training')}),
matrix AS (SELECT g.node_name, g.timestamp, {", ".join(f'coalesce(g."{f}", m."{f}") AS "{f}"' for f in FEATURES)}
 FROM gaps g JOIN (SELECT node_name, {", ".join(f'avg("{f}") AS "{f}"' for f in FEATURES)} FROM gaps GROUP BY 1) m ON m.node_name = g.node_name)"""


def _matrix(t: Tables) -> DataFrame:
    return telemetry.feature_matrix(_training(t))


@query("i1_feature_matrix", views=_TELE, sql=f"WITH {_MATRIX} SELECT node_name, timestamp, {_r(FEATURES)} FROM matrix")
def _(t: Tables):
    return rounded(_matrix(t))


@query("e3_fill_newest_first", views=_TELE, sql=f"""
WITH {_TRAINING}, gaps AS ({_fill_sql(FEATURES, 'training', False)}) SELECT node_name, timestamp, {_r(FEATURES)} FROM gaps""")
def _(t: Tables):
    rows = _training(t).select("node_name", "timestamp", *FEATURES)
    return rounded(telemetry.filled(rows, FEATURES, newest_first=True))


_STANDARD = ", ".join(
    f'round((x."{f}" - "m_{f}") / CASE WHEN "d_{f}" > 1e-9 * greatest(1.0, abs("m_{f}")) THEN "d_{f}" ELSE 1 END, 9) AS "{f}"' for f in FEATURES
)


@query("i3_standardised", views=_TELE, sql=f"""
WITH {_MATRIX}, s AS (SELECT node_name, {", ".join(f'avg("{f}") AS "m_{f}", stddev_pop("{f}") AS "d_{f}"' for f in FEATURES)} FROM matrix GROUP BY 1)
SELECT x.node_name, x.timestamp, {_STANDARD} FROM matrix x JOIN s ON s.node_name = x.node_name""")
def _(t: Tables):
    matrix = _matrix(t)
    return rounded(anomaly.standardised(matrix, anomaly.scaling(matrix)))


@query("d27_feature_ranges", views=_TELE, sql=f"""
WITH {_MATRIX}, long AS (UNPIVOT matrix ON {_FEATURE_LIST} INTO NAME metric VALUE value)
SELECT node_name, metric, round(min(value), 9) AS min, round(max(value), 9) AS max, round(avg(value), 9) AS mean FROM long GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(telemetry.feature_ranges(_matrix(t)))


_LONG = f'long AS (UNPIVOT series ON {", ".join(chr(34) + c + chr(34) for c in _SERIES_COLS)} INTO NAME metric VALUE value)'


@query("d26_series_stats", views=_TELE, sql=f"""
WITH {_SERIES}, {_LONG} SELECT node_name, metric, count(*) AS points, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std,
 round(min(value), 9) AS min, round(max(value), 9) AS max FROM long GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(telemetry.series_stats(telemetry.long_form(_series(t), _SERIES_COLS)))


@query("e6_mean_of_last_24", views=_TELE, sql=f"""
WITH {_SERIES}, {_LONG} SELECT node_name, metric, round(avg(value), 9) AS current_avg FROM
 (SELECT *, row_number() OVER (PARTITION BY node_name, metric ORDER BY timestamp DESC) AS r FROM long) WHERE r <= 24 GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(telemetry.mean_of_last(telemetry.long_form(_series(t), _SERIES_COLS)))


_TREND = f"""
{_RECENT}, filled AS ({_DEFAULTED} FROM recent),
long AS (SELECT node_name, timestamp, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT filled ON "qkdQber", "qkdKeyRate", "neCpuLoad", "neTemperature" INTO NAME metric VALUE value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node_name, metric ORDER BY timestamp) AS i, count(*) OVER (PARTITION BY node_name, metric) AS n FROM long),
halves AS (SELECT node_name, metric, avg(value) FILTER (WHERE i <= n // 2) AS a, avg(value) FILTER (WHERE i > n // 2) AS b,
 max(value) FILTER (WHERE i = n) AS current, avg(value) AS average, min(value) AS min, max(value) AS max FROM ranked WHERE n >= 2 GROUP BY 1, 2),
trend AS (SELECT node_name, metric, round(current, 9) AS current, round(average, 9) AS average, round(min, 9) AS min, round(max, 9) AS max,
 CASE WHEN metric = 'qkdQber' THEN CASE WHEN b > a * 1.1 THEN 'deteriorating' WHEN b < a * 0.9 THEN 'improving' ELSE 'stable' END
      WHEN metric = 'qkdKeyRate' THEN CASE WHEN b < a * 0.9 THEN 'deteriorating' WHEN b > a * 1.1 THEN 'improving' ELSE 'stable' END
      WHEN abs(b - a) / (a + 0.001) > 0.2 THEN 'deteriorating' ELSE 'stable' END AS direction FROM halves)"""


def _trend(t: Tables) -> DataFrame:
    return telemetry.half_split_trend(telemetry.recent_with_defaults(_recent(t)))


@query("e4_half_split_trend", views=_TELE, sql=f"WITH {_TREND} SELECT * FROM trend")
def _(t: Tables):
    return rounded(_trend(t))


@query("e5_overall_trend", views=_TELE, sql=f"""
WITH {_TREND} SELECT node_name, count(*) AS metrics, CASE WHEN count(*) FILTER (WHERE direction = 'deteriorating') >= 2 THEN 'deteriorating'
 WHEN count(*) FILTER (WHERE direction = 'improving') >= 2 THEN 'improving' ELSE 'stable' END AS overall FROM trend GROUP BY 1""")
def _(t: Tables):
    return telemetry.overall_trend(_trend(t))


@query("d24_node_coverage", views="node_metrics", sql="""
SELECT count(*) AS rows, count(DISTINCT node_name) AS entities, min(timestamp) AS first_time, max(timestamp) AS last_time FROM node_metrics""")
def _(t: Tables):
    return telemetry.coverage(t.node_metrics, "node_name")


@query("d24_link_coverage", views="link_metrics", sql="""
SELECT count(*) AS rows, count(DISTINCT link_name) AS entities, min(timestamp) AS first_time, max(timestamp) AS last_time FROM link_metrics""")
def _(t: Tables):
    return telemetry.coverage(t.link_metrics, "link_name")


# -- rules -----------------------------------------------------------------------


def _violation_sql(source: str, keys: str) -> str:
    parts = []
    for rule in RULE_SETS["fault_default"]:
        sign, kind = (">", "exceeds") if rule.kind == "max" else ("<", "below")
        parts.append(
            f"SELECT {keys}, '{rule.metric}' AS metric, \"{rule.metric}\" AS value, CAST({rule.limit} AS DOUBLE) AS threshold, '{kind}' AS type "
            f'FROM {source} WHERE "{rule.metric}" {sign} {rule.limit}'
        )
    return " UNION ALL ".join(parts)


@query("h3_violations", views=_TELE, sql=f"""
WITH {_TRAINING}, v AS ({_violation_sql('training', 'node_name, timestamp')})
SELECT node_name, timestamp, metric, round(value, 9) AS value, threshold, type FROM v""")
def _(t: Tables):
    return rounded(anomaly.violations(_training(t), ["node_name", "timestamp"], RULE_SETS["fault_default"]))


_ADVICE_SQL = """
CASE WHEN "qkdQber" > 0.06 THEN ['Check fiber optic alignment and cleanliness', 'Verify laser stability and power levels'] ELSE [] END
|| CASE WHEN "qkdKeyRate" < 900 THEN ['Inspect photon detectors for degradation', 'Check quantum channel attenuation'] ELSE [] END
|| CASE WHEN "qkdVisibility" < 0.85 THEN ['Recalibrate optical components', 'Check for environmental vibrations'] ELSE [] END
|| CASE WHEN "neCpuLoad" > 80 THEN ['Review running processes and optimize', 'Consider system resource upgrade'] ELSE [] END
|| CASE WHEN "neMemUsage" > 90 THEN ['Review running processes and optimize', 'Consider system resource upgrade'] ELSE [] END
|| CASE WHEN "neTemperature" > 75 THEN ['Check cooling system operation', 'Verify thermal paste and heat sink contact'] ELSE [] END"""

_DIAGNOSED = f"""
scored AS (SELECT *, 0.15 - "errorCount" / 10.0 AS anomaly_score, {_ADVICE_SQL} AS lines,
  list_filter([CASE WHEN "qkdQber" > 0.06 THEN 'qkdQber' END, CASE WHEN "qkdKeyRate" < 900 THEN 'qkdKeyRate' END,
   CASE WHEN "qkdVisibility" < 0.85 THEN 'qkdVisibility' END, CASE WHEN "qkdLaserPower" < 0.5 THEN 'qkdLaserPower' END,
   CASE WHEN "neCpuLoad" > 80 THEN 'neCpuLoad' END, CASE WHEN "neMemUsage" > 90 THEN 'neMemUsage' END,
   CASE WHEN "neTemperature" > 75 THEN 'neTemperature' END], lambda x: x IS NOT NULL) AS broken FROM filled),
judged AS (SELECT *, CASE WHEN anomaly_score < 0 OR len(broken) > 0 THEN 'fault' ELSE 'normal' END AS status,
  CASE WHEN NOT (anomaly_score < 0 OR len(broken) > 0) THEN 'NONE' WHEN anomaly_score < -0.3 OR len(broken) >= 3 THEN 'HIGH'
       WHEN anomaly_score < -0.1 OR len(broken) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  list_has_any(broken, ['qkdQber', 'qkdVisibility', 'qkdLaserPower']) AS on_link,
  list_has_any(broken, ['neCpuLoad', 'neMemUsage', 'neTemperature']) AS on_node FROM scored),
advised AS (SELECT *, list_slice(CASE WHEN status <> 'fault' THEN [] ELSE CASE WHEN severity = 'HIGH' THEN ['IMMEDIATE ACTION REQUIRED'] ELSE [] END || lines
  || CASE severity WHEN 'HIGH' THEN ['Consider emergency maintenance'] WHEN 'MEDIUM' THEN ['Schedule maintenance within 24 hours'] ELSE [] END END, 1, 5) AS tips FROM judged),
diagnosed AS (SELECT node_name, timestamp, round(anomaly_score, 9) AS anomaly_score, status, severity, CAST(len(broken) AS INTEGER) AS violations,
  CASE WHEN on_link AND on_node THEN 'mixed' WHEN on_link THEN 'link' WHEN on_node THEN 'node' END AS location,
  array_to_string(broken, ',') AS violated,
  CASE WHEN len(tips) > 0 THEN array_to_string(tips, '; ') ELSE 'System operating normally' END AS recommendations FROM advised)"""


def _judged_history(t: Tables) -> DataFrame:
    rows = telemetry.recent_with_defaults(_recent(t)).withColumn("anomaly_score", F.lit(0.15) - F.col("errorCount") / 10.0)
    return anomaly.diagnose(rows, RULE_SETS["fault_default"])


@query("h4_h5_h6_diagnosis", views=_TELE, sql=f"WITH {_RECENT}, filled AS ({_DEFAULTED} FROM recent), {_DIAGNOSED} SELECT * FROM diagnosed")
def _(t: Tables):
    return rounded(_judged_history(t))


@query("d33_scan_summary", views=_TELE, sql=f"""
WITH {_RECENT}, filled AS ({_DEFAULTED} FROM recent), {_DIAGNOSED} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'normal') AS normal,
 count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'HIGH') AS high FROM diagnosed""")
def _(t: Tables):
    return anomaly.scan_summary(_judged_history(t))


@query("d33_urgent_nodes", views=_TELE, sql=f"""
WITH {_RECENT}, filled AS ({_DEFAULTED} FROM recent), {_DIAGNOSED} SELECT node_name, violations FROM diagnosed WHERE severity = 'HIGH'""")
def _(t: Tables):
    return anomaly.urgent_nodes(_judged_history(t))


@query("l5_generated_alerts", views="node_metrics link_metrics", sql="""
SELECT * FROM (SELECT 'link' AS entity_type, link_name AS entity_name, timestamp, 'Critical' AS severity, 'High QBER' AS alert_type, 'qber' AS metric_name,
 'QBER exceeded critical threshold' AS message, round(qber, 9) AS current_value, CAST(0.04 AS DOUBLE) AS threshold_value, 'max' AS threshold_type
 FROM link_metrics WHERE qber > 0.04 ORDER BY timestamp DESC, link_name LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'node', node_name, timestamp, 'Warning', 'High Temperature', 'temperature',
 'Node temperature above threshold', round(temperature, 9), CAST(45 AS DOUBLE), 'max' FROM node_metrics WHERE temperature > 45 ORDER BY timestamp DESC, node_name LIMIT 5)""")
def _(t: Tables):
    return rounded(anomaly.generated_alerts(t.node_metrics, t.link_metrics))


# -- models ------------------------------------------------------------------------


def _trained(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scaled rows with their split, and the scaling and forests, saved per node and loaded."""
    folder = sinks.scratch_folder(t.spark, "forests")
    matrix = cut_lineage(anomaly.train_split(_matrix(t)))
    sinks.save_models(anomaly.scaling(matrix.filter("is_train")), f"{folder}/scaling", at(AS_OF_TELE), ["node_name"])
    scaling = sinks.load_models(t.spark, f"{folder}/scaling").drop("trained_at")
    scaled = anomaly.standardised(matrix, scaling)
    sinks.save_models(anomaly.fit_forests(scaled.filter("is_train")), f"{folder}/forests", at(AS_OF_TELE), ["node_name"])
    return scaled, scaling, sinks.load_models(t.spark, f"{folder}/forests").drop("trained_at")


def _offsets(scaled: DataFrame, model: DataFrame) -> DataFrame:
    return anomaly.score_offsets(cut_lineage(anomaly.forest_scores(scaled.filter("is_train"), model)))


_SPLIT = f"""{_MATRIX},
split AS (SELECT node_name, count(*) OVER (PARTITION BY node_name) < 100
  OR CAST(concat('0x', substr(md5(concat(node_name, '|', CAST(epoch_us(timestamp) AS VARCHAR))), 1, 8)) AS BIGINT) % 10 < 8 AS is_train FROM matrix)"""


@query("i2_train_split", views=_TELE, sql=f"""
WITH {_SPLIT} SELECT node_name, count(*) AS rows, count(*) FILTER (WHERE is_train) AS train_rows FROM split GROUP BY 1""")
def _(t: Tables):
    split = anomaly.train_split(_matrix(t))
    return split.groupBy("node_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_train").alias("train_rows"))


def _bits_sql(text: str, place: int = 1) -> str:
    return f"CAST(concat('0x', substr(md5({text}), {place}, 8)) AS BIGINT)"


_EDGES = ", ".join(f"min(f[{k}]) OVER w AS a{k}, max(f[{k}]) OVER w AS b{k}" for k in range(1, len(FEATURES) + 1))
_OPTIONS = ", ".join(
    f"CASE WHEN b{k} > a{k} THEN struct_pack(d := {_bits_sql(f"concat(node_name, '|', tree, '|', path, '|{f}')")}, i := -{k}, a := a{k}, b := b{k}) END"
    for k, f in enumerate(FEATURES, 1)
)
_LEAF = "(CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n END)"
#: The same forests: every level is one pass over (node, tree, path), a walk one join per level.
_FOREST = f"""{_MATRIX},
parted AS (SELECT *, count(*) OVER (PARTITION BY node_name) < 100 OR {_bits_sql("concat(node_name, '|', CAST(epoch_us(timestamp) AS VARCHAR))")} % 10 < 8 AS is_train FROM matrix),
span AS (SELECT node_name, count(*) AS n_train, {", ".join(f'avg("{f}") AS "m_{f}", stddev_pop("{f}") AS "d_{f}"' for f in FEATURES)} FROM parted WHERE is_train GROUP BY 1),
std AS (SELECT p.node_name, p.timestamp, epoch_us(p.timestamp) AS us, is_train, n_train,
 [{", ".join(f'round((p."{f}" - "m_{f}") / CASE WHEN "d_{f}" > 1e-9 * greatest(1.0, abs("m_{f}")) THEN "d_{f}" ELSE 1.0 END, 9)' for f in FEATURES)}] AS f FROM parted p JOIN span USING (node_name)),
offer AS (SELECT *, least(100, CAST(ceil(102400.0 / n_train) AS BIGINT)) AS copies FROM std WHERE is_train),
kept AS (SELECT *, unnest(range(copies)) AS j FROM offer WHERE 102400.0 / (n_train * copies) >= 1 OR {_bits_sql("concat(node_name, '|', us, '|offer')")} < 102400.0 / (n_train * copies) * 4294967296.0),
dealt AS (SELECT node_name, us, f, ({_bits_sql("concat(node_name, '|', us, '|offer')", 9)} + j) % 100 AS tree FROM kept),
chosen AS (SELECT *, count(*) OVER (PARTITION BY node_name, tree) AS sample FROM (SELECT * FROM dealt
  QUALIFY row_number() OVER (PARTITION BY node_name, tree ORDER BY md5(concat(node_name, '|', tree, '|', us)), us) <= 256)),
grow AS (SELECT node_name, tree, sample, CAST(ceil(log2(greatest(sample, 2))) AS BIGINT) AS top, CAST(0 AS BIGINT) AS level, CAST(1 AS BIGINT) AS path, f,
  CAST(NULL AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS cut, CAST(NULL AS BIGINT) AS above FROM chosen
 UNION ALL SELECT node_name, tree, sample, top, level + 1, CASE WHEN f[kk] <= c THEN 2 * path ELSE 2 * path + 1 END, f, kk, c, path FROM
  (SELECT *, -best.i AS kk, CASE WHEN best.a + u * (best.b - best.a) < best.b THEN best.a + u * (best.b - best.a) ELSE best.a END AS c FROM
   (SELECT *, list_aggregate(list_filter([{_OPTIONS}], lambda x: x IS NOT NULL), 'max') AS best, {_bits_sql("concat(node_name, '|', tree, '|', path, '|cut')")} / 4294967296.0 AS u FROM
    (SELECT *, {_EDGES} FROM grow WHERE level < top WINDOW w AS (PARTITION BY node_name, tree, path))) WHERE best IS NOT NULL)),
inner_node AS (SELECT DISTINCT node_name, tree, above AS path, k, cut FROM grow WHERE above IS NOT NULL),
leaf AS (SELECT node_name, tree, sample, path, level + {_LEAF} AS depth FROM (SELECT node_name, tree, sample, path, level, count(*) AS n FROM grow GROUP BY ALL) g
  WHERE NOT EXISTS (SELECT 1 FROM inner_node i WHERE i.node_name = g.node_name AND i.tree = g.tree AND i.path = g.path)),
walk AS (SELECT node_name, timestamp, f, tree, CAST(1 AS BIGINT) AS path FROM {{rows}}, range(100) x(tree)
 UNION ALL SELECT w.node_name, w.timestamp, w.f, w.tree, CASE WHEN w.f[i.k] <= i.cut THEN 2 * w.path ELSE 2 * w.path + 1 END
  FROM walk w JOIN inner_node i ON i.node_name = w.node_name AND i.tree = w.tree AND i.path = w.path),
raw_score AS (SELECT w.node_name, w.timestamp, round(-pow(2.0, -avg(l.depth) / max(norm)), 9) AS raw FROM walk w JOIN leaf l ON l.node_name = w.node_name AND l.tree = w.tree AND l.path = w.path
  JOIN (SELECT node_name, CASE WHEN {_LEAF} > 0 THEN {_LEAF} ELSE 1.0 END AS norm FROM (SELECT node_name, max(sample) AS n FROM leaf GROUP BY 1)) nn ON nn.node_name = w.node_name GROUP BY w.node_name, w.timestamp)"""
_DECIDED = _FOREST.replace("{rows}", "std") + """,
bar AS (SELECT node_name, quantile_cont(raw, 0.05) AS bar FROM raw_score JOIN std USING (node_name, timestamp) WHERE is_train GROUP BY 1),
decided AS (SELECT node_name, timestamp, is_train, round(raw - bar, 9) AS score FROM raw_score JOIN bar USING (node_name) JOIN std USING (node_name, timestamp))"""


@query("i4_isolation_forests", views=_TELE, sql=f"""
WITH RECURSIVE {_FOREST.replace("{rows}", "std")} SELECT node_name, CAST(tree AS INTEGER) AS tree, CAST(max(sample) AS INTEGER) AS sample,
 CAST(2 * count(*) - 1 AS INTEGER) AS tree_nodes, round(max(depth), 6) AS longest FROM leaf GROUP BY 1, 2""")
def _(t: Tables):
    _, _, model = _trained(t)
    return model.select("node_name", "tree", "sample", F.size("feature").alias("tree_nodes"), F.round(F.array_max("depth"), 6).alias("longest"))


@query("i4_forest_shape", views=_TELE, sql=f"""
WITH {_SPLIT} SELECT node_name, CAST(100 AS BIGINT) AS trees, least(256, count(*) FILTER (WHERE is_train)) AS smallest_sample,
 least(256, count(*) FILTER (WHERE is_train)) AS largest_sample, true AS binary_trees FROM split GROUP BY 1""")
def _(t: Tables):
    _, _, model = _trained(t)
    return model.groupBy("node_name").agg(
        F.count_distinct("tree").alias("trees"),
        F.min("sample").cast("bigint").alias("smallest_sample"),
        F.max("sample").cast("bigint").alias("largest_sample"),
        # one leaf more than splits, and no more leaves than points
        F.bool_and((F.size("feature") % 2 == 1) & (F.size("feature") < 2 * F.col("sample"))).alias("binary_trees"),
    )


@query("i5_i6_h10_holdout_report", views=_TELE, sql=f"""
WITH RECURSIVE {_DECIDED} SELECT node_name, count(*) AS test_samples, count(*) FILTER (WHERE score < 0) AS outliers_detected, round(count(*) FILTER (WHERE score < 0) / count(*), 6) AS outlier_ratio,
 round(avg(score), 6) AS avg_anomaly_score, round(min(score), 6) AS min_anomaly_score, round(max(score), 6) AS max_anomaly_score, round(stddev_pop(score), 6) AS std_anomaly_score
FROM decided WHERE NOT is_train GROUP BY 1""")
def _(t: Tables):
    scaled, _, model = _trained(t)
    offsets = _offsets(scaled, model)
    raw = anomaly.forest_scores(scaled.filter(~F.col("is_train")), model)
    return rounded(anomaly.holdout_report(anomaly.decisions(raw, offsets)), 6)


@query("i7_fault_diagnosis")
def _(t: Tables):
    scaled, scaling, model = _trained(t)
    offsets = _offsets(scaled, model)
    now = cut_lineage(_snapshot(t))
    features = anomaly.standardised(anomaly.with_feature_defaults(now).select("node_name", "timestamp", *FEATURES), scaling)
    judged = anomaly.decisions(anomaly.forest_scores(features, model), offsets)
    readings = now.join(judged.select("node_name", "anomaly_score"), "node_name")
    trends = telemetry.overall_trend(_trend(t))
    return anomaly.diagnose(readings, RULE_SETS["fault_default"], trends=trends)


def _scored_history(t: Tables) -> DataFrame:
    """Every row of the history with the score that its node's forest gives it."""
    scaled, _, model = _trained(t)
    raw = cut_lineage(anomaly.forest_scores(scaled, model).join(scaled.select("node_name", "timestamp", "is_train"), ["node_name", "timestamp"]))
    return anomaly.decisions(raw.drop("is_train"), anomaly.score_offsets(raw.filter("is_train").drop("is_train")))


@query("d25_h13_anomaly_history", views=_TELE, sql=f"""
WITH RECURSIVE {_DECIDED}, a AS (SELECT node_name, count(*) AS total_points, count(*) FILTER (WHERE score < 0) AS anomalies_detected,
 round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, round(min(score), 6) AS score_min,
 round(max(score), 6) AS score_max, round(count(*) FILTER (WHERE score < 0) / count(*) * 100, 2) AS anomaly_rate FROM decided GROUP BY 1)
SELECT *, CASE WHEN anomaly_rate > 10 THEN 'high' WHEN anomaly_rate < 5 THEN 'low' ELSE 'moderate' END AS verdict FROM a""")
def _(t: Tables):
    return rounded(anomaly.anomaly_history(_scored_history(t)), 6)


@query("e9_first_anomalies", views=_TELE, sql=f"""
WITH RECURSIVE {_DECIDED} SELECT node_name, timestamp, round(score, 6) AS anomaly_score, CAST(rank AS INTEGER) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY node_name ORDER BY timestamp DESC) AS rank FROM decided WHERE score < 0) WHERE rank <= 10""")
def _(t: Tables):
    return rounded(anomaly.first_anomalies(_scored_history(t)), 6).select("node_name", "timestamp", "anomaly_score", "rank")
