import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photonwatch.functions import scores
from photonwatch.functions.rules import FEATURES, RULE_SETS
from photonwatch.operators import anomaly, forecast, telemetry


def test_fault_severity_table(spark):
    cases = [
        (0.2, 0, "normal", "NONE"), (0.2, 1, "fault", "MEDIUM"), (0.2, 3, "fault", "HIGH"),
        (-0.05, 0, "fault", "LOW"), (-0.2, 0, "fault", "MEDIUM"), (-0.4, 0, "fault", "HIGH"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "score double, n int")
    status, severity = scores.fault_status(F.col("score"), F.col("score") < 0, F.col("n"))
    assert [tuple(r) for r in df.select(status, severity).collect()] == [c[2:] for c in cases]


def test_diagnosis_advice_and_location(spark):
    columns = ["node_name", "timestamp", "anomaly_score", *(r.metric for r in RULE_SETS["fault_default"])]
    when = dt.datetime(2024, 1, 1)
    rows = [
        ("calm", when, 0.1, 0.01, 1500.0, 0.95, 9.0, 10.0, 10.0, 30.0),
        ("link", when, 0.1, 0.10, 1500.0, 0.95, 9.0, 10.0, 10.0, 30.0),
        ("all", when, 0.1, 0.10, 100.0, 0.50, 9.0, 95.0, 10.0, 90.0),
        ("rate", when, 0.1, 0.01, 100.0, 0.95, 9.0, None, 10.0, 30.0),
        ("edge", when, 0.1, 0.06, 900.0, 0.85, 0.5, 80.0, 90.0, 75.0),
    ]
    got = {r.node_name: r for r in anomaly.diagnose(spark.createDataFrame(rows, columns), RULE_SETS["fault_default"]).collect()}
    assert got["calm"].recommendations == "System operating normally"
    assert (got["edge"].violations, got["edge"].status) == (0, "normal")  # limits are strict
    assert (got["link"].severity, got["link"].location) == ("MEDIUM", "link")
    assert got["link"].recommendations.endswith("Schedule maintenance within 24 hours")
    assert (got["all"].severity, got["all"].location, got["all"].violations) == ("HIGH", "mixed", 5)
    assert got["all"].recommendations.split("; ")[0] == "IMMEDIATE ACTION REQUIRED" and got["all"].recommendations.count(";") == 4
    assert (got["rate"].location, got["rate"].violated) == (None, "qkdKeyRate")


def test_half_split_trend_by_hand(spark):
    start = dt.datetime(2024, 1, 1)
    qber, rate, cpu = [1.0, 1.0, 2.0, 2.0, 2.0], [100.0, 100.0, 115.0, 115.0, 115.0], [10.0, 10.0, 11.0, 11.0, 11.0]
    rows = [("n", start + dt.timedelta(hours=30 * i), q, r, c, None) for i, (q, r, c) in enumerate(zip(qber, rate, cpu))]
    df = spark.createDataFrame(rows, "node_name string, timestamp timestamp_ntz, qkdQber double, qkdKeyRate double, neCpuLoad double, neTemperature double")
    got = {r.metric: r for r in telemetry.half_split_trend(df).collect()}
    assert {m: r.direction for m, r in got.items()} == {"qkdQber": "deteriorating", "qkdKeyRate": "improving", "neCpuLoad": "stable"}
    assert got["qkdQber"].current == 2.0 and got["qkdQber"].average == pytest.approx(1.6)


@pytest.fixture(scope="module")
def series_rows(spark):
    """One node with most rows; ten planted outliers in it."""
    rng = np.random.default_rng(1)
    parts = []
    for node, n in (("big", 1500), ("small", 60)):
        values = rng.normal(size=(n, len(FEATURES)))
        if node == "big":
            values[:10] += 12.0
        part = pd.DataFrame(values, columns=FEATURES)
        part.insert(0, "timestamp", pd.date_range("2024-01-01", periods=n, freq="15min"))
        part.insert(0, "node_name", node)
        parts.append(part)
    return spark.createDataFrame(pd.concat(parts)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_forest_finds_planted_outliers(series_rows):
    model = anomaly.fit_forests(series_rows, trees=40)
    sizes = {(r.node_name, r["sample"]) for r in model.select("node_name", "sample").distinct().collect()}
    assert sizes == {("big", 256), ("small", 60)}
    raw = anomaly.forest_scores(series_rows, model).cache()
    judged = anomaly.decisions(raw, anomaly.score_offsets(raw)).toPandas()
    big = judged[judged.node_name == "big"].sort_values("anomaly_score")
    planted = set(pd.date_range("2024-01-01", periods=10, freq="15min"))
    assert set(big.head(10)["timestamp"]) == planted
    assert (big["prediction"] == -1).mean() == pytest.approx(0.05, abs=0.01)
    quantile = np.percentile(raw.filter("node_name = 'big'").toPandas()["raw_score"], 5)
    offset = anomaly.score_offsets(raw).filter("node_name = 'big'").first().offset
    assert offset == pytest.approx(quantile, abs=1e-12)


def test_forest_does_not_depend_on_partitions(series_rows, monkeypatch):
    one = anomaly.forest_scores(series_rows, anomaly.fit_forests(series_rows.repartition(1), trees=5))
    monkeypatch.setattr(anomaly, "ROWS_PER_GROUP", 100)
    many = anomaly.forest_scores(series_rows, anomaly.fit_forests(series_rows.repartition(7), trees=5))
    key = ["node_name", "timestamp"]
    a, b = one.toPandas().sort_values(key), many.toPandas().sort_values(key)
    assert len(a) == 1560 and np.allclose(a["raw_score"], b["raw_score"])


def test_forecast_recovers_trend_and_season(spark):
    rng = np.random.default_rng(5)
    hours = np.arange(24 * 28)
    clean = 100 + 0.05 * hours + 10 * np.sin(2 * np.pi * hours / 24) + 4 * np.cos(2 * np.pi * hours / 168)
    values = clean + rng.normal(scale=1.0, size=len(hours))
    begin = pd.Timestamp("2024-01-01")
    frame = pd.DataFrame({"node_name": "n", "timestamp": begin + pd.to_timedelta(hours, "h"), "metric": "cpu_load", "value": values})
    few = frame.head(20).assign(metric="qkdKeyRate")
    series = spark.createDataFrame(pd.concat([frame.head(24 * 21), few])).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    models = forecast.fit_models(series.repartition(6)).cache()
    assert [r.metric for r in models.collect()] == ["cpu_load"]  # 20 points do not make a key-rate model
    ahead = forecast.predict(models, days=7).toPandas().sort_values("step")
    assert list(ahead["ds"])[0] == begin + pd.Timedelta(hours=24 * 21)
    truth = clean[24 * 21 :]
    assert np.abs(ahead["yhat"] - truth).mean() < 2.5
    inside = ((values[24 * 21 :] >= ahead["yhat_lower"]) & (values[24 * 21 :] <= ahead["yhat_upper"])).mean()
    assert inside > 0.6
    # the expression form of the model equals the matrix it was fitted with
    m = models.first()
    seconds = m.end_s + ahead["step"].to_numpy() * 3600.0
    x = (seconds - m.begin_s) / (m.end_s - m.begin_s)
    assert np.allclose(forecast._design(x, seconds) @ np.array(m.coefficients) * m.y_scale, ahead["yhat"])


def test_insight_risk_order(spark):
    rows = [("n", m, 0.0, 0.0, 0.0, 0.0) for m in forecast.METRICS]
    wide = {"qkdQber": (0.2, 0.0), "cpu_load": (90.0, 0.0)}
    rows = [(n, m, wide.get(m, (0.0, 0.0))[0], 0.0, 1.0, wide.get(m, (0.0, 0.0))[1]) for n, m, *_ in rows]
    df = spark.createDataFrame(rows, "node_name string, metric string, predicted_avg double, min_predicted double, current_avg double, change_pct double")
    got = forecast.insights(df).first()
    assert (got.risk, got.max_risk) == ("medium", "high")  # a later rule replaces an earlier, higher one


def test_a_single_break_is_found_and_the_rest_is_zero():
    from photonwatch.operators import forecast as fc

    rng = np.random.default_rng(4)
    seconds = np.arange(0, 30 * 86_400.0, 1_800.0)
    x = seconds / seconds[-1]
    at = fc._BREAKS[11]
    y = 0.5 + 0.2 * x - 0.9 * np.maximum(x - at, 0) + 0.05 * np.sin(2 * np.pi * seconds / 86_400) + rng.normal(0, 0.02, len(x))
    design = fc._design(x, seconds)
    xx, xy = design.T @ design, design.T @ y
    found, sigma = fc._solve(xx, xy, float(y @ y), len(y))
    changes = found[fc._SPARSE]
    assert np.argmax(np.abs(changes)) in (10, 11, 12) and np.count_nonzero(changes) <= 8 and abs(changes.sum() + 0.9) < 0.1
    assert abs(sigma - 0.02) < 0.002
    # a change is as far from zero as its pull against the price, and zero where the pull is less
    pull = (xy - xx @ found)[fc._SPARSE]
    price = sigma**2 / fc.CHANGE_PRIOR
    assert np.all(np.abs(pull) <= price * 1.01) and np.allclose(pull[changes != 0], price * np.sign(changes[changes != 0]), rtol=0.02)
