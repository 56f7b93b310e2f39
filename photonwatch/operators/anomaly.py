"""Threshold rules, verdicts and advice; isolation forests per node."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions import rules, scores
from photonwatch.functions.rules import FEATURES, Limit
from photonwatch.operators.filters import first_per_group

# -- rules -------------------------------------------------------------------


def broken_limits(limits: Sequence[Limit]) -> Column:
    """Broken limits of a row, in rule order; missing readings break nothing."""
    return F.filter(rules.limit_structs(limits), lambda r: r["broken"])


def violations(readings: DataFrame, keys: Sequence[str], limits: Sequence[Limit]) -> DataFrame:
    """One row per broken limit; no shuffle and no join."""
    return readings.select(*keys, F.inline(broken_limits(limits))).drop("broken")


def location(broken: Column) -> Column:
    """Where the trouble sits, by the metrics that broke a limit."""

    def touches(metrics: list[str]) -> Column:
        return F.exists(broken, lambda r: r["metric"].isin(metrics))

    link, node = touches(rules.LINK_METRICS), touches(rules.NODE_METRICS)
    return F.when(link & node, "mixed").when(link, "link").when(node, "node")


def advice(broken: Column, status: Column, severity: Column, overall_trend: Column | None = None) -> Column:
    """Up to five recommendations, in rule order."""
    # the table as a map, looked up per broken limit
    table = F.create_map(
        *[part for metric, lines in rules.ADVICE.items() for part in (F.lit(metric), F.array(*map(F.lit, lines)))]
    )
    none = F.array().cast("array<string>")
    per_limit = F.flatten(F.transform(broken, lambda r: F.coalesce(table[r["metric"]], none)))
    head = F.when(severity == "HIGH", F.array(F.lit(rules.ADVICE_HIGH_FIRST))).otherwise(none)
    tail = (
        F.when(severity == "HIGH", F.array(F.lit(rules.ADVICE_HIGH_LAST)))
        .when(severity == "MEDIUM", F.array(F.lit(rules.ADVICE_MEDIUM_LAST)))
        .otherwise(none)
    )
    calm = none
    if overall_trend is not None:
        calm = F.when(overall_trend == "deteriorating", F.array(*map(F.lit, rules.ADVICE_DEGRADING))).otherwise(none)
    lines = F.when(status == "fault", F.concat(head, per_limit, tail)).otherwise(calm)
    first = F.slice(lines, 1, 5)
    return F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(rules.ADVICE_NONE)))


def diagnose(
    readings: DataFrame, limits: Sequence[Limit], score: str = "anomaly_score", trends: DataFrame | None = None
) -> DataFrame:
    """Status, severity, location and advice for every node at once.

    ``readings`` carries the anomaly decision in ``score`` (negative is an outlier).
    """
    rows = readings.withColumn("_broken", broken_limits(limits))
    broken = F.col("_broken")
    status, severity = scores.fault_status(F.col(score), F.col(score) < 0, F.size(broken))
    rows = rows.withColumns({"status": status, "severity": severity})
    overall = None
    if trends is not None:
        rows = rows.join(trends.select("node_name", "overall"), "node_name", "left")
        overall = F.col("overall")
    return rows.select(
        "node_name",
        "timestamp",
        score,
        "status",
        "severity",
        F.size(broken).alias("violations"),
        location(broken).alias("location"),
        F.array_join(F.transform(broken, lambda r: r["metric"]), ",").alias("violated"),
        F.array_join(advice(broken, F.col("status"), F.col("severity"), overall), "; ").alias("recommendations"),
    )


def scan_summary(diagnoses: DataFrame) -> DataFrame:
    """Nodes per outcome of a network scan."""
    fault, severity = F.col("status") == "fault", F.col("severity")
    return diagnoses.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~fault).alias("normal"),
        F.count_if(fault & (severity == "LOW")).alias("low"),
        F.count_if(fault & (severity == "MEDIUM")).alias("medium"),
        F.count_if(fault & (severity == "HIGH")).alias("high"),
    )


def urgent_nodes(diagnoses: DataFrame) -> DataFrame:
    """Nodes with a HIGH fault, as rows: the list may be as long as the network."""
    return diagnoses.filter((F.col("status") == "fault") & (F.col("severity") == "HIGH")).select("node_name", "violations")


def generated_alerts(node_metrics: DataFrame, link_metrics: DataFrame, newest: int = 5) -> DataFrame:
    """The newest breaches per alert rule, as alert rows."""
    parts = []
    for rule in rules.ALERT_RULES:
        source = link_metrics if rule.entity == "link" else node_metrics
        name = f"{rule.entity}_name"
        breaches = (
            source.filter(F.col(rule.metric) > rule.limit)
            .orderBy(F.col("timestamp").desc(), F.col(name))
            .limit(newest)
        )
        parts.append(
            breaches.select(
                F.lit(rule.entity).alias("entity_type"),
                F.col(name).alias("entity_name"),
                "timestamp",
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.alert_type).alias("alert_type"),
                F.lit(rule.metric).alias("metric_name"),
                F.lit(rule.message).alias("message"),
                F.col(rule.metric).alias("current_value"),
                F.lit(rule.limit).alias("threshold_value"),
                F.lit("max").alias("threshold_type"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anomaly_history(scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Per node: points, outliers, rate in percent, spread of the scores, verdict."""
    out = scored.groupBy("node_name").agg(
        F.count(F.lit(1)).alias("total_points"),
        F.count_if(F.col(score) < 0).alias("anomalies_detected"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
    )
    rate = F.round(F.col("anomalies_detected") / F.col("total_points") * 100, 2)
    return out.withColumn("anomaly_rate", rate).withColumn("verdict", scores.rate_verdict(F.col("anomaly_rate")))


def first_anomalies(scored: DataFrame, n: int = 10, score: str = "anomaly_score") -> DataFrame:
    """The newest outliers per node."""
    return first_per_group(scored.filter(F.col(score) < 0), ["node_name"], [F.col("timestamp").desc()], n)


# -- learning ------------------------------------------------------------------


def train_split(matrix: DataFrame, minimum: int = 100) -> DataFrame:
    """Mark about 80 % of the rows of each node for training, all if there are few."""
    sizes = matrix.groupBy("node_name").agg(F.count(F.lit(1)).alias("_n"))
    # the first digits of a digest, so that any engine can draw the same rows
    chosen = _bits(F.md5(F.concat_ws("|", "node_name", _moment())), 1) % 10 < 8
    return scale.beside(matrix, sizes, ["node_name"]).withColumn("is_train", (F.col("_n") < minimum) | chosen).drop("_n")


def scaling(matrix: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Mean and population deviation per node and feature (deviation 0, also by rounding alone, counts as 1)."""
    aggregates = []
    for f in features:
        spread, noise = F.stddev_pop(f), 1e-9 * F.greatest(F.lit(1.0), F.abs(F.avg(f)))
        aggregates += [F.avg(f).alias(f"mean_{f}"), F.when(spread > noise, spread).otherwise(1.0).alias(f"std_{f}")]
    return matrix.groupBy("node_name").agg(*aggregates)


def standardised(matrix: DataFrame, scale_table: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    kept = [c for c in matrix.columns if c not in features]
    return scale.beside(matrix, scale_table, ["node_name"]).select(
        *kept, *[((F.col(f) - F.col(f"mean_{f}")) / F.col(f"std_{f}")).alias(f) for f in features]
    )


def with_feature_defaults(readings: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Features absent when scoring take their default, else 0."""
    default = rules.FEATURE_DEFAULTS
    return readings.withColumns(
        {
            f: F.coalesce(F.col(f), F.lit(default.get(f, 0.0))) if f in readings.columns else F.lit(default.get(f, 0.0))
            for f in features
        }
    )


TREES = 100
SAMPLE = 256
EULER = 0.5772156649


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    large = np.maximum(n, 3.0)
    grown = 2.0 * (np.log(large - 1.0) + EULER) - 2.0 * (large - 1.0) / large
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, grown))


MODEL_SCHEMA = (
    "node_name string, tree int, sample int, feature array<int>, split array<double>, "
    "low array<int>, high array<int>, depth array<double>"
)


def _draw(*names) -> int:
    """32 bits from the names alone, so that any engine draws the same."""
    return int(hashlib.md5("|".join(map(str, names)).encode()).hexdigest()[:8], 16)


def _grow(points: np.ndarray, features: list[str], node: str, tree: int) -> dict[str, np.ndarray]:
    """One isolation tree in flat form, grown a level at a time.

    A node is named by its path (1 for the root, 2p and 2p + 1 below p), and draws
    by that name: of the features that vary, the one of highest draw, cut at a
    drawn share of its range; values up to the cut go low.  A leaf has feature -1
    and its path length in ``depth``.
    """
    n = len(points)
    limit = int(np.ceil(np.log2(max(n, 2))))
    feature, low, high = (np.full(2 * n + 1, -1, dtype="int32") for _ in range(3))
    split, depth = np.zeros(2 * n + 1), np.zeros(2 * n + 1)
    used, nodes, paths = 1, np.array([0]), [1]  # the nodes of this level and their names
    rows, place = np.arange(n), np.zeros(n, dtype=int)  # points still moving, and their node's position in ``nodes``
    for level in range(limit + 1):
        sizes = np.bincount(place, minlength=len(nodes))
        if level == limit:
            depth[nodes] = level + average_path(sizes)
            break
        order = np.argsort(place, kind="stable")
        rows, place = rows[order], place[order]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        least = np.minimum.reduceat(points[rows], starts, axis=0)
        most = np.maximum.reduceat(points[rows], starts, axis=0)
        usable = most > least
        splits = usable.any(axis=1)
        depth[nodes[~splits]] = level + average_path(sizes[~splits])
        if not splits.any():
            break
        chosen, cut = np.zeros(len(nodes), dtype=int), np.zeros(len(nodes))
        for k in np.flatnonzero(splits):
            chosen[k] = max(np.flatnonzero(usable[k]), key=lambda j: (_draw(node, tree, paths[k], features[j]), -j))
            a, b = least[k, chosen[k]], most[k, chosen[k]]
            cut[k] = a + _draw(node, tree, paths[k], "cut") / 2**32 * (b - a)
            cut[k] = cut[k] if cut[k] < b else a
        child = used + 2 * (np.cumsum(splits) - 1)
        inner = nodes[splits]
        feature[inner], split[inner] = chosen[splits], cut[splits]
        low[inner], high[inner] = child[splits], child[splits] + 1
        moving = splits[place]
        rows, place = rows[moving], place[moving]
        below = points[rows, chosen[place]] <= cut[place]
        first = 2 * (np.cumsum(splits) - 1)
        nodes, paths = used + np.arange(2 * len(inner)), [2 * paths[k] + side for k in np.flatnonzero(splits) for side in (0, 1)]
        used += 2 * len(inner)
        place = first[place] + np.where(below, 0, 1)
    flat = {"feature": feature, "split": split, "low": low, "high": high, "depth": depth}
    return {name: values[:used] for name, values in flat.items()}


#: Digits that features and scores are rounded to, so that sums in another order give the same trees and labels.
DIGITS = 9


def _moment() -> Column:
    return F.unix_micros(F.col("timestamp").cast("timestamp")).cast("string")


def _bits(digest: Column, place: int) -> Column:
    return F.conv(F.substring(digest, place, 8), 16, 10).cast("bigint")


def fit_forests(rows: DataFrame, features: Sequence[str] = tuple(FEATURES), trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """One isolation forest per node: a row per (node, tree).

    Each row offers itself to only as many trees as are needed for about four
    times the sample size per tree, so that even a node holding a third of all
    rows sends a bounded number of rows to a tree.  Whatever is drawn comes from
    digests of names, so the same rows give the same forest in any engine.
    """
    features = list(features)
    sizes = rows.groupBy("node_name").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.lit(4.0 * sample * trees)
    copies = F.least(F.lit(trees), F.ceil(wanted / F.col("_n"))).cast("int")
    keep = wanted / (F.col("_n") * F.col("_copies"))
    slim = rows.select("node_name", "timestamp", *[F.round(f, DIGITS).alias(f) for f in features])
    offered = (
        scale.beside(slim, sizes, ["node_name"])
        .withColumns({"_copies": copies, "_digest": F.md5(F.concat_ws("|", "node_name", _moment(), F.lit("offer")))})
        .filter((keep >= 1) | (_bits(F.col("_digest"), 1) < keep * 2.0**32))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .withColumn("tree", ((_bits(F.col("_digest"), 9) + F.col("_j")) % trees).cast("int"))
        .withColumn("_order", F.md5(F.concat_ws("|", "node_name", F.col("tree").cast("string"), _moment())))
    )
    offered = scale.workers(offered, "node_name", "tree")
    chosen = scale.top_k(offered, ["node_name", "tree"], [F.col("_order"), F.col("timestamp")], sample, "_rank")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, tree = key
        points = pdf.sort_values("_rank")[features].to_numpy(dtype=float)
        return pd.DataFrame([{"node_name": node, "tree": tree, "sample": len(points), **_grow(points, features, node, int(tree))}])

    columns = chosen.select("node_name", "tree", "_rank", *features)
    return columns.groupBy("node_name", "tree").applyInPandas(build, MODEL_SCHEMA)


def _paths(points: np.ndarray, model: pd.DataFrame) -> np.ndarray:
    """Mean path length of every point over the trees of a model."""
    total = np.zeros(len(points))
    each = np.arange(len(points))
    for tree in model.itertuples():
        feature, split = np.asarray(tree.feature), np.asarray(tree.split)
        low, high, depth = np.asarray(tree.low), np.asarray(tree.high), np.asarray(tree.depth)
        at = np.zeros(len(points), dtype=int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes_low = points[each, np.maximum(f, 0)] <= split[at]
            at = np.where(inner, np.where(goes_low, low[at], high[at]), at)
        total += depth[at]
    return total / max(len(model), 1)


ROWS_PER_GROUP = 20_000


def forest_scores(rows: DataFrame, model: DataFrame, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Raw score of every row, in (-1, 0); lower is stranger.

    Rows of a node are split into groups of about ``ROWS_PER_GROUP`` and the
    node's forest travels to each group, so nothing is broadcast and no group
    grows with the node.
    """
    features = list(features)
    sizes = rows.groupBy("node_name").agg(
        F.ceil(F.count(F.lit(1)) / ROWS_PER_GROUP).cast("bigint").alias("_groups")
    )
    left = (
        scale.beside(rows.select("node_name", "timestamp", *[F.round(f, DIGITS).alias(f) for f in features]), sizes, ["node_name"])
        .withColumn("_group", F.pmod(F.xxhash64("timestamp", *features), F.col("_groups")))
        .drop("_groups")
    )
    right = model.join(sizes, "node_name").withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups") - 1)))

    def score(key: tuple, part: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if part.empty or forest.empty:
            return pd.DataFrame({"node_name": [], "timestamp": [], "raw_score": []})
        points = part[features].to_numpy(dtype=float)
        norm = float(average_path(forest["sample"].max())) or 1.0
        raw = np.round(-np.power(2.0, -_paths(points, forest.sort_values("tree")) / norm), DIGITS)
        return pd.DataFrame({"node_name": part["node_name"], "timestamp": part["timestamp"], "raw_score": raw})

    stamp = dict(rows.dtypes)["timestamp"]
    left, right = (scale.workers(side, "node_name", "_group") for side in (left, right.drop("_groups")))
    return (
        left.groupBy("node_name", "_group")
        .cogroup(right.groupBy("node_name", "_group"))
        .applyInPandas(score, f"node_name string, timestamp {stamp}, raw_score double")
    )


def score_offsets(train_scores: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Per node the linear-interpolated quantile of the training scores, exactly.

    Equal scores are counted first; the running count over the distinct scores
    is bucketed, so neither a large node nor a frequent score crowds a task.
    """
    counts = train_scores.groupBy("node_name", "raw_score").agg(F.count(F.lit(1)).alias("_count"))
    rows = scale.spread(counts.withColumn("_bucket", F.floor(F.col("raw_score") * 10_000)), ["node_name"], "_bucket")
    running = scale.split_running_sum(rows, ["node_name"], "_bucket", [F.col("raw_score")], "_count", "_upto")
    sizes = train_scores.groupBy("node_name").agg(F.count(F.lit(1)).alias("_n"))
    place = (F.col("_n") - 1) * F.lit(contamination)
    low = F.floor(place)
    part = place - low

    def holds(position: Column) -> Column:
        return (F.col("_upto") - F.col("_count") < position) & (position <= F.col("_upto"))

    weight = F.when(holds(low + 1), 1 - part).otherwise(0.0) + F.when(holds(low + 2), part).otherwise(0.0)
    return (
        scale.beside(running, sizes, ["node_name"])
        .withColumn("_w", weight)
        .filter(F.col("_w") > 0)
        .groupBy("node_name")
        .agg(F.sum(F.col("_w") * F.col("raw_score")).alias("offset"))
    )


def decisions(raw: DataFrame, offsets: DataFrame) -> DataFrame:
    """Anomaly score (negative is an outlier), label and confidence."""
    score = F.round(F.col("raw_score") - F.col("offset"), DIGITS)
    return scale.beside(raw, offsets, ["node_name"]).select(
        "node_name",
        "timestamp",
        score.alias("anomaly_score"),
        F.when(score < 0, -1).otherwise(1).alias("prediction"),
        scores.anomaly_confidence(score).alias("confidence"),
    )


def holdout_report(decided: DataFrame) -> DataFrame:
    """Quality of a forest on rows it was not fitted on."""
    score = F.col("anomaly_score")
    return decided.groupBy("node_name").agg(
        F.count(F.lit(1)).alias("test_samples"),
        F.count_if(score < 0).alias("outliers_detected"),
        (F.count_if(score < 0) / F.count(F.lit(1))).alias("outlier_ratio"),
        F.avg(score).alias("avg_anomaly_score"),
        F.min(score).alias("min_anomaly_score"),
        F.max(score).alias("max_anomaly_score"),
        F.stddev_pop(score).alias("std_anomaly_score"),
    )
