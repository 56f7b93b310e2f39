"""Nodes, links, sessions and the paths sessions take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions import scores


def links_with_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each link with the names of both end nodes."""
    src = nodes.select(F.col("id").alias("source_node"), F.col("node_id").alias("source_node_id"))
    dst = nodes.select(F.col("id").alias("destination_node"), F.col("node_id").alias("destination_node_id"))
    return links.join(src, "source_node").join(dst, "destination_node")


def incidence(links: DataFrame, node: str = "node") -> DataFrame:
    """One row per (node, link) with the node at either end; an OR join becomes an equi-join."""
    ends = F.array_distinct(F.array("source_node", "destination_node"))
    return links.withColumn(node, F.explode(ends))


def new_links(requests: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Acceptable link requests: both nodes exist, no self-loop, no link yet in either direction."""
    ends = nodes.select("node_id", "id", "type")
    named = (
        requests.filter(F.col("source") != F.col("destination"))
        .join(ends.toDF("source", "source_node", "_source_type"), "source")
        .join(ends.toDF("destination", "destination_node", "_destination_type"), "destination")
        .withColumns(
            {
                "_low": F.least("source_node", "destination_node"),
                "_high": F.greatest("source_node", "destination_node"),
                "link_type": scores.link_type_of(F.col("_source_type"), F.col("_destination_type")),
            }
        )
    )
    present = links.select(
        F.least("source_node", "destination_node").alias("_low"),
        F.greatest("source_node", "destination_node").alias("_high"),
    )
    return named.join(present, ["_low", "_high"], "left_anti").select(
        "request_id", "source_node", "destination_node", "link_type"
    )


def session_counts(sessions: DataFrame, session_path: DataFrame) -> DataFrame:
    """Distinct active sessions per link."""
    active = sessions.filter(F.col("status") == "Active").select(F.col("id").alias("session_id"))
    return (
        session_path.join(active, "session_id")
        .groupBy("link_id")
        .agg(F.count_distinct("session_id").alias("active_session_count"))
    )


def scored_links(links: DataFrame, nodes: DataFrame, sessions: DataFrame, session_path: DataFrame) -> DataFrame:
    """Quantum links with ends, active sessions (0 if none), scores and severity."""
    counts = session_counts(sessions, session_path).withColumnRenamed("link_id", "id")
    quantum = links.filter(F.col("link_type") == "Quantum")
    return (
        links_with_ends(quantum, nodes)
        .join(counts, "id", "left")
        .select(
            "link_id",
            "source_node_id",
            "destination_node_id",
            F.coalesce("active_session_count", F.lit(0)).alias("active_session_count"),
            scores.instability().alias("instability_score"),
            scores.quality_index().alias("qlqi"),
        )
        .withColumn("severity", scores.quality_band(F.col("qlqi")))
    )


def link_health(scored: DataFrame) -> DataFrame:
    """Bands of the links in use, and the headline."""
    band = scores.instability_band(F.col("instability_score"))
    totals = scored.filter(F.col("active_session_count") > 0).agg(
        *[F.count_if(band == b).alias(f"total_{b.lower()}") for b in ("Healthy", "Warning", "Critical")]
    )
    critical, warning = F.col("total_critical"), F.col("total_warning")
    headline = (
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" Critical")))
        .when(warning > 0, F.concat(warning.cast("string"), F.lit(" Warning")))
        .when(F.col("total_healthy") > 0, "All Links Healthy")
        .otherwise("No Links Found")
    )
    return totals.withColumn("headline", headline)


def most_degraded(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy(F.col("instability_score").desc(), "link_id").limit(k)


def failed_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("status") == "Failed").agg(F.count(F.lit(1)).alias("blocked_sessions"))


_STEP_BUCKET = 1024


def path_hops(steps: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Walk every session along its ordered links, taking each link in the fitting direction.

    ``steps``: session_id, step_order, source_node, destination_node.
    ``starts``: session_id, start_node; without it the walk starts at the first
    link's source.  Result: session_id, step_order, from_node, to_node.

    A link leads to its far end if it starts where the walk stands, else to its
    source.  So after a step the walk is at one of two ends, and what a step
    does to that choice is one of: fix it, keep it, flip it.  The position is
    then the last fixed choice, flipped once per flip since: a fill and a
    running sum, which need no per-session loop and no array.
    """
    key, order = ["session_id"], ["step_order"]
    before = {"source_node": "_ps", "destination_node": "_pd"}
    # without nulls in what is joined, the branches below differ in no filter and share this shuffle; steps without an order come first
    bucket = F.coalesce(F.floor(F.col("step_order") / _STEP_BUCKET), F.lit(-(2**62)))
    rows = scale.spread(steps.dropna(subset=key).withColumn("_bucket", bucket), key, "_bucket")
    # a start goes once to each bucket of its session, so that this shuffle is the only one of the paths
    rows = scale.split_lag(rows, key, "_bucket", order, before, None if starts is None else starts.withColumnRenamed("start_node", "_start"))
    rows = rows.filter(F.col("step_order").isNotNull())
    s, d = F.col("source_node"), F.col("destination_node")
    if starts is None:
        rows = rows.withColumn("_start", s)
    first = F.col("_ps").isNull()
    at_start = s == F.col("_start")
    rows = rows.withColumns(
        {
            "_near": F.when(first, at_start).otherwise(s == F.col("_ps")),
            "_far": F.when(first, at_start).otherwise(s == F.col("_pd")),
        }
    )
    fixes = F.col("_near") == F.col("_far")
    flips = F.when(fixes | F.col("_far"), 0).otherwise(1)

    # inside a bucket: flips so far, and the last fixed choice with the flips at that point
    inside = Window.partitionBy("session_id", "_bucket").orderBy("step_order")
    rows = rows.withColumn("_flips", F.sum(flips).over(inside))
    rows = rows.withColumn(
        "_fix", F.last(F.when(fixes, F.struct(F.col("_near").alias("far"), F.col("_flips").alias("at"))), True).over(inside)
    )
    # the state a bucket ends in: known if it holds a fixed choice, else relative to the state before
    ends = rows.groupBy("session_id", "_bucket").agg(F.max_by(F.struct("_flips", "_fix"), "step_order").alias("_end"))
    end_flips, end_fix = F.col("_end._flips"), F.col("_end._fix")
    chain = Window.partitionBy("session_id").orderBy("_bucket")
    ends = ends.withColumn("_sum", F.sum(end_flips).over(chain)).withColumn(
        "_known",
        F.last(
            F.when(
                end_fix.isNotNull(),
                F.struct(end_fix["far"].alias("far"), (F.col("_sum") - end_flips + end_fix["at"]).alias("at")),
            ),
            True,
        ).over(chain),
    )
    ends = ends.withColumn("_out", F.col("_known.far") != ((F.col("_sum") - F.col("_known.at")) % 2 == 1))
    ends = ends.select("session_id", "_bucket", F.lag("_out").over(chain).alias("_in"))
    # most sessions have one bucket: only buckets that others come before are joined
    rows = rows.join(ends.filter(F.col("_in").isNotNull()), ["session_id", "_bucket"], "left")

    since = F.col("_flips") - F.coalesce(F.col("_fix.at"), F.lit(0))
    at_far = F.coalesce(F.col("_fix.far"), F.col("_in")) != (since % 2 == 1)
    rows = rows.withColumn("_at_far", at_far)
    before = F.coalesce(F.lag("_at_far").over(inside), F.col("_in"))
    came_from = F.when(first, F.col("_start")).when(before, F.col("_pd")).otherwise(F.col("_ps"))
    return rows.select(
        "session_id",
        "step_order",
        came_from.alias("from_node"),
        F.when(F.col("_at_far"), d).otherwise(s).alias("to_node"),
        "_bucket",
    )


def session_steps(session_path: DataFrame, links: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Ordered links of each session with the ids of their ends; ``sessions`` restricts."""
    if sessions is not None:
        wanted = sessions.select(F.col("id").alias("session_id"))
        session_path = session_path.join(wanted, "session_id", "left_semi")
    ends = links.select(F.col("id").alias("link_id"), "source_node", "destination_node")
    return session_path.join(ends, "link_id").select("session_id", "step_order", "source_node", "destination_node")


def path_text(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths as text for a page of sessions; restrict the sessions before walking."""
    names = nodes.select(F.col("id").alias("node"), "node_id")
    places = hops.select("session_id", F.col("step_order").alias("position"), F.col("to_node").alias("node")).unionByName(
        hops.groupBy("session_id").agg(
            F.lit(0).cast("bigint").alias("position"), F.min_by("from_node", "step_order").alias("node")
        )
    )
    named = places.join(names, "node")
    ordered = F.array_sort(F.collect_list(F.struct("position", "node_id")))
    return named.groupBy("session_id").agg(F.array_join(ordered["node_id"], " > ").alias("path"))


def busiest_segments(hops: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent runs of three nodes, direction ignored, counted once per session."""
    runs = scale.split_lag(hops, ["session_id"], "_bucket", ["step_order"], {"from_node": "_first"}).filter(
        F.col("_first").isNotNull()
    )
    triple = F.sort_array(F.array("_first", "from_node", "to_node"))
    counted = (
        runs.select("session_id", triple.alias("segment"))
        .distinct()
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("num_sessions"))
        .orderBy(F.col("num_sessions").desc(), "segment")
        .limit(k)
    )
    named = counted.select(
        "num_sessions", *[F.col("segment")[i].alias(f"n{i}") for i in range(3)]
    )
    for i in range(3):
        named = named.join(nodes.select(F.col("id").alias(f"n{i}"), F.col("node_id").alias(f"node_{i + 1}")), f"n{i}")
    return named.select("node_1", "node_2", "node_3", "num_sessions")
