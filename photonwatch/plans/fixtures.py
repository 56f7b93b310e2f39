"""The network tables as DataFrames derived from the driver tables.

``fixture_sql`` states the same tables in SQL; the two are written separately
so that the registered queries are checked against independent text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions.rules import inline

AS_OF_OPS = "1998-06-17 00:00:00"
AS_OF_TELE = "2024-01-31 00:00:00"


def at(moment: str) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(moment).cast("timestamp_ntz")


def _text(prefix: str, *parts: Column) -> Column:
    out = [F.lit(prefix)]
    for i, part in enumerate(parts):
        out += ([F.lit("_")] if i else []) + [part.cast("string")]
    return F.concat(*out)


def _choose(key: Column, values: list[str]) -> Column:
    """The n-th value for key n, the last one beyond."""
    out = F.lit(values[-1])
    for i, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(key == i, value).otherwise(out)
    return out


class Tables:
    """Lazy access to the driver tables and the network tables built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _ring(self) -> tuple[Column, Column]:
        supplier = self.raw("supplier")
        return (
            supplier.agg(F.count(F.lit(1)).alias("n")).scalar(),
            supplier.agg(F.min("s_suppkey").alias("lo")).scalar(),
        )

    # -- operational tables -------------------------------------------------

    @cached_property
    def nodes(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"),
            _text("NODE_", k).alias("node_id"),
            F.when(k % 4 == 3, "Switch").otherwise("QKD").alias("type"),
            F.when(k % 5 == 0, "Offline").otherwise("Online").alias("status"),
            F.when(k % 7 == 0, "Temporary").otherwise("Created").alias("state"),
            F.abs("s_acctbal").alias("key_pool_remaining"),
            F.col("s_nationkey").alias("site"),
        )

    @cached_property
    def links(self) -> DataFrame:
        n, lo = self._ring
        src, d = F.col("s_suppkey"), F.col("d")
        ends = (
            self.raw("supplier")
            .select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(7))).alias("d"))
            .select(src.alias("s"), "d", ((src - lo + d) % n + lo).alias("e"))
        )
        s, e = F.col("s"), F.col("e")
        return ends.select(
            (s * 2 + F.when(d == 1, 0).otherwise(1)).alias("id"),
            _text("LINK_", s, e).alias("link_id"),
            s.alias("source_node"),
            e.alias("destination_node"),
            F.when((s % 4 != 3) & (e % 4 != 3), "Quantum").otherwise("Classical").alias("link_type"),
            (((s * 37 + d * 11) % 130).cast("double") / 10).alias("qber"),
            (F.lit(80) + ((s * 53 + d * 7) % 200).cast("double") / 10).alias("visibility"),
            (((s * 29 + d * 3) % 150).cast("double") / 10).alias("key_rate"),
            (((s * 17 + d * 5) % 400).cast("double") / 10).alias("photon_loss"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        n, lo = self._ring
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            _text("S_", F.col("o_orderkey")).alias("session_id"),
            (F.col("o_custkey") % n + lo).alias("source_node"),
            ((F.col("o_custkey") * 3 + 1) % n + lo).alias("destination_node"),
            F.when(F.col("o_orderstatus") == "O", "Active")
            .when(F.col("o_orderstatus") == "P", "Failed")
            .otherwise("Closed")
            .alias("status"),
            F.col("o_orderdate").alias("start_time"),
        )

    @cached_property
    def session_path(self) -> DataFrame:
        n, lo = self._ring
        lines = scale.split_row_number(
            self.raw("lineitem")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .withColumn("_bucket", F.floor(F.col("l_linenumber") / 1024)),
            ["l_orderkey"],
            "_bucket",
            [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")],
            "step",
        )
        # one row per order grows with the data: judged by its packed file it would be broadcast by way of the driver
        orders = self.raw("orders").select("o_orderkey", (F.col("o_custkey") % n).alias("base")).hint("merge")
        step, base = F.col("step"), F.col("base")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("session_id"),
            step.cast("bigint").alias("step_order"),
            (
                (
                    F.when(F.col("l_orderkey") % 2 == 0, (base + step - 1) % n).otherwise(
                        F.pmod(base - step, n)
                    )
                    + lo
                )
                * 2
            ).alias("link_id"),
        )

    @cached_property
    def faults(self) -> DataFrame:
        n, lo = self._ring
        k, who, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
        status = F.col("o_orderstatus")
        seen = status != "O"
        node = who % n + lo
        hours = F.when(status == "F", F.when(k % 2 == 0, 9).otherwise(30))
        return self.raw("orders").select(
            k.alias("id"),
            F.concat(F.lit("FLT_"), F.when(k < 1000, F.lpad(k.cast("string"), 3, "0")).otherwise(k.cast("string"))).alias(
                "fault_id"
            ),
            F.when(k % 3 == 0, "Link").otherwise("Node").alias("component_type"),
            F.when(k % 3 == 0, node * 2).otherwise(node).alias("component_id"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Critical")
            .when(F.col("o_orderpriority") == "2-HIGH", "Warning")
            .otherwise("Info")
            .alias("severity"),
            F.when(status == "O", "Open").when(status == "P", "Ongoing").otherwise("Resolved").alias("status"),
            date.alias("detected_at"),
            F.when(seen, date + F.expr("interval 3 hours")).alias("acknowledged_at"),
            (date + F.make_dt_interval(hours=hours)).alias("resolved_at"),
            F.when(seen, who).alias("acknowledged_by"),
            F.when(seen, who + 1).alias("assigned_to"),
            F.when(status == "F", who + 1).alias("resolved_by"),
            F.when(k % 5 == 0, k).alias("alert_id"),
        )

    # -- governance -----------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        last = at("1998-06-17 12:00:00") - F.make_dt_interval(days=(k % 60).cast("int"))
        return self.raw("customer").select(
            k.alias("uuid"),
            F.col("c_name").alias("name"),
            (k % 6).alias("role_id"),
            _choose(k % 5, ["Online", "Offline", "Locked", "Deactivated", "Invited"]).alias("status"),
            F.when(k % 11 != 0, last).alias("last_login"),
        )

    @cached_property
    def roles(self) -> DataFrame:
        names = ["Super Admin", "System Automation", "Administrator", "Operator", "Analyst", "Viewer"]
        return inline(self.spark, list(enumerate(names)), "id bigint, role_name string")

    @cached_property
    def permissions(self) -> DataFrame:
        names = ["fault.acknowledge", "fault.resolve", "alert.escalate", "policy.view"]
        return inline(self.spark, list(enumerate(names, 1)), "id bigint, permission_name string")

    @cached_property
    def roles_permissions(self) -> DataFrame:
        pairs = [(r, p) for r in range(6) for p in range(1, 5) if r <= 2 or (r == 3 and p <= 2) or p == 4]
        return inline(self.spark, pairs, "role_id bigint, permission_id bigint")

    @cached_property
    def role_requests(self) -> DataFrame:
        k, who = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            k.alias("id"),
            who.alias("assigned_to"),
            (who + k % 2).alias("requested_by"),
            (k % 6).alias("role_id"),
            F.when(F.col("o_orderstatus") == "P", "Pending Approval").otherwise("Approved").alias("status"),
        )

    @cached_property
    def user_sessions(self) -> DataFrame:
        return (
            self.raw("events")
            .filter(F.col("event_type") == "purchase")
            .select(
                F.col("user_id"),
                _text("TOK_", F.col("event_id")).alias("session_token"),
                F.col("ts").alias("created_at"),
                (F.col("ts") + F.expr("interval 30 minutes")).alias("expires_at"),
            )
        )

    @cached_property
    def policies(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        return self.raw("part").select(
            k.alias("id"),
            F.col("p_name").alias("policy_name"),
            _choose(k % 3, ["Weightage", "Threshold", "Security"]).alias("policy_type"),
            _choose(size % 3, ["Global", "Node", "Link"]).alias("scope"),
            F.when(size % 2 == 0, "Active").otherwise("Inactive").alias("status"),
            (k % 4 + 1).alias("priority"),
            (k % 10 == 0).alias("is_deleted"),
            F.when(k % 3 != 0, k % 1000).alias("created_by"),
        )

    @cached_property
    def policy_rules(self) -> DataFrame:
        line = F.col("l_linenumber")
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("policy_id"),
            _choose(line % 4, ["QBER", "Visibility", "Photon Loss", "Key Rate"]).alias("metric"),
            F.col("l_quantity").alias("value"),
            F.col("l_discount").alias("weight"),
        )

    @cached_property
    def policy_target(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("policy_id"),
            _choose(F.col("l_linenumber") % 3, ["Node", "Link", "Site"]).alias("target_type"),
            F.col("l_suppkey").alias("target_id"),
        )

    # -- logs -----------------------------------------------------------------

    @cached_property
    def keys_summaries(self) -> DataFrame:
        q = F.col("l_quantity")
        return self.raw("lineitem").select(
            F.col("l_shipdate").alias("timestamp"),
            q.alias("keys_generated"),
            (q * (1 - F.col("l_discount"))).alias("keys_consumed"),
            (q * F.col("l_tax")).alias("keys_expired"),
            (F.col("l_tax") * 100).alias("avg_retention_time"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        n, lo = self._ring
        k, value = F.col("event_id"), F.col("value")
        return (
            self.raw("events")
            .filter(F.col("event_type") == "error")
            .select(
                k.alias("id"),
                _text("ALR_", k).alias("alert_id"),
                _choose(k % 4, ["Low Visibility", "Low Key Pool", "High Photon Loss", "QBER Spike"]).alias("type"),
                F.when(value > 40, "Critical").when(value > 15, "Warning").otherwise("Info").alias("severity"),
                _choose(F.col("user_id") % 3, ["Resolved", "Escalated", "Open"]).alias("status"),
                F.when(k % 3 == 0, "Link").otherwise("Node").alias("component_type"),
                F.when(k % 3 == 0, (k % n + lo) * 2).otherwise(k % n + lo).alias("component_id"),
                F.col("ts").alias("detected_at"),
                F.concat(
                    F.lit("Reading "), F.col("props"), F.lit(" beyond limit. Raised by user "), F.col("user_id").cast("string")
                ).alias("description"),
            )
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        n, lo = self._ring
        k = F.col("event_id")
        return self.raw("events").select(
            k.alias("id"),
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("action_type"),
            F.col("user_id").alias("performed_by"),
            (k % 2500).alias("policy_id"),
            (k * 3 % 30000).alias("fault_id"),
            k.alias("alert_id"),
            _choose(k % 3, ["Node", "Link", "Site"]).alias("component_type"),
            F.when(k % 3 == 1, (k % n + lo) * 2).otherwise(k % n + lo).alias("component_id"),
            F.when(k % 4 == 0, "Failed").otherwise("Success").alias("outcome"),
            F.col("props").alias("notes"),
        )

    @cached_property
    def login_log(self) -> DataFrame:
        return (
            self.raw("events")
            .filter(F.col("event_type").isin("error", "purchase"))
            .select(
                "event_id",
                F.col("user_id"),
                F.col("ts"),
                (F.col("event_type") == "purchase").alias("success"),
            )
        )

    @cached_property
    def service_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("service_id"),
            "ts",
            F.when(kind == "purchase", "active").when(kind == "error", "failed").otherwise(kind).alias("state"),
        )

    # -- telemetry ------------------------------------------------------------

    @cached_property
    def tele_nodes(self) -> DataFrame:
        m = F.col("user_id") % 12
        return (
            self.raw("events")
            .select(_text("N", m).alias("node_name"), F.when(m == 11, "Switch").otherwise("QKD").alias("node_type"))
            .distinct()
        )

    @cached_property
    def tele_links(self) -> DataFrame:
        m = F.col("user_id") % 9
        return (
            self.raw("events")
            .select(
                _text("T", m).alias("link_name"),
                _text("N", m).alias("source_node"),
                _text("N", (m * 5 + 2) % 12).alias("destination_node"),
                F.when(m == 8, "Classical").otherwise("Quantum").alias("link_type"),
            )
            .distinct()
        )

    @cached_property
    def node_metrics(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value")
        return (
            self.raw("events")
            .filter(kind != "purchase")
            .groupBy(
                _text("N", F.col("user_id") % 12).alias("node_name"),
                F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
            )
            .agg(
                F.avg(F.when(kind == "view", F.least(value, F.lit(100.0)))).alias("cpu_usage"),
                F.avg(F.when(kind == "click", F.least(value * 2, F.lit(100.0)))).alias("memory_usage"),
                F.avg(F.lit(20) + F.least(value, F.lit(60.0))).alias("temperature"),
                (F.avg(value) * 10).alias("aggregated_key_rate"),
                F.sum(F.when(kind == "error", 1).otherwise(0)).alias("error_count"),
            )
        )

    @cached_property
    def link_metrics(self) -> DataFrame:
        mean = F.avg("value")
        rate = F.lit(2000) - F.least(mean * 10, F.lit(1900.0))
        return (
            self.raw("events")
            .filter(F.col("event_type").isin("purchase", "signup"))
            .groupBy(
                _text("T", F.col("user_id") % 9).alias("link_name"),
                F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
            )
            .agg(
                F.least(mean / 1000, F.lit(0.1)).alias("qber"),
                (F.lit(1) - F.least(mean / 500, F.lit(0.3))).alias("visibility"),
                rate.alias("key_rate"),
                (F.lit(5) + F.least(mean / 10, F.lit(10.0))).alias("laser_power"),
                mean.alias("attenuation"),
                F.least(mean, F.lit(60.0)).alias("photon_loss"),
                F.max(F.lit(0.1)).alias("detector_efficiency"),
                (F.lit(0.9) * rate).alias("secure_key_rate"),
            )
        )

    # -- documents ------------------------------------------------------------

    @cached_property
    def library(self) -> DataFrame:
        """One row per source file, the parent of the chunks."""
        return (
            self.raw("documents")
            .groupBy("source")
            .agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("n_chars").alias("size_bytes"), F.min("doc_id").alias("id"))
            .select(
                "id",
                F.col("source").alias("filename"),
                "chunk_count",
                "size_bytes",
                F.when(F.col("id") % 7 == 3, "deleted").otherwise("active").alias("status"),
            )
        )

    @cached_property
    def chunks(self) -> DataFrame:
        docs = self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("filename"),
            F.col("text").alias("content"),
            F.floor(F.col("doc_id") / 4096).alias("_bucket"),
        )
        ranked = scale.split_row_number(docs, ["filename"], "_bucket", [F.col("id")], "_rank")
        labels = self.raw("labels").select(F.col("doc_id").alias("id"), "toxic")
        vectors = self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return (
            ranked.join(labels, "id", "left")
            .join(vectors, "id", "left")
            .select(
                "id",
                "filename",
                "content",
                "embedding",
                (F.col("_rank") - 1).alias("chunk_index"),
                F.when(F.col("toxic") == 1, "inactive").otherwise("active").alias("status"),
            )
        )

    @cached_property
    def questions(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
