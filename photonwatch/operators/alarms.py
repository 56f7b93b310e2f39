"""Controller payloads: alarms and service inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions.rules import ALARM_SEVERITIES
from photonwatch.operators.filters import first_per_group

# Attribute names of the alarm payload and the columns they become.
ALARM_FIELDS = {
    "alarm-id": "alarm_id",
    "device-name": "device_name",
    "device-type": "device_type",
    "ip-address": "ip_address",
    "mac-address": "mac_address",
    "condition-severity": "severity",
    "state": "state",
    "native-condition-type": "condition",
    "native-condition-type-qualifier": "qualifier",
    "service-affecting": "service_affecting",
    "acknowledge-state": "acknowledge_state",
    "resource": "resource",
    "first-raise-time": "first_raise_time",
    "last-raise-time": "last_raise_time",
    "number-of-occurrences": "occurrences",
    "additional-text": "additional_text",
}

ALARM_PAYLOAD = (
    "struct<data: array<struct<attributes: struct<"
    + ", ".join(f"`{f}`: string" for f in ALARM_FIELDS)
    + ">>>>"
)
SERVICE_PAYLOAD = (
    "struct<items: array<struct<id: string, label: string, orchState: string, resourceTypeId: string, "
    "productId: string, properties: struct<name: string, serviceType: string, customerName: string, "
    "endpoints: array<struct<node: string, port: string, role: string>>>>>>"
)


def alarms(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """One row per alarm; absent attributes read ``Unknown``."""
    found = payloads.select(F.explode(F.from_json(text, ALARM_PAYLOAD)["data"]).alias("_a"))
    columns = []
    for field, name in ALARM_FIELDS.items():
        value = F.col("_a")["attributes"][field]
        if name in ("first_raise_time", "last_raise_time"):
            columns.append(F.try_to_timestamp(value).cast("timestamp_ntz").alias(name))
        elif name == "occurrences":
            columns.append(F.coalesce(value.cast("bigint"), F.lit(0)).alias(name))
        elif name in ("qualifier", "additional_text"):
            columns.append(value.alias(name))
        else:
            columns.append(F.coalesce(value, F.lit("Unknown")).alias(name))
    return found.select(*columns)


def find_alarms(
    rows: DataFrame,
    alarm_id: str | None = None,
    state: Sequence[str] | None = None,
    severity: Sequence[str] | None = None,
    device_name: str | None = None,
    device_type: Sequence[str] | None = None,
    ip_address: str | None = None,
    service_affecting: bool | None = None,
    hours_ago: int | None = None,
    as_of: Column | None = None,
    sort: str | None = None,
    page_size: int = 20,
) -> DataFrame:
    """All given filters together, sorted by last raise time (``-`` = newest first) or else by id, first page."""
    kept = filtered(rows, alarm_id, state, severity, device_name, device_type, ip_address, service_affecting, hours_ago, as_of)
    last = F.col("last_raise_time")
    order = [] if sort is None else [last.desc() if sort.startswith("-") else last.asc()]
    return kept.orderBy(*order, F.col("alarm_id")).limit(page_size)


def filtered(
    rows: DataFrame,
    alarm_id: str | None = None,
    state: Sequence[str] | None = None,
    severity: Sequence[str] | None = None,
    device_name: str | None = None,
    device_type: Sequence[str] | None = None,
    ip_address: str | None = None,
    service_affecting: bool | None = None,
    hours_ago: int | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    for column, value in (("alarm_id", alarm_id), ("device_name", device_name), ("ip_address", ip_address)):
        if value:
            rows = rows.filter(F.col(column) == value)
    for column, values in (("state", state), ("severity", severity), ("device_type", device_type)):
        if values:
            rows = rows.filter(F.col(column).isin([values] if isinstance(values, str) else list(values)))
    if service_affecting is not None:
        wanted = "SERVICE_AFFECTING" if service_affecting else "NON_SERVICE_AFFECTING"
        rows = rows.filter(F.col("service_affecting") == wanted)
    if hours_ago:
        if as_of is None:
            raise ValueError("hours_ago needs as_of")
        rows = rows.filter(F.col("last_raise_time") >= as_of - F.make_dt_interval(hours=F.lit(hours_ago)))
    return rows


def severity_counts(rows: DataFrame) -> DataFrame:
    """Alarms per severity, in display order."""
    place = F.lit(len(ALARM_SEVERITIES) + 1)
    for i, name in enumerate(ALARM_SEVERITIES, 1):
        place = F.when(F.col("severity") == name, i).otherwise(place)
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("alarms")).withColumn("place", place).orderBy("place")


def busiest_devices(rows: DataFrame, k: int = 3) -> DataFrame:
    counted = rows.groupBy("device_name").agg(F.count(F.lit(1)).alias("alarms"))
    return counted.orderBy(F.col("alarms").desc(), "device_name").limit(k)


def recent_alarms(rows: DataFrame, k: int = 5) -> DataFrame:
    shown = F.coalesce("qualifier", "condition")
    return (
        rows.orderBy(F.col("last_raise_time").desc(), "alarm_id")
        .limit(k)
        .select("alarm_id", "severity", shown.alias("condition"), "device_name", F.date_format("last_raise_time", "MMM dd HH:mm").alias("raised"))
    )


def services(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """One row per service with its type (``Unknown`` if absent) and name (else its label)."""
    item = F.col("_s")
    return payloads.select(F.explode(F.from_json(text, SERVICE_PAYLOAD)["items"]).alias("_s")).select(
        item["id"].alias("service_id"),
        F.coalesce(item["properties"]["serviceType"], F.lit("Unknown")).alias("service_type"),
        F.coalesce(item["properties"]["name"], item["label"], F.lit("N/A")).alias("name"),
        F.coalesce(item["orchState"], F.lit("unknown")).alias("state"),
        item["productId"].alias("product_id"),
        item["properties"]["endpoints"].alias("endpoints"),
    )


def service_endpoints(rows: DataFrame) -> DataFrame:
    return rows.select("service_id", F.inline("endpoints"))


def service_inventory(rows: DataFrame) -> DataFrame:
    return rows.groupBy("service_type").agg(F.count(F.lit(1)).alias("services"))


def first_services(rows: DataFrame, n: int = 10) -> DataFrame:
    return first_per_group(rows, ["service_type"], [F.col("service_id").cast("bigint")], n)


def product_ids(rows: DataFrame, service_type: str = "EPL") -> DataFrame:
    """Services per product of one service type."""
    wanted = rows.filter((F.col("service_type") == service_type) & F.col("product_id").isNotNull())
    return wanted.groupBy("product_id").agg(F.count(F.lit(1)).alias("services"))


def state_changes(log: DataFrame, terminal: Sequence[str] = ("active", "failed")) -> DataFrame:
    """Rows where the state of a service differs from its previous one, seconds since its first row,
    and whether the new state is terminal."""
    rows = log.withColumn("_bucket", scale.hour_bucket("ts"))
    rows = scale.spread(rows, ["service_id"], "_bucket")
    lagged = scale.split_lag(rows, ["service_id"], "_bucket", ["ts", "event_id"], {"state": "_before"})
    begin = log.groupBy("service_id").agg(F.min("ts").alias("_begin"))
    seconds = F.floor(
        (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_begin").cast("timestamp"))) / 1_000_000
    )
    return (
        scale.beside(lagged.filter(~F.col("state").eqNullSafe(F.col("_before"))), begin, ["service_id"])
        .select("service_id", "event_id", "state", seconds.alias("elapsed"), F.col("state").isin(*terminal).alias("terminal"))
    )


def provisioning_outcome(log: DataFrame, max_wait: int = 60) -> DataFrame:
    """Per service: first terminal state within ``max_wait`` seconds of its first row, else timeout."""
    begin = log.groupBy("service_id").agg(F.min("ts").alias("_begin"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_begin").cast("timestamp"))) / 1e6
    ended = F.col("state").isin("active", "failed")
    place = F.struct("ts", "event_id")
    return (
        scale.beside(log, begin, ["service_id"])
        .filter(seconds < max_wait)
        .groupBy("service_id")
        .agg(
            F.min_by("state", F.when(ended, place)).alias("_end"),
            F.max_by("state", place).alias("last_state"),
        )
        .select("service_id", "last_state", F.coalesce("_end", F.lit("timeout")).alias("outcome"))
    )
