"""Row filters, paging, placeholders and label formats (groups B and F)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale


def since(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows no older than ``hours`` before ``as_of``."""
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def since_latest(df: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """Rows no older than ``hours`` before the newest row of the same key.

    The newest time per key is a partial aggregate; the join back keeps a hot
    key's rows spread.
    """
    newest = df.groupBy(key).agg(F.max(ts).alias("_newest"))
    return (
        scale.beside(df, newest, [key])
        .filter(F.col(ts) >= F.col("_newest") - F.make_dt_interval(hours=F.lit(hours)))
        .drop("_newest")
    )


PRESET_HOURS = {"1h": 1, "24h": 24, "7d": 168}


def window_preset(
    df: DataFrame,
    ts: str,
    preset: str,
    as_of: Column,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """``all``, ``1h``, ``24h``, ``7d`` or ``custom``; both ends inclusive.

    A custom window with a missing end leaves the frame as it is.
    """
    if preset == "all":
        return df
    if preset == "custom":
        if start is None or end is None:
            return df
        return df.filter(F.col(ts).between(start, end))
    if preset not in PRESET_HOURS:
        raise ValueError(f"unknown window preset: {preset}")
    first = as_of - F.make_dt_interval(hours=F.lit(PRESET_HOURS[preset]))
    return df.filter(F.col(ts).between(first, as_of))


def multi_select(df: DataFrame, choices: Mapping[str, Iterable[str]]) -> DataFrame:
    """Every column must be in its list; an empty list matches nothing."""
    for column, values in choices.items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


def contains_any(
    df: DataFrame, text: str, columns: Sequence[str], accents: bool = True
) -> DataFrame:
    """Case-insensitive search over several columns; ``%`` and ``_`` keep their LIKE meaning.

    ``accents=False`` also ignores accents through a Unicode collation; then the
    text is searched literally.
    """
    if not text:
        return df
    if accents:
        hits = [F.col(c).ilike(f"%{text}%") for c in columns]
    else:
        hits = [
            F.contains(F.collate(F.col(c), "UNICODE_CI_AI"), F.collate(F.lit(text), "UNICODE_CI_AI"))
            for c in columns
        ]
    hit = hits[0]
    for other in hits[1:]:
        hit = hit | other
    return df.filter(hit)


def between_times(df: DataFrame, ts: str, start: Column | None, end: Column | None) -> DataFrame:
    """Inclusive range, applied only if both ends are given."""
    if start is None or end is None:
        return df
    return df.filter(F.col(ts).between(start, end))


def page(df: DataFrame, order: Sequence[Column], number: int, per_page: int) -> DataFrame:
    """One page of an ordered listing (offset and limit inside the top-k operator)."""
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def page_count(df: DataFrame, per_page: int) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.ceil(F.count(F.lit(1)) / F.lit(per_page)).cast("bigint").alias("total_pages"),
    )


def newest_first(df: DataFrame, ts: str, tie: str, k: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie).desc())
    return ordered.limit(k) if k is not None else ordered


def default_if_empty(column: str | Column, default: Column | float | int) -> Column:
    """Null and zero both count as missing."""
    c = F.col(column) if isinstance(column, str) else column
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == 0), d).otherwise(c)


def placeholder(column: str | Column, text: str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(text))


def padded_code(prefix: str, number: str | Column, width: int = 3) -> Column:
    """Prefix plus zero-padded number; longer numbers are kept whole."""
    text = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def first_sentence(text: str | Column) -> Column:
    return F.substring_index(F.col(text) if isinstance(text, str) else text, ".", 1)


def day_label(ts: str | Column) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "dd-MM-yyyy")


def title_case(code: str | Column) -> Column:
    """``NON_SERVICE_AFFECTING`` becomes ``Non Service Affecting``."""
    return F.initcap(F.replace(F.col(code) if isinstance(code, str) else code, F.lit("_"), F.lit(" ")))


def display_time(iso: str | Column, pattern: str = "MMM dd, yyyy HH:mm:ss") -> Column:
    """ISO text with Z as display text; unreadable text keeps its first 19 characters."""
    c = F.col(iso) if isinstance(iso, str) else iso
    parsed = F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(
        F.coalesce(F.date_format(parsed, pattern), F.substring(c, 1, 19))
    )


def document_listing(library: DataFrame, active_only: bool = True) -> DataFrame:
    """Documents with their size in MB, newest (highest id) first."""
    rows = library.filter(F.col("status") == "active") if active_only else library
    return rows.select(
        "id", "filename", "chunk_count", "status", F.round(F.col("size_bytes") / 1048576, 2).alias("size_mb")
    ).orderBy(F.col("id").desc())


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return scale.top_k(df, keys, order, n, rank)
