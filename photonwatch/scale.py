"""Ordered analytics over groups that may hold a third of all rows.

A plain window over ``partitionBy(key)`` sends one key to one task.  The
functions here split every key into ordered buckets (for example one per hour
of data), work inside ``(key, bucket)``, and carry only one summary row per
bucket from bucket to bucket.  Results equal the plain window exactly.

Keys and buckets must not be null; buckets must sort like the order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)
_AFTER = (1, Window.unboundedFollowing)


def hour_bucket(ts: str | Column) -> Column:
    """Hours since the epoch, from a zone-free or zoned timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(c.cast("date")) * F.lit(24) + F.hour(c)


def spread(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Shuffle once by (key, bucket).

    The functions below read their input for the summary and for the rows; both
    then share this one shuffle instead of scanning twice.
    """
    return df.repartition(*keys, bucket)


def workers(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key into the configured number of partitions.

    For groups that are small in bytes but long in computing: AQE would merge
    them into a few tasks by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def beside(df: DataFrame, summary: DataFrame, keys: Sequence[str], salts: int | None = None) -> DataFrame:
    """Each row with its key's row of ``summary``, one per key; rows of other keys are left out.

    A join on the bare keys would gather all rows of a key in one task.  Here
    rows are dealt by key and a hash of the row, and the short summary is copied
    to every such part: a quarter of the shuffle partitions unless ``salts`` says otherwise.
    """
    parts = salts or max(4, min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int"))
    copies = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.join(copies, [*keys, "_salt"]).drop("_salt")


def _bucket_window(keys: Sequence[str], bucket: str, frame: tuple[int, int]):
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(*frame)


def _with_carried(df: DataFrame, summary: DataFrame, keys: Sequence[str], bucket: str, carried: str) -> DataFrame:
    """Rows with what earlier buckets hand on, null if there is nothing.

    Most keys have one bucket, so only buckets that get something are joined: a
    summary of every key would be broadcast by way of the driver, or shuffle the rows.
    """
    return df.dropna(subset=[*keys, bucket]).join(summary.filter(F.col(carried).isNotNull()), [*keys, bucket], "left")


def split_row_number(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], out: str, total: str | None = None
) -> DataFrame:
    """``row_number`` per key, and with ``total`` also the size of the key."""
    keys = list(keys)
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(_bucket_window(keys, bucket, _BEFORE)).alias("_before")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    rows = df.withColumn("_inside", F.row_number().over(inside))
    if total:
        size = F.sum("_size").over(Window.partitionBy(*keys)).alias(total)
        rows = rows.join(sizes.select(*keys, bucket, before, size), [*keys, bucket])
    else:
        rows = _with_carried(rows, sizes.select(*keys, bucket, before), keys, bucket, "_before")
    return rows.withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_inside", "_before")


def split_running_sum(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over this and all earlier rows of the key."""
    return _split_running(df, keys, bucket, order, value, out, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def split_running_min(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Least ``value`` of this and all earlier rows of the key; nulls count for nothing."""
    return _split_running(df, keys, bucket, order, value, out, F.min, lambda a, b: F.least(a, b))


def _split_running(df, keys, bucket, order, value, out, whole, both) -> DataFrame:
    keys = list(keys)
    parts = df.groupBy(*keys, bucket).agg(whole(value).alias("_part"))
    before = parts.select(*keys, bucket, whole("_part").over(_bucket_window(keys, bucket, _BEFORE)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", whole(value).over(inside))
        .join(before, [*keys, bucket])
        .withColumn(out, both(F.col("_inside"), F.col("_before")))
        .drop("_inside", "_before")
    )


def split_lag(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], values: dict[str, str], summary: DataFrame | None = None
) -> DataFrame:
    """Previous row's columns; ``values`` maps source column to new column.

    Rows also get the columns of their key's row of ``summary``, if there is one; rows of other keys are left out.
    It travels with what buckets hand on, once to each bucket of its key: copied to a fixed number of parts
    (:func:`beside`), a row per short key would take up more than the rows.
    """
    keys = list(keys)
    sources = list(values)
    last = df.groupBy(*keys, bucket).agg(
        F.max_by(F.struct(*sources), F.struct(*order)).alias("_last")
    )
    carried = last.select(
        *keys, bucket, F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_carried")
    )
    prev = F.lag(F.struct(*sources)).over(Window.partitionBy(*keys, bucket).orderBy(*order))
    if summary is None:
        out = _with_carried(df.withColumn("_prev", prev), carried, keys, bucket, "_carried")
    else:
        # one row per key is no short table: it must not be broadcast by way of the driver
        out = df.join(carried.join(summary.hint("merge"), keys).hint("merge"), [*keys, bucket]).withColumn("_prev", prev)
    prev = F.coalesce(F.col("_prev"), F.col("_carried"))
    return out.withColumns({new: prev[old] for old, new in values.items()}).drop("_prev", "_carried")


def split_fill(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], columns: Sequence[str], suffix: str = ""
) -> DataFrame:
    """Last known value at or before each row."""
    return _split_known(df, keys, bucket, order, columns, suffix, ["before"])


def split_fill_both(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], columns: Sequence[str], newest_first: bool = False
) -> DataFrame:
    """Last known value at or before each row, else the next known one.

    This is a forward fill followed by a backward fill, in one pass;
    ``newest_first`` asks for the next value before the last one.
    """
    sides = ["after", "before"] if newest_first else ["before", "after"]
    return _split_known(df, keys, bucket, order, columns, "", sides)


def _split_known(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    columns: Sequence[str],
    suffix: str,
    sides: Sequence[str],
) -> DataFrame:
    keys = list(keys)
    position = F.struct(*order)
    names = [(side, c) for side in sides for c in columns]

    def edge_value(side: str, c: str) -> Column:
        pick = F.max_by if side == "before" else F.min_by
        return pick(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_e_{side}_{c}")

    def carried(side: str, c: str) -> Column:
        known, frame = (F.last, _BEFORE) if side == "before" else (F.first, _AFTER)
        over = _bucket_window(keys, bucket, frame)
        return known(f"_e_{side}_{c}", ignorenulls=True).over(over).alias(f"_c_{side}_{c}")

    inside = Window.partitionBy(*keys, bucket).orderBy(*order)

    def nearby(side: str, c: str) -> Column:
        if side == "before":
            return F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        return F.first(c, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))

    edges = df.groupBy(*keys, bucket).agg(*[edge_value(*n) for n in names])
    edges = edges.select(*keys, bucket, *[carried(*n) for n in names])
    filled = df.withColumns({f"_i_{side}_{c}": nearby(side, c) for side, c in names})
    known = {
        c + suffix: F.coalesce(*[x for side in sides for x in (f"_i_{side}_{c}", f"_c_{side}_{c}")]) for c in columns
    }
    kept = [c for c in df.columns if c not in known]
    return filled.join(edges, [*keys, bucket]).select(*kept, *[v.alias(n) for n, v in known.items()])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark keeps at most ``k`` per key and task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
