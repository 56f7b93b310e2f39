"""A uniform shuffle of rows into shards of exact sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.llm.common import spread_count, unit_interval


def draw_hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows, taken without putting back, are marked: the value at quantile ``u``.

    Weights follow from each other by the ratio of neighbouring probabilities, so
    no factorials are needed; they are summed over twelve deviations around the
    mean, beyond which a double holds nothing.
    """
    n, k, d = (c.cast("double") for c in (population, marked, draws))
    share = F.when(population > 0, k / n).otherwise(0.0)
    mean = d * share
    spread = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * (n - d) / F.greatest(n - 1, F.lit(1.0))))
    low = F.greatest(F.lit(0).cast("bigint"), draws - population + marked, F.floor(mean - 12 * spread - 12))
    high = F.least(draws, marked, F.ceil(mean + 12 * spread + 12))
    values = F.sequence(low, F.greatest(low, high))

    def following(w: Column, x: Column) -> Column:
        """Weight of x + 1 from that of x."""
        return w * (k - x) * (d - x) / F.greatest((x + 1) * (n - k - d + x + 1), F.lit(1.0))

    def add(state: Column, x: Column) -> Column:
        w = state["w"]
        return F.struct(following(w, x).alias("w"), (state["sum"] + w).alias("sum"))

    def pick(target: Column):
        def step(state: Column, x: Column) -> Column:
            w, total = state["w"], state["sum"]
            found = F.when(state["x"] < 0, F.when(total + w > target, x).otherwise(F.lit(-1).cast("bigint"))).otherwise(state["x"])
            return F.struct(following(w, x).alias("w"), (total + w).alias("sum"), found.alias("x"))

        return step

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    total = F.aggregate(values, start, add, lambda s: s["sum"])
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("x"))
    # the target is bound once, not summed again at every step
    found = F.transform(F.array(u * total), lambda target: F.aggregate(values, begin, pick(target), lambda s: s["x"]))[0]
    return F.when(found < 0, high).otherwise(found)


def _split_shards(sizes: Column, taken: Column, seed: Column) -> Column:
    """``taken`` of the rows that fill ``sizes``, drawn at random: how many come from each shard."""
    everything = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.struct(
        everything.alias("rows"), taken.alias("open"), F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("out")
    )

    def step(state: Column, size: Column) -> Column:
        u = unit_interval(F.xxhash64(seed, state["at"]))
        drawn = F.array(draw_hypergeometric(state["rows"], size, state["open"], u))
        # bound once, as the draw is a long expression
        return F.transform(
            drawn,
            lambda x: F.struct(
                (state["rows"] - size).alias("rows"),
                (state["open"] - x).alias("open"),
                (state["at"] + 1).alias("at"),
                F.concat(state["out"], F.array(x)).alias("out"),
            ),
        )[0]

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def communication_matrix(block_sizes: DataFrame, blocks: int, rows: int, n_shards: int, seed: int) -> DataFrame:
    """Rows per (block, shard) of a uniform shuffle: block and the array ``counts``.

    ``block_sizes``: block (0 .. blocks - 1), n.  Blocks are halved again and
    again; each half draws what it gives to every shard from what its parent
    gives, so a block needs only the draws on the way down to it.
    """
    depth = max(0, math.ceil(math.log2(blocks)))
    every = block_sizes.sparkSession.range(2**depth).select(F.col("id").alias("block"))
    filled = every.join(block_sizes, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"))
    nodes = filled.agg(F.array_sort(F.collect_list(F.struct("block", "n")))["n"].alias("sizes"))
    share, more = divmod(rows, n_shards)
    shards = F.sequence(F.lit(0), F.lit(n_shards - 1))
    nodes = nodes.select(
        F.lit(0).cast("bigint").alias("node"),
        "sizes",
        F.transform(shards, lambda s: (F.lit(share) + F.when(s < more, 1).otherwise(0)).cast("bigint")).alias("counts"),
    )
    for level in range(depth):
        half = 2 ** (depth - level - 1)
        left_sizes = F.slice("sizes", 1, half)
        taken = F.aggregate(left_sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
        drawn = nodes.withColumn("_left", _split_shards(F.col("counts"), taken, F.xxhash64(F.lit(seed), F.lit(level), "node")))
        left = F.struct(
            (F.col("node") * 2).alias("node"), left_sizes.alias("sizes"), F.col("_left").alias("counts")
        )
        right = F.struct(
            (F.col("node") * 2 + 1).alias("node"),
            F.slice("sizes", half + 1, half).alias("sizes"),
            F.zip_with("counts", "_left", lambda a, b: a - b).alias("counts"),
        )
        # the shuffle shares the draws of deeper levels among tasks
        nodes = drawn.repartition(min(2**level, spread_count(drawn.sparkSession)), "node").select(F.inline(F.array(left, right)))
    return nodes.select(F.col("node").alias("block"), "counts")


def shuffle_into_shards(
    df: DataFrame,
    n_shards: int = 40,
    seed: int = 20,
    rows_per_block: int = 50_000,
    rows_per_bucket: int = 50_000,
) -> DataFrame:
    """Every row with ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    The shuffle is uniform and shard sizes differ by at most one row.  Rows are
    dealt to blocks by a hash of all their columns, permuted inside the block,
    cut among the shards by an exactly drawn matrix, exchanged, and permuted
    again inside each shard.  All draws are hashes of the row and ``seed``, so a
    task that runs twice gives the same answer.

    Nulls are values like any other; equal rows are told apart by nothing and
    may swap places; an empty table gives no rows.  Columns ``shard`` and ``slot``
    of the input are replaced; columns starting with ``_pw_`` are not allowed.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    marks = [F.xxhash64(F.lit(seed + k), *[F.col(f"`{c}`") for c in kept]) for k in range(3)]
    rows = df.count()
    blocks = max(1, math.ceil(rows / rows_per_block))
    buckets = max(1, math.ceil(rows / n_shards / rows_per_bucket))
    dealt = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.pmod(marks[0], F.lit(blocks)).alias("_pw_block"),
        marks[1].alias("_pw_first"),
        marks[2].alias("_pw_second"),
    )
    sizes = dealt.groupBy(F.col("_pw_block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(sizes, blocks, rows, n_shards, seed)
    upto = F.transform(
        F.sequence(F.lit(1), F.lit(n_shards)),
        lambda i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )
    ends = matrix.select(F.col("block").alias("_pw_block"), upto.alias("_pw_ends"))
    first = Window.partitionBy("_pw_block").orderBy("_pw_first", "_pw_second")
    placed = dealt.withColumn("_pw_place", F.row_number().over(first)).join(ends, "_pw_block")
    shard = F.size(F.filter("_pw_ends", lambda e: e < F.col("_pw_place")))
    placed = placed.withColumns({"shard": shard, "_pw_bucket": F.floor(unit_interval(F.col("_pw_second")) * buckets)})
    placed = scale.spread(placed.drop("_pw_ends", "_pw_place", "_pw_block"), ["shard"], "_pw_bucket")
    numbered = scale.split_row_number(
        placed, ["shard"], "_pw_bucket", [F.col("_pw_second"), F.col("_pw_first")], "slot"
    )
    return numbered.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("slot") - 1).cast("bigint").alias("slot"))
