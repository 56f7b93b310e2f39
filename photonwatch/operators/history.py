"""Chat history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_exchanges(turns: DataFrame, k: int = 3) -> DataFrame:
    """Turns of the last ``k`` exchanges (question and answer) per conversation."""
    recent = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2).desc())
    return turns.withColumn("_r", F.dense_rank().over(recent)).filter(F.col("_r") <= k).drop("_r")
