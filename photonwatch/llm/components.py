"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.llm.common import stored


def _roots(parents: DataFrame) -> DataFrame:
    """id and root of a stored forest (id, parent), one row per id: every round doubles the steps a row looks up."""
    found = parents
    while True:
        above = found.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        found = stored(found.join(above, "parent", "left").select("id", F.coalesce("_next", "parent").alias("parent"), F.col("_next").isNotNull().alias("moved")))
        if found.filter("moved").isEmpty():
            return found.select("id", F.col("parent").alias("root"))
        found = found.select("id", "parent")


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between roots; those within a tree go."""
    for c in "ab":
        own = names.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        edges = edges.join(own, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``edges`` (a, b: whole numbers).

    Every id that knows a smaller one hangs itself under the smallest it knows,
    which makes trees; trees are flattened to their roots, links are renamed to
    roots and those within a tree dropped, and what is left goes on the same way
    between roots.  A round works on ids once and on links once; most links go in
    the first.  Roots are smallest of their trees, so the last root of an id is
    the smallest id of its component.
    """
    links = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    names = None
    while names is None or not links.isEmpty():
        trees = _roots(stored(links.groupBy("a").agg(F.min("b").alias("parent")).withColumnRenamed("a", "id")))
        if names is None:
            alone = links.select(F.col("b").alias("id")).distinct().join(trees, "id", "left_anti")
            names = stored(trees.unionByName(alone.withColumn("root", F.col("id"))))
        else:
            above = trees.select(F.col("id").alias("root"), F.col("root").alias("_root"))
            names = stored(names.join(above, "root", "left").select("id", F.coalesce("_root", "root").alias("root")))
        links = stored(_renamed(links, trees))
    return names.select("id", F.col("root").alias("component"))
