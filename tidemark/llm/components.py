"""Connected components by alternating large and small stars.

A node may have links to a third of all nodes, so its links are spread over parts: each part
finds its least neighbour, the few parts of a node agree on the least of all, and the links
of each part are joined with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import part_of, written


def with_group(rows: DataFrame, key: str, by: str, **totals: tuple[Column, Column]) -> DataFrame:
    """``rows`` with totals over all rows of their key, of which one key may hold many.

    A total is an aggregate of rows, and one, of the column of that name, that merges those
    of the parts of a key.
    """
    cut = rows.withColumn("part", part_of(by))
    parts = cut.groupBy(key, "part").agg(*[first.alias(name) for name, (first, _) in totals.items()])
    whole = Window.partitionBy(key)
    agreed = parts.select(key, "part", *[merge.over(whole).alias(name) for name, (_, merge) in totals.items()])
    return cut.join(agreed, [key, "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = with_group(both, "a", "b", least=(F.min("b"), F.min("least")))
    return known.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("least", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known = with_group(down, "a", "b", least=(F.min("b"), F.min("least")))
    # A link to the least itself says where the node belongs; others are moved to the least.
    own = F.col("b") == F.col("least")
    return known.select(F.when(own, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """a, b: each node with links to the least node of its component, if it isn't that.

    ``edges`` has comparable columns a and b. Each round is written to the shared folder;
    the rounds end when one changes nothing, which takes the logarithm of the longest path.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), name)
    seen = None
    while True:
        now = written(_small_star(_large_star(now)), name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen = state
