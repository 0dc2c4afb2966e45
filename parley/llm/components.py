"""Connected components by alternating large-star and small-star steps.

Every step is a grouping and a join of the links; nothing is gathered in one place. The links are written to the
shared folder after each round, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import written


def _stars(neighbours: DataFrame, keep: str) -> DataFrame:
    """Links of each neighbour to the smallest one of its star; ``keep`` says which neighbours are linked anew."""
    least = written(neighbours.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")))
    joined = neighbours.join(least, "a")
    moved = joined.filter(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes in ``links`` (a, b: long). Nodes without links are not in it."""
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, "b > a")
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        links = written(_stars(down, "true"))
        now = _state(links)
        if now == state:
            break
        state = now
    tops = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops).distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``links`` (a, b) between its nodes; a label is the smallest of what it stands for.

    Only links between different labels are followed, so later calls see small graphs.
    """
    if links.isEmpty():
        return labels
    ends = [labels.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}")) for n in "ab"]
    between = links.join(ends[0], "a").join(ends[1], "b").filter("label_a <> label_b")
    tops = components(between.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    tops = written(tops.select(F.col("node").alias("label"), "component"))
    joined = labels.join(tops, "label", "left")
    return written(joined.select("node", F.coalesce("component", "label").alias("label")))
