"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize

ROUNDS = 60  # the rounds needed grow with the logarithm of the longest path


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the least ``b`` of their ``a``, and that table. It is stored: Spark sees
    whether it is small enough to broadcast, and otherwise a hot node is split."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    return lookup_join(edges, least, ["a"], least.count()), least


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, _ = _with_least(both)
    larger = joined.where(F.col("b") > F.col("a"))
    return larger.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node (``a``, larger than its ``b``s) and all its ``b``s with the least of them."""
    joined, least = _with_least(edges)
    others = joined.where(F.col("b") != F.col("least"))
    moved = others.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the least node it is connected with.

    Alternating large-star and small-star rounds: each is one aggregate with partial aggregation
    and one join on the node, the result of a round is a written table, and no list of links ever
    leaves the executors. Self-links and nulls are ignored; an empty table gives an empty result.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    linked = edges.where((F.col("a") != F.col("b")))
    state = materialize(linked.select(a.alias("a"), b.alias("b")).distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(state.agg(F.count(F.lit(1)), mark).first())
        if now == before or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                state.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        before = now
        large = materialize(_large_star(state), "stars")
        state = materialize(_small_star(large), "links")
    raise RuntimeError(f"components are not found after {ROUNDS} rounds")
