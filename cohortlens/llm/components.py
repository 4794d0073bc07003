"""Connected components of a link table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One round on rows (a, b), a > b: every vertex passes its neighbours on to the smallest of them."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = large.join(least, large["a"] == least["u"])
    moved = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(small.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Rows (v, root) for every vertex of `links` (two columns a, b); root is the smallest vertex reachable.

    Rows with a null or with a == b give no vertex of their own.  The result is itself a table of
    links (v, root): new links can be added to it and given here again, which takes few rounds.  Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the largest component.
    """
    edges = links.toDF("a", "b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = materialise(edges, "links")
    before = _state(edges)
    for _ in range(most_rounds):
        edges = materialise(_stars(edges), "stars")
        state = _state(edges)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
