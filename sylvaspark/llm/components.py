"""Connected components of a graph given by its edges: alternating large-star and small-star.

Both steps link a node's neighbours to the least of them (Kiveris et al., 2014),
so the graph becomes stars in a logarithmic number of rounds.  The least neighbour
is a pre-aggregated minimum joined back to the edges; nothing is gathered per node,
and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges (a, b), a > b: link each node's neighbours to the least."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each linked node's component.  ``edges`` has two bigint columns, a and b."""
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = materialize(now, "edges")
    while True:
        after = materialize(_star(_star(now, True), False), "edges")
        # a round that changes no edge is the last; rows are distinct, so equal numbers and one-sided difference suffice
        done = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        release(now)
        now = after
        if done:
            break
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return ends.unionByName(centres)
