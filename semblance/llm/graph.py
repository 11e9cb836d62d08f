"""Connected components by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.session import materialised


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Tie every node's larger (or smaller) neighbours to the smallest one of its neighbourhood."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    around = edges.select(F.explode(both).alias("e")).select("e.a", "e.b")
    around = (around.where("a > b") if small else around).distinct()
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = around.join(least, "a")
    if small:
        # The node itself hangs on the smallest one too.
        own = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        out = tied.select(F.explode(own).alias("e")).select("e.a", "e.b")
    else:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (a, b) with a != b; the label is the smallest node reachable.

    Each round is checkpointed and ends when no edge changes; the number of rounds is logarithmic in the longest path.
    Then every node but the smallest of a component has one edge, to that one.
    """
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    last = None
    while True:
        mark = edges.agg(state.alias("s")).first().s
        if mark == last or mark[0] == 0:
            break
        last = mark
        edges = materialised(_star(_star(edges, small=False), small=True))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("label")), F.struct(F.col("b").alias("node"), F.col("b").alias("label")))
    return edges.select(F.explode(ends).alias("e")).select("e.node", "e.label").distinct()
