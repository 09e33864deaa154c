"""Connected components of an undirected edge list, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.llm._common import delete, settle


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, comp)``: ``comp`` is the smallest node reachable from ``node``.

    Nodes without an edge don't occur. Each round hooks every root onto the smallest root next
    to its tree and then halves the paths, so the number of rounds grows with the logarithm of a
    component's diameter. Labels and edges stay distributed; the driver sees one count a round.
    An empty edge list gives an empty result. Loops (a = b) and repeated edges are harmless.
    """
    both = edges.select("a", "b").filter("a <> b").distinct()
    live = settle(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = settle(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
                   .unionByName(live.select(F.col("b").alias("node"), F.col("b").alias("comp")))
                   .groupBy("node").agg(F.min("comp").alias("comp")))
    while True:
        # pointer jumping until the forest is flat
        while True:
            up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            jumped = settle(label.join(up, "comp").select("node", F.col("up").alias("comp"), (F.col("up") != F.col("comp")).alias("moved")))
            moved = jumped.filter("moved").limit(1).count()
            delete(label)
            label = jumped.select("node", "comp")
            if not moved:
                break
        # edges between roots of different trees; loops go, so the edge list shrinks
        of = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"r{c}"))
        before, live = live, settle(live.join(of("a"), "a").join(of("b"), "b").filter("ra <> rb")
                      .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        delete(before)
        hooks = live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hook"))
        if live.limit(1).count() == 0:
            delete(live)
            return label
        hooked = settle(label.join(hooks, "node", "left").select("node", F.coalesce("hook", "comp").alias("comp")))
        delete(label)
        label = hooked
