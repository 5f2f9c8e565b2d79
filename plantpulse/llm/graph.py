"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import write_shared

MAX_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``u``, ``v``).

    ``component`` is the smallest node reachable.  Large-star and small-star
    steps alternate (Kiveris et al., 2014): the first links every larger
    neighbour of a node to the smallest one, the second every smaller
    neighbour, until each component is a star around its smallest node.  The
    edge count never grows, each step is an aggregation with map-side
    combine and a join whose hot keys adaptive execution may split, and each round is
    written to the shared folder.  Null ends are ignored; a self-loop gives a
    node of its own.  Nodes are of any ordered type.
    """
    edges = write_shared(edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull()).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        # every neighbour larger than u goes to the smallest neighbour of u (u included)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return pairs.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))

    star = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(MAX_ROUNDS):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = linked(both).distinct()
        # every u has edges to smaller nodes only; link those and u itself to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        star = write_shared(small, "star")
        # settled: every node has one smaller neighbour, which has none itself
        n, nodes_up = star.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes_up and not star.join(star.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left") \
        .select("node", F.coalesce("component", "node").alias("component"))
