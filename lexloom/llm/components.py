"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.checkpoints import materialize, release
from lexloom.operators.lookup import attach


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """`(node, root)` for every node with an edge to another; nodes of a component share a root.

    Randomised contraction: in each round every node moves to the neighbour (or itself) with the smallest hash,
    edges follow, and what coincides is dropped. A round shrinks the graph by a constant factor on average, also
    on long paths. Rounds are written down; hubs are looked up by `attach`, and minima are aggregated in each task
    before the shuffle. Edges with a null end and loops are ignored; an empty graph gives no rows.
    """
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v")
    pairs = materialize(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = None
    turn = 0
    while not pairs.isEmpty():
        best = pairs.groupBy("u").agg(F.min_by("v", F.xxhash64("v", F.lit(turn))).alias("v"))
        nearer = F.xxhash64("v", F.lit(turn)) < F.xxhash64("u", F.lit(turn))
        moves = materialize(best.select(F.col("u").alias("node"), F.when(nearer, F.col("v")).otherwise(F.col("u")).alias("root")))
        moved = attach(pairs, moves.toDF("u", "to_u"), ["u"], ["u", "v"])
        moved = attach(moved, moves.toDF("v", "to_v"), ["v"], ["u", "v"])
        following = materialize(moved.where("to_u != to_v").select(F.col("to_u").alias("u"), F.col("to_v").alias("v")).distinct())
        release(pairs)
        pairs = following
        if labels is None:
            labels = moves
        else:
            joined = attach(labels, moves.toDF("root", "next"), ["root"], ["node"])
            relabelled = materialize(joined.select("node", F.coalesce("next", "root").alias("root")))
            release(labels)
            release(moves)
            labels = relabelled
        turn += 1
    if labels is None:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
