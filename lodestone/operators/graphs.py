"""Graph operators on edge tables: ranks, components, paths and simple clustering.

Every iteration is one join and one aggregation over the edges; lineage is cut with reliable checkpoints. Convergence is
read from one aggregated number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null and src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def graph_metrics(edges: DataFrame) -> DataFrame:
    """nodes, edges, density and mean degree of an undirected graph given in both directions; zeros for no edges."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"))
    n, e = F.col("nodes"), F.col("ends") / 2
    return d.select("nodes", e.cast("long").alias("edges"), F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * e / n).otherwise(0.0).alias("mean_degree"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, personal: DataFrame | None = None) -> DataFrame:
    """(node, rank) after ``rounds`` of (personalised) PageRank; ranks sum to the number of nodes for a plain run.

    ``personal`` holds (node, weight) to restart at; without it every node restarts alike. Nodes are the edges' sources.
    """
    out = cut(degrees(edges))
    e = cut(edges.join(out.withColumnRenamed("node", "src"), "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")))
    base = out.select("node", F.lit(1.0).alias("restart")) if personal is None else out.join(personal, "node", "left").select("node", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("restart"))
    base = cut(base)
    rank = base.select("node", F.col("restart").alias("rank"))
    for i in range(rounds):
        flow = e.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        rank = base.join(flow, "node", "left").select("node", ((1 - damping) * F.col("restart") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if i % 3 == 2:
            rank = cut(rank)
    return rank


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. Labels spread to neighbours and jump along labels until stable."""
    label = cut(degrees(edges).select("node", F.col("node").alias("component")))
    while True:
        near = edges.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.least("component", "near").alias("component"))
        # pointer jumping halves the remaining distance
        step = step.join(label.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").select("node", F.least("component", "up").alias("component"))
        new = cut(step)
        changed = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        label = new
        if not changed:
            return label


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: int = 4) -> DataFrame:
    """(origin, node, distance) of the nodes within ``cutoff`` steps of each source in ``sources`` (node)."""
    seen = cut(sources.select(F.col("node").alias("origin"), "node", F.lit(0).alias("distance")))
    front = seen
    for step in range(1, cutoff + 1):
        near = front.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        front = cut(near.join(seen, ["origin", "node"], "left_anti").withColumn("distance", F.lit(step)))
        seen = cut(seen.unionByName(front))
    return seen


def triangle_clustering(edges: DataFrame) -> DataFrame:
    """(node, triangles, clustering): each triangle is found once from its lowest-degree corner, so that hubs open none."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = cut(e.where("ds < dd or (ds = dd and src < dst)").select("src", "dst"))
    wedge = up.select("src", F.col("dst").alias("a")).join(up.select("src", F.col("dst").alias("b")), "src").where("a < b")
    closed = wedge.join(up.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), ["a", "b"])
    t = closed.select(F.explode(F.array("src", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    out = d.join(t, "node", "left").fillna(0, ["triangles"])
    return out.select("node", "triangles", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))
