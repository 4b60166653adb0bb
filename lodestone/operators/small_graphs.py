"""Measures that need a whole graph at once, for graphs of a bounded number of nodes, run in one task.

Larger graphs are first reduced to the nodes of largest degree by ``largest_nodes``, or measured by ``graphs``.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

#: Nodes of a graph that a task takes whole.
MOST_NODES = 200


def adjacency(pairs: list[tuple]) -> dict:
    out: dict = {}
    for a, b, w in pairs:
        if a != b:
            out.setdefault(a, {})[b] = w
            out.setdefault(b, {})[a] = w
    return out


def betweenness(adj: dict) -> dict:
    """Share of the shortest paths between other nodes that lead over each node (unweighted, normalised)."""
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        order, before, paths, far = [], {v: [] for v in adj}, dict.fromkeys(adj, 0), {s: 0}
        paths[s] = 1
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(adj, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    n = len(adj)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


def modularity(adj: dict, label: dict) -> float:
    total = sum(sum(x.values()) for x in adj.values())
    if not total:
        return 0.0
    inside, ends = {}, {}
    for v, near in adj.items():
        for w, x in near.items():
            ends[label[v]] = ends.get(label[v], 0.0) + x
            if label[v] == label[w]:
                inside[label[v]] = inside.get(label[v], 0.0) + x
    return sum(inside.get(c, 0.0) / total - (e / total) ** 2 for c, e in ends.items())


def greedy_communities(adj: dict) -> dict:
    """Communities by joining, as long as modularity rises, the two whose union raises it most; named by their least node."""
    total = sum(sum(x.values()) for x in adj.values())
    groups = {v: {v} for v in adj}
    between = {v: dict(near) for v, near in adj.items()}
    degree = {v: sum(near.values()) for v, near in adj.items()}
    while total:
        gain, pair = max(((2 * (w / total - degree[a] * degree[b] / total**2), (a, b)) for a in sorted(groups) for b, w in sorted(between[a].items()) if a < b), default=(0.0, None), key=lambda x: x[0])
        if pair is None or gain <= 1e-12:
            break
        a, b = pair
        groups[a] |= groups.pop(b)
        degree[a] += degree.pop(b)
        for c, w in between.pop(b).items():
            between[c].pop(b)
            if c != a:
                between[a][c] = between[a].get(c, 0.0) + w
                between[c][a] = between[a][c]
        between[a].pop(b, None)
    return {v: min(g) for g in groups.values() for v in g}


def edge_connectivity(adj: dict) -> int:
    """Least number of edges whose removal parts the graph: the least cut of each phase of merging nodes by adjacency."""
    if len(adj) < 2:
        return 0
    near = {v: dict.fromkeys(x, 1) for v, x in adj.items()}
    best = None
    while len(near) > 1:
        start = min(near)
        weight, seen = {v: near[start].get(v, 0) for v in near if v != start}, [start]
        while weight:
            v = max(sorted(weight), key=weight.get)
            last = weight.pop(v)
            seen.append(v)
            for w, x in near[v].items():
                if w in weight:
                    weight[w] += x
        best = last if best is None else min(best, last)
        s, t = seen[-2], seen[-1]
        for w, x in near.pop(t).items():
            near[w].pop(t, None)
            if w != s:
                near[s][w] = near[s].get(w, 0) + x
                near[w][s] = near[s][w]
    return int(best)


def clustering(adj: dict) -> tuple[float, float]:
    """(average clustering, transitivity)."""
    closed, open_, mean = 0, 0, 0.0
    for v, near in adj.items():
        k = len(near)
        links = sum(1 for a in near for b in near if a < b and b in adj[a])
        closed, open_ = closed + links, open_ + k * (k - 1) // 2
        mean += 2 * links / (k * (k - 1)) if k > 1 else 0.0
    return (mean / len(adj) if adj else 0.0), (closed / open_ if open_ else 0.0)


def largest_nodes(edges: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """Edges (a, b, weight) among the ``most`` nodes of largest degree; ties go to the smaller node."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    top = F.broadcast(ends.orderBy(F.desc("n"), "node").limit(most).select("node"))
    return edges.join(top.withColumnRenamed("node", "a"), "a", "left_semi").join(top.withColumnRenamed("node", "b"), "b", "left_semi")


def _whole(edges: DataFrame, f, schema: str) -> DataFrame:
    ship(edges.sparkSession)
    e = largest_nodes(edges.select("a", "b", F.col("weight").cast("double").alias("weight")))
    return e.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: f(adjacency(list(pdf[["a", "b", "weight"]].itertuples(index=False, name=None)))), schema)


def betweenness_of(edges: DataFrame) -> DataFrame:
    """(node, betweenness) of edges (a, b, weight); no edges give no rows."""
    return _whole(edges, lambda adj: pd.DataFrame(sorted(betweenness(adj).items()), columns=["node", "betweenness"]), "node string, betweenness double")


def communities_of(edges: DataFrame) -> DataFrame:
    """(node, community) by greedy modularity."""
    return _whole(edges, lambda adj: pd.DataFrame(sorted(greedy_communities(adj).items()), columns=["node", "community"]), "node string, community string")


def validity_of(edges: DataFrame) -> DataFrame:
    """(metric, value): nodes, modularity, communities, edge_connectivity, average_clustering, transitivity; fewer than two
    nodes give no rows."""

    def measure(adj: dict) -> pd.DataFrame:
        label = greedy_communities(adj)
        average, transitivity = clustering(adj)
        rows = [("nodes", len(adj)), ("modularity", modularity(adj, label)), ("communities", len(set(label.values()))), ("edge_connectivity", edge_connectivity(adj)), ("average_clustering", average), ("transitivity", transitivity)]
        return pd.DataFrame([(n, float(v)) for n, v in rows] if len(adj) > 1 else [], columns=["metric", "value"])

    return _whole(edges, measure, "metric string, value double")


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> dict[str, float] | None:
    """Coefficients and intercept of ridge regression by the normal equations, whose sums one aggregation gives; None for
    no rows."""
    import numpy as np

    names = [*features, target]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *products).first()
    if not r["n"]:
        return None
    n, k = r["n"], len(names)
    s = np.array([r[f"s{i}"] for i in range(k)])
    p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - np.outer(s, s) / n
    w = np.linalg.solve(p[:-1, :-1] + alpha * np.eye(k - 1), p[:-1, -1])
    return {**dict(zip(features, w.tolist(), strict=True)), "intercept": float((s[-1] - s[:-1] @ w) / n)}
