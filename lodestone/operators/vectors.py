"""Similarity over embedding columns: exact top-k for a stated query set, all pairs in blocks, and an index of cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_key
from lodestone.session import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(c: Column) -> Column:
    n = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: x.cast("double") / n)


#: Query vectors multiplied with a batch at once; more are handled in further blocks of this size.
QUERY_BLOCK = 4096


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` rows of largest cosine for every query, the query itself left out.

    The queries are collected in blocks of a fixed number of vectors; each block is multiplied with Arrow batches of all
    rows, a task keeps only its k best per query, and those are ranked. Ties go to the smaller key.
    """
    qs = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where("v is not null")
    out, block = None, []

    def score(part: list) -> DataFrame:
        ids = [r["q"] for r in part]
        m = np.array([r["v"] for r in part], dtype=np.float64)
        shared = rows.sparkSession.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)))

        def best(frames):
            ids, m = shared.value
            kept = None
            for f in frames:
                if not len(f):
                    continue
                x = np.stack(f["v"].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                s = np.round(x @ m.T, 9)
                # in the order of the keys, so that of equal similarities the smaller keys are kept
                by_key = np.argsort(f["k"].to_numpy(), kind="stable")
                s, keys = s[by_key], f["k"].to_numpy()[by_key]
                least = -np.partition(-s, min(k, len(s) - 1), axis=0)[min(k, len(s) - 1)]
                above, equal = s > least, s == least
                keep = above | (equal & (np.cumsum(equal, axis=0, dtype=np.int32) <= k + 1 - above.sum(0)))
                top, cols = np.nonzero(keep)
                got = pd.DataFrame({"query": np.array(ids)[cols], "key": keys[top], "similarity": s[top, cols]})
                kept = got if kept is None else pd.concat([kept, got])
                kept = kept.sort_values(["query", "similarity", "key"], ascending=[True, False, True]).groupby("query").head(k + 1)
            if kept is not None:
                yield kept

        kt = dict(rows.dtypes)[key]
        return rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null").mapInPandas(best, f"query {kt}, key {kt}, similarity double")

    for r in qs.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part, block = score(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = score(block) if block else rows.select(F.col(key).alias("query"), F.col(key).alias("key"), F.lit(0.0).alias("similarity")).limit(0)
        out = part if out is None else out.unionByName(part)
    from lodestone.operators.ranking import ranked

    own = out.where(F.col("query") != F.col("key"))
    top = top_per_key(own, ["query"], [F.desc("similarity"), F.col("key")], k)
    return ranked(top, ["query"], [F.desc("similarity"), F.col("key")])


#: Vectors of a block, and rows of a block multiplied with another block at once.
PAIR_BLOCK, TILE = 8192, 512


def _block_pairs(rows: DataFrame, key: str, vector: str, tiles, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``tiles(left, right, similar, same)`` for each pair of blocks of vectors, as rows of ``schema``.

    ``similar(a, b)`` is the cosine matrix of rows a to b of ``left`` with all of ``right``. Blocks have a bounded number
    of vectors, each pair of blocks is one task's group, and no pair of rows is left out. Null vectors have no cosine.
    """
    src = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), *extra).where("v is not null")
    blocks = max(4, -(-src.count() // PAIR_BLOCK))
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    spread = src.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("o")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = (pdf[pdf["b"] == n].sort_values("k").reset_index(drop=True) for n in (i, j))
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        x, y = (np.stack(p["v"].to_numpy()).astype(np.float64) for p in (left, right))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
        return pd.DataFrame(tiles(left, right, lambda a, b: np.round(x[a:b] @ y.T, 9), i == j), columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return spread.groupBy("i", "j").applyInPandas(pair, schema)


def _hits(left: pd.DataFrame, right: pd.DataFrame, similar, same: bool, least: float):
    """(first row, similarities, linked) of each tile; within one block only pairs of a row and a later one."""
    lk, rk = left["k"].to_numpy(), right["k"].to_numpy()
    for a in range(0, len(left), TILE):
        s = similar(a, a + TILE)
        hit = (s >= least) & (lk[a : a + TILE, None] != rk[None, :])
        if same:
            hit &= np.arange(len(rk))[None, :] > np.arange(a, a + len(s))[:, None]
        yield a, s, hit


def similarity_links(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(key, links, class) of every vector: the number of others with a cosine of at least ``least``, and the smallest key
    reachable over such links. The pairs themselves, quadratic for groups of copies, never leave a task: it gives counts
    and the edges of a spanning forest of its two blocks."""
    from lodestone.operators.graphs import connected_components, undirected
    from lodestone.session import cut

    kt = dict(rows.dtypes)[key]

    def tiles(left, right, similar, same):
        shift = 0 if same else len(left)
        keys = left["k"].to_numpy() if same else np.concatenate([left["k"].to_numpy(), right["k"].to_numpy()])
        links, label, forest = np.zeros(len(keys), np.int64), np.arange(len(keys)), []
        for a, _, hit in _hits(left, right, similar, same, least):
            links[a : a + len(hit)] += hit.sum(1)
            links[shift:] += hit.sum(0)
            for r in range(len(hit)):
                to = np.flatnonzero(hit[r]) + shift
                new, at = np.unique(label[to], return_index=True)
                at = at[new != label[a + r]]
                if len(at):
                    forest += [(keys[a + r], keys[t], None) for t in to[at]]
                    label[np.isin(label, label[to[at]])] = label[a + r]
        return [(k, None, n) for k, n in zip(keys, links.tolist(), strict=True)] + forest

    got = cut(_block_pairs(rows, key, vector, tiles, f"key {kt}, other {kt}, links long"))
    n = got.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    c = connected_components(cut(undirected(got.where("other is not null"), "key", "other")))
    return n.join(c.withColumnRenamed("node", "key"), "key", "left").select(F.col("key").alias(key), "links", F.coalesce("component", "key").alias("class"))


def bridged_graph(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(src, dst, similarity, kind): every pair src < dst with a cosine of at least ``least`` as 'semantic', and between
    consecutive components, in the order of their smallest key, the most similar pair as 'bridge' if it is above 0.

    As in the reference, fewer than four vectors are not bridged. Of equally similar pairs the smaller keys are taken.
    """
    from lodestone.operators.graphs import connected_components, undirected
    from lodestone.operators.ranking import ranked
    from lodestone.session import cut

    kt = dict(rows.dtypes)[key]

    def semantic(left, right, similar, same):
        lk, rk, out = left["k"].to_numpy(), right["k"].to_numpy(), []
        for a, s, hit in _hits(left, right, similar, same, least):
            p, q = np.nonzero(hit)
            u, v = lk[a + p], rk[q]
            out.append(pd.DataFrame({"src": np.minimum(u, v), "dst": np.maximum(u, v), "similarity": s[p, q]}))
        return pd.concat(out)

    edges = cut(_block_pairs(rows, key, vector, semantic, f"src {kt}, dst {kt}, similarity double").distinct())
    out = edges.withColumn("kind", F.lit("semantic"))
    src = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null")
    if src.select("k").distinct().count() <= 3:
        return out
    c = connected_components(cut(undirected(edges, "src", "dst")))
    part = cut(src.join(c.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component"))
    order = ranked(part.select("c").distinct(), [], [F.col("c")], "r")

    def bridges(left, right, similar, same):
        lk, rk, lr, rr, out = left["k"].to_numpy(), right["k"].to_numpy(), left["r"].to_numpy(), right["r"].to_numpy(), []
        for a in range(0, len(left), TILE):
            s, r = similar(a, a + TILE), lr[a : a + TILE]
            p, q = np.nonzero((np.abs(r[:, None] - rr[None, :]) == 1) & (s > 0))
            up = r[p] < rr[q]
            t = pd.DataFrame({"r": np.minimum(r[p], rr[q]), "away": -s[p, q], "src": np.where(up, lk[a + p], rk[q]), "dst": np.where(up, rk[q], lk[a + p])})
            out.append(t.sort_values(["r", "away", "src", "dst"]).drop_duplicates("r"))
        return pd.concat(out)

    best = _block_pairs(part.join(order, "c"), "k", "v", bridges, f"r long, away double, src {kt}, dst {kt}", ("r",)).groupBy("r").agg(F.min(F.struct("away", "src", "dst")).alias("b"))
    return out.unionByName(best.select(F.least("b.src", "b.dst").alias("src"), F.greatest("b.src", "b.dst").alias("dst"), (-F.col("b.away")).alias("similarity"), F.lit("bridge").alias("kind")))


@dataclass(frozen=True)
class CellIndex:
    """Vectors by the cell of their nearest centre; ``rows`` holds (cell, key, vector) of every vector."""

    rows: DataFrame
    centres: np.ndarray


def cell_index(rows: DataFrame, key: str, vector: str, cells: int = 16, sample: int = 20_000) -> CellIndex:
    """Index of unit vectors in ``cells`` cells. Centres are fitted on the ``sample`` rows of least hash; every row is indexed.

    Null vectors are left out; a table without vectors gives an empty index. Written partitioned by cell, a search reads
    its cells only.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ship(rows.sparkSession)
    src = rows.select(F.col(key).alias("k"), unit(F.col(vector)).alias("v")).where("v is not null")
    fit = src.orderBy(F.xxhash64("k"), "k").limit(sample).select(array_to_vector("v").alias("features"))
    if fit.isEmpty():
        return CellIndex(src.select(F.lit(0).alias("cell"), "k", "v"), np.zeros((1, 1)))
    centres = np.stack(KMeans(k=cells, seed=5, maxIter=10).fit(fit).clusterCenters())
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # cells x dimensions

    def assign(frames):
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                c = shared.value
                f["cell"] = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]).argmin(1).astype(np.int32)
                yield f[["cell", "k", "v"]]

    kt = dict(src.dtypes)["k"]
    return CellIndex(src.mapInPandas(assign, f"cell int, k {kt}, v array<double>"), centres)


def nearest_in_cells(index: CellIndex, queries: DataFrame, key: str, vector: str, k: int, probes: int = 12) -> DataFrame:
    """(query, key, similarity, rank) of the nearest in the ``probes`` cells nearest to each query; ties go to the smaller key.

    Approximate: vectors of other cells are not met. ``nearest`` is the exact way.
    """
    from lodestone.operators.ranking import ranked

    shared = index.rows.sparkSession.sparkContext.broadcast(index.centres)
    q = queries.select(F.col(key).alias("q"), unit(F.col(vector)).alias("u")).where("u is not null")
    qt = dict(q.dtypes)["q"]

    def probe(frames):
        for f in frames:
            if len(f):
                x, c = np.stack(f["u"].to_numpy()), shared.value
                near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]).argsort(1)[:, :probes]
                yield pd.DataFrame({"q": np.repeat(f["q"].to_numpy(), near.shape[1]), "u": [u for u in f["u"] for _ in range(near.shape[1])], "cell": near.ravel().astype(np.int32)})

    asked = q.mapInPandas(probe, f"q {qt}, u array<double>, cell int")
    met = index.rows.join(asked, "cell").where(F.col("k") != F.col("q")).select(F.col("q").alias("query"), F.col("k").alias("key"), F.round(dot(F.col("u"), F.col("v")), 9).alias("similarity"))
    order = [F.desc("similarity"), F.col("key")]
    return ranked(top_per_key(met, ["query"], order, k), ["query"], order)


def davies_bouldin(rows: DataFrame, vector: str, label: str) -> float:
    """Davies-Bouldin index of labelled vectors; the labels are few, so their centres and spreads reach the driver."""
    src = rows.select(F.col(label).alias("c"), F.col(vector).alias("v"))
    e = src.select("c", F.posexplode("v").alias("i", "x"))
    means = e.groupBy("c", "i").agg(F.avg("x").alias("m")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    diff = F.zip_with(F.col("v"), F.col("m"), lambda a, b: a.cast("double") - b)
    spread = src.join(F.broadcast(means), "c").groupBy("c").agg(F.avg(F.sqrt(dot(diff, diff))).alias("s"))
    got = means.join(spread, "c").orderBy("c").collect()
    m, s = np.array([r["m"] for r in got]), np.array([r["s"] for r in got])
    if len(got) < 2:
        return 0.0
    gap = np.linalg.norm(m[:, None, :] - m[None, :, :], axis=2)
    np.fill_diagonal(gap, np.inf)
    return float(np.mean(((s[:, None] + s[None, :]) / gap).max(axis=1)))
