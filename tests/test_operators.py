import pytest
from pyspark.sql import functions as F

from lodestone.operators import facts as fo
from lodestone.operators import graphs as gr
from lodestone.operators import vectors as ve
from lodestone.operators.ranking import equal_width_bins, letter_alias, top_per_key
from lodestone.operators.search import bm25, gap_clusters


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("d1", "a", 1.0, 0.9), ("d1", "a", 3.0, 0.5), ("d2", "a", 30.0, 0.5), ("d3", "a", 2.0, None), ("d3", None, 5.0, 0.1), ("d1", "b", None, 0.2), ("d1", "b", 4.0, 0.2)]
    return spark.createDataFrame(rows, "doc string, e string, v double, c double").cache()


def test_consensus_needs_two_documents(facts):
    got = fo.consensus(facts, "e", "doc", "v").collect()
    assert [(r["e"], r["docs"], r["n"], r["median"]) for r in got] == [("a", 3, 4, 2.5)]


def test_contradictions(facts):
    got = {r["doc"]: (r["ratio"], r["severity"]) for r in fo.contradiction_pairs(facts, "e", "doc", "v").collect()}
    assert got == {"d1": (15.0, "critical"), "d2": (15.0, "critical"), "d3": (15.0, "critical")}


def test_ratio_of_exactly_two_is_no_contradiction(spark):
    df = spark.createDataFrame([("d1", "a", 1.0), ("d2", "a", 2.0), ("d3", "b", -1.0), ("d4", "b", 9.0)], "doc string, e string, v double")
    assert fo.contradiction_pairs(df, "e", "doc", "v").count() == 0


def test_single_value_has_no_spread(facts):
    got = {r["e"]: r["std"] for r in fo.grouped(facts, ["e"], "v").collect()}
    assert got["b"] == 0.0


def test_fusion(spark):
    df = spark.createDataFrame([("x", 0.0), ("y", 10.0), ("y", 10.1), ("z", 1.0), ("z", 9.0)], "k string, v double")
    assert {r["k"]: r["level"] for r in fo.fused_numeric(df, ["k"], "v").collect()} == {"x": "MODERATE", "y": "HIGH", "z": "LOW"}


def test_dedupe_keeps_first_of_equal(spark):
    df = spark.createDataFrame([("k", 0.5, 1), ("k", 0.9, 3), ("k", 0.9, 2), ("n", None, 4)], "k string, c double, i int")
    assert {(r["k"], r["i"]) for r in fo.deduplicated(df, ["k"], "c", "i").collect()} == {("k", 2), ("n", 4)}


def test_cooccurrence(spark):
    df = spark.createDataFrame([("d1", "b"), ("d1", "a"), ("d1", "a"), ("d2", "a"), ("d2", "b"), ("d2", "c"), ("d3", None)], "d string, i string")
    assert {tuple(r) for r in fo.cooccurrence(df, "i", "d").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc string, e string, v double")
    for f in (fo.consensus, fo.contradiction_pairs):
        assert f(e, "e", "doc", "v").count() == 0
    g = gr.undirected(spark.createDataFrame([], "a int, b int"), "a", "b")
    assert gr.graph_metrics(g).first().asDict() == {"nodes": 0, "edges": 0, "density": 0.0, "mean_degree": 0.0}


def test_graph(spark):
    g = gr.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9), (5, 5), (None, 1)], "a int, b int"), "a", "b").cache()
    assert {tuple(r) for r in gr.connected_components(g).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert {(r["node"], r["triangles"]) for r in gr.triangle_clustering(g).collect()} == {(1, 1), (2, 1), (3, 1), (4, 0), (8, 0), (9, 0)}
    d = gr.shortest_paths(g, spark.createDataFrame([(1,)], "node int"), 4)
    assert {(r["node"], r["distance"]) for r in d.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    ranks = {r["node"]: r["rank"] for r in gr.pagerank(g, 10).collect()}
    assert max(ranks, key=ranks.get) == 3 and abs(sum(ranks.values()) - 6) < 1e-6


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "k long, v array<double>").repartition(3)
    got = {(r["query"], r["rank"]): r["key"] for r in ve.nearest(df, df.where("k % 50 = 0"), "k", "v", 4).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 50, 100):
        order = [i for i in np.argsort(-(u @ u[q])) if i != q][:4]
        assert [got[q, r] for r in range(1, 5)] == order


def test_ranking(spark):
    df = spark.createDataFrame([("a", i % 3, i) for i in range(9)] + [(None, 1, 9)], "k string, s int, i int")
    got = top_per_key(df, ["k"], [F.desc("s"), F.col("i")], 2).collect()
    assert {(r["k"], r["i"]) for r in got} == {("a", 2), ("a", 5), (None, 9)}
    bins = equal_width_bins(spark.createDataFrame([(float(i),) for i in range(11)], "v double"), "v", 5, "b")
    assert [r["b"] for r in bins.orderBy("v").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    names = letter_alias(spark.createDataFrame([(f"n{i:02}",) for i in range(27)], "n string"), "n", "a")
    assert [r["a"] for r in names.orderBy("n").collect()][-2:] == ["[Z]", "[27]"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "pore pore grain"), (2, "grain"), (3, None), (4, "")], "k int, t string")
    assert [r["k"] for r in bm25(docs, "k", "t", ["pore"]).collect()] == [1]
    c = gap_clusters(spark.createDataFrame([("a", 1.0), ("a", 1.5), ("a", 9.0), ("a", None)], "k string, v double"), "k", "v", 1.0)
    assert sorted(r["cluster"] for r in c.collect()) == [1, 1, 2]
