import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.embedder import embedded, hashing_embedder
from lodestone.operators import facts as fo
from lodestone.operators import graphs as gr
from lodestone.operators import small_graphs as sg
from lodestone.operators import structure as st
from lodestone.operators import vectors as ve
from lodestone.operators.search import bm25, metrics_at, search_postings, write_postings
from lodestone.sources import writers


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(30))) for _ in range(400)] + [("one", 5.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: (r["q1"], r["m"]) for r in fo.quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5}).collect()}
    for k in ("a", "b", None, "one"):
        v = [x for g, x in rows if g == k and x is not None]
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.25, 0.5])))
    assert fo.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_contradicting_documents_are_counted(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), f"d{rng.randrange(25)}", rng.choice([1.0, 2.0, 4.0, 5.0, 11.0, 64.0])) for _ in range(90)] + [("x", None, 3.0), ("z", "d1", 1.0), ("z", "d2", 2.0)]
    df = spark.createDataFrame(rows, "e string, d string, v double").repartition(4)
    means = {}
    for e, d, v in rows:
        means.setdefault((e, d), []).append(v)
    means = {k: sum(v) / len(v) for k, v in means.items()}
    want = {}
    for (e, d), m in means.items():
        n = [max(m / o, o / m) for (e2, d2), o in means.items() if e2 == e and d2 != d and (o < m / 2 or o > m * 2)]
        if n:
            want[e, d] = (len(n), max(n))
    got = {(r["e"], r["d"]): (r["contradicting"], r["ratio"]) for r in fo.contradiction_pairs(df, "e", "d", "v").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ("z", "d1") not in got


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_batches_are_those_of_one_pass(spark, block):
    rng = random.Random(block)
    items = {k: [rng.choice([0, 1, 5, 20, 60, 99, 100, 101, 250]) for _ in range(n)] for k, n in (("a", 60), ("b", 1), (None, 13))}
    rows = [(k, i, s) for k, sizes in items.items() for i, s in enumerate(sizes)]
    want = set()
    for k, sizes in items.items():
        batch = n = chars = 0
        for s in sizes:
            if n and chars + s > 100:
                want.add((k, batch, n, chars))
                batch, n, chars = batch + 1, 0, 0
            n, chars = n + 1, chars + s
        want.add((k, batch, n, chars))
    df = spark.createDataFrame(rows, "k string, o int, s int").repartition(3)
    got = st.greedy_batches(df, "k", "o", F.col("s"), 100, block)
    assert {tuple(r) for r in got.select("k", "batch", "items", "chars").collect()} == want
    assert st.greedy_batches(df.limit(0), "k", "o", F.col("s"), 100, block).count() == 0


def test_long_paths_are_one_component(spark):
    e = gr.undirected(spark.createDataFrame([(i, i + 1) for i in range(80)], "a int, b int"), "a", "b")
    assert {r["component"] for r in gr.connected_components(e).collect()} == {0}


def test_spans(spark):
    assert st.deduplicated_spans([(0, 4, "a", 0.5), (0, 2, "b", 0.4), (3, 9, "c", 0.9), (5, 6, "d", 0.1), (9, 10, "e", 0.2)]) == [(3, 9, "c", 0.9), (5, 6, "d", 0.1), (9, 10, "e", 0.2)]
    df = spark.createDataFrame([(1, "at 5.5 MPa, 3 and 4"), (2, "")], "k int, t string")
    assert {(r["start"], r["stop"], r["kind"]) for r in st.entity_spans(df, "k", "t").collect()} == {(3, 10, "measurement"), (12, 19, "range")}


def test_small_graph_measures():
    path = sg.adjacency([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)])
    assert sg.betweenness(path) == pytest.approx({1: 0.0, 2: 2 / 3, 3: 2 / 3, 4: 0.0})
    two = sg.adjacency([(a, b, 1.0) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for a in g for b in g if a < b] + [(4, 5, 1.0)])
    label = sg.greedy_communities(two)
    assert len(set(label.values())) == 2 and label[1] == label[4] != label[5]
    assert sg.modularity(two, label) == pytest.approx(2 * (12 / 26 - (13 / 26) ** 2))
    assert sg.edge_connectivity(two) == 1 and sg.edge_connectivity(sg.adjacency([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)])) == 2
    assert sg.edge_connectivity(sg.adjacency([(1, 2, 1.0), (3, 4, 1.0)])) == 0
    assert sg.clustering(sg.adjacency([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0)])) == pytest.approx(((1 + 1 + 1 / 3) / 4, 3 / 5))
    assert sg.clustering({}) == (0.0, 0.0)


def test_whole_graph_measures_run_in_spark(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, weight double")
    assert {r["node"]: r["betweenness"] for r in sg.betweenness_of(e).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert {r["metric"]: r["value"] for r in sg.validity_of(e).collect()}["nodes"] == 3.0
    assert sg.validity_of(e.limit(0)).count() == 0


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, y double")
    c, t = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(c.T @ c + np.eye(2), c.T @ t)
    got = sg.ridge(df, ["a", "b"], "y")
    assert [got["a"], got["b"], got["intercept"]] == pytest.approx([*w, y.mean() - x.mean(0) @ w])
    assert sg.ridge(df.limit(0), ["a"], "y") is None


def test_stored_postings_give_the_scores_of_a_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("pore grain melt pool laser beam".split()) for _ in range(rng.randrange(1, 30)))) for i in range(60)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "k int, t string")
    write_postings(docs, "k", "t", str(tmp_path))
    got = {r["k"]: r["score"] for r in search_postings(spark, str(tmp_path), "k", ["pore", "beam", "nowhere"]).collect()}
    assert got == pytest.approx({r["k"]: r["score"] for r in bm25(docs, "k", "t", ["pore", "beam"]).collect()})
    plan = search_postings(spark, str(tmp_path), "k", ["pore"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan


def test_metrics_at(spark):
    runs = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 1), ("q", 4, 0), ("r", 1, 0)], "query string, rank int, relevant int")
    judged = spark.createDataFrame([("q", 4), ("r", 0)], "query string, judged int")
    got = {(r["query"], r["k"]): r for r in metrics_at(runs, judged, [3, 5]).collect()}
    q = got["q", 3]
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert (q["recall"], q["rr"]) == (0.5, 0.5) and q["precision"] == pytest.approx(2 / 3) and q["ndcg"] == pytest.approx((1 / math.log2(3) + 0.5) / ideal)
    assert got["r", 5]["recall"] == 0.0 and not got["r", 5]["covered"]


def test_index_finds_most_of_the_nearest(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    m = np.concatenate([c + rng.normal(size=(60, 16)) for c in centres])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(9999, None)], "k long, v array<double>").repartition(3)
    q = df.where("k % 50 = 0")
    exact = {(r["query"], r["key"]) for r in ve.nearest(df, q, "k", "v", 10).collect()}
    index = ve.cell_index(df, "k", "v", cells=12, sample=300)
    assert index.rows.count() == len(m)
    found = {(r["query"], r["key"]) for r in ve.nearest_in_cells(index, q, "k", "v", 10, probes=4).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert ve.cell_index(df.limit(0), "k", "v").rows.count() == 0


def test_davies_bouldin(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, 2.0], 1), ([10.0, 0.0], 2), ([10.0, 2.0], 2)], "v array<double>, c int")
    assert ve.davies_bouldin(df, "v", "c") == pytest.approx(0.2)


def test_any_embedder_can_be_plugged_in(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "k int, t string")
    got = {r["k"]: r["vector"] for r in embedded(df, "t", lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    v = hashing_embedder(32)(["grain of steel", "steel grain of", "laser"])
    assert v[0].tolist() == v[1].tolist() != v[2].tolist()


def test_sinks_replace_and_ignore(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, 10), ("x", 1, 11), ("y", 2, 12)], "s string, i int, n int")
    writers.upsert(a, str(tmp_path / "u"), ["s", "i"], "n")
    writers.upsert(spark.createDataFrame([("x", 1, 20), ("z", 1, 21)], a.schema), str(tmp_path / "u"), ["s", "i"], "n")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).select("s", "i", "n").collect()} == {("x", 1, 20), ("y", 2, 12), ("z", 1, 21)}
    b = spark.createDataFrame([(3, "c"), (1, "c"), (2, None)], "id int, c string")
    writers.insert_or_ignore(b, str(tmp_path / "i"), "c", order="id")
    writers.insert_or_ignore(spark.createDataFrame([(9, "c"), (8, "d")], b.schema), str(tmp_path / "i"), "c", order="id")
    assert {(r["id"], r["c"]) for r in spark.read.parquet(str(tmp_path / "i")).collect()} == {(1, "c"), (8, "d")}


def test_matches_have_their_places(spark):
    texts = ["a1b22", "", None, "7", "x 3 x 33 x", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: [tuple(m) for m in r["m"]] if r["m"] is not None else None for r in df.select("k", tx.matches(F.col("t"), "([0-9])[0-9]?", 1).alias("m")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (None if t is None else [(m.start() + 1, m.group(), m.group(1)) for m in re.finditer("([0-9])[0-9]?", t)])


def test_words_are_counted_as_often_as_they_occur(spark):
    df = spark.createDataFrame([("Grain grains GRAIN",), (None,), ("",)], "t string")
    assert [r["n"] for r in df.select(tx.word_hits(F.col("t"), ["grain", "rain"]).alias("n")).collect()] == [6, 0, 0]


def test_pattern_bank(spark, tmp_path):
    from lodestone.plans import catalogue

    text = "Laser power = 200 W and scan speed: 800 mm/s; yield strength = 1.1 GPa. PREN = 41. porosity = 0.5 %"
    spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["quantity"], r["value"]) for r in catalogue.queries()["x7_quantity_regex_bank"](spark, str(tmp_path)).collect())
    assert {("scan_speed", 800.0), ("yield_strength", 1.1), ("PREN", 41.0), ("porosity", 0.5), ("laser_power", 200.0)} <= set(got)


def test_units_with_no_stated_one_and_the_same_model_for_any_partitions(spark):
    from lodestone.operators.units import fit_unit_model, infer_units, prepare, with_context_unit

    rng = random.Random(5)
    rows = []
    for i in range(600):
        kilo = rng.random() < 0.5
        watts = 10 ** rng.uniform(2.0, 3.0)
        rows.append(("t", i, round(watts / 1000, 4) if kilo else round(watts, 1), None if i % 4 == 0 else "kW" if kilo else "W", "laser_power", None, "s"))
    df = spark.createDataFrame(rows, "table_name string, row_id long, value double, unit string, physical_quantity string, context string, source string")
    units = spark.createDataFrame([("laser_power", "W", "beam power")], "physical_quantity string, base_unit string, other_names string")
    got = []
    for n in (1, 5):
        p = prepare(df.repartition(n), units)
        got.append({r["row_id"]: (r["factor"], r["decision"]) for r in infer_units(with_context_unit(p.where("missing")), fit_unit_model(p)).collect()})
    assert got[0] == got[1] and "convert" in {d for _, d in got[0].values()}


def test_recursive_chunks():
    from lodestone.operators.chunking import recursive_chunks

    rng = random.Random(7)
    for _ in range(60):
        t = "".join(rng.choice(["word ", "a. ", "b; ", "c, ", "\n", "\n\n", "xyz"]) for _ in range(rng.randrange(400)))
        chunks = recursive_chunks(t, 60, 15)
        longest = max((len(x) for x in re.split(r"\n|(?<=[.;,] )", t)), default=0)
        assert all(c and len(c) <= max(60, longest) for c in chunks)
        assert set(re.findall("[a-z]+", t)) <= set(re.findall("[a-z]+", " ".join(chunks)))
    assert recursive_chunks("one. two. three.", 10, 5) == ["one. two.", "two.", "three."] or recursive_chunks("one. two. three.", 10, 5) == ["one. two.", "three."]
    assert recursive_chunks("", 10, 2) == [] and recursive_chunks("x" * 30, 10, 2) == ["x" * 30]


def test_values_are_converted_though_no_unit_is_stated(spark, tmp_path):
    from lodestone.plans import catalogue

    spark.createDataFrame([("laser_power", "W", "beam power")], "physical_quantity string, base_unit string, other_names string").write.parquet(str(tmp_path / "quantity_units.parquet"))
    fields = "value double, unit string, physical_quantity string, context string, {} string"
    spark.createDataFrame([(1, 3.0, None, "beam power", "it was 3 kW there", "m"), (2, 4.0, "", "beam power", "it was 4", "m")], "item_id long, " + fields.format("method")).write.parquet(str(tmp_path / "facts.parquet"))
    spark.createDataFrame([], "value_id long, " + fields.format("method_origin")).write.parquet(str(tmp_path / "extracted_values.parquet"))
    q = catalogue.queries()
    assert [tuple(r) for r in q["p4_found"](spark, str(tmp_path)).collect()] == [("facts", 1, "laser_power", "3.000e+03")]
    assert {(r["row_id"], r["decision"]) for r in q["p4_review"](spark, str(tmp_path)).collect()} == {(1, "convert"), (2, "review")}
    assert q["p4_hidden_units"](spark, str(tmp_path)).count() == 0
