import numpy as np
import pytest

from lodestone.operators import vectors as ve


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 8))
    v[10:30] = v[9]  # copies
    v[50] = -v[9]
    return v


def _brute(v, least):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    near = (s >= least) & ~np.eye(len(v), dtype=bool)
    cls = list(range(len(v)))
    for _ in v:
        cls = [min([cls[i], *(cls[j] for j in np.flatnonzero(near[i]))]) for i in range(len(v))]
    return s, near, cls


@pytest.mark.parametrize("least", [0.6, 0.9])
def test_links_of_all_vectors(spark, vectors, least, monkeypatch):
    monkeypatch.setattr(ve, "TILE", 7)
    _, near, cls = _brute(vectors, least)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)] + [(99, None)], "id int, v array<double>")
    got = {r["id"]: (r["links"], r["class"]) for r in ve.similarity_links(df, "id", "v", least).collect()}
    assert got == {i: (int(near[i].sum()), cls[i]) for i in range(len(vectors))}


def test_graph_has_all_edges_and_bridges(spark, vectors, monkeypatch):
    monkeypatch.setattr(ve, "TILE", 7)
    s, near, cls = _brute(vectors, 0.9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "id int, v array<double>")
    got = ve.bridged_graph(df, "id", "v", 0.9).collect()
    assert {(r["src"], r["dst"]) for r in got if r["kind"] == "semantic"} == {(i, j) for i, j in np.argwhere(near).tolist() if i < j}
    order, want = sorted(set(cls)), set()
    for a, b in zip(order, order[1:], strict=False):
        best = min((-s[i, j], i, j) for i in range(60) if cls[i] == a for j in range(60) if cls[j] == b)
        if best[0] < 0:
            want.add((min(best[1:]), max(best[1:])))
    assert {(r["src"], r["dst"]) for r in got if r["kind"] == "bridge"} == want and want


def test_paths_from_every_paper(spark, tmp_path):
    from lodestone.plans import catalogue

    spark.createDataFrame([(1, p) for p in range(101, 107)], "group_id long, paper_id long").write.parquet(str(tmp_path / "duplicate_groups.parquet"))
    got = {tuple(r) for r in catalogue.queries()["m3_all_shortest_paths"](spark, str(tmp_path)).select("origin", "node", "distance").collect()}
    assert got == {(a, b, abs(a - b)) for a in range(101, 107) for b in range(101, 107) if abs(a - b) <= 4}


def test_all_mentions_of_a_sentence_are_related(spark):
    from lodestone.operators.structure import sentence_relations

    text = "Annealing of Alloy\n7 at 1.5 MPa raised the strength. The hardness of A7 and its hardness grew. Strength" + " x" * 50 + " A7 and 9 W."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = [tuple(r)[1:5] for r in sentence_relations(df, "id", "t", {"Alloy 7": "Alloy 7", "A7": "Alloy 7"}).collect()]
    assert sorted(got) == sorted([(0, "Alloy 7", "has_property", "strength"), (0, "annealing", "affects", "Alloy 7"), (0, "strength", "measured_as", "1.5MPa"), (1, "Alloy 7", "has_property", "hardness"), (1, "Alloy 7", "has_property", "hardness")])


def test_one_window_per_occurrence(spark, tmp_path):
    from lodestone.plans import catalogue

    texts = ["30 MPa at 3.5 MPa", "none", None, "x" * 280 + " 5 W 6 × 10^3 kHz" + "y" * 290]
    spark.createDataFrame(list(enumerate(texts)), "page_id int, text string").write.parquet(str(tmp_path / "pages_text.parquet"))
    q = catalogue.queries()
    got = {(r["page_id"], r["at"]): r["ctx"] for r in q["x18_context_window"](spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 1), (0, 11), (3, 282), (3, 286)}
    assert got[3, 286] == texts[3][85:485]
    raw = {(r["page_id"], r["at"]): (r["raw"], r["v"], r["u"]) for r in q["x10_number_unit_candidates"](spark, str(tmp_path)).collect()}
    assert raw[3, 286] == ("6 × 10^3 kHz", "6 × 10^3", "kHz") and raw[0, 11] == ("3.5 MPa", "3.5", "MPa")


def test_ties_go_to_the_smaller_key_in_any_batch(spark):
    v = [1.0, 2.0, 3.0]
    ids = np.random.default_rng(1).permutation(400).tolist()
    df = spark.createDataFrame([(i, v) for i in ids], "id int, v array<double>").repartition(1)
    got = ve.nearest(df, df.where("id in (0, 200)"), "id", "v", 5).collect()
    assert {(r["query"], r["key"], r["rank"]) for r in got} == {(0, n, n) for n in range(1, 6)} | {(200, n, n + 1) for n in range(5)}


def test_limits_are_those_of_the_reference(spark, tmp_path):
    import hashlib

    from lodestone.plans import catalogue

    q = catalogue.queries()
    body = "w" * 1500
    pages = [(1, 1, f"Title\nAbstract: {body}\nIntroduction x\n\n"), (2, 7, "z" * 20_001), (3, 2, "a\nABSTRACT " + body + "\n 1. x"), (4, 1, None)]
    spark.createDataFrame(pages, "page_id int, page_num int, text string").write.parquet(str(tmp_path / "pages_text.parquet"))
    texts = ["µ" * 1000 + "a", "µ" * 1000 + "b", "µ" * 600_000]
    texts += ["q" * 1024 + "a", "q" * 1024 + "b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["page_id"]: r["abstract"] for r in q["x5_abstract_extraction"](spark, str(tmp_path)).collect()} == {1: body, 2: "z" * 500, 3: body, 4: None}
    assert {r["page_id"]: r["text"] for r in q["s2_pages_truncated"](spark, str(tmp_path)).collect()} == {n: t if n != 2 else "z" * 20_000 + " [cut]" for n, _, t in pages}
    assert {r["doc_id"]: r["short"] for r in q["x1_hashes"](spark, str(tmp_path)).collect()} == {n: hashlib.sha256(t.encode()[: 1 << 20]).hexdigest()[:16] for n, t in enumerate(texts)}
