"""Graphs, models and sinks as queries (sections 2.2 and 2.10 of the inventory)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import graphs as gr
from lodestone.operators import small_graphs as sg
from lodestone.operators import vectors as ve
from lodestone.operators.facts import cooccurrence, fused_numeric, quantiles
from lodestone.plans.aggregates import _A, _E, facts, properties, values
from lodestone.plans.registry import Catalogue, sig, sig_sql
from lodestone.session import cut, shared_dir, table
from lodestone.sources import writers

C = Catalogue()
add = C.add

_COOC = "select x.physical_quantity as a, y.physical_quantity as b, count(distinct x.doc_name) as w from extracted_values x join extracted_values y on x.doc_name = y.doc_name and x.physical_quantity < y.physical_quantity group by 1, 2"


def _edges(spark, d):
    e = cooccurrence(table(spark, d, "extracted_values", "physical_quantity", "doc_name"), "physical_quantity", "doc_name")
    return cut(e.select("a", "b", F.col("docs").alias("weight")))


@add("m1_hybrid_graph", f"with c as ({_COOC}), n as (select physical_quantity as q, material, count(distinct value_id) as n from extracted_values where material is not null group by 1, 2), l as (select q, sqrt(sum(n * n)) as len from n group by 1), s as (select x.q as a, y.q as b, sum(x.n * y.n) / (any_value(lx.len) * any_value(ly.len)) as sem from n x join n y on x.material = y.material and x.q < y.q join l lx on x.q = lx.q join l ly on y.q = ly.q group by 1, 2), deg as (select v, count(*) as d from (select a as v from c union all select b from c) group by 1) select coalesce(c.a, s.a) as a, coalesce(c.b, s.b) as b, round(0.6 * coalesce(c.w, 0) + 0.4 * coalesce(s.sem, 0), 6) as weight, case when c.w is not null then 'cooccurrence' else 'semantic' end as kind from c full join s on c.a = s.a and c.b = s.b left join deg da on coalesce(c.a, s.a) = da.v left join deg db on coalesce(c.b, s.b) = db.v where c.w is not null or (s.sem > 0.75 and (coalesce(da.d, 0) < 2 or coalesce(db.d, 0) < 2))")
def m1(spark, d):
    """Co-occurrence edges, and semantic ones where there is none, the similarity exceeds 0.75 and an end has fewer than two
    co-occurrences; quantities are alike by the materials they are reported for. Degrees are those of the co-occurrences,
    not of a graph in the making, so the result doesn't depend on an order."""
    c = _edges(spark, d)
    n = values(spark, d, "value_id", "q", "material").where("material is not null").groupBy("q", "material").agg(F.count(F.lit(1)).alias("n"))
    # the quantities are a closed list, so a material's row holds few
    rows = n.groupBy("material").agg(F.array_sort(F.collect_list(F.struct("q", "n"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda q: F.struct(p["q"].alias("a"), q["q"].alias("b"), (p["n"] * q["n"]).alias("dot")))))
    dots = rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.dot").alias("dot"))
    length = n.groupBy("q").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    s = dots.join(length.select(F.col("q").alias("a"), F.col("len").alias("la")), "a").join(length.select(F.col("q").alias("b"), F.col("len").alias("lb")), "b").select("a", "b", (F.col("dot") / (F.col("la") * F.col("lb"))).alias("sem"))
    deg = c.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    j = c.join(s, ["a", "b"], "full").join(deg.select(F.col("v").alias("a"), F.col("d").alias("da")), "a", "left").join(deg.select(F.col("v").alias("b"), F.col("d").alias("db")), "b", "left").fillna(0, ["da", "db"])
    j = j.where("weight is not null or (sem > 0.75 and (da < 2 or db < 2))")
    return j.select("a", "b", F.round(0.6 * F.coalesce("weight", F.lit(0)) + 0.4 * F.coalesce("sem", F.lit(0.0)), 6).alias("weight"), F.when(F.col("weight").isNotNull(), "cooccurrence").otherwise("semantic").alias("kind"))


@add("m4_negative_samples")
def m4(spark, d):
    """Pairs without an edge, twice as many as edges and 2000 at most: those at distance 3, three in ten of those at distance
    2, and one in ten of pairs that no path joins. Chance is a hash of the pair, so the sample is repeatable."""
    g = table(spark, d, "duplicate_groups", "group_id", "paper_id")
    from lodestone.plans.relations import _paper_graph

    e = cut(_paper_graph(spark, d))
    want = min(e.count() or 10, 2000)
    nodes = e.select(F.col("src").alias("node")).distinct()
    chance = F.pmod(F.xxhash64("a", "b", F.lit("chance")), F.lit(1000)) / 1000.0
    near = gr.shortest_paths(e, nodes, 3).where("distance >= 2 and origin < node").select(F.col("origin").alias("a"), F.col("node").alias("b"), "distance")
    near = near.where((F.col("distance") == 3) | (chance < 0.3))
    # partners for unreachable pairs are drawn from a bounded sample of nodes
    some = nodes.join(g.withColumnRenamed("paper_id", "node"), "node").orderBy(F.xxhash64("node"), "node").limit(500)
    other = some.select(F.col("node").alias("b"), F.col("group_id").alias("gb"))
    far = some.select(F.col("node").alias("a"), F.col("group_id").alias("ga")).join(F.broadcast(other), (F.col("ga") != F.col("gb")) & (F.col("a") < F.col("b"))).where(chance < 0.1).select("a", "b", F.lit(None).cast("int").alias("distance"))
    return near.unionByName(far).orderBy(F.xxhash64("a", "b"), "a", "b").limit(want)


@add("m5_link_prediction")
def m5(spark, d):
    """Link prediction without a neural net on the graph of documents and phases: logistic regression on degrees and common
    neighbours, fitted on pairs of even hash and scored on the others; with the area under the curve there."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = table(spark, d, "facts", F.col("doc_source").alias("doc"), F.col("physical_quantity").alias("q")).where("doc is not null and q is not null").distinct()
    known = table(spark, d, "quantity_units", F.col("physical_quantity").alias("q")).distinct()
    e = cut(f.join(F.broadcast(known), "q", "left_semi"))
    pairs = e.select("doc").distinct().join(F.broadcast(known)).join(e.withColumn("label", F.lit(1.0)), ["doc", "q"], "left").fillna(0.0, ["label"])
    docs, qs = e.groupBy("doc").agg(F.count(F.lit(1)).alias("d1")), e.groupBy("q").agg(F.count(F.lit(1)).alias("d2"))
    # the label's own edge is taken out of both degrees
    x = pairs.join(docs, "doc").join(F.broadcast(qs), "q").withColumns({"d1": F.col("d1") - F.col("label"), "d2": F.col("d2") - F.col("label"), "part": F.pmod(F.xxhash64("doc", "q"), F.lit(2))})
    x = cut(VectorAssembler(inputCols=["d1", "d2"], outputCol="features").transform(x))
    if x.where("part = 0").select("label").distinct().count() < 2:
        return x.select("doc", "q", F.lit(0.0).alias("p"), F.lit(0.0).alias("auc")).limit(0)
    scored = LogisticRegression(maxIter=20, regParam=0.01).fit(x.where("part = 0")).transform(x.where("part = 1"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability").evaluate(scored)
    return scored.where("label = 0").select("doc", "q", F.round(vector_to_array("probability")[1], 6).alias("p"), F.lit(round(float(auc), 6)).alias("auc"))


@add("m6_direction_scores")
def m6(spark, d):
    """Pairs of quantities by 0.4 likeness of neighbourhoods, 0.3 novelty, 0.2 gain and less 0.1 of what is not feasible; the
    fifty best. Without a neural net the neighbourhoods' overlap stands for its score."""
    e = _edges(spark, d)
    both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.groupBy("node").agg(F.collect_set("other").alias("near"))  # a closed list of quantities
    m = quantiles(facts(spark, d, "item_id", "q", "value"), ["q"], "value", {"m": 0.5}).select(F.col("q").alias("node"), "m")
    node = near.join(m, "node", "left").fillna(0.0, ["m"])
    j = e.join(node.select(F.col("node").alias("a"), F.col("near").alias("na"), F.col("m").alias("ma")), "a").join(node.select(F.col("node").alias("b"), F.col("near").alias("nb"), F.col("m").alias("mb")), "b")
    most = e.agg(F.max("weight").alias("most"))
    overlap = F.size(F.array_intersect("na", "nb")) / F.size(F.array_union("na", "nb"))
    top, low = F.greatest(F.abs("ma"), F.abs("mb")), F.least(F.abs("ma"), F.abs("mb"))
    gain = F.when(top > 0, (top - low) / top).otherwise(0.0)
    share = F.col("weight") / F.col("most")
    s = j.join(F.broadcast(most)).select("a", "b", F.round(0.4 * overlap + 0.3 * (1 - share) + 0.2 * gain - 0.1 * (1 - share), 9).alias("score"))
    return s.orderBy(F.desc("score"), "a", "b").limit(50)


@add("m10_representatives")
def m10(spark, d):
    """Classes of materials whose names share three quarters of their letter pairs, each named by its shortest name."""
    from lodestone.functions.embedder import embedded

    def letter_pairs(texts):
        out = np.zeros((len(texts), 256))
        for i, t in enumerate(texts):
            t = f" {t.lower()} "
            for x in range(len(t) - 1):
                out[i, (ord(t[x]) * 31 + ord(t[x + 1])) % 256] += 1
        return out

    m = table(spark, d, "materials_ref", "material_id", "canonical_name")
    v = cut(embedded(m, "canonical_name", letter_pairs))
    c = ve.similarity_links(v, "material_id", "vector", 0.75).select("material_id", F.col("class").alias("cluster"))
    best = m.join(c, "material_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.length("canonical_name").alias("n"), "canonical_name")).alias("b"))
    return best.select("cluster", "members", F.col("b.canonical_name").alias("representative"))


@add("m7_ridge_regression")
def m7(spark, d):
    """Ridge regression (alpha 1) of the larger property of an edge's ends, raised by 8 %, on both properties and the weight."""
    m = quantiles(facts(spark, d, "item_id", "q", "value"), ["q"], "value", {"m": 0.5})
    e = _edges(spark, d).join(m.select(F.col("q").alias("a"), F.col("m").alias("pu")), "a", "left").join(m.select(F.col("q").alias("b"), F.col("m").alias("pv")), "b", "left").fillna(0.0, ["pu", "pv"])
    top = F.greatest("pu", "pv")
    got = sg.ridge(e.withColumn("y", F.when(top > 0, top * 1.08).otherwise(0.0)), ["pu", "pv", "weight"], "y") or {}
    return spark.createDataFrame(sorted(got.items()), "term string, coefficient double")


@add("m8_cluster_validity")
def m8(spark, d):
    """Silhouette and Davies-Bouldin index of the labelled vectors, and modularity, clustering and transitivity of the graph of
    quantities."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings", "vec_id", "embedding", "label").where("embedding is not null and label is not null")
    v = e.select(F.col("label").cast("double").alias("prediction"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    silhouette = ClusteringEvaluator(metricName="silhouette").evaluate(v)
    got = [("silhouette", float(silhouette)), ("davies_bouldin", ve.davies_bouldin(e, "embedding", "label"))]
    return spark.createDataFrame(got, "metric string, value double").unionByName(sg.validity_of(_edges(spark, d)))


@add("m8_triangle_clustering", "with p as (select distinct x.physical_quantity as a, y.physical_quantity as b from extracted_values x join extracted_values y on x.doc_name = y.doc_name and x.physical_quantity <> y.physical_quantity) select x.a as node, count(*) // 2 as triangles from p x join p y on x.b = y.a join p z on y.b = z.a and z.b = x.a group by 1")
def m8_triangles(spark, d):
    e = _edges(spark, d)
    return gr.triangle_clustering(cut(gr.undirected(e, "a", "b"))).where("triangles > 0").select("node", "triangles")


@add("m17_betweenness")
def m17(spark, d):
    """The five nodes of largest betweenness."""
    b = sg.betweenness_of(_edges(spark, d))
    return b.select("node", F.round("betweenness", 9).alias("betweenness")).orderBy(F.desc("betweenness"), "node").limit(5)


@add("m21_graph_validity")
def m21(spark, d):
    v = sg.validity_of(_edges(spark, d))
    return v.withColumn("value", F.round("value", 9))


@add("r2_index_recall")
def r2_index(spark, d):
    """Share of the exact ten nearest that the index of cells finds, over the stated queries."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 50 = 0")
    exact = ve.nearest(e, q, "vec_id", "embedding", 10).select("query", F.col("key").alias("k"))
    index = ve.cell_index(e, "vec_id", "embedding")
    found = ve.nearest_in_cells(index, q, "vec_id", "embedding", 10).select("query", F.col("key").alias("k"), F.lit(1).alias("hit"))
    return exact.join(found, ["query", "k"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


@add("r3_multi_query")
def r3(spark, d):
    """Chunks found for several wordings of a question by a pluggable embedder, each once with its best similarity, and of
    each only the sentences that hold a word of the question."""
    from lodestone.functions.embedder import embedded, hashing_embedder

    wordings = ["laser power and porosity", "pores at high beam power", "influence of power on keyhole pores"]
    c = table(spark, d, "chunks", "chunk_id", "content").where("content <> ''").distinct()
    docs = embedded(c, "content", hashing_embedder(64)).select("chunk_id", "content", F.col("vector").alias("v"))
    ask = embedded(spark.createDataFrame([(-1 - i, w) for i, w in enumerate(wordings)], "chunk_id long, content string"), "content", hashing_embedder(64)).select("chunk_id", F.col("vector").alias("v"))
    docs = cut(docs)
    top = ve.nearest(docs.select("chunk_id", "v"), ask, "chunk_id", "v", 6)
    best = top.groupBy(F.col("key").alias("chunk_id")).agg(F.max("similarity").alias("similarity"))
    words = ["laser", "power", "poros", "pore", "keyhole"]
    kept = F.concat_ws(" ", F.filter(F.split(F.regexp_replace("content", r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: tx.contained(x, words) > 0))
    return docs.join(F.broadcast(best), "chunk_id").select("chunk_id", F.round("similarity", 6).alias("similarity"), kept.alias("extract"))


# sinks: written to the shared folder and read back
def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@add("k1_insert_or_ignore", "select paper_id, checksum_sha256 from (select paper_id, checksum_sha256, row_number() over (partition by checksum_sha256 order by paper_id) as rn from papers where checksum_sha256 is not null) where rn = 1")
def k1(spark, d):
    """Papers stored in two batches; a checksum that is stored already is ignored."""
    p = table(spark, d, "papers", "paper_id", "checksum_sha256")
    half = p.agg(F.percentile_approx("paper_id", 0.5, 100)).first()[0]
    path = _folder(spark, "papers")
    for part in (p.where(F.col("paper_id") <= (half or 0)), p.where(F.col("paper_id") > (half or 0))):
        writers.insert_or_ignore(part, path, "checksum_sha256", order="paper_id")
    return spark.read.parquet(path).select("paper_id", "checksum_sha256")


@add("k2_replace_per_key", "select feed, count(*) as n from papers where feed is not null group by 1")
def k2(spark, d):
    """Counts per feed, written twice; the second writing replaces the feeds it holds."""
    g = table(spark, d, "papers", "feed").where("feed is not null").groupBy("feed").agg(F.count(F.lit(1)).alias("n"))
    path = _folder(spark, "feeds")
    writers.replace_keys(g.withColumn("n", F.lit(0).cast("long")).select("n", "feed"), path, "feed")
    writers.replace_keys(g.select("n", "feed"), path, "feed")
    return spark.read.parquet(path).select(F.col("feed").cast("string").alias("feed"), "n")


@add("k3_chunk_upsert", "select source, chunk_index, max(chunk_id) as chunk_id from chunks where source is not null and chunk_index is not null group by 1, 2")
def k3(spark, d):
    """Chunks stored by source and index, later ones in place of earlier ones."""
    c = table(spark, d, "chunks", "source", "chunk_index", "chunk_id").where("source is not null and chunk_index is not null")
    path = _folder(spark, "chunks")
    writers.upsert(c, path, ["source", "chunk_index"], "chunk_id")
    return spark.read.parquet(path)


@add("k4_edge_export", f"select a as src, b as dst, w as weight from ({_COOC})")
def k4(spark, d):
    """Node-link export of the graph of quantities, read back."""
    e = _edges(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    path = _folder(spark, "graph")
    writers.export_graph(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e, path)
    return spark.read.schema("src string, dst string, weight long").json(f"{path}/links")


@add("k4_edge_csv", f"select a as src, b as dst, w as weight from ({_COOC})")
def k4_csv(spark, d):
    e = _edges(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    path = _folder(spark, "edges")
    writers.export_csv(e, path)
    return spark.read.schema("src string, dst string, weight long").option("header", True).csv(path)


_FUSED = f"select property_name, count(*) as n, avg(normalized_value) as mean, stddev_pop(normalized_value) as std from {_A} where normalized_value is not null group by 1"


@add("k6_comparison_table", f"select property_name, n, {sig_sql('mean', 4)} as mean, case when cv < 0.1 and n >= 2 then 'HIGH' when cv < 0.3 or n = 1 then 'MODERATE' else 'LOW' end as level from (select *, case when mean = 0 then 1.0 else std / abs(mean) end as cv from ({_FUSED}))")
def k6(spark, d):
    """Fused properties as a comparison table; ``writers.comparison_table`` gives it in four styles."""
    f = fused_numeric(properties(spark, d, "property_id", "property_name", "normalized_value"), ["property_name"], "normalized_value")
    return f.select("property_name", "n", sig("mean", 4).alias("mean"), "level")


@add("k5_report", f"select q, count(*) as n, '- ' || q || ': ' || count(*) || ' values in ' || count(distinct doc) || ' documents' as line from {_E} where value is not null group by q")
def k5(spark, d):
    """Lines of the report on quantities, written as JSON and read back."""
    g = values(spark, d, "value_id", "q", "doc", "value").where("value is not null").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))
    path = _folder(spark, "report")
    writers.export_json(g.select("q", "n", F.format_string("- %s: %d values in %d documents", "q", "n", "docs").alias("line")), path)
    return spark.read.schema("q string, n long, line string").json(path)


@add("k7_edge_explanations", f"select src, dst, weight, src || ' and ' || dst || ' in ' || weight || ' documents' as explanation from (select a as src, b as dst, w as weight from ({_COOC})) order by weight desc, src, dst")
def k7(spark, d):
    e = _edges(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    x = e.withColumn("explanation", F.format_string("%s and %s in %d documents", "src", "dst", "weight"))
    return x.where("explanation <> ''").orderBy(F.desc("weight"), "src", "dst")


@add("k8_tree_cache")
def k8(spark, d):
    """Cache keys of documents: the safe name and the hash of the pages' hashes in order."""
    p = table(spark, d, "pages_text", "filename", "page_num", "page_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).where("filename is not null")
    g = p.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("page_num", "page_id", "h"))).alias("x"))
    whole = F.sha2(F.concat_ws("", F.transform("x", lambda y: y["h"])), 256)
    return g.select(F.concat(F.regexp_replace("filename", "[^A-Za-z0-9._-]", "_"), F.lit("."), F.substring(whole, 1, 16)).alias("cache_key"), F.size("x").alias("pages"))


QUERIES, ORACLE = C.queries, C.oracle
