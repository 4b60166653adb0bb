"""Filters, joins, retrieval, graphs and clustering as queries (sections 2.4, 2.5, 2.9 and 2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import graphs as gr
from lodestone.operators import vectors as ve
from lodestone.operators.ranking import top_per_key
from lodestone.operators.structure import sentence_relations
from lodestone.plans.registry import Catalogue
from lodestone.session import small, table

C = Catalogue()
add = C.add


def _contained(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(contains(lower({col}), '{w}')::int, 0)" for w in words) + ")"


@add("f2_min_confidence", "select distinct item_id from facts where confidence >= 0.55")
def f2(spark, d):
    return table(spark, d, "facts", "item_id", "confidence").where("confidence >= 0.55").select("item_id").distinct()


@add("f3_quantitative", "select distinct item_id, value from facts where item_type = 'quantitative' and value is not null and value <> 0")
def f3(spark, d):
    return table(spark, d, "facts", "item_id", "item_type", "value").where("item_type = 'quantitative' and value is not null and value <> 0").select("item_id", "value").distinct()


_KW = ["laser", "grain", "melt", "crack"]


@add("f5_page_keyword_scan", f"select page_id from pages_text where {_contained('text', _KW)} >= 2")
def f5(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").where(tx.contained(F.col("text"), _KW) >= 2).select("page_id")


@add("f6_section_prefilter", "select item_id from (select distinct item_id, section_title, content, value from facts) where contains(lower(section_title), 'result') and (contains(lower(content), 'porosity') or contains(lower(content), 'strength')) order by (value is not null) desc, item_id limit 25")
def f6(spark, d):
    f = table(spark, d, "facts", "item_id", "section_title", "content", "value").distinct()
    f = f.where(F.lower("section_title").contains("result") & (F.lower("content").contains("porosity") | F.lower("content").contains("strength")))
    return f.orderBy(F.col("value").isNotNull().desc(), "item_id").limit(25).select("item_id")


@add("f8_excluded_terms", "select distinct material from facts where material is not null and lower(trim(material)) not in ('unknown', 'n/a', '')")
def f8(spark, d):
    return table(spark, d, "facts", "material").where(~F.lower(F.trim("material")).isin("unknown", "n/a", "")).distinct()


@add("f9_softmax_threshold", "select value_id from (select value_id, exp(confidence) / sum(exp(confidence)) over (partition by query_text) as p, count(*) over (partition by query_text) as n from (select distinct value_id, query_text, confidence from extracted_values where confidence is not null and query_text is not null)) where round(p, 12) > round(1.0 / n, 12) or n <= 5")
def f9(spark, d):
    e = table(spark, d, "extracted_values", "value_id", "query_text", "confidence").where("confidence is not null").distinct()
    # totals are aggregated before the join, so that one frequent query is not gathered in a window
    t = e.groupBy("query_text").agg(F.sum(F.exp("confidence")).alias("z"), F.count(F.lit(1)).alias("n"))
    return e.join(t, "query_text").where((F.round(F.exp("confidence") / F.col("z"), 12) > F.round(1.0 / F.col("n"), 12)) | (F.col("n") <= 5)).select("value_id")


_PQ = "select distinct doc_name, material, {c} as {n} from extracted_values where physical_quantity = '{q}' and value is not null"


@add("j1_many_to_many", f"select count(*) as pairs, count(distinct p.doc_name) as docs from ({_PQ.format(c='value', n='power', q='laser_power')}) p join ({_PQ.format(c='value', n='speed', q='scan_speed')}) s on p.doc_name = s.doc_name and p.material is not distinct from s.material")
def j1(spark, d):
    e = table(spark, d, "extracted_values", "doc_name", "material", "physical_quantity", "value").where("value is not null").distinct()
    p = e.where("physical_quantity = 'laser_power'").select("doc_name", "material", F.col("value").alias("power"))
    s = e.where("physical_quantity = 'scan_speed'").select(F.col("doc_name").alias("d2"), F.col("material").alias("m2"), F.col("value").alias("speed"))
    # the number of pairs follows from the group sizes, so hot documents need no expansion
    a = p.groupBy("doc_name", "material").agg(F.count(F.lit(1)).alias("np"))
    b = s.groupBy("d2", "m2").agg(F.count(F.lit(1)).alias("ns"))
    j = a.join(b, (F.col("doc_name") == F.col("d2")) & F.col("material").eqNullSafe(F.col("m2")))
    return j.agg(F.coalesce(F.sum(F.col("np") * F.col("ns")), F.lit(0)).alias("pairs"), F.count_distinct("doc_name").alias("docs"))


@add("j3_left_join_fill", "select p.filename, coalesce(n, 0) as facts from papers p left join (select doc_source, count(distinct item_id) as n from facts group by 1) f on p.filename = f.doc_source")
def j3(spark, d):
    n = table(spark, d, "facts", F.col("doc_source").alias("filename"), "item_id").groupBy("filename").agg(F.count_distinct("item_id").alias("facts"))
    return table(spark, d, "papers", "filename").join(n, "filename", "left").fillna(0, ["facts"])


@add("j6_page_range_join", "select p.page_id, r.part from pages_text p join (values ('front', 1, 2), ('body', 3, 6), ('back', 7, 99)) r(part, lo, hi) on p.page_num between r.lo and r.hi")
def j6(spark, d):
    r = spark.createDataFrame([("front", 1, 2), ("body", 3, 6), ("back", 7, 99)], "part string, lo int, hi int")
    return table(spark, d, "pages_text", "page_id", "page_num").join(F.broadcast(r), F.col("page_num").between(F.col("lo"), F.col("hi"))).select("page_id", "part")


@add("j7_nearest_parent", "select item_id, page_num from (select f.item_id, p.page_num, row_number() over (partition by f.item_id order by abs(p.page_num - f.page), p.page_num) as rn from (select distinct item_id, doc_source, page from facts where page is not null) f join (select distinct filename, page_num from pages_text) p on f.doc_source = p.filename) where rn = 1")
def j7(spark, d):
    # the pages of a document are aggregated to one array first, then the nearest is picked inside each fact's row
    pages = table(spark, d, "pages_text", F.col("filename").alias("doc_source"), "page_num").where("page_num is not null").groupBy("doc_source").agg(F.collect_set("page_num").alias("p"))
    f = table(spark, d, "facts", "item_id", "doc_source", "page").where("page is not null").distinct().join(pages, "doc_source")
    near = F.array_min(F.transform("p", lambda x: F.struct(F.abs(x - F.col("page")).alias("k"), x.alias("page_num"))))
    return f.select("item_id", near["page_num"].alias("page_num"))


@add("j9_link_counts", "select a.vec_id, count(b.vec_id) as links from embeddings a left join embeddings b on a.vec_id <> b.vec_id and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) >= 0.3 group by 1")
def j9_counts(spark, d):
    """Number of vectors with a cosine of at least 0.3 to each vector, over all pairs in blocks."""
    return j9_links(spark, d).select("vec_id", "links")


@add("j9_similarity_links")
def j9_links(spark, d):
    """The similarity join over all vectors: each with its number of links and its class."""
    return ve.similarity_links(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 0.3)


@add("j8_dictionary_join", "select item_id, q from (select f.item_id, q.physical_quantity as q, row_number() over (partition by f.item_id order by length(a) desc, a) as rn from (select distinct item_id, content from facts) f join (select physical_quantity, trim(unnest(string_split(other_names || '; ' || replace(physical_quantity, '_', ' '), ';'))) as a from quantity_units) q on contains(lower(f.content), lower(q.a))) where rn = 1")
def j8(spark, d):
    """The longest alias that a content holds, of equally long ones the first; the dictionary is looked through in the row."""
    q = table(spark, d, "quantity_units", "physical_quantity", "other_names")
    names = q.select(F.col("physical_quantity").alias("q"), F.explode(F.split(F.concat("other_names", F.lit("; "), F.regexp_replace("physical_quantity", "_", " ")), ";")).alias("a")).select("q", F.trim("a").alias("a")).distinct()
    one = names.agg(F.array_sort(F.collect_list(F.struct((-F.length("a")).alias("k"), "a", "q"))).alias("names"))  # the fixed list of quantities
    f = table(spark, d, "facts", "item_id", "content").distinct().where("content is not null")
    hit = F.get(F.filter("names", lambda x: F.lower("content").contains(F.lower(x["a"]))), F.lit(0))
    return f.join(F.broadcast(one)).select("item_id", hit["q"].alias("q")).where("q is not null")


@add("j10_semi_join", "select page_id from pages_text where filename in (select doc_source from facts where physical_quantity = 'porosity')")
def j10(spark, d):
    f = table(spark, d, "facts", F.col("doc_source").alias("filename"), "physical_quantity").where("physical_quantity = 'porosity'").select("filename").distinct()
    return table(spark, d, "pages_text", "page_id", "filename").join(f, "filename", "left_semi").select("page_id")


@add("j11_anti_join", "select filename from papers p where not exists (select 1 from facts f where f.doc_source = p.filename and f.physical_quantity = 'porosity')")
def j11(spark, d):
    f = table(spark, d, "facts", F.col("doc_source").alias("filename"), "physical_quantity").where("physical_quantity = 'porosity'").select("filename").distinct()
    return table(spark, d, "papers", "filename").join(f, "filename", "left_anti")


@add("j12_missing_edges", "with s as (select distinct physical_quantity as q from quantity_units), e as (select distinct x.physical_quantity as a, y.physical_quantity as b from extracted_values x join extracted_values y on x.doc_name = y.doc_name and x.physical_quantity < y.physical_quantity) select s.q as a, t.q as b from s join s t on s.q < t.q where not exists (select 1 from e where e.a = s.q and e.b = t.q)")
def j12(spark, d):
    from lodestone.operators.facts import cooccurrence

    s = table(spark, d, "quantity_units", F.col("physical_quantity").alias("a")).distinct()
    pairs = s.join(F.broadcast(s.select(F.col("a").alias("b"))), F.col("a") < F.col("b"))
    have = cooccurrence(table(spark, d, "extracted_values", "physical_quantity", "doc_name"), "physical_quantity", "doc_name")
    return pairs.join(have, ["a", "b"], "left_anti")


@add("j15_siblings", "select a.chunk_id, count(b.chunk_id) as siblings from (select distinct chunk_id, source, chunk_index from chunks) a left join (select distinct chunk_id, source, chunk_index from chunks) b on a.source = b.source and abs(a.chunk_index - b.chunk_index) = 1 group by 1")
def j15(spark, d):
    c = table(spark, d, "chunks", "chunk_id", "source", "chunk_index").distinct()
    # a sibling is looked up by its exact index, so a frequent source is no hot key
    want = c.select("chunk_id", "source", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    have = c.groupBy("source", "chunk_index").agg(F.count(F.lit(1)).alias("n"))
    n = want.join(have, ["source", "chunk_index"]).groupBy("chunk_id").agg(F.sum("n").alias("siblings"))
    return c.select("chunk_id").distinct().join(n, "chunk_id", "left").fillna(0, ["siblings"])


@add("j16_sentence_relations")
def j16_relations(spark, d):
    """All mentions of a sentence for the three type pairs."""
    m = table(spark, d, "materials_ref", "canonical_name", "other_names").collect()  # a fixed dimension
    names = {n.strip(): r["canonical_name"] for r in m for n in (r["other_names"] or "").split(";")} | {r["canonical_name"]: r["canonical_name"] for r in m}
    return sentence_relations(table(spark, d, "pages_text", "page_id", "text"), "page_id", "text", {k: v for k, v in names.items() if k})


@add("j17_two_level_fallback", "with d as (select doc_source, material, row_number() over (partition by doc_source order by count(*) desc, material) as rn from (select distinct item_id, doc_source, material from facts) where material is not null group by 1, 2) select f.item_id, coalesce(f.material, d.material) as material from (select distinct item_id, doc_source, material from facts) f left join d on f.doc_source = d.doc_source and d.rn = 1")
def j17(spark, d):
    f = table(spark, d, "facts", "item_id", "doc_source", "material").distinct()
    n = f.where("material is not null").groupBy("doc_source", "material").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("doc_source").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("material").alias("m"))).alias("b")).select("doc_source", F.col("b.m").alias("usual"))
    return f.join(best, "doc_source", "left").select("item_id", F.coalesce("material", "usual").alias("material"))


_TERMS = ["porosity", "grain", "laser"]


@add("r2_vector_top_k", "select q as query, k as key, similarity, rn as rank from (select q, k, similarity, row_number() over (partition by q order by similarity desc, k) as rn from (select a.vec_id as q, b.vec_id as k, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as similarity from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)) where rn <= 5")
def r2(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return ve.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


def _quantity_graph(spark, d):
    from lodestone.operators.facts import cooccurrence

    pairs = cooccurrence(table(spark, d, "extracted_values", "physical_quantity", "doc_name"), "physical_quantity", "doc_name")
    return gr.undirected(pairs, "a", "b")


@add("r5_personalised_pagerank")
def r5(spark, d):
    from lodestone.session import cut

    e = cut(_quantity_graph(spark, d))
    start = spark.createDataFrame([("porosity", 1.0)], "node string, weight double")
    return gr.pagerank(e, rounds=10, personal=start).select("node", F.round("rank", 9).alias("rank"))


@add("r16_bm25", "with p as (select page_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from pages_text where text is not null), s as (select count(*) as n, avg(len(w)) as l from p), t as (select 'porosity' as term union all select 'keyhole'), f as (select p.page_id, t.term, len(list_filter(p.w, lambda x: x = t.term)) as tf, len(p.w) as dl from p, t), df as (select term, count(*) filter (tf > 0) as df from f group by 1) select page_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / l))), 6) as score from f join df using (term), s where tf > 0 group by 1")
def r16(spark, d):
    from lodestone.operators.search import bm25

    return bm25(table(spark, d, "pages_text", "page_id", "text"), "page_id", "text", ["porosity", "keyhole"])


@add("r18_query_expansion", "select distinct q.physical_quantity as term, trim(a) as expanded from (select physical_quantity, unnest(string_split(other_names, ';')) as a from quantity_units) q")
def r18(spark, d):
    q = table(spark, d, "quantity_units", "physical_quantity", "other_names")
    return q.select(F.col("physical_quantity").alias("term"), F.explode(F.split("other_names", ";")).alias("a")).select("term", F.trim("a").alias("expanded")).distinct()


@add("r19_word_cloud", "select word, n * (1 + ln(sources + 1)) as raw, n from (select word, count(*) as n, count(distinct source) as sources from (select source, unnest(regexp_extract_all(lower(content), '[a-z]{3,}')) as word from (select distinct chunk_id, source, content from chunks)) group by 1) order by n desc, word limit 100")
def r19(spark, d):
    c = table(spark, d, "chunks", "chunk_id", "source", "content").distinct()
    # counted per source first: one frequent source brings one row per word
    w = c.select("source", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), 0)).alias("word")).groupBy("word", "source").agg(F.count(F.lit(1)).alias("n"))
    g = w.groupBy("word").agg(F.sum("n").alias("n"), F.count("source").alias("sources"))
    return g.select("word", (F.col("n") * (1 + F.log(F.col("sources") + 1))).alias("raw"), "n").orderBy(F.desc("n"), "word").limit(100)


@add("g36_retrieval_metrics", "with r as (select a.vec_id as q, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank, (a.label = b.label)::int as rel from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), m as (select q, sum(rel) * 1.0 / 5 as precision_5, coalesce(1.0 / min(case when rel = 1 then rank end), 0) as rr, sum(rel / log2(rank + 1)) as dcg from r where rank <= 5 group by q) select round(avg(precision_5), 9) as precision_5, round(avg(rr), 9) as mrr, round(avg(dcg), 9) as dcg from m")
def g36(spark, d):
    from lodestone.operators.search import retrieval_metrics

    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    top = ve.nearest(e.select("vec_id", "embedding"), e.where("vec_id % 50 = 0").select("vec_id", "embedding"), "vec_id", "embedding", 5)
    label = e.select("vec_id", "label")
    r = top.join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(label.select(F.col("vec_id").alias("key"), F.col("label").alias("kl")), "key")
    return retrieval_metrics(r.select("query", "rank", (F.col("ql") == F.col("kl")).cast("int").alias("relevant")), 5)


@add("g40_graph_metrics", "with p as (select distinct x.physical_quantity as a, y.physical_quantity as b from extracted_values x join extracted_values y on x.doc_name = y.doc_name and x.physical_quantity < y.physical_quantity), n as (select a as v from p union select b from p), c as (select (select count(*) from n) as nodes, (select count(*) from p) as edges) select nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 9) as density, round(2.0 * edges / nodes, 9) as mean_degree from c")
def g40(spark, d):
    m = gr.graph_metrics(_quantity_graph(spark, d))
    return m.select("nodes", "edges", F.round("density", 9).alias("density"), F.round("mean_degree", 9).alias("mean_degree"))


def _paper_graph(spark, d):
    """Papers of one duplicate group as a path, so that no group is expanded to pairs."""
    g = table(spark, d, "duplicate_groups", "group_id", "paper_id")
    w = Window.partitionBy("group_id").orderBy("paper_id")
    chain = g.select("paper_id", F.lead("paper_id").over(w).alias("next")).where("next is not null")
    return gr.undirected(chain, "paper_id", "next")


@add("m3_all_shortest_paths", "select a.paper_id as origin, b.paper_id as node, abs(a.r - b.r) as distance from (select group_id, paper_id, row_number() over (partition by group_id order by paper_id) as r from duplicate_groups) a join (select group_id, paper_id, row_number() over (partition by group_id order by paper_id) as r from duplicate_groups) b on a.group_id = b.group_id where abs(a.r - b.r) <= 4 and a.group_id in (select group_id from duplicate_groups group by 1 having count(*) > 1)")
def m3_all(spark, d):
    """Paths of at most four steps from every paper."""
    from lodestone.session import cut

    e = cut(_paper_graph(spark, d))
    return gr.shortest_paths(e, e.select(F.col("src").alias("node")).distinct(), 4)


@add("m11_connected_components", "select paper_id as node, min(paper_id) over (partition by group_id) as component from duplicate_groups where group_id in (select group_id from duplicate_groups group by 1 having count(*) > 1)")
def m11(spark, d):
    from lodestone.session import cut

    return gr.connected_components(cut(_paper_graph(spark, d)))


@add("m12_one_dimensional_clusters", "select c_nationkey, count(*) as members from (select c_nationkey, s, sum(brk) over (partition by c_nationkey order by s rows unbounded preceding) as cluster from (select c_nationkey, c_acctbal as s, case when c_acctbal - lag(c_acctbal) over (partition by c_nationkey order by c_acctbal) <= 100 then 0 else 1 end as brk from customer)) group by c_nationkey, cluster having count(*) >= 2")
def m12(spark, d):
    from lodestone.operators.search import gap_clusters

    c = gap_clusters(table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", 100.0, "c_custkey")
    return c.groupBy("c_nationkey", "cluster").agg(F.count(F.lit(1)).alias("members")).where("members >= 2").select("c_nationkey", "members")


@add("m13_kmeans_clusters")
def m13(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=5, maxIter=10).fit(e)
    return model.transform(e).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


@add("m16_pca")
def m16(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="o").fit(e).transform(e).select("vec_id", vector_to_array("o").alias("o"))
    return p.select("vec_id", F.col("o")[0].alias("x"), F.col("o")[1].alias("y"))


@add("m15_topics")
def m15(spark, d):
    """Topics of all abstracts over a sweep of their number: terms, and how often a topic's terms occur together.

    Coherence is the mean logarithm of (documents with both terms + 1) to (documents with the more frequent one).
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from lodestone.session import cut

    p = cut(table(spark, d, "papers", "paper_id", "abstract").where("abstract <> ''").select("paper_id", F.regexp_extract_all(F.lower("abstract"), F.lit("[a-z]{4,}"), 0).alias("w")).where(F.size("w") > 0))
    if p.isEmpty():
        return spark.createDataFrame([], "topics int, topic int, terms array<string>, coherence double")
    cv = CountVectorizer(inputCol="w", outputCol="features", minDF=2.0).fit(p)
    x = cv.transform(p)
    out = None
    for k in (3, 5):
        model = LDA(k=k, maxIter=20, seed=3, optimizer="online").fit(x)
        t = model.describeTopics(5).select(F.lit(k).alias("topics"), "topic", F.transform("termIndices", lambda i: F.element_at(F.lit(cv.vocabulary), i + 1)).alias("terms"))
        out = t if out is None else out.unionByName(t)
    out = cut(out)
    pairs = out.select("topics", "topic", F.explode("terms").alias("a"), "terms").select("topics", "topic", "a", F.explode("terms").alias("b")).where("a < b")
    wanted = [r["a"] for r in out.select(F.explode("terms").alias("a")).distinct().collect()]  # five terms a topic
    held = p.select("paper_id", F.explode(F.array_intersect(F.array_distinct("w"), F.array(*[F.lit(w) for w in wanted]))).alias("a"))
    df = held.groupBy("a").agg(F.count(F.lit(1)).alias("df"))
    both = held.join(held.withColumnRenamed("a", "b"), "paper_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    s = pairs.join(both, ["a", "b"], "left").join(df.withColumnRenamed("df", "da"), "a").join(df.withColumnsRenamed({"a": "b", "df": "db"}), "b")
    c = s.groupBy("topics", "topic").agg(F.round(F.avg(F.log((F.coalesce("both", F.lit(0)) + 1) / F.greatest("da", "db"))), 6).alias("coherence"))
    return out.join(c, ["topics", "topic"], "left")


QUERIES, ORACLE = C.queries, C.oracle
