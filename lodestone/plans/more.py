"""Further operators of the inventory as queries: classification details, trees, batches, projections and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vocabulary as vo
from lodestone.operators import graphs as gr
from lodestone.operators import structure as st
from lodestone.operators.ranking import top_per_key
from lodestone.plans.aggregates import _F, facts
from lodestone.plans.extraction import _case, _contained
from lodestone.plans.registry import Catalogue
from lodestone.session import cut, small, table
from lodestone.streaming import ingest

C = Catalogue()
add = C.add


@add("s15_demo_graph", "select i as src, (i * 7 + 3) % 20 as dst from range(0, 20) r(i)")
def s15(spark, d):
    return spark.range(20).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 20).alias("dst"))


@add("x22_dimension_class")
def p22(spark, d):
    """Kinds of quantity a stated unit can measure, by the rule-built unit table."""
    from lodestone.functions.unit_table import QUANTITY_KIND, unit_key, unit_rows

    dim = spark.createDataFrame(sorted({(k, QUANTITY_KIND[q][0]) for q, k, *_ in unit_rows()}), "ukey string, kind string")
    e = table(spark, d, "extracted_values", "value_id", "unit").where("unit is not null").distinct().withColumn("ukey", unit_key(F.col("unit")))
    return e.join(F.broadcast(dim), "ukey").select("value_id", "kind").distinct()


@add("x24_concept_normalise")
def p24(spark, d):
    """Exact alias, else the longest contained alias, else the closest within an edit ratio of 85, else lower case."""
    q = table(spark, d, "quantity_units", "physical_quantity", "other_names")
    names = q.select(F.col("physical_quantity").alias("q"), F.explode(F.split(F.concat("other_names", F.lit("; "), F.regexp_replace("physical_quantity", "_", " ")), ";")).alias("a")).select("q", F.lower(F.trim("a")).alias("a"))
    terms = table(spark, d, "facts", "physical_quantity").where("physical_quantity is not null").distinct().withColumn("t", F.lower(F.trim(F.regexp_replace("physical_quantity", r"[_\-]+", " "))))
    return st.alias_normalise(terms, "t", names, "a", "q").select("physical_quantity", F.col("normal").alias("concept"))


_INLINE = r"([a-z]+ [a-z]+) (?:of|reached|was) ([0-9]+(?:\.[0-9]+)?) "


@add("x66_quantity_schema", "select physical_quantity, base_unit, len(string_split(other_names, ';')) as aliases from quantity_units")
def p66(spark, d):
    return table(spark, d, "quantity_units", "physical_quantity", "base_unit", "other_names").select("physical_quantity", "base_unit", F.size(F.split("other_names", ";")).alias("aliases"))


@add("x68_span_dedupe")
def p68(spark, d):
    """Spans of a page, of overlapping candidates the first and longest; a surer one that overlaps it replaces it."""
    return st.entity_spans(table(spark, d, "pages_text", "page_id", "text").where("text is not null"), "page_id", "text")


@add("x69_entity_normalisation", "select distinct f.material, m.material_id from (select distinct material from facts) f join (select material_id, trim(unnest(string_split(canonical_name || coalesce('; ' || other_names, ''), ';'))) as n from materials_ref) m on lower(trim(f.material)) = lower(m.n)")
def p69(spark, d):
    m = table(spark, d, "materials_ref", "material_id", "canonical_name", "other_names")
    names = m.select("material_id", F.explode(F.split(F.concat("canonical_name", F.coalesce(F.concat(F.lit("; "), "other_names"), F.lit(""))), ";")).alias("n")).select("material_id", F.lower(F.trim("n")).alias("n"))
    f = table(spark, d, "facts", "material").distinct().withColumn("n", F.lower(F.trim("material")))
    return f.join(small(names), "n").select("material", "material_id").distinct()


@add("x70_comparison_narrative", "select parameter_name, array_to_string(list_sort(list_distinct(list(unit))), ', ') as units from extracted_values where parameter_name is not null and unit is not null group by 1")
def p70(spark, d):
    return table(spark, d, "extracted_values", "parameter_name", "unit").where("parameter_name is not null and unit is not null").groupBy("parameter_name").agg(F.array_join(F.array_sort(F.collect_set("unit")), ", ").alias("units"))


@add("j4_copair_counts", "with s as (select distinct source_citation as doc, phase as p from alloy_properties where phase is not null and source_citation is not null) select x.p as a, y.p as b, count(*) as docs from s x join s y on x.doc = y.doc and x.p < y.p group by 1, 2")
def j4(spark, d):
    from lodestone.operators.facts import cooccurrence

    return cooccurrence(table(spark, d, "alloy_properties", "phase", "source_citation").where("source_citation is not null"), "phase", "source_citation")


@add("g45_document_entity_counts", f"select doc, material, count(*) as n from {_F} where material is not null group by 1, 2")
def g45(spark, d):
    return facts(spark, d, "item_id", "doc", "material").where("material is not null").groupBy("doc", "material").agg(F.count(F.lit(1)).alias("n"))


@add("g49_grain_morphology")
def g49(spark, d):
    """Connected regions of a binary field, labelled per field; sizes, mean area and phase fraction."""
    grid = table(spark, d, "lineitem", "l_returnflag", "l_linenumber", "l_quantity").where("l_quantity is not null")
    cells = grid.select(F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("int").alias("col")).groupBy("field", "row", "col").agg(F.count(F.lit(1)).alias("n")).withColumn("on", F.col("n") % 2 == 1)
    return st.region_statistics(cells)


@add("g50_context_relevance", "select round(avg(list_cosine_similarity(embedding::double[], (select embedding from embeddings order by vec_id limit 1)::double[])), 9) as relevance from embeddings")
def g50(spark, d):
    from lodestone.operators.vectors import dot, unit

    e = table(spark, d, "embeddings", "vec_id", "embedding")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).agg(F.round(F.avg(dot(unit(F.col("embedding")), unit(F.col("q")))), 9).alias("relevance"))


@add("w4_top_subgraph", "with e as (select x.physical_quantity as a, y.physical_quantity as b, count(distinct x.doc_name) as w from extracted_values x join extracted_values y on x.doc_name = y.doc_name and x.physical_quantity <> y.physical_quantity group by 1, 2) select a as node, sum(w) as degree from e group by 1 order by degree desc, node limit 5")
def w4(spark, d):
    pairs = k4(spark, d)
    both = pairs.select(F.col("src").alias("node"), "weight").unionByName(pairs.select(F.col("dst").alias("node"), "weight"))
    return both.groupBy("node").agg(F.sum("weight").alias("degree")).orderBy(F.desc("degree"), "node").limit(5)


@add("w10_greedy_batches")
def w10(spark, d):
    """Items packed in order into batches of at most 6000 characters per source; a longer item forms its own batch."""
    c = table(spark, d, "chunks", "source", "chunk_index", "content").where("content is not null and source is not null").distinct()
    return st.greedy_batches(c, "source", "chunk_index", F.length("content"), 6000)


@add("w11_coverage_bitmap", "select distinct f.doc_source as doc, p as page from (select distinct doc_source, page from facts where page is not null) f, range(0, 60) r(p) where p between greatest(0, f.page - 2) and f.page + 1")
def w11(spark, d):
    f = table(spark, d, "facts", "doc_source", "page").where("page is not null").distinct()
    return f.select(F.col("doc_source").alias("doc"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("page") - 2), F.col("page") + 1)).alias("page")).distinct()


@add("r10_blend", f"select filename, round(0.6 * {_contained('title', ['laser'])} + 0.4 * {_contained('abstract', ['laser'])}, 9) as score from papers")
def r10(spark, d):
    return table(spark, d, "papers", "filename", "title", "abstract").select("filename", F.round(0.6 * tx.contained(F.col("title"), ["laser"]) + 0.4 * tx.contained(F.col("abstract"), ["laser"]), 9).alias("score"))


@add("r17_regex_then_verify", "select distinct page_id, v from (select page_id, text, unnest(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?) MPa', 1)) as v from pages_text) where contains(text, ' ' || v || ' ')")
def r17(spark, d):
    p = table(spark, d, "pages_text", "page_id", "text").select("page_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?) MPa"), 1))).alias("v"))
    return p.where(F.col("text").contains(F.concat(F.lit(" "), "v", F.lit(" ")))).select("page_id", "v")


def k4(spark, d):
    from lodestone.operators.facts import cooccurrence

    return cooccurrence(table(spark, d, "extracted_values", "physical_quantity", "doc_name"), "physical_quantity", "doc_name").withColumnsRenamed({"a": "src", "b": "dst", "docs": "weight"})


def _quantity_edges(spark, d):
    return cut(gr.undirected(k4(spark, d), "src", "dst"))


@add("m9_bootstrap_interval")
def m9(spark, d):
    """Percentile interval of the mean over 500 Poisson resamples, drawn in one pass over the rows."""
    e = table(spark, d, "extracted_values", "value_id", "confidence").where("confidence is not null").distinct()
    return st.bootstrap_mean(e, "value_id", "confidence", 500)


@add("m14_stratified_sample", "select paper_id from (select paper_id, row_number() over (partition by feed order by md5(paper_id::varchar), paper_id) as rn from papers) where rn <= 10")
def m14(spark, d):
    p = table(spark, d, "papers", "paper_id", "feed")
    return top_per_key(p, ["feed"], [F.md5(F.col("paper_id").cast("string")), F.col("paper_id")], 10).select("paper_id")


@add("m18_heterogeneous_graph", "select 'doc-material' as kind, count(*) as edges from (select distinct doc_source, material from facts where doc_source is not null and material is not null) union all select 'doc-quantity', count(*) from (select distinct doc_source, physical_quantity from facts where doc_source is not null and physical_quantity is not null)")
def m18(spark, d):
    f = table(spark, d, "facts", F.col("doc_source").alias("doc"), "material", F.col("physical_quantity").alias("q"))
    e = f.unpivot("doc", ["material", "q"], "kind", "target").where("doc is not null and target is not null").distinct()
    return e.groupBy(F.when(F.col("kind") == "q", "doc-quantity").otherwise("doc-material").alias("kind")).agg(F.count(F.lit(1)).alias("edges"))


@add("stream_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling(spark, d):
    return ingest.tumbling_counts(table(spark, d, "events", "ts", "event_type"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@add("stream_sessions")
def stream_sessions(spark, d):
    return ingest.session_counts(table(spark, d, "events", "ts", "user_id"), "ts", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@add("s7_load_and_chunk", "select doc_id, i as chunk_no, substring(text, i * 450 + 1, 500) as piece from (select doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 450 + 1)) as i from documents where text is not null)")
def s7(spark, d):
    x = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return x.select("doc_id", F.posexplode(tx.chunk_array(F.col("text"), 500, 50)).alias("chunk_no", "piece")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@add("s11_key_value_lines", "select doc_id, k, v from (select doc_id, unnest(regexp_extract_all(text, '([A-Z][A-Za-z]+) = ([0-9.]+)', 1)) as k, unnest(regexp_extract_all(text, '([A-Z][A-Za-z]+) = ([0-9.]+)', 2)) as v from documents)")
def s11(spark, d):
    pat = r"([A-Z][A-Za-z]+) = ([0-9.]+)"
    z = F.arrays_zip(F.regexp_extract_all("text", F.lit(pat), 1).alias("k"), F.regexp_extract_all("text", F.lit(pat), 2).alias("v"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(z).alias("z")).select("doc_id", "z.k", "z.v")


@add("s12_field_cells", "select vec_id, i as col, embedding[i + 1]::double as value from (select vec_id, embedding, unnest(range(0, len(embedding))) as i from embeddings)")
def s12(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("col", "value"))
    return e.select("vec_id", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


@add("x67_concept_centroids", "select label, i as dim, round(avg(v), 9) as centre from (select label, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as v from embeddings) group by 1, 2")
def p67(spark, d):
    e = table(spark, d, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", F.col("i").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("centre"))


@add("g54_agreement_frames", "with t as (select material, count(*) as n, count(distinct method_origin) as agreement from (select distinct * from extracted_values) where material is not null group by 1 order by n desc, material limit 50) select material, k from t, range(1, 4) r(k) where agreement >= k")
def g54(spark, d):
    e = table(spark, d, "extracted_values").distinct().where("material is not null")
    top = e.groupBy("material").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("method_origin").alias("agreement")).orderBy(F.desc("n"), "material").limit(50)
    return top.where("agreement > 0").select("material", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(3).cast("long"), F.col("agreement")))).alias("k"))


@add("m2_semantic_edges", "select a.vec_id as src, b.vec_id as dst from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) >= 0.35")
def m2_edges(spark, d):
    """All pairs with a cosine of at least 0.35, of the graph with its bridges."""
    return m2_bridged(spark, d).where("kind = 'semantic'").select("src", "dst")


@add("m2_bridged_graph")
def m2_bridged(spark, d):
    """The whole semantic graph, its components joined by bridges."""
    from lodestone.operators.vectors import bridged_graph

    return bridged_graph(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 0.35)


@add("m20_projection_variance")
def m20(spark, d):
    """Share of variance of each of four principal components of the standardised vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings", "embedding").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    z = StandardScaler(withMean=True, inputCol="v", outputCol="z").fit(e).transform(e)
    got = PCA(k=4, inputCol="z", outputCol="o").fit(z).explainedVariance
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(got.toArray())], "component int, share double")


QUERIES, ORACLE = C.queries, C.oracle
