"""Queries of the text problems and, where SQL can say them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.canonical import exact_frequency, map_to_list
from lodestone.llm.consensus import consensus_survivors, usable_abstract, usable_doi, usable_title, usable_year
from lodestone.llm.encode import encode_corpus
from lodestone.llm.leaks import leaked_items, reparameterised_items
from lodestone.llm.pairs import expand_pairs, similar_classes
from lodestone.llm.scans import repair_scans, scan_repairs
from lodestone.llm.split import split_oversized
from lodestone.llm.visual import add_visual_form, look_alike_pairs, visual_texts
from lodestone.session import small, table


def _materials(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str | None]]:
    """The reference list; its 56 rows are fixed at every scale."""
    return [tuple(r) for r in table(spark, sf_dir, "materials_ref", "material_id", "canonical_name", "other_names").collect()]


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facts", "item_id", "material").select(F.lit("facts").alias("table_name"), F.col("item_id").alias("row_id"), F.col("material").alias("value"))
    a = table(spark, sf_dir, "alloy_properties", "property_id", "alloy_system").select(F.lit("alloy_properties").alias("table_name"), F.col("property_id").alias("row_id"), F.col("alloy_system").alias("value"))
    return f.unionByName(a)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _materials(spark, sf_dir)
    names = _typed_names(spark, sf_dir)
    return map_to_list(names, "value", rows, "material_id", frequency=exact_frequency(names, "value", rows)).where(~F.col("value").isin(*[r[1] for r in rows]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).where("material_id is not null").select("table_name", "row_id", "material_id").distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the values the list has no entry for."""
    return _mapped(spark, sf_dir).where("material_id = 0").groupBy("value").agg(F.count_distinct("table_name", "row_id").alias("n"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "papers", "paper_id", "abstract").select(F.lit("papers").alias("tbl"), F.col("paper_id").alias("id"), F.col("abstract").alias("t"))
    q = table(spark, sf_dir, "pages_text", "page_id", "text").select(F.lit("pages_text").alias("tbl"), F.col("page_id").alias("id"), F.col("text").alias("t"))
    return p.unionByName(q)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = expand_pairs(*similar_classes(_texts(spark, sf_dir), size=3, threshold=0.6, least=20))
    return pairs.select(F.col("tbl").alias("table_name"), "id_a", "id_b")


def _classes(members: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.select("tbl", F.col("a").alias("rep")).unionByName(links.select("tbl", F.col("b").alias("rep"))).groupBy("tbl", "rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, ["tbl", "rep"], "left").select(F.col("tbl").alias("table_name"), "id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record (five-word n-grams, similarity 0.8): its class of equal sets and its number of linked classes."""
    return _classes(*similar_classes(_texts(spark, sf_dir)))


def p3_version_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class form of p3_found: three-word n-grams, similarity 0.6, sets of at least 20."""
    return _classes(*similar_classes(_texts(spark, sf_dir), size=3, threshold=0.6, least=20))


_FIELDS = {"title": ("title", usable_title), "doi": ("doi_guess", usable_doi), "year": ("year_guess", usable_year), "abstract": ("abstract", usable_abstract)}


def _group_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    groups = table(spark, sf_dir, "duplicate_groups", "group_id", "paper_id").distinct()
    feeds = table(spark, sf_dir, "feeds", "feed", "trust").groupBy("feed").agg(F.max("trust").alias("trust"))
    papers = table(spark, sf_dir, "papers", "paper_id", "feed", *[c for c, _ in _FIELDS.values()])
    rows = papers.join(groups, "paper_id").join(small(feeds), "feed", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    # an unusable value becomes null before the fields are turned into rows
    wide = rows.select(F.col("group_id").alias("g"), F.col("paper_id").alias("row"), "trust", *[F.when(ok(F.col(c)), F.col(c)).alias(name) for name, (c, ok) in _FIELDS.items()])
    return groups, wide.unpivot(["g", "row", "trust"], list(_FIELDS), "field", "value").where("value is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, values = _group_values(spark, sf_dir)
    best = consensus_survivors(values, dominant=True).groupBy("g").pivot("field", list(_FIELDS)).agg(F.max("row"))
    out = groups.select("group_id").distinct().join(best.withColumnRenamed("g", "group_id"), "group_id", "left")
    return out.select("group_id", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(f"{n}_paper_id") for n in _FIELDS])


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group by trust-weighted consensus (votes add up), field by field."""
    _, values = _group_values(spark, sf_dir)
    best = consensus_survivors(values, dominant=False)
    chosen = best.join(values.select("g", "field", "row", "value").distinct(), ["g", "field", "row"])
    return chosen.groupBy("g").pivot("field", list(_FIELDS)).agg(F.max("value")).withColumnRenamed("g", "group_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages_text", "page_id", "filename", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repairs(_pages(spark, sf_dir), "page_id", "filename", "text").select("page_id", "kind", "item").distinct()


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs."""
    return repair_scans(_pages(spark, sf_dir), "page_id", "filename", "text").select("page_id", "text")


def _long_texts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("chunks", table(spark, sf_dir, "chunks", "chunk_id", "content"), "chunk_id", "content"), ("pages_text", table(spark, sf_dir, "pages_text", "page_id", "text"), "page_id", "text")]


def _pieces(spark: SparkSession, sf_dir: str, boundary: str) -> DataFrame:
    parts = [split_oversized(df, key, text, boundary=boundary).select(F.lit(name).alias("table_name"), F.col(key).alias("item_id"), "piece_no", "start_char", "end_char") for name, df, key, text in _long_texts(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "latest")


def p7_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items cut at the deepest valleys of lexical cohesion."""
    return _pieces(spark, sf_dir, "cohesion")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id")


def p9_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reparameterised_items(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the digest of its visual form, the class of texts a reader cannot tell apart."""
    return add_visual_form(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", F.col("form").alias("class_id"), "visible")


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document in its one consistent form."""
    return visual_texts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p3_found, p3_classes, p3_version_classes, p5_found, p5_records, p6_found, p6_repaired, p7_found, p7_cohesion, p8_ids, p9_found, p9_reparameterised, p10_found, p10_classes, p10_texts)}
ORACLE: dict[str, str] = {}
