"""Scans, sinks' keys and scalar extraction as queries (sections 2.1 to 2.3 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vocabulary as vo
from lodestone.operators.quantities import normalise_units
from lodestone.plans.registry import Catalogue
from lodestone.session import small, table

C = Catalogue()
add = C.add


def _q(s: str) -> str:
    return s.replace("'", "''")


def _hits(col: str, patterns: list[str]) -> str:
    return " + ".join(f"coalesce(len(regexp_extract_all(lower({col}), '{_q(p)}')), 0)" for p in patterns)


def _contained(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(contains(lower({col}), '{_q(w)}')::int, 0)" for w in words) + ")"


def _case(col: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    return "case " + " ".join(f"when {' or '.join(f"contains(lower({col}), '{_q(w)}')" for w in ws)} then '{n}'" for n, ws in rules) + f" else '{default}' end"


@add("s1_page_text_scan", "select page_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') as text from pages_text")
def s1(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").select("page_id", tx.squeeze(F.col("text")).alias("text"))


@add("s2_pages_truncated", "select page_id, case when length(text) > 20000 then substring(text, 1, 20000) || ' [cut]' else text end as text from pages_text")
def s2(spark, d):
    """Every page, cut with a mark beyond 20,000 characters."""
    return table(spark, d, "pages_text", "page_id", "text").select("page_id", tx.truncated(F.col("text"), 20_000).alias("text"))


@add("s3_page_range_scan", "select page_id, page_num from pages_text where page_num in (select unnest(generate_series(1, 7, 2)))")
def s3(spark, d):
    wanted = spark.range(1, 8, 2).select(F.col("id").cast("int").alias("page_num"))
    return table(spark, d, "pages_text", "page_id", "page_num").join(F.broadcast(wanted), "page_num", "left_semi").select("page_id", "page_num")


@add("s6_loader_fallback", "select paper_id, coalesce(nullif(abstract, ''), nullif(title, ''), filename) as text from papers")
def s6(spark, d):
    p = table(spark, d, "papers", "paper_id", "abstract", "title", "filename")
    return p.select("paper_id", F.coalesce(F.nullif("abstract", F.lit("")), F.nullif("title", F.lit("")), "filename").alias("text"))


@add("s8_counts_coerced", "select property_id, coalesce(cast(trunc(try_cast(value as double)) as bigint), 0) as n from alloy_properties")
def s8(spark, d):
    return table(spark, d, "alloy_properties", "property_id", "value").select("property_id", F.coalesce(F.col("value").try_cast("double").cast("long"), F.lit(0)).alias("n"))


@add("s9_material_lists", "select distinct material_id, trim(n) as name from (select material_id, unnest(string_split(canonical_name || coalesce('; ' || other_names, ''), ';')) as n from materials_ref)")
def s9(spark, d):
    m = table(spark, d, "materials_ref", "material_id", "canonical_name", "other_names")
    names = F.split(F.concat("canonical_name", F.coalesce(F.concat(F.lit("; "), "other_names"), F.lit(""))), ";")
    return m.select("material_id", F.explode(names).alias("n")).select("material_id", F.trim("n").alias("name")).distinct()


@add("s13_blank_line_split", "select doc_id, trim(p, ' ') as part from (select doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) as p from documents where text is not null) where trim(p, ' ') <> ''")
def s13(spark, d):
    parts = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(F.split("text", r"\n[ \t]*\n")).alias("p"))
    return parts.select("doc_id", F.trim("p").alias("part")).where("part <> ''")


@add("s14_latest_rows", "select paper_id, filename from papers order by paper_id desc limit 100")
def s14(spark, d):
    return table(spark, d, "papers", "paper_id", "filename").orderBy(F.desc("paper_id")).limit(100)




@add("x9_process_flags", "select page_id, concat_ws(',', " + ", ".join(f"case when {_contained('text', w)} > 0 then '{n}' end" for n, w in vo.PROCESSES.items()) + ") as flags from pages_text")
def p9(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").select("page_id", tx.flags(F.col("text"), vo.PROCESSES).alias("flags"))


_NU = r"([0-9]+(?:\.[0-9]+)?) (mm/s|J/mm3|MPa|kHz|nm|W|K|%|HV)"


_NUM = "try_cast(regexp_extract(replace(regexp_replace(regexp_replace(trim(value), '^[~<>≈±=]+\\s*', ''), '\\s*[x×]\\s*10\\^?', 'e', 'g'), ',', ''), '^(-?[0-9]+(?:\\.[0-9]+)?(?:e-?[0-9]+)?)', 1) as double)"


@add("x11_safe_numbers", f"select property_id, {_NUM} as number from alloy_properties")
def p11(spark, d):
    return table(spark, d, "alloy_properties", "property_id", "value").select("property_id", tx.safe_number(F.col("value")).alias("number"))




@add("x13_quantity_labels", "select item_id, replace(physical_quantity, '_', ' ') as label from facts where physical_quantity in (select physical_quantity from quantity_units)")
def p13(spark, d):
    dim = table(spark, d, "quantity_units", "physical_quantity").select("physical_quantity", F.regexp_replace("physical_quantity", "_", " ").alias("label"))
    return table(spark, d, "facts", "item_id", "physical_quantity").join(small(dim), "physical_quantity").select("item_id", "label")




@add("x16_keyword_cooccurrence", f"select page_id, least({_contained('text', vo.DEFECT_WORDS)} / 1.5, 1.0) as score from pages_text")
def p16(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").select("page_id", tx.keyword_score(F.col("text"), vo.DEFECT_WORDS).alias("score"))


@add("x30_categorise", f"select distinct material, method, {_case('material', vo.MATERIAL_CLASSES, 'other')} as material_class, {_case('method', vo.METHOD_CLASSES, 'other')} as method_class from facts")
def p30(spark, d):
    f = table(spark, d, "facts", "material", "method").distinct()
    return f.select("material", "method", tx.first_class(F.col("material"), vo.MATERIAL_CLASSES, "other").alias("material_class"), tx.first_class(F.col("method"), vo.METHOD_CLASSES, "other").alias("method_class"))


@add("x37_math_tokens", "select doc_id, len(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '\\\\([a-z]+)', '\\1', 'g'), '[{}_^=]', ' ', 'g'), '[a-z0-9]+'))) as words from documents where text is not null")
def p37(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.size(tx.word_set(F.col("text"))).alias("words"))


_CLAIM = r"(?:The|the) ([a-z]+ [a-z]+) (reduces|increases|controls|governs|limits) (?:the |every )?([a-z]+ [a-z]+)"


_COMP = r"([A-Z][a-z]?)([0-9]+(?:\.[0-9]+)?)"


@add("x51_composition", f"select material_id, e, try_cast(n as double) as amount from (select material_id, unnest(regexp_extract_all(canonical_name, '{_COMP}', 1)) as e, unnest(regexp_extract_all(canonical_name, '{_COMP}', 2)) as n from materials_ref)")
def p51(spark, d):
    z = F.arrays_zip(F.regexp_extract_all("canonical_name", F.lit(_COMP), 1).alias("e"), F.regexp_extract_all("canonical_name", F.lit(_COMP), 2).alias("n"))
    return table(spark, d, "materials_ref", "material_id", "canonical_name").select("material_id", F.explode(z).alias("z")).select("material_id", "z.e", F.col("z.n").try_cast("double").alias("amount"))


_W3 = r"[a-z-]+ (?:grain|pore|crack) [a-z-]+"


@add("x57_equal_width_bins", "select item_id, cast(least(floor((confidence - lo) / ((hi - lo) / 5)), 4) as int) as bin from (select distinct item_id, confidence from facts where confidence is not null), (select min(confidence) as lo, max(confidence) as hi from facts)")
def p57(spark, d):
    from lodestone.operators.ranking import equal_width_bins

    return equal_width_bins(table(spark, d, "facts", "item_id", "confidence").where("confidence is not null").distinct(), "confidence", 5, "bin").select("item_id", "bin")


@add("x64_table_likeness", "select page_id, len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[0-9]+')) > 3)) > 0 as table_like from pages_text where text is not null")
def p64(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", F.exists(F.split("text", "\n"), lambda x: F.regexp_count(x, F.lit("[0-9]+")) > 3).alias("table_like"))


_KW = ["laser", "grain", "stress"]


@add("x72_keyword_density", f"select page_id, round(case when len(regexp_extract_all(lower(text), '[a-z]+')) = 0 then 0 else 100.0 * ({_contained('text', _KW)} / 3.0) * ({_contained('text', _KW)} / len(regexp_extract_all(lower(text), '[a-z]+'))) end, 9) as density from pages_text where text is not null")
def p72(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", F.round(tx.keyword_density(F.col("text"), _KW), 9).alias("density"))


_NC = r"(.{0,30}?)([0-9]+(?:\.[0-9]+)?) (J/mm3|HV|MPa|K|nm)"


@add("x56_letter_alias", "select feed, '[' || case when rn <= 26 then chr((64 + rn)::int) else rn::varchar end || ']' as alias from (select feed, row_number() over (order by feed) as rn from feeds)")
def x56(spark, d):
    from lodestone.operators.ranking import letter_alias

    return letter_alias(table(spark, d, "feeds", "feed"), "feed", "alias")


QUERIES, ORACLE = C.queries, C.oracle
