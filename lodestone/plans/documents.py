"""Pages, tables, phrases, fields and labels as queries: further rows of sections 2.1, 2.3, 2.4 and 2.6."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vocabulary as vo
from lodestone.operators.chunking import chunked
from lodestone.operators.ranking import ranked
from lodestone.plans.aggregates import _E, properties, values
from lodestone.plans.extraction import _contained, _q
from lodestone.plans.registry import Catalogue, sig, sig_sql
from lodestone.plans.scalars import x39
from lodestone.session import shared_dir, table
from lodestone.sources import readers

C = Catalogue()
add = C.add
_LINES = "string_split(replace({}, chr(13), ''), chr(10))"


def _split(c):
    return F.split(F.regexp_replace(c, "\r", ""), "\n")


@add("s4_raw_pages", "select page_id, filename, page_num, coalesce(text, '') as text from pages_text")
def s4(spark, d):
    return table(spark, d, "pages_text", "page_id", "filename", "page_num", F.coalesce("text", F.lit("")).alias("text"))


_KIND = "case when regexp_matches(l, '^#{1,6} ') or regexp_matches(l, '^([0-9]+\\.?)+ +[A-Z]') then 'heading' when regexp_matches(l, '^\\s*([-*+]|[0-9]+[.)]) ') then 'list' when length(l) - length(replace(l, '|', '')) >= 2 then 'table' when trim(l) = '' then 'blank' else 'text' end"


@add("s5_layout_lines", f"select page_id, i as line, {_KIND} as kind, l as text from (select page_id, i, x[i] as l from (select page_id, x, unnest(range(1, len(x) + 1)) as i from (select page_id, {_LINES.format('text')} as x from pages_text where text is not null)))")
def s5(spark, d):
    """The layout of a page given as text or markdown: each line with its place and kind."""
    p = table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", F.posexplode(_split("text")).alias("i", "text"))
    t = F.col("text")
    kind = F.when(t.rlike("^#{1,6} ") | t.rlike(r"^([0-9]+\.?)+ +[A-Z]"), "heading").when(t.rlike(r"^\s*([-*+]|[0-9]+[.)]) "), "list").when(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 2, "table").when(F.trim(t) == "", "blank").otherwise("text")
    return p.select("page_id", (F.col("i") + 1).cast("long").alias("line"), kind.alias("kind"), "text")


@add("s9_material_lines", "select distinct 'm1' as model, doc_source as doc, trim(material) as material from facts where regexp_matches(doc_source, '^\\S+\\.pdf$') and trim(material) <> '' and not regexp_matches(material, '[,\"\\r\\n]')")
def s9(spark, d):
    """Materials written as lines ``name.pdf: a, b`` and read back by the reader of such files."""
    f = table(spark, d, "facts", F.col("doc_source").alias("doc"), F.trim("material").alias("material")).where(F.col("doc").rlike(r"^\S+\.pdf$") & (F.col("material") != "") & ~F.col("material").rlike('[,"\r\n]')).distinct()
    # a document's materials are written in lines of a bounded number of names
    lines = f.withColumn("part", F.pmod(F.xxhash64("material"), F.lit(16))).groupBy("doc", "part").agg(F.array_join(F.array_sort(F.collect_list("material")), ", ").alias("m"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.select(F.concat("doc", F.lit(": "), "m")).write.text(path)
    return readers.material_lines(spark, path, "m1")


_STATS = "format('{{}}: n={{}}, min={{}}, max={{}}', '{c}', count({c}), min({c}), max({c}))"


@add("s10_dataset_documents", "select 'global' as kind, 'nations: ' || count(*) || ' rows, 2 numeric columns' as text from nation union all select 'column', " + _STATS.format(c="n_nationkey") + " from nation union all select 'column', " + _STATS.format(c="n_regionkey") + " from nation union all select 'row', format('n_nationkey={}, n_name={}, n_regionkey={}', n_nationkey, n_name, n_regionkey) from nation where (select count(*) from nation) <= 100")
def s10(spark, d):
    """A dataset as texts: one for the whole, one per numeric column, and one per row if there are at most a hundred."""
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    numeric = ["n_nationkey", "n_regionkey"]
    s = n.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in numeric for f in (F.count, F.min, F.max)])
    whole = s.select(F.lit("global").alias("kind"), F.format_string("nations: %d rows, 2 numeric columns", "rows").alias("text"))
    columns = [s.select(F.lit("column").alias("kind"), F.format_string(f"{c}: n=%s, min=%s, max=%s", *[F.col(f"{f}_{c}").cast("string") for f in ("count", "min", "max")]).alias("text")) for c in numeric]
    rows = n.join(F.broadcast(s.where("rows <= 100").select("rows"))).select(F.lit("row").alias("kind"), F.format_string("n_nationkey=%s, n_name=%s, n_regionkey=%s", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("text"))
    return whole.unionByName(columns[0]).unionByName(columns[1]).unionByName(rows)


@add("x40_section_chunks")
def x40(spark, d):
    """The sections of each page cut at separators, with the size and overlap of their kind."""
    return chunked(x39(spark, d), "page_id", "section", "body", vo.SECTION_SIZES)


_VOL, _YEAR = r"(?i)\bvol(?:ume|\.)?\s*([0-9]+)", r"((?:19|20)[0-9]{2})"


@add("x42_bibliography", f"select paper_id, title, len(list_filter(string_split(coalesce(authors, ''), ';'), lambda x: trim(x) <> '')) as authors, trim(string_split(authors, ';')[1]) as first_author, nullif(trim(regexp_extract(subject, '^(.*?)[, ]*(?:(?i:vol(?:ume|\\.)?) *[0-9]+)?[, ]*\\(?(?:19|20)[0-9]{{2}}\\)?$', 1)), '') as journal, nullif(regexp_extract(subject, '{_VOL}', 1), '') as volume, coalesce(nullif(regexp_extract(subject, '{_YEAR}', 1), ''), nullif(regexp_extract(year_guess, '{_YEAR}', 1), '')) as year, pages, nullif(regexp_extract(doi_guess, '(?i)10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+'), '') as doi from papers")
def x42(spark, d):
    p = table(spark, d, "papers", "paper_id", "title", "authors", "subject", "year_guess", "pages", "doi_guess")
    names = F.split(F.coalesce("authors", F.lit("")), ";")
    journal = F.nullif(F.trim(F.regexp_extract("subject", r"^(.*?)[, ]*(?:(?i:vol(?:ume|\.)?) *[0-9]+)?[, ]*\(?(?:19|20)[0-9]{2}\)?$", 1)), F.lit(""))
    return p.select("paper_id", "title", F.size(F.filter(names, lambda x: F.trim(x) != "")).alias("authors"), F.trim(F.get(F.split("authors", ";"), F.lit(0))).alias("first_author"), journal.alias("journal"), tx.first_match(F.col("subject"), _VOL, 1).alias("volume"), F.coalesce(tx.first_match(F.col("subject"), _YEAR, 1), tx.first_match(F.col("year_guess"), _YEAR, 1)).alias("year"), "pages", tx.doi_guess(F.col("doi_guess")).alias("doi"))


@add("x45_extractive_summary", "select page_id, substring(array_to_string(list_transform(list_reverse_sort(list_transform(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 15 and length(x) < 250), lambda x: {'k': " + _contained("x", vo.SUMMARY_WORDS) + ", 's': x}))[1:3], lambda y: y.s), ' '), 1, 220) as summary from pages_text where text is not null")
def x45(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", tx.extractive_summary(F.col("text"), vo.SUMMARY_WORDS).alias("summary"))


_CELLS = "select page_id, line, unnest(range(1, len(c) + 1)) as col, c from (select page_id, i as line, case when contains(x[i], '|') then string_split(trim(trim(x[i]), '|'), '|') else regexp_split_to_array(trim(x[i]), ' {2,}|\\t') end as c from (select page_id, x, unnest(range(1, len(x) + 1)) as i from (select page_id, " + _LINES.format("text") + " as x from pages_text where text is not null)) where length(x[i]) - length(replace(x[i], '|', '')) >= 2 or len(regexp_split_to_array(trim(x[i]), ' {2,}|\\t')) >= 3)"


@add("x49_table_cells", f"select page_id, line, col, trim(c[col]) as cell from ({_CELLS}) where not regexp_matches(trim(c[col]), '^[-: ]*$')")
def x49(spark, d):
    """Cells of lines that are rows of a table: with at least two bars, or three columns apart by two blanks or a tab."""
    p = table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", F.posexplode(_split("text")).alias("i", "l"))
    plain = F.split(F.trim("l"), r" {2,}|\t")
    bars = F.length("l") - F.length(F.replace("l", F.lit("|"), F.lit("")))
    cells = F.when(F.col("l").contains("|"), F.split(F.regexp_replace(F.trim("l"), r"^\|+|\|+$", ""), r"\|")).otherwise(plain)
    c = p.where((bars >= 2) | (F.size(plain) >= 3)).select("page_id", (F.col("i") + 1).cast("long").alias("line"), F.posexplode(cells).alias("j", "cell"))
    return c.select("page_id", "line", (F.col("j") + 1).cast("long").alias("col"), F.trim("cell").alias("cell")).where(~F.col("cell").rlike("^[-: ]*$"))


#: Templates of properties: inline, categorical and comparative; the groups are the name and the value.
_PROPERTIES = {
    "inline": r"([a-z]+ [a-z]+) (?:of|reached|was|is) ([0-9]+(?:\.[0-9]+)? ?(?:W|kW|MPa|GPa|K|nm|µm|%|HV|mm/s|kHz|J/mm3)?)", "category": r"((?i:heat source|laser|beam|scan)) ((?i:gaussian|uniform|ring|continuous|pulsed|fibre|fiber|strategy|pattern))",
    "comparison": r"([a-z]+ [a-z]+) (?:is|was|shows|exhibits) (?:approximately )?([0-9.]+ ?%? (?:higher|lower|greater|less) than [a-z]+ [a-z]+)",
}


@add("x50_properties", " union all ".join(f"select page_id, '{n}' as kind, unnest(regexp_extract_all(text, '{_q(p)}', 1)) as name, unnest(regexp_extract_all(text, '{_q(p)}', 2)) as value from pages_text where text is not null" for n, p in _PROPERTIES.items()))
def x50(spark, d):
    pairs = {n: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("name"), F.regexp_extract_all("text", F.lit(p), 2).alias("value")) for n, p in _PROPERTIES.items()}
    found = tx.tagged(pairs, "kind", "x")
    return table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", F.explode(found).alias("f")).select("page_id", "f.kind", "f.x.name", "f.x.value")


#: Words around which phrases are taken.
_PHRASE_WORDS = ["power", "speed", "scan", "energy", "density", "beam", "pulse", "laser", "grain", "dendrite", "precipitate", "phase", "texture", "boundary", "defect", "interface", "solidification", "simulation"]
_W = "regexp_extract_all(lower(content), '[a-z0-9_-]+')"


@add("x52_keyword_window", f"select chunk_id, unnest(list_sort(list_distinct(list_filter(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] in ({', '.join(repr(x) for x in _PHRASE_WORDS)})), lambda i: array_to_string(w[greatest(1, i - 1):i + 1], ' ')), lambda p: length(p) > 3)))[1:5]) as phrase from (select distinct chunk_id, {_W} as w from chunks where content is not null)")
def x52(spark, d):
    """The first five, in sort order, of the phrases of a word and its neighbours around a keyword."""
    c = table(spark, d, "chunks", "chunk_id", "content").where("content is not null").select("chunk_id", F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_-]+"), 0).alias("w")).distinct()
    at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(_PHRASE_WORDS), i + 1)), lambda i: i.isNotNull())
    phrase = lambda i: F.array_join(F.slice("w", F.greatest(F.lit(1), i - 1), F.when(i > 1, 3).otherwise(2)), " ")
    kept = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(at, phrase), lambda p: F.length(p) > 3))), 1, 5)
    return c.select("chunk_id", F.explode(kept).alias("phrase"))


_PHRASES = ["[a-z]+ (?:structure|pattern|boundary|layer|region|zone)", "(?:columnar|equiaxed|fine|coarse) grains?", "(?:laser|scan|melt|beam) [a-z]+", "[a-z]+ (?:strength|hardness|conductivity|density|energy)"]


@add("x54_phrase_concepts", "select distinct paper_id, c from (" + " union all ".join(f"select paper_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '{p}')) as c from papers" for p in _PHRASES) + ") where len(string_split(c, ' ')) >= 2")
def x54(spark, d):
    t = F.lower(F.concat_ws(" ", "title", "abstract"))
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), 0) for p in _PHRASES])))
    return table(spark, d, "papers", "paper_id", "title", "abstract").select("paper_id", F.explode(found).alias("c")).where(F.size(F.split("c", " ")) >= 2)


@add("x63_strict_extractor", "select distinct value_id, value, unit, substring(context, greatest(1, strpos(lower(context), 'power') - 80), strpos(lower(context), 'power') + 80 - greatest(1, strpos(lower(context), 'power') - 80)) as around from extracted_values where value <> 0 and regexp_matches(upper(unit), '^(W|KW|MW)$') and (contains(lower(context), 'laser') or len(list_intersect(list_distinct(regexp_extract_all(lower(context), '[a-z]{4,}')), list_distinct(regexp_extract_all(lower(query_text), '[a-z]{4,}')))) > 0) and regexp_matches(lower(context), '(?:laser|beam|output|average|incident)? ?power')")
def x63(spark, d):
    """Non-zero powers in an allowed unit whose context speaks of a power and of the laser or the query, with what is around."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0))
    low = F.lower("context")
    asked = F.coalesce(F.size(F.array_intersect(words(F.col("context")), words(F.col("query_text")))) > 0, F.lit(False))
    e = table(spark, d, "extracted_values", "value_id", "value", "unit", "context", "query_text").where((F.col("value") != 0) & F.upper("unit").rlike("^(W|KW|MW)$") & (low.contains("laser") | asked) & low.rlike("(?:laser|beam|output|average|incident)? ?power"))
    return e.select("value_id", "value", "unit", tx.context_window(F.col("context"), F.instr(low, "power"), 80, 80).alias("around")).distinct()


@add("x67_nearest_concept", "with c as (select label, i, avg(v) as m from (select label, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as v from embeddings) group by 1, 2), l as (select label, list(m order by i) as m from c group by 1), s as (select vec_id, l.label, round(list_cosine_similarity(e.embedding::double[], l.m), 9) as similarity from embeddings e, l) select vec_id, concept, similarity from (select vec_id, label as concept, similarity, row_number() over (partition by vec_id order by similarity desc, label) as rn from s) where rn = 1")
def x67(spark, d):
    """Each vector unified with the concept of the nearest centroid; the concepts are few and looked through in the row."""
    from lodestone.operators.vectors import dot

    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    l = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m")).agg(F.collect_list(F.struct("label", "m")).alias("all"))  # noqa: E741
    near = F.transform("all", lambda x: F.struct(F.round(dot(F.col("embedding"), x["m"]) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(x["m"], x["m"])), 9).alias("s"), (-x["label"]).alias("k")))
    b = e.join(F.broadcast(l)).select("vec_id", F.array_max(near).alias("b"))
    return b.select("vec_id", (-F.col("b.k")).alias("concept"), F.col("b.s").alias("similarity"))


_SOUGHT = ["results", "discussion"]


@add("x71_fuzzy_section", f"select section_title, score from (select distinct section_title, case when contains(lower(section_title), 'results and discussion') or contains('results and discussion', lower(section_title)) then 1.0 else len(list_intersect(list_distinct(regexp_extract_all(lower(section_title), '[a-z]+')), ['{_SOUGHT[0]}', '{_SOUGHT[1]}'])) / 2.0 end as score from facts where section_title <> '') where score >= 0.5")
def x71(spark, d):
    """Sections found for a title by containment or by the share of its words."""
    s = F.lower("section_title")
    words = F.array_distinct(F.regexp_extract_all(s, F.lit("[a-z]+"), 0))
    score = F.when(s.contains("results and discussion") | F.lit("results and discussion").contains(s), 1.0).otherwise(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in _SOUGHT]))) / 2.0)
    return table(spark, d, "facts", "section_title").where("section_title <> ''").distinct().select("section_title", score.alias("score")).where("score >= 0.5")


@add("f7_min_frequency_terms", "with n as (select count(*) as papers from papers), t as (select material, count(distinct doc_source) as n from facts where material is not null group by 1) select material, t.n from t, n where t.n >= case when papers <= 15 then 1 when papers <= 30 then 2 else 3 end and len(string_split(trim(material), ' ')) >= case when papers <= 15 then 1 else 2 end")
def f7(spark, d):
    """Terms that enough documents hold and that have enough words; both limits follow the number of papers."""
    n = table(spark, d, "papers", "paper_id").agg(F.count(F.lit(1)).alias("papers"))
    t = table(spark, d, "facts", "material", "doc_source").where("material is not null").groupBy("material").agg(F.count_distinct("doc_source").alias("n"))
    p = F.col("papers")
    j = t.join(F.broadcast(n)).where((F.col("n") >= F.when(p <= 15, 1).when(p <= 30, 2).otherwise(3)) & (F.size(F.split(F.trim("material"), " ")) >= F.when(p <= 15, 1).otherwise(2)))
    return j.select("material", "n")


@add("g34_material_features", f"with e as (select distinct value_id, material, method_origin as model, doc from (select *, doc_name as doc from extracted_values) where material is not null), m as (select distinct model from e where model is not null), c as (select material, model, count(*) as n from e where model is not null group by 1, 2), t as (select material, count(distinct doc) as docs from e group by 1) select t.material, list(round(ln(1 + coalesce(c.n, 0)), 9) order by m.model) as counts, any_value(round(ln(1 + docs), 9)) as log_docs from t cross join m left join c on t.material = c.material and m.model = c.model group by 1")
def g34(spark, d):
    """log1p of a material's count per model, in the order of the models' names, and of its documents."""
    e = values(spark, d, "value_id", "material", "method_origin", "doc").where("material is not null")
    models = e.where("method_origin is not null").select("method_origin").distinct().agg(F.array_sort(F.collect_list("method_origin")).alias("models"))  # a closed list
    c = e.where("method_origin is not null").groupBy("material", "method_origin").agg(F.count(F.lit(1)).alias("n")).groupBy("material").agg(F.map_from_entries(F.collect_list(F.struct("method_origin", "n"))).alias("c"))
    t = e.groupBy("material").agg(F.round(F.log1p(F.count_distinct("doc")), 9).alias("log_docs"))
    j = t.join(c, "material", "left").join(F.broadcast(models))
    return j.select("material", F.transform("models", lambda m: F.round(F.log1p(F.coalesce(F.try_element_at("c", m), F.lit(0))), 9)).alias("counts"), "log_docs")


_PRED = "select a.vec_id as field, unnest(range(0, len(a.embedding))) as i, unnest(a.embedding)::double as p, unnest(b.embedding)::double as t from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0"
_SSIM = "((2 * avg(p) * avg(t) + 1e-4) * (2 * covar_pop(p, t) + 9e-4)) / ((avg(p) * avg(p) + avg(t) * avg(t) + 1e-4) * (var_pop(p) + var_pop(t) + 9e-4))"


@add("g38_field_errors", f"select field, {sig_sql('sqrt(avg((p - t) * (p - t)))', 6)} as rmse, {sig_sql('avg(abs(p - t))', 6)} as mae, {sig_sql('20 * log10((max(t) - min(t)) / sqrt(avg((p - t) * (p - t))))', 5)} as psnr, {sig_sql(_SSIM, 5)} as ssim from ({_PRED}) group by 1 having avg((p - t) * (p - t)) > 0")
def g38(spark, d):
    """Errors of a predicted field against the true one, the next vector of the table, cell by cell: root mean square, mean,
    peak signal to noise, structural similarity of the whole field."""
    e = table(spark, d, "embeddings", "vec_id", "embedding").where("embedding is not null")
    a = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("field"), "embedding")
    b = e.select((F.col("vec_id") - 1).alias("field"), F.col("embedding").alias("truth"))
    c = a.join(b, "field").select("field", F.explode(F.arrays_zip("embedding", "truth")).alias("z")).select("field", F.col("z.embedding").cast("double").alias("p"), F.col("z.truth").cast("double").alias("t"))
    mse = F.avg((F.col("p") - F.col("t")) * (F.col("p") - F.col("t")))
    mp, mt = F.avg("p"), F.avg("t")
    ssim = ((2 * mp * mt + 1e-4) * (2 * F.covar_pop("p", "t") + 9e-4)) / ((mp * mp + mt * mt + 1e-4) * (F.var_pop("p") + F.var_pop("t") + 9e-4))
    g = c.groupBy("field").agg(F.sqrt(mse).alias("rmse"), F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"), (20 * F.log10((F.max("t") - F.min("t")) / F.sqrt(mse))).alias("psnr"), ssim.alias("ssim")).where("rmse > 0")
    return g.select("field", sig("rmse", 6).alias("rmse"), sig("mae", 6).alias("mae"), sig("psnr", 5).alias("psnr"), sig("ssim", 5).alias("ssim"))


@add("g42_short_labels", "select filename, 'Doc ' || row_number() over (order by paper_id) as label, coalesce(nullif(trim(title), ''), 'Doc ' || row_number() over (order by paper_id)) as shown from papers")
def g42(spark, d):
    """Labels in the order of registration, and what is shown: a title takes the place of the label."""
    r = ranked(table(spark, d, "papers", "paper_id", "filename", "title"), [], [F.col("paper_id")], "n")
    label = F.concat(F.lit("Doc "), F.col("n"))
    return r.select("filename", label.alias("label"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), label).alias("shown"))


@add("g45_property_values", "select distinct property_id, property_name, alloy_system, source_citation as doc, normalized_value as value, unit from alloy_properties where normalized_value is not null and property_name is not null")
def g45(spark, d):
    """The long table of property values."""
    return properties(spark, d, "property_id", "property_name", "alloy_system", "doc", "normalized_value", "unit").where("normalized_value is not null and property_name is not null").withColumnRenamed("normalized_value", "value")


@add("g53_mode_profile", f"with p as (select parameter_name from {_E} where parameter_name is not null group by 1 order by count(*) desc, parameter_name limit 5), m as (select parameter_name, max(abs(value)) as big from {_E} where value is not null group by 1), c as (select phase, parameter_name, avg(value) as mean from {_E} where value is not null and phase is not null group by 1, 2), h as (select distinct phase from {_E} where phase is not null and value is not null) select h.phase, p.parameter_name, {sig_sql('coalesce(c.mean / greatest(1, m.big), 0)')} as cell from h cross join p left join m using (parameter_name) left join c on c.phase = h.phase and c.parameter_name = p.parameter_name")
def g53(spark, d):
    """Each phase against the five most frequent parameters; what is missing is 0."""
    e = values(spark, d, "value_id", "phase", "parameter_name", "value")
    top = e.where("parameter_name is not null").groupBy("parameter_name").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("big")).orderBy(F.desc("n"), "parameter_name").limit(5)
    v = e.where("value is not null and phase is not null")
    cells = v.join(F.broadcast(top), "parameter_name").groupBy("phase", "parameter_name").agg(F.avg("value").alias("mean"))
    grid = v.select("phase").distinct().join(F.broadcast(top))  # phases and parameters are closed lists
    out = grid.join(cells, ["phase", "parameter_name"], "left")
    return out.select("phase", "parameter_name", sig(F.coalesce(F.col("mean") / F.greatest(F.lit(1.0), F.col("big")), F.lit(0.0))).alias("cell"))


QUERIES, ORACLE = C.queries, C.oracle
