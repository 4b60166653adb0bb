"""Joins on facts, verification, document trees and scoring as queries (sections 2.4, 2.5 and 2.9 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import facts as fo
from lodestone.operators.ranking import ranked, top_per_key
from lodestone.plans.aggregates import _E, _F, SALIENCE_COLUMNS, SALIENCE_SQL, facts, salience, values
from lodestone.plans.registry import Catalogue, sig, sig_sql
from lodestone.session import cut, small, table

C = Catalogue()
add = C.add

#: The question of the retrieval queries, a parameter of each operator: its words and its weights.
QUESTION = ["laser", "power", "porosity", "corvanil", "612", "grain"]
W_META, W_KEYWORD = 0.8, 0.5
_ASKED = "[" + ", ".join(f"'{w}'" for w in QUESTION) + "]"


@add("j1_power_speed", f"select p.doc, p.material, p.value as power, s.value as speed from (select distinct doc, material, value from {_E} where q = 'laser_power' and value is not null) p join (select distinct doc, material, value from {_E} where q = 'scan_speed' and value is not null) s on p.doc = s.doc and p.material is not distinct from s.material")
def j1_rows(spark, d):
    """The distinct powers and speeds of one document and material; missing materials match."""
    e = table(spark, d, "extracted_values", F.col("doc_name").alias("doc"), "material", "physical_quantity", "value").where("value is not null")
    p = e.where("physical_quantity = 'laser_power'").select("doc", "material", F.col("value").alias("power")).distinct()
    s = e.where("physical_quantity = 'scan_speed'").select(F.col("doc").alias("d2"), F.col("material").alias("m2"), F.col("value").alias("speed")).distinct()
    return p.join(s, (F.col("doc") == F.col("d2")) & F.col("material").eqNullSafe(F.col("m2"))).select("doc", "material", "power", "speed")


_MEAN_OF = "select material, avg(value) as m, count(*) as n from {e} where q = '{q}' and value is not null group by 1"


@add("j2_material_means", f"select p.material, {sig_sql('p.m')} as power, p.n as power_n, {sig_sql('s.m')} as speed, s.n as speed_n from ({_MEAN_OF.format(e=_E, q='laser_power')}) p join ({_MEAN_OF.format(e=_E, q='scan_speed')}) s on p.material = s.material")
def j2(spark, d):
    e = values(spark, d, "value_id", "material", "q", "value").where("value is not null")
    of = lambda q, m, n: e.where(F.col("q") == q).groupBy("material").agg(sig(F.avg("value")).alias(m), F.count(F.lit(1)).alias(n))
    return of("laser_power", "power", "power_n").join(of("scan_speed", "speed", "speed_n"), "material")


@add("j5_contradicting_documents", f"with m as (select q, doc, avg(value) as mean from {_F} where q is not null and value is not null group by 1, 2 having avg(value) > 0) select a.q, count(*) as pairs, {sig_sql('max(greatest(a.mean / b.mean, b.mean / a.mean))')} as worst from m a join m b on a.q = b.q and a.doc is distinct from b.doc and a.mean > 2 * b.mean group by 1")
def j5(spark, d):
    """Number of pairs of documents whose means of a quantity differ by more than twice, and the largest ratio; the pairs
    are counted from both of their documents."""
    c = fo.contradiction_pairs(facts(spark, d, "item_id", "q", "doc", "value"), "q", "doc", "value")
    return c.groupBy("q").agg((F.sum("contradicting") / 2).cast("long").alias("pairs"), sig(F.max("ratio")).alias("worst"))


@add("j13_candidates_by_pattern", f"select value_id, " + " + ".join(f"coalesce(regexp_matches(lower(context), '{w}')::int, 0)" for w in ("laser", "power", "speed", "fluence", "wavelength", "duration", "repetition", "spot", "yield", "grain", "poros", "dens")) + " as hits from (select distinct value_id, context from extracted_values)")
def j13(spark, d):
    """Every candidate against every pattern, inside the candidate's row."""
    words = ("laser", "power", "speed", "fluence", "wavelength", "duration", "repetition", "spot", "yield", "grain", "poros", "dens")
    return table(spark, d, "extracted_values", "value_id", "context").distinct().select("value_id", tx.contained(F.col("context"), list(words)).cast("long").alias("hits"))


_WRITTEN = "case when value is not null and (value = 0 or abs(value) between 0.001 and 1000000) then regexp_replace(value::varchar, '\\.0$', '') end"
_PAGE = "select filename, page_num, min(text) as text from pages_text where text <> '' group by 1, 2"
_TERMS = "len(list_filter(map_values(variables_defined), lambda v: v <> '' and contains(lower(text), lower(v)))) > 0"
_VERIFIED = f"case when text is null then confidence * 0.5 when {_WRITTEN} is not null and contains(text, {_WRITTEN}) then least(1.0, confidence + 0.1) when parameter_name <> '' and contains(lower(substring(text, 1, 3000)), lower(parameter_name)) then least(1.0, confidence + 0.05) when item_type = 'equation' then case when {_TERMS} then least(1.0, confidence + 0.15) else greatest(0.0, confidence - 0.05) end else greatest(0.0, confidence - 0.3) end"


def _verified(spark, d):
    f = table(spark, d, "facts", "item_id", "item_type", "doc_source", "page", "value", "parameter_name", "confidence", F.map_values("variables_defined").alias("terms")).where("confidence is not null").distinct()
    p = table(spark, d, "pages_text", F.col("filename").alias("doc_source"), F.col("page_num").alias("page"), "text").where("text <> ''").groupBy("doc_source", "page").agg(F.min("text").alias("text"))
    c, v = F.col("confidence"), F.abs("value")
    written = F.when((v == 0) | v.between(0.001, 1000000), F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""))
    named = (F.col("parameter_name") != "") & F.lower(F.substring("text", 1, 3000)).contains(F.lower("parameter_name"))
    terms = F.exists("terms", lambda x: (x != "") & F.lower("text").contains(F.lower(x)))
    equation = F.when(F.coalesce(terms, F.lit(False)), F.least(F.lit(1.0), c + 0.15)).otherwise(F.greatest(F.lit(0.0), c - 0.05))
    out = F.when(F.col("text").isNull(), c * 0.5).when(F.col("text").contains(written), F.least(F.lit(1.0), c + 0.1)).when(named, F.least(F.lit(1.0), c + 0.05)).when(F.col("item_type") == "equation", equation).otherwise(F.greatest(F.lit(0.0), c - 0.3))
    return f.join(p, ["doc_source", "page"], "left").select("item_id", "doc_source", "page", F.round(out, 9).alias("confidence"))


_VERIFY_SQL = f"from (select distinct item_id, item_type, doc_source, page, value, parameter_name, confidence, variables_defined from facts where confidence is not null) f left join ({_PAGE}) p on f.doc_source = p.filename and f.page = p.page_num"


@add("j14_citation_verification", f"select item_id, doc_source, page, round({_VERIFIED}, 9) as confidence {_VERIFY_SQL}")
def j14(spark, d):
    """Confidence after looking for the value, the parameter or an equation's variables on the cited page."""
    return _verified(spark, d)


@add("r14_verified_items", f"select item_id, confidence from (select item_id, round({_VERIFIED}, 9) as confidence {_VERIFY_SQL}) where confidence >= 0.55")
def r14(spark, d):
    """The items that hold after verification."""
    return _verified(spark, d).where("confidence >= 0.55").select("item_id", "confidence")


@add("j18_first_chunk", "select e.value_id, c.chunk_id, e.value, coalesce(nullif(e.unit, ''), 'unknown') as unit, contains(c.content, regexp_replace(e.value::varchar, '\\.0$', '')) as seen from (select distinct value_id, doc_name, value, unit from extracted_values where value is null or value = 0 or abs(value) between 0.001 and 1000000) e join (select source, chunk_id, content from (select *, row_number() over (partition by source order by chunk_id) as rn from chunks) where rn = 1) c on e.doc_name = c.source")
def j18(spark, d):
    """Candidates with the first chunk of their document and whether it states their value; others drop out."""
    c = table(spark, d, "chunks", F.col("source").alias("doc_name"), "chunk_id", "content").groupBy("doc_name").agg(F.min(F.struct("chunk_id", "content")).alias("c"))
    e = table(spark, d, "extracted_values", "value_id", "doc_name", "value", "unit").distinct().where("value is null or value = 0 or abs(value) between 0.001 and 1000000")
    written = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    return e.join(c, "doc_name").select("value_id", "c.chunk_id", "value", F.coalesce(F.nullif("unit", F.lit("")), F.lit("unknown")).alias("unit"), F.col("c.content").contains(written).alias("seen"))


_FIELDS = ["title", "authors", "subject", "keywords", "abstract", "year_guess", "doi_guess"]
_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"
_SCORES = f"with m as (select doc, count(distinct w) as meta, count(distinct q) filter (q in ('laser_power', 'porosity') and value is not null) as targets from (select doc_source as doc, physical_quantity as q, value, unnest(list_intersect(list_distinct(regexp_extract_all(lower(concat_ws(' ', material, method)), '[a-z0-9]+')), {_ASKED})) as w from facts) group by 1), t as (select doc_source as doc, count(distinct physical_quantity) as targets from facts where physical_quantity in ('laser_power', 'porosity') and value is not null group by 1) select p.filename, round(least(1.0, 0.5 * {W_META} * coalesce(m.meta, 0) + 0.02 * {W_META} * ({' + '.join(f'(coalesce({c}, {chr(39)}{chr(39)}) <> {chr(39)}{chr(39)})::int' for c in _FIELDS)}) + 0.3 * {W_KEYWORD} * len(list_intersect({_TOKENS.format('substring(abstract, 1, 2000)')}, {_ASKED})) + {W_META} * coalesce(t.targets, 0)), 9) as score from papers p left join m on p.filename = m.doc left join t on p.filename = t.doc"


def _document_scores(spark, d):
    """Score of each document for the question: words of its materials and methods, filled fields, words of its abstract,
    and the target quantities it has values for."""
    asked = F.array(*[F.lit(w) for w in QUESTION])
    words = lambda c: F.array_intersect(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), asked)
    f = table(spark, d, "facts", F.col("doc_source").alias("filename"), "material", "method", "physical_quantity", "value")
    meta = f.select("filename", F.explode(words(F.concat_ws(" ", "material", "method"))).alias("w")).groupBy("filename").agg(F.count_distinct("w").alias("meta"))
    targets = f.where("physical_quantity in ('laser_power', 'porosity') and value is not null").groupBy("filename").agg(F.count_distinct("physical_quantity").alias("targets"))
    p = table(spark, d, "papers", "filename", *_FIELDS)
    filled = sum(((F.coalesce(c, F.lit("")) != "").cast("int") for c in _FIELDS), F.lit(0))
    summary = F.size(words(F.substring(F.coalesce("abstract", F.lit("")), 1, 2000)))
    j = p.select("filename", filled.alias("filled"), summary.alias("summary")).join(meta, "filename", "left").join(targets, "filename", "left").fillna(0, ["meta", "targets"])
    score = 0.5 * W_META * F.col("meta") + 0.02 * W_META * F.col("filled") + 0.3 * W_KEYWORD * F.col("summary") + W_META * F.col("targets")
    return j.select("filename", F.round(F.least(F.lit(1.0), score), 9).alias("score"))


@add("r1_document_score", _SCORES)
def r1(spark, d):
    return _document_scores(spark, d)


@add("w1_ranked_documents", f"with s as ({_SCORES}) select filename, case when (select max(score) from s) > 0 then score else 0.2 end as score from s order by score desc, filename limit 8")
def w1(spark, d):
    """The eight best documents; if none scores at all, the first eight with 0.2."""
    s = cut(_document_scores(spark, d))
    best = s.agg(F.max("score").alias("most"))
    return s.join(F.broadcast(best)).select("filename", F.when(F.col("most") > 0, F.col("score")).otherwise(0.2).alias("score")).orderBy(F.desc("score"), "filename").limit(8)


_ENTITIES = ["Corvanil", "Nimbrax"]
_CLAIM = "(?:reduces|increases|controls|governs|limits)"


@add("r4_chunk_scores", "with l as (select distinct doc_source as source from facts where " + " or ".join(f"contains(material, '{e}')" for e in _ENTITIES) + "), c as (select distinct chunk_id, source, content from chunks) select chunk_id, round(" + " + ".join(f"0.3 * contains(content, '{e}')::int" for e in _ENTITIES) + f" + {0.2 * len(_ENTITIES)} * (l.source is not null)::int + 0.25 * (" + " + ".join(f"len(regexp_extract_all(content, '{e}[^.]*{_CLAIM}'))" for e in _ENTITIES) + "), 9) as score from c left join l on c.source = l.source where content is not null and (" + " or ".join(f"contains(content, '{e}')" for e in _ENTITIES) + " or l.source is not null)")
def r4(spark, d):
    """Entities in the text, documents linked to any of them (once per entity), and claims about them; zeros drop out."""
    any_of = F.lit(False)
    for e in _ENTITIES:
        any_of = any_of | F.col("material").contains(e)
    linked = table(spark, d, "facts", F.col("doc_source").alias("source"), "material").where(any_of).select("source").distinct().withColumn("linked", F.lit(1))
    c = table(spark, d, "chunks", "chunk_id", "source", "content").where("content is not null").distinct().join(linked, "source", "left").fillna(0, ["linked"])
    s = 0.2 * len(_ENTITIES) * F.col("linked")
    for e in _ENTITIES:
        s = s + 0.3 * F.col("content").contains(e).cast("int") + 0.25 * F.regexp_count("content", F.lit(f"{e}[^.]*{_CLAIM}"))
    return c.select("chunk_id", F.round(s, 9).alias("score")).where("score > 0")


_STEP = "0.6 * case when n > 1 then (t - {s}) / (n - 1) else 0 end + 0.4 * confidence"
_LOOP = "confidence"
for _ in range(5):
    _LOOP = _STEP.format(s=f"({_LOOP})")


@add("r6_diffusion", f"select value_id, round(greatest(0.0, least(1.0, case when n_all >= 5 then {_LOOP} else confidence end)), 9) as score from (select value_id, confidence, sum(confidence) over (partition by doc, page) as t, count(*) over (partition by doc, page) as n, count(*) over () as n_all from {_E} where confidence is not null and doc is not null and page is not null)")
def r6(spark, d):
    """Five rounds of row-normalised diffusion among the values of a page. A group's sum stays what it is, so a round is an
    expression of the row and the groups are aggregated once."""
    e = values(spark, d, "value_id", "doc", "page", "confidence").where("confidence is not null and doc is not null and page is not null")
    t = e.groupBy("doc", "page").agg(F.sum("confidence").alias("t"), F.count(F.lit(1)).alias("n"))
    every = e.agg(F.count(F.lit(1)).alias("n_all"))
    s = F.col("confidence")
    for _ in range(5):
        s = 0.6 * F.when(F.col("n") > 1, (F.col("t") - s) / (F.col("n") - 1)).otherwise(0.0) + 0.4 * F.col("confidence")
    s = F.when(F.col("n_all") >= 5, s).otherwise(F.col("confidence"))
    return e.join(t, ["doc", "page"]).join(F.broadcast(every)).select("value_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 9).alias("score"))


@add("r7_salience", f"select value_id, round({SALIENCE_SQL}, 9) as salience from {_E}")
def r7(spark, d):
    return values(spark, d, "value_id", *SALIENCE_COLUMNS).select("value_id", F.round(salience(), 9).alias("salience"))


#: Weights of the relevance: similarity, entity, unit, position, documents, validation.
_ALPHA, _BETA, _GAMMA, _DELTA, _EPSILON, _ZETA = 0.30, 0.20, 0.15, 0.10, 0.15, 0.10
_OVER = "len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(query_text, '')), '[a-z]{4,}')), list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[a-z]{4,}')))) * 1.0 / greatest(1, len(list_distinct(regexp_extract_all(lower(coalesce(query_text, '')), '[a-z]{4,}'))))"


@add("r8_relevance_penalty", f"with n as (select material, count(distinct doc) as docs from {_E} where material is not null group by 1), a as (select count(distinct doc) as all_docs from {_E}) select value_id, round(greatest(0.0, least(1.0, ({_ALPHA} * ({_OVER}) + {_BETA} * coalesce(contains(lower(query_text), lower(e.material))::int, 0) + {_GAMMA} * case when coalesce(value, 0) = 0 or coalesce(unit, '') = '' then 1.0 else exp(-abs(log10(greatest(value, 1e-9) / 100.0))) end + {_DELTA} * (0.5 + 0.5 * (1.0 - least(1.0, coalesce(page, 1) / 20.0))) + {_EPSILON} * coalesce(n.docs, 0) * 1.0 / greatest(1, all_docs) + {_ZETA} * 0.7) * (0.6 + 0.4 * coalesce(confidence, 0)))), 9) as relevance from {_E} e left join n on e.material = n.material, a")
def r8(spark, d):
    """Similarity (words of the query in the context), entity, unit penalty, position, documents and validation, modulated by
    the confidence of the pattern."""
    e = values(spark, d, "value_id", "doc", "page", "value", "unit", *SALIENCE_COLUMNS)
    n = e.where("material is not null").groupBy("material").agg(F.count_distinct("doc").alias("docs"))
    a = e.agg(F.count_distinct("doc").alias("all_docs"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{4,}"), 0))
    asked = words(F.col("query_text"))
    over = F.size(F.array_intersect(asked, words(F.col("context")))) * 1.0 / F.greatest(F.lit(1), F.size(asked))
    entity = F.coalesce(F.lower("query_text").contains(F.lower("material")).cast("int"), F.lit(0))
    penalty = F.when((F.coalesce("value", F.lit(0.0)) == 0) | (F.coalesce("unit", F.lit("")) == ""), 1.0).otherwise(F.exp(-F.abs(F.log10(F.greatest(F.col("value"), F.lit(1e-9)) / 100.0))))
    position = 0.5 + 0.5 * (1.0 - F.least(F.lit(1.0), F.coalesce("page", F.lit(1)) / 20.0))
    s = _ALPHA * over + _BETA * entity + _GAMMA * penalty + _DELTA * position + _EPSILON * F.coalesce("docs", F.lit(0)) * 1.0 / F.greatest(F.lit(1), F.col("all_docs")) + _ZETA * 0.7
    s = s * (0.6 + 0.4 * F.coalesce("confidence", F.lit(0.0)))
    return e.join(n, "material", "left").join(F.broadcast(a)).select("value_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 9).alias("relevance"))


_SECTION_WEIGHT = "case when contains(lower(section_title), 'abstract') then 0.9 when contains(lower(section_title), 'result') then 1.0 when contains(lower(section_title), 'conclusion') then 0.8 when contains(lower(section_title), 'method') then 0.6 else 0.3 end"


@add("r9_concept_salience", f"with f as (select item_id, doc, material, section_title from {_F}), a as (select count(*) as items from f) select material, round(least(1.0, greatest(0.0, (0.25 * ln(1 + count(*)) / ln(1 + any_value(items)) + 0.20 * count(distinct doc) * 1.0 / any_value(items) + 0.18 * avg({_SECTION_WEIGHT}) + 0.15 * coalesce(any_value(r.listed), 0) + 0.12 * case when regexp_matches(material, '[0-9]') then 1.0 else 0.6 end) * case when regexp_matches(material, '[0-9]') then 1.12 else 1.0 end)), 7) as salience from f left join (select distinct canonical_name as c, 1 as listed from materials_ref) r on f.material = r.c, a where material is not null group by material")
def r9(spark, d):
    """Frequency, spread, sections, agreement with the reference list in place of a proposal's vector, and digits."""
    f = facts(spark, d, "item_id", "doc", "material", "section_title")
    a = f.agg(F.count(F.lit(1)).alias("items"))
    s = F.lower("section_title")
    weight = F.when(s.contains("abstract"), 0.9).when(s.contains("result"), 1.0).when(s.contains("conclusion"), 0.8).when(s.contains("method"), 0.6).otherwise(0.3)
    r = table(spark, d, "materials_ref", F.col("canonical_name").alias("material")).distinct().withColumn("listed", F.lit(1))
    g = f.where("material is not null").withColumn("w", weight).groupBy("material").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"), F.avg("w").alias("w"))
    digit = F.col("material").rlike("[0-9]")
    base = 0.25 * F.log1p("n") / F.log1p("items") + 0.20 * F.col("docs") * 1.0 / F.col("items") + 0.18 * F.col("w") + 0.15 * F.coalesce("listed", F.lit(0)) + 0.12 * F.when(digit, 1.0).otherwise(0.6)
    out = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * F.when(digit, 1.12).otherwise(1.0)))
    return g.join(F.broadcast(a)).join(small(r), "material", "left").select("material", F.round(out, 7).alias("salience"))


_HEAD = r"^(?:[0-9]+\.?)+ +[A-Z]"
_HEADINGS = f"select * from (select *, row_number() over (partition by filename order by page_num, page_id, i) as rn from (select filename, page_num, page_id, i, trim(l[i]) as title from (select filename, page_num, page_id, l, unnest(range(1, len(l) + 1)) as i from (select filename, page_num, page_id, string_split(replace(text, chr(13), ''), chr(10)) as l from pages_text where text is not null and filename is not null))) where regexp_matches(title, '{_HEAD}')) where rn <= 50"
_TREE = f"with h as ({_HEADINGS}), n as (select filename, max(page_num) as pages from pages_text where filename is not null group by 1), p as (select t.filename, page_num, row_number() over (partition by t.filename order by page_num, page_id) as rn from pages_text t where t.filename is not null and trim(coalesce(text, '')) <> '' and not exists (select 1 from h where h.filename = t.filename)), tree as (select filename, '0001' as node_id, null as parent_id, 0 as level, 1 as page_start, pages as page_end, 'Document Root' as title from n union all select h.filename, '0001.' || lpad(rn::varchar, 4, '0'), '0001', 2, page_num, least(page_num + 7, pages), title from h join n on h.filename = n.filename union all select p.filename, '0001.' || lpad(rn::varchar, 4, '0'), '0001', 3, page_num, page_num, 'Page ' || page_num from p)"


def document_tree(spark, d):
    """(filename, node_id, parent_id, level, page_start, page_end, title): a root per document; its first fifty headings, each
    with seven pages more, else its pages that hold text."""
    p = table(spark, d, "pages_text", "filename", "page_num", "page_id", "text").where("filename is not null")
    lines = p.where("text is not null").select("filename", "page_num", "page_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("i", "l")).withColumn("title", F.trim("l")).where(F.col("title").rlike(_HEAD))
    order = [F.col("page_num"), F.col("page_id"), F.col("i")]
    h = cut(ranked(top_per_key(lines.drop("l"), ["filename"], order, 50), ["filename"], order, "rn"))
    n = p.groupBy("filename").agg(F.max("page_num").alias("pages"))
    node = F.concat(F.lit("0001."), F.lpad(F.col("rn").cast("string"), 4, "0")).alias("node_id")
    root = n.select("filename", F.lit("0001").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.lit(1).alias("page_start"), F.col("pages").alias("page_end"), F.lit("Document Root").alias("title"))
    headed = h.join(n, "filename").select("filename", node, F.lit("0001").alias("parent_id"), F.lit(2).alias("level"), F.col("page_num").alias("page_start"), F.least(F.col("page_num") + 7, F.col("pages")).alias("page_end"), "title")
    plain = p.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(h.select("filename").distinct(), "filename", "left_anti")
    pages = ranked(plain.select("filename", "page_num", "page_id"), ["filename"], [F.col("page_num"), F.col("page_id")], "rn").select("filename", node, F.lit("0001").alias("parent_id"), F.lit(3).alias("level"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), F.concat(F.lit("Page "), "page_num").alias("title"))
    return root.unionByName(headed).unionByName(pages)


@add("r13_tree", f"{_TREE} select * from tree")
def r13(spark, d):
    return document_tree(spark, d)


@add("r13_leaves", f"{_TREE} select filename, node_id, title from tree t where not exists (select 1 from tree c where c.filename = t.filename and c.parent_id = t.node_id)")
def r13_leaves(spark, d):
    """Nodes without children."""
    t = cut(document_tree(spark, d))
    return t.join(t.select("filename", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), ["filename", "node_id"], "left_anti").select("filename", "node_id", "title")


_NODE_HITS = "(" + " + ".join(f"contains(lower(title), '{w}')::int" for w in QUESTION) + ")"


@add("r11_condensed_tree", f"{_TREE} select * from (select filename, node_id, title, {_NODE_HITS} as hits, row_number() over (partition by filename order by {_NODE_HITS} desc, node_id) as rank from tree where level > 0) where rank <= 5")
def r11(spark, d):
    """The five children of each root that fit the question best, by words of their titles; ties in document order."""
    t = document_tree(spark, d).where("level > 0").withColumn("hits", tx.contained(F.col("title"), QUESTION))
    order = [F.desc("hits"), F.col("node_id")]
    return ranked(top_per_key(t.select("filename", "node_id", "title", "hits"), ["filename"], order, 5), ["filename"], order)


_DOCS8 = f"select filename from ({_SCORES}) order by score desc, filename limit 8"


@add("r15_tiered_selection", f"{_TREE}, best as ({_DOCS8}), nodes as (select * from (select t.filename, t.node_id, t.page_start, t.page_end, row_number() over (partition by t.filename order by {_NODE_HITS} desc, node_id) as rn from tree t semi join best on t.filename = best.filename where level > 0) where rn <= 3) select distinct p.page_id, n.filename, n.node_id from nodes n join pages_text p on p.filename = n.filename and p.page_num between n.page_start and n.page_end")
def r15(spark, d):
    """Documents by score, then their best nodes, then the pages of those."""
    best = w1(spark, d).select("filename")
    t = document_tree(spark, d).join(F.broadcast(best), "filename", "left_semi").where("level > 0").withColumn("hits", tx.contained(F.col("title"), QUESTION))
    nodes = top_per_key(t, ["filename"], [F.desc("hits"), F.col("node_id")], 3)
    p = table(spark, d, "pages_text", "page_id", "filename", "page_num")
    return p.join(F.broadcast(nodes.select("filename", "node_id", "page_start", "page_end")), "filename").where("page_num between page_start and page_end").select("page_id", "filename", "node_id").distinct()


@add("r12_drill_down", f"{_TREE}, root as (select filename from ({_SCORES}) order by score desc, filename limit 5), step as (select * from (select t.filename, t.node_id, t.title, t.page_start, t.page_end, row_number() over (partition by t.filename order by {_NODE_HITS} desc, node_id) as rn from tree t semi join root on t.filename = root.filename where parent_id = '0001') where rn <= 1) select s.filename, s.node_id, p.page_id, substring(p.text, 1, 200) as extract from step s join pages_text p on p.filename = s.filename and p.page_num between s.page_start and s.page_end")
def r12(spark, d):
    """At most three steps with a pluggable score: into the best documents, into their best child, then the text is taken."""
    root = _document_scores(spark, d).orderBy(F.desc("score"), "filename").limit(5).select("filename")
    t = document_tree(spark, d).where("parent_id = '0001'").join(F.broadcast(root), "filename", "left_semi").withColumn("hits", tx.contained(F.col("title"), QUESTION))
    step = top_per_key(t, ["filename"], [F.desc("hits"), F.col("node_id")], 1)
    p = table(spark, d, "pages_text", "page_id", "filename", "page_num", "text")
    return p.join(F.broadcast(step), "filename").where("page_num between page_start and page_end").select("filename", "node_id", "page_id", F.substring("text", 1, 200).alias("extract"))


@add("r16_document_frequencies", "select w as term, count(distinct page_id) as df, count(*) as cf from (select page_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from pages_text where text is not null) group by 1")
def r16_terms(spark, d):
    """The index's terms: pages that hold them and occurrences."""
    from lodestone.operators.search import postings

    p = postings(table(spark, d, "pages_text", "page_id", "text"), "page_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@add("g36_per_query", "with r as (select a.vec_id as q, b.vec_id as k, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank, (a.label = b.label)::int as rel from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), j as (select a.vec_id as q, count(*) as judged from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and a.label = b.label group by 1), ks as (select unnest([3, 5, 10]) as k), m as (select r.q, ks.k, sum(rel) filter (rank <= ks.k) as hits, min(rank) filter (rel = 1 and rank <= ks.k) as first, sum(rel / log2(rank + 1)) filter (rank <= ks.k) as dcg from r, ks group by 1, 2) select m.q, m.k, round(coalesce(hits * 1.0 / judged, 0), 9) as recall, round(hits * 1.0 / m.k, 9) as precision, round(coalesce(1.0 / first, 0), 9) as rr, round(case when coalesce(judged, 0) = 0 then 0 else dcg / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= least(m.k, judged)) end, 9) as ndcg, hits > 0 as covered from m left join j on m.q = j.q")
def g36_rows(spark, d):
    """Recall, precision, reciprocal rank, nDCG (ideal over all judged) and coverage of each query at 3, 5 and 10."""
    from lodestone.operators import vectors as ve
    from lodestone.operators.search import metrics_at

    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = e.where("vec_id % 50 = 0")
    top = ve.nearest(e.select("vec_id", "embedding"), q.select("vec_id", "embedding"), "vec_id", "embedding", 10)
    label = e.select("vec_id", "label")
    r = top.join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(label.select(F.col("vec_id").alias("key"), F.col("label").alias("kl")), "key")
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    judged = q.select(F.col("vec_id").alias("query"), "label").join(sizes, "label").select("query", (F.col("n") - 1).alias("judged"))
    return metrics_at(r.select("query", "rank", (F.col("ql") == F.col("kl")).cast("int").alias("relevant")), judged, [3, 5, 10]).withColumnRenamed("query", "q")


@add("g37_faithfulness", "select value_id, round(greatest(0.0, least(1.0, 0.4 * sim + 0.3 * sim + 0.3 * case when unseen < 3 then 1.0 else 0.5 end)), 9) as faithfulness, round(sim, 9) as overlap, unseen from (select value_id, case when len(a) = 0 then 0 else len(list_intersect(a, c)) * 1.0 / len(a) end as sim, len(list_filter(list_distinct(regexp_extract_all(query_text, '[0-9]+\\.[0-9]+')), lambda x: not list_contains(regexp_extract_all(context, '[0-9]+\\.[0-9]+'), x))) as unseen from (select distinct value_id, context, query_text, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(context), '[a-z0-9]+')) as c from extracted_values where context is not null and query_text is not null))")
def g37(spark, d):
    """How far a text's words and numbers are found in its context; word overlap stands for similarity without vectors."""
    e = table(spark, d, "extracted_values", "value_id", "context", "query_text").where("context is not null and query_text is not null").distinct()
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+\.[0-9]+"), 0))
    a = words(F.col("query_text"))
    x = e.select("value_id", F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, words(F.col("context")))) * 1.0 / F.size(a)).alias("sim"), F.size(F.array_except(numbers(F.col("query_text")), numbers(F.col("context")))).alias("unseen"))
    f = 0.4 * F.col("sim") + 0.3 * F.col("sim") + 0.3 * F.when(F.col("unseen") < 3, 1.0).otherwise(0.5)
    return x.select("value_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)), 9).alias("faithfulness"), F.round("sim", 9).alias("overlap"), "unseen")


@add("f1_query_focus", "select distinct item_id from facts where doc_source in (select filename from papers where feed = 'publisher') or physical_quantity in (select physical_quantity from quantity_units where contains('laser power porosity of corvanil 612', replace(physical_quantity, '_', ' '))) or material in (select canonical_name from materials_ref where contains('laser power porosity of corvanil 612', lower(canonical_name)))")
def f1(spark, d):
    """Facts of the relevant documents, or of the quantities or materials that the question names."""
    question = F.lit("laser power porosity of corvanil 612")
    docs = table(spark, d, "papers", "filename", "feed").where("feed = 'publisher'").select(F.col("filename").alias("doc_source")).distinct().withColumn("by_doc", F.lit(True))
    q = table(spark, d, "quantity_units", "physical_quantity").where(question.contains(F.regexp_replace("physical_quantity", "_", " "))).distinct().withColumn("by_q", F.lit(True))
    m = table(spark, d, "materials_ref", F.col("canonical_name").alias("material")).where(question.contains(F.lower("material"))).distinct().withColumn("by_m", F.lit(True))
    f = table(spark, d, "facts", "item_id", "doc_source", "physical_quantity", "material").join(docs, "doc_source", "left").join(small(q), "physical_quantity", "left").join(small(m), "material", "left")
    return f.where("coalesce(by_doc, by_q, by_m, false)").select("item_id").distinct()


QUERIES, ORACLE = C.queries, C.oracle
