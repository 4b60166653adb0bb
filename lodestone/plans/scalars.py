"""Extraction with whole vocabularies as queries (section 2.3 of the inventory); SQL is made from the same vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vocabulary as vo
from lodestone.operators.ranking import ranked, top_per_key
from lodestone.plans.aggregates import METRICS_SQL, metrics, values
from lodestone.plans.extraction import _case, _contained, _q
from lodestone.plans.registry import Catalogue
from lodestone.session import small, table

C = Catalogue()
add = C.add


def _any(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"coalesce(contains(lower({col}), '{_q(w)}'), false)" for w in words) + ")"


def _holds(col, words: list[str]):
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.lower(col).contains(w), F.lit(False))
    return out


def _matches(col: str, pattern: str, groups: int) -> str:
    """SQL list of structs (start, g0, g1, ...) of all matches."""
    p = _q(pattern)
    raw, pieces = f"regexp_extract_all({col}, '{p}')", f"string_split_regex({col}, '{p}')"
    before = f"list_sum(list_transform(list_slice({pieces}, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice({raw}, 1, i - 1), lambda x: length(x))), 0)"
    fields = ", ".join(f"'g{g}': regexp_extract_all({col}, '{p}', {g})[i]" for g in range(groups + 1))
    return f"list_transform(range(1, len({raw}) + 1), lambda i: {{'start': ({before} + 1)::int, {fields}}})"


@add("x1_hashes", "select doc_id, sha256(text) as sha, md5(text) as md, substring(sha256(case when octet_length(encode(text)) <= 1048576 then text else left(text, 1048576) end), 1, 16) as short from documents where text is not null")
def x1(spark, d):
    """Whole texts, and the first MiB for the short hash."""
    x = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    head = F.substring(F.encode("text", "UTF-8"), 1, 1 << 20)
    return x.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"), F.substring(F.sha2(head, 256), 1, 16).alias("short"))


_PDF = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
_part = lambda i: f"coalesce(nullif(regexp_extract(creation_date, '{_PDF}', {i}), ''), '01')"
_ISO = f"{_part(1)} || '-' || {_part(2)} || '-' || {_part(3)} || 'T' || {_part(4)} || ':' || {_part(5)} || ':' || {_part(6)}"


@add("x2_pdf_date_iso", f"select paper_id, case when regexp_matches(creation_date, '{_PDF}') and try_cast({_ISO} as timestamp) is not null then {_ISO} else creation_date end as iso from papers")
def x2(spark, d):
    return table(spark, d, "papers", "paper_id", "creation_date").select("paper_id", tx.pdf_date_iso(F.col("creation_date")).alias("iso"))


@add("x3_year_guess", "select paper_id, nullif(regexp_extract(concat_ws(' ', title, subject), '(?:19|20)\\d{2}'), '') as year from papers")
def x3(spark, d):
    return table(spark, d, "papers", "paper_id", "title", "subject").select("paper_id", tx.year_guess(F.concat_ws(" ", "title", "subject")).alias("year"))


@add("x4_doi_guess", "select page_id, nullif(regexp_extract(text, '(?i)10\\.\\d{4,9}/[-._;()/:A-Z0-9]+'), '') as doi from pages_text where text is not null")
def x4(spark, d):
    return table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", tx.doi_guess(F.col("text")).alias("doi"))


_ABSTRACT = r"(?i)abstract[:\s]*([\s\S]{1,1000}?[\s\S]{0,1000}?)(?:\n\n|\n\s*(?:1\.|introduction|keywords))"


@add("x5_abstract_extraction", f"select page_id, regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(text, '{_ABSTRACT}', 1), ''), substring(text, 1, 500)), '^\\s+', ''), '\\s+$', '') as abstract from pages_text")
def x5(spark, d):
    """Up to 2000 characters after the word abstract, ended by a blank line, a first section or the keywords; else the first
    500 characters."""
    t = F.col("text")
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    return table(spark, d, "pages_text", "page_id", "text").select("page_id", strip(F.coalesce(tx.first_match(t, _ABSTRACT, 1), F.substring(t, 1, 500))).alias("abstract"))


def _hits_sql(col: str, words: list[str]) -> str:
    return " + ".join(f"coalesce((length(lower({col})) - length(replace(lower({col}), '{_q(w)}', ''))) // {len(w)}, 0)" for w in words)


@add("x6_topic_counts", "select * from (" + " union all ".join(f"select page_id, '{n}' as topic, ({_hits_sql('text', p)})::int as n from pages_text" for n, p in vo.TOPICS.items()) + ") where n > 0")
def x6(spark, d):
    wide = table(spark, d, "pages_text", "page_id", "text").select("page_id", *[tx.word_hits(F.col("text"), p).alias(n) for n, p in vo.TOPICS.items()])
    return wide.unpivot("page_id", list(vo.TOPICS), "topic", "n").where("n > 0")


_BANK_SQL = " union all ".join(f"select doc_id, '{q}' as quantity, unnest(regexp_extract_all(text, '{_q(vo.bank_pattern(q))}', 1)) as v from documents" for q in vo.BANK)


def _bank(spark, d):
    t = F.col("text")
    found = tx.tagged({q: F.regexp_extract_all(t, F.lit(vo.bank_pattern(q)), 1) for q in vo.BANK}, "quantity", "value", lambda v: v.try_cast("double"))
    # every pattern holds = or :, which most texts do not
    x = table(spark, d, "documents", "doc_id", "text").where(t.contains("=") | t.contains(":"))
    return x.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.quantity", "x.value")


@add("x7_quantity_regex_bank", f"select doc_id, quantity, try_cast(v as double) as value from ({_BANK_SQL})")
def x7(spark, d):
    return _bank(spark, d)


@add("x65_metadata_to_facts", f"select doc_id, quantity, try_cast(v as double) as value, u.unit from ({_BANK_SQL}) b join (values " + ", ".join(f"('{q}', '{_q(u.split('|')[0].replace(chr(92), ''))}')" for q, (_, u) in vo.BANK.items()) + ") u(q, unit) on b.quantity = u.q where try_cast(v as double) is not null")
def x65(spark, d):
    """The value lists of the documents as facts in the default unit of each quantity."""
    units = spark.createDataFrame([(q, u.split("|")[0].replace("\\", "")) for q, (_, u) in vo.BANK.items()], "quantity string, unit string")
    return _bank(spark, d).where("value is not null").join(F.broadcast(units), "quantity").select("doc_id", "quantity", "value", "unit")


_ALLOY_SQL = " union all ".join(f"select page_id, unnest(regexp_extract_all(text, '{p}')) as a from pages_text" for p in vo.ALLOY_PATTERNS)


@add("x8_alloy_names", f"select distinct page_id, a from ({_ALLOY_SQL}) where length(a) > 2 and lower(a) not in ('alloy', 'composite', 'metal')")
def x8(spark, d):
    names = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), 0) for p in vo.ALLOY_PATTERNS])))
    return table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", F.explode(F.filter(names, lambda x: (F.length(x) > 2) & ~F.lower(x).isin("alloy", "composite", "metal"))).alias("a"))


@add("x10_number_unit_candidates", f"select page_id, m.start as at, m.g0 as raw, m.g1 as v, m.g2 as u from (select page_id, unnest({_matches('text', vo.NUMBER_UNIT, 2)}) as m from pages_text where text is not null)")
def x10(spark, d):
    """Numbers with a unit, also as powers of ten, with their place and written form."""
    return table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", F.explode(tx.matches(F.col("text"), vo.NUMBER_UNIT, 2)).alias("m")).select("page_id", F.col("m.start").alias("at"), F.col("m.g0").alias("raw"), F.col("m.g1").alias("v"), F.col("m.g2").alias("u"))


@add("x18_context_window", f"select page_id, m.start as at, substring(text, greatest(1, m.start - 200), m.start + 200 - greatest(1, m.start - 200)) as ctx from (select page_id, text, unnest({_matches('text', vo.NUMBER_UNIT, 2)}) as m from pages_text where text is not null)")
def x18(spark, d):
    """The 200 characters on both sides of every number with a unit."""
    p = table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", "text", F.explode(tx.matches(F.col("text"), vo.NUMBER_UNIT, 2)).alias("m"))
    return p.select("page_id", F.col("m.start").alias("at"), tx.context_window(F.col("text"), F.col("m.start"), 200, 200).alias("ctx"))


_by = lambda col: f"nullif({_case(col, vo.QUANTITY_RULES, '?')}, '?')"
_ABBR = "case lower(trim(parameter_name)) " + " ".join(f"when '{a}' then '{q}'" for a, q in vo.ABBREVIATIONS.items()) + " end"
_UNIT_CTX = "case " + " ".join(f"when {_any('context', [w])} and {_any('unit', us)} then '{q}'" for w, us, q in vo.UNIT_AND_CONTEXT) + " end"
_HINT = f"nullif({_case('unit', vo.UNIT_HINTS, '?')}, '?')"
_LAST = "case " + " ".join(f"when {('lower(unit) in (' + ', '.join(repr(u) for u in us) + ')') if whole else _any('unit', us)} then '{q}'" for us, whole, q in vo.LAST_UNITS) + " end"


@add("x12_quantity_cascade", f"select distinct item_id, coalesce({_by('parameter_name')}, {_ABBR}, {_by('context')}, {_UNIT_CTX}, {_HINT}, {_LAST}, 'unknown') as quantity from facts")
def x12(spark, d):
    """Name, abbreviation, context, unit with context, hints of the unit, last rules - the first that tells the quantity."""
    f = table(spark, d, "facts", "item_id", "parameter_name", "context", "unit").distinct()
    abbreviations = F.create_map(*[F.lit(x) for kv in vo.ABBREVIATIONS.items() for x in kv])
    unit_ctx, last = F.lit(None).cast("string"), F.lit(None).cast("string")
    for w, us, q in reversed(vo.UNIT_AND_CONTEXT):
        unit_ctx = F.when(_holds(F.col("context"), [w]) & _holds(F.col("unit"), us), q).otherwise(unit_ctx)
    for us, whole, q in reversed(vo.LAST_UNITS):
        last = F.when(F.lower("unit").isin(us) if whole else _holds(F.col("unit"), us), q).otherwise(last)
    by = lambda c: tx.rule_class(F.col(c), vo.QUANTITY_RULES)
    return f.select("item_id", F.coalesce(by("parameter_name"), F.try_element_at(abbreviations, F.lower(F.trim("parameter_name"))), by("context"), unit_ctx, tx.rule_class(F.col("unit"), vo.UNIT_HINTS), last, F.lit("unknown")).alias("quantity"))


def _unit_score_sql(unit: str, expected: str) -> str:
    e = expected.lower()
    same = next((a for a in vo.UNIT_ALIASES if e in a), [e])
    near = next((x for x in vo.UNIT_DIMENSIONS if e in x), [])
    listed = lambda xs: ", ".join(f"'{_q(x)}'" for x in xs)
    return f"case when lower(trim({unit})) in ({listed([e, *same])}) then 1.0 " + (f"when lower(trim({unit})) in ({listed(near)}) then 0.7 " if near else "") + "else 0.0 end"


def _unit_score(unit, expected: str):
    e, u = expected.lower(), F.lower(F.trim(unit))
    same = next((a for a in vo.UNIT_ALIASES if e in a), [e])
    near = next((x for x in vo.UNIT_DIMENSIONS if e in x), [])
    out = F.when(u.isin([e, *same]), 1.0)
    return (out.when(u.isin(near), 0.7) if near else out).otherwise(0.0)


def _range_sql(lo: float, hi: float) -> str:
    return f"case when value between {lo} and {hi} then 1.0 else exp(-0.5 * pow((value - {(lo + hi) / 2}) / {(hi - lo) / 2}, 2)) end"


_CAND = " union all ".join(f"select value_id, '{q}' as q, {i} as pri, 0.35 * {_unit_score_sql('unit', u)} + 0.30 * case when regexp_matches(lower(coalesce(context, '')), '{_q(vo.biased_pattern(q))}') then 0.9 else 0.0 end + 0.20 * least({_contained('context', ks)} / {max(0.3 * len(ks), 1.0)}, 1.0) + 0.15 * {_range_sql(lo, hi)} as score from v" for i, (q, (u, (lo, hi), ks, _)) in enumerate(vo.BIASED.items()))


@add("x14_weighted_classify", f"with v as (select distinct value_id, value, unit, context from extracted_values where value is not null) select value_id, q, round(score, 6) as score from (select *, row_number() over (partition by value_id order by round(score, 9) desc, pri) as rn from ({_CAND})) where rn = 1 and score > 0")
def x14(spark, d):
    """Unit, pattern, words and range of twelve quantities; the best is found inside the row."""
    v = table(spark, d, "extracted_values", "value_id", "value", "unit", "context").where("value is not null").distinct()
    scores = []
    for i, (q, (u, (lo, hi), words, _)) in enumerate(vo.BIASED.items()):
        pattern = F.when(F.lower(F.coalesce("context", F.lit(""))).rlike(vo.biased_pattern(q)), 0.9).otherwise(0.0)
        score = 0.35 * _unit_score(F.col("unit"), u) + 0.30 * pattern + 0.20 * tx.keyword_score(F.col("context"), words) + 0.15 * tx.plausibility(F.col("value"), lo, hi)
        scores.append(F.struct(F.round(-score, 9).alias("neg"), F.lit(i).alias("pri"), F.lit(q).alias("q"), score.alias("score")))
    return v.select("value_id", F.array_min(F.array(*scores)).alias("b")).where("b.score > 0").select("value_id", "b.q", F.round("b.score", 6).alias("score"))


@add("x15_unit_match_score", "select distinct value_id, case physical_quantity " + " ".join(f"when '{q}' then {_unit_score_sql('unit', u)}" for q, (u, *_) in vo.BIASED.items()) + " end as score from extracted_values where unit is not null and physical_quantity in (" + ", ".join(f"'{q}'" for q in vo.BIASED) + ")")
def x15(spark, d):
    e = table(spark, d, "extracted_values", "value_id", "unit", "physical_quantity").where(F.col("unit").isNotNull() & F.col("physical_quantity").isin(list(vo.BIASED))).distinct()
    score = F.lit(None).cast("double")
    for q, (u, *_) in vo.BIASED.items():
        score = F.when(F.col("physical_quantity") == q, _unit_score(F.col("unit"), u)).otherwise(score)
    return e.select("value_id", score.alias("score"))


@add("x17_range_plausibility", "select distinct value_id, round(case physical_quantity " + " ".join(f"when '{q}' then {_range_sql(*r)}" for q, (_, r, *_) in vo.BIASED.items()) + " end, 9) as p from extracted_values where value is not null and physical_quantity in (" + ", ".join(f"'{q}'" for q in vo.BIASED) + ")")
def x17(spark, d):
    e = table(spark, d, "extracted_values", "value_id", "value", "physical_quantity").where(F.col("value").isNotNull() & F.col("physical_quantity").isin(list(vo.BIASED))).distinct()
    p = F.lit(None).cast("double")
    for q, (_, r, *_) in vo.BIASED.items():
        p = F.when(F.col("physical_quantity") == q, tx.plausibility(F.col("value"), *r)).otherwise(p)
    return e.select("value_id", F.round(p, 9).alias("p"))


_CLEAN = "replace(replace(lower(trim(unit)), '²', '2'), '·', '')"
_FACTORS = ", ".join(f"('{q}', '{u}', {f!r}, '{b}')" for q, (b, us) in vo.UNIT_FACTORS.items() for u, f in us.items())


def _factors(spark):
    return spark.createDataFrame([(q, u, f, b) for q, (b, us) in vo.UNIT_FACTORS.items() for u, f in us.items()], "physical_quantity string, u string, factor double, base_unit string")


@add("x19_unit_normalise", f"select distinct value_id, value * coalesce(f.factor, 1.0) as base, coalesce(f.base_unit, e.unit) as unit from extracted_values e left join (values {_FACTORS}) f(q, u, factor, base_unit) on e.physical_quantity = f.q and {_CLEAN} = f.u where value is not null")
def x19(spark, d):
    """Fifteen quantities; a unit that the tables lack stays as it is."""
    e = table(spark, d, "extracted_values", "value_id", "value", "unit", "physical_quantity").where("value is not null").distinct()
    clean = F.replace(F.replace(F.lower(F.trim("unit")), F.lit("²"), F.lit("2")), F.lit("·"), F.lit(""))
    j = e.withColumn("u", clean).join(F.broadcast(_factors(spark)), ["physical_quantity", "u"], "left")
    return j.select("value_id", (F.col("value") * F.coalesce("factor", F.lit(1.0))).alias("base"), F.coalesce("base_unit", "unit").alias("unit"))


@add("x20_plausibility_filter", "select distinct value_id from extracted_values where value is not null and case physical_quantity " + " ".join(f"when '{q}' then value between {lo * 0.8!r} and {hi * 1.2!r}" for q, (lo, hi) in vo.PLAUSIBLE.items()) + " else true end")
def x20(spark, d):
    e = table(spark, d, "extracted_values", "value_id", "value", "physical_quantity").where("value is not null")
    ok = F.lit(True)
    for q, (lo, hi) in vo.PLAUSIBLE.items():
        ok = F.when(F.col("physical_quantity") == q, F.col("value").between(lo * 0.8, hi * 1.2)).otherwise(ok)
    return e.where(ok).select("value_id").distinct()


_STRESS, _SPEED = ["mpa", "gpa", "n/mm", "psi", "pa", "kpa"], ["mm/s", "m/s", "cm/s", "m/min", "mm/min"]
_SAYS_STRESS, _SAYS_PRESSURE, _SAYS_SCAN = ["von mises", "yield", "ultimate", "tensile", "stress", "strength"], ["pressure", "hydraulic", "chamber", "back pressure"], ["scan", "laser", "beam", "traverse", "stage"]


@add("x21_quantity_from_unit_context", f"select distinct value_id, case when {_any('unit', _STRESS)} then case when {_any('context', _SAYS_STRESS)} then 'stress' when {_any('context', _SAYS_PRESSURE)} then 'pressure' else 'stress' end when {_any('unit', _SPEED)} then case when {_any('context', _SAYS_SCAN)} then 'scan_speed' else 'flow_speed' end when lower(unit) in ('w', 'kw', 'mw') then 'power' when {_any('unit', ['w/cm'])} then 'irradiance' when {_any('unit', ['c', 'f', 'k'])} then 'temperature' else 'unknown' end as q from extracted_values")
def x21(spark, d):
    u, c = F.col("unit"), F.col("context")
    q = F.when(_holds(u, _STRESS), F.when(_holds(c, _SAYS_STRESS), "stress").when(_holds(c, _SAYS_PRESSURE), "pressure").otherwise("stress"))
    q = q.when(_holds(u, _SPEED), F.when(_holds(c, _SAYS_SCAN), "scan_speed").otherwise("flow_speed")).when(F.lower(u).isin("w", "kw", "mw"), "power")
    q = q.when(_holds(u, ["w/cm"]), "irradiance").when(_holds(u, ["c", "f", "k"]), "temperature").otherwise("unknown")
    return table(spark, d, "extracted_values", "value_id", "unit", "context").distinct().select("value_id", q.alias("q"))


@add("x23_validity_notes", f"select distinct value_id, concat_ws('; ', case when value is null then 'no value' when value <= 0 then 'not positive' end, case when unit is null or trim(unit) = '' then 'no unit' when physical_quantity in (select q from (values {_FACTORS}) f(q, u, a, b)) and not exists (select 1 from (values {_FACTORS}) f(q, u, a, b) where f.q = physical_quantity and f.u = {_CLEAN}) then 'unit does not fit' end, case when coalesce(trim(context), '') = '' then 'no context' when not contains(lower(context), split_part(physical_quantity, '_', -1)) then 'quantity not in context' end) as notes from extracted_values")
def x23(spark, d):
    """Positivity, the unit's fit with the quantity, and whether the context speaks of the quantity."""
    e = table(spark, d, "extracted_values", "value_id", "value", "unit", "physical_quantity", "context").distinct()
    fits = _factors(spark).groupBy("physical_quantity").agg(F.collect_set("u").alias("us"))
    clean = F.replace(F.replace(F.lower(F.trim("unit")), F.lit("²"), F.lit("2")), F.lit("·"), F.lit(""))
    last = F.element_at(F.split("physical_quantity", "_"), -1)
    notes = F.concat_ws(
        "; ", F.when(F.col("value").isNull(), "no value").when(F.col("value") <= 0, "not positive"),
        F.when(F.col("unit").isNull() | (F.trim("unit") == ""), "no unit").when(F.col("us").isNotNull() & ~F.array_contains("us", clean), "unit does not fit"),
        F.when(F.trim(F.coalesce("context", F.lit(""))) == "", "no context").when(~F.lower("context").contains(last), "quantity not in context"),
    )
    return e.join(F.broadcast(fits), "physical_quantity", "left").select("value_id", notes.alias("notes"))


_REWRITES = [("(ti)(6)(al)(4)(v)", "ti6al4v"), ("(al)(si)(10)(mg)", "alsi10mg"), ("inconel718", "inconel718"), ("cocrfe(?:ni|mn|mo)[a-z0-9_]*", "cocrfeni"), ("(sn)(ag)(cu)", "snagcu")]
_canon = r"regexp_replace(lower(material), '[\s\-_]', '', 'g')"
for _a, _b in _REWRITES:
    _canon = f"regexp_replace({_canon}, '{_a}', '{_b}', 'g')"


@add("x25_alloy_canonical", f"select distinct material, {_canon} as canonical from facts where material is not null")
def x25(spark, d):
    c = F.regexp_replace(F.lower("material"), r"[\s\-_]", "")
    for a, b in _REWRITES:
        c = F.regexp_replace(c, a, b)
    return table(spark, d, "facts", "material").where("material is not null").distinct().select("material", c.alias("canonical"))


_TERMS = [(r"\b(?:j/mm\s*3|j mm-3|j mm⁻³)", "j/mm³"), (r"\b(?:watts?|w)\b", "w"), (r"\b(?:mm/s|mm s-1|mm s⁻¹)", "mm/s"), (r"(?:μm|\bmicrons?\b|\bum\b)", "um")]
_term = "trim(lower(context))"
for _a, _b in _TERMS:
    _term = f"regexp_replace({_term}, '{_a}', '{_b}', 'g')"


@add("x26_term_canonical", f"select distinct value_id, {_term} as context from extracted_values where context is not null")
def x26(spark, d):
    c = F.trim(F.lower("context"))
    for a, b in _TERMS:
        c = F.regexp_replace(c, a, b)
    return table(spark, d, "extracted_values", "value_id", "context").where("context is not null").distinct().select("value_id", c.alias("context"))


@add("x27_concept_validity", f"select paper_id, ({_any('title', vo.DOMAIN_WORDS)} or " + " or ".join(f"regexp_matches(title, '{p}')" for p in vo.ALLOY_PATTERNS) + ") and not list_has_any(string_split(lower(title), ' '), [" + ", ".join(f"'{w}'" for w in vo.GENERIC_WORDS) + "]) as valid from papers where title is not null")
def x27(spark, d):
    t = F.col("title")
    named = _holds(t, vo.DOMAIN_WORDS)
    for p in vo.ALLOY_PATTERNS:
        named = named | t.rlike(p)
    generic = F.arrays_overlap(F.split(F.lower(t), " "), F.array(*[F.lit(w) for w in vo.GENERIC_WORDS]))
    return table(spark, d, "papers", "paper_id", "title").where("title is not null").select("paper_id", (named & ~generic).alias("valid"))


_CATEGORY = "case " + " ".join(f"when regexp_matches(lower(title), '{_q(p)}') then '{c}'" for p, c in vo.CATEGORIES) + " else title end"


@add("x28_concept_category", f"select paper_id, {_CATEGORY} as category from papers where title is not null")
def x28(spark, d):
    """Class of the first pattern that occurs, else the concept itself."""
    c = F.col("title")
    for p, name in reversed(vo.CATEGORIES):
        c = F.when(F.lower("title").rlike(p), name).otherwise(c)
    return table(spark, d, "papers", "paper_id", "title").where("title is not null").select("paper_id", c.alias("category"))


_MODEL = r"trim(regexp_replace(lower(trim(parameter_name)), '[-_\s]+', ' ', 'g'))"
_EXACT = f"case {_MODEL} " + " ".join(f"when '{a}' then '{c}'" for a, c in vo.MODEL_ALIASES.items()) + " end"
_PARTIAL = "case " + " ".join(f"when contains({_MODEL}, '{a}') or contains('{a}', {_MODEL}) then '{c}'" for a, c in vo.MODEL_ALIASES.items()) + " end"


@add("x29_model_normalise", f"select distinct parameter_name, case when trim(parameter_name) = '' then 'unknown' else coalesce({_EXACT}, {_PARTIAL}, replace({_MODEL}, ' ', '_')) end as model from facts where parameter_name is not null")
def x29(spark, d):
    """Exact alias, else the first that contains or is contained, else the name with underscores."""
    n = F.trim(F.regexp_replace(F.lower(F.trim("parameter_name")), r"[-_\s]+", " "))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in vo.MODEL_ALIASES.items() for x in kv]), n)
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in vo.MODEL_ALIASES.items()])
    partial = F.get(F.filter(rules, lambda r: n.contains(r["a"]) | r["a"].contains(n)), F.lit(0))["c"]
    return table(spark, d, "facts", "parameter_name").where("parameter_name is not null").distinct().select("parameter_name", F.when(F.trim("parameter_name") == "", "unknown").otherwise(F.coalesce(exact, partial, F.regexp_replace(n, " ", "_"))).alias("model"))


# at each place the longer symbol is tried first, then the shorter one, else the character is passed over
_SCAN = "|".join([*sorted(e.lower() for e in vo.ELEMENTS if len(e) == 2), *sorted(e.lower() for e in vo.ELEMENTS if len(e) == 1), "."])
_SYMBOLS = ", ".join(f"'{e.lower()}'" for e in vo.ELEMENTS)
_OTHER_TERMS = [t for c, ts in vo.TAXONOMY.items() if c != "Alloy / Composition" for t in ts]
_listed = lambda xs: ", ".join(f"'{_q(x)}'" for x in xs)


@add("x31_material_validator", f"with m as (select distinct lower(material) as t from facts where material is not null), e as (select t, len(list_distinct(list_filter(regexp_extract_all(t, '{_SCAN}'), lambda x: x in ({_SYMBOLS})))) as n from m) select t as term, case when t in ({_listed(vo.TAXONOMY['Alloy / Composition'])}) then true when t in ({_listed(_OTHER_TERMS)}) then false else n >= 2 or {_any('t', vo.MATERIAL_INDICATORS)} or (n = 1 and length(t) <= 2) end as valid from e")
def x31(spark, d):
    m = table(spark, d, "facts", F.lower("material").alias("term")).where("term is not null").distinct()
    return m.select("term", tx_valid(F.col("term")).alias("valid"))


def tx_valid(t):
    """Taxonomy, else two elements of a greedy scan, a word that names materials, or one element that is the whole term."""
    symbols = F.array(*[F.lit(e.lower()) for e in vo.ELEMENTS])
    n = F.size(F.array_intersect(F.regexp_extract_all(t, F.lit(_SCAN), 0), symbols))
    return F.when(t.isin(vo.TAXONOMY["Alloy / Composition"]), True).when(t.isin(_OTHER_TERMS), False).otherwise((n >= 2) | _holds(t, vo.MATERIAL_INDICATORS) | ((n == 1) & (F.length(t) <= 2)))


@add("f4_materials_only", f"with m as (select distinct doc_source as doc, lower(material) as t from facts where material is not null), e as (select *, len(list_distinct(list_filter(regexp_extract_all(t, '{_SCAN}'), lambda x: x in ({_SYMBOLS})))) as n from m) select doc, count(*) as materials from e where case when t in ({_listed(vo.TAXONOMY['Alloy / Composition'])}) then true when t in ({_listed(_OTHER_TERMS)}) then false else n >= 2 or {_any('t', vo.MATERIAL_INDICATORS)} or (n = 1 and length(t) <= 2) end group by 1")
def f4(spark, d):
    """Documents with the terms that the validator takes for materials; documents without any drop out."""
    m = table(spark, d, "facts", F.col("doc_source").alias("doc"), F.lower("material").alias("t")).where("t is not null").distinct()
    return m.where(tx_valid(F.col("t"))).groupBy("doc").agg(F.count(F.lit(1)).alias("materials"))


_TERM = "replace(replace(lower(trim(parameter_name)), '–', '-'), '—', '-')"
_SYN = f"coalesce(case {_TERM} " + " ".join(f"when '{_q(a)}' then '{b}'" for a, b in vo.TERM_SYNONYMS.items()) + f" end, {_TERM})"


@add("x32_term_normalise", f"select parameter_name, term, case " + " ".join(f"when replace(term, ' ', '_') in ({_listed(ts)}) then '{c}'" for c, ts in vo.TAXONOMY.items()) + f" else 'Other' end as category from (select distinct parameter_name, {_SYN} as term from facts where parameter_name is not null)")
def x32(spark, d):
    t = F.translate(F.lower(F.trim("parameter_name")), "–—", "--")
    synonyms = F.create_map(*[F.lit(x) for kv in vo.TERM_SYNONYMS.items() for x in kv])
    category = F.lit("Other")
    for c, ts in reversed(vo.TAXONOMY.items()):
        category = F.when(F.regexp_replace("term", " ", "_").isin(ts), c).otherwise(category)
    f = table(spark, d, "facts", "parameter_name").where("parameter_name is not null").distinct()
    return f.withColumn("term", F.coalesce(F.try_element_at(synonyms, t), t)).withColumn("category", category)


_GATED = "(" + " or ".join(f"regexp_matches(q, '{_q(p)}')" for p in vo.VALUE_TRIGGERS) + ")"
_INTENT = "case when gated then 'value_extraction' " + " ".join(f"when regexp_matches(q, '{_q(p)}') then '{i}'" for i, p in vo.INTENT_PATTERNS.items()) + " else 'open_query' end"
_FORMAT = "case intent " + " ".join(f"when '{i}' then '{f}'" for i, f in vo.OUTPUT_FORMATS.items()) + " else 'prose' end"
_VALUEISH = "intent in ('value_extraction', 'constitutive')"


@add("x33_intent_routing", f"with g as (select distinct query_text, lower(query_text) as q from extracted_values where query_text is not null), h as (select *, {_GATED} as gated from g), i as (select *, {_INTENT} as intent from h) select query_text, intent, gated, {_FORMAT} as output_format, case when {_VALUEISH} then 0.8 else 0.15 end as metadata, case when {_VALUEISH} then 0.5 else 0.25 end as keyword, case when {_VALUEISH} then 0.2 else 0.7 end as semantic, case when {_VALUEISH} then 0.4 else 0.95 end as tree_search, case when intent in ('equation', 'constitutive') then 0.6 else 0.0 end as equation_boost from i")
def x33(spark, d):
    """Value extraction is gated by its triggers; else the first intent whose pattern occurs; with format and weights."""
    q = F.lower("query_text")
    gated = F.lit(False)
    for p in vo.VALUE_TRIGGERS:
        gated = gated | q.rlike(p)
    intent = F.lit("open_query")
    for i, p in reversed(vo.INTENT_PATTERNS.items()):
        intent = F.when(q.rlike(p), i).otherwise(intent)
    x = table(spark, d, "extracted_values", "query_text").where("query_text is not null").distinct().withColumn("gated", gated).withColumn("intent", F.when(F.col("gated"), "value_extraction").otherwise(intent))
    fmt = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in vo.OUTPUT_FORMATS.items() for v in kv]), F.col("intent")), F.lit("prose"))
    valueish = F.col("intent").isin("value_extraction", "constitutive")
    w = lambda a, b: F.when(valueish, a).otherwise(b)
    return x.select("query_text", "intent", "gated", fmt.alias("output_format"), w(0.8, 0.15).alias("metadata"), w(0.5, 0.25).alias("keyword"), w(0.2, 0.7).alias("semantic"), w(0.4, 0.95).alias("tree_search"), F.when(F.col("intent").isin("equation", "constitutive"), 0.6).otherwise(0.0).alias("equation_boost"))


_TARGETS = "array_to_string(list_filter([" + ", ".join(f"case when {_any('query_text', ws)} then '{q}' end" for q, ws in vo.QUANTITY_RULES) + "], lambda x: x is not null), ',')"
_QINTENT = _case("query_text", vo.QUERY_INTENTS, "value_extraction")


@add("x34_query_targets", f"select distinct query_text, {_QINTENT} as intent, {_TARGETS} as targets, case {_QINTENT} " + " ".join(f"when '{i}' then {w[0]}" for i, w in vo.QUERY_WEIGHTS.items()) + " end as metadata_weight, case " + f"{_QINTENT} " + " ".join(f"when '{i}' then {w[1]}" for i, w in vo.QUERY_WEIGHTS.items()) + " end as semantic_weight from extracted_values where query_text is not null")
def x34(spark, d):
    q = F.col("query_text")
    targets = F.array_join(F.array_compact(F.array(*[F.when(_holds(q, ws), n) for n, ws in vo.QUANTITY_RULES])), ",")
    x = table(spark, d, "extracted_values", "query_text").where("query_text is not null").distinct().select("query_text", tx.first_class(q, vo.QUERY_INTENTS, "value_extraction").alias("intent"), targets.alias("targets"))
    weight = lambda i: F.element_at(F.create_map(*[F.lit(v) for k, w in vo.QUERY_WEIGHTS.items() for v in (k, w[i])]), F.col("intent"))
    return x.withColumns({"metadata_weight": weight(0), "semantic_weight": weight(1)})


@add("x35_group_dimension", f"select distinct query_text, nullif({_case('query_text', vo.QUERY_QUANTITIES, '')}, '') as quantity, {_case('query_text', vo.DIMENSIONS, 'material')} as dimension from extracted_values where query_text is not null")
def x35(spark, d):
    q = F.col("query_text")
    return table(spark, d, "extracted_values", "query_text").where("query_text is not null").distinct().select("query_text", tx.rule_class(q, vo.QUERY_QUANTITIES).alias("quantity"), tx.first_class(q, vo.DIMENSIONS, "material").alias("dimension"))


@add("x36_chart_request", f"select distinct query_text, {_case('query_text', vo.CHARTS, 'bar')} as chart, nullif({_case('query_text', vo.FOCI, '')}, '') as focus, case when {_any('query_text', ['only', 'among'])} then 'compare' end as filter from extracted_values where query_text is not null")
def x36(spark, d):
    q = F.col("query_text")
    return table(spark, d, "extracted_values", "query_text").where("query_text is not null").distinct().select("query_text", tx.first_class(q, vo.CHARTS, "bar").alias("chart"), F.nullif(tx.first_class(q, vo.FOCI, ""), F.lit("")).alias("focus"), F.when(_holds(q, ["only", "among"]), "compare").alias("filter"))


@add("x38_headings", "select filename, page_num, title from (select *, row_number() over (partition by filename order by page_num, page_id, i) as rn from (select filename, page_num, page_id, i, trim(l[i]) as title from (select filename, page_num, page_id, l, unnest(range(1, len(l) + 1)) as i from (select filename, page_num, page_id, string_split(replace(text, chr(13), ''), chr(10)) as l from pages_text where text is not null))) where regexp_matches(title, '^(?:[0-9]+\\.?)+ +[A-Z]')) where rn <= 50")
def x38(spark, d):
    """The first fifty numbered headings of each document."""
    p = table(spark, d, "pages_text", "filename", "page_num", "page_id", "text").where("text is not null")
    lines = p.select("filename", "page_num", "page_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("i", "l")).withColumn("title", F.trim("l")).where(F.col("title").rlike(r"^(?:[0-9]+\.?)+ +[A-Z]"))
    return top_per_key(lines, ["filename"], [F.col("page_num"), F.col("page_id"), F.col("i")], 50).select("filename", "page_num", "title")


_NL = "(chr(10) || text)"
_BOUNDS = " union all ".join(f"select page_id, unnest({_matches(_NL, '(?i)' + p, 0)}).start as pos, '{n}' as section from pages_text where text is not null" for n, p in vo.SECTION_HEADINGS)
_SLICES = f"select b.*, p.text, coalesce(lead(pos) over (partition by b.page_id order by pos, section), length(p.text) + 2) as stop from ({_BOUNDS}) b join pages_text p on b.page_id = p.page_id"


@add("x39_sections", f"with s as (select page_id, section, regexp_replace(regexp_replace(substring(chr(10) || text, pos, stop - pos), '^\\s+', ''), '\\s+$', '') as body from ({_SLICES})), k as (select * from s where length(body) > 50) select * from k union all select page_id, 'BODY', text from pages_text p where text is not null and not exists (select 1 from k where k.page_id = p.page_id)")
def x39(spark, d):
    """Sections between the headings of a page, the short ones left out; pages without any are one body."""
    p = table(spark, d, "pages_text", "page_id", "text").where("text is not null")
    t = F.concat(F.lit("\n"), F.col("text"))
    found = tx.tagged({n: tx.matches(t, "(?i)" + pattern, 0) for n, pattern in vo.SECTION_HEADINGS}, "section", "at", lambda m: m["start"])
    b = p.select("page_id", "text", F.array_sort(F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["section"].alias("section")))).alias("b"))
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")
    stop = lambda i: F.coalesce(F.get(F.col("b"), i + 1)["at"], F.length("text") + 2)
    cuts = F.filter(F.transform("b", lambda x, i: F.struct(x["section"].alias("section"), strip(F.substring(F.concat(F.lit("\n"), F.col("text")), x["at"], stop(i) - x["at"])).alias("body"))), lambda s: F.length(s["body"]) > 50)
    c = b.select("page_id", "text", cuts.alias("c"))
    whole = F.array(F.struct(F.lit("BODY").alias("section"), F.col("text").alias("body")))
    return c.select("page_id", F.explode(F.when(F.size("c") > 0, F.col("c")).otherwise(whole)).alias("s")).select("page_id", "s.section", "s.body")


_PARAMS = ", ".join(f"try_cast(nullif(regexp_extract(content, '(?i){_q(p)}', 1), '') as double) as {n}" for n, p in vo.CHUNK_PARAMETERS.items())


@add("x41_chunk_metadata", f"select distinct chunk_id, concat_ws(',', {', '.join(f"case when {_contained('content', w)} > 0 then '{n}' end" for n, w in vo.TOPICS.items())}) as topics, {_PARAMS}, coalesce(regexp_matches(content, '[(=]\\s*[0-9.]+\\s*[×*]\\s*10\\^'), false) as has_equations, coalesce(regexp_matches(content, '(?i)Figure\\s*[0-9]+|Fig\\.\\s*[0-9]+'), false) as has_figures from chunks")
def x41(spark, d):
    c = F.col("content")
    params = [tx.first_match(c, "(?i)" + p, 1).try_cast("double").alias(n) for n, p in vo.CHUNK_PARAMETERS.items()]
    flag = lambda p: F.coalesce(c.rlike(p), F.lit(False))
    return table(spark, d, "chunks", "chunk_id", "content").distinct().select("chunk_id", tx.flags(c, vo.TOPICS).alias("topics"), *params, flag(r"[(=]\s*[0-9.]+\s*[×*]\s*10\^").alias("has_equations"), flag(r"(?i)Figure\s*[0-9]+|Fig\.\s*[0-9]+").alias("has_figures"))


@add("x43_citations", "select paper_id, regexp_replace(regexp_replace(filename, '(?i)\\.pdf$', ''), '^(10\\.[0-9]+)_', '\\1/') as doi, substring(regexp_replace(filename, '\\.[A-Za-z0-9]+$', ''), 1, 20) as short, '[' || paper_id || ']' as number, coalesce(nullif(trim(title), ''), filename) as alias from papers")
def x43(spark, d):
    """Labels in the styles doi (file name back to a DOI), short, number and alias."""
    f = F.col("filename")
    doi = F.regexp_replace(F.regexp_replace(f, r"(?i)\.pdf$", ""), r"^(10\.[0-9]+)_", "$1/")
    return table(spark, d, "papers", "paper_id", "filename", "title").select("paper_id", doi.alias("doi"), F.substring(F.regexp_replace(f, r"\.[A-Za-z0-9]+$", ""), 1, 20).alias("short"), F.concat(F.lit("["), "paper_id", F.lit("]")).alias("number"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), f).alias("alias"))


@add("x44_json_blocks", "select distinct chunk_id, block, json_valid(block) as ok from (select chunk_id, nullif(regexp_extract(metadata, '(?s)\\[.*\\]|\\{.*\\}'), '') as block from chunks) where block is not null")
def x44(spark, d):
    """The first list or object written in a text and whether it parses."""
    c = table(spark, d, "chunks", "chunk_id", "metadata").select("chunk_id", tx.first_match(F.col("metadata"), r"(?s)\[.*\]|\{.*\}").alias("block")).where("block is not null").distinct()
    return c.withColumn("ok", F.try_parse_json("block").isNotNull())


_N2, _N1 = _contained("text", vo.TIER2_WORDS), _contained("text", vo.TIER1_WORDS)


@add("x46_summary_tier", f"select page_id, case when n < 500 then 0 when {_any('text', vo.TIER_BOOSTERS)} then 2 when n2 >= 3 or (n2 >= 2 and n < 4000) or (n2 >= 1 and n < 2000) then 2 when n1 >= 3 or (n1 >= 1 and n < 3000) then 1 when n < 1500 then 0 when n < 3500 then 1 else 2 end as tier from (select page_id, text, length(text) as n, {_N2} as n2, {_N1} as n1 from pages_text where text is not null)")
def x46(spark, d):
    """Tier of a leaf by length and words."""
    p = table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", "text", F.length("text").alias("n"), tx.contained(F.col("text"), vo.TIER2_WORDS).alias("n2"), tx.contained(F.col("text"), vo.TIER1_WORDS).alias("n1"))
    n, n2, n1 = F.col("n"), F.col("n2"), F.col("n1")
    tier = F.when(n < 500, 0).when(_holds(F.col("text"), vo.TIER_BOOSTERS), 2).when((n2 >= 3) | ((n2 >= 2) & (n < 4000)) | ((n2 >= 1) & (n < 2000)), 2).when((n1 >= 3) | ((n1 >= 1) & (n < 3000)), 1).when(n < 1500, 0).when(n < 3500, 1).otherwise(2)
    return p.select("page_id", tier.alias("tier"))


_CTX = "substring(text, greatest(1, m.start - 120), m.start + length(m.g0) + 120 - greatest(1, m.start - 120))"
_CLAIM_SQL = " union all ".join(f"select page_id, '{n}' as predicate, trim(m.g1) as subject, trim(m.g2) as object, {_CTX} as context from (select page_id, text, unnest({_matches('text', p, 2)}) as m from pages_text where text is not null)" for n, p in vo.CLAIMS.items())


@add("x47_claim_triples", _CLAIM_SQL)
def x47(spark, d):
    """Subject, predicate and object of each template with the 120 characters on both sides."""
    p = table(spark, d, "pages_text", "page_id", "text").where("text is not null")
    found = tx.tagged({n: tx.matches(F.col("text"), pattern, 2) for n, pattern in vo.CLAIMS.items()}, "predicate", "m")
    x = p.select("page_id", "text", F.explode(found).alias("x")).select("page_id", "text", "x.predicate", "x.m")
    start = F.greatest(F.lit(1), F.col("m.start") - 120)
    return x.select("page_id", "predicate", F.trim("m.g1").alias("subject"), F.trim("m.g2").alias("object"), F.substring("text", start, F.col("m.start") + F.length("m.g0") + 120 - start).alias("context"))


@add("x53_abstract_metrics", f"select paper_id, metric, try_cast(v as double) as value from ({METRICS_SQL})")
def x53(spark, d):
    return metrics(spark, d).select("paper_id", "metric", "value")


@add("x58_multiphysics_flags", "select paper_id, " + _any("keywords", ["simulation", "thermal", "phase field", "finite element", "electro", "fluid"]) + " as multiphysics from papers")
def x58(spark, d):
    return table(spark, d, "papers", "paper_id", "keywords").select("paper_id", _holds(F.col("keywords"), ["simulation", "thermal", "phase field", "finite element", "electro", "fluid"]).alias("multiphysics"))


_PREFS = ", ".join(f"{{'s': 2.0 * {_contained('query_text', [v.lower() for v in vs])}, 'p': -{i}, 'u': '{u}'}}" for i, (u, vs) in enumerate(vo.UNIT_VARIANTS.items()))


@add("x59_unit_preference", f"select distinct query_text, list_max([{_PREFS}]).s as score, case when list_max([{_PREFS}]).s > 0 then list_max([{_PREFS}]).u end as unit from extracted_values where query_text is not null")
def x59(spark, d):
    """Two points per variant named in the query; the unit with most points, the first of equal ones."""
    q = F.col("query_text")
    best = F.array_max(F.array(*[F.struct((2.0 * tx.contained(q, [v.lower() for v in vs])).alias("s"), F.lit(-i).alias("p"), F.lit(u).alias("u")) for i, (u, vs) in enumerate(vo.UNIT_VARIANTS.items())]))
    x = table(spark, d, "extracted_values", "query_text").where("query_text is not null").distinct().select("query_text", best.alias("b"))
    return x.select("query_text", F.col("b.s").alias("score"), F.when(F.col("b.s") > 0, F.col("b.u")).alias("unit"))


_GUESS = f"case when {_any('context', ['stress', 'strength'])} then case when {_any('context', ['yield'])} then 'yield_strength' when {_any('context', ['ultimate', 'tensile'])} then 'ultimate_tensile_strength' when {_any('context', ['von mises', 'equivalent'])} then 'von_mises_stress' else 'mechanical_stress' end else {_case('context', vo.GUESSES, 'unknown_parameter')} end"


def _guess(c):
    stress = F.when(_holds(c, ["yield"]), "yield_strength").when(_holds(c, ["ultimate", "tensile"]), "ultimate_tensile_strength").when(_holds(c, ["von mises", "equivalent"]), "von_mises_stress").otherwise("mechanical_stress")
    return F.when(_holds(c, ["stress", "strength"]), stress).otherwise(tx.first_class(c, vo.GUESSES, "unknown_parameter"))


@add("x61_guess_from_context", f"select distinct value_id, {_GUESS} as guess from extracted_values")
def x61(spark, d):
    return table(spark, d, "extracted_values", "value_id", "context").distinct().select("value_id", _guess(F.col("context")).alias("guess"))


_DYNAMIC = r"([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*([a-zA-Zµμ°%‰]+(?:/[a-zA-Zµμ°%‰]+)?(?:·?[a-zA-Zµμ°%‰]+)?[0-9]?)"
_DYN_WORDS, _KNOWN = ["stress", "strength", "modulus", "viscosity", "enthalpy", "cooling rate", "hardness", "energy density", "yield", "tensile"], ["MPa", "GPa", "J/", "W/", "Pa·s", "HV", "K/s"]
_DSCORE = f"case when u in ({_listed(vo.COMMON_UNITS)}) then 0.6 when " + " or ".join(f"contains(u, '{k}')" for k in _KNOWN) + f" then 0.4 else 0.0 end + case when {_any('context', _DYN_WORDS)} then 0.5 else 0.0 end + case when contains(lower(coalesce(query_text, '')), lower(u)) then 1.0 else 0.0 end"


@add("x60_dynamic_units", f"with c as (select distinct value_id, context, query_text from extracted_values where context is not null), m as (select context, query_text, value_id, unnest({_matches('context', _DYNAMIC, 2)}) as m from c), s as (select value_id, try_cast(m.g1 as double) as value, m.g2 as u, {_GUESS} as guess, context, query_text from m) select value_id, value, u as unit, guess, max(round(score, 3)) as score from (select *, {_DSCORE} as score from s where length(u) <= 15) where score > 0.4 group by 1, 2, 3, 4")
def x60(spark, d):
    """Numbers with any unit in a context, scored by unit, words and query; the best of equal values and guesses."""
    c = table(spark, d, "extracted_values", "value_id", "context", "query_text").where("context is not null").distinct()
    m = c.select("*", F.explode(tx.matches(F.col("context"), _DYNAMIC, 2)).alias("m")).select("value_id", F.col("m.g1").try_cast("double").alias("value"), F.col("m.g2").alias("unit"), _guess(F.col("context")).alias("guess"), "context", "query_text").where(F.length("unit") <= 15)
    known = F.lit(False)
    for k in _KNOWN:
        known = known | F.col("unit").contains(k)
    score = F.when(F.col("unit").isin(vo.COMMON_UNITS), 0.6).when(known, 0.4).otherwise(0.0) + F.when(_holds(F.col("context"), _DYN_WORDS), 0.5).otherwise(0.0) + F.when(F.lower(F.coalesce("query_text", F.lit(""))).contains(F.lower("unit")), 1.0).otherwise(0.0)
    return m.withColumn("score", score).where("score > 0.4").groupBy("value_id", "value", "unit", "guess").agg(F.max(F.round("score", 3)).alias("score"))


def _onto_sql(i: int, q: str) -> str:
    units, words, anti, (lo, hi) = vo.ONTOLOGY[q]
    return f"{{'s': round(case when {_any('unit', units)} then 0.65 else 0.0 end + case when {_any('context', words)} then 0.55 else 0.0 end - case when {_any('context', anti)} then 1.2 else 0.0 end + case when value between {lo} and {hi} then 0.25 else -0.4 end + case when {_any('query_text', words)} then 0.4 else 0.0 end, 9), 'p': -{i}, 'q': '{q}'}}"


_ONTO = ", ".join(_onto_sql(i, q) for i, q in enumerate(vo.ONTOLOGY))


@add("x62_disambiguation", f"select value_id, case when b.s > -1 then b.q else 'unknown' end as quantity, greatest(0.0, b.s) as confidence from (select value_id, list_max([{_ONTO}]) as b from (select distinct value_id, value, unit, context, query_text from extracted_values where value is not null))")
def x62(spark, d):
    """Unit, words for and against, range and query of each quantity; the best, the first of equal ones."""
    v = table(spark, d, "extracted_values", "value_id", "value", "unit", "context", "query_text").where("value is not null").distinct()
    one = lambda test, yes, no=0.0: F.when(test, yes).otherwise(no)
    scores = []
    for i, (q, (units, words, anti, (lo, hi))) in enumerate(vo.ONTOLOGY.items()):
        s = one(_holds(F.col("unit"), units), 0.65) + one(_holds(F.col("context"), words), 0.55) - one(_holds(F.col("context"), anti), 1.2) + one(F.col("value").between(lo, hi), 0.25, -0.4) + one(_holds(F.col("query_text"), words), 0.4)
        scores.append(F.struct(F.round(s, 9).alias("s"), F.lit(-i).alias("p"), F.lit(q).alias("q")))
    b = v.select("value_id", F.array_max(F.array(*scores)).alias("b"))
    return b.select("value_id", F.when(F.col("b.s") > -1, F.col("b.q")).otherwise("unknown").alias("quantity"), F.greatest(F.lit(0.0), F.col("b.s")).alias("confidence"))


_SPAN_SQL = " union all ".join(f"select page_id, '{n}' as kind, try_cast(m.g1 as double) as value, m.start as start, m.start + length(m.g0) as stop, substring(text, greatest(1, m.start - 30), m.start + length(m.g0) + 30 - greatest(1, m.start - 30)) as context from (select page_id, text, unnest({_matches('text', '(?i)' + p, 1)}) as m from pages_text where text is not null)" for n, p in vo.CLAIM_UNITS.items())


@add("x73_numeric_claims", _SPAN_SQL)
def x73(spark, d):
    """Five groups of units: value, span and the thirty characters on both sides."""
    p = table(spark, d, "pages_text", "page_id", "text").where("text is not null")
    found = tx.tagged({n: tx.matches(F.col("text"), "(?i)" + pattern, 1) for n, pattern in vo.CLAIM_UNITS.items()}, "kind", "m")
    x = p.select("page_id", "text", F.explode(found).alias("x")).select("page_id", "text", "x.kind", "x.m")
    start, stop = F.col("m.start"), F.col("m.start") + F.length("m.g0")
    begin = F.greatest(F.lit(1), start - 30)
    return x.select("page_id", "kind", F.col("m.g1").try_cast("double").alias("value"), start.alias("start"), stop.alias("stop"), F.substring("text", begin, stop + 30 - begin).alias("context"))


@add("x74_alias_override", "select a, q from (select lower(trim(a)) as a, q, row_number() over (partition by lower(trim(a)) order by q desc) as rn from (select physical_quantity as q, unnest(string_split(other_names, ';')) as a from quantity_units)) where rn = 1")
def x74(spark, d):
    """Alias to quantity; of several writers of an alias the last one, in the order of names, holds."""
    a = table(spark, d, "quantity_units", "physical_quantity", "other_names").select(F.col("physical_quantity").alias("q"), F.explode(F.split("other_names", ";")).alias("a")).select(F.lower(F.trim("a")).alias("a"), "q")
    return a.groupBy("a").agg(F.max("q").alias("q"))


@add("f10_physics_bounds", "select distinct value_id, case " + " ".join(f"when contains(physical_quantity, '{q}') and (value < {lo!r} or value > {hi!r}) then 'out of range'" for q, (lo, hi) in vo.BOUNDS.items()) + " else 'ok' end as verdict from extracted_values where value is not null")
def f10(spark, d):
    verdict = F.lit("ok")
    for q, (lo, hi) in reversed(vo.BOUNDS.items()):
        verdict = F.when(F.col("physical_quantity").contains(q) & ((F.col("value") < lo) | (F.col("value") > hi)), "out of range").otherwise(verdict)
    return table(spark, d, "extracted_values", "value_id", "physical_quantity", "value").where("value is not null").distinct().select("value_id", verdict.alias("verdict"))


@add("x55_material_features", f"select material, round(ln(1 + count(*)), 9) as log_n, " + ", ".join(f"max(({_case('material', vo.MATERIAL_CLASSES, 'other')} = '{c}')::int) as is_{c}" for c, _ in vo.MATERIAL_CLASSES) + " from (select distinct value_id, material from extracted_values) where material is not null group by 1")
def x55(spark, d):
    """log1p of the count and one indicator per class."""
    g = values(spark, d, "value_id", "material").where("material is not null").groupBy("material").agg(F.round(F.log1p(F.count(F.lit(1))), 9).alias("log_n"))
    cls = tx.first_class(F.col("material"), vo.MATERIAL_CLASSES, "other")
    return g.select("material", "log_n", *[(cls == c).cast("int").alias(f"is_{c}") for c, _ in vo.MATERIAL_CLASSES])


@add("x57_quantile_bins", "select item_id, (rn - 1) * 5 // n as bin from (select item_id, row_number() over (order by confidence, item_id) as rn, count(*) over () as n from (select distinct item_id, confidence from facts where confidence is not null))")
def x57q(spark, d):
    """Five bins of equal size, by ranks over range blocks."""
    f = table(spark, d, "facts", "item_id", "confidence").where("confidence is not null").distinct()
    n = f.agg(F.count(F.lit(1)).alias("n"))
    r = ranked(f, [], [F.col("confidence"), F.col("item_id")], "rn")
    return r.join(F.broadcast(n)).select("item_id", F.floor((F.col("rn") - 1) * 5 / F.col("n")).alias("bin"))


@add("x48_entities", "with m as (select material_id, trim(unnest(string_split(canonical_name || coalesce('; ' || other_names, ''), ';'))) as n from materials_ref) select distinct chunk_id, 'material' as label, material_id::varchar as entity from chunks c join m on m.n <> '' and contains(c.content, m.n) union all select distinct chunk_id, 'number', trim(unnest(regexp_extract_all(content, '" + _q(vo.NUMBER_UNIT) + "'))) from chunks")
def x48(spark, d):
    """Materials by any of their names, and numbers with units; the names are looked for inside the row."""
    m = table(spark, d, "materials_ref", "material_id", "canonical_name", "other_names")
    names = m.select("material_id", F.explode(F.split(F.concat("canonical_name", F.coalesce(F.concat(F.lit("; "), "other_names"), F.lit(""))), ";")).alias("n")).select("material_id", F.trim("n").alias("n")).where("n <> ''").distinct()
    one = names.agg(F.collect_list(F.struct("material_id", "n")).alias("names"))  # the fixed list of materials
    c = table(spark, d, "chunks", "chunk_id", "content").where("content is not null").distinct()
    found = F.array_distinct(F.transform(F.filter("names", lambda x: F.col("content").contains(x["n"])), lambda x: x["material_id"].cast("string")))
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(vo.NUMBER_UNIT), 0), lambda x: F.trim(x)))
    j = c.join(F.broadcast(one)).select("chunk_id", F.explode(F.concat(F.transform(found, lambda x: F.struct(F.lit("material").alias("label"), x.alias("entity"))), F.transform(numbers, lambda x: F.struct(F.lit("number").alias("label"), x.alias("entity"))))).alias("e"))
    return j.select("chunk_id", "e.label", "e.entity")


QUERIES, ORACLE = C.queries, C.oracle
_ = small
