"""Aggregations as queries (section 2.6 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import facts as fo
from lodestone.operators.ranking import ranked, shifted, top_per_key
from lodestone.plans.registry import Catalogue, sig, sig_sql
from lodestone.session import small, table

C = Catalogue()
add = C.add

#: Repeated rows count once in every query. They repeat in full, so their key and the columns in use tell them apart.
_F = "(select distinct item_id, item_type, material, physical_quantity as q, doc_source as doc, page, value, unit, confidence, method, content, parameter_name, section_title from facts)"
_E = "(select distinct value_id, physical_quantity as q, doc_name as doc, page, value, unit, confidence, material, parameter_name, method_origin, phase, section_title, context, query_text from extracted_values)"
_A = "(select distinct property_id, property_name, value, unit, source_citation as doc, extraction_confidence, alloy_system, phase, normalized_value, property_type from alloy_properties)"


def _narrow(spark, d, name, key, renamed, columns):
    named = {v: k for k, v in renamed.items()}
    df = table(spark, d, name, *[named.get(c, c) for c in dict.fromkeys([key, *columns])]).withColumnsRenamed(renamed).distinct()
    return df if key in columns or not columns else df.drop(key)


def facts(spark, d, *columns):
    """The columns of facts (doc and q for short), repeated rows once; only they and the key are read and shuffled."""
    return _narrow(spark, d, "facts", "item_id", {"physical_quantity": "q", "doc_source": "doc"}, columns)


def values(spark, d, *columns):
    """As ``facts``, of extracted_values."""
    return _narrow(spark, d, "extracted_values", "value_id", {"physical_quantity": "q", "doc_name": "doc"}, columns)


def properties(spark, d, *columns):
    """As ``facts``, of alloy_properties."""
    return _narrow(spark, d, "alloy_properties", "property_id", {"source_citation": "doc"}, columns)


def _r(df, *cols, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _s(df, *cols):
    return df.withColumns({c: sig(c) for c in cols})


_AVG, _POP = sig_sql("avg(value)"), sig_sql("coalesce(stddev_pop(value), 0)")
_SAMP = sig_sql("coalesce(stddev_samp(value), 0)")
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]{{4,}}'))"
_OVERLAP = f"least(len(list_intersect({_WORDS.format('query_text')}, {_WORDS.format('context')})) / greatest(0.5 * len({_WORDS.format('query_text')}), 1), 1.0)"
#: Query-biased salience without a vector: similarity counts as one half.
SALIENCE_SQL = f"(0.4 * 0.5 + 0.25 * {_OVERLAP} + 0.2 * (material is not null)::int + 0.15 * coalesce(contains(lower(section_title), 'result')::int, 0)) * confidence"
SALIENCE_COLUMNS = ["query_text", "context", "material", "section_title", "confidence"]


def salience():
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{4,}"), 0))
    asked = words(F.col("query_text"))
    overlap = F.least(F.size(F.array_intersect(asked, words(F.col("context")))) / F.greatest(0.5 * F.size(asked), F.lit(1)), F.lit(1.0))
    section = F.coalesce(F.lower("section_title").contains("result").cast("int"), F.lit(0))
    return (0.4 * 0.5 + 0.25 * overlap + 0.2 * F.col("material").isNotNull().cast("int") + 0.15 * section) * F.col("confidence")


@add("g1_quantity_summary", f"select q, count(value) as n, count(distinct doc) as docs, count(distinct value) as vals, min(value) as lo, max(value) as hi, {_AVG} as mean, {_POP} as std from {_F} where value is not null group by q")
def g1(spark, d):
    f = facts(spark, d, "q", "doc", "value", "item_id").where("value is not null")
    return _s(f.groupBy("q").agg(F.count("value").alias("n"), F.count_distinct("doc").alias("docs"), F.count_distinct("value").alias("vals"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std")), "mean", "std")


@add("g2_material_summary", f"select lower(material) as material, q, count(*) as n, count(distinct doc) as docs, min(value) as lo, max(value) as hi, {_AVG} as mean from {_F} where material is not null and q is not null and value is not null group by 1, 2")
def g2(spark, d):
    f = facts(spark, d, "item_id", "material", "q", "doc", "value").where("material is not null and q is not null and value is not null")
    return _s(f.groupBy(F.lower("material").alias("material"), "q").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean")), "mean")


@add("g2_material_values", f"select lower(material) as material, q, item_id, value, unit, doc, page from {_F} where lower(material) = 'corvanil 612' and value is not null")
def g2_values(spark, d):
    """The values of one material, the name being the query's parameter."""
    return facts(spark, d, "item_id", "material", "q", "value", "unit", "doc", "page").where("lower(material) = 'corvanil 612' and value is not null").withColumn("material", F.lower("material"))


@add("g3_quantity_counts", f"select q, count(*) as n from {_F} where q is not null group by q")
def g3(spark, d):
    return facts(spark, d, "item_id", "q").where("q is not null").groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@add("g4_materials_per_doc", "select doc_source as doc, count(distinct material) as materials from facts where material is not null group by 1")
def g4(spark, d):
    return table(spark, d, "facts", F.col("doc_source").alias("doc"), "material").where("material is not null").groupBy("doc").agg(F.count_distinct("material").alias("materials"))


@add("g4_documents_per_material", "select material, count(distinct doc_source) as docs from facts where material is not null group by 1 order by docs desc, material limit 10")
def g4_donut(spark, d):
    return table(spark, d, "facts", "doc_source", "material").where("material is not null").groupBy("material").agg(F.count_distinct("doc_source").alias("docs")).orderBy(F.desc("docs"), "material").limit(10)


@add("g5_entity_consensus", f"select e, count(*) as n, count(distinct doc) as docs, min(value) as lo, max(value) as hi, {_AVG} as mean, min(unit) as unit from (select item_id, material as e, doc, value, unit from {_F} where value is not null union select item_id, q, doc, value, unit from {_F} where value is not null) where e is not null group by e")
def g5(spark, d):
    f = facts(spark, d, "item_id", "material", "q", "doc", "value", "unit").where("value is not null")
    # a row whose material and quantity are the same name counts once for it
    both = f.select(F.explode(F.array_distinct(F.array_compact(F.array("material", "q")))).alias("e"), "doc", "value", "unit")
    return _s(both.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.min("unit").alias("unit")), "mean")


@add("g6_full_consensus", f"select q, count(distinct doc) as docs, count(*) as n, {_AVG} as mean, {_POP} as std, min(value) as lo, max(value) as hi, {sig_sql('median(value)')} as median, min(unit) as unit from {_F} where q is not null and value is not null group by q having count(distinct doc) >= 2 and count(*) >= 2")
def g6(spark, d):
    s = fo.consensus(facts(spark, d, "item_id", "q", "doc", "value", "unit"), "q", "doc", "value", "unit")
    return _s(s.select("q", "docs", "n", "mean", "std", "lo", "hi", "median", "unit"), "mean", "std", "median")


@add("g6_values_by_document", f"with k as (select q from {_F} where q is not null and value is not null group by q having count(distinct doc) >= 2 and count(*) >= 2) select q, doc, count(*) as n, {_AVG} as mean, min(value) as lo, max(value) as hi from {_F} semi join k using (q) where value is not null group by q, doc")
def g6_by_doc(spark, d):
    f = facts(spark, d, "item_id", "q", "doc", "value").where("q is not null and value is not null")
    g = f.groupBy("q", "doc").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    kept = g.groupBy("q").agg(F.count("doc").alias("docs"), F.sum("n").alias("all")).where("docs >= 2 and all >= 2").select("q")
    return _s(g.join(kept, "q", "left_semi"), "mean")


@add("g7_contradictions", f"with m as (select q, doc, avg(value) as mean, stddev_pop(value) as std from {_F} where q is not null and value is not null group by q, doc having avg(value) > 0), c as (select m.q, m.doc, m.mean, m.std, count(*) as contradicting, max(greatest(o.mean / m.mean, m.mean / o.mean)) as ratio from m join m o on m.q = o.q and (o.mean < m.mean / 2 or o.mean > m.mean * 2) group by 1, 2, 3, 4) select q, doc, {sig_sql('mean')} as mean, {sig_sql('std')} as std, contradicting, {sig_sql('ratio')} as ratio, case when ratio > 10 then 'critical' when ratio > 5 then 'high' else 'moderate' end as severity from c")
def g7(spark, d):
    return _s(fo.contradiction_pairs(facts(spark, d, "item_id", "q", "doc", "value"), "q", "doc", "value"), "mean", "std", "ratio")


@add("g8_variance_contradictions", f"select parameter_name, unit, n, {sig_sql('mean')} as mean, {sig_sql('std')} as std from (select parameter_name, unit, count(*) as n, avg(value) as mean, stddev_pop(value) as std from {_F} where value is not null and item_type = 'quantitative' group by 1, 2) where n >= 2 and std > 0.5 * mean")
def g8(spark, d):
    f = facts(spark, d, "item_id", "item_type", "parameter_name", "unit", "value").where("item_type = 'quantitative'")
    return _s(fo.variance_contradictions(f, ["parameter_name", "unit"], "value").select("parameter_name", "unit", "n", "mean", "std"), "mean", "std")


@add("g9_parameter_consensus", f"select parameter_name, unit, count(*) as n, min(value) as lo, max(value) as hi, {_AVG} as mean, {_POP} as std, count(distinct doc) as sources from {_F} where value is not null and item_type = 'quantitative' and unit <> '' group by 1, 2 having count(*) >= 2")
def g9(spark, d):
    f = facts(spark, d, "item_id", "item_type", "parameter_name", "unit", "value", "doc").where("value is not null and item_type = 'quantitative' and unit <> ''")
    g = f.groupBy("parameter_name", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count_distinct("doc").alias("sources"))
    return _s(g.where("n >= 2"), "mean", "std")


def _by(key, other, name):
    sql = f"select q, {key}, count(*) as n, {_AVG} as mean, {_SAMP} as std, min(value) as lo, max(value) as hi, {sig_sql(f'avg({SALIENCE_SQL})')} as avg_salience, {sig_sql('avg(confidence)')} as avg_confidence, count(distinct {other}) as {name} from {_E} where value is not null group by 1, 2"

    def run(spark, d):
        e = values(spark, d, "value_id", "q", "doc", "value", *SALIENCE_COLUMNS).where("value is not null").withColumn("s", salience())
        g = e.groupBy("q", key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), fo.sample_std("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("s").alias("avg_salience"), F.avg("confidence").alias("avg_confidence"), F.count_distinct(other).alias(name))
        return _s(g, "mean", "std", "avg_salience", "avg_confidence")

    return sql, run


for _name, _key, _other, _out in (("g10_by_material", "material", "doc", "sources"), ("g11_by_document", "doc", "material", "materials")):
    _sql, _run = _by(_key, _other, _out)
    add(_name, _sql)(_run)


@add("g12_quantity_digest", f"with u as (select q, unit, row_number() over (partition by q order by count(*) desc, unit) as rn from {_E} where value is not null and unit is not null group by 1, 2) select e.q, count(*) as n, count(distinct value) as vals, min(value) as lo, max(value) as hi, {_AVG} as mean, {_SAMP} as std, {sig_sql('median(value)')} as median, count(distinct doc) as docs, any_value(u.unit) as unit from {_E} e left join u on e.q = u.q and u.rn = 1 where value is not null group by 1")
def g12(spark, d):
    e = values(spark, d, "value_id", "q", "doc", "value", "unit").where("value is not null")
    g = e.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("vals"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), fo.sample_std("value").alias("std"), F.count_distinct("doc").alias("docs"))
    out = g.join(fo.quantiles(e, ["q"], "value", {"median": 0.5}), "q").join(fo.most_frequent(e, ["q"], "unit", "unit"), "q", "left")
    return _s(out, "mean", "std", "median")


@add("g12_top_salience", f"select q, value_id, rn as rank from (select q, value_id, row_number() over (partition by q order by round({SALIENCE_SQL}, 9) desc nulls last, value_id) as rn from {_E} where value is not null) where rn <= 10")
def g12_top(spark, d):
    e = values(spark, d, "value_id", "q", "value", *SALIENCE_COLUMNS).where("value is not null").withColumn("s", F.round(salience(), 9))
    order = [F.desc_nulls_last("s"), F.col("value_id")]
    return ranked(top_per_key(e.select("q", "value_id", "s"), ["q"], order, 10), ["q"], order).select("q", "value_id", "rank")


@add("g13_consensus_boost", f"select material, round(1 + 0.3 * ln(1 + count(distinct doc)), 9) as boost from {_F} where material is not null group by 1")
def g13(spark, d):
    return facts(spark, d, "material", "doc").where("material is not null").groupBy("material").agg(F.round(1 + 0.3 * F.log1p(F.count_distinct("doc")), 9).alias("boost"))


@add("g14_fused_numeric", "select physical_quantity as q, unit, n, case when cv < 0.1 and n >= 2 then 'HIGH' when cv < 0.3 or n = 1 then 'MODERATE' else 'LOW' end as level from (select *, case when mean = 0 then 1.0 else std / abs(mean) end as cv from (select physical_quantity, unit, count(*) as n, avg(value) as mean, stddev_pop(value) as std from (select distinct * from extracted_values) where value is not null group by 1, 2))")
def g14(spark, d):
    return fo.fused_numeric(values(spark, d, "value_id", "q", "unit", "value"), ["q", "unit"], "value").select("q", "unit", "n", "level")


@add("g14_fused_categorical", "select alloy_system, mode, round(share, 9) as share from (select alloy_system, phase as mode, n * 1.0 / sum(n) over (partition by alloy_system) as share, row_number() over (partition by alloy_system order by n desc, phase) as rn from (select alloy_system, phase, count(*) as n from (select distinct * from alloy_properties) where phase is not null group by 1, 2)) where rn = 1")
def g14b(spark, d):
    return _r(fo.fused_categorical(properties(spark, d, "property_id", "alloy_system", "phase"), ["alloy_system"], "phase"), "share", digits=9)


_FUSED = "select property_name, count(*) as n, avg(normalized_value) as mean, stddev_pop(normalized_value) as std, count(distinct doc) as sources from " + _A + " where normalized_value is not null group by 1"
_LEVELS = f"select *, case when cv < 0.1 and n >= 2 then 'HIGH' when cv < 0.3 or n = 1 then 'MODERATE' else 'LOW' end as level from (select *, case when mean = 0 then 1.0 else std / abs(mean) end as cv from ({_FUSED}))"


@add("g15_fusion_metrics", f"select count(*) as fused, sum(n)::bigint as extracted, round(count(*) * 1.0 / sum(n), 9) as coverage, count(*) filter (level <> 'LOW') as consistent, round(count(*) filter (level <> 'LOW') * 1.0 / count(*), 9) as consistency, round(avg(case level when 'HIGH' then 1.0 when 'MODERATE' then 0.7 else 0.4 end), 9) as weighted_confidence, {sig_sql('avg(std / abs(mean)) filter (mean <> 0)')} as uncertainty, any_value(least(1.0, docs / 3.0)) as diversity from ({_LEVELS}), (select count(distinct doc) as docs from {_A})")
def g15(spark, d):
    """Metrics of fusing the numeric properties of all documents; a property of low confidence is one with conflicts."""
    p = properties(spark, d, "property_id", "property_name", "normalized_value", "doc")
    f = fo.fused_numeric(p, ["property_name"], "normalized_value")
    weight = F.when(F.col("level") == "HIGH", 1.0).when(F.col("level") == "MODERATE", 0.7).otherwise(0.4)
    one = f.agg(F.count(F.lit(1)).alias("fused"), F.sum("n").alias("extracted"), F.count_if(F.col("level") != "LOW").alias("consistent"), F.round(F.avg(weight), 9).alias("weighted_confidence"), F.avg(F.when(F.col("mean") != 0, F.col("std") / F.abs("mean"))).alias("uncertainty"))
    docs = p.agg(F.least(F.lit(1.0), F.count_distinct("doc") / 3.0).alias("diversity"))
    out = one.join(F.broadcast(docs)).withColumns({"coverage": F.round(F.col("fused") / F.col("extracted"), 9), "consistency": F.round(F.col("consistent") / F.col("fused"), 9)})
    return _s(out, "uncertainty")


_RANKED_Q = f"select q, row_number() over (order by count(*) desc, q) as r from {_F} where value is not null and material is not null and q is not null group by q order by r limit 5"


@add("g16_material_pivot", f"with t as ({_RANKED_Q}) select material, " + ", ".join(f"{sig_sql(f'avg(value) filter (r = {i})')} as top{i}" for i in range(1, 6)) + f" from {_F} f join t on f.q = t.q where value is not null and material is not null group by material")
def g16(spark, d):
    """Mean of each of the five most frequent quantities per material; column topI is the I-th of them."""
    f = facts(spark, d, "item_id", "material", "q", "value").where("value is not null and material is not null and q is not null")
    top = f.groupBy("q").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "q").limit(5)
    r = ranked(top, [], [F.desc("n"), F.col("q")], "r").select("q", F.concat(F.lit("top"), F.col("r")).alias("r"))
    names = [f"top{i}" for i in range(1, 6)]
    return _s(f.join(F.broadcast(r), "q").groupBy("material").pivot("r", names).agg(F.avg("value")), *names)


#: The names of the quantities in the unit table.
QUANTITIES = ["energy_density", "fluence", "grain_size", "laser_power", "mass_density", "porosity", "preheat_temperature", "pulse_duration", "repetition_rate", "scan_speed", "spot_size", "thermal_conductivity", "wavelength", "yield_strength"]


@add("g17_doc_quantity_pivot", "select doc, " + ", ".join(f"count(*) filter (q = '{q}') as {q}" for q in QUANTITIES) + f" from {_F} where q in ({', '.join(repr(q) for q in QUANTITIES)}) group by doc")
def g17(spark, d):
    f = facts(spark, d, "item_id", "doc", "q").where(F.col("q").isin(QUANTITIES))
    return f.groupBy("doc").pivot("q", QUANTITIES).count().fillna(0, QUANTITIES)


@add("g18_material_stats", f"select q, material, {_AVG} as mean, {_SAMP} as std, min(value) as lo, max(value) as hi, count(value) as n from {_F} where value is not null and material is not null group by q, material")
def g18(spark, d):
    f = facts(spark, d, "item_id", "material", "q", "value").where("material is not null")
    return _s(fo.grouped(f, ["q", "material"], "value"), "mean", "std")


@add("g19_contradiction_matrix", "with m as (select method_origin as m, avg(confidence) as a from extracted_values where method_origin is not null group by 1) select x.m as m1, y.m as m2, round(abs(x.a - y.a) / y.a, 9) as diff from m x join m y on x.m <> y.m where y.a <> 0")
def g19(spark, d):
    # the method vocabulary is a closed list, so its square is too
    m = table(spark, d, "extracted_values", "method_origin", "confidence").where("method_origin is not null").groupBy("method_origin").agg(F.avg("confidence").alias("a"))
    x, y = m.select(F.col("method_origin").alias("m1"), F.col("a").alias("a1")), m.select(F.col("method_origin").alias("m2"), F.col("a").alias("a2"))
    return x.join(F.broadcast(y), F.col("m1") != F.col("m2")).where("a2 <> 0").select("m1", "m2", F.round(F.abs(F.col("a1") - F.col("a2")) / F.col("a2"), 9).alias("diff"))


@add("g20_consensus_waterfall", f"select material, q, {_AVG} as mean, {_SAMP} as std, count(*) as n from {_F} where value is not null and material is not null and q is not null group by 1, 2 order by n desc, material, q limit 10")
def g20(spark, d):
    g = facts(spark, d, "item_id", "material", "q", "value").where("value is not null and material is not null and q is not null").groupBy("material", "q").agg(F.avg("value").alias("mean"), fo.sample_std("value").alias("std"), F.count(F.lit(1)).alias("n"))
    return _s(g.orderBy(F.desc("n"), "material", "q").limit(10), "mean", "std")


@add("g21_group_bars", f"select q, coalesce(nullif(material, ''), 'Unknown') as material, count(*) as n, {_AVG} as mean, {_SAMP} as std from {_F} where value is not null group by 1, 2")
def g21(spark, d):
    f = facts(spark, d, "item_id", "q", "material", "value").where("value is not null").withColumn("material", tx.named_or_unknown(F.col("material")))
    return _s(f.groupBy("q", "material").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), fo.sample_std("value").alias("std")), "mean", "std")


@add("g22_cooccurrence", "with s as (select distinct doc_source as doc, physical_quantity as q from facts where physical_quantity in (select physical_quantity from quantity_units)) select x.q as a, y.q as b, count(*) as docs from s x join s y on x.doc = y.doc and x.q < y.q group by 1, 2")
def g22(spark, d):
    known = table(spark, d, "quantity_units", "physical_quantity")
    f = table(spark, d, "facts", "doc_source", "physical_quantity").join(small(known), "physical_quantity", "left_semi")
    return fo.cooccurrence(f, "physical_quantity", "doc_source")


@add("g23_hierarchy_rollup", f"select coalesce(material, '*') as material, coalesce(q, '*') as q, count(*) as n from {_F} where material is not null and q is not null group by rollup (material, q)")
def g23(spark, d):
    f = facts(spark, d, "item_id", "material", "q").where("material is not null and q is not null")
    return f.rollup("material", "q").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("material", F.lit("*")).alias("material"), F.coalesce("q", F.lit("*")).alias("q"), "n")


@add("g24_quartiles", f"select q, round(quantile_cont(confidence, 0.25), 9) as q1, round(quantile_cont(confidence, 0.5), 9) as q2, round(quantile_cont(confidence, 0.75), 9) as q3, min(confidence) as lo, max(confidence) as hi from {_E} where confidence is not null group by 1")
def g24(spark, d):
    """The table of a violin chart."""
    e = values(spark, d, "value_id", "q", "confidence").where("confidence is not null")
    ends = e.groupBy("q").agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return _r(fo.quantiles(e, ["q"], "confidence", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).join(ends, "q"), "q1", "q2", "q3", digits=9)


@add("g24_parallel_categories", "select material, physical_quantity as q, method, doc_source as doc, count(distinct item_id) as n from facts where material is not null and physical_quantity is not null and method is not null group by 1, 2, 3, 4")
def g24_parallel(spark, d):
    f = facts(spark, d, "item_id", "material", "q", "method", "doc").where("material is not null and q is not null and method is not null")
    return f.groupBy("material", "q", "method", "doc").agg(F.count(F.lit(1)).alias("n"))


@add("g24_timeline", f"select year, q, count(*) as n, {_AVG} as mean from (select item_id, q, value, coalesce(try_cast(nullif(regexp_extract(doc, '(?:19|20)[0-9]{{2}}'), '') as int), 2023) as year from {_F} where value is not null and q is not null) group by 1, 2")
def g24_timeline(spark, d):
    """Values by the year in the document's name, 2023 if it has none."""
    f = facts(spark, d, "item_id", "q", "value", "doc").where("value is not null and q is not null")
    year = F.coalesce(F.nullif(F.regexp_extract("doc", "(?:19|20)[0-9]{2}", 0), F.lit("")).try_cast("int"), F.lit(2023))
    return _s(f.groupBy(year.alias("year"), "q").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


@add("g25_concept_documents", "select material, count(distinct doc_source) as docs from facts where material is not null group by 1")
def g25(spark, d):
    return table(spark, d, "facts", "material", "doc_source").where("material is not null").groupBy("material").agg(F.count_distinct("doc_source").alias("docs"))


@add("g26_concept_distillation", "with w as (select source, word from (select distinct source, unnest(regexp_extract_all(lower(content), '[a-z]{4,}')) as word from chunks where content is not null and source is not null)), n as (select count(distinct source) as n from chunks where content is not null and source is not null) select word, count(*) as freq, round(count(*) * ln((1.0 + max(n.n)) / (1.0 + count(*))), 6) as score from w, n group by word")
def g26(spark, d):
    c = table(spark, d, "chunks", "source", "content").where("content is not null and source is not null")
    words = c.select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{4,}"), 0))).alias("word")).distinct()
    n = c.agg(F.count_distinct("source").alias("n"))
    freq = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return freq.join(F.broadcast(n)).select("word", "freq", F.round(F.col("freq") * F.log((1.0 + F.col("n")) / (1.0 + F.col("freq"))), 6).alias("score"))


#: Patterns of the metrics that an abstract states: grain size, strength, energy density, share of defects.
METRICS = {"grain_size": r"([0-9]+(?:\.[0-9]+)?) (?:µm|um|nm)", "strength": r"([0-9]+(?:\.[0-9]+)?) (?:MPa|GPa)", "energy_density": r"([0-9]+(?:\.[0-9]+)?) (?:J/mm3|J/mm³|J/cm2)", "defects": r"([0-9]+(?:\.[0-9]+)?) ?%"}
METRICS_SQL = " union all ".join(f"select paper_id, filename, '{n}' as metric, unnest(regexp_extract_all(abstract, '{p}', 1)) as v from papers" for n, p in METRICS.items())


def metrics(spark, d):
    """(paper_id, filename, metric, value) of the numbers that abstracts state."""
    found = tx.tagged({n: F.regexp_extract_all("abstract", F.lit(p), 1) for n, p in METRICS.items()}, "metric", "value", lambda v: v.try_cast("double"))
    return table(spark, d, "papers", "paper_id", "filename", "abstract").where("abstract is not null").select("paper_id", "filename", F.explode(found).alias("m")).select("paper_id", "filename", "m.metric", "m.value")


@add("g27_concept_median", f"with m as (select filename, try_cast(v as double) as v from ({METRICS_SQL})), c as (select distinct material, doc_source as doc from facts where material is not null and doc_source is not null) select c.material, {sig_sql('coalesce(median(m.v), 0)')} as m, count(m.v) as n from c left join m on c.doc = m.filename group by 1")
def g27(spark, d):
    """Median of all metrics in the abstracts of a material's documents, 0 without any."""
    c = table(spark, d, "facts", "material", F.col("doc_source").alias("filename")).where("material is not null and filename is not null").distinct()
    j = c.join(metrics(spark, d).select("filename", "value"), "filename", "left")
    n = j.groupBy("material").agg(F.count("value").alias("n"))
    return _s(n.join(fo.quantiles(j, ["material"], "value", {"m": 0.5}), "material", "left").fillna(0.0, ["m"]), "m")


@add("g28_exclusive_intersections", "select combo, count(*) as terms from (select material, array_to_string(list_sort(list_distinct(list(method_origin))), '&') as combo from extracted_values where material is not null and method_origin is not null group by 1) group by 1")
def g28(spark, d):
    e = table(spark, d, "extracted_values", "material", "method_origin").where("material is not null and method_origin is not null")
    return fo.exclusive_intersections(e, "material", "method_origin")


_TERMS_SQL = "select distinct method_origin as model, lower(trim(material)) as term from extracted_values where material is not null and method_origin is not null"


def _terms(spark, d):
    """(model, term) once, and how many models hold each term."""
    e = table(spark, d, "extracted_values", F.col("method_origin").alias("model"), F.lower(F.trim("material")).alias("term")).where("model is not null and term is not null").distinct()
    return e, e.groupBy("term").agg(F.count(F.lit(1)).alias("models"))


@add("g29_solo_pair_universal", f"with t as ({_TERMS_SQL}), n as (select term, count(*) as models from t group by 1) select model, count(*) filter (models = 1) as solo, count(*) filter (models = 2) as pairwise, count(*) filter (models >= 3) as universal from t join n using (term) group by 1")
def g29(spark, d):
    e, n = _terms(spark, d)
    m = F.col("models")
    return e.join(n, "term").groupBy("model").agg(F.count_if(m == 1).alias("solo"), F.count_if(m == 2).alias("pairwise"), F.count_if(m >= 3).alias("universal"))


_REFERENCE_SQL = "select distinct lower(canonical_name) as term from materials_ref"


@add("g30_agreement_metrics", f"with t as ({_TERMS_SQL}), n as (select term, count(*) as models from t group by 1), r as ({_REFERENCE_SQL}) select model, count(*) as terms, count(*) filter (models > 1) * 100.0 / count(*) as consensus_yield, (count(*) - count(*) filter (t.term = 'unknown')) * 100.0 / count(*) as schema_strict, round(100.0 * count(r.term) / any_value((select count(*) from r)), 9) as ref_coverage, case when count(*) filter (models = 1) = 0 then 100.0 else greatest(0.0, 100.0 - 15 * count(*) filter (models = 1)) end as no_singleton, 100.0 as top2 from t join n using (term) left join r on t.term = r.term group by 1")
def g30(spark, d):
    e, n = _terms(spark, d)
    r = table(spark, d, "materials_ref", F.lower("canonical_name").alias("term")).distinct().withColumn("listed", F.lit(1))
    size = r.agg(F.count(F.lit(1)).alias("size"))
    g = e.join(n, "term").join(small(r), "term", "left").groupBy("model").agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("models") > 1).alias("shared"), F.count_if(F.col("term") == "unknown").alias("unknown"), F.count("listed").alias("listed"), F.count_if(F.col("models") == 1).alias("solo"))
    share = lambda c: c * 100.0 / F.col("terms")
    return g.join(F.broadcast(size)).select("model", "terms", share(F.col("shared")).alias("consensus_yield"), share(F.col("terms") - F.col("unknown")).alias("schema_strict"), F.round(100.0 * F.col("listed") / F.col("size"), 9).alias("ref_coverage"), F.when(F.col("solo") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 15 * F.col("solo"))).alias("no_singleton"), F.lit(100.0).alias("top2"))


@add("g31_consensus_terms", "with e as (select lower(trim(material)) as term, method_origin as model, count(distinct value_id) as n from extracted_values where material is not null and method_origin is not null group by 1, 2) select term, coalesce(any_value(r.material_class), 'Other') as category, count(*) as models, max(n) as most from e left join (select lower(canonical_name) as t, min(material_class) as material_class from materials_ref group by 1) r on e.term = r.t group by term having count(*) >= 2")
def g31(spark, d):
    """Terms of at least two models by category, the most frequent first."""
    e = table(spark, d, "extracted_values", "value_id", F.col("method_origin").alias("model"), F.lower(F.trim("material")).alias("term")).where("model is not null and term is not null")
    g = e.groupBy("term", "model").agg(F.count_distinct("value_id").alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("models"), F.max("n").alias("most")).where("models >= 2")
    r = table(spark, d, "materials_ref", F.lower("canonical_name").alias("term"), "material_class").groupBy("term").agg(F.min("material_class").alias("category"))
    return g.join(small(r), "term", "left").fillna("Other", ["category"]).orderBy("category", F.desc("most"), "term")


@add("g32_agreement_heatmap", "select doc_name, material, count(distinct method_origin) as models from extracted_values where material is not null group by 1, 2")
def g32(spark, d):
    return table(spark, d, "extracted_values", "doc_name", "material", "method_origin").where("material is not null").groupBy("doc_name", "material").agg(F.count_distinct("method_origin").alias("models"))


@add("g33_agreement_levels", "with t as (select material, count(*) as n, count(distinct method_origin) as agreement from (select distinct value_id, material, method_origin from extracted_values) where material is not null group by 1 order by n desc, material limit 50) select k, count(*) as materials from t, range(1, 5) r(k) where agreement >= k group by k")
def g33(spark, d):
    e = values(spark, d, "value_id", "material", "method_origin").where("material is not null")
    top = e.groupBy("material").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("method_origin").alias("agreement")).orderBy(F.desc("n"), "material").limit(50)
    return top.where("agreement > 0").select(F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.col("agreement").cast("int")))).alias("k")).groupBy(F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("materials"))


@add("g35_knowledge_summary", f"select 'facts' as kind, null as name, count(*) as n from {_F} union all select 'documents', null, count(distinct doc) from {_F} union all select 'materials', null, count(distinct material) from {_F} union all select 'quantities', null, count(distinct q) from {_F} union all select 'item_type', item_type, count(*) from {_F} where item_type is not null group by item_type union all select * from (select 'top_material', material, count(*) as n from {_F} where material is not null group by material order by n desc, material limit 15) union all select * from (select 'top_quantity', q, count(*) as n from {_F} where q is not null group by q order by n desc, q limit 15)")
def g35(spark, d):
    """Totals, items by type and the fifteen most frequent materials and quantities."""
    f = facts(spark, d, "item_id", "item_type", "doc", "material", "q")
    t = f.agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("doc").alias("documents"), F.count_distinct("material").alias("materials"), F.count_distinct("q").alias("quantities"))
    totals = t.unpivot([], t.columns, "kind", "n").select("kind", F.lit(None).cast("string").alias("name"), "n")

    def counts(kind, column, top=None):
        g = f.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
        return g.orderBy(F.desc("n"), "name").limit(top) if top else g

    return totals.unionByName(counts("item_type", "item_type")).unionByName(counts("top_material", "material", 15)).unionByName(counts("top_quantity", "q", 15))


@add("g39_chunks_per_document", "select source, count(distinct chunk_id) as chunks from chunks group by 1")
def g39(spark, d):
    return table(spark, d, "chunks", "source", "chunk_id").groupBy("source").agg(F.count_distinct("chunk_id").alias("chunks"))


@add("g41_fact_dedupe", "select content, doc_source, material, item_id from (select *, row_number() over (partition by content, doc_source, material, page order by confidence desc nulls last, item_id) as rn from facts) where rn = 1")
def g41(spark, d):
    f = table(spark, d, "facts", "content", "doc_source", "page", "material", "item_id", "confidence")
    return fo.deduplicated(f, ["content", "doc_source", "page", "material"], "confidence", "item_id").select("content", "doc_source", "material", "item_id")


@add("g43_material_distribution", f"select coalesce(m.material_class, 'other') as category, count(*) as mentions, count(distinct doc) as docs, round(count(*) * 1.0 / count(distinct doc), 9) as per_doc from {_F} f left join (select canonical_name, min(material_class) as material_class from materials_ref group by 1) m on f.material = m.canonical_name where material is not null and doc is not null group by 1")
def g43(spark, d):
    m = table(spark, d, "materials_ref", F.col("canonical_name").alias("material"), "material_class").groupBy("material").agg(F.min("material_class").alias("category"))
    f = facts(spark, d, "item_id", "material", "doc").where("material is not null and doc is not null").join(small(m), "material", "left").fillna("other", ["category"])
    g = f.groupBy("category").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc").alias("docs"))
    return g.withColumn("per_doc", F.round(F.col("mentions") / F.col("docs"), 9)).orderBy(F.desc("mentions"), "category")


@add("g44_method_distribution", f"select method, section_title, count(*) as n from {_F} group by 1, 2")
def g44(spark, d):
    return facts(spark, d, "item_id", "method", "section_title").groupBy("method", "section_title").agg(F.count(F.lit(1)).alias("n"))


@add("g46_treemap_sizes", f"select q, material, count(*) as n from {_F} where q is not null and material is not null group by 1, 2")
def g46(spark, d):
    return facts(spark, d, "item_id", "q", "material").na.drop(subset=["q", "material"]).groupBy("q", "material").agg(F.count(F.lit(1)).alias("n"))


@add("g47_composition_consistency", "select material_id, total, case when total > 10 then 'HIGH' else 'LOW' end as level from (select material_id, sum(try_cast(n as double)) as total from (select material_id, unnest(regexp_extract_all(canonical_name, '[A-Z][a-z]?([0-9]+)', 1)) as n from materials_ref) group by 1) where total > 5")
def g47(spark, d):
    parts = table(spark, d, "materials_ref", "material_id", "canonical_name").select("material_id", F.explode(F.regexp_extract_all("canonical_name", F.lit("[A-Z][a-z]?([0-9]+)"), 1)).alias("n"))
    g = parts.groupBy("material_id").agg(F.sum(F.col("n").try_cast("double")).alias("total")).where("total > 5")
    return g.withColumn("level", F.when(F.col("total") > 10, "HIGH").otherwise("LOW"))


def _wide_sql(names):
    return ", ".join(f"avg(value) filter (q = '{q}') as {q}" for q in names)


_LASER = ["laser_power", "fluence", "pulse_duration", "repetition_rate", "spot_size", "energy_density"]


@add("g47_energy_consistency", f"with w as (select doc, {_wide_sql(_LASER)} from {_E} where value > 0 and doc is not null group by 1), e as (select doc, laser_power as p, fluence * 3.141592653589793 / 4 * pow(spot_size * 1e-4, 2) as energy, repetition_rate * 1000 as f, fluence, pulse_duration * 1e-9 as t from w) select doc, coalesce(abs(energy * f - p) / p > 0.1, false) as energy_off, coalesce(energy / t > 1e15, false) as peak_off, coalesce(abs(fluence / t - energy / t) / nullif(energy / t, 0) > 0.2, false) as fluence_off from e")
def g47_energy(spark, d):
    """Laser parameters of a document against each other: energy times frequency and power, peak power, and fluence over
    pulse duration and intensity; a check whose parameters are not all stated does not fail."""
    w = values(spark, d, "value_id", "q", "doc", "value").where(F.col("q").isin(_LASER) & (F.col("value") > 0)).where("doc is not null").groupBy("doc").pivot("q", _LASER).agg(F.avg("value"))
    all_docs = values(spark, d, "value_id", "doc", "value").where("doc is not null and value > 0").select("doc").distinct()
    w = all_docs.join(w, "doc", "left")
    e = w.select("doc", F.col("laser_power").alias("p"), (F.col("fluence") * 3.141592653589793 / 4 * F.pow(F.col("spot_size") * 1e-4, F.lit(2))).alias("energy"), (F.col("repetition_rate") * 1000).alias("f"), "fluence", (F.col("pulse_duration") * 1e-9).alias("t"))
    false = F.lit(False)
    peak = F.col("energy") / F.col("t")
    return e.select("doc", F.coalesce(F.abs(F.col("energy") * F.col("f") - F.col("p")) / F.col("p") > 0.1, false).alias("energy_off"), F.coalesce(peak > 1e15, false).alias("peak_off"), F.coalesce(F.abs(F.col("fluence") / F.col("t") - peak) / F.nullif(peak, F.lit(0.0)) > 0.2, false).alias("fluence_off"))


@add("g47_phase_rule", f"select alloy_system, count(distinct phase) as phases, len(list_distinct(regexp_extract_all(alloy_system, '[A-Z][a-z]?'))) as components, len(list_distinct(regexp_extract_all(alloy_system, '[A-Z][a-z]?'))) - count(distinct phase) + 2 as freedom, len(list_distinct(regexp_extract_all(alloy_system, '[A-Z][a-z]?'))) - count(distinct phase) + 2 < 0 as violated from {_A} where alloy_system is not null and phase is not null group by 1")
def g47_phase(spark, d):
    p = table(spark, d, "alloy_properties", "alloy_system", "phase").where("alloy_system is not null and phase is not null").groupBy("alloy_system").agg(F.count_distinct("phase").alias("phases"))
    c = F.size(F.array_distinct(F.regexp_extract_all("alloy_system", F.lit("[A-Z][a-z]?"), 0)))
    return p.select("alloy_system", "phases", c.alias("components"), (c - F.col("phases") + 2).alias("freedom"), (c - F.col("phases") + 2 < 0).alias("violated"))


@add("g48_conditions_summary", "select physical_quantity, k, count(distinct v) as vals, min(v) as first, max(v) as last from (select physical_quantity, e.key as k, e.value as v from (select physical_quantity, unnest(map_entries(conditions)) as e from facts)) group by 1, 2")
def g48(spark, d):
    c = table(spark, d, "facts", "physical_quantity", "conditions").select("physical_quantity", F.explode("conditions").alias("k", "v"))
    return c.groupBy("physical_quantity", "k").agg(F.count_distinct("v").alias("vals"), F.min("v").alias("first"), F.max("v").alias("last"))


@add("g48_fused_properties", f"select alloy_system, property_name, n, {sig_sql('mean')} as mean, {sig_sql('std')} as std, {sig_sql('cv')} as cv, lo, hi, unit, case when cv < 0.1 and n >= 2 then 'HIGH' when cv < 0.3 or n = 1 then 'MODERATE' else 'LOW' end as level from (select *, case when mean = 0 then 1.0 else std / abs(mean) end as cv from (select alloy_system, property_name, count(*) as n, avg(normalized_value) as mean, stddev_pop(normalized_value) as std, min(normalized_value) as lo, max(normalized_value) as hi, arg_min(coalesce(unit, ''), property_id) as unit from {_A} where normalized_value is not null group by 1, 2))")
def g48_fused(spark, d):
    p = properties(spark, d, "property_id", "alloy_system", "property_name", "normalized_value", "unit").where("normalized_value is not null")
    f = fo.fused_numeric(p, ["alloy_system", "property_name"], "normalized_value")
    more = p.groupBy(F.col("alloy_system").alias("a"), F.col("property_name").alias("b")).agg(F.min("normalized_value").alias("lo"), F.max("normalized_value").alias("hi"), F.min_by(F.coalesce("unit", F.lit("")), "property_id").alias("unit"))
    j = f.join(more, F.col("alloy_system").eqNullSafe(F.col("a")) & F.col("property_name").eqNullSafe(F.col("b"))).drop("a", "b")
    return _s(j, "mean", "std", "cv")


@add("g48_fused_categories", f"with c as (select alloy_system, property_name, value, count(*) as n from {_A} where normalized_value is null and value is not null group by 1, 2, 3), t as (select *, sum(n) over (partition by alloy_system, property_name) as total, row_number() over (partition by alloy_system, property_name order by n desc, value) as rn from c) select alloy_system, property_name, value as mode, round(n / total, 9) as share, case when n = total then 'HIGH' when n / total > 0.5 then 'MODERATE' else 'LOW' end as level from t where rn = 1")
def g48_categories(spark, d):
    p = properties(spark, d, "property_id", "alloy_system", "property_name", "normalized_value", "value").where("normalized_value is null and value is not null")
    f = fo.fused_categorical(p, ["alloy_system", "property_name"], "value")
    return f.withColumn("level", F.when(F.col("share") == 1, "HIGH").when(F.col("share") > 0.5, "MODERATE").otherwise("LOW")).withColumn("share", F.round("share", 9))


_FRACTIONS = "list_transform(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?) %', 1), lambda x: try_cast(x as double))"


@add("g51_fraction_sum_rule", f"select page_id, round(total, 9) as total, total > 100.1 or (total < 99.9 and captures > 1) as violated from (select page_id, len({_FRACTIONS}) as captures, coalesce(list_sum(list_filter({_FRACTIONS}, lambda x: x < 100)), 0) as total from pages_text where text is not null) where captures > 0")
def g51(spark, d):
    """Sum of the stated fractions below 100; a single fraction may leave the rest unsaid."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?) %"), 1), lambda v: v.try_cast("double"))
    t = table(spark, d, "pages_text", "page_id", "text").where("text is not null").select("page_id", found.alias("v")).where(F.size("v") > 0)
    total = F.aggregate(F.filter("v", lambda v: v < 100), F.lit(0.0), lambda a, x: a + x)
    return t.select("page_id", F.round(total, 9).alias("total"), F.coalesce((total > 100.1) | ((total < 99.9) & (F.size("v") > 1)), F.lit(False)).alias("violated"))


@add("g52_source_type_comparison", f"select q, method, {_AVG} as mean, {_SAMP} as std, count(value) as n from {_F} where method is not null and q is not null group by 1, 2 having count(value) >= 1")
def g52(spark, d):
    f = facts(spark, d, "item_id", "q", "method", "value").where("method is not null and q is not null")
    return _s(fo.grouped(f, ["q", "method"], "value").select("q", "method", "mean", "std", "n"), "mean", "std")


@add("g55_category_breakdown", "select material_class, count(*) as mentions, count(distinct doc_source || '|' || material) as pairs from (select distinct item_id, doc_source, material from facts) f join materials_ref m on f.material = m.canonical_name where doc_source is not null group by 1")
def g55(spark, d):
    m = table(spark, d, "materials_ref", F.col("canonical_name").alias("material"), "material_class")
    f = facts(spark, d, "item_id", "doc", "material").where("doc is not null").join(small(m), "material")
    return f.groupBy("material_class").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc", "material").alias("pairs"))


@add("g56_category_share", "select material_class, count(*) as mentions, material_class = 'nickel' as highlight from (select distinct item_id, material from facts) f join materials_ref m on f.material = m.canonical_name group by 1")
def g56(spark, d):
    m = table(spark, d, "materials_ref", F.col("canonical_name").alias("material"), "material_class")
    g = facts(spark, d, "item_id", "material").join(small(m), "material").groupBy("material_class").agg(F.count(F.lit(1)).alias("mentions"))
    return g.withColumn("highlight", F.col("material_class") == "nickel")


@add("g57_property_means", f"select property_name, {sig_sql('avg(normalized_value)')} as mean, count(normalized_value) as n from {_A} where normalized_value is not null group by 1")
def g57(spark, d):
    p = properties(spark, d, "property_id", "property_name", "normalized_value").where("normalized_value is not null")
    return _s(p.groupBy("property_name").agg(F.avg("normalized_value").alias("mean"), F.count("normalized_value").alias("n")), "mean")


@add("g57_box_rows", f"select property_id, property_name, alloy_system, normalized_value as value from {_A} where normalized_value is not null and lower(property_name) in (select lower(property_name) from {_A} group by 1 order by count(*) desc, 1 limit 6)")
def g57_rows(spark, d):
    """The rows of a box plot of the six most frequent properties."""
    p = properties(spark, d, "property_id", "property_name", "alloy_system", "normalized_value").withColumn("low", F.lower("property_name"))
    top = p.groupBy("low").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "low").limit(6).select("low")
    return p.where("normalized_value is not null").join(F.broadcast(top), "low", "left_semi").select("property_id", "property_name", "alloy_system", F.col("normalized_value").alias("value"))


# ranking, windows and sets (sections 2.7 and 2.8)
@add("w2_top_values", "select material, count(*) as n from (select distinct item_id, material from facts) where material is not null group by 1 order by n desc, material limit 10")
def w2(spark, d):
    return facts(spark, d, "item_id", "material").where("material is not null").groupBy("material").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "material").limit(10)


@add("w3_top_per_category", "select q, material, n from (select *, row_number() over (partition by q order by n desc, material) as rn from (select physical_quantity as q, material, count(*) as n from (select distinct item_id, physical_quantity, material from facts) where physical_quantity is not null and material is not null group by 1, 2)) where rn <= 5")
def w3(spark, d):
    g = facts(spark, d, "item_id", "q", "material").where("q is not null and material is not null").groupBy("q", "material").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(g, ["q"], [F.desc("n"), F.col("material")], 5)


@add("w5_top_confidence", "select item_id, confidence from (select distinct item_id, confidence from facts) where confidence is not null order by confidence desc, item_id limit 10")
def w5(spark, d):
    return facts(spark, d, "item_id", "confidence").where("confidence is not null").orderBy(F.desc("confidence"), "item_id").limit(10)


@add("w6_top_facts_per_doc", "select doc_source as doc, item_id from (select doc_source, item_id, row_number() over (partition by doc_source order by confidence desc nulls last, item_id) as rn from (select distinct doc_source, item_id, confidence from facts)) where rn <= 5")
def w6(spark, d):
    return top_per_key(facts(spark, d, "doc", "item_id", "confidence"), ["doc"], [F.desc_nulls_last("confidence"), F.col("item_id")], 5).select("doc", "item_id")


@add("w7_rank_significance", "select count(*) as edges, round(avg(p), 9) as mean_p, count(*) filter (p < 0.05) as significant from (select n, (count(*) over (order by n desc range between unbounded preceding and current row)) * 1.0 / count(*) over () as p from (select feed, count(*) as n from papers where feed is not null group by 1))")
def w7(spark, d):
    # the feeds are a fixed dimension, so one sorted array holds all their weights
    g = table(spark, d, "papers", "feed").where("feed is not null").groupBy("feed").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list("n").alias("w"))
    p = F.transform("w", lambda x: F.size(F.filter("w", lambda y: y >= x)) / F.size("w"))
    return g.select(F.explode(p).alias("p")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("p"), 9).alias("mean_p"), F.count_if(F.col("p") < 0.05).alias("significant"))


@add("w8_next_boundary", "select page_id, coalesce(lead(page_num) over (partition by filename order by page_num, page_id), 0) as next_page from pages_text")
def w8(spark, d):
    p = shifted(table(spark, d, "pages_text", "page_id", "filename", "page_num"), ["filename"], [F.col("page_num"), F.col("page_id")], "page_num", "next_page")
    return p.select("page_id", F.coalesce("next_page", F.lit(0)).alias("next_page"))


@add("w9_discounted_position", "select item_id, round(1.0 / rn, 9) as rr, round(1.0 / log2(rn + 1), 9) as dcg from (select item_id, row_number() over (partition by doc_source order by confidence desc nulls last, item_id) as rn from (select distinct item_id, doc_source, confidence from facts))")
def w9(spark, d):
    r = ranked(facts(spark, d, "item_id", "doc", "confidence"), ["doc"], [F.desc_nulls_last("confidence"), F.col("item_id")])
    return r.select("item_id", F.round(1.0 / F.col("rank"), 9).alias("rr"), F.round(1.0 / F.log2(F.col("rank") + 1), 9).alias("dcg"))


@add("w12_rank_frequency", "with c as (select material, n, row_number() over (order by n desc, material) as rank from (select material, count(*) as n from (select distinct value_id, material from extracted_values) where material is not null group by 1)) select material, n, rank, (select case when count(*) <= 5 then 0 else max(n) filter (rank = 1) * 1.0 / max(n) filter (rank = 5) end from c) as drop_ratio from c where rank <= 20")
def w12(spark, d):
    """The twenty most frequent terms by rank, with how far the counts drop from the first to the fifth of more than five."""
    e = values(spark, d, "value_id", "material").where("material is not null").groupBy("material").agg(F.count(F.lit(1)).alias("n"))
    top = ranked(e.orderBy(F.desc("n"), "material").limit(20), [], [F.desc("n"), F.col("material")], "rank")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("n")))
    drop = top.agg(F.when(F.count(F.lit(1)) <= 5, 0.0).otherwise(at(1) / at(5)).alias("drop_ratio"))
    return top.join(F.broadcast(drop)).select("material", "n", "rank", "drop_ratio")


@add("w13_sort_forms", "select paper_id, year_guess from papers order by year_guess asc nulls first, paper_id desc limit 50")
def w13(spark, d):
    return table(spark, d, "papers", "paper_id", "year_guess").orderBy(F.asc_nulls_first("year_guess"), F.desc("paper_id")).limit(50)


@add("set_union", "select material as term from facts union select material from extracted_values")
def set_union(spark, d):
    return table(spark, d, "facts", F.col("material").alias("term")).unionByName(table(spark, d, "extracted_values", F.col("material").alias("term"))).distinct()


@add("set_intersect", "select material as term from facts intersect select alloy_system from alloy_properties")
def set_intersect(spark, d):
    return table(spark, d, "facts", F.col("material").alias("term")).intersect(table(spark, d, "alloy_properties", F.col("alloy_system").alias("term")))


@add("set_difference", "select filename as term from papers except select doc_source from facts")
def set_difference(spark, d):
    return table(spark, d, "papers", F.col("filename").alias("term")).subtract(table(spark, d, "facts", F.col("doc_source").alias("term")))


@add("set_distinct", "select distinct * exclude (metadata) from chunks")
def set_distinct(spark, d):
    return table(spark, d, "chunks").drop("metadata").distinct()


QUERIES, ORACLE = C.queries, C.oracle
