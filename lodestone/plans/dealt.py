"""Queries of the general training-data problems: timestamps (p1) and units (p4)."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.timestamps import DAY_US, estimate_zones, normalise_timestamps, to_utc_micros
from lodestone.operators.units import UnitModel, converted, fit_unit_model, infer_units, prepare, row_hash, with_context_unit
from lodestone.session import cut, small, table

_STAMPS = ["creation_date", "mod_date", "upload_time"]


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "papers", "paper_id", "site_zone", *_STAMPS).unpivot(["paper_id", "site_zone"], _STAMPS, "field_name", "written")
    # uploads are stamped by the ingesting server, whose clock is UTC
    return long.withColumn("zone", F.when(F.col("field_name") != "upload_time", F.col("site_zone")))


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, site_zone, field_name, zone, utc_micros, local) of every readable stamp; ``local`` only if it names no zone."""
    w = normalise_timestamps(_stamps(spark, sf_dir), "written", "zone", local_out="local", site="site_zone")
    return cut(w.where("utc_micros is not null").select("paper_id", "site_zone", "field_name", "zone", "utc_micros", "local").distinct())


def _estimates(stamps: DataFrame) -> DataFrame:
    """Offset history of each site, from changes without zone, their uploads, and creations that name their zone."""
    at = lambda name, field, value: stamps.where(F.col("field_name") == field).groupBy("paper_id").agg(F.min(value).alias(name))
    mods = stamps.where("field_name = 'mod_date' and local is not null").select("paper_id", "site_zone", "local")
    created = at("created", "creation_date", F.when(F.col("local").isNull(), F.col("utc_micros")))
    w = mods.join(at("ingested", "upload_time", "utc_micros"), "paper_id").join(created, "paper_id", "left")
    return estimate_zones(w, "site_zone", "local", "ingested", "created")


def _localised(stamps: DataFrame, estimates: DataFrame) -> DataFrame:
    """Stamps with ``estimated``: the instant of a stamp without zone by the estimated history of its site."""
    e = estimates.where("decision = 'estimated'").select("source", F.col("zone").alias("history"), "first_day", "last_day")
    day = F.floor(F.col("local") / DAY_US)
    w = stamps.join(small(e), F.col("site_zone").eqNullSafe(F.col("source")) & day.between(F.col("first_day"), F.col("last_day")) & (F.col("field_name") != "upload_time"), "left")
    return w.withColumn("estimated", F.when(F.col("history").isNotNull(), to_utc_micros(F.col("local"), F.coalesce("history", F.lit("UTC")))))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp without zone is local at the zone that its site names, or UTC if the site names none. Where the site's name
    is none of the tz database, the rule names no zone; there the estimated history of the site decides, and UTC without one."""
    stamps = _instants(spark, sf_dir)
    unknown = F.col("site_zone").isNotNull() & ~F.col("site_zone").isin(sorted(available_timezones()))
    odd = stamps.where(unknown)
    found = stamps.where(~unknown).select("paper_id", "field_name", "utc_micros")
    if not odd.isEmpty():
        w = _localised(odd, _estimates(odd))
        found = found.unionByName(w.select("paper_id", "field_name", F.coalesce("estimated", "utc_micros").alias("utc_micros")))
    return found.distinct()


def p1_zone_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated histories of all sites, as if their zones had not been declared."""
    return _estimates(_instants(spark, sf_dir))


def p1_zone_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site: its stamps without zone and how many come out as the declared zone has them if the zone is estimated."""
    stamps = _instants(spark, sf_dir)
    w = _localised(stamps, _estimates(stamps)).where("local is not null and field_name <> 'upload_time'")
    return w.groupBy("site_zone").agg(F.count(F.lit(1)).alias("n"), F.count("estimated").alias("estimated"), F.count_if(F.col("estimated") == F.col("utc_micros")).alias("right"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = ["value", "unit", "physical_quantity", "context"]
    f = table(spark, sf_dir, "facts", "item_id", "method", *common).select(F.lit("facts").alias("table_name"), F.col("item_id").alias("row_id"), *common, F.col("method").alias("source"))
    e = table(spark, sf_dir, "extracted_values", "value_id", "method_origin", *common).select(F.lit("extracted_values").alias("table_name"), F.col("value_id").alias("row_id"), *common, F.col("method_origin").alias("source"))
    return f.unionByName(e)


def _p4_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, UnitModel | None, DataFrame]:
    """(prepared rows, model, rows without unit and the unit predicted for each)."""
    prepared = prepare(_measured(spark, sf_dir), table(spark, sf_dir, "quantity_units"))
    model = fit_unit_model(prepared)
    missing = with_context_unit(prepared.where("missing"))
    if model is None:  # no unit is stated anywhere, so nothing can be learned and the text alone decides
        p = F.when(F.col("context_factor").isNotNull(), 1.0).otherwise(0.0)
        alone = missing.select("table_name", "row_id", "quantity", "value", F.col("context_factor").alias("factor"), F.col("context_offset").alias("offset"), p.alias("p"), "context_factor", "context_offset")
        return prepared, None, alone.withColumn("decision", F.when(F.col("p") == 1, "convert").otherwise("review"))
    return prepared, model, infer_units(missing, model)


def _stated(prepared: DataFrame) -> DataFrame:
    return converted(prepared.where("stated_factor is not null and unit <> base_unit"), "stated_factor", "stated_offset")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated units are converted; predicted ones only where the text names the same unit after the value."""
    prepared, _, inferred = _p4_parts(spark, sf_dir)
    sure = inferred.where("decision = 'convert' and factor = context_factor and offset = context_offset")
    return _stated(prepared).unionByName(converted(sure, "factor", "offset")).distinct()


def p4_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values that come out in the base unit: also those whose unit only the classifier tells, as the text is silent."""
    prepared, _, inferred = _p4_parts(spark, sf_dir)
    sure = converted(inferred.where("decision = 'convert'"), "factor", "offset")
    return _stated(prepared).withColumn("by", F.lit("stated")).unionByName(sure.withColumn("by", F.lit("predicted"))).distinct()


def p4_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value without unit: the predicted conversion, its calibrated probability and whether it needs review."""
    return _p4_parts(spark, sf_dir)[2].select("table_name", "row_id", "quantity", "factor", "p", "decision")


def p4_hidden_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per quantity on values whose stated unit and text are withheld; rows the model was fitted on are left out."""
    prepared, model, _ = _p4_parts(spark, sf_dir)
    if model is None:
        return spark.createDataFrame([], "quantity string, n long, converted long, right long")
    known = prepared.where("stated_factor is not null").where((row_hash() > model.last) | (F.pmod(row_hash(), F.lit(10)) >= 8))
    blind = known.withColumns({"context_factor": F.lit(None).cast("double"), "context_offset": F.lit(None).cast("double")})
    truth = known.select("table_name", "row_id", "value", F.col("stated_factor").alias("f"), F.col("stated_offset").alias("o")).distinct()
    got = infer_units(blind, model).join(truth, ["table_name", "row_id", "value"])
    sure = F.col("decision") == "convert"
    return got.groupBy("quantity").agg(F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("converted"), F.count_if(sure & (F.col("factor") == F.col("f")) & (F.col("offset") == F.col("o"))).alias("right"))


QUERIES = {"p1_found": p1_found, "p1_zone_estimates": p1_zone_estimates, "p1_zone_agreement": p1_zone_agreement, "p4_found": p4_found, "p4_converted": p4_converted, "p4_review": p4_review, "p4_hidden_units": p4_hidden_units}
ORACLE: dict[str, str] = {}
