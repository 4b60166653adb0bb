import random

from pyspark.sql import functions as F

from lodestone.functions.unit_table import py_key, unit_rows
from lodestone.operators.units import UnitModelParams, converted, fit_unit_model, infer_units, prepare, with_context_unit

UNITS = [("laser_power", "W", "beam power"), ("wavelength", "nm", "laser wavelength"), ("preheat_temperature", "K", "base temperature"), ("yield_strength", "MPa", "proof stress")]
SCHEMA = "table_name string, row_id long, value double, unit string, physical_quantity string, context string, source string"


def frame(spark, rows):
    return spark.createDataFrame([("t", i, *r, "s") for i, r in enumerate(rows)], SCHEMA), spark.createDataFrame(UNITS, "physical_quantity string, base_unit string, other_names string")


def test_table_has_the_usual_units():
    keys = {(q, k) for q, k, *_ in unit_rows()}
    for q, u in [("laser_power", "kW"), ("fluence", "mJ cm^-2"), ("thermal_conductivity", "cal/(cm·s·K)"), ("yield_strength", "kgf/mm²"), ("wavelength", "Å"), ("scan_speed", "m·min⁻¹")]:
        assert (q, py_key(u)) in keys


def test_stated_units(spark):
    rows = [(2.0, "kW", "Beam Power", None), (5.0, "mW", "laser-power", None), (5.0, "MW", "LaserPower", None), (20.0, "degC", "base temperature", None), (1.0, "µm", "wavelength", None), (1.0, "px", "wavelength", None), (3.0, "K", "wavelength", None), (0.0, "kW", "laser_power", None), (None, "kW", "laser_power", None), (7.0, "kW", "colour", None), (7.0, "kW", None, None)]
    df, units = frame(spark, rows)
    got = {r["row_id"]: r["value_base"] for r in converted(prepare(df, units).where("stated_factor is not null"), "stated_factor", "stated_offset").collect()}
    assert got == {0: "2.000e+03", 1: "5.000e-03", 2: "5.000e+06", 3: "2.931e+02", 4: "1.000e+03"}


def test_context_unit(spark):
    rows = [(1300.0, None, "laser_power", "held at 20 kW, later 1,300 W was used"), (82.94, "", "laser_power", "reached 8.294x10^1 kW here"), (6.72e-8, "unknown", "laser_power", "was 6.72 × 10^-8 MW in all"), (5.0, None, "laser_power", "was 5 during the run"), (5.0, None, "laser_power", "was 5 nm wide"), (5.0, None, "laser_power", None), (5.0, None, "laser_power", "x" * 50_000)]
    df, units = frame(spark, rows)
    got = {r["row_id"]: r["ckey"] for r in with_context_unit(prepare(df, units)).collect()}
    assert got == {0: "W", 1: "kW", 2: "MW", 3: None, 4: None, 5: None, 6: None}


def test_classifier_recovers_hidden_units(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(1500):
        kilo = rng.random() < 0.5
        watts = 10 ** rng.uniform(2.0, 3.0)
        value, unit = (round(watts / 1000, 4), "kW") if kilo else (round(watts, 1), "W")
        hide = i % 5 == 0
        truth[i] = unit
        rows.append((value, None if hide else unit, "laser_power", f"used {value} {unit} there"))
    df, units = frame(spark, rows)
    p = prepare(df, units)
    params = UnitModelParams(trees=8, depth=4)
    got = infer_units(with_context_unit(p.where("missing")), fit_unit_model(p, params), params).collect()
    assert len(got) == 300
    right = sum(r["factor"] == (1000.0 if truth[r["row_id"]] == "kW" else 1.0) for r in got)
    assert right >= 0.98 * len(got)
    # with the text withheld the magnitude alone still tells the unit
    blind = p.where("missing").withColumn("context", F.lit(None).cast("string"))
    got = infer_units(with_context_unit(blind), fit_unit_model(p, params), params).collect()
    assert sum(r["factor"] == (1000.0 if truth[r["row_id"]] == "kW" else 1.0) for r in got) >= 0.9 * len(got)


def test_no_labelled_rows(spark):
    df, units = frame(spark, [(1.0, None, "laser_power", None)])
    assert fit_unit_model(prepare(df, units)) is None
