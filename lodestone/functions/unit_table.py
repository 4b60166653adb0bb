"""Alias table of measurement units, built by rule from unit factors and writing styles."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length units in metres, time units in seconds, energies in joules, powers in watts and so on.
LENGTH = {"m": 1.0, "cm": 1e-2, "mm": 1e-3, "um": 1e-6, "nm": 1e-9, "pm": 1e-12, "in": 0.0254, "ft": 0.3048}
TIME = {"s": 1.0, "sec": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "ps": 1e-12, "fs": 1e-15, "min": 60.0, "h": 3600.0}
ENERGY = {"J": 1.0, "mJ": 1e-3, "uJ": 1e-6, "nJ": 1e-9, "kJ": 1e3, "MJ": 1e6, "cal": 4.184, "kcal": 4184.0}
POWER = {"W": 1.0, "mW": 1e-3, "uW": 1e-6, "kW": 1e3, "MW": 1e6, "GW": 1e9}
MASS = {"g": 1e-3, "mg": 1e-6, "kg": 1.0, "lb": 0.45359237, "t": 1e3}
PRESSURE = {"Pa": 1.0, "hPa": 1e2, "kPa": 1e3, "MPa": 1e6, "GPa": 1e9, "bar": 1e5, "mbar": 1e2, "psi": 6894.757293168, "ksi": 6894757.293168, "atm": 101325.0, "N/mm2": 1e6, "N/m2": 1.0, "MN/m2": 1e6, "kN/mm2": 1e9, "kgf/mm2": 9.80665e6, "kgf/cm2": 98066.5}
FREQUENCY = {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9, "mHz": 1e-3, "1/s": 1.0, "s-1": 1.0, "1/ms": 1e3, "kilohertz": 1e3, "hertz": 1.0, "megahertz": 1e6, "gigahertz": 1e9}
RATIO = {"%": 1.0, "percent": 1.0, "per cent": 1.0, "pct": 1.0, "vol%": 1.0, "vol.%": 1.0, "vol %": 1.0, "vol. %": 1.0, "fraction": 100.0, "vol. fraction": 100.0, "volume fraction": 100.0, "ppm": 1e-4, "ppb": 1e-7, "‰": 0.1, "permille": 0.1, "per mille": 0.1}
LENGTH_WORDS = {"metre": 1.0, "meter": 1.0, "centimetre": 1e-2, "centimeter": 1e-2, "millimetre": 1e-3, "millimeter": 1e-3, "micrometre": 1e-6, "micrometer": 1e-6, "micron": 1e-6, "nanometre": 1e-9, "nanometer": 1e-9, "picometre": 1e-12, "angstrom": 1e-10, "ångström": 1e-10, "inch": 0.0254, "mil": 2.54e-5, "thou": 2.54e-5}
TIME_WORDS = {"second": 1.0, "millisecond": 1e-3, "microsecond": 1e-6, "nanosecond": 1e-9, "picosecond": 1e-12, "femtosecond": 1e-15}
POWER_WORDS = {"watt": 1.0, "milliwatt": 1e-3, "kilowatt": 1e3, "megawatt": 1e6, "gigawatt": 1e9, "microwatt": 1e-6}
PRESSURE_WORDS = {"pascal": 1.0, "kilopascal": 1e3, "megapascal": 1e6, "gigapascal": 1e9}
TEMPERATURE = {"K": (1.0, 0.0), "kelvin": (1.0, 0.0), "kelvins": (1.0, 0.0), **{x: (1.0, 273.15) for x in ("°C", "degC", "deg C", "deg. C", "Celsius", "celsius", "℃", "degrees Celsius", "degree Celsius")}, **{x: (5 / 9, 459.67 * 5 / 9) for x in ("°F", "degF", "deg F", "deg. F", "Fahrenheit", "fahrenheit", "℉", "degrees Fahrenheit")}}

#: The kind of unit each quantity is measured in and the factor of its base unit.
QUANTITY_KIND = {
    "laser_power": ("power", 1.0), "scan_speed": ("speed", 1e-3), "pulse_duration": ("time", 1e-9), "spot_size": ("length", 1e-6), "wavelength": ("length", 1e-9),
    "fluence": ("areal_energy", 1e4), "yield_strength": ("pressure", 1e6), "preheat_temperature": ("temperature", 1.0), "thermal_conductivity": ("conductivity", 1.0),
    "grain_size": ("length", 1e-6), "repetition_rate": ("frequency", 1e3), "porosity": ("ratio", 1.0), "energy_density": ("volume_energy", 1e9), "mass_density": ("density", 1e3),
}

_FROM = "µμÅ⁰¹²³⁴⁵⁶⁷⁸⁹⁻−‐‑–·⋅∙*×[](){}^   _"
_TO = "uuÅ0123456789-----     "
#: The characters after the last one of _TO are deleted by translate(); blanks are restored from them first.
_BLANKS = "   _"


def unit_key(text: Column) -> Column:
    """Comparable spelling of a unit: one mu, plain exponents, no brackets, no leading ``in``, single blanks."""
    s = F.regexp_replace(text, f"[{_BLANKS}]", " ")
    s = F.translate(s, _FROM, _TO)
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"^(?:in|unit:?|measured in) (?=\S)", "")
    return F.regexp_replace(s, r" ?/ ?", "/")


def py_key(text: str) -> str:
    """``unit_key`` for one Python string; used to build the table."""
    for b in _BLANKS:
        text = text.replace(b, " ")
    table = {ord(a): (_TO[i] if i < len(_TO) else None) for i, a in enumerate(_FROM)}
    return " ".join(text.translate(table).split()).replace(" / ", "/").replace("/ ", "/").replace(" /", "/")


def _ratios(num: dict, den: dict, power: int) -> dict[str, float]:
    p = "" if power == 1 else str(power)
    out = {}
    for a, fa in num.items():
        for b, fb in den.items():
            value = fa / fb**power
            for form in (f"{a}/{b}{p}", f"{a} {b}-{power}", f"{a} per {b}{p}", f"{a}{b}-{power}"):
                out[form] = value
    return out


@lru_cache(1)
def unit_rows() -> tuple[tuple[str, str, str, float, float], ...]:
    """(quantity, key, lower_key, factor, offset): value_base = value * factor + offset."""
    plural = lambda words: {**words, **{w + "s": f for w, f in words.items()}, "inches": 0.0254} if "inch" in words else {**words, **{w + "s": f for w, f in words.items()}}
    lengths = {k: v for k, v in LENGTH.items() if k not in ("in", "ft")}
    conductivity = {}
    for w, fw in {**POWER, "cal/s": 4.184}.items():
        for m, fm in {k: LENGTH[k] for k in ("m", "cm", "mm")}.items():
            for k in ("K", "°C", "degC"):
                for form in (f"{w}/{m} {k}", f"{w}/{m}{k}", f"{w} {m}-1 {k}-1", f"{w}/{m}/{k}", f"{w}{m}-1{k}-1"):
                    conductivity[form] = fw / fm
    for m, fm in {k: LENGTH[k] for k in ("m", "cm", "mm")}.items():
        for form in (f"cal/{m} s K", f"cal/s {m} K", f"cal {m}-1 s-1 K-1", f"cal s-1 {m}-1 K-1"):
            conductivity[form] = 4.184 / fm
    kinds: dict[str, dict[str, tuple[float, float]]] = {
        "power": {**POWER, **plural(POWER_WORDS)},
        "speed": {**_ratios(LENGTH, TIME, 1), "ipm": 0.0254 / 60, "fpm": 0.3048 / 60, "inch/min": 0.0254 / 60},
        "time": {**{k: v for k, v in TIME.items() if k not in ("h",)}, **plural(TIME_WORDS)},
        "length": {**lengths, "Å": 1e-10, "Å": 1e-10, **plural(LENGTH_WORDS)},
        "areal_energy": _ratios(ENERGY, lengths, 2),
        "volume_energy": _ratios(ENERGY, lengths, 3),
        "pressure": {**PRESSURE, **_ratios({"N": 1.0, "kN": 1e3, "MN": 1e6, "kgf": 9.80665}, lengths, 2), **plural(PRESSURE_WORDS)},
        "conductivity": conductivity,
        "frequency": FREQUENCY,
        "ratio": RATIO,
        "density": {**_ratios(MASS, {**lengths, "ft": 0.3048, "in": 0.0254}, 3), **{f"{a}/{b}": f for a, f in (("g", 1e3), ("kg", 1e6), ("mg", 1.0)) for b in ("cc", "ccm", "mL", "ml")}, "g/L": 1.0, "kg/L": 1e3, "g/l": 1.0},
    }
    rows = []
    for quantity, (kind, base) in QUANTITY_KIND.items():
        forms = {k: (v / base, 0.0) for k, v in kinds[kind].items()} if kind != "temperature" else TEMPERATURE
        keyed = {py_key(k): v for k, v in forms.items()}
        lower: dict[str, set] = {}
        for k, v in keyed.items():
            lower.setdefault(k.lower(), set()).add(v)
        for k, (f, o) in keyed.items():
            # a factor such as 1e-3/1e-9 is rounded to 15 digits, so that it is the decimal the unit means
            rows.append((quantity, k, k.lower() if len(lower[k.lower()]) == 1 else None, float(f"{f:.15g}"), float(f"{o:.15g}")))
    return tuple(rows)


def unit_pattern() -> str:
    """One alternation of every known unit key, longest first, for matching at the start of a text."""
    keys = sorted({k for _, k, _, _, _ in unit_rows()} | {x for _, _, x, _, _ in unit_rows() if x and len(x) > 2}, key=lambda k: (-len(k), k))
    return "(?:" + "|".join("\\Q" + k + "\\E" for k in keys) + ")"
