"""Timestamps in mixed formats and zones, normalised to UTC microseconds.

The written form is rewritten to one canonical field list inside the JVM (one ``regexp_replace`` per format, chosen by
``rlike``), so no Python runs per row and the plan has no shuffle: the only join is with a broadcast dimension of zone
abbreviations whose size is fixed by the time-zone database.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, ship

DAY_US = 86_400_000_000

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[A-Za-z]+/[A-Za-z_/+-]+|[A-Z]{2,5})"
#: name, pattern, order of the canonical fields year|month|day|hour|minute|second|fraction|am-pm|zone
_FORMATS: tuple[tuple[str, str, str], ...] = (
    ("pdf", r"^[Dd]:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Zz]|[+-]\d{2}'?\d{2}'?)?(?:(?<=[Zz])00'00'?)?$", "$1|$2|$3|$4|$5|$6|||$7"),
    ("iso", rf"^(\d{{4}})-(\d{{2}})(?:-(\d{{2}}))?(?:[Tt ]{_TIME})?\s*{_ZONE}?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", r"^((?:19|20)\d{2})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("slash_md", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_TIME} ?([AaPp][Mm])?)?(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_TIME})?(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("rfc", rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}})(?:,? {_TIME})?(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("ctime", rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) +(\d{{1,2}}) {_TIME}(?: {_ZONE})? (\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    ("prose", rf"^([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}})(?:,? {_TIME} ?([AaPp][Mm])?)?(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


@lru_cache(1)
def zone_abbreviations(first: int = 1990, last: int = 2035) -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, offset in seconds) in use at each zone of the tz database between two years."""
    out = {}
    for name in sorted(available_timezones()):
        try:
            zone = ZoneInfo(name)
        except Exception:  # noqa: BLE001 - a zone the installation lacks
            continue
        for year in range(first, last, 3):
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=UTC).astimezone(zone)
                if (abbr := at.tzname()) and abbr.isalpha():
                    out[name, abbr] = int(at.utcoffset().total_seconds())
    return tuple((z, a, o) for (z, a), o in out.items())


#: Meaning of an abbreviation where the site's zone does not use it or is unknown (seconds).
DEFAULT_ABBREVIATIONS = {"UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800, "IST": 19800, "JST": 32400, "AEST": 36000, "AEDT": 39600, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200}


def clean(text: Column) -> Column:
    """Trimmed text with single blanks and plain minus signs."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[\s\u00a0\u202f]+", " ")), "\u2212", "-")


def canonical_fields(s: Column, month_first: Column) -> Column:
    """The written fields as ``year|month|day|hour|minute|second|fraction|am-pm|zone``; null if no format fits."""
    canon = F.lit(None).cast("string")
    for name, pattern, order in reversed(_FORMATS):
        if name == "slash_md":
            dm = order.replace("$3|$1|$2", "$3|$2|$1")
            value = F.when(month_first, F.regexp_replace(s, pattern, order)).otherwise(F.regexp_replace(s, pattern, dm))
        else:
            value = F.regexp_replace(s, pattern, order)
        canon = F.when(s.rlike(pattern), value).otherwise(canon)
    return canon


def epoch_micros(s: Column) -> Column:
    """Micros of a bare epoch number, its unit told by the number of digits."""
    digits = F.length(s)
    n = F.when(s.rlike(r"^-?\d+$"), s.try_cast("long"))
    return F.when(digits.between(9, 11), n * 1_000_000).when(digits.between(12, 13), n * 1_000).when(digits.between(15, 17), n).when(digits.between(18, 19), F.floor(n / F.lit(1000).cast("decimal(4,0)")).cast("long"))


def _part(p: Column, i: int) -> Column:
    return F.split_part(p, F.lit("|"), F.lit(i + 1))


def _field(p: Column, i: int, default: int) -> Column:
    v = _part(p, i)
    return F.when(v == "", F.lit(default)).otherwise(v.try_cast("int"))


def _with_local_micros(w: DataFrame, fields: str, out: str) -> DataFrame:
    """Micros of the written local time as if it were UTC; null for impossible dates or times.

    The steps are separate projections, so that each field is evaluated once and generated code stays small.
    """
    p = F.col(fields)
    w = w.withColumns({"__ts_mon": _part(p, 1), "__ts_y": _field(p, 0, 0), "__ts_d": _field(p, 2, 1), "__ts_h": _field(p, 3, 0), "__ts_mi": _field(p, 4, 0), "__ts_s2": _field(p, 5, 0), "__ts_ap": F.upper(_part(p, 7)), "__ts_fr": F.substring(F.rpad(_part(p, 6), 6, "0"), 1, 6).try_cast("int")})
    w = w.withColumn("__ts_at", F.instr(F.lit(_MONTHS), F.lower(F.substring("__ts_mon", 1, 3))))
    named = F.when((F.col("__ts_at") > 0) & ((F.col("__ts_at") - 1) % 3 == 0), ((F.col("__ts_at") - 1) / 3 + 1).cast("int"))
    twelve = F.when(F.col("__ts_h").between(1, 12), F.col("__ts_h") % 12)
    w = w.withColumns({
        "__ts_m": F.when(F.col("__ts_mon").rlike("^[A-Za-z]"), named).when(F.col("__ts_mon") == "", F.lit(1)).otherwise(F.col("__ts_mon").try_cast("int")),
        "__ts_h": F.when(F.col("__ts_ap") == "AM", twelve).when(F.col("__ts_ap") == "PM", twelve + 12).otherwise(F.col("__ts_h")),
    })
    y, m, d = F.col("__ts_y"), F.col("__ts_m"), F.col("__ts_d")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    month_days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    w = w.withColumn("__ts_ok", y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= month_days) & F.col("__ts_h").between(0, 23) & F.col("__ts_mi").between(0, 59) & F.col("__ts_s2").between(0, 59))
    # days since the epoch of a Gregorian date, counting years from March
    w = w.withColumns({"__ts_yy": F.when(m <= 2, y - 1).otherwise(y), "__ts_mm": (m + 9) % 12})
    yy = F.col("__ts_yy")
    days = yy * 365 + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + F.floor((F.col("__ts_mm") * 306 + 5) / 10) + d - 1 - 719468
    clock = (F.col("__ts_h") * 3600 + F.col("__ts_mi") * 60 + F.col("__ts_s2")).cast("long") * 1_000_000 + F.coalesce(F.col("__ts_fr"), F.lit(0))
    w = w.withColumn(out, F.when(F.col("__ts_ok"), days.cast("long") * DAY_US + clock))
    return w.drop("__ts_mon", "__ts_y", "__ts_d", "__ts_h", "__ts_mi", "__ts_s2", "__ts_ap", "__ts_fr", "__ts_at", "__ts_m", "__ts_ok", "__ts_yy", "__ts_mm")


def to_utc_micros(local: Column, zone: Column) -> Column:
    """Micros of a local time in ``zone``: the first of two occurrences; a skipped time moves on by the gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def normalise_timestamps(df: DataFrame, text: str, zone: str | None = None, out: str = "utc_micros", local_out: str | None = None, site: str | None = None) -> DataFrame:
    """Add ``out`` (long): microseconds since 1970-01-01 UTC of the timestamp written in ``text``.

    A time without zone is local at ``zone`` (a column of tz names; null or unknown names mean UTC; no column: UTC).
    An abbreviation means what it means at that zone, else its common meaning. Missing month or day is the first,
    missing time is midnight, digits finer than microseconds are cut off. ``site`` names another column of zones that
    tells abbreviations and the order of slashed dates, where these are not those of ``zone``. Slashed dates are month-first where the zone
    starts with ``America/``, else day-first. Null, empty, placeholder and impossible values give null; so does a row of
    an empty table. ``local_out`` also keeps the written local time of values that name no zone. Columns of any other
    name are passed through, also those named like the operator's working columns; a column named ``out`` is replaced.
    """
    spark = df.sparkSession
    kept = {c: f"__keep{i}" for i, c in enumerate(df.columns) if c.startswith("__ts_") and c not in (text, zone, site)}
    df = df.withColumnsRenamed(kept)
    known = sorted(available_timezones())

    def named(column: str | None) -> Column:
        return F.when(F.col(f"`{column}`").isin(known), F.col(f"`{column}`")).otherwise(F.lit("UTC")) if column else F.lit("UTC")

    w = df.withColumn("__ts_site", named(site or zone)).withColumn("__ts_zone", named(zone))
    w = w.withColumn("__ts_s", clean(F.col(f"`{text}`")))
    w = w.withColumn("__ts_f", canonical_fields(F.col("__ts_s"), F.col("__ts_site").startswith("America/")))
    p = F.col("__ts_f")
    w = _with_local_micros(w, "__ts_f", "__ts_local").withColumn("__ts_z", F.coalesce(_part(p, 8), F.lit("")))
    dim = spark.createDataFrame(list(zone_abbreviations()), "__ts_az string, __ts_aa string, __ts_ao int")
    w = w.join(F.broadcast(dim), (F.col("__ts_site") == F.col("__ts_az")) & (F.col("__ts_z") == F.col("__ts_aa")), "left")
    z = F.col("__ts_z")
    common = F.create_map(*[F.lit(x) for kv in DEFAULT_ABBREVIATIONS.items() for x in kv])
    digits = F.regexp_replace(z, "[^0-9]", "")
    off = (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60) * F.when(z.startswith("-"), -1).otherwise(1)
    seconds = F.when(z.isin("Z", "z"), F.lit(0)).when(z.rlike(r"^[+-]\d"), off).otherwise(F.coalesce(F.col("__ts_ao"), F.try_element_at(common, z)))
    local = F.col("__ts_local")
    utc = (
        F.when(z == "", to_utc_micros(local, F.col("__ts_zone")))
        .when(z.contains("/"), F.when(z.isin(known), to_utc_micros(local, F.when(z.isin(known), z).otherwise("UTC"))))
        .otherwise(local - seconds.cast("long") * 1_000_000)
    )
    w = w.withColumn(out, F.coalesce(epoch_micros(F.col("__ts_s")), utc))
    if local_out:
        w = w.withColumn(local_out, F.when(z == "", local))
    w = w.drop("__ts_site", "__ts_zone", "__ts_s", "__ts_f", "__ts_local", "__ts_z", "__ts_az", "__ts_aa", "__ts_ao")
    return w.withColumnsRenamed({v: k for k, v in kept.items()})


#: Offsets are told apart in quarters of an hour, from 14 hours west to 15 hours east.
_QUARTER_US, _WEST, _EAST = 900_000_000, -56, 60
_REGIONS = ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "UTC")


@lru_cache(4)
def offset_histories(first_day: int, last_day: int) -> tuple[tuple[str, ...], np.ndarray]:
    """Names and offsets (in quarters of an hour, one column per local day) of all different offset histories of the tz
    database between two days since 1970. Zones that agree on every day are one history, named by the first of them; those
    of most zones come first."""

    def offset(zone: ZoneInfo, day: int) -> int:
        noon = datetime(1970, 1, 1, 12, tzinfo=UTC) + timedelta(days=day)
        return round(zone.utcoffset(noon.replace(tzinfo=None)).total_seconds() / 900)

    out: dict[bytes, list[str]] = {}
    for name in sorted(available_timezones()):
        if name.split("/")[0] not in _REGIONS:
            continue
        zone = ZoneInfo(name)
        row = np.empty(last_day - first_day + 1, np.int8)
        day, now = first_day, offset(zone, first_day)
        while day <= last_day:
            # offsets change a few times a year: look a fortnight ahead, then halve the way to the change
            ahead = min(day + 14, last_day)
            then = offset(zone, ahead)
            lo, hi = day, ahead
            while then != now and hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(zone, mid) == now else (lo, mid)
            stop = ahead if then == now else hi
            row[day - first_day : stop - first_day + 1] = now
            row[stop - first_day] = then
            if stop == last_day:
                break
            day, now = stop, then
        out.setdefault(row.tobytes(), []).append(name)
    order = sorted(out, key=lambda k: (-len(out[k]), out[k][0]))
    return tuple(out[k][0] for k in order), np.stack([np.frombuffer(k, np.int8) for k in order])


def estimate_zones(df: DataFrame, source: str, local: str, reference: str, after: str | None = None, horizon_s: int = 900, margin: float = 5.0, switch: float = 3.0) -> DataFrame:
    """Estimate the offset history of each source whose timestamps name no zone; any history of the tz database may win.

    ``local`` holds written local micros, ``reference`` the instant (micros, UTC) at which the row was ingested and
    ``after`` an instant that it cannot precede, such as that of an earlier step of the same item. Under a history a row
    is a violation if it lies after its ingestion, more than ``horizon_s`` before it, or before ``after``. The sequence
    of histories with fewest violations wins; to change the history between two months it must save ``switch`` times
    the root of the source's rows, and 10. Ties go to the history that more zones share, then to the earlier name.

    One row per source and stretch of one history: source, zone, first_day, last_day (days since 1970 of the local time,
    open at the source's ends), rows, violations, runner_up_violations, decision: 'estimated' where the rows that fit
    outnumber those that fit the median history, as chance has it, by ``margin`` times (1 + the root of the latter), else
    'review'. Rows with null local or reference count for nothing; a null source is one group; an empty table gives no
    rows. A short ``horizon_s`` tells neighbouring offsets apart, if only some rows are ingested at once.

    A row allows a range of offsets, so it adds two marks to the counts of its source, day and quarter of an hour. These
    are summed before the shuffle; a source's group is bounded by the days of the calendar, however many rows it has.
    """
    ship(df.sparkSession)
    lag = F.col("local") - F.col("reference")
    rows = df.where(F.col(local).isNotNull() & F.col(reference).isNotNull()).select(F.col(source).alias("source"), F.col(local).alias("local"), F.col(reference).alias("reference"), (F.col(after) if after else F.lit(None)).cast("long").alias("after"))
    lo = F.greatest(F.ceil(lag / _QUARTER_US), F.lit(_WEST))
    hi = F.least(F.floor(F.least(lag + horizon_s * 1_000_000, F.col("local") - F.col("after")) / _QUARTER_US), F.lit(_EAST))
    marks = F.array_compact(F.array(
        F.struct(F.lit(_WEST - 1).cast("long").alias("at"), F.lit(1).alias("n")),
        F.when(lo <= hi, F.struct(lo.alias("at"), F.lit(1).alias("n"))),
        F.when(lo <= hi, F.struct((hi + 1).alias("at"), F.lit(-1).alias("n"))),
    ))
    m = rows.select("source", F.floor(F.col("local") / DAY_US).alias("day"), F.explode(marks).alias("m")).groupBy("source", "day", "m.at").agg(F.sum("m.n").alias("n"))
    m = cut(m)
    first, last = m.agg(F.min("day"), F.max("day")).first()
    kind = dict(m.dtypes)["source"]
    schema = f"source {kind}, zone string, first_day long, last_day long, rows long, violations long, runner_up_violations long, decision string"
    if first is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(offset_histories(first, last))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        names, offsets = shared.value
        days, at = np.unique(pdf["day"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(days), _EAST - _WEST + 3), np.int64)
        np.add.at(counts, (at, pdf["at"].to_numpy() - _WEST + 1), pdf["n"].to_numpy())
        total = counts[:, 0].copy()
        counts[:, 0] = 0
        fits = np.cumsum(counts, axis=1)
        off = offsets[:, days - first].astype(np.int64) - _WEST + 1
        wrong = total - fits[np.arange(len(days))[None, :], off]
        months, start = np.unique(days // 30, return_index=True)
        cost = np.add.reduceat(wrong, start, axis=1)
        pay = 10 + switch * total.sum() ** 0.5
        best, came = cost[:, 0].astype(float), []
        for j in range(1, len(months)):
            top = int(best.argmin())
            move = best[top] + pay < best
            came.append(np.where(move, top, np.arange(len(best))))
            best = np.where(move, best[top] + pay, best) + cost[:, j]
        path = [int(best.argmin())]
        for c in reversed(came):
            path.append(int(c[path[-1]]))
        path = path[::-1]
        ends = [j for j in range(len(path)) if j + 1 == len(path) or path[j + 1] != path[j]]
        out, begin = [], 0
        for j in ends:
            z, part = path[j], cost[:, begin : j + 1].sum(axis=1)
            n = int(np.add.reduceat(total, start)[begin : j + 1].sum())
            others, usual = np.delete(part, z), float(n - np.median(part))
            from_day = int(days[start[begin]]) if begin else -(2**31)
            to_day = int(days[start[j + 1]]) - 1 if j + 1 < len(path) else 2**31
            out.append((pdf["source"].iloc[0], names[z], from_day, to_day, n, int(part[z]), int(others.min()) if len(others) else n, "estimated" if n - part[z] - usual > margin * (1 + usual**0.5) else "review"))
            begin = j + 1
        return pd.DataFrame(out, columns=["source", "zone", "first_day", "last_day", "rows", "violations", "runner_up_violations", "decision"])

    return m.groupBy("source").applyInPandas(choose, schema)
