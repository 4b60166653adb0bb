import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from lodestone.operators.timestamps import estimate_zones, normalise_timestamps, offset_histories


def micros(*a, zone=UTC):
    return int(datetime(*a, tzinfo=zone).timestamp() * 1_000_000)


CASES = [
    ("D:20090812073939+02'00'", None, micros(2009, 8, 12, 5, 39, 39)),
    ("D:20171221153833Z00'00'", None, micros(2017, 12, 21, 15, 38, 33)),
    ("D:2014", "Asia/Tokyo", micros(2013, 12, 31, 15)),
    ("D:201209", None, micros(2012, 9, 1)),
    ("D:", None, None),
    ("D:20181340990000", None, None),
    ("2019-01-08 04:17:37.044082+0900", "UTC", micros(2019, 1, 7, 19, 17, 37) + 44082),
    ("2011-04-28T12:58:50.097813451Z", None, micros(2011, 4, 28, 12, 58, 50) + 97813),
    ("2019-01-08 05:17:37 Asia/Tokyo", None, micros(2019, 1, 7, 20, 17, 37)),
    ("  2021-06-03 ", None, micros(2021, 6, 3)),
    ("2017-02-30T10:15:00", None, None),
    ("0000-00-00 00:00:00", None, None),
    ("20190109T202318Z", None, micros(2019, 1, 9, 20, 23, 18)),
    ("20190109", None, micros(2019, 1, 9)),
    ("20190109202318", None, micros(2019, 1, 9, 20, 23, 18)),
    ("1546989998", None, 1546989998 * 1_000_000),
    ("1408902435581", None, 1408902435581 * 1000),
    ("11/01/2019 11:31:30", "UTC", micros(2019, 1, 11, 11, 31, 30)),
    ("11/01/2019 11:31:30", "America/Chicago", micros(2019, 11, 1, 16, 31, 30)),
    ("12/07/2020 12:05:00 AM", "America/New_York", micros(2020, 12, 7, 5, 5)),
    ("31/31/2018", None, None),
    ("11.07.2021 05:35", None, micros(2021, 7, 11, 5, 35)),
    ("Wed, 05 Nov 2014 12:56:30 +0530", None, micros(2014, 11, 5, 7, 26, 30)),
    ("Tue, 99 Foo 2016", None, None),
    ("Sat May  2 19:18:35 2009", "Europe/Berlin", micros(2009, 5, 2, 17, 18, 35)),
    ("Thu Jul  2 07:06:53 IST 2020", "Asia/Kolkata", micros(2020, 7, 2, 1, 36, 53)),
    ("22-Dec-2011 17:17:04 CST", "America/Chicago", micros(2011, 12, 22, 23, 17, 4)),
    ("22-Dec-2011 17:17:04 CST", "Asia/Shanghai", micros(2011, 12, 22, 9, 17, 4)),
    ("January 8, 2019 5:16 AM", "Asia/Tokyo", micros(2019, 1, 7, 20, 16)),
    # twice: the first occurrence; skipped: moved on by the gap
    ("2019-10-27 02:30:00", "Europe/Berlin", micros(2019, 10, 27, 0, 30)),
    ("2019-03-31 02:30:00", "Europe/Berlin", micros(2019, 3, 31, 1, 30)),
    ("unknown", None, None),
    ("", None, None),
    (None, "Europe/Berlin", None),
    ("2020-01-01 00:00:00", "No/Such_Zone", micros(2020, 1, 1)),
]


def test_written_forms(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "id int, t string, z string")
    got = {r["id"]: r["u"] for r in normalise_timestamps(df, "t", "z", "u").collect()}
    assert {i: got[i] for i in got} == {i: c[2] for i, c in enumerate(CASES)}


def test_site_tells_the_order_of_slashed_dates(spark):
    df = spark.createDataFrame([("02/03/2020 10:00:00", "America/Chicago")], "t string, s string")
    assert normalise_timestamps(df, "t", None, "u", site="s").first()["u"] == micros(2020, 2, 3, 10)


def test_edges(spark):
    empty = spark.createDataFrame([], "t string, __x int")
    assert normalise_timestamps(empty, "t", None, "u").columns == ["t", "__x", "u"]
    twice = spark.createDataFrame([("2020-01-01",), ("2020-01-01",), ("x" * 100_000,)], "t string")
    assert [r["u"] for r in normalise_timestamps(twice, "t", None, "u").collect()].count(None) == 1


def same_history(a, b, first, last):
    """Whether two zones have one offset on every day of a range."""
    names, offsets = offset_histories(first, last)
    days = [datetime(1970, 1, 1, 12) + timedelta(days=d) for d in range(first, last + 1)]
    return all(ZoneInfo(a).utcoffset(d) == ZoneInfo(b).utcoffset(d) for d in days)


def written(zone, at):
    return int(datetime.fromtimestamp(at, ZoneInfo(zone)).replace(tzinfo=UTC).timestamp() * 1e6)


def test_histories_are_those_of_the_database():
    first, last = 15_000, 16_500
    names, offsets = offset_histories(first, last)
    assert len(names) == len({o.tobytes() for o in offsets}) > 60
    for name in ("Europe/Moscow", "America/New_York", "Asia/Kolkata"):
        want = [ZoneInfo(name).utcoffset(datetime(1970, 1, 1, 12) + timedelta(days=d)).total_seconds() / 900 for d in range(first, last + 1)]
        assert any((o == want).all() for o in offsets)


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York", "Europe/Paris", "Asia/Kathmandu", "Pacific/Auckland"])
def test_zone_estimate(spark, zone):
    first = 1_500_000_000
    rows = [("s", written(zone, first + k * 90_000), (first + k * 90_000 + 60) * 1_000_000) for k in range(400)]
    # a tenth of the uploads come days late
    rows = [(s, l, r + (300_000_000_000 if k % 10 == 0 else 0)) for k, (s, l, r) in enumerate(rows)]
    df = spark.createDataFrame([*rows, (None, None, 1), ("t", 5, None)], "s string, l long, r long")
    (got,) = estimate_zones(df, "s", "l", "r", horizon_s=600).collect()
    assert (got["rows"], got["violations"], got["decision"]) == (400, 40, "estimated")
    assert same_history(got["zone"], zone, first // 86400, first // 86400 + 410)


def test_a_site_that_moves(spark):
    first = 1_500_000_000
    rows = [("s", written("Asia/Tokyo" if k < 300 else "Europe/Berlin", first + k * 90_000), (first + k * 90_000 + 60) * 1_000_000) for k in range(600)]
    got = sorted(estimate_zones(spark.createDataFrame(rows, "s string, l long, r long"), "s", "l", "r", horizon_s=600).collect(), key=lambda r: r["first_day"])
    assert len(got) == 2 and got[0]["last_day"] + 1 == got[1]["first_day"] and abs(got[1]["first_day"] - (first + 300 * 90_000) // 86400) < 31
    assert same_history(got[0]["zone"], "Asia/Tokyo", 17_400, 17_600) and same_history(got[1]["zone"], "Europe/Berlin", 17_800, 17_900)


def test_an_earlier_step_bounds_from_the_other_side(spark):
    first = 1_500_000_000
    rows = [("s", written("Asia/Tokyo", first + k * 90_000), (first + k * 90_000 + 60) * 1_000_000, (first + k * 90_000 - 60) * 1_000_000) for k in range(400)]
    df = spark.createDataFrame(rows, "s string, l long, r long, a long")
    (got,) = estimate_zones(df, "s", "l", "r", "a", horizon_s=10**9).collect()
    assert got["violations"] == 0 and same_history(got["zone"], "Asia/Tokyo", 17_400, 17_700)


def test_stamps_of_no_history_are_for_review(spark):
    rng = random.Random(1)
    rows = [("s", rng.randrange(10**15, 2 * 10**15), rng.randrange(10**15, 2 * 10**15)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string, l long, r long")
    assert {r["decision"] for r in estimate_zones(df, "s", "l", "r").collect()} == {"review"}
    assert estimate_zones(df.limit(0), "s", "l", "r").count() == 0


def test_the_estimate_decides_where_the_site_names_no_zone(spark, tmp_path):
    from lodestone.plans.dealt import p1_found

    first, rows, want = 1_500_000_000, [], {}
    for k in range(400):
        at = first + k * 90_000
        text = datetime.fromtimestamp(at, ZoneInfo("Asia/Tokyo")).strftime("%Y-%m-%d %H:%M:%S")
        upload = datetime.fromtimestamp(at + 60, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for n, site in enumerate(("Plant 7", None, "Europe/Berlin")):
            rows.append((3 * k + n, None, text, upload, site))
            # a rule that names a zone holds, whatever the uploads say
            zone = ("Asia/Tokyo", "UTC", "Europe/Berlin")[n]
            want[3 * k + n, "mod_date"] = int(datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(zone)).timestamp() * 1e6)
            want[3 * k + n, "upload_time"] = (at + 60) * 1_000_000
    rows.append((9000, None, "2019-05-05 05:05:05", None, "Plant 8"))  # too little to tell
    want[9000, "mod_date"] = micros(2019, 5, 5, 5, 5, 5)
    spark.createDataFrame(rows, "paper_id long, creation_date string, mod_date string, upload_time string, site_zone string").write.parquet(str(tmp_path / "papers.parquet"))
    assert {(r["paper_id"], r["field_name"]): r["utc_micros"] for r in p1_found(spark, str(tmp_path)).collect()} == want
