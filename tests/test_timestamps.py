from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.operators.timestamps import normalise_timestamps, zone_transitions

ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kathmandu", "Australia/Sydney", "America/St_Johns", "America/Los_Angeles", "Europe/London", "Africa/Nairobi"]


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


def run(spark, values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, value string, zone string, ord string")
    return [tuple(r[0]) for r in normalise_timestamps(df, "value", "zone", "ord", ZONES).orderBy("i").select("parsed").collect()]


CASES = [
    ("Mon, 18 Nov 2024 02:38:06 +0000", "UTC", "DMY", "2024-11-18T02:38:06"),
    ("Wed, 17 Sep 2025 18:58:43 +0530", "UTC", "DMY", "2025-09-17T13:28:43"),
    ("02 Nov 2025 01:01:50 PST", "America/Los_Angeles", "MDY", "2025-11-02T09:01:50"),
    ("Sat, 28 Dec 24 05:56:42 PST", "America/Los_Angeles", "MDY", "2024-12-28T13:56:42"),
    ("Fri, 17 Oct 2025 09:59:41 GMT", "America/New_York", "MDY", "2025-10-17T09:59:41"),
    ("2025-07-09t19:47:18z", "UTC", "DMY", "2025-07-09T19:47:18"),
    ("20250724075919", "America/New_York", "MDY", "2025-07-24T07:59:19"),
    ("1748147705921", "UTC", "DMY", "2025-05-25T04:35:05.921"),
    ("1745760833", "UTC", "DMY", "2025-04-27T13:33:53"),
    ("05/11/2025 20:40", "Europe/Berlin", "DMY", "2025-11-05T19:40:00"),
    ("05/11/2025 20:40", "America/New_York", "MDY", "2025-05-12T00:40:00"),
    ("18.07.2025 02:04", "Europe/Berlin", "DMY", "2025-07-18T00:04:00"),
    ("13. März 2025, 06:17 Uhr", "Europe/Berlin", "DMY", "2025-03-13T05:17:00"),
    ("25 de enero de 2025, 00:33", "UTC", "DMY", "2025-01-25T00:33:00"),
    ("29 août 2025 à 1h20", "UTC", "DMY", "2025-08-29T01:20:00"),
    ("May 20, 2025 4:29 am", "UTC", "DMY", "2025-05-20T04:29:00"),
    ("Jun 3, 2025 9:43 p.m. EDT", "America/New_York", "MDY", "2025-06-04T01:43:00"),
    ("Feb 11, 2025 12:48 AM GMT", "Europe/Berlin", "DMY", "2025-02-11T00:48:00"),
    ("2025-W28-5T07:44:13Z", "UTC", "DMY", "2025-07-11T07:44:13"),
    ("2025-159T01:12:06Z", "UTC", "DMY", "2025-06-08T01:12:06"),
    ("2025-07-11 11:54:49 UTC+2", "UTC", "DMY", "2025-07-11T09:54:49"),
    ("2024-12-01T18:10:12.424538999Z", "UTC", "DMY", "2024-12-01T18:10:12.424538"),
    ("2025-10-05T05:10:37+11:00[Australia/Sydney]", "UTC", "DMY", "2025-10-04T18:10:37"),
    ("2025-10-02T03:33:42-04", "UTC", "DMY", "2025-10-02T07:33:42"),
    ("  2025-06-10  04:55:33 ", "Asia/Kathmandu", "DMY", "2025-06-09T23:10:33"),
    ("\t2025-12-31T23:59:59\n", "America/St_Johns", "MDY", "2026-01-01T03:29:59"),
]


def test_formats(spark):
    got = run(spark, [c[:3] for c in CASES])
    assert got == [(us(c[3]), "ok") for c in CASES]


def test_transitions_of_daylight_saving(spark):
    got = run(
        spark,
        [
            ("2025-11-02T01:10:06", "America/Los_Angeles", "MDY"),
            ("2025-03-09T02:50:27", "America/Los_Angeles", "MDY"),
            ("2025-11-02T01:39:58", "America/St_Johns", "MDY"),
            ("2025-03-30T02:00:00", "Europe/Berlin", "DMY"),
            ("2025-03-30T03:00:00", "Europe/Berlin", "DMY"),
        ],
    )
    assert got == [(us("2025-11-02T08:10:06"), "ambiguous"), (None, "nonexistent"), (us("2025-11-02T04:09:58"), "ambiguous"), (None, "nonexistent"), (us("2025-03-30T01:00:00"), "ok")]


@pytest.mark.parametrize("value", [None, "", " ", "2024-11-08", "20250228", "2 Nov 2025", "Fri, 31 Apr 2026 08:00:00 GMT", "2025-02-30T10:00:00Z", "2025-13-04 09:00:00+00:00", "25:61", "unknown", "0000-00-00 00:00:00", "T12:30Z", "2025-W54-1T00:00:00Z", "x" * 100_000])
def test_no_cases(spark, value):
    assert run(spark, [(value, "UTC", "DMY")]) == [(None, "unparsed")]


def test_null_columns_empty_table_and_clashing_names(spark):
    assert run(spark, [("2025-01-01T00:00:00", None, None), ("2025-01-01T00:00:00Z", None, None), ("2025-01-01T00:00:00", "No/Where", "DMY")]) == [(None, "no_zone"), (us("2025-01-01T00:00:00"), "ok"), (None, "no_zone")]
    df = spark.createDataFrame([("2025-01-01T00:00:00", "UTC", "DMY", 1, 2)], "value string, zone string, ord string, year int, parsed int")
    out = normalise_timestamps(df, "value", "zone", "ord", ["UTC"], "found")
    assert out.columns == ["value", "zone", "ord", "year", "parsed", "found"]
    assert normalise_timestamps(df.limit(0), "value", "zone", "ord", [], "found").count() == 0


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4_000_000_000), st.sampled_from(ZONES)), min_size=300, max_size=300))
def test_local_readings_against_zone_info(spark, points):
    locals_ = [((datetime(1970, 1, 1) + timedelta(seconds=s)), z) for s, z in points]
    got = run(spark, [(t.isoformat(), z, "DMY") for t, z in locals_])
    for (value, status), (t, z) in zip(got, locals_):
        first, second = (t.replace(tzinfo=ZoneInfo(z), fold=f) for f in (0, 1))
        exists = first.astimezone(timezone.utc).astimezone(ZoneInfo(z)).replace(tzinfo=None) == t
        if not exists:
            assert status == "nonexistent"
        else:
            assert value == int(first.timestamp()) * 1_000_000
            assert status == ("ok" if first.utcoffset() == second.utcoffset() else "ambiguous")


def test_unknown_zone_has_no_intervals():
    assert zone_transitions("Not/AZone") == ()
