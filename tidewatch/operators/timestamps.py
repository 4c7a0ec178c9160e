"""Time stamps in mixed formats, precisions and zones, normalised to one UTC instant.

A value is parsed by JVM expressions into a local reading (microseconds of the wall clock)
and what it says about its zone: an offset, a zone abbreviation, a zone name, or nothing.
Readings that name no offset are resolved by an as-of join against *zone-offset intervals*:
for every zone the stretches of local time during which one offset held, exploded by local
year. Two matching intervals mean that the reading occurred twice, none that it was skipped,
one gives the offset directly.

The interval table is bounded by the IANA data base (about 600 zones, 200 years), not by the
input, so it is always safe to broadcast; the join adds no shuffle.
"""

from __future__ import annotations

import functools
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_YEAR, LAST_YEAR = 1970, 2100
_US = 1_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# Month names of the languages that feeds use, lower case, without dots.
MONTHS = {
    1: ["jan", "january", "januar", "enero", "janvier", "janeiro", "jän", "jänner", "ene", "janv"],
    2: ["feb", "february", "februar", "febrero", "février", "fevrier", "fevereiro", "févr", "fev"],
    3: ["mar", "march", "märz", "maerz", "mär", "marzo", "mars", "março", "marco"],
    4: ["apr", "april", "abril", "avril", "abr", "avr"],
    5: ["may", "mai", "mayo", "maio"],
    6: ["jun", "june", "juni", "junio", "juin", "junho"],
    7: ["jul", "july", "juli", "julio", "juillet", "julho", "juil"],
    8: ["aug", "august", "agosto", "août", "aout", "ago"],
    9: ["sep", "sept", "september", "septiembre", "septembre", "setembro", "set"],
    10: ["oct", "october", "oktober", "octubre", "octobre", "outubro", "okt", "out"],
    11: ["nov", "november", "noviembre", "novembre", "novembro"],
    12: ["dec", "december", "dezember", "diciembre", "décembre", "decembre", "dezembro", "dez", "dic", "déc"],
}
_MONTH_NUMBER = {name: number for number, names in MONTHS.items() for name in names}

_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?(am|pm|a\.m\.|p\.m\.))?"
_TAIL = r" ?(.*)$"
_SEP = r"(?:t| |, ?| à | at | um | a las )"
# Year, month and day, and week or day of the year.
_ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})" + _SEP + _CLOCK + _TAIL
_WEEK = r"^(\d{4})-?w(\d{2})-?([1-7])" + _SEP + _CLOCK + _TAIL
_ORDINAL = r"^(\d{4})-(\d{3})" + _SEP + _CLOCK + _TAIL
_BASIC = r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _TAIL
_NUMERIC = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})" + _SEP + _CLOCK + _TAIL
_DAY_FIRST = r"^(\d{1,2})(?:\.|st|nd|rd|th|º)?[ \-](?:de |of )?([\p{L}\p{M}]+)\.?,?[ \-](?:de |del )?(\d{4}|\d{2})" + _SEP + _CLOCK + _TAIL
_MONTH_FIRST = r"^([\p{L}\p{M}]+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _SEP + _CLOCK + _TAIL
_WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? "
_DIGITS = r"^(\d{10}|\d{13}|\d{16}|\d{19})$"
_OFFSET = r"^(?:utc|gmt|ut)? ?([+\-−])(\d{1,2}):?(\d{2})?(?::?(\d{2}))?(?: ?(?:\[.*\]|\(.*\)))?$"

#: Names of time zones that sources may have.
MAX_ZONES = 1_000


@functools.lru_cache(maxsize=1024)
def zone_transitions(name: str) -> tuple[tuple[int, int, str], ...]:
    """(first UTC second, offset in seconds, abbreviation) of each stretch; () for an unknown zone."""
    try:
        zone = ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return ()

    def at(second: int) -> tuple[int, str]:
        local = (_EPOCH + timedelta(seconds=second)).astimezone(zone)
        return int(local.utcoffset().total_seconds()), local.tzname()

    start = int(datetime(FIRST_YEAR - 1, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(LAST_YEAR + 1, 12, 31, tzinfo=timezone.utc).timestamp())
    step = 86_400 * 4
    out = [(start, *at(start))]
    previous = start
    for now in range(start + step, end, step):
        if at(now) != out[-1][1:]:
            low, high = previous, now
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == out[-1][1:] else (low, middle)
            out.append((high, *at(high)))
        previous = now
    return tuple(out)


def _intervals(zone: str) -> list[tuple[str, int, int, int, int]]:
    """(zone, local year, first local us, end local us, offset us), exploded by local year."""
    rows = zone_transitions(zone)
    out = []
    for i, (begin, offset, _) in enumerate(rows):
        low = begin + offset if i else -(10**12)
        high = rows[i + 1][0] + offset if i + 1 < len(rows) else 10**12
        first = (_EPOCH + timedelta(seconds=max(low, -31_000_000))).year
        last = (_EPOCH + timedelta(seconds=min(high, 4_133_900_000))).year
        for year in range(max(first, FIRST_YEAR), min(last, LAST_YEAR) + 1):
            out.append((zone, year, low * _US, high * _US, offset * _US))
    return out


def zone_interval_frame(spark: SparkSession, zones: list[str]) -> DataFrame:
    """One row per zone and local year: ``zone``, ``year``, ``spans`` (low, high, offset)."""
    rows: dict[tuple[str, int], list] = {}
    for zone in sorted(set(zones)):
        for name, year, low, high, offset in _intervals(zone):
            rows.setdefault((name, year), []).append((low, high, offset))
    schema = "zone string, year int, spans array<struct<low:bigint,high:bigint,offset:bigint>>"
    return spark.createDataFrame([(z, y, spans) for (z, y), spans in rows.items()], schema)


def zone_abbreviation_frame(spark: SparkSession, zones: list[str]) -> DataFrame:
    """``zone``, ``abbr`` (lower case), ``abbr_offset`` in microseconds, the latest of each."""
    rows = {}
    for zone in sorted(set(zones)):
        for _, offset, abbr in zone_transitions(zone):
            if abbr and abbr[0].isalpha():
                rows[zone, abbr.lower()] = offset * _US
    return spark.createDataFrame([(z, a, o) for (z, a), o in rows.items()], "zone string, abbr string, abbr_offset bigint")


def _int(text: Column) -> Column:
    return F.when(text != "", text.cast("int"))


def _days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _day_number(year: Column, month: Column, day: Column) -> Column:
    good = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= _days_in_month(year, month))
    return F.when(good, F.unix_date(F.make_date(year, month, day)))


def _clean(value: Column) -> Column:
    text = F.regexp_replace(value, r"[\s   ​﻿]+", " ")
    return F.regexp_replace(F.lower(F.trim(text)), _WEEKDAY, "")


# Each pattern with the order of its groups: y year, m month, d day, n month name, w week, k
# week day, o day of the year, p and q a day and a month in the order of the source, H M S
# F P clock, fraction and half of the day, Z what follows.
_FAMILIES = [
    (_BASIC, "ymdHMSFZ"),
    (_ISO, "ymdHMSFPZ"),
    (_WEEK, "ywkHMSFPZ"),
    (_ORDINAL, "yoHMSFPZ"),
    (_NUMERIC, "pqyHMSFPZ"),
    (_DAY_FIRST, "dnyHMSFPZ"),
    (_MONTH_FIRST, "ndyHMSFPZ"),
]
_FIELDS = "ymdnwkopqHMSFPZ"
_MARK = "\u0001"


def _monday_of_week_one(year: Column) -> Column:
    fourth = F.unix_date(F.make_date(year, F.lit(1), F.lit(4)))
    return fourth - F.pmod(fourth + 3, F.lit(7))


def parse_readings(df: DataFrame, value: str, date_order: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>local`` and ``<prefix>utc`` (microseconds) and ``<prefix>tail``.

    ``utc`` is set for values that are instants by themselves (epoch numbers and 14 bare
    digits); otherwise ``local`` is the wall clock and ``tail`` what follows it. Both are null
    where the value is no time, a date alone or a date or clock that does not exist. The steps
    stay separate projections, so that each pattern is matched once.
    """
    t = prefix
    df = df.withColumn(t + "v", _clean(F.col(value)))
    v = F.col(t + "v")
    fields = F.lit(None).cast("string")
    for pattern, groups in reversed(_FAMILIES):
        order = _MARK.join(f"${groups.index(f) + 1}" if f in groups else "" for f in _FIELDS)
        fields = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, order)).otherwise(fields)
    df = df.withColumn(t + "g", F.split(F.when(~v.rlike(_DIGITS), fields), _MARK))
    raw = {f: F.col(t + "g")[i] for i, f in enumerate(_FIELDS)}
    month_map = F.create_map(*[x for name, number in _MONTH_NUMBER.items() for x in (F.lit(name), F.lit(number))])
    mdy = F.coalesce(F.col(date_order), F.lit("DMY")) == "MDY"
    p, q = _int(raw["p"]), _int(raw["q"])
    short, year = F.length(raw["y"]) == 2, _int(raw["y"])
    half, hour = F.substring(raw["P"], 1, 1), _int(raw["H"])
    df = df.withColumns(
        {
            t + "y": F.when(short, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year),
            t + "m": F.coalesce(_int(raw["m"]), F.when(raw["n"] != "", F.try_element_at(month_map, raw["n"])), F.when(mdy, p).otherwise(q)),
            t + "d": F.coalesce(_int(raw["d"]), F.when(mdy, q).otherwise(p)),
            t + "w": _int(raw["w"]),
            t + "k": _int(raw["k"]),
            t + "o": _int(raw["o"]),
            t + "h": F.when(raw["P"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)),
            t + "mi": _int(raw["M"]),
            t + "s": F.coalesce(_int(raw["S"]), F.lit(0)),
            t + "us": F.rpad(F.substring(raw["F"], 1, 6), 6, "0").cast("bigint"),
            t + "tail": raw["Z"],
        }
    )
    y, m, d, w, k, o, h, mi, s, us = (F.col(t + c) for c in ("y", "m", "d", "w", "k", "o", "h", "mi", "s", "us"))
    some_year = y.between(1, 9998)
    weeks = (_monday_of_week_one(y + 1) - _monday_of_week_one(y)) / 7
    jan1 = F.unix_date(F.make_date(y, F.lit(1), F.lit(1)))
    length = F.unix_date(F.make_date(y + 1, F.lit(1), F.lit(1))) - jan1
    day = (
        F.when(~some_year | ~h.between(0, 23) | ~mi.between(0, 59) | ~s.between(0, 59), None)
        .when(w.isNotNull(), F.when((w >= 1) & (w <= weeks), _monday_of_week_one(y) + (w - 1) * 7 + k - 1))
        .when(o.isNotNull(), F.when((o >= 1) & (o <= length), jan1 + o - 1))
        .when(m.between(1, 12) & (d >= 1) & (d <= _days_in_month(y, m)), F.unix_date(F.make_date(y, m, d)))
    )
    df = df.withColumn(t + "local", day.cast("bigint") * (86_400 * _US) + (h * 3600 + mi * 60 + s).cast("bigint") * _US + us)
    number, digits = F.when(v.rlike(_DIGITS), v.cast("decimal(20,0)")), F.length(v)
    instant = F.when(digits == 10, number * _US).when(digits == 13, number * 1000).when(digits == 16, number).otherwise(F.floor(number / 1000))
    return df.withColumn(t + "utc", F.coalesce(instant.cast("bigint"), F.when(v.rlike(r"^\d{14}$"), F.col(t + "local"))))


def normalise_timestamps(df: DataFrame, value: str, zone: str, date_order: str, zones: list[str], out: str = "parsed") -> DataFrame:
    """Adds ``out``: struct(utc_us, status).

    ``value`` is the raw text, ``zone`` the IANA zone of readings that name none, ``date_order``
    DMY or MDY for all-numeric dates; ``zones`` lists the zone names that ``zone`` may hold (its
    number is bounded by the IANA data base). Status: ``ok``, ``ambiguous`` (the earlier instant
    is taken), ``nonexistent`` (the local reading was skipped), ``no_zone`` (no offset and no known
    zone), ``unparsed`` (null, empty, a date alone, a date or clock that does not exist, any other
    text). All but the first two have a null ``utc_us``. Rows are kept one to one, whatever other
    columns they have; an empty frame gives an empty frame. Digits beyond the microsecond are cut.
    """
    spark = df.sparkSession
    t = "__tw_"
    bracket = sorted({z for z in zones if z})
    spans = zone_interval_frame(spark, bracket).withColumnsRenamed({"zone": t + "z", "year": t + "sy", "spans": t + "spans"})
    abbrs = zone_abbreviation_frame(spark, bracket).withColumnsRenamed({"zone": t + "az", "abbr": t + "abbr", "abbr_offset": t + "aoff"})

    df = parse_readings(df, value, date_order, t)
    tail, local, utc = F.col(t + "tail"), F.col(t + "local"), F.col(t + "utc")
    sign = F.when(F.regexp_extract(tail, _OFFSET, 1) == "+", 1).otherwise(-1)
    parts = [F.coalesce(_int(F.regexp_extract(tail, _OFFSET, i)), F.lit(0)) for i in (2, 3, 4)]
    in_range = (parts[0] <= 18) & (parts[1] <= 59) & (parts[2] <= 59)
    offset = F.when(tail.rlike(r"^(?:z|utc|gmt|ut)(?: ?[\[(].*[\])])?$"), F.lit(0)).when(
        tail.rlike(_OFFSET) & in_range, sign * (parts[0] * 3600 + parts[1] * 60 + parts[2])
    )
    named = F.regexp_extract(tail, r"^\[([^\]]+)\]$", 1)
    known = F.create_map(*[x for z in bracket for x in (F.lit(z.lower()), F.lit(z))]) if bracket else F.create_map(F.lit(""), F.lit(""))
    local_zone = F.when(tail.isin("", "uhr", "h", "hrs"), F.col(zone)).when(named != "", F.try_element_at(known, named))
    df = df.withColumns(
        {
            t + "off": offset.cast("bigint") * _US,
            t + "lz": local_zone,
            t + "ab": F.when(tail.rlike(r"^\(?[a-z]{2,6}\)?$"), F.regexp_replace(tail, r"[()]", "")),
            t + "year": F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.year(F.date_from_unix_date(F.floor(local / (86_400 * _US)).cast("int"))))),
        }
    )
    df = df.join(F.broadcast(spans), (F.col(t + "lz") == F.col(t + "z")) & (F.col(t + "year") == F.col(t + "sy")), "left")
    df = df.join(F.broadcast(abbrs), (F.col(zone) == F.col(t + "az")) & (F.col(t + "ab") == F.col(t + "abbr")), "left")
    hits = F.filter(F.col(t + "spans"), lambda s: (s["low"] <= local) & (local < s["high"]))
    df = df.withColumn(t + "hits", hits)
    count = F.size(t + "hits")
    direct = F.coalesce(utc, local - F.col(t + "off"), local - F.col(t + "aoff"))
    zoned = local - F.array_max(F.transform(t + "hits", lambda s: s["offset"]))
    status = (
        F.when(F.coalesce(utc, local).isNull(), "unparsed")
        .when(direct.isNotNull(), "ok")
        .when(F.col(t + "spans").isNull(), "no_zone")
        .when(count == 0, "nonexistent")
        .when(count == 1, "ok")
        .otherwise("ambiguous")
    )
    df = df.withColumn(out, F.struct(F.coalesce(direct, zoned).alias("utc_us"), status.alias("status")))
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def source_zones(sources: DataFrame) -> list[str]:
    """Distinct zone names, MAX_ZONES at most; more can't all be of the IANA data base."""
    rows = sources.select("zone_name").where(F.col("zone_name").isNotNull()).distinct().limit(MAX_ZONES + 1).collect()
    if len(rows) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} time zones")
    return [r[0] for r in rows]


def stamped_records(feed_items: DataFrame, reliefweb_items: DataFrame, event_details: DataFrame) -> DataFrame:
    """record_kind, record_id, source_id, value of the five fields that carry time stamps."""
    relief = reliefweb_items.select(
        "id",
        "source_id",
        F.explode(F.array(*[F.struct(F.lit(f"reliefweb_items.{k}").alias("kind"), F.col(f"date.{k}").alias("value")) for k in ("original", "created", "changed")])).alias("f"),
    )
    feed = feed_items.select(F.lit("feed_items").alias("record_kind"), F.col("item_id").alias("record_id"), "source_id", F.col("published").alias("value"))
    detail = event_details.select(F.lit("event_details").alias("record_kind"), F.col("detail_id").alias("record_id"), "source_id", F.col("occurred_at").alias("value"))
    return feed.unionByName(detail).unionByName(relief.select(F.col("f.kind").alias("record_kind"), F.col("id").alias("record_id"), "source_id", F.col("f.value").alias("value")))


def normalised_records(records: DataFrame, sources: DataFrame) -> DataFrame:
    """``stamped_records`` with ``parsed``; ``sources`` is a dimension of one row per feed."""
    zones = source_zones(sources)
    dimension = sources.select(F.col("id").alias("source_id"), "zone_name", "date_order").dropDuplicates(["source_id"])
    return normalise_timestamps(records.join(dimension, "source_id", "left"), "value", "zone_name", "date_order", zones)
