"""Parsers of public feeds: a frame of raw payloads becomes a frame of observation drafts.

Every parser takes a frame with a ``payload`` column (one response per row) or, for line formats, a frame of
``value`` lines as ``spark.read.text`` gives, and returns the columns of DRAFT. Malformed payloads and items
without what a draft needs give no row. Bodies are worded by us; all other fields follow the feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text, time
from ..model import lookup
from ..operators.spatial import usable_location

DRAFT = (
    "source_id string, external_id string, title string, body string, url string, occurred_at timestamp, published_at timestamp, lat double, lon double, geo_precision string, "
    "place_name string, country_code string, place_hint string, category string, magnitude double, tone double, report_count int, actors array<string>, raw string"
)
_TYPES = dict(part.strip().split(" ", 1) for part in DRAFT.split(", "))


def draft(df: DataFrame, **columns: Column) -> DataFrame:
    """The DRAFT columns, null where not given; report_count 1 and no actors by default."""
    columns = {"report_count": F.lit(1), "actors": F.array().cast("array<string>"), **columns}
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _TYPES.items()])


def check_drafts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good drafts, rejected drafts with ``reason``); good ones have ids, a title, sane ranges and actors."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = (
        F.when(blank("source_id") | blank("external_id"), "no id")
        .when(blank("title"), "no title")
        .when(F.col("occurred_at").isNull(), "no time")
        .when(F.col("url").isNotNull() & text.safe_url(F.col("url")).isNull(), "bad url")
        .when(~F.coalesce(F.col("tone").between(-1, 1), F.lit(True)), "tone out of range")
        .when(F.col("report_count") < 0, "negative count")
        .when(~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(True)), "place out of range")
    )
    checked = df.withColumn("reason", reason)
    good = checked.where("reason is null").drop("reason")
    return good.withColumn("actors", F.coalesce("actors", F.array().cast("array<string>"))), checked.where("reason is not null")


def first_copies(df: DataFrame, order: str) -> DataFrame:
    """One draft per (source_id, external_id), the one with the least ``order``."""
    rank = Window.partitionBy("source_id", "external_id").orderBy(order)
    return df.withColumn("__k", F.row_number().over(rank)).where("__k = 1").drop("__k")


def _point(lat: Column, lon: Column) -> Column:
    return usable_location(geo.leading_number(lat.cast("string")), geo.leading_number(lon.cast("string")))


def _sentence(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


# --- event export: 61 tab-separated fields, a manifest names the newest file ------------------------------

# 0-based offsets of the fields in use.
EXPORT_FIELDS = {
    "id": 0, "day": 1, "actor1": 6, "actor1_country": 7, "actor2": 16, "actor2_country": 17, "is_root": 25, "code": 26, "root": 28, "quad": 29, "goldstein": 30, "mentions": 31, "sources": 32, "articles": 33,
    "tone": 34, "geo_type": 51, "place": 52, "fips": 53, "adm1": 54, "lat": 56, "lon": 57, "added": 59, "url": 60,
}
EXPORT_WIDTH = 61
MIN_MENTIONS = 2


def newest_export(manifest: DataFrame) -> DataFrame:
    """url and cursor (14 digits) of the first export file that a manifest lists; no row without one."""
    lines = manifest.select("payload", F.posexplode(F.split("payload", r"\r?\n")).alias("pos", "line"))
    url = F.element_at(F.split(F.trim("line"), r"\s+"), -1)
    found = lines.where((F.size(F.split(F.trim("line"), r"\s+")) >= 3) & F.lower(url).rlike(r"\.export\.csv\.zip$")).groupBy("payload").agg(F.min_by(url, "pos").alias("url"))
    return found.select("url", F.regexp_extract("url", r"(\d{14})", 1).alias("cursor"))


def event_export(lines: DataFrame, now: Column) -> DataFrame:
    """Drafts of an event export; short rows, rows of fewer than two mentions and rows without a place are skipped."""
    rows = lines.select(F.split("value", "\t").alias("f")).where(F.size("f") >= EXPORT_WIDTH)
    rows = rows.select(*[F.col("f")[i].alias(name) for name, i in EXPORT_FIELDS.items()])
    number = lambda c: geo.leading_number(F.col(c))
    rows = rows.where((F.col("id") != "") & (F.coalesce(number("mentions"), F.lit(0.0)) >= MIN_MENTIONS)).withColumn("at", _point(F.col("lat"), F.col("lon"))).where("at is not null")
    names = F.transform(F.filter(F.array("actor1", "actor2"), lambda a: F.length(a) > 1), text.title_case)
    rows = rows.withColumns({"actors": names, "label": text.root_label(F.col("root")), "place": F.when(F.col("place") != "", F.col("place"))})
    action, where = F.coalesce("label", F.lit("Reported activity")), F.coalesce(F.concat(F.lit(" in "), "place"), F.lit(""))
    title = (
        F.when(F.size("actors") >= 2, F.concat(F.col("actors")[0], F.lit(" — "), action, F.lit(" — "), F.col("actors")[1], where))
        .when(F.size("actors") == 1, F.concat(F.col("actors")[0], F.lit(": "), action, where))
        .otherwise(F.concat(action, where))
    )
    at = F.coalesce(time.parse_date(F.col("added")), time.parse_date(F.col("day")), now)
    precision = F.when(F.col("geo_type").isin("3", "4"), "city").when(F.col("geo_type").isin("2", "5"), "admin1").when(F.col("geo_type") == "1", "country").otherwise("unknown")
    raw = F.to_json(
        F.struct(
            "root", "quad", F.struct(F.col("actor1").alias("name"), F.col("actor1_country").alias("country")).alias("actor1"), F.struct(F.col("actor2").alias("name"), F.col("actor2_country").alias("country")).alias("actor2"),
            F.struct(F.col("fips").alias("fipsCountryCode"), F.col("geo_type").alias("type")).alias("actionGeo"), (F.col("is_root") == "1").alias("isRootEvent"),
        )
    )
    sources = F.coalesce(number("sources"), F.lit(0.0)).cast("int")
    return draft(
        rows, source_id=F.lit("gdelt.events"), external_id=F.col("id"), title=title, body=_sentence(F.concat("label", F.lit(".")), F.concat(F.lit("Reported by "), sources.cast("string"), F.lit(" sources."))),
        url=text.safe_url(F.col("url")), occurred_at=at, published_at=at, lat=F.col("at.lat"), lon=F.col("at.lon"), geo_precision=precision, place_name=F.col("place"), place_hint=F.col("place"),
        category=text.root_category(F.col("root")), magnitude=number("goldstein"), tone=F.when(number("tone").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number("tone") / 100))), report_count=F.greatest(sources, F.lit(1)), actors=F.col("actors"), raw=raw,
    )


# --- GeoJSON and JSON feeds ------------------------------------------------------------------------------

_QUAKES = "features array<struct<id string, geometry struct<coordinates array<double>>, properties struct<mag double, place string, time bigint, updated bigint, url string, title string, alert string, status string, tsunami int, sig int, type string>>>"


def earthquakes(df: DataFrame, now: Column) -> DataFrame:
    """Drafts of earthquake GeoJSON; features without a usable point are dropped."""
    f = df.select(F.explode(F.from_json("payload", _QUAKES)["features"]).alias("f"))
    f = f.withColumn("at", F.when(F.size("f.geometry.coordinates") >= 2, usable_location(F.col("f.geometry.coordinates")[1], F.col("f.geometry.coordinates")[0]))).where("at is not null")
    p = lambda c: F.col(f"f.properties.{c}")
    title = F.when(p("mag").isNotNull(), F.concat(F.format_string("Magnitude %.1f earthquake strikes ", p("mag")), F.coalesce(p("place"), F.lit("unknown location")))).otherwise(
        F.concat(F.lit("Earthquake reported "), F.coalesce(F.concat(F.lit("near "), p("place")), F.lit("at an unknown location")))
    )
    depth = F.try_element_at("f.geometry.coordinates", F.lit(3))
    body = _sentence(F.format_string("Magnitude %.1f.", p("mag")), F.when(depth.isNotNull(), F.format_string("Depth %.1f km.", depth)), F.when(p("tsunami") == 1, "Flagged for tsunami evaluation."))
    at = F.coalesce(F.timestamp_millis(p("time")), now)
    return draft(
        f, source_id=F.lit("usgs.quakes"), external_id=F.col("f.id"), title=title, body=body, url=text.safe_url(p("url")), occurred_at=at, published_at=F.coalesce(F.timestamp_millis(p("updated")), at),
        lat=F.col("at.lat"), lon=F.col("at.lon"), geo_precision=F.lit("exact"), place_name=p("place"), place_hint=p("place"), category=F.lit("seismic"), magnitude=p("mag"), tone=F.lit(-0.5), raw=F.to_json("f"),
    )


# Category titles of natural events.
NATURAL_CATEGORY = {
    "wildfires": "wildfire", "volcanoes": "natural_disaster", "severe storms": "severe_weather", "floods": "severe_weather", "drought": "natural_disaster", "earthquakes": "seismic", "landslides": "natural_disaster",
    "sea and lake ice": "natural_disaster", "dust and haze": "health", "snow and ice": "severe_weather", "water color": "natural_disaster", "temperature extremes": "severe_weather", "manmade": "infrastructure",
}
_NATURAL = "events array<struct<id string, title string, description string, link string, categories array<struct<id string, title string>>, sources array<struct<id string, url string>>, geometries array<struct<date string, type string, coordinates string>>, geometry array<struct<date string, type string, coordinates string>>>>"


def natural_events(df: DataFrame, now: Column) -> DataFrame:
    """Drafts of tracked natural events: the newest usable point (of a polygon its first corner) of each."""
    e = df.select(F.explode(F.from_json("payload", _NATURAL)["events"]).alias("e"))
    shapes = F.coalesce("e.geometries", "e.geometry")
    # Coordinates stay text in the schema, as points and polygons nest differently; the first two numbers are the first corner.
    parsed = F.transform(
        shapes,
        lambda g: F.struct(
            F.coalesce(time.parse_date(g["date"]), F.lit("1900-01-01").cast("timestamp")).alias("date"),
            usable_location(
                F.regexp_extract(g["coordinates"], r"^[\[\s]*-?[\d.eE+-]+\s*,\s*(-?[\d.eE+-]+)", 1).try_cast("double"), F.regexp_extract(g["coordinates"], r"^[\[\s]*(-?[\d.eE+-]+)", 1).try_cast("double")
            ).alias("at"),
            time.parse_date(g["date"]).alias("when"),
        ),
    )
    e = e.withColumn("last", F.array_max(F.filter(parsed, lambda g: g["at"].isNotNull()))).where("last is not null")
    name = F.lower(F.try_element_at("e.categories", F.lit(1))["title"])
    when = F.coalesce("last.when", now)
    return draft(
        e, source_id=F.lit("nasa.eonet"), external_id=F.concat_ws(":", "e.id", F.date_format("last.when", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), title=F.col("e.title"), body=F.col("e.description"),
        url=text.safe_url(F.coalesce(F.try_element_at("e.sources", F.lit(1))["url"], F.col("e.link"))), occurred_at=when, published_at=when, lat=F.col("last.at.lat"), lon=F.col("last.at.lon"), geo_precision=F.lit("exact"),
        category=lookup(name, NATURAL_CATEGORY, "natural_disaster"), tone=F.lit(-0.4), raw=F.to_json("e"),
    )


# What an alert's event is about and its category; the first that fits counts.
WEATHER_WORDS = [("fire|red flag", "wildfire"), ("tsunami|earthquake", "seismic"), ("volcan|avalanche|landslide", "natural_disaster"), ("air quality|smoke", "health")]
_WEATHER = "features array<struct<id string, geometry struct<type string, coordinates string>, properties struct<id string, event string, headline string, description string, severity string, urgency string, certainty string, areaDesc string, senderName string, sent string, effective string, onset string>>>"


def weather_alerts(df: DataFrame, now: Column) -> DataFrame:
    """Drafts of weather alerts with a polygon: its corners' spherical centre; the onset is never the time."""
    f = df.select(F.explode(F.from_json("payload", _WEATHER)["features"]).alias("f"))
    numbers = F.transform(F.regexp_extract_all("f.geometry.coordinates", F.lit(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    f = f.withColumn("n", numbers).where("size(n) >= 2")
    corners = F.transform(F.sequence(F.lit(0), (F.size("n") / 2).cast("int") - 1), lambda i: F.struct(F.radians(F.get("n", 2 * i + 1)).alias("la"), F.radians(F.get("n", 2 * i)).alias("lo")))
    total = lambda part: F.aggregate("corners", F.lit(0.0), lambda acc, c: acc + part(c))
    f = f.withColumn("corners", corners).withColumns(
        {"x": total(lambda c: F.cos(c["la"]) * F.cos(c["lo"])), "y": total(lambda c: F.cos(c["la"]) * F.sin(c["lo"])), "z": total(lambda c: F.sin(c["la"])), "w": F.size("corners").cast("double")}
    )
    f = f.withColumn("at", geo.direction(F.col("x"), F.col("y"), F.col("z"), F.col("w"))).where("at is not null")
    p = lambda c: F.col(f"f.properties.{c}")
    event = F.coalesce(p("event"), F.lit("Weather alert"))
    sent = F.coalesce(p("sent").try_cast("timestamp"), now)
    category = F.lit("severe_weather")
    for words, kind in reversed(WEATHER_WORDS):
        category = F.when(F.lower(event).rlike(words), kind).otherwise(category)
    level = F.lower(p("severity"))
    magnitude = F.when(level == "minor", 1).when(level == "severe", 3).when(level == "extreme", 4).otherwise(2)
    return draft(
        f, source_id=F.lit("nws.alerts"), external_id=F.coalesce("f.id", p("id"), F.concat_ws(":", event, p("sent"))), title=F.coalesce(text.truncate(p("headline"), 200), F.concat(event, F.lit(" — "), F.coalesce(p("areaDesc"), F.lit("US")))),
        body=text.truncate(p("description"), 2500), url=text.safe_url(F.col("f.id")), occurred_at=F.least(sent, F.coalesce(p("effective").try_cast("timestamp"), sent)), published_at=sent, lat=F.col("at.lat"), lon=F.col("at.lon"),
        geo_precision=F.lit("city"), place_name=p("areaDesc"), country_code=F.lit("US"), place_hint=p("areaDesc"), category=category, magnitude=magnitude, tone=F.lit(-0.5), actors=F.filter(F.array(p("senderName")), lambda a: a.isNotNull()), raw=F.to_json("f.properties"),
    )


# Kinds of words and the category they stand for; the first kind that occurs counts.
RELIEF_WORDS = [
    ("cholera disease epidemic health measles outbreak pandemic", "health"),
    ("conflict fighting hostilities violence war", "armed_conflict"),
    ("cyclone flood hurricane storm typhoon", "severe_weather"),
    ("earthquake landslide tsunami volcano", "natural_disaster"),
]
_RELIEF = "data array<struct<id string, fields struct<title string, body string, url_alias string, url string, date struct<original string, created string, changed string>, country array<struct<name string, iso3 string>>, disaster_type array<struct<name string>>, theme array<struct<name string>>, source array<struct<name string, shortname string>>>>>"


def relief_category(words: Column) -> Column:
    """Category of a situation report by the first kind of word that occurs."""
    t, out = F.lower(words), F.lit("humanitarian")
    for kind, category in reversed(RELIEF_WORDS):
        out = F.when(t.rlike(rf"\b({'|'.join(kind.split())})\b"), category).otherwise(out)
    return out


def situation_reports(df: DataFrame) -> DataFrame:
    """Drafts of situation reports with a title and one of the three dates."""
    i = df.select(F.explode(F.from_json("payload", _RELIEF)["data"]).alias("i"))
    f = lambda c: F.col(f"i.fields.{c}")
    i = i.withColumns({"title": text.clean_text(f("title")), "body": text.clean_text(f("body")), "at": F.coalesce(*[time.parse_date(f(f"date.{k}")) for k in ("original", "created", "changed")])}).where("title <> '' and at is not null")
    names = lambda c, field: F.transform(f(c), lambda x: x[field])
    words = F.concat_ws(" ", "title", "body", names("disaster_type", "name"), names("theme", "name"))
    actors = F.filter(F.transform(f("source"), lambda s: F.trim(F.coalesce(s["shortname"], s["name"]))), lambda s: s != "")
    return draft(
        i, source_id=F.lit("ocha.reliefweb"), external_id=F.col("i.id"), title=F.col("title"), body=F.when(F.col("body") != "", text.truncate(F.col("body"), 1800)), url=F.coalesce(text.safe_url(f("url_alias")), text.safe_url(f("url"))),
        occurred_at=F.col("at"), published_at=F.coalesce(time.parse_date(f("date.created")), "at"), place_hint=F.trim(F.try_element_at(names("country", "name"), F.lit(1))), category=relief_category(words), tone=F.lit(-0.55),
        report_count=F.greatest(F.lit(1), F.coalesce(F.size(actors), F.lit(1))), actors=F.coalesce(actors, F.array().cast("array<string>")), raw=F.to_json("i"),
    )


# Where a space-weather message says its scale, its number and that it is withdrawn.
K_INDEX, SCALE, SERIAL, WITHDRAWN = r"(?i)K-index of\s*([4-9])", r"(?i)\b[GRS]([1-5])\b", r"(?i)Serial Number:\s*(\d+)", r"(?i)\bCANCEL(?:LED)?\b"


def space_weather(df: DataFrame) -> DataFrame:
    """Drafts of space-weather products; cancellations are dropped."""
    p = df.select(F.explode(F.from_json("payload", "array<struct<product_id string, issue_datetime string, message string>>")).alias("p"))
    stamp = F.when(F.col("p.issue_datetime").rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), F.col("p.issue_datetime")).otherwise(F.concat(F.regexp_replace("p.issue_datetime", " ", "T"), F.lit("Z")))
    p = p.withColumns({"message": text.clean_text(F.col("p.message")), "at": time.parse_date(stamp)}).where("message <> '' and at is not null").where(~F.col("message").rlike(WITHDRAWN))
    lines = F.transform(F.split("p.message", r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    headline = F.get(F.filter(lines, lambda s: s.rlike(r"(?i)^(?:ALERT|SUMMARY|WARNING|WATCH):")), F.lit(0))
    digit = lambda pattern: F.regexp_extract("message", pattern, 1).try_cast("int")
    k = digit(K_INDEX)
    scale = F.coalesce(digit(SCALE), F.when(k.isNotNull(), F.greatest(F.lit(1), k - 4)))
    serial = F.coalesce(F.nullif(F.regexp_extract("message", SERIAL, 1), F.lit("")), F.lit("none"))
    key = F.concat_ws(":", F.coalesce("p.product_id", F.lit("product")), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), serial)
    return draft(
        p, source_id=F.lit("noaa.swpc"), external_id=key, title=F.coalesce(headline, F.trim(F.concat(F.lit("NOAA space weather product "), F.coalesce("p.product_id", F.lit(""))))), body=text.truncate(F.col("message"), 1800),
        occurred_at=F.col("at"), published_at=F.col("at"), category=F.lit("space"), magnitude=scale, tone=F.lit(-0.35), actors=F.array(F.lit("NOAA Space Weather Prediction Center")), raw=F.to_json("p"),
    )


# --- pages, CSV and XML ----------------------------------------------------------------------------------


def sanctions_updates(df: DataFrame) -> DataFrame:
    """Drafts of the dated links of a sanctions page, the first of each path, at noon UTC."""
    links = df.select(F.posexplode(F.regexp_extract_all("payload", F.lit(r"""(?is)<a\b[^>]*href=["']/recent-actions/\d{8}["'][^>]*>.*?</a>"""), F.lit(0))).alias("pos", "a"))
    path = F.regexp_extract("a", r"(?i)href=[\"'](/recent-actions/\d{8})[\"']", 1)
    links = links.select("pos", path.alias("path"), text.clean_text(F.col("a")).alias("title")).where("title <> ''")
    links = links.withColumn("at", F.try_to_timestamp(F.concat(F.right("path", F.lit(8)), F.lit("12")), F.lit("yyyyMMddHH"))).where("at is not null")
    first = Window.partitionBy("path").orderBy("pos")
    links = links.withColumn("k", F.row_number().over(first)).where("k = 1")
    return draft(
        links, source_id=F.lit("us.ofac"), external_id=F.col("path"), title=F.concat(F.lit("OFAC: "), "title"), body=F.lit("A sanctions list update was published."), url=F.concat(F.lit("https://ofac.treasury.gov"), "path"),
        occurred_at=F.col("at"), published_at=F.col("at"), category=F.lit("economy"), tone=F.lit(-0.45), actors=F.array(F.lit("US Treasury"), F.lit("Office of Foreign Assets Control")),
    )


def bin_detections(df: DataFrame, degrees: float = 0.25, min_power: float = 50) -> DataFrame:
    """Fire detections (lat, lon, frp, occurred_at) by grid cell: power-weighted centre, power, n, latest."""
    power = F.sum("frp")
    binned = df.groupBy(F.floor(F.col("lat") / degrees).alias("row"), F.floor(F.col("lon") / degrees).alias("column")).agg(
        (F.sum(F.col("lat") * F.col("frp")) / power).alias("lat"), (F.sum(F.col("lon") * F.col("frp")) / power).alias("lon"), power.alias("power"), F.count(F.lit(1)).alias("n"), F.max("occurred_at").alias("latest")
    )
    return binned.where(F.col("power") >= min_power)


def fire_detections(csv: DataFrame) -> DataFrame:
    """lat, lon, frp, occurred_at of a header-addressed detection table; low confidence and no power are dropped."""
    confidence = F.lower(F.trim("confidence")) if "confidence" in csv.columns else F.lit("")
    rows = csv.where(F.coalesce(confidence, F.lit("")).isin("", "n", "h", "nominal", "high"))
    rows = rows.withColumns({"at": _point(F.col("latitude"), F.col("longitude")), "power": geo.leading_number(F.col("frp").cast("string"))}).where("at is not null and power > 0")
    clock = F.lpad(F.coalesce(F.trim(F.col("acq_time").cast("string")), F.lit("0000")), 4, "0")
    return rows.select("at.lat", "at.lon", F.col("power").alias("frp"), F.try_to_timestamp(F.concat(F.col("acq_date").cast("string"), F.lit(" "), clock), F.lit("yyyy-MM-dd HHmm")).alias("occurred_at"))


def fires(csv: DataFrame) -> DataFrame:
    """Drafts of burning cells."""
    cells = bin_detections(fire_detections(csv)).where("latest is not null")
    day = F.date_format("latest", "yyyy-MM-dd")
    return draft(
        cells, source_id=F.lit("firms.fires"), external_id=F.concat_ws(":", F.col("row").cast("string"), F.col("column").cast("string"), day), title=F.format_string("Active wildfire detected burning near %.2f, %.2f", "lat", "lon"),
        body=F.format_string("%d fire detections with a total radiative power of %.0f megawatts.", "n", "power"), occurred_at=F.col("latest"), published_at=F.col("latest"), lat=F.col("lat"), lon=F.col("lon"), geo_precision=F.lit("exact"),
        category=F.lit("wildfire"), magnitude=F.col("power"), tone=F.lit(-0.5),
    )


_ITEM = (
    "title string, description string, summary string, `content:encoded` string, content string, link array<struct<_VALUE string, _href string, _rel string>>, pubDate string, published string, updated string, `dc:date` string, guid string, id string, "
    "category array<struct<_VALUE string, _term string>>, `georss:point` string, `geo:Point` struct<`geo:lat` string, `geo:long` string>, `geo:lat` string, `geo:long` string"
)


def _items(df: DataFrame, item: str) -> DataFrame:
    """Items of RSS 2 channels, RDF documents and Atom feeds in one frame of column ``i``."""
    items = f"array<struct<{item}>>"
    x = df.select(F.from_xml("payload", f"channel struct<item {items}>, item {items}, entry {items}", {"mode": "PERMISSIVE"}).alias("x"))
    return x.select(F.explode(F.flatten(F.filter(F.array("x.channel.item", "x.item", "x.entry"), lambda a: a.isNotNull()))).alias("i"))


def node_text(nodes: Column, at: int = 0) -> Column:
    """Trimmed text of one of an array of nodes (struct with ``_VALUE``); null for none or blank."""
    return F.nullif(F.trim(F.get(nodes, F.lit(at))["_VALUE"]), F.lit(""))


def node_attribute(nodes: Column, name: str, at: int = 0) -> Column:
    """An attribute of one of an array of nodes (struct with ``_name``)."""
    return F.get(nodes, F.lit(at))[f"_{name}"]


def feed_items(df: DataFrame) -> DataFrame:
    """title, description, link, guid, published (raw text), lat, lon, categories of feed items with a title."""
    i = _items(df, _ITEM)
    clean = lambda c: F.nullif(text.clean_text(F.col(c)), F.lit(""))
    own = F.filter("i.link", lambda x: x["_href"].isNotNull() & (x["_rel"].isNull() | (x["_rel"] == "alternate")) | x["_VALUE"].startswith("http"))
    link = F.get(F.transform(own, lambda x: F.coalesce(x["_href"], F.trim(x["_VALUE"]))), F.lit(0))
    geo_text = F.split(F.trim("i.`georss:point`"), r"[\s,]+")
    point = F.coalesce(_point(F.get(geo_text, F.lit(0)), F.get(geo_text, F.lit(1))), _point(F.col("i.`geo:Point`.`geo:lat`"), F.col("i.`geo:Point`.`geo:long`")), _point(F.col("i.`geo:lat`"), F.col("i.`geo:long`")))
    categories = F.filter(F.transform("i.category", lambda c: F.coalesce(F.nullif(F.trim(c["_VALUE"]), F.lit("")), c["_term"])), lambda c: c.isNotNull())
    named = i.select(
        clean("i.title").alias("title"), F.coalesce(clean("i.description"), clean("i.summary"), clean("i.`content:encoded`"), clean("i.content")).alias("description"), link.alias("link"),
        F.coalesce("i.guid", "i.id", link).alias("guid"), F.coalesce("i.pubDate", "i.published", "i.updated", "i.`dc:date`").alias("published"), point.alias("at"), F.coalesce(categories, F.array().cast("array<string>")).alias("categories"),
    ).where("title is not null")
    return named.select("title", "description", "link", "guid", "published", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), "categories")


def feed_drafts(items: DataFrame, source_id: str, zone: str = "UTC", date_order: str = "DMY") -> DataFrame:
    """Drafts of feed items; a null time where ``published`` names none."""
    from ..operators.timestamps import normalise_timestamps

    stamped = normalise_timestamps(items.withColumns({"__zone": F.lit(zone), "__order": F.lit(date_order)}), "published", "__zone", "__order", [zone], "__at")
    at = F.timestamp_micros("__at.utc_us")
    key = F.coalesce("guid", "link", text.content_hash(F.col("title"), F.col("description")))
    return draft(
        stamped, source_id=F.lit(source_id), external_id=key, title=F.col("title"), body=F.col("description"), url=text.safe_url(F.col("link")), occurred_at=at, published_at=at, lat=F.col("lat"), lon=F.col("lon"),
        geo_precision=F.when(F.col("lat").isNotNull(), "city"), place_hint=F.nullif(F.array_join("categories", ", "), F.lit("")),
    )


# Event types and levels of the multi-hazard feed.
HAZARD_CATEGORY = {"EQ": "seismic", "TC": "severe_weather", "FL": "severe_weather", "DR": "natural_disaster", "WF": "wildfire", "VO": "natural_disaster", "TS": "seismic"}
HAZARD_LABEL = {"EQ": "Earthquake", "TC": "Tropical cyclone", "FL": "Flood", "DR": "Drought", "WF": "Wildfire", "VO": "Volcanic activity", "TS": "Tsunami"}
_HAZARD = (
    "title string, description string, link string, pubDate string, `gdacs:eventid` string, `gdacs:episodeid` string, `gdacs:eventtype` string, `gdacs:alertlevel` string, `gdacs:country` string, `gdacs:iso3` string, "
    "`gdacs:fromdate` string, `gdacs:dateadded` string, `georss:point` string, `geo:Point` struct<`geo:lat` string, `geo:long` string>"
)


def hazard_alerts(df: DataFrame, now: Column, iso3: dict[str, str] | None = None) -> DataFrame:
    """Drafts of multi-hazard alerts; every episode of an event is a draft. ``iso3`` maps to two-letter codes."""
    parsed = df.select(F.explode(F.from_xml("payload", f"channel struct<item array<struct<{_HAZARD}>>>")["channel"]["item"]).alias("i"))
    g = lambda c: F.nullif(F.trim(F.col(f"i.`gdacs:{c}`")), F.lit(""))
    kind, level = F.upper(g("eventtype")), F.lower(g("alertlevel"))
    geo_text = F.split(F.trim("i.`georss:point`"), r"[\s,]+")
    point = F.coalesce(_point(F.col("i.`geo:Point`.`geo:lat`"), F.col("i.`geo:Point`.`geo:long`")), _point(F.get(geo_text, F.lit(0)), F.get(geo_text, F.lit(1))))
    dated = parsed.where(g("eventid").isNotNull()).withColumn("at", point)
    from ..operators.timestamps import normalise_timestamps

    for name, column in (("d1", g("fromdate")), ("d2", F.col("i.pubDate")), ("d3", g("dateadded"))):
        dated = normalise_timestamps(dated.withColumns({"__v": column, "__z": F.lit("UTC"), "__o": F.lit("DMY")}), "__v", "__z", "__o", ["UTC"], name)
    when = F.coalesce(F.timestamp_micros("d1.utc_us"), F.timestamp_micros("d2.utc_us"), now)
    title = F.coalesce(F.nullif(text.clean_text(F.col("i.title")), F.lit("")), F.concat(F.coalesce(lookup(kind, HAZARD_LABEL), kind), F.lit(" alert")))
    key = F.concat(F.coalesce(kind, F.lit("")), F.concat_ws(".", g("eventid"), g("episodeid")))
    return draft(
        dated, source_id=F.lit("gdacs.alerts"), external_id=key, title=title, body=_sentence(text.clean_text(F.col("i.description")), F.concat(F.lit("Country: "), g("country"), F.lit("."))), url=text.safe_url(F.col("i.link")),
        occurred_at=when, published_at=F.coalesce(F.timestamp_micros("d3.utc_us"), when), lat=F.col("at.lat"), lon=F.col("at.lon"), geo_precision=F.when(F.col("at").isNotNull(), "exact"), place_name=g("country"),
        country_code=lookup(g("iso3"), iso3 or {"": ""}), place_hint=g("country"), category=lookup(kind, HAZARD_CATEGORY, "natural_disaster"), magnitude=F.when(level == "orange", 2).when(level == "red", 3).otherwise(1), tone=F.lit(-0.6), raw=F.to_json("i"),
    )


# --- registry --------------------------------------------------------------------------------------------

PARSERS = {
    "gdelt.events": event_export, "usgs.quakes": earthquakes, "gdacs.alerts": hazard_alerts, "nasa.eonet": natural_events, "nws.alerts": weather_alerts, "firms.fires": fires, "ocha.reliefweb": situation_reports,
    "noaa.swpc": space_weather, "us.ofac": sanctions_updates,
}
NEEDS = {"firms.fires": ["FIRMS_MAP_KEY"], "ocha.reliefweb": ["RELIEFWEB_APPNAME"]}


def available(environment: dict[str, str]) -> tuple[dict, dict[str, str]]:
    """(parsers that can run, reasons why the others can't) given the variables that are set."""
    missing = {s: [v for v in needed if not environment.get(v)] for s, needed in NEEDS.items()}
    reasons = {s: f"needs {', '.join(v)}" for s, v in missing.items() if v}
    return {s: p for s, p in PARSERS.items() if s not in reasons}, reasons


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses, one file a row, for replay."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def backoff_seconds(failures: int) -> int:
    """Pause of a failing source: a minute, doubled with every failure, two hours at most."""
    return 0 if failures <= 0 else min(7200, 60 * 2 ** min(failures - 1, 20))


def retry_after_seconds(header: str | None, now_s: float) -> float | None:
    """Seconds that a server asks to wait, given as seconds or a date; 120 at most, None if unreadable."""
    from email.utils import parsedate_to_datetime

    if not header:
        return None
    try:
        wait = float(header) if header.strip().isdigit() else parsedate_to_datetime(header).timestamp() - now_s
    except (TypeError, ValueError):
        return None
    return max(0.0, min(120.0, wait))

