"""Queries that run the feed parsers, with their SQL.

Payloads are made from whole tables where a table has what a feed sends; feeds without one get responses
written out below, whose drafts are listed in the SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _O, _now, _observations, registry
from .sources import feeds, registry as sources
from .tables import load

QUERIES, SQL, query = registry()
_S = "epoch_us({}) // 1000000"
_PLACED = "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 360 AND NOT (lat = 0 AND lon = 0)"
_WRAP = "CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END"


def _payloads(spark, *responses) -> DataFrame:
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in responses], "payload string")


def _text(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def _values(columns: str, *rows) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) AS t({columns})"




@query(
    f"""WITH {_O}, r AS (SELECT *, severity % 23 AS root FROM o WHERE severity % 4 >= 2 AND {_PLACED})
SELECT id, CASE WHEN root IN (2, 3, 4, 5, 6, 16) THEN 'diplomacy' WHEN root = 7 THEN 'humanitarian' WHEN root IN (1, 8, 9, 10, 11, 12, 13) THEN 'political' WHEN root IN (14, 17) THEN 'civil_unrest' WHEN root IN (15, 18, 19) THEN 'armed_conflict' WHEN root = 20 THEN 'terrorism' ELSE 'other' END AS category,
 CASE geo_precision WHEN 'exact' THEN 'city' WHEN 'city' THEN 'city' WHEN 'admin1' THEN 'admin1' WHEN 'country' THEN 'country' ELSE 'unknown' END AS geo_precision, {_S.format('occurred_at')} AS at_s, greatest(coalesce(report_count, 0), 1) AS report_count,
 round(lat, 5) AS lat, round({_WRAP}, 5) AS lon FROM r"""
)
def feed_event_export(spark, d):
    """Every observation as a line of an event export, read back by its parser."""
    o = _observations(spark, d, "source_id", "occurred_at", "severity", "lat", "lon", "geo_precision", "place_name", "report_count", "tone", "magnitude", "country_code", "url")
    kind = F.when(F.col("geo_precision") == "exact", "3").when(F.col("geo_precision") == "city", "4").when(F.col("geo_precision") == "admin1", "2").when(F.col("geo_precision") == "country", "1").otherwise("9")
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields = {
        "id": F.col("id"), "day": F.date_format("occurred_at", "yyyyMMdd"), "actor1": F.col("source_id"), "root": F.lpad((F.col("severity") % 23).cast("string"), 2, "0"), "mentions": (F.col("severity") % 4).cast("string"), "sources": some("report_count"),
        "goldstein": some("magnitude"), "tone": some("tone"), "geo_type": kind, "place": some("place_name"), "fips": some("country_code"), "lat": some("lat"), "lon": some("lon"), "added": F.date_format("occurred_at", "yyyyMMddHHmmss"), "url": some("url"),
    }
    at = {i: name for name, i in feeds.EXPORT_FIELDS.items()}
    lines = o.select(F.concat_ws("\t", *[fields.get(at.get(i, ""), F.lit("")) for i in range(feeds.EXPORT_WIDTH)]).alias("value"))
    rows = feeds.event_export(lines, _now())
    return rows.select(F.col("external_id").alias("id"), "category", "geo_precision", F.unix_seconds("occurred_at").alias("at_s"), "report_count", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query(f"WITH {_O} SELECT id, round(lat, 5) AS lat, round({_WRAP}, 5) AS lon, CASE WHEN NOT isnan(magnitude) THEN round(magnitude, 4) END AS magnitude, epoch_us(occurred_at) // 1000 AS at_ms, 'seismic' AS category, 'exact' AS geo_precision FROM o WHERE {_PLACED}")
def feed_earthquakes(spark, d):
    """Every located observation as a feature of an earthquake feed."""
    o = _observations(spark, d, "occurred_at", "lat", "lon", "magnitude", "place_name", where=F.expr("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"))
    feature = F.struct("id", F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.when(~F.isnan("magnitude"), F.col("magnitude")).alias("mag"), F.col("place_name").alias("place"), F.unix_millis("occurred_at").alias("time")).alias("properties"))
    rows = feeds.earthquakes(o.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("payload")), _now())
    return rows.select(F.col("external_id").alias("id"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("magnitude", 4).alias("magnitude"), F.unix_millis("occurred_at").alias("at_ms"), "category", "geo_precision")


@query(f"WITH {_O} SELECT id, true AS near, CAST(1 + severity % 4 AS DOUBLE) AS magnitude, CASE WHEN severity % 3 = 0 THEN 'wildfire' WHEN severity % 3 = 1 THEN 'health' ELSE 'severe_weather' END AS category, {_S.format('occurred_at')} AS at_s FROM o WHERE {_PLACED} AND abs(lat) < 80 AND abs(lon) < 179")
def feed_weather_alerts(spark, d):
    """Every located observation as a weather alert over a small square around it."""
    o = _observations(spark, d, "occurred_at", "lat", "lon", "severity", where=F.expr("abs(lat) < 80 and abs(lon) < 179 and not (lat = 0 and lon = 0)"))
    corner = lambda dy, dx: F.array(F.col("lon") + dx, F.col("lat") + dy)
    ring = F.array(*[corner(a, b) for a, b in ((-0.001, -0.001), (-0.001, 0.001), (0.001, 0.001), (0.001, -0.001))])
    level = F.element_at(F.array(*[F.lit(x) for x in ("Minor", "Moderate", "Severe", "Extreme")]), F.col("severity") % 4 + 1)
    event = F.element_at(F.array(*[F.lit(x) for x in ("Red Flag Warning", "Air Quality Alert", "Wind Advisory")]), F.col("severity") % 3 + 1)
    sent = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    feature = F.struct("id", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(event.alias("event"), level.alias("severity"), sent.alias("sent")).alias("properties"))
    rows = feeds.weather_alerts(o.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("payload")), _now())
    near = (F.abs(F.col("lat") - F.col("o_lat")) < 1e-4) & (F.abs(F.col("lon") - F.col("o_lon")) < 1e-4)
    rows = rows.join(o.select(F.col("id").alias("external_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")), "external_id")
    return rows.select(F.col("external_id").alias("id"), near.alias("near"), "magnitude", "category", F.unix_seconds("occurred_at").alias("at_s"))


@query(
    """SELECT DISTINCT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, country[1].name AS place_hint, greatest(1, len(list_filter(list_transform(source, lambda s: trim(coalesce(s.shortname, s.name))), lambda s: s <> ''))) AS report_count FROM reliefweb_items WHERE title IS NOT NULL AND trim(title) <> '' AND title NOT LIKE '%<%' AND title NOT LIKE '%&%'"""
)
def feed_situation_reports(spark, d):
    """Every situation report as the feed sends it; the dates, which p1 is about, are replaced by one that all parsers read."""
    r = load(spark, d, "reliefweb_items").where("title not like '%<%' and title not like '%&%'").select("id", "title", "country", "source").distinct()
    item = F.struct("id", F.struct("title", F.struct(F.lit("2025-01-02T00:00:00+00:00").alias("created")).alias("date"), "country", "source").alias("fields"))
    rows = feeds.situation_reports(r.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("payload")))
    return rows.select(F.col("external_id").alias("id"), "title", "place_hint", "report_count")


@query("SELECT DISTINCT trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(guid, CASE WHEN link LIKE 'http%' THEN trim(link) END) AS guid, len(categories) AS n FROM feed_items WHERE trim(title) <> '' AND title NOT LIKE '%<%' AND title NOT LIKE '%&%' AND coalesce(guid, link, '') NOT LIKE '%&%' AND len(list_filter(categories, lambda c: c IS NULL OR trim(c) = '' OR c LIKE '%&%' OR c LIKE '%<%')) = 0")
def feed_rss_items(spark, d):
    """Every feed item as RSS 2, parsed again."""
    f = load(spark, d, "feed_items").where("title not like '%<%' and title not like '%&%' and coalesce(guid, link, '') not like '%&%'").where("size(filter(categories, c -> c is null or trim(c) = '' or c like '%&%' or c like '%<%')) = 0")
    tag = lambda name, value: F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))
    categories = F.array_join(F.transform("categories", lambda c: F.concat(F.lit("<category>"), c, F.lit("</category>"))), "")
    payload = F.concat(F.lit("<rss><channel><item>"), tag("title", F.col("title")), tag("link", F.col("link")), tag("guid", F.col("guid")), categories, F.lit("</item></channel></rss>"))
    return feeds.feed_items(f.select(payload.alias("payload"))).select("title", "guid", F.size("categories").alias("n")).distinct()


@query(f"WITH {_O}, b AS (SELECT floor(lat / 0.25) AS r, floor(lon / 0.25) AS c, sum(severity) AS power, count(*) AS n, max(epoch_us(occurred_at) // 60000000 * 60) AS at_s, strftime(max(occurred_at), '%Y-%m-%d') AS day FROM o WHERE severity > 0 AND {_PLACED} AND abs(lon) <= 180 GROUP BY 1, 2) SELECT CAST(r AS BIGINT) || ':' || CAST(c AS BIGINT) || ':' || day AS external_id, CAST(power AS DOUBLE) AS magnitude, at_s, 'wildfire' AS category FROM b WHERE power >= 50")
def feed_fires(spark, d):
    """Every located observation as a line of a detection table."""
    o = _observations(spark, d, "occurred_at", "lat", "lon", "severity", where=F.expr("abs(lon) <= 180"))
    csv = o.select(F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"), F.col("severity").cast("string").alias("frp"), F.date_format("occurred_at", "yyyy-MM-dd").alias("acq_date"), F.regexp_replace(F.date_format("occurred_at", "HHmm"), "^0+(?=.)", "").alias("acq_time"), F.lit("nominal").alias("confidence"))
    return feeds.fires(csv).select("external_id", "magnitude", F.unix_seconds("occurred_at").alias("at_s"), "category")


@query(f"WITH {_O} SELECT id || ':' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.000Z') AS external_id, round(lat, 5) AS lat, round({_WRAP}, 5) AS lon, CASE severity % 3 WHEN 0 THEN 'wildfire' WHEN 1 THEN 'severe_weather' ELSE 'natural_disaster' END AS category FROM o WHERE {_PLACED}")
def feed_natural_events(spark, d):
    """Every located observation as a tracked event: an older point at the pole, then a polygon that begins at its place."""
    o = _observations(spark, d, "occurred_at", "lat", "lon", "severity", where=F.expr("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Wildfires", "Floods", "Something new")]), F.col("severity") % 3 + 1)
    number = lambda c: F.col(c).cast("string")
    shape = lambda at, kind, xy: F.concat(F.lit('{"date":"'), stamp(at), F.lit(f'","type":"{kind}","coordinates":'), xy, F.lit("}"))
    older = shape(F.col("occurred_at") - F.expr("INTERVAL 1 DAY"), "Point", F.lit("[10.0,89.0]"))
    newer = shape(F.col("occurred_at"), "Polygon", F.concat(F.lit("[[["), number("lon"), F.lit(","), number("lat"), F.lit("],[1.0,1.0]]]")))
    payload = F.concat(F.lit('{"events":[{"id":"'), F.col("id"), F.lit('","title":"x","categories":[{"id":"c","title":"'), name, F.lit('"}],"geometry":['), older, F.lit(","), newer, F.lit("]}]}"))
    rows = feeds.natural_events(o.where("not (lat = 0 and lon = 0) and abs(lat) <= 90 and abs(lon) <= 360").select(payload.alias("payload")), _now())
    return rows.select("external_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "category")


_MANIFEST = "12 aa http://x.example/20250101000000.mentions.CSV.zip\r\nshort line\r\n13 bb http://x.example/20250101001500.export.CSV.zip\n14 cc http://x.example/20250101003000.EXPORT.CSV.zip"


@query(_values("url, cursor", ("http://x.example/20250101001500.export.CSV.zip", "20250101001500")))
def feed_manifest(spark, d):
    """The first export file of a manifest; a manifest without one gives no row."""
    return feeds.newest_export(_payloads(spark, _MANIFEST, "nothing here"))


_SPACE = [
    {"product_id": "K06A", "issue_datetime": "2025-01-02 03:04:05.000", "message": "Space Weather Message Code: ALTK06\r\nSerial Number: 512\r\nALERT: Geomagnetic K-index of 6\r\nThreshold reached"},
    {"product_id": "A30F", "issue_datetime": "2025-01-03 10:00:00", "message": "WATCH: Geomagnetic Storm Category G3 Predicted"},
    {"product_id": "XX", "issue_datetime": "2025-01-04 10:00:00", "message": "CANCEL WARNING: Geomagnetic K-index of 5"},
    {"product_id": "SUM", "issue_datetime": "2025-01-05 00:30:00", "message": "Summary of the day without a headline"},
]


@query(
    _values(
        "external_id, title, magnitude, at_s", ("K06A:2025-01-02T03:04:05.000Z:512", "ALERT: Geomagnetic K-index of 6", 2.0, 1735787045), ("A30F:2025-01-03T10:00:00.000Z:none", "WATCH: Geomagnetic Storm Category G3 Predicted", 3.0, 1735898400),
        ("SUM:2025-01-05T00:30:00.000Z:none", "NOAA space weather product SUM", None, 1736037000),
    )
)
def feed_space_weather(spark, d):
    """Space-weather products: K-index and scale, serial number, headline, cancellation."""
    return feeds.space_weather(_payloads(spark, _SPACE)).select("external_id", "title", "magnitude", F.unix_seconds("occurred_at").alias("at_s"))


_PAGE = """<ul><li><a href="/recent-actions/20250102">Two <i>names</i> added &amp; one removed</a></li><li><a href="/recent-actions/20250102">again</a></li><li><a href="/other/20250103">no</a></li>
<li><a class="x" href='/recent-actions/20250230'>no such day</a></li><li><a href="/recent-actions/20250107">   </a></li><li><a href='/recent-actions/20250110'>General licence</a></li></ul>"""


@query(_values("external_id, title, at_s", ("/recent-actions/20250102", "OFAC: Two names added & one removed", 1735819200), ("/recent-actions/20250110", "OFAC: General licence", 1736510400)))
def feed_sanctions(spark, d):
    """Dated links of a sanctions page, the first of each, at noon."""
    return feeds.sanctions_updates(_payloads(spark, _PAGE)).select("external_id", "title", F.unix_seconds("occurred_at").alias("at_s"))


_HAZARDS = """<rss xmlns:gdacs="http://g.example" xmlns:georss="http://r.example" xmlns:geo="http://w.example"><channel>
<item><title>Flood in Peru</title><gdacs:eventid>12</gdacs:eventid><gdacs:episodeid>3</gdacs:episodeid><gdacs:eventtype>fl</gdacs:eventtype><gdacs:alertlevel>Orange</gdacs:alertlevel><gdacs:country>Peru</gdacs:country><gdacs:iso3>PER</gdacs:iso3><gdacs:fromdate>Wed, 01 Jan 2025 00:00:00 GMT</gdacs:fromdate><georss:point>-12 -77</georss:point></item>
<item><gdacs:eventid>12</gdacs:eventid><gdacs:episodeid>4</gdacs:episodeid><gdacs:eventtype>TC</gdacs:eventtype><gdacs:alertlevel>Red</gdacs:alertlevel><gdacs:iso3>XXX</gdacs:iso3><pubDate>Thu, 02 Jan 2025 06:00:00 GMT</pubDate><geo:Point><geo:lat>10.5</geo:lat><geo:long>190</geo:long></geo:Point></item>
<item><title>no id</title></item></channel></rss>"""


@query(_values("external_id, title, category, magnitude, lat, lon, country_code, at_s", ("FL12.3", "Flood in Peru", "severe_weather", 2.0, -12.0, -77.0, "PE", 1735689600), ("TC12.4", "Tropical cyclone alert", "severe_weather", 3.0, 10.5, -170.0, None, 1735797600)))
def feed_hazards(spark, d):
    """Multi-hazard alerts: levels, episodes, either form of point, three-letter codes by the country list."""
    countries = spark.createDataFrame([("PE", "PER")], "iso2 string, iso3 string")
    rows = feeds.hazard_alerts(_payloads(spark, _HAZARDS), _now(), sources.two_letter_codes(countries))
    return rows.select("external_id", "title", "category", "magnitude", "lat", "lon", "country_code", F.unix_seconds("occurred_at").alias("at_s"))


_ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><title>Third &lt;b&gt;news&lt;/b&gt;</title><id>id3</id><link rel="self" href="https://f.example/self"/><link rel="alternate" href="https://f.example/3"/><updated>2025-01-02T00:00:00Z</updated><summary>S</summary><category term="fire"/></entry></feed>"""
_RDF = """<rdf:RDF xmlns:rdf="http://rdf.example" xmlns:dc="http://dc.example" xmlns:georss="http://g.example"><channel><title>C</title></channel><item><title>Fourth</title><link>https://f.example/4</link><dc:date>2025-01-03T12:00:00+01:00</dc:date><georss:point>10.5 20.5</georss:point></item></rdf:RDF>"""


@query(_values("external_id, title, body, url, lat, place_hint, at_s", ("id3", "Third news", "S", "https://f.example/3", None, "fire", 1735776000), ("https://f.example/4", "Fourth", None, "https://f.example/4", 10.5, None, 1735902000)))
def feed_atom_rdf(spark, d):
    """Atom and RDF items as drafts."""
    rows = feeds.feed_drafts(feeds.feed_items(_payloads(spark, _ATOM, _RDF)), "rss.test")
    return rows.select("external_id", "title", "body", "url", "lat", "place_hint", F.unix_seconds("occurred_at").alias("at_s"))


@query(f"WITH {_O} SELECT CASE WHEN trim(title) = '' OR title IS NULL THEN 'no title' WHEN occurred_at IS NULL THEN 'no time' WHEN url IS NOT NULL AND NOT regexp_matches(trim(url), '^https?://[^\\s/?#]+') THEN 'bad url' WHEN tone IS NOT NULL AND (isnan(tone) OR tone NOT BETWEEN -1 AND 1) THEN 'tone out of range' WHEN report_count < 0 THEN 'negative count' WHEN lat IS NOT NULL AND lon IS NOT NULL AND (isnan(lat) OR isnan(lon) OR lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180) THEN 'place out of range' ELSE 'good' END AS reason, count(*) AS n FROM o GROUP BY 1")
def feed_draft_checks(spark, d):
    """Outcome of the draft check on every observation."""
    o = _observations(spark, d, "source_id", "external_id", "title", "occurred_at", "url", "tone", "report_count", "lat", "lon")
    good, bad = feeds.check_drafts(o.withColumn("actors", F.lit(None).cast("array<string>")))
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT source_id, external_id, min(ingested_at) AS seen FROM observations GROUP BY 1, 2) SELECT source_id, count(*) AS n, max(epoch_us(seen)) AS last_us FROM t GROUP BY 1")
def feed_first_copies(spark, d):
    """Drafts of two fetches merged: the first copy of each."""
    rows = feeds.first_copies(load(spark, d, "observations").select("source_id", "external_id", "ingested_at"), "ingested_at")
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ingested_at")).alias("last_us"))


@query(_values("source_id, available, reason", *[(s, s not in feeds.NEEDS, f"needs {', '.join(feeds.NEEDS[s])}" if s in feeds.NEEDS else None) for s in [*feeds.PARSERS, *sources.FEEDS]]).replace("True", "true").replace("False", "false"))
def feed_registry(spark, d):
    """All sources, and why one can't run without its variables."""
    able, reasons = sources.registry().available({})
    rows = [(s, s in able, reasons.get(s)) for s in sources.registry().ids()]
    return spark.createDataFrame(rows, "source_id string, available boolean, reason string")
