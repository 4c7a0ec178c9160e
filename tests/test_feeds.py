import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.sources import feeds

def now():
    return F.lit("2025-01-10 00:00:00").cast("timestamp")


def payload(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "payload string")


def one(df):
    (row,) = df.collect()
    return row.asDict()


def export_row(**kw):
    f = [""] * 61
    for name, v in {"id": "1", "day": "20250101", "root": "14", "mentions": "5", "sources": "3", "tone": "-25", "goldstein": "-6.5", "geo_type": "4", "place": "Rome, Italy", "fips": "IT", "lat": "41.9", "lon": "12.5", "added": "20250102030405", "url": "https://a.example/1", "actor1": "PROTESTERS", "actor2": "POLICE FORCE", **kw}.items():
        f[feeds.EXPORT_FIELDS[name]] = v
    return "\t".join(f)


def test_event_export(spark):
    lines = [export_row(), export_row(id="2", mentions="1"), export_row(id="3", lat="", lon=""), "too\tshort", export_row(id="4", actor2="", root="99", geo_type="9", place="", tone="x", goldstein="")]
    out = {r["external_id"]: r for r in feeds.event_export(spark.createDataFrame([(x,) for x in lines], "value string"), now()).collect()}
    assert sorted(out) == ["1", "4"]
    a = out["1"]
    assert (a["title"], a["category"], a["tone"], a["magnitude"], a["report_count"], a["geo_precision"], a["occurred_at"]) == ("Protesters — Protest — Police Force in Rome, Italy", "civil_unrest", -0.25, -6.5, 3, "city", datetime(2025, 1, 2, 3, 4, 5))
    assert (out["4"]["title"], out["4"]["category"], out["4"]["tone"], out["4"]["geo_precision"]) == ("Protesters: Reported activity", "other", None, "unknown")
    assert json.loads(a["raw"])["actionGeo"]["fipsCountryCode"] == "IT"


def test_manifest(spark):
    text = "1 a http://x/20250101000000.mentions.CSV.zip\n2 b http://x/20250101001500.export.CSV.zip\n3 c http://x/20250101003000.export.CSV.zip"
    assert one(feeds.newest_export(payload(spark, text))) == {"url": "http://x/20250101001500.export.CSV.zip", "cursor": "20250101001500"}
    assert feeds.newest_export(payload(spark, "nothing here")).count() == 0


def test_earthquakes(spark):
    f = lambda i, c, m: {"id": i, "geometry": c and {"coordinates": c}, "properties": {"mag": m, "place": "5 km N of X", "time": 1700000000000, "url": "https://q.example/1"}}
    out = feeds.earthquakes(payload(spark, {"features": [f("a", [12.5, 41.9, 10.0], 5.25), f("b", None, 1.0), f("c", [181.0, 10.0], None)]}), now()).orderBy("external_id").collect()
    assert [r["external_id"] for r in out] == ["a", "c"] and out[0]["lat"] == 41.9 and out[0]["title"].startswith("Magnitude 5.") and out[1]["lon"] == -179.0 and out[1]["title"] == "Earthquake reported near 5 km N of X"
    assert feeds.earthquakes(payload(spark, "not json"), now()).count() == 0


def test_natural_events(spark):
    e = {"id": "E1", "title": "Fire", "categories": [{"id": 8, "title": "Wildfires"}], "geometries": [{"date": "2025-01-01T00:00:00Z", "type": "Point", "coordinates": [1.0, 2.0]}, {"date": "2025-01-03T00:00:00Z", "type": "Polygon", "coordinates": [[[5.0, 6.0], [7.0, 8.0]]]}]}
    r = one(feeds.natural_events(payload(spark, {"events": [e, {"id": "E2", "title": "No place", "geometries": []}]}), now()))
    assert (r["external_id"], r["lat"], r["lon"], r["category"]) == ("E1:2025-01-03T00:00:00.000Z", 6.0, 5.0, "wildfire")


def test_weather_alerts(spark):
    ring = [[179.0, 10.0], [-179.0, 10.0], [-179.0, 12.0], [179.0, 12.0]]
    a = {"id": "https://w.example/1", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"event": "Red Flag Warning", "severity": "Extreme", "headline": "Hot", "sent": "2025-01-02T00:00:00Z", "effective": "2025-01-01T00:00:00Z", "onset": "2025-01-05T00:00:00Z"}}
    r = one(feeds.weather_alerts(payload(spark, {"features": [a, {"id": "x", "geometry": None, "properties": {"event": "Flood"}}]}), now()))
    assert r["category"] == "wildfire" and r["magnitude"] == 4 and r["occurred_at"] == datetime(2025, 1, 1) and abs(abs(r["lon"]) - 180) < 1e-6


def test_situation_reports(spark):
    item = {"id": "7", "fields": {"title": "Cholera <b>update</b>", "date": {"original": None, "created": "2025-01-02T00:00:00+00:00"}, "country": [{"name": "Chad", "iso3": "TCD"}], "source": [{"name": "World Health", "shortname": "WHO"}, {"name": "Unicef"}]}}
    out = feeds.situation_reports(payload(spark, {"data": [item, {"id": "8", "fields": {"title": "Undated"}}, {"id": "9", "fields": {"title": "War news", "date": {"changed": "2025-01-02"}}}]})).orderBy("external_id").collect()
    assert [(r["external_id"], r["category"], r["report_count"]) for r in out] == [("7", "health", 2), ("9", "armed_conflict", 1)] and out[0]["title"] == "Cholera update" and out[0]["place_hint"] == "Chad" and out[0]["actors"] == ["WHO", "Unicef"]


def test_space_weather(spark):
    p = lambda m: {"product_id": "K05A", "issue_datetime": "2025-01-02 03:04:05.000", "message": m}
    out = feeds.space_weather(payload(spark, [p("Code\r\nSerial Number: 12\r\nALERT: Geomagnetic K-index of 6\r\nmore"), p("CANCEL WARNING: none"), p("WATCH: G3 storm")])).orderBy("title").collect()
    assert [(r["title"], r["magnitude"], r["external_id"].split(":")[-1]) for r in out] == [("ALERT: Geomagnetic K-index of 6", 2.0, "12"), ("WATCH: G3 storm", 3.0, "none")]


def test_sanctions_page(spark):
    html = '<a href="/recent-actions/20250102">Two <i>names</i></a> <a href="/recent-actions/20250102">again</a> <a href="/other/20250103">no</a> <a class="x" href=\'/recent-actions/20250230\'>bad day</a>'
    r = one(feeds.sanctions_updates(payload(spark, html)))
    assert (r["external_id"], r["title"], r["occurred_at"]) == ("/recent-actions/20250102", "OFAC: Two names", datetime(2025, 1, 2, 12))


def test_fires(spark):
    rows = [("10.1", "20.1", "40", "2025-01-01", "930", "n"), ("10.2", "20.2", "20", "2025-01-01", "1000", "high"), ("10.1", "20.1", "999", "2025-01-01", "1000", "low"), ("50", "50", "49", "2025-01-01", "1000", "h"), ("50", "50", "-1", "2025-01-01", "1000", "h")]
    csv = spark.createDataFrame(rows, "latitude string, longitude string, frp string, acq_date string, acq_time string, confidence string")
    r = one(feeds.fires(csv))
    assert (r["external_id"], r["magnitude"], r["occurred_at"]) == ("40:80:2025-01-01", 60.0, datetime(2025, 1, 1, 10)) and abs(r["lat"] - (10.1 * 40 + 10.2 * 20) / 60) < 1e-9


RSS = """<rss xmlns:georss="http://g" xmlns:geo="http://w" xmlns:dc="http://d"><channel><title>F</title>
<item><title>First &amp; best</title><description><![CDATA[<p>Body</p>]]></description><link>https://f.example/1</link><guid>g1</guid><pubDate>Wed, 01 Jan 2025 10:00:00 +0100</pubDate><category>war</category><category>peace</category><georss:point>10.5 20.5</georss:point></item>
<item><description>no title</description></item>
<item><title>Second</title><geo:Point><geo:lat>1.5</geo:lat><geo:long>2.5</geo:long></geo:Point><link>https://f.example/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><title>Third</title><id>id3</id><link rel="self" href="https://f.example/self"/><link rel="alternate" href="https://f.example/3"/><updated>2025-01-02T00:00:00Z</updated><summary>S</summary><category term="fire"/></entry></feed>"""


def test_feed_items(spark):
    items = feeds.feed_items(payload(spark, RSS, ATOM))
    out = {r["title"]: r for r in items.collect()}
    assert sorted(out) == ["First & best", "Second", "Third"]
    a, b, c = out["First & best"], out["Second"], out["Third"]
    assert (a["description"], a["link"], a["guid"], a["categories"], a["lat"]) == ("Body", "https://f.example/1", "g1", ["war", "peace"], 10.5)
    assert (b["lat"], b["lon"], b["guid"]) == (1.5, 2.5, "https://f.example/2") and (c["link"], c["guid"], c["categories"], c["description"]) == ("https://f.example/3", "id3", ["fire"], "S")
    drafts = {r["title"]: r for r in feeds.feed_drafts(items, "rss.test").collect()}
    assert drafts["First & best"]["occurred_at"] == datetime(2025, 1, 1, 9) and drafts["Third"]["occurred_at"] == datetime(2025, 1, 2) and drafts["Second"]["occurred_at"] is None
    good, bad = feeds.check_drafts(feeds.feed_drafts(items, "rss.test"))
    assert good.count() == 2 and [r["reason"] for r in bad.collect()] == ["no time"]


def test_hazard_alerts(spark):
    xml = """<rss xmlns:gdacs="http://g" xmlns:georss="http://r"><channel><item><title>Flood in Peru</title><gdacs:eventid>12</gdacs:eventid><gdacs:episodeid>3</gdacs:episodeid><gdacs:eventtype>fl</gdacs:eventtype><gdacs:alertlevel>Orange</gdacs:alertlevel>
<gdacs:country>Peru</gdacs:country><gdacs:iso3>PER</gdacs:iso3><gdacs:fromdate>Wed, 01 Jan 2025 00:00:00 GMT</gdacs:fromdate><georss:point>-12 -77</georss:point></item><item><title>no id</title></item></channel></rss>"""
    r = one(feeds.hazard_alerts(payload(spark, xml), now(), {"PER": "PE"}))
    assert (r["external_id"], r["category"], r["magnitude"], r["lat"], r["country_code"], r["occurred_at"]) == ("FL12.3", "severe_weather", 2.0, -12.0, "PE", datetime(2025, 1, 1))


def test_registry_and_transport_helpers():
    ok, reasons = feeds.available({"RELIEFWEB_APPNAME": "x"})
    assert "usgs.quakes" in ok and "firms.fires" in reasons and "ocha.reliefweb" in ok
    assert [feeds.backoff_seconds(n) for n in (0, 1, 2, 20)] == [0, 60, 120, 7200]
    assert feeds.retry_after_seconds("300", 0) == 120 and feeds.retry_after_seconds("Thu, 01 Jan 1970 00:01:00 GMT", 0) == 60 and feeds.retry_after_seconds("soon", 0) is None


def test_first_copies(spark):
    df = spark.createDataFrame([("s", "1", 2, "late"), ("s", "1", 1, "early"), ("s", "2", 1, "x")], "source_id string, external_id string, feed int, title string")
    assert sorted(r["title"] for r in feeds.first_copies(df, "feed").collect()) == ["early", "x"]
