import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, score, text, time, vector
from tidewatch.model import CATEGORIES, CATEGORY_WEIGHT, GROUPS, group_of, half_life_h

def now():
    return F.lit("2025-01-10 00:00:00").cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ts(s):
    return F.lit(s).cast("timestamp")


def test_vocabularies():
    assert len(CATEGORIES) == 18 and sorted(CATEGORIES) == sorted(CATEGORY_WEIGHT) == sorted(c for g in GROUPS.values() for c in g)


def test_groups_and_half_lives(spark):
    assert [value(spark, group_of(F.lit(c))) for c in ("cyber", "health", "nonsense")] == ["security", "human", "domain"]
    assert [value(spark, half_life_h(F.lit("terrorism"), m)) for m in ("full", "stored")] == [96.0, 36.0]


@pytest.mark.parametrize(
    "raw,clean",
    [
        (None, ""), ("<p>Hello <b>world</b></p>", "Hello world"), ("<![CDATA[Fire & smoke]]>", "Fire & smoke"), ("A &amp; B &#8217; &#x41;", "A & B ’ A"), ("bad &#xFFFFFFFF; end", "bad � end"), ("  a \n\t b ", "a b"), ("x < y and y > z", "x < y and y > z"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert value(spark, text.clean_text(F.lit(raw).cast("string"))) == clean


def test_keys_and_hashes(spark):
    key = lambda s: value(spark, text.normalize_key(F.lit(s)))
    assert key("  São-Paulo, ÉTÉ! ") == "sao paulo ete" and key(key("Zürich's")) == key("Zürich's")
    h = lambda *p: value(spark, text.content_hash(*[F.lit(x).cast("string") for x in p]))
    assert h("A", None) == h("<b>a</b>", "") != h("", "a") and h("ab", "c") != h("a", "bc")


def test_text_helpers(spark):
    assert value(spark, text.truncate(F.lit("one two three"), 9)) == "one two…" and value(spark, text.truncate(F.lit("short"), 9)) == "short"
    assert value(spark, text.sentences(F.lit("It fell. Then it rose! was it? Yes."))) == ["It fell.", "Then it rose! was it?", "Yes."] and value(spark, text.sentences(F.lit(""))) == []
    assert value(spark, text.tokens(F.lit("The flood of the old River is up"))) == ["flood", "old", "river"]
    assert value(spark, text.embedding_text(F.lit("T"), F.lit(None).cast("string"), F.lit("P"))) == "T. P" and len(value(spark, text.embedding_text(F.lit("x" * 3000), F.lit("b")))) == 2000
    assert [value(spark, text.short_count(F.lit(n))) for n in (999, 1_234, 12_345, 1_234_567)] == ["999", "1.2k", "12k", "1.2M"]
    assert value(spark, text.coordinates(F.lit(-12.3456), F.lit(7.0))) == "12.346°S 7.000°E"
    assert [value(spark, text.root_category(F.lit(c))) for c in ("14", "7", "062", None)] == ["civil_unrest", "humanitarian", "other", "other"]
    assert [value(spark, text.safe_url(F.lit(u))) for u in ("https://a.example/x", "javascript:1", "nope")] == ["https://a.example/x", None, None]


def test_time(spark):
    assert value(spark, time.parse_date(F.lit("1700000000"))) == value(spark, time.parse_date(F.lit("1700000000000"))) == datetime(2023, 11, 14, 22, 13, 20)
    assert value(spark, time.parse_date(F.lit("20240229123000"))) == datetime(2024, 2, 29, 12, 30) and value(spark, time.parse_date(F.lit("20240230"))) is None and value(spark, time.parse_date(F.lit("junk"))) is None
    assert value(spark, time.floor_to(ts("2025-01-01 10:44:59"), 15)) == datetime(2025, 1, 1, 10, 30) and value(spark, time.floor_to(ts("1969-12-31 23:59:00"), 60)) == datetime(1969, 12, 31, 23)
    ago = lambda t: value(spark, time.relative(ts(t), now()))
    assert [ago("2025-01-09 23:59:40"), ago("2025-01-09 23:15:00"), ago("2025-01-09 20:00:00"), ago("2025-01-07 00:00:00"), ago("2024-10-01 00:00:00")] == ["now", "45m ago", "4h ago", "3d ago", "3mo ago"]


def test_geo(spark):
    km = value(spark, geo.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522)))
    assert abs(km - 343.5565) < 1e-3
    assert [value(spark, geo.grid_cell(F.lit(a), F.lit(o))) for a, o in ((0.0, 0.0), (90.0, 180.0), (-90.0, -180.0))] == ["5:18:36", "5:36:72", "5:0:0"]
    assert tuple(value(spark, geo.cell_centre(F.lit("5:18:36")))) == (2.5, 2.5) and value(spark, geo.cell_centre(F.lit("x"))) is None
    assert [value(spark, geo.leading_number(F.lit(s))) for s in ("12abc", "-1.5e2x", "abc")] == [12.0, -150.0, None]
    df = spark.createDataFrame([(10.0, 179.0, 1.0), (10.0, -179.0, 1.0)], "lat double, lon double, w double")
    s = df.agg(*[v.alias(k) for k, v in geo.unit_sums(F.col("lat"), F.col("lon"), F.col("w")).items()])
    c = s.select(geo.direction(F.col("x"), F.col("y"), F.col("z"), F.col("w")).alias("c")).first()["c"]
    assert abs(abs(c["lon"]) - 180) < 1e-9
    opposite = spark.createDataFrame([(0.0, 0.0), (0.0, 180.0)], "lat double, lon double")
    s = opposite.agg(*[v.alias(k) for k, v in geo.unit_sums(F.col("lat"), F.col("lon"), F.lit(1.0)).items()])
    assert s.select(geo.direction(F.col("x"), F.col("y"), F.col("z"), F.col("w")).alias("c")).first()["c"] is None


def test_vectors(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ([3, 4], [4, 3], [0, 0]))
    assert value(spark, vector.dot(a, b)) == 24 and value(spark, vector.magnitude(a)) == 5 and abs(value(spark, vector.cosine(a, b)) - 0.96) < 1e-12 and value(spark, vector.cosine(a, z)) == 0
    assert value(spark, vector.normalise(a)) == [0.6, 0.8] and value(spark, vector.normalise(z)) == [0, 0] and value(spark, vector.add_to_mean(a, F.lit(1), b)) == [3.5, 3.5]
    with pytest.raises(Exception, match="differ in width"):
        value(spark, vector.dot(a, F.array(F.lit(1.0))))
    assert value(spark, vector.from_text(F.lit("[1,2.5]"))) == [1.0, 2.5] and value(spark, vector.from_text(F.lit("oops"))) is None


def test_scores(spark):
    f = lambda feed, m: value(spark, score.intensity(F.lit(feed), F.lit(m).cast("double")))
    assert f("usgs.quakes", 9.0) == 1 and f("usgs.quakes", 2.0) == 0 and f("usgs.quakes", None) == 0.4 and f("unknown", 3.0) == 0.4 and f("usgs.quakes", float("nan")) == 0.4
    assert abs(f("gdelt.events", -10.0) - 1.0) < 1e-9 and abs(f("gdacs.alerts", 3.0) - 1.0) < 1e-9
    corr = lambda n: value(spark, score.corroboration(F.lit(n)))
    assert corr(1) == 0 and corr(100) == 1 and corr(0) == 0 and 0 < corr(10) < 1
    sev = lambda *a: value(spark, score.severity(*[F.lit(x) for x in a]))
    assert sev("terrorism", 1.0, -1.0, 100, 1) == 100 and sev("other", 0.0, 1.0, 1, 1) == 0 and value(spark, score.severity(F.lit("space"), F.lit(0.4), F.lit(None).cast("double"), F.lit(1), F.lit(1))) == 11
    conf = lambda p, c, n: value(spark, score.confidence(F.lit(p), F.lit(c), F.lit(n)))
    assert conf("exact", 1.0, 100) == 100 and conf("unknown", 0.0, 1) == 9
    assert value(spark, score.recency(F.lit("seismic"), ts("2025-01-08 00:00:00"), now())) == 0.5 and value(spark, score.recency(F.lit("seismic"), ts("2025-02-08 00:00:00"), now())) == 1
    assert [value(spark, score.band(F.lit(s))) for s in (70, 69, 49, 29)] == ["critical", "serious", "elevated", "routine"]
    status = lambda t, v: value(spark, score.status(ts(t), F.lit(v), now()))
    assert [status("2025-01-01 00:00:00", 9.0), status("2025-01-08 00:00:00", 9.0), status("2025-01-09 23:00:00", 2.0), status("2025-01-09 23:00:00", 1.0), status("2025-02-09 00:00:00", 0.0)] == ["closed", "dormant", "developing", "active", "closed"]
    assert value(spark, score.velocity(F.lit(3), F.lit(3), ts("2025-01-09 23:50:00"), ts("2025-01-09 23:55:00"))) == pytest.approx(0.25 / 3)
    npmi = lambda *a: value(spark, score.npmi(*[F.lit(float(x)) for x in a]))
    assert npmi(5, 5, 5, 5) == 1 and npmi(0, 5, 5, 10) == 0 and npmi(5, 5, 5, 10) == pytest.approx(1) and npmi(1, 5, 5, 25) == pytest.approx(0)
    assert value(spark, score.clamp01(F.lit(float("inf")))) == 0 and value(spark, score.round_half_up(F.lit(2.5))) == 3 and math.isclose(value(spark, score.hotness(F.lit(80), F.lit("wildfire"), ts("2025-01-07 00:00:00"), now())), 40)
