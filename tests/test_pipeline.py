import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import catalogue, catalogue_pipeline
from tidewatch.operators import anomaly, classify, entities, events, gazetteer, rules, stages
from tidewatch.operators.skew import join_hot_cold
from tidewatch.plans import reads

T0 = datetime(2025, 3, 1)


def place_line(i, name, alts, lat, lon, country, population):
    f = [str(i), name, name, alts, str(lat), str(lon), "P", "PPL", country, "", "01", "", "", "", str(population), "", "", "", "2020-01-01"]
    return "\t".join(f)


@pytest.fixture(scope="module")
def gaz(spark):
    lines = [
        "# comment", place_line(1, "Springfield", "", 39.8, -89.6, "US", 115_000), place_line(2, "Springfield", "", -38.0, 145.0, "AU", 300_000), place_line(3, "Nueva York", "New York,From", 40.7, -74.0, "US", 8_000_000),
        place_line(4, "Suva", "", -18.14, 178.44, "FJ", 77_000), place_line(5, "Taveuni", "", -16.9, -179.9, "FJ", 9_000), place_line(6, "Geneva", "Genf", 46.2, 6.15, "CH", 250_000), "short\tline",
    ]
    lands = ["#c", "US\tUSA\t840\tUS\tUnited States", "CH\tCHE\t756\tSZ\tSwitzerland", "FJ\tFJI\t242\tFJ\tFiji", "SN\tSEN\t686\tSG\tSenegal"]
    read = lambda rows: spark.createDataFrame([(r,) for r in rows], "value string")
    return gazetteer.read_places(read(lines)).cache(), gazetteer.read_countries(read(lands)).cache()


def test_gazetteer_lookup(spark, gaz):
    places, lands = gaz
    assert places.count() == 6 and {r["fips"]: r["iso2"] for r in lands.collect()}["SG"] == "SN"
    names = gazetteer.place_names(places)
    assert names.where("norm = 'from'").count() == 0
    asked = spark.createDataFrame([("a", "springfield", None), ("b", "Springfield!", "US"), ("c", "NEW YORK", None), ("d", "nowhere", None), ("e", "", None), ("f", None, None)], "k string, n string, c string")
    got = {r["k"]: r["place"]["geoname_id"] for r in gazetteer.find_places(asked, "k", "n", "c", names).collect()}
    assert got == {"a": 2, "b": 1, "c": 3}


def test_nearest_across_the_antimeridian(spark, gaz):
    points = spark.createDataFrame([("x", -16.8, 179.95), ("far", 0.0, 100.0)], "k string, lat double, lon double")
    (r,) = gazetteer.nearest_place(points, "k", gaz[0], 100.0).collect()
    assert (r["k"], r["geoname_id"]) == ("x", 5)


def test_places_in_text(spark, gaz):
    texts = [("a", "Talks in Geneva about New York"), ("b", "floods from the hills"), ("c", "Unrest in Fiji and Geneva"), ("d", "Storm nears Springfield"), ("e", "geneva in lower case"), ("f", ""), ("g", None), ("h", "Leaders leave Nueva York today")]
    got = {r["k"]: (r["kind"], r["country_code"]) for r in gazetteer.scan_text(spark.createDataFrame(texts, "k string, t string"), "k", "t", gazetteer.place_names(gaz[0]), gaz[1]).collect()}
    assert got == {"a": ("place", "CH"), "c": ("country", "FJ"), "d": ("place", "AU"), "h": ("place", "US")}


def test_resolution_ladder(spark, gaz):
    schema = "id string, title string, body string, place_hint string, lat double, lon double, geo_precision string, country_code string, fips string"
    rows = [
        ("own", "T", None, "Geneva", 1.0, 2.0, "exact", None, None), ("hint", "T", None, "Nueva York, Geneva", None, None, None, None, None), ("part", "T", None, "Nope; Geneva", 0.0, 0.0, None, None, None),
        ("title", "Blast in Geneva", None, None, None, None, None, None, None), ("body", "Blast", "It was in Geneva.", None, None, None, None, None, None), ("held", "News from Fiji", "It was in Geneva.", None, None, None, None, None, None),
        ("code", "T", None, None, None, None, None, None, "SZ"), ("none", "T", None, None, None, None, None, None, None),
    ]
    out = {r["id"]: r for r in gazetteer.resolve_locations(spark.createDataFrame(rows, schema), *gaz).collect()}
    assert {k: (r["step"], r["precision"], r["country_code"]) for k, r in out.items()} == {
        "own": ("source", "exact", None), "hint": ("hint", "city", "US"), "part": ("hint", "city", "CH"), "title": ("title", "city", "CH"), "body": ("body", "city", "CH"), "held": ("country", "country", "FJ"), "code": ("code", "country", "CH"), "none": (None, None, None),
    }
    named = gazetteer.name_precise(spark.createDataFrame([("p", 46.3, 6.2, "exact", None, None), ("q", 0.0, 50.0, "city", None, None)], "id string, lat double, lon double, precision string, place_name string, country_code string"), gaz[0])
    assert {r["id"]: r["place_name"] for r in named.collect()} == {"p": "Geneva", "q": None}


def test_classifier(spark):
    df = spark.createDataFrame([("a", "Airstrike and shelling near the front", [1.0, 0.0]), ("b", "volcanic ash", [0.0, 1.0]), ("c", "nothing", None), ("d", None, [0.0, 0.0])], "k string, t string, v array<float>")
    lex = {(r["k"], r["category"]): r["score"] for r in classify.lexical_scores(df, "k", "t").collect()}
    assert lex["a", "armed_conflict"] == pytest.approx(min(1, 1.6 * math.sqrt(6 / 30.5))) and ("b", "seismic") not in lex
    got = {r["k"]: r for r in classify.classify(df, "k", "t", "v", {"armed_conflict": [[1.0, 0.1]], "health": [[0.1, 1.0]]}).collect()}
    assert got["a"]["category"] == "armed_conflict" and got["a"]["category_confidence"] > 0.5 and got["b"]["category"] == "health" and got["c"]["category"] == got["d"]["category"] == "other" and len(got["a"]["alternatives"]) == 3
    blend = lambda p, s, i, c: tuple(spark.range(1).select(classify.blend_prior(F.lit(p).cast("string"), F.lit(s), F.lit(i), F.lit(c)).alias("b")).first()["b"])
    assert [blend("cyber", "authoritative", "health", 0.5), blend("cyber", "weak", "cyber", 0.5), blend("cyber", "weak", "health", 0.2), blend("cyber", "weak", "health", 0.5), blend(None, "weak", "health", 0.5)] == [
        ("cyber", 0.9), ("cyber", 0.65), ("cyber", 0.4), ("health", 0.5), ("health", 0.5),
    ]


def test_anomalies_equal_the_running_fold(spark):
    counts = [3, 4, 3, 5, 4, 3, 4, 5, 3, 4, 4, 3, 4, 30, 4]
    volume = spark.createDataFrame([("c", "g", T0 + timedelta(hours=2 * i), n, 50) for i, n in enumerate(counts)], "category string, grid_cell string, bucket timestamp, observed bigint, max_severity int")
    scored = {r["bucket"]: r for r in anomaly.z_scores(volume).collect()}
    n = mean = m2 = 0
    for i, x in enumerate(counts):
        sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0
        r = scored[T0 + timedelta(hours=2 * i)]
        assert r["z"] == pytest.approx((x - mean) / sd if sd else 0) and r["prior_n"] == n
        n, d = n + 1, x - mean
        mean += d / n
        m2 += d * (x - mean)
        assert r["expected"] == pytest.approx(mean)
    (hit,) = anomaly.signals(anomaly.z_scores(volume)).collect()
    assert hit["observed"] == 30 and hit["dedup_key"] == "volume_spike:c:g:2025-03-02T02:00:00.000Z" and hit["severity"] == 100
    halves = [anomaly.baselines_after(volume.where(f"bucket {op} timestamp '2025-03-01 12:00:00'")) for op in ("<", ">=")]
    merged, whole = anomaly.merge_baselines(*halves).first(), anomaly.baselines_after(volume).first()
    assert merged["m2"] == pytest.approx(whole["m2"]) and merged["mean"] == pytest.approx(whole["mean"]) and merged["sample_count"] == 15
    assert anomaly.fill_gaps(volume).count() == 29
    assert anomaly.new_alerts(anomaly.signals(anomaly.z_scores(volume)), spark.createDataFrame([(hit["dedup_key"],)], "dedup_key string")).count() == 0


def observation(i, hours, vector, lat=10.0, lon=10.0, precision="city", country="AA", category="seismic", **kw):
    return {"id": f"o{i}", "occurred_at": T0 + timedelta(hours=hours), "embedding": vector, "lat": lat, "lon": lon, "geo_precision": precision, "country_code": country, "category": category, "source_id": "s", "title": f"Title {i}", "body": None, "severity": 10 + i, "category_confidence": 0.5, "magnitude": None, "tone": None, "report_count": 1, "place_name": f"P{i}", **kw}


OBS = "id string, occurred_at timestamp, embedding array<double>, lat double, lon double, geo_precision string, country_code string, category string, source_id string, title string, body string, severity int, category_confidence double, magnitude double, tone double, report_count int, place_name string"


def test_matching_and_online_clusters_agree(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    obs = [observation(0, 0, a), observation(1, 1, a, 10.1, 10.1), observation(2, 2, b), observation(3, 3, a, -60.0, 100.0, country="BB"), observation(4, 4, a, None, None, "country", "AA"), observation(5, 200, a), observation(6, 5, None), observation(7, 6, a, category="health")]
    df = spark.createDataFrame(obs, OBS)
    got = {r["observation_id"]: r["event_id"] for r in events.cluster_online(df).collect()}
    assert got == {"o0": "o0", "o1": "o0", "o2": "o2", "o3": "o3", "o4": "o0", "o5": "o5", "o6": "o6", "o7": "o0"}
    store = spark.createDataFrame([("e", a, "seismic", 10.0, 10.0, "city", "AA", T0)], "id string, centroid array<double>, category string, lat double, lon double, geo_precision string, country_code string, last_seen_at timestamp")
    subjects = df.where("embedding is not null").select("id", "embedding", "category", "lat", "lon", "geo_precision", "country_code", "occurred_at")
    match = {r["subject_id"]: r["adjusted"] for r in events.match_candidates(subjects, store).collect()}
    assert sorted(match) == ["o0", "o1", "o4", "o7"] and match["o4"] == pytest.approx(0.95) and match["o7"] == pytest.approx(0.8)


OBSERVATIONS = "id string, source_id string, external_id string, title string, body string, occurred_at timestamp, ingested_at timestamp, lat double, lon double, geo_precision string, place_name string, country_code string, grid_cell string, category string, category_confidence double, severity smallint, confidence smallint, magnitude double, tone double, report_count int"


def test_online_query_weighs_events_of_other_countries(spark, tmp_path):
    obs = [observation(i, i, None, country=c, lat=lat) for i, (c, lat) in enumerate([("AA", 10.0), ("BB", 10.0), (None, None), ("AA", 10.0)])] + [observation(4, 500, None)]
    names = [p.split(" ")[0] for p in OBSERVATIONS.split(", ")]
    spark.createDataFrame([tuple({**o, "ingested_at": T0}.get(n) for n in names) for o in obs], OBSERVATIONS).write.parquet(f"{tmp_path}/observations.parquet")
    vectors = [[1.0, 0.0], [1.0, 0.1], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    spark.createDataFrame([(f"o{i}", v) for i, v in enumerate(vectors)], "observation_id string, embedding array<float>").write.parquet(f"{tmp_path}/enrichments.parquet")
    assert {r["event_id"]: r["members"] for r in catalogue.online_clusters(spark, str(tmp_path)).collect()} == {"o0": 3, "o3": 1, "o4": 1}


def test_match_query_has_the_default_threshold_and_factors(spark, tmp_path):
    at = lambda angle: [math.cos(angle), math.sin(angle)]
    cases = [("a", at(0), 10.0, "AA", 0), ("b", at(0.9), 10.0, "AA", 1), ("c", at(-0.9), 10.0, "BB", 1), ("d", at(0), 10.0, "AA", 100), ("e", [math.nan, 1.0], 10.0, "AA", 1), ("f", [0.0, 0.0], 10.0, "AA", 1), ("g", at(2.5), 95.0, "AA", 2), ("h", at(2.6), -10.0, "AA", 2)]
    rows = [(i, v, "seismic", lat, 10.0, "city", c, T0 + timedelta(hours=h), T0 + timedelta(hours=h)) for i, v, lat, c, h in cases]
    schema = "id string, centroid array<float>, category string, lat double, lon double, geo_precision string, country_code string, first_seen_at timestamp, last_seen_at timestamp"
    spark.createDataFrame(rows + rows[:1], schema).write.parquet(f"{tmp_path}/event_clusters.parquet")
    got = {r["subject_id"]: (r["event_id"], r["adjusted"]) for r in catalogue_pipeline.best_event_match(spark, str(tmp_path)).collect()}
    cos = math.cos(0.9)
    assert {k: v[0] for k, v in got.items()} == {"a": "b", "b": "a", "g": "h", "h": "g"} and got["a"][1] == pytest.approx(cos, abs=1e-5) and got["g"][1] == pytest.approx(0.85 * math.cos(0.1), abs=1e-5)


def test_recompute_and_titles(spark):
    obs = [observation(0, 0, None, body=" ", severity=90, title="x" * 10), observation(1, 1, None, body="A long report.", country="BB", title="A title that is certainly long enough for everyone"), observation(2, 2, None, country="BB", source_id="t", category="health", category_confidence=2.0)]
    df = spark.createDataFrame(obs, OBS)
    links = spark.createDataFrame([("e", f"o{i}") for i in range(3)], "event_id string, observation_id string")
    r = events.recompute(links, df, F.lit("2025-03-01 04:00:00").cast("timestamp")).first()
    assert (r["observation_count"], r["source_count"], r["category"], r["country_code"], r["severity"], r["summary"], r["status"], r["place_name"]) == (3, 2, "health", "BB", 24, "A long report.", "active", "P0")
    # The peak is scored again: 0.75 * (0.6 * 0.4 + 0.25 * log10(2) / 2 + 0.15 * 0.3); a curve of its own source counts.
    strong = events.recompute(links, df.withColumn("magnitude", F.lit(1.0)), F.lit("2025-03-01 04:00:00").cast("timestamp"), curves={"s": lambda m: m}).first()
    assert strong["severity"] == 51 and strong["title"] and strong["grid_cell"] == "5:20:38"
    members = links.join(df.withColumnRenamed("id", "observation_id"), "observation_id")
    assert events.pick_titles(members, [], []).first()["title"] == "x" * 10
    assert events.pick_titles(members.withColumn("title", F.lit(" ")), [], []).first()["title"] == "Unnamed event"


def test_summaries(spark):
    rows = [("e", s, v, [1.0, 0.2], 0) for s, v in (("First sentence.", [1.0, 0.0]), ("Nearly the first.", [1.0, 0.01]), ("Another thing.", [0.3, 1.0]))]
    out = events.mmr_sentences(spark.createDataFrame(rows, "event_id string, sentence string, embedding array<double>, centroid array<double>, severity int")).first()
    assert out["summary"] in ("First sentence. Another thing.", "Nearly the first. Another thing.")
    v = spark.createDataFrame([("alpha beta gamma",), ("",), (None,)], "t string").select(events.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert math.isclose(sum(x * x for x in v[0]["v"]), 1, rel_tol=1e-5) and not any(v[1]["v"]) and not any(v[2]["v"])


def test_entities(spark, gaz):
    df = spark.createDataFrame([("d", "Yesterday Ana Silva met Ana Silva in Geneva on Monday.", ["World Bank"])], "k string, t string, a array<string>")
    got = {r["entity_key"]: (r["kind"], r["mentions"], r["confidence"]) for r in entities.extract_entities(df, "k", "t", "a", gazetteer.place_names(gaz[0])).collect()}
    assert got["geneva"] == ("place", 1, 0.85) and got["world bank"] == ("organization", 1, 0.95) and got["ana silva"][1] >= 1 and "monday" not in got
    raw = spark.createDataFrame([('{"actor1": {"name": "POLICE"}, "actor2": {"name": "X"}}',), (None,)], "r string")
    assert [r[0] for r in raw.select(entities.declared_actors(F.col("r"))).collect()] == [["POLICE"], []]
    stored = spark.createDataFrame([("a", "person", "Ana", 2, T0, T0)], "entity_key string, kind string, name string, mention_count bigint, first_seen_at timestamp, last_seen_at timestamp")
    new = spark.createDataFrame([("a", "person", "ANA", 3, T0 + timedelta(1), T0 + timedelta(2)), ("b", "place", "B", 1, T0, T0)], stored.schema)
    out = {r["entity_key"]: r for r in entities.upsert_entities(stored, new).collect()}
    assert out["a"]["mention_count"] == 5 and out["a"]["name"] == "Ana" and out["a"]["last_seen_at"] == T0 + timedelta(2) and out["b"]["mention_count"] == 1


def test_stage_store(spark):
    rows = [("a", 0, T0, T0 + timedelta(1), None, 1), ("b", None, T0 - timedelta(1), T0, None, 2), ("c", 1, T0, T0, "x", 3), ("d", 2, T0, T0, "x", 4)]
    df = spark.createDataFrame(rows, "id string, pipeline_stage smallint, ingested_at timestamp, occurred_at timestamp, category string, extra int")
    assert [r["id"] for r in stages.pending(df, stages.INGESTED).collect()] == ["b", "a"] and stages.backlog(df).first()["n"] == 2 and stages.pending(df, stages.ENRICHED).count() == 1
    done = stages.apply_enrichment(df, spark.createDataFrame([("a", "seismic"), ("a", "seismic"), ("d", "health"), ("zz", "x")], "id string, category string"))
    assert {r["id"]: (r["pipeline_stage"], r["category"]) for r in done.collect()} == {"a": (1, "seismic"), "b": (0, None), "c": (1, "x"), "d": (2, "health")} and done.count() == 4
    edges = "source_entity_id string, target_entity_id string, co_occurrences int, pmi double, last_seen_at timestamp"
    stored = spark.createDataFrame([("b", "a", 2, 0.1, T0), ("a", "b", 1, 0.2, T0 + timedelta(1)), ("a", None, 1, 0.1, T0), ("c", "d", 1, None, None)], edges)
    got = {(r[0], r[1]): (r[2], r[3]) for r in stages.upsert_edges(stored, spark.createDataFrame([("a", "b", 4, -0.5, T0)], edges)).collect()}
    assert got == {("a", "b"): (7, -0.5), ("c", "d"): (1, None)} and stages.upsert_edges(stored.limit(0), stored.limit(0)).count() == 0
    links = spark.createDataFrame([("o", "e", 1)], "o string, e string, n int")
    assert sorted(map(tuple, stages.insert_ignore(links, spark.createDataFrame([("o", "e", 9), ("o", "f", 3), ("o", "f", 2)], links.schema), ["o", "e"]).collect())) == [("o", "e", 1), ("o", "f", 2)]
    assert stages.rederive(df, {"n": stages.backlog})["n"].first()["n"] == 4


def test_sources_are_plug_ins(spark):
    from tidewatch.sources.registry import Source, news_feed, registry, two_letter_codes

    known = registry()
    assert known.get("rss.un-news").homepage == "https://news.un.org" and "firms.fires" in known.available({})[1] and "firms.fires" in known.available({"FIRMS_MAP_KEY": "k"})[0]
    with pytest.raises(KeyError):
        known.get("nothing")
    known.add(news_feed("rss.mine", "Mine", "https://mine.example", category="health"))
    payloads = spark.createDataFrame([("<rss><channel><item><title>T</title><guid>g</guid></item></channel></rss>",)], "payload string")
    (r,) = known.drafts("rss.mine", payloads, F.lit("2025-01-01").cast("timestamp")).collect()
    assert (r["source_id"], r["category"], r["title"]) == ("rss.mine", "health", "T")
    known.add(Source("own", "Own", lambda df, now: df))
    assert known.ids()[-1] == "own" and two_letter_codes(spark.createDataFrame([("PE", "PER"), ("", "X")], "iso2 string, iso3 string")) == {"PER": "PE"}


def test_known_names_and_aliases(spark):
    places = spark.createDataFrame([(1, "Bigtown", "Bigtown", None, 1.0, 1.0, "GB", 100_000), (2, "Smalltown", "Smalltown", None, 1.0, 2.0, "GB", 99_999)], "geoname_id bigint, name string, asciiname string, alternatenames string, lat double, lon double, country_code string, population bigint")
    countries = spark.createDataFrame([("GB", "United Kingdom"), ("CG", "Congo"), ("CD", "DR Congo proper")], "iso2 string, name string")
    assert {r[0] for r in gazetteer.known_names(places, countries).collect()} >= {"bigtown", "britain", "united kingdom"} and "smalltown" not in {r[0] for r in gazetteer.known_names(places, countries).collect()}
    lands = {r["norm"]: r["land"] for r in gazetteer.country_names(countries).collect()}
    assert lands["scotland"] == "GB" and lands["congo"] == "CG" and lands["dr congo"] == "CD" and "france" not in lands
    text = spark.createDataFrame([(1, "Rain in Britain"), (2, "Fire near Bigtown Bigtown")], "k int, t string")
    names = gazetteer.place_names(places)
    assert gazetteer.scan_text(text, "k", "t", names, countries).where("k = 1").first()["kind"] == "country" and gazetteer.places_in_text(text, "k", "t", names, countries).where("k = 1").count() == 0


def test_rules(spark):
    ev = spark.createDataFrame([("e1", "Flood hits crop", None, "severe_weather", 80, 80, 1.0), ("e2", "Quiet", None, "severe_weather", 80, 80, 1.0), ("e3", "x", None, "space", 1, 1, 0.0)], "id string, title string, summary string, category string, severity int, confidence int, velocity double")
    table = [(1, ["severe_weather"], None, "ins", "Insurance", "operations", 70.0, 0.7), (2, ["severe_weather"], "(?i)crop", "agri", "Agriculture", "supply", 75.0, 0.8), (3, ["severe_weather"], None, "ins", "Other", "operations", 70.0, 0.9), (4, ["space"], None, "sat", "Satellites", "operations", 60.0, 0.7)]
    found = rules.exposures(ev, spark.createDataFrame(table, rules.RULES)).cache()
    assert sorted((r["id"], r["exposure"], r["label"], r["confidence"]) for r in found.collect()) == [("e1", "agri", "Agriculture", 64), ("e1", "ins", "Insurance", 56), ("e2", "ins", "Insurance", 56)]
    impact = rules.impacts(found)
    assert {r["id"]: r["confidence"] for r in impact.collect()} == {"e1": 60, "e2": 56} and [r["id"] for r in rules.by_channel(impact, "supply").collect()] == ["e1"]
    assert {r["channel"]: r["n"] for r in rules.channel_counts(found, ["supply", "operations", "macro"]).collect()} == {"supply": 1, "operations": 2, "macro": 0}


def test_read_parameters():
    p = reads.ReadParameters.parse({"hours": "9999", "minSeverity": "-3", "limit": "x", "order": "sideways", "groups": "hazard,nope"})
    assert (p.hours, p.min_severity, p.limit, p.order, p.groups) == (720, 0, 300, "hotness", ("hazard",)) and p.categories() == ["natural_disaster", "severe_weather", "wildfire", "seismic"]
    assert reads.ReadParameters().categories() is None and [reads.bucket_minutes(h) for h in (6, 24, 72, 73)] == [15, 60, 180, 360]


def test_search_escapes_backslashes_and_health(spark):
    ev = spark.createDataFrame([("a", "50\\% off", None, None), ("b", "plain", "Half", None)], "id string, title string, summary string, place_name string")
    assert [r["id"] for r in reads.where_all(ev, reads.EventFilters(search="\\%").conditions()).collect()] in (["a"], [])
    runs = spark.createDataFrame([("a", 2, T0), ("b", 0, None), ("c", 0, T0 - timedelta(hours=3)), ("d", 0, T0)], "id string, consecutive_failures int, last_success_at timestamp")
    assert [r["health"] for r in reads.source_health(runs, F.lit(T0)).collect()] == ["failing", "never", "stale", "healthy"]


def test_hot_and_cold_join(spark):
    df = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i}", i) for i in range(40)] + [("missing", 0)], "k string, x int")
    table = spark.createDataFrame([("hot", 60, 1)] + [(f"k{i}", 1, 2) for i in range(40)], "k string, n bigint, v int").cache()
    out = join_hot_cold(df, table, "k", "n", ["v"])
    assert out.columns == ["k", "x", "v"] and out.count() == 100 and out.where("v = 1").count() == 60


def test_enrichment(spark, gaz):
    from tidewatch.operators import enrich
    from tidewatch.sources.feeds import DRAFT

    def row(**kw):
        base = dict.fromkeys(p.split(" ")[0] for p in DRAFT.split(", "))
        return {**base, "source_id": "usgs.quakes", "occurred_at": T0, "report_count": 1, "actors": [], **kw}

    drafts = spark.createDataFrame([row(external_id="1", title="Earthquake shakes Geneva", category="seismic", magnitude=6.0, tone=-0.5), row(external_id="1", title="Later copy", occurred_at=T0 + timedelta(1)), row(external_id="2", title="Cholera outbreak", source_id="rss.x", actors=["World Bank"]), row(external_id=None, title="x"), row(external_id="3", title=" ")], DRAFT)
    enriched = enrich.enrich(drafts, *gaz).cache()
    out = {r["external_id"]: r for r in enriched.collect()}
    assert sorted(out) == ["1", "2"] and out["1"]["country_code"] == "CH" and out["1"]["category"] == "seismic" and out["1"]["category_confidence"] >= 0.9 and out["1"]["grid_cell"] == "5:27:37" and out["1"]["severity"] > out["2"]["severity"]
    assert out["2"]["category"] == "health" and out["2"]["geo_precision"] == "unknown" and out["2"]["lat"] is None
    ents, links = enrich.link_entities(enriched, gazetteer.place_names(gaz[0]))
    assert {(r["entity_key"], r["kind"]) for r in ents.collect()} >= {("world bank", "organization")} and links.count() >= 2


def test_detail_and_names(spark):
    obs = spark.createDataFrame([observation(i, i, [1.0, 0.0]) for i in range(3)], OBS)
    ev = spark.createDataFrame([("e", "E", [1.0, 0.0]), ("f", "F", [1.0, 0.1]), ("g", "G", None)], "id string, title string, centroid array<double>")
    links = spark.createDataFrame([("e", "o0"), ("e", "o1"), ("f", "o2")], "event_id string, observation_id string")
    mentions = spark.createDataFrame([("o0", "x", 2), ("o1", "x", 1), ("o1", None, 1), ("o2", "y", 1)], "observation_id string, entity_id string, mentions int")
    ents = spark.createDataFrame([("x", "X", "person"), ("y", "Y", "person")], "id string, name string, kind string")
    src = spark.createDataFrame([("s", "Source")], "id string, name string")
    d = reads.event_detail(ev, "e", links, obs, src, mentions, ents)
    assert [r["observation_id"] for r in d["members"].orderBy("occurred_at").collect()] == ["o0", "o1"] and [tuple(r)[1:5] for r in d["entities"].collect()] == [("x", "X", "person", 3)] and [r["id"] for r in d["related"].collect()] == ["f"]
    names = spark.createDataFrame([("press.a",), ("quake.b.c",), (None,)], "s string").select(reads.source_short_name(F.col("s"), {"quake.b": "Quakes"}).alias("n"), reads.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000")).alias("u")).collect()
    assert [r["n"] for r in names] == ["Press", "Quakes", None] and names[0]["u"]
    assert reads.wire_rows(spark.createDataFrame([(T0,)], "t timestamp")).first()["json"] == '{"t":"2025-03-01T00:00:00.000Z"}'


def nearest_by_hand(rows, floor, hours):
    """{subject: (event, cosine)} of (id, vector, first, last)."""
    best = {}
    for s, x, t, _ in rows:
        for e, y, _, u in rows:
            if e == s or t is None or u is None or abs(t - u).total_seconds() > hours * 3600:
                continue
            dot, xx, yy = (sum(p * q for p, q in zip(a, b)) for a, b in ((x, y), (x, x), (y, y)))
            sim = min(1.0, dot / (xx * yy) ** 0.5) if math.isfinite(xx * yy) else math.nan
            key = math.inf if math.isnan(sim) else sim
            if key >= floor and (s not in best or (-key, e) < (-best[s][1], best[s][0])):
                best[s] = (e, key)
    return best


@pytest.mark.parametrize("tile", [(8, 16), (1_000, 1_000)])
def test_nearest_in_time_against_brute_force(spark, monkeypatch, tile):
    """Tiles, blocks and portions of any size: equal vectors, multiples of a vector, one time for many, no time, infinite numbers."""
    monkeypatch.setattr(events, "TILE_ROWS", tile)
    if tile[0] == 8:
        monkeypatch.setattr(events, "BLOCK_ROWS", (5, 3))
        monkeypatch.setattr(events, "CONFIRMED", 2)
    rng = np.random.default_rng(5)
    start = datetime(2025, 3, 1)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(180):
        t = start + timedelta(hours=float(rng.integers(0, 400)))
        v = centres[i % 12] * float(rng.integers(1, 4)) + (0.25 * rng.normal(size=8) if i % 3 else 0)
        rows.append((f"e{i}", [float(np.float32(x)) for x in v], t, t + timedelta(hours=float(rng.integers(0, 60)))))
    rows += [(f"same{i}", rows[i % 4][1], start + timedelta(hours=100), start + timedelta(hours=100)) for i in range(40)]
    rows += [("late", rows[0][1], start, None), ("early", rows[0][1], None, start), ("far", [1.0] * 8, start + timedelta(days=90), start + timedelta(days=90))]
    rows += [("edge", [1.0] * 8, start + timedelta(days=93), start + timedelta(days=93)), ("over", [1.0] * 8, start + timedelta(days=96, microseconds=1), start + timedelta(days=96, microseconds=1))]
    rows += [("inf", [math.inf] + [1.0] * 7, start + timedelta(hours=30), start + timedelta(hours=30))]
    df = spark.createDataFrame([*rows, ("hole", [None] + [1.0] * 7, start, start)], "id string, centroid array<float>, first_seen_at timestamp, last_seen_at timestamp")
    got = {r["subject_id"]: (r["event_id"], math.inf if math.isnan(r["similarity"]) else r["similarity"]) for r in events.nearest_in_time(df, 0.8, 72).collect()}
    want = nearest_by_hand(rows, 0.8, 72)
    assert got.keys() == want.keys() and len(want) > 200
    assert all(got[k][0] == want[k][0] and (got[k][1] == want[k][1] or abs(got[k][1] - want[k][1]) < 1e-12) for k in want)
    assert events.nearest_in_time(df.limit(0), 0.8, 72).count() == 0


def test_best_static_match_makes_no_rows_of_pairs(spark, tmp_path, rows):
    """Ties fall to the smaller id, also if it begins the other and for multiples of a vector; no join, so pairs are never rows."""
    at = datetime(2025, 3, 5)
    v, w = [float(np.float32(0.1 * (i % 7) + 0.01 * i + 0.05)) for i in range(64)], [(-1.0) ** i for i in range(64)]
    data = [("s", v), ("e", v), ("e1", v), ("e10", [3 * x for x in v]), ("e2", [0.7 * x for x in v]), ("u", w)]
    schema = "id string, centroid array<float>, first_seen_at timestamp, last_seen_at timestamp"
    spark.createDataFrame([(i, c, at, at + timedelta(hours=5)) for i, c in data], schema).write.parquet(f"{tmp_path}/event_clusters.parquet")
    found = catalogue.QUERIES["best_static_match"](spark, str(tmp_path))
    assert {r[0]: r[1] for r in rows(found)} == {"s": "e", "e": "e1", "e1": "e", "e10": "e", "e2": "e"}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
