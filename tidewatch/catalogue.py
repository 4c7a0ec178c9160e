"""Catalogue of read and processing queries over the model's tables, with their SQL.

``now`` is fixed, so that results don't depend on the day they are run.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, score, time, vector
from .model import CATEGORY_WEIGHT, GROUPS, HALF_LIFE_H, MEMBER_WEIGHT, PRECISION_CONFIDENCE, STORED_HALF_LIVES, lexicon_rows
from .operators import anomaly, classify, entities, events, gazetteer, rules
from .plans import reads
from .tables import load

NOW = datetime(2025, 3, 28)
_NOW = "TIMESTAMPTZ '2025-03-28 00:00:00+00'"


def registry() -> tuple[dict, dict[str, str], Callable]:
    """(queries, their SQL, decorator that registers a query under its function's name, with its SQL if it has one)."""
    queries: dict = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql is not None:
                texts[f.__name__] = sql
            return f

        return register

    return queries, texts, query


QUERIES, SQL, query = registry()


def _now():
    return F.lit("2025-03-28 00:00:00").cast("timestamp")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return reads.distinct_by(load(spark, d, "event_clusters"), "id")


def _filtered(spark: SparkSession, d: str, filters: reads.EventFilters) -> DataFrame:
    """Filtered events, each once. Rows that are delivered again are equal, so the filter may come first and reach the scan."""
    return reads.distinct_by(reads.where_all(load(spark, d, "event_clusters"), filters.conditions()), "id")


def _observations(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    """``id`` and the named columns of the first delivery of every observation; only they are read.

    Deliveries of one id differ in nothing but ``ingested_at``, so a condition on other columns may come first and reach the scan.
    """
    rows = load(spark, d, "observations")
    rows = rows if where is None else rows.where(where)
    names = [c for c in dict.fromkeys(columns) if c != "id"]
    if "ingested_at" not in names:
        return rows.select("id", *names).dropDuplicates(["id"])
    return rows.groupBy("id").agg(F.min_by(F.struct(*names), "ingested_at").alias("r")).select("id", "r.*")


_E = "e AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS k FROM event_clusters) WHERE k = 1)"
_O = "o AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS k FROM observations) WHERE k = 1)"
_CASE = lambda column, table, default: "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"
_HL = _CASE("category", HALF_LIFE_H, 36.0)
_AGE = lambda c: f"((epoch_us({_NOW}) - epoch_us({c})) / 3.6e9)"
_HOT = f"severity * pow(0.5, greatest(0, {_AGE('last_seen_at')}) / ({_HL}))"
_LIST = ["id", "title", "category", "status", "severity", "confidence", "country_code"]


def _listed(df: DataFrame) -> DataFrame:
    return df.select(*_LIST, F.round("hotness", 6).alias("hotness"))


@query(f"WITH {_E} SELECT {', '.join(_LIST)}, round({_HOT}, 6) AS hotness FROM e ORDER BY {_HOT} DESC, last_seen_at DESC, id LIMIT 200")
def event_list_hot(spark, d):
    return _listed(reads.list_events(_events(spark, d), reads.EventFilters(), _now()))


@query(
    f"WITH {_E} SELECT {', '.join(_LIST)}, round(severity * pow(0.5, greatest(0, {_AGE('last_seen_at')}) / ({_CASE('category', {c: HALF_LIFE_H[c] for c in STORED_HALF_LIVES}, 36.0)})), 6) AS hotness FROM e WHERE status IN ('active', 'developing') AND confidence >= 40 ORDER BY severity DESC, last_seen_at DESC, id LIMIT 50 OFFSET 10"
)
def event_list_severity(spark, d):
    return _listed(reads.list_events(_filtered(spark, d, reads.EventFilters(statuses=["active", "developing"], min_confidence=40)), reads.EventFilters(), _now(), "severity", 50, 10, "stored"))


@query(f"WITH {_E} SELECT {', '.join(_LIST)}, round({_HOT}, 6) AS hotness FROM e WHERE category IN ('seismic', 'wildfire') AND severity >= 20 ORDER BY last_seen_at DESC, id LIMIT 200")
def event_list_recent(spark, d):
    return _listed(reads.list_events(_filtered(spark, d, reads.EventFilters(categories=["seismic", "wildfire"], min_severity=20)), reads.EventFilters(), _now(), "recent"))


@query(f"WITH {_E} SELECT id, lat, lon FROM e WHERE lat BETWEEN -30 AND 40 AND lon BETWEEN 10 AND 90 AND last_seen_at >= TIMESTAMPTZ '2025-03-10 00:00:00+00' AND first_seen_at <= TIMESTAMPTZ '2025-03-20 00:00:00+00'")
def event_filter_bbox(spark, d):
    filters = reads.EventFilters(box=(10, -30, 90, 40), since=datetime(2025, 3, 10), until=datetime(2025, 3, 20))
    return _filtered(spark, d, filters).select("id", "lat", "lon")


@query(f"WITH {_E} SELECT id, lat, lon FROM e WHERE lat BETWEEN -60 AND 60 AND (lon >= 150 OR lon <= -150)")
def event_filter_bbox_wrap(spark, d):
    return _filtered(spark, d, reads.EventFilters(box=(150, -60, -150, 60))).select("id", "lat", "lon")


@query(f"WITH {_E} SELECT id, title FROM e WHERE country_code = 'XB' AND (title ILIKE '%tremor%' OR summary ILIKE '%tremor%' OR place_name ILIKE '%tremor%')")
def event_search_ilike(spark, d):
    return _filtered(spark, d, reads.EventFilters(search=" tremor ", country="xb")).select("id", "title")


@query(f"WITH {_E} SELECT count(*) AS n FROM e WHERE lat IS NOT NULL AND lon IS NOT NULL AND severity >= 50")
def event_count(spark, d):
    return reads.count_events(_filtered(spark, d, reads.EventFilters(located=True, min_severity=50)), reads.EventFilters())


@query(
    f"WITH {_E} SELECT id, CASE WHEN severity >= 70 THEN 'critical' WHEN severity >= 50 THEN 'serious' WHEN severity >= 30 THEN 'elevated' ELSE 'routine' END AS band, round(0.16 + 0.62 * sqrt(severity / 100), 6) AS size, velocity > 1.3 AND status = 'developing' AS escalating FROM e WHERE lat IS NOT NULL AND lon IS NOT NULL"
)
def event_markers(spark, d):
    rows = _filtered(spark, d, reads.EventFilters(located=True))
    escalating = (F.col("velocity") > 1.3) & (F.col("status") == "developing")
    return rows.select("id", score.band(F.col("severity")).alias("band"), F.round(reads.marker_size(F.col("severity")), 6).alias("size"), escalating.alias("escalating"))


@query(
    f"WITH {_O} SELECT epoch_us(occurred_at) // 3600000000 * 3600 AS bucket_s, category, count(*) AS count, CAST(floor(avg(severity) + 0.5) AS INTEGER) AS avg_severity, CAST(max(severity) AS INTEGER) AS max_severity FROM o WHERE occurred_at >= TIMESTAMPTZ '2025-03-20 00:00:00+00' GROUP BY 1, 2"
)
def timeline_hour(spark, d):
    rows = reads.timeline(_observations(spark, d, "occurred_at", "category", "severity", where=F.col("occurred_at") >= F.lit("2025-03-20 00:00:00").cast("timestamp")), F.lit("2025-03-20 00:00:00").cast("timestamp"))
    return rows.select(F.unix_seconds("bucket").alias("bucket_s"), "category", "count", "avg_severity", "max_severity")


@query(
    "WITH "
    + _O
    + """, s AS (SELECT unnest(range(1742428800, 1743120000, 21600)) AS bucket_s)
SELECT s.bucket_s, """
    + ", ".join(f"count(CASE WHEN category IN ({', '.join(repr(c) for c in members)}) THEN 1 END) AS {g}" for g, members in GROUPS.items())
    + " FROM s LEFT JOIN o ON epoch_us(o.occurred_at) // 21600000000 * 21600 = s.bucket_s GROUP BY 1"
)
def timeline_groups_filled(spark, d):
    rows = reads.grouped_timeline(_observations(spark, d, "occurred_at", "category", "severity", where=(F.col("occurred_at") >= F.lit(datetime(2025, 3, 20))) & (F.col("occurred_at") < F.lit(NOW))), datetime(2025, 3, 20), NOW, reads.bucket_minutes(192))
    return rows.select(F.unix_seconds("bucket").alias("bucket_s"), *GROUPS)


@query(
    f"""WITH {_E}, {_O}, a AS (SELECT DISTINCT ON (id) * FROM alerts)
SELECT * FROM (SELECT count(*) FILTER (WHERE status = 'active') AS active_events, count(*) FILTER (WHERE severity >= 70) AS critical_events, count(DISTINCT country_code) AS countries_affected FROM e WHERE last_seen_at >= {_NOW} - INTERVAL 24 HOUR),
(SELECT count(*) AS observations_24h FROM o WHERE ingested_at >= {_NOW} - INTERVAL 24 HOUR), (SELECT count(*) AS open_alerts FROM a WHERE acknowledged_at IS NULL), (SELECT count(*) AS total_sources FROM sources WHERE enabled)"""
)
def dashboard_stats(spark, d):
    alerts = reads.distinct_by(load(spark, d, "alerts"), "id")
    return reads.dashboard_stats(_events(spark, d), _observations(spark, d, "ingested_at"), alerts, load(spark, d, "sources"), _now())


@query(f"WITH {_E} SELECT category, count(*) AS n FROM e WHERE last_seen_at >= {_NOW} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY n DESC, category LIMIT 8")
def stats_top_categories(spark, d):
    return reads.top_categories(_events(spark, d), _now())


@query("WITH a AS (SELECT DISTINCT ON (id) * FROM alerts) SELECT id, title, observed, severity FROM a WHERE acknowledged_at IS NULL ORDER BY created_at DESC, id LIMIT 50")
def alerts_recent(spark, d):
    return reads.list_alerts(reads.distinct_by(load(spark, d, "alerts"), "id"), open_only=True).select("id", "title", "observed", "severity")


@query("SELECT id, name, kind, mention_count FROM entities ORDER BY mention_count DESC, id LIMIT 60")
def graph_nodes(spark, d):
    return reads.graph_nodes(load(spark, d, "entities"))


@query(
    """WITH n AS (SELECT id FROM entities ORDER BY mention_count DESC, id LIMIT 60)
SELECT source_entity_id, target_entity_id, co_occurrences, round(CASE WHEN isnan(pmi) THEN NULL ELSE pmi END, 6) AS pmi FROM (SELECT DISTINCT * FROM entity_edges)
WHERE co_occurrences >= 2 AND source_entity_id IN (SELECT id FROM n) AND target_entity_id IN (SELECT id FROM n)
ORDER BY CASE WHEN isnan(pmi) THEN NULL ELSE pmi END DESC NULLS LAST, source_entity_id, target_entity_id, co_occurrences LIMIT 100000"""
)
def graph_edges(spark, d):
    edges = load(spark, d, "entity_edges").distinct()
    rows = reads.graph_edges(edges, reads.graph_nodes(load(spark, d, "entities")), 100_000)
    return rows.withColumn("pmi", F.when(~F.isnan("pmi"), F.round("pmi", 6)))


_TARGET = "(SELECT min(id) FROM e WHERE len(centroid) = 64 AND list_cosine_similarity(centroid::DOUBLE[], centroid::DOUBLE[]) > 0.5)"


@query(
    f"""WITH {_E}, v AS (SELECT id, title, centroid::DOUBLE[] AS c FROM e WHERE centroid IS NOT NULL AND len(centroid) = 64 AND len(list_filter(centroid, lambda x: isnan(x))) = 0 AND len(list_filter(centroid, lambda x: x <> 0)) > 0),
t AS (SELECT id, c FROM v ORDER BY id LIMIT 1)
SELECT v.id, v.title, round(list_cosine_similarity(v.c, t.c), 6) AS similarity FROM v, t WHERE v.id <> t.id ORDER BY list_cosine_similarity(v.c, t.c) DESC, v.id LIMIT 8"""
)
def related_events_knn(spark, d):
    rows = _events(spark, d).where((F.size("centroid") == 64) & ~F.exists("centroid", lambda x: F.isnan(x)) & F.exists("centroid", lambda x: x != 0))
    target = rows.agg(F.min("id")).first()[0]
    return reads.nearest_events(rows, target, 8).withColumn("similarity", F.round("similarity", 6))


# An event's members are the observations of its category and cell within its life.
_LINKS = "l AS (SELECT e.id AS event_id, o.id AS observation_id FROM e JOIN o ON e.category = o.category AND e.grid_cell = o.grid_cell AND o.occurred_at BETWEEN e.first_seen_at AND e.last_seen_at)"


def _links(ev: DataFrame, ob: DataFrame) -> DataFrame:
    """Candidates meet in the days that the event lives, so a cell with a long history stays narrow."""
    day = lambda c: F.floor(F.unix_seconds(c) / 86_400)
    e = ev.where("first_seen_at <= last_seen_at").select(F.col("id").alias("event_id"), "category", "grid_cell", "first_seen_at", "last_seen_at", F.explode(F.sequence(day("first_seen_at"), day("last_seen_at"))).alias("day"))
    o = ob.select(F.col("id").alias("observation_id"), "category", "grid_cell", "occurred_at", day("occurred_at").alias("day"))
    return e.join(o, ["category", "grid_cell", "day"]).where(F.col("occurred_at").between(F.col("first_seen_at"), F.col("last_seen_at"))).select("event_id", "observation_id")


@query(
    f"""WITH {_E}, {_O}, {_LINKS}, r AS (SELECT l.event_id, l.observation_id, s.name AS source_name, o.occurred_at, row_number() OVER (PARTITION BY l.event_id ORDER BY o.occurred_at DESC, l.observation_id) AS k
FROM l JOIN o ON o.id = l.observation_id LEFT JOIN sources s ON s.id = o.source_id) SELECT event_id, observation_id, source_name FROM r WHERE k <= 5"""
)
def event_members(spark, d):
    ob = _observations(spark, d, "category", "grid_cell", "occurred_at", "source_id")
    rows = reads.members(_links(_events(spark, d), ob), ob.withColumnRenamed("id", "observation_id"), load(spark, d, "sources"), 5)
    return rows.select("event_id", "observation_id", "source_name")


@query(
    f"""WITH {_E}, {_O}, {_LINKS}, m AS (SELECT DISTINCT observation_id, entity_id, mentions FROM observation_entities WHERE entity_id IS NOT NULL),
s AS (SELECT l.event_id, m.entity_id, sum(m.mentions) AS mentions FROM l JOIN m USING (observation_id) GROUP BY ALL),
r AS (SELECT s.event_id, s.entity_id, n.name, n.kind, CAST(s.mentions AS BIGINT) AS mentions, CAST(row_number() OVER (PARTITION BY s.event_id ORDER BY s.mentions DESC, n.name, s.entity_id) AS INTEGER) AS k FROM s JOIN entities n ON n.id = s.entity_id)
SELECT * FROM r WHERE k <= 4"""
)
def event_top_entities_ranked(spark, d):
    mentions = load(spark, d, "observation_entities").where("entity_id is not null").select("observation_id", "entity_id", "mentions").distinct()
    return reads.top_entities(_links(_events(spark, d), _observations(spark, d, "category", "grid_cell", "occurred_at")), mentions, load(spark, d, "entities"), 4)


# The feeds of the tables at hand, each with the scale of a feed that measures the same.
_CURVES = {"quake.lattice": score.INTENSITY_CURVES["usgs.quakes"], "storm.eastgrid": score.INTENSITY_CURVES["nws.alerts"], "fire.skylook": score.INTENSITY_CURVES["firms.fires"]}
_STRENGTH = lambda source, m: f"CASE WHEN {m} IS NULL OR isnan({m}) THEN 0.4 ELSE least(1, greatest(0, CASE {source} WHEN 'quake.lattice' THEN ({m} - 2.5) / 6.5 WHEN 'storm.eastgrid' THEN ({m} - 0.5) / 3.5 WHEN 'fire.skylook' THEN log10(greatest({m}, 1) + 1) / 3.5 ELSE 0.4 END)) END"
_TONE = lambda t: f"CASE WHEN {t} IS NULL OR isnan({t}) THEN 0.3 ELSE least(1, greatest(0, -{t})) END"
_SUPPORT = lambda n: f"least(1, greatest(0, log10(greatest(1, {n})) / 2))"
_WEIGHT = _CASE("geo_precision", MEMBER_WEIGHT, 0.5)
_EDITORIAL, _SYNTHETIC = ["press.harbourpost", "press.rheinbote"], ["quake.lattice"]


@query(
    f"""WITH {_E}, {_O}, {_LINKS}, m AS (SELECT l.event_id, o.*, {_WEIGHT} AS w, epoch_us(o.occurred_at) AS us FROM l JOIN o ON o.id = l.observation_id),
b AS (SELECT event_id, count(*) AS observation_count, count(DISTINCT source_id) AS source_count, count(*) FILTER (WHERE occurred_at >= {_NOW} - INTERVAL 3 HOUR) AS recent, min(occurred_at) AS f, max(occurred_at) AS t,
 sum(CASE WHEN lon IS NOT NULL THEN w * cos(radians(lat)) * cos(radians(lon)) END) AS x, sum(CASE WHEN lon IS NOT NULL THEN w * cos(radians(lat)) * sin(radians(lon)) END) AS y, sum(CASE WHEN lon IS NOT NULL THEN w * sin(radians(lat)) END) AS z FROM m GROUP BY 1),
pk AS (SELECT * FROM (SELECT event_id, source_id, category_confidence, magnitude, tone, report_count, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(severity, 0) DESC, us, id DESC) AS k FROM m) WHERE k = 1),
bp AS (SELECT * FROM (SELECT event_id, geo_precision, place_name, row_number() OVER (PARTITION BY event_id ORDER BY w DESC, us, id DESC) AS k FROM m WHERE lat IS NOT NULL AND lon IS NOT NULL) WHERE k = 1),
bb AS (SELECT * FROM (SELECT event_id, body, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(severity, 0) DESC, us, id DESC) AS k FROM m WHERE trim(body) <> '') WHERE k = 1),
c AS (SELECT event_id, category FROM (SELECT event_id, category, row_number() OVER (PARTITION BY event_id ORDER BY round(sum(greatest(coalesce(category_confidence, 0), 0.1)), 9) DESC, category DESC) AS k FROM m GROUP BY event_id, category) WHERE k = 1),
g AS (SELECT event_id, country_code FROM (SELECT event_id, country_code, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, country_code DESC) AS k FROM m WHERE country_code IS NOT NULL GROUP BY event_id, country_code) WHERE k = 1),
v AS (SELECT *, least(10, (recent / 3) / (observation_count / greatest((epoch_us(t) - epoch_us(f)) / 3.6e9, 0.25))) AS velocity, sqrt(x * x + y * y) AS flat FROM b),
q AS (SELECT v.*, c.category, g.country_code, coalesce(bp.geo_precision, 'unknown') AS geo_precision, bp.place_name, bb.body, pk.source_id, pk.magnitude, pk.tone, coalesce(pk.category_confidence, 0) AS cc, greatest(coalesce(pk.report_count, 1), source_count) AS n,
 degrees(atan2(z, flat)) AS lat, degrees(atan2(y, x)) AS lon FROM v JOIN c USING (event_id) JOIN pk USING (event_id) LEFT JOIN g USING (event_id) LEFT JOIN bp USING (event_id) LEFT JOIN bb USING (event_id))
SELECT event_id, category, country_code, geo_precision, place_name, observation_count, source_count, round(velocity, 6) AS velocity, round(lat, 5) AS lat, round(lon, 5) AS lon, epoch_us(f) AS first_us, epoch_us(t) AS last_us, length(body) > 500 AS long_body,
 CASE WHEN lat IS NOT NULL THEN '5:' || CAST(floor((lat + 90) / 5) AS BIGINT) || ':' || CAST(floor((lon + 180) / 5) AS BIGINT) END AS grid_cell,
 CAST(floor(100 * least(1, greatest(0, ({_CASE('category', CATEGORY_WEIGHT, 0.35)}) * (0.6 * ({_STRENGTH('source_id', 'magnitude')}) + 0.25 * {_SUPPORT('n')} + 0.15 * ({_TONE('tone')})))) + 0.5) AS INTEGER) AS severity,
 CAST(floor(100 * least(1, greatest(0, ({_CASE('geo_precision', PRECISION_CONFIDENCE, 0.3)}) * (0.5 + 0.5 * cc) * least(1, greatest(0, 0.6 + 0.4 * {_SUPPORT('source_count')})))) + 0.5) AS INTEGER) AS confidence,
 CASE WHEN abs({_AGE('t')}) > 168 THEN 'closed' WHEN abs({_AGE('t')}) > 24 THEN 'dormant' WHEN velocity > 1.3 AND abs({_AGE('t')}) < 6 THEN 'developing' ELSE 'active' END AS status FROM q"""
)
def event_recompute(spark, d):
    """Every column of the recomputed events; of the summary, whether it was cut."""
    ob = _observations(spark, d, "source_id", "title", "body", "occurred_at", "lat", "lon", "geo_precision", "place_name", "country_code", "grid_cell", "category", "category_confidence", "severity", "magnitude", "tone", "report_count")
    rows = events.recompute(_links(_events(spark, d), ob), ob, _now(), _EDITORIAL, _SYNTHETIC, _CURVES)
    columns = ["event_id", "category", "country_code", "geo_precision", "place_name", "grid_cell", "observation_count", "source_count", "severity", "confidence", "status"]
    return rows.select(*columns, F.round("velocity", 6).alias("velocity"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), F.col("summary").endswith("…").alias("long_body"))


@query(
    f"""WITH {_E}, {_O}, {_LINKS}, m AS (SELECT l.event_id, o.id, trim(o.title) AS title, o.severity + CASE WHEN source_id IN ('press.harbourpost', 'press.rheinbote') THEN 25 ELSE 0 END - CASE WHEN source_id IN ('quake.lattice') THEN 20 ELSE 0 END
 + CASE WHEN length(trim(title)) BETWEEN 40 AND 140 THEN 10 WHEN length(trim(title)) < 20 THEN -15 ELSE 0 END AS s FROM l JOIN o ON o.id = l.observation_id),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, id DESC) AS k FROM m WHERE title <> '') SELECT event_id, title FROM r WHERE k = 1"""
)
def title_pick(spark, d):
    ob = _observations(spark, d, "category", "grid_cell", "occurred_at", "title", "severity", "source_id")
    members = _links(_events(spark, d), ob).join(ob.withColumnRenamed("id", "observation_id"), "observation_id")
    return events.pick_titles(members, _EDITORIAL, _SYNTHETIC)


@query("SELECT id, round(sqrt(list_sum(list_transform(centroid, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM (SELECT DISTINCT ON (id) id, centroid FROM event_clusters WHERE len(centroid) = 64 AND len(list_filter(centroid, lambda x: isnan(x))) = 0)")
def vector_norms(spark, d):
    rows = _events(spark, d).where((F.size("centroid") == 64) & ~F.exists("centroid", lambda x: F.isnan(x)))
    return rows.select("id", F.round(vector.magnitude(F.col("centroid")), 5).alias("length"))


@query("SELECT label, i - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def vector_mean(spark, d):
    flat = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return flat.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


_HAV = lambda a, o, b, p: f"2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({p} - {o}) / 2), 2))))"


@query(f"SELECT a.geoname_id AS a, b.geoname_id AS b, round({_HAV('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM places a JOIN places b ON a.country_code = b.country_code AND a.admin1 = b.admin1 AND a.geoname_id < b.geoname_id")
def haversine_pairs(spark, d):
    p = load(spark, d, "places").select("geoname_id", "lat", "lon", "country_code", "admin1")
    a, b = (p.select(F.col("geoname_id").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"), "country_code", "admin1") for s in "ab")
    km = geo.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, ["country_code", "admin1"]).where("a < b").select("a", "b", F.round(km, 6).alias("km"))


@query("SELECT '5:' || CAST(floor((lat + 90) / 5) AS BIGINT) || ':' || CAST(floor((lon + 180) / 5) AS BIGINT) AS cell, count(*) AS n FROM places GROUP BY 1")
def grid_cell_counts(spark, d):
    return load(spark, d, "places").groupBy(geo.grid_cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT country_code, sum(w * cos(radians(lat)) * cos(radians(lon))) AS x, sum(w * cos(radians(lat)) * sin(radians(lon))) AS y, sum(w * sin(radians(lat))) AS z FROM (SELECT *, population::DOUBLE AS w FROM places) GROUP BY 1)
SELECT country_code, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM s"""
)
def spherical_centroid(spark, d):
    sums = geo.unit_sums(F.col("lat"), F.col("lon"), F.col("population").cast("double"))
    rows = load(spark, d, "places").groupBy("country_code").agg(*[v.alias(k) for k, v in sums.items()])
    centre = geo.direction(F.col("x"), F.col("y"), F.col("z"), F.col("w"))
    return rows.withColumn("c", centre).select("country_code", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("SELECT country_code, round(sum(lat * population) / sum(population), 6) AS lat, round(sum(lon * population) / sum(population), 6) AS lon FROM places GROUP BY 1")
def country_centroid_weighted(spark, d):
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("population")) / F.sum("population"), 6).alias(c)
    return load(spark, d, "places").groupBy("country_code").agg(mean("lat"), mean("lon"))


_CORR = lambda n: f"least(1, greatest(0, log10(greatest(1, {n})) / 2))"
# The seven scales of strength, one a feed, over the magnitude m.
_SCALES = {
    "usgs.quakes": "(m - 2.5) / 6.5", "gdelt.events": "0.6 * least(1, greatest(0, (10 - m) / 20)) + 0.4 * abs(m) / 10", "gdacs.alerts": "(m - 0.5) / 2.5", "nws.alerts": "(m - 0.5) / 3.5",
    "firms.fires": "log10(greatest(m, 1) + 1) / 3.5", "nasa.eonet": "0.5", "noaa.swpc": "(m - 0.5) / 4.5", "other.feed": "0.4",
}
_INTENSITY = "CASE WHEN m IS NULL OR isnan(m) THEN 0.4 ELSE least(1, greatest(0, CASE feed " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SCALES.items()) + " END)) END"


@query(
    f"""WITH {_O}, f(feed) AS (VALUES {', '.join(f"('{k}')" for k in _SCALES)}), q AS (SELECT id, feed, category, magnitude AS m, tone, report_count FROM o, f)
SELECT id, feed, CAST(floor(100 * least(1, greatest(0, ({_CASE('category', CATEGORY_WEIGHT, 0.35)}) * (0.6 * ({_INTENSITY}) + 0.25 * {_CORR('coalesce(report_count, 1)')} + 0.15 * ({_TONE('tone')})))) + 0.5) AS INTEGER) AS score FROM q"""
)
def severity_score(spark, d):
    """Severity of every observation by each of the feeds' scales, and by none."""
    rows = _observations(spark, d, "category", "magnitude", "tone", "report_count").withColumn("feed", F.explode(F.array(*[F.lit(f) for f in _SCALES])))
    tone = F.when(~F.isnan("tone"), F.col("tone"))
    return rows.select("id", "feed", score.severity(F.col("category"), score.intensity(F.col("feed"), F.col("magnitude")), tone, F.col("report_count"), F.lit(1)).alias("score"))


@query(f"WITH {_E} SELECT id, CAST(floor(100 * least(1, greatest(0, ({_CASE('geo_precision', PRECISION_CONFIDENCE, 0.3)}) * 0.9 * least(1, greatest(0, 0.6 + 0.4 * {_CORR('source_count')})))) + 0.5) AS INTEGER) AS score FROM e")
def confidence_score(spark, d):
    return _events(spark, d).select("id", score.confidence(F.col("geo_precision"), F.lit(0.8), F.col("source_count")).alias("score"))


@query(f"WITH {_E} SELECT id, round(pow(0.5, greatest(0, {_AGE('last_seen_at')}) / ({_HL})), 6) AS weight FROM e")
def recency_weight(spark, d):
    return _events(spark, d).select("id", F.round(score.recency(F.col("category"), F.col("last_seen_at"), _now()), 6).alias("weight"))


@query(
    f"""WITH {_E} SELECT id, CASE WHEN abs({_AGE('last_seen_at')}) > 168 THEN 'closed' WHEN abs({_AGE('last_seen_at')}) > 24 THEN 'dormant' WHEN velocity > 1.3 AND abs({_AGE('last_seen_at')}) < 6 THEN 'developing' ELSE 'active' END AS status,
 CASE WHEN confidence >= 70 THEN 'High' WHEN confidence >= 45 THEN 'Moderate' ELSE 'Low' END AS level FROM e"""
)
def event_status(spark, d):
    return _events(spark, d).select("id", score.status(F.col("last_seen_at"), F.col("velocity"), _now()).alias("status"), score.level(F.col("confidence")).alias("level"))


_VOLUME = "h AS (SELECT category, grid_cell, epoch_us(occurred_at) // 3600000000 * 3600 AS bucket_s, count(*) AS observed FROM o WHERE grid_cell IS NOT NULL AND category IS NOT NULL GROUP BY ALL)"
_Z = """z AS (SELECT *, count(observed) OVER p AS prior_n, avg(observed) OVER p AS prior_mean, coalesce(stddev_samp(observed) OVER p, 0) AS prior_sd, avg(observed) OVER u AS expected FROM h
WINDOW p AS (PARTITION BY category, grid_cell ORDER BY bucket_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY category, grid_cell ORDER BY bucket_s ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN prior_sd > 0 THEN (observed - prior_mean) / prior_sd ELSE 0 END AS z FROM z)"""


def _cells(spark, d):
    return _observations(spark, d, "category", "grid_cell", "occurred_at", "severity")


@query(f"WITH {_O}, {_VOLUME}, {_Z} SELECT category, grid_cell, bucket_s, observed, prior_n, round(prior_mean, 6) AS prior_mean, round(z, 6) AS z FROM s")
def anomaly_zscores(spark, d):
    rows = anomaly.z_scores(anomaly.hourly_volume(_cells(spark, d)))
    return rows.select("category", "grid_cell", F.unix_seconds("bucket").alias("bucket_s"), "observed", "prior_n", F.round("prior_mean", 6).alias("prior_mean"), F.round("z", 6).alias("z"))


@query(
    f"WITH {_O}, {_VOLUME}, {_Z} SELECT 'volume_spike:' || category || ':' || grid_cell || ':' || strftime(make_timestamp(bucket_s * 1000000), '%Y-%m-%dT%H:00:00.000Z') AS dedup_key, observed, round(z, 6) AS z, CAST(floor(least(100, 45 + 55 * (1 - exp(-(z - 3) / 4))) + 0.5) AS INTEGER) AS severity, 'Unusual ' || replace(category, '_', ' ') || ' volume' AS title, observed || ' reports against ' || printf('%.1f', expected) || ' expected (' || printf('%.1f', observed / expected) || '×)' AS detail FROM s WHERE prior_n >= 12 AND z >= 3 AND observed >= 4"
)
def anomaly_alerts(spark, d):
    rows = anomaly.signals(anomaly.z_scores(anomaly.hourly_volume(_cells(spark, d))))
    return rows.select("dedup_key", "observed", F.round("z", 6).alias("z"), "severity", "title", "detail")


@query(f"WITH {_O}, {_VOLUME} SELECT category, grid_cell, count(*) AS sample_count, round(avg(observed), 6) AS mean, round(var_pop(observed) * count(*), 5) AS m2, max(bucket_s) AS last_s FROM h GROUP BY 1, 2")
def baseline_state(spark, d):
    rows = anomaly.baselines_after(anomaly.hourly_volume(_cells(spark, d)))
    return rows.select("category", "grid_cell", "sample_count", F.round("mean", 6).alias("mean"), F.round("m2", 5).alias("m2"), F.unix_seconds("last_bucket_at").alias("last_s"))


@query("SELECT source_id, content_hash, count(DISTINCT external_id) AS n FROM observations GROUP BY 1, 2 HAVING count(DISTINCT external_id) > 1")
def content_hash_dups(spark, d):
    rows = load(spark, d, "observations").groupBy("source_id", "content_hash").agg(F.count_distinct("external_id").alias("n"))
    return rows.where("n > 1")


@query("SELECT source_id, count(*) AS rows_in, count(DISTINCT external_id) AS rows_kept FROM observations GROUP BY 1")
def idempotent_dedup(spark, d):
    rows = load(spark, d, "observations")
    kept = rows.dropDuplicates(["source_id", "external_id"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("rows_kept"))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows_in")).join(kept, "source_id")


@query(f"WITH {_O} SELECT source_id, category, count(*) AS n, count(lat) AS located, count(*) - count(lat) AS unlocated FROM o GROUP BY 1, 2")
def draft_profile(spark, d):
    located = F.count("lat")
    return _observations(spark, d, "source_id", "category", "lat").groupBy("source_id", "category").agg(F.count(F.lit(1)).alias("n"), located.alias("located"), (F.count(F.lit(1)) - located).alias("unlocated"))


@query("SELECT count(*) FILTER (WHERE id IS NULL OR title IS NULL) AS missing, count(*) FILTER (WHERE abs(lat) > 90 OR abs(lon) > 180) AS out_of_range, count(*) - count(DISTINCT id) AS repeated, count(*) FILTER (WHERE occurred_at IS NULL) AS undated FROM observations")
def draft_invariants(spark, d):
    return load(spark, d, "observations").agg(
        F.count_if(F.col("id").isNull() | F.col("title").isNull()).alias("missing"),
        F.count_if((F.abs("lat") > 90) | (F.abs("lon") > 180)).alias("out_of_range"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated"),
        F.count_if(F.col("occurred_at").isNull()).alias("undated"),
    )


@query(
    f"WITH {_O} SELECT CAST(floor(lat / 0.25) AS BIGINT) AS r, CAST(floor(lon / 0.25) AS BIGINT) AS c, round(sum(lat * severity) / sum(severity), 6) AS lat, round(sum(lon * severity) / sum(severity), 6) AS lon, CAST(sum(severity) AS BIGINT) AS power, count(*) AS n FROM o WHERE category = 'wildfire' AND lat IS NOT NULL AND lon IS NOT NULL AND severity > 0 GROUP BY 1, 2 HAVING sum(severity) >= 50"
)
def fire_grid_binning(spark, d):
    from .sources.feeds import bin_detections

    rows = _observations(spark, d, "lat", "lon", "severity", "occurred_at", where=F.expr("category = 'wildfire' and lat is not null and lon is not null and severity > 0"))
    binned = bin_detections(rows.select("lat", "lon", F.col("severity").alias("frp"), "occurred_at"), 0.25, 50)
    return binned.select(F.col("row").alias("r"), F.col("column").alias("c"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("power").cast("bigint").alias("power"), "n")


@query(
    """WITH s AS (SELECT c_mktsegment, n_name, r_name, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 4))) AS revenue, count(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)
SELECT c_mktsegment, n_name, r_name, CAST(revenue AS DECIMAL(28, 4)) AS revenue, orders FROM s"""
)
def order_revenue(spark, d):
    t = {name: load(spark, d, name) for name in ("lineitem", "orders", "customer", "nation", "region")}
    joined = (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,4)"))
    return joined.groupBy("c_mktsegment", "n_name", "r_name").agg(revenue.cast("decimal(28,4)").alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_orders(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").withColumn("k", F.row_number().over(by)).where("k <= 3").select("o_orderkey", "o_custkey")


@query("SELECT epoch_us(ts) // 900000000 * 900 AS bucket_s, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def time_bucket_floor(spark, d):
    bucket = F.unix_seconds(time.floor_to(F.col("ts"), 15))
    return load(spark, d, "events").groupBy(bucket.alias("bucket_s"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))




_NORM = lambda c: f"trim(regexp_replace(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_LEX = "x(category, term, w) AS (VALUES " + ", ".join(f"('{c}', '{t.replace('-', ' ')}', {w})" for c, t, w in lexicon_rows()) + ")"


@query(
    f"""WITH {_E}, {_LEX}, t AS (SELECT id, ' ' || {_NORM("coalesce(title, '') || ' ' || coalesce(summary, '')")} || ' ' AS t FROM e),
a AS (SELECT category, sum(w) AS total FROM x GROUP BY 1)
SELECT id, category, round(least(1, 1.6 * sqrt(hit / total)), 6) AS score FROM (
  SELECT t.id, x.category, sum(CASE WHEN contains(t.t, ' ' || term || ' ') THEN w WHEN length(term) > 6 AND contains(t.t, term) THEN 0.8 * w ELSE 0 END) AS hit FROM t, x GROUP BY 1, 2) JOIN a USING (category) WHERE hit > 0"""
)
def lexical_scores(spark, d):
    rows = _events(spark, d).withColumn("__text", F.concat_ws(" ", "title", "summary"))
    return classify.lexical_scores(rows, "id", "__text").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_O}, p AS (SELECT id, category AS prior, CASE WHEN source_id IN ('quake.lattice', 'storm.eastgrid', 'fire.skylook') THEN 'authoritative' WHEN source_id IN ('wire.meridian') THEN 'weak' ELSE 'none' END AS strength,
 CASE WHEN severity > 50 THEN 'seismic' ELSE 'health' END AS inferred, coalesce(category_confidence, 0) AS c FROM o)
SELECT id, CASE WHEN prior IS NULL OR strength = 'none' THEN inferred WHEN strength = 'authoritative' THEN prior WHEN prior = inferred THEN inferred WHEN c < 0.35 THEN prior ELSE inferred END AS category,
 round(CASE WHEN prior IS NULL OR strength = 'none' THEN c WHEN strength = 'authoritative' THEN greatest(c, 0.9) WHEN prior = inferred THEN least(1, c + 0.15) WHEN c < 0.35 THEN 0.4 ELSE c END, 6) AS confidence FROM p"""
)
def prior_blend(spark, d):
    o = _observations(spark, d, "source_id", "category", "category_confidence", "severity")
    source = F.col("source_id")
    strength = F.when(source.isin("quake.lattice", "storm.eastgrid", "fire.skylook"), "authoritative").when(source == "wire.meridian", "weak").otherwise("none")
    inferred = F.when(F.col("severity") > 50, "seismic").otherwise("health")
    blended = classify.blend_prior(F.col("category"), strength, inferred, F.coalesce("category_confidence", F.lit(0.0)))
    return o.select("id", blended.alias("b")).select("id", "b.category", F.round("b.confidence", 6).alias("confidence"))


@query(
    f"""WITH {_O}, i AS (SELECT id FROM o WHERE occurred_at >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND occurred_at < TIMESTAMPTZ '2025-03-31 00:00:00+00'),
m AS (SELECT observation_id, entity_id, max(mentions) AS mentions FROM observation_entities WHERE entity_id IS NOT NULL AND observation_id IN (SELECT id FROM i) GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY mentions DESC, entity_id) AS k FROM m) WHERE k <= 8),
s AS (SELECT entity_id, count(*) AS n FROM b GROUP BY 1), t AS (SELECT count(DISTINCT observation_id) AS total FROM b),
c AS (SELECT x.entity_id AS source, y.entity_id AS target, count(*) AS n FROM b x JOIN b y ON x.observation_id = y.observation_id AND x.entity_id < y.entity_id GROUP BY 1, 2)
SELECT source, target, c.n AS co_occurrences, round(CASE WHEN c.n >= total THEN CASE WHEN a.n >= total AND z.n >= total THEN 1.0 ELSE 0.0 END ELSE greatest(-1, least(1, log2((c.n / total) / ((a.n / total) * (z.n / total))) / -log2(c.n / total))) END, 6) AS npmi
FROM c JOIN s a ON a.entity_id = source JOIN s z ON z.entity_id = target, t"""
)
def entity_pairs_npmi(spark, d):
    at = lambda day: F.lit(f"2025-03-{day} 00:00:00").cast("timestamp")
    edges = entities.co_occurrence_edges(load(spark, d, "observation_entities"), _observations(spark, d, "occurred_at"), at("01"), at("31"))
    return edges.withColumn("npmi", F.round("npmi", 6))


_RULES = [
    (1, ["armed_conflict", "terrorism"], None, "defence", "Defence", "security", 80.0, 0.8), (2, ["seismic", "wildfire", "severe_weather", "natural_disaster"], None, "insurance", "Insurance", "operations", 70.0, 0.7),
    (3, ["severe_weather", "natural_disaster"], r"(?i)\b(drought|flood|crop)", "agriculture", "Agriculture", "supply", 75.0, 0.8), (4, ["maritime"], None, "shipping", "Shipping", "supply", 68.0, 0.7),
    (5, ["wildfire", "infrastructure"], None, "insurance", "Insurers", "operations", 66.0, 0.9),
]
_RULES_SQL = "r(rule, category, keywords, exposure, channel, base, spec) AS (VALUES " + ", ".join(f"({r}, '{c}', {'NULL' if k is None else repr('flood|drought|crop')}, '{x}', '{ch}', {b}, {s})" for r, cs, k, x, _, ch, b, s in _RULES for c in cs) + ")"


def _exposures(spark, d):
    return rules.exposures(_events(spark, d), spark.createDataFrame(_RULES, rules.RULES))


_EXPOSED = f"""WITH {_E}, {_RULES_SQL}, q AS (SELECT e.id, r.*, least(1, 0.3 + severity / 250 + confidence / 500 + least(2, velocity) / 20) AS st, confidence AS c FROM e JOIN r ON r.category = e.category
 AND (r.keywords IS NULL OR regexp_matches(coalesce(title, '') || ' ' || coalesce(summary, ''), '(?i)\\b(drought|flood|crop)'))),
z AS (SELECT id, exposure, channel, rule, CAST(floor(least(100, greatest(0, base * st)) + 0.5) AS INTEGER) AS materiality, CAST(floor(least(100, greatest(0, c * spec)) + 0.5) AS INTEGER) AS confidence FROM q),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, exposure ORDER BY materiality DESC, rule) AS k FROM z) WHERE k = 1 AND materiality >= 30 AND confidence >= 20)"""


@query(_EXPOSED + " SELECT id, exposure, channel, materiality, confidence FROM k")
def rule_exposures(spark, d):
    return _exposures(spark, d).select("id", "exposure", "channel", "materiality", "confidence")


@query(_EXPOSED + " SELECT c AS channel, count(DISTINCT k.id) AS n FROM (SELECT unnest(['security', 'supply', 'policy', 'operations', 'macro']) AS c) LEFT JOIN k ON k.channel = c GROUP BY 1")
def rule_channels(spark, d):
    return rules.channel_counts(_exposures(spark, d), ["security", "supply", "policy", "operations", "macro"])


@query(
    f"""WITH {_E}, v AS (SELECT *, centroid::DOUBLE[] AS c FROM e WHERE len(centroid) = 64 AND len(list_filter(centroid, lambda x: isnan(x))) = 0 AND len(list_filter(centroid, lambda x: x <> 0)) > 0),
b AS (SELECT s.id AS s, t.id AS e, list_cosine_similarity(s.c, t.c) AS sim, abs(epoch_us(s.first_seen_at) - epoch_us(t.last_seen_at)) / 3.6e9 AS gap, s.category = t.category AS same FROM v s JOIN v t ON abs(epoch_us(s.first_seen_at) - epoch_us(t.last_seen_at)) <= 72 * 3600000000 WHERE s.id <> t.id)
SELECT s AS subject_id, e AS event_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, e) AS k FROM b WHERE sim >= 0.8) WHERE k = 1"""
)
def best_static_match(spark, d):
    """Nearest other event in time and meaning at cosine 0.8 and more; places, categories and time decay are left out (see best_event_match)."""
    usable = _events(spark, d).where((F.size("centroid") == 64) & ~F.exists("centroid", lambda x: F.isnan(x)) & F.exists("centroid", lambda x: x != 0))
    best = events.nearest_in_time(usable, 0.8, 72)
    return best.select("subject_id", "event_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {_E}, u AS (SELECT DISTINCT id, lat, CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END AS lon FROM e WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 360 AND NOT (lat = 0 AND lon = 0)),
p AS (SELECT u.id, p.geoname_id, {_HAV('u.lat', 'u.lon', 'p.lat', 'p.lon')} AS km FROM u JOIN places p ON p.lat BETWEEN u.lat - 1 AND u.lat + 1)
SELECT id, geoname_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, geoname_id) AS k FROM p WHERE km <= 100) WHERE k = 1"""
)
def nearest_place(spark, d):
    near = gazetteer.nearest_place(_events(spark, d), "id", load(spark, d, "places"), 100.0)
    return near.select("id", "geoname_id", F.round("distance_km", 6).alias("km"))


@query()
def resolved_locations(spark, d):
    """Place of every observation by the whole ladder: its own coordinates, hint, title, body, country."""
    places = load(spark, d, "places")
    countries = places.select(F.col("country_code").alias("iso2"), F.lit(None).cast("string").alias("iso3"), F.col("country_code").alias("fips"), F.col("country_name").alias("name")).distinct()
    o = _observations(spark, d, "title", "body", "place_name", "lat", "lon", "geo_precision", "country_code").withColumnRenamed("place_name", "place_hint").withColumn("fips", F.col("country_code"))
    return gazetteer.resolve_locations(o, places, countries)


@query()
def entity_extract(spark, d):
    """Entities of the titles and bodies of all observations by the default extractor."""
    o = _observations(spark, d, "title", "body").select("id", F.concat_ws(". ", "title", "body").alias("text"))
    places = load(spark, d, "places")
    countries = places.select(F.col("country_code").alias("iso2"), F.col("country_name").alias("name")).distinct()
    return entities.extract_entities(o, "id", "text", None, gazetteer.known_names(places, countries)).select("id", "entity_key", "surface", "kind", "mentions", "confidence")


@query()
def online_clusters(spark, d):
    """Events by sequential assignment of all enriched observations."""
    vectors = load(spark, d, "enrichments").groupBy(F.col("observation_id").alias("id")).agg(F.min("embedding").alias("embedding"))
    o = _observations(spark, d, "category", "lat", "lon", "geo_precision", "country_code", "occurred_at").join(vectors, "id")
    return events.cluster_online(o).groupBy("event_id").agg(F.count(F.lit(1)).alias("members"))
