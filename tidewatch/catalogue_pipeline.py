"""Queries that run the stages of the pipeline and the helpers of texts, times and places, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .catalogue import _CASE, _E, _EXPOSED, _HAV, _LINKS, _NORM, _NOW, _O, _VOLUME, _Z, NOW, _cells, _events, _exposures, _filtered, _links, _listed, _now, _observations, registry
from .functions import geo, score, text, time, vector
from .model import CATEGORIES, EVENT_ROOTS, GROUPS, MATCH_COSINE, PRECISION_RADIUS_KM
from .operators import anomaly, entities, events, gazetteer, rules, stages
from .plans import reads
from .tables import load

QUERIES, SQL, query = registry()
_DAY15 = "2025-03-15 00:00:00"


def _at(text_: str):
    return F.lit(text_).cast("timestamp")


# --- texts, times, places, vectors ------------------------------------------------------------------------


@query(f"WITH {_O} SELECT id, CASE WHEN length(title) <= 30 THEN title ELSE rtrim(regexp_replace(substr(title, 1, 30), '\\s+\\S*$', '')) || '…' END AS short FROM o")
def text_truncate(spark, d):
    return _observations(spark, d, "title").select("id", text.truncate(F.col("title"), 30).alias("short"))


@query(f"WITH {_O} SELECT id, trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) AS clean FROM o")
def text_clean(spark, d):
    """Bodies as cleaned; they hold no markup at hand, so the same white space is left."""
    return _observations(spark, d, "body").select("id", text.clean_text(F.col("body")).alias("clean"))


@query(f"WITH {_O} SELECT id, sha256({_NORM('coalesce(title, ' + chr(39) * 2 + ')')} || chr(31) || {_NORM('coalesce(body, ' + chr(39) * 2 + ')')}) AS hash FROM o")
def text_content_hash(spark, d):
    return _observations(spark, d, "title", "body").select("id", text.content_hash(F.col("title"), F.col("body")).alias("hash"))


@query(f"WITH {_O}, s AS (SELECT id, list_filter(string_split(regexp_replace(trim(body), '([.!?])\\s+(\\p{{Lu}})', '\\1' || chr(31) || '\\2', 'g'), chr(31)), lambda x: x <> '') AS s FROM o WHERE body IS NOT NULL) SELECT id, len(s) AS n, array_to_string(s, '|') AS joined FROM s")
def text_sentences(spark, d):
    rows = _observations(spark, d, "body").where("body is not null").withColumn("s", text.sentences(F.col("body")))
    return rows.select("id", F.size("s").cast("bigint").alias("n"), F.array_join("s", "|").alias("joined"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"WITH {_O} SELECT id, array_to_string(list_filter(string_split({_NORM('title')}, ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP})), ' ') AS words FROM o WHERE title IS NOT NULL")
def text_tokens(spark, d):
    return _observations(spark, d, "title").where("title is not null").select("id", F.array_join(text.tokens(F.col("title")), " ").alias("words"))


@query(f"WITH {_O} SELECT id, substr(array_to_string(list_filter([trim(title), trim(place_name), trim(body)], lambda x: x IS NOT NULL AND x <> ''), '. '), 1, 2000) AS text FROM o")
def text_embedding(spark, d):
    return _observations(spark, d, "title", "body", "place_name").select("id", text.embedding_text(F.col("title"), F.col("body"), F.col("place_name")).alias("text"))


@query("SELECT id, CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1e6) || 'M' WHEN n >= 10000 THEN CAST(floor(n / 1e3 + 0.5) AS BIGINT) || 'k' WHEN n >= 1000 THEN printf('%.1f', n / 1e3) || 'k' ELSE CAST(n AS VARCHAR) END AS short FROM (SELECT id, CAST(mention_count AS BIGINT) * 37 AS n FROM entities)")
def text_short_count(spark, d):
    return load(spark, d, "entities").select("id", text.short_count(F.col("mention_count").cast("bigint") * 37).alias("short"))


@query("SELECT code, CASE WHEN c < 1 OR c > 20 THEN 'other' ELSE list_extract([" + ", ".join(f"'{v[1]}'" for v in EVENT_ROOTS.values()) + "], c) END AS category, CASE WHEN c BETWEEN 1 AND 20 THEN list_extract([" + ", ".join(f"'{v[0]}'" for v in EVENT_ROOTS.values()) + "], c) END AS label FROM (SELECT CAST(i AS VARCHAR) AS code, i AS c FROM range(0, 26) t(i))")
def text_event_roots(spark, d):
    codes = spark.range(26).select(F.col("id").cast("string").alias("code"))
    return codes.select("code", text.root_category(F.col("code")).alias("category"), text.root_label(F.col("code")).alias("label"))


@query("SELECT DISTINCT id AS source_id, CASE WHEN id LIKE 'press.r%' THEN 'Rhine' WHEN id LIKE 'press.%' THEN 'Press' ELSE upper(id[1]) || substr(string_split(id, '.')[1], 2) END AS short FROM sources")
def text_source_names(spark, d):
    return load(spark, d, "sources").select(F.col("id").alias("source_id"), reads.source_short_name(F.col("id"), {"press.": "Press", "press.r": "Rhine"}).alias("short")).distinct()


@query(f"WITH {_E} SELECT id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' WHEN m < 43200 THEN m // 1440 || 'd ago' ELSE m // 43200 || 'mo ago' END AS ago, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN m // 60 || 'h' WHEN m < 43200 THEN m // 1440 || 'd' ELSE m // 43200 || 'mo' END AS short FROM (SELECT id, CAST(floor((epoch_us({_NOW}) - epoch_us(last_seen_at)) / 6e7) AS BIGINT) AS m FROM e)")
def time_relative(spark, d):
    return _events(spark, d).select("id", time.relative(F.col("last_seen_at"), _now()).alias("ago"), time.relative(F.col("last_seen_at"), _now(), "").alias("short"))


@query(f"WITH {_O}, f(form) AS (VALUES ('s'), ('ms'), ('digits'), ('day'), ('iso')) SELECT id, form, CASE form WHEN 'ms' THEN epoch_us(occurred_at) // 1000 * 1000 WHEN 'day' THEN epoch_us(occurred_at) // 86400000000 * 86400000000 ELSE epoch_us(occurred_at) // 1000000 * 1000000 END AS us FROM o, f")
def time_parse_date(spark, d):
    """The time of every observation written in five forms and read again."""
    o = _observations(spark, d, "occurred_at")
    at = F.col("occurred_at")
    forms = {"s": F.unix_seconds(at).cast("string"), "ms": F.unix_millis(at).cast("string"), "digits": F.date_format(at, "yyyyMMddHHmmss"), "day": F.date_format(at, "yyyyMMdd"), "iso": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    rows = o.select("id", F.explode(F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), v)])).alias("form", "written"))
    return rows.select("id", "form", F.unix_micros(time.parse_date(F.col("written"))).alias("us"))


@query("SELECT DISTINCT grid_cell, (CAST(split_part(grid_cell, ':', 2) AS INTEGER) + 0.5) * 5 - 90 AS lat, (CAST(split_part(grid_cell, ':', 3) AS INTEGER) + 0.5) * 5 - 180 AS lon FROM observations WHERE grid_cell IS NOT NULL")
def geo_cell_centres(spark, d):
    cells = load(spark, d, "observations").where("grid_cell is not null").select("grid_cell").distinct()
    return cells.withColumn("c", geo.cell_centre(F.col("grid_cell"))).select("grid_cell", "c.lat", "c.lon")


_RADIUS = lambda p: _CASE(p, PRECISION_RADIUS_KM, 2000.0)


@query(f"WITH p AS (SELECT geoname_id, lat, lon, country_code, admin1, CASE population % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'city' WHEN 2 THEN 'admin1' WHEN 3 THEN 'country' ELSE 'unknown' END AS pr FROM places) SELECT a.geoname_id AS a, b.geoname_id AS b, {_HAV('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= ({_RADIUS('a.pr')}) + ({_RADIUS('b.pr')}) AS same FROM p a JOIN p b ON a.country_code = b.country_code AND a.admin1 = b.admin1 AND a.geoname_id < b.geoname_id")
def geo_compatible(spark, d):
    precision = F.element_at(F.array(*[F.lit(p) for p in ("exact", "city", "admin1", "country", "unknown")]), (F.col("population") % 5 + 1).cast("int"))
    p = load(spark, d, "places").select("geoname_id", "lat", "lon", "country_code", "admin1", precision.alias("pr"))
    a, b = (p.select(F.col("geoname_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "pr")], "country_code", "admin1") for s in "ab")
    km = geo.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, ["country_code", "admin1"]).where("a < b").select("a", "b", geo.compatible(km, F.col("pr_a"), F.col("pr_b")).alias("same"))


@query("SELECT i - 1 AS pos, label, round(avg(x / l), 6) AS unit, round(avg((3 * x + y) / 4), 6) AS mixed FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y, generate_subscripts(embedding, 1) AS i, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS l FROM embeddings) GROUP BY 1, 2")
def vector_unit_and_running_mean(spark, d):
    """Unit vectors, and the mean of three vectors after a fourth, averaged by label and position; vectors go through their text form."""
    e = load(spark, d, "embeddings").withColumn("v", vector.from_text(vector.to_text(F.col("embedding"))))
    mixed = vector.add_to_mean(F.transform("v", lambda x: x.cast("double")), F.lit(3), F.reverse("v"))
    flat = e.select("label", F.posexplode(F.arrays_zip(vector.normalise(F.col("v")).alias("u"), mixed.alias("m"))).alias("pos", "x"))
    return flat.groupBy("pos", "label").agg(F.round(F.avg("x.u"), 6).alias("unit"), F.round(F.avg("x.m"), 6).alias("mixed"))


# --- reads ------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT source_id AS id, count(*) % 4 AS consecutive_failures, CASE WHEN count(*) % 3 <> 0 THEN max(ingested_at) END AS ok FROM observations GROUP BY 1)
SELECT id, CASE WHEN consecutive_failures > 0 THEN 'failing' WHEN ok IS NULL THEN 'never' WHEN epoch_us(ok) < epoch_us(TIMESTAMPTZ '2025-03-31 00:00:00+00') - 7200000000 THEN 'stale' ELSE 'healthy' END AS health FROM r"""
)
def source_health(spark, d):
    """Health of the sources, their runs made from the counts of what they delivered."""
    runs = load(spark, d, "observations").groupBy(F.col("source_id").alias("id")).agg((F.count(F.lit(1)) % 4).alias("consecutive_failures"), F.when(F.count(F.lit(1)) % 3 != 0, F.max("ingested_at")).alias("last_success_at"))
    return reads.source_health(runs, _at("2025-03-31 00:00:00")).select("id", "health")


@query(f"WITH {_E} SELECT '{{\"id\":\"' || id || '\",\"severity\":' || severity || ',\"last_seen_at\":\"' || strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(last_seen_at) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z\"}}' AS json FROM e")
def wire_rows(spark, d):
    return reads.wire_rows(_events(spark, d).select("id", "severity", "last_seen_at"))


@query(f"WITH {_O}, b AS (SELECT epoch_us(occurred_at) // 21600000000 AS b, count(*) AS n FROM o WHERE occurred_at >= TIMESTAMPTZ '2025-03-20 00:00:00+00' AND occurred_at < {_NOW} AND category IN ({', '.join(repr(c) for g in ('hazard', 'human') for c in GROUPS[g])}) GROUP BY 1) SELECT greatest(1, max(n)) AS peak, CAST(sum(n) AS BIGINT) AS total FROM b")
def timeline_peak(spark, d):
    ob = _observations(spark, d, "occurred_at", "category", "severity", where=(F.col("occurred_at") >= F.lit(datetime(2025, 3, 20))) & (F.col("occurred_at") < F.lit(NOW)))
    return reads.peak_bucket(reads.grouped_timeline(ob, datetime(2025, 3, 20), NOW, 360), ["hazard", "human"])


@query(
    f"""WITH {_E}, {_O}, {_LINKS}, m AS (SELECT DISTINCT observation_id, entity_id, mentions FROM observation_entities WHERE entity_id IS NOT NULL), s AS (SELECT l.event_id, m.entity_id, sum(m.mentions) AS n FROM l JOIN m USING (observation_id) GROUP BY ALL),
r AS (SELECT s.event_id, x.name, row_number() OVER (PARTITION BY s.event_id ORDER BY n DESC, x.name, s.entity_id) AS k FROM s JOIN entities x ON x.id = s.entity_id)
SELECT e.id, e.severity, c.names FROM (SELECT * FROM e WHERE severity >= 40 ORDER BY severity DESC, last_seen_at DESC, id LIMIT 200) e LEFT JOIN (SELECT event_id, string_agg(name, '|' ORDER BY k) AS names FROM r WHERE k <= 3 GROUP BY 1) c ON c.event_id = e.id"""
)
def event_cards(spark, d):
    """The listed events with their three most mentioned entities."""
    listed = reads.list_events(_filtered(spark, d, reads.EventFilters(min_severity=40)), reads.EventFilters(), _now(), "severity")
    mentions = load(spark, d, "observation_entities").where("entity_id is not null").select("observation_id", "entity_id", "mentions").distinct()
    top = reads.top_entities(_links(_events(spark, d), _observations(spark, d, "category", "grid_cell", "occurred_at")), mentions, load(spark, d, "entities"), 3)
    return reads.event_cards(listed, top).select("id", "severity", F.array_join(F.transform("entities", lambda x: x["name"]), "|").alias("names"))


@query(
    f"""WITH {_E}, {_O}, {_LINKS}, t AS (SELECT event_id FROM l GROUP BY 1 ORDER BY count(*) DESC, event_id LIMIT 1), m AS (SELECT DISTINCT observation_id, entity_id, mentions FROM observation_entities WHERE entity_id IS NOT NULL)
SELECT 'event' AS part, 1 AS n UNION ALL SELECT 'members', least(200, count(*)) FROM l JOIN t USING (event_id) UNION ALL SELECT 'entities', least(25, count(DISTINCT m.entity_id)) FROM l JOIN t USING (event_id) JOIN m USING (observation_id) JOIN entities x ON x.id = m.entity_id"""
)
def event_detail(spark, d):
    """Sizes of the parts of the detail of the event with the most members."""
    ev, ob = _events(spark, d), _observations(spark, d, "category", "grid_cell", "occurred_at", "source_id")
    links = _links(ev, ob)
    target = links.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_id").first()
    mentions = load(spark, d, "observation_entities").where("entity_id is not null").select("observation_id", "entity_id", "mentions").distinct()
    parts = reads.event_detail(ev, target["event_id"] if target else "", links, ob, load(spark, d, "sources"), mentions, load(spark, d, "entities"))
    sizes = [parts[p].agg(F.lit(p).alias("part"), F.count(F.lit(1)).cast("int").alias("n")) for p in ("event", "members", "entities")]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query("SELECT * FROM (VALUES (1, 24, 0, 300, 'hotness', ''), (2, 720, 100, 1, 'severity', ''), (3, 1, 0, 1500, 'hotness', 'natural_disaster,severe_weather,wildfire,seismic,health,humanitarian'), (4, 24, 30, 300, 'recent', '')) AS t(n, hours, min_severity, most, ordered, categories)")
def read_parameters(spark, d):
    """Parameters of requests: defaults, out of range, groups, all groups and nonsense."""
    raw = [{}, {"hours": "9999", "minSeverity": "101", "limit": "0", "order": "severity"}, {"hours": "0.2", "minSeverity": "-5", "limit": "5000", "order": "name", "groups": "hazard,human,nothing"}, {"hours": "soon", "minSeverity": "30", "order": "recent", "groups": ",".join(GROUPS)}]
    parsed = [reads.ReadParameters.parse(r) for r in raw]
    return spark.createDataFrame([(i + 1, p.hours, p.min_severity, p.limit, p.order, ",".join(p.categories() or [])) for i, p in enumerate(parsed)], "n int, hours int, min_severity int, most int, ordered string, categories string")


@query(f"WITH {_E}, f(hours, floor) AS (SELECT h, s FROM (VALUES (6), (24), (72), (168)) a(h), (VALUES (0), (30), (50), (70)) b(s)) SELECT f.hours, f.floor, count(e.id) AS n FROM f LEFT JOIN e ON e.severity >= f.floor AND epoch_us(e.last_seen_at) >= epoch_us({_NOW}) - f.hours * 3600000000 GROUP BY 1, 2")
def filter_presets(spark, d):
    """Events of every preset of window and severity, all counted in one pass."""
    counts = [F.count_if((F.col("severity") >= s) & (F.col("last_seen_at") >= _now() - F.expr(f"INTERVAL {h} HOURS"))).alias(f"{h}_{s}") for h in reads.WINDOW_PRESETS for s in reads.SEVERITY_PRESETS]
    row = _events(spark, d).agg(*counts)
    cells = F.array(*[F.struct(F.lit(h).alias("hours"), F.lit(s).alias("floor"), F.col(f"{h}_{s}").alias("n")) for h in reads.WINDOW_PRESETS for s in reads.SEVERITY_PRESETS])
    return row.select(F.explode(cells).alias("c")).select("c.*")


@query("SELECT DISTINCT category, category IN (" + ", ".join(f"'{c}'" for c in CATEGORIES) + ") AS known FROM (SELECT category FROM observations WHERE category IS NOT NULL UNION ALL SELECT name FROM sources WHERE name IS NOT NULL)")
def category_guard(spark, d):
    names = load(spark, d, "observations").select("category").unionByName(load(spark, d, "sources").select(F.col("name").alias("category")))
    return names.where("category is not null").distinct().select("category", stages.is_category(F.col("category"), CATEGORIES).alias("known"))


@query("SELECT v, regexp_full_match(lower(v), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS good FROM (SELECT id AS v FROM sources UNION SELECT left(h, 8) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] FROM (SELECT md5(id) AS h FROM sources) UNION SELECT upper(left(h, 8)) || '-0000' FROM (SELECT md5(id) AS h FROM sources))")
def uuid_guard(spark, d):
    s = load(spark, d, "sources").select("id", F.md5("id").alias("h"))
    part = lambda a, n: F.substring("h", a, n)
    forms = [F.col("id"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.concat(F.upper(part(1, 8)), F.lit("-0000"))]
    return s.select(F.explode(F.array(*forms)).alias("v")).distinct().select("v", reads.is_uuid(F.col("v")).alias("good"))


@query(_EXPOSED + " SELECT id, max(materiality) AS materiality, CAST(floor(avg(confidence) + 0.5) AS INTEGER) AS confidence, string_agg(exposure, '|' ORDER BY materiality DESC, confidence DESC, exposure) AS exposures, CASE WHEN max(materiality) >= 70 THEN 'High' WHEN max(materiality) >= 45 THEN 'Moderate' ELSE 'Low' END AS level, bool_or(channel = 'supply') AS supply FROM k GROUP BY 1")
def event_impacts(spark, d):
    """Impacts of the events with their exposures, strongest first, and those that touch a channel."""
    impact = rules.impacts(_exposures(spark, d))
    supply = rules.by_channel(impact, "supply").select("id", F.lit(True).alias("supply"))
    named = impact.join(supply, "id", "left").withColumn("supply", F.coalesce("supply", F.lit(False)))
    return named.select("id", "materiality", "confidence", F.array_join(F.transform("exposures", lambda x: x["exposure"]), "|").alias("exposures"), score.level(F.col("materiality")).alias("level"), "supply")


@query(_EXPOSED + " SELECT k.id AS event_id, max(k.materiality) AS materiality, min(e.title) AS title FROM k JOIN e ON e.id = k.id GROUP BY 1")
def impact_events(spark, d):
    return stages.events_of_impacts(rules.impacts(_exposures(spark, d)).select("id", "materiality"), _events(spark, d).select("id", "title"))


@query("SELECT (SELECT count(*) FROM places) AS places, (SELECT count(DISTINCT country_code) FROM places) AS countries")
def gazetteer_statistics(spark, d):
    places = load(spark, d, "places")
    rows = gazetteer.statistics(places, places.select(F.col("country_code").alias("iso2"), F.col("country_name").alias("name")).distinct())
    return rows.select("places", "countries")


# --- volumes and alerts -----------------------------------------------------------------------------------


@query(f"WITH {_O}, {_VOLUME}, r AS (SELECT category, grid_cell, min(bucket_s) AS a, max(bucket_s) AS b, count(*) AS n FROM h GROUP BY 1, 2) SELECT category, grid_cell, CAST((b - a) // 3600 + 1 AS BIGINT) AS hours, CAST((b - a) // 3600 + 1 - n AS BIGINT) AS empty FROM r")
def volume_gaps(spark, d):
    filled = anomaly.fill_gaps(anomaly.hourly_volume(_cells(spark, d)).select("category", "grid_cell", "bucket", "observed"))
    return filled.groupBy("category", "grid_cell").agg(F.count(F.lit(1)).alias("hours"), F.count_if(F.col("observed") == 0).alias("empty"))


@query(f"WITH {_O}, {_VOLUME} SELECT category, grid_cell, count(*) AS sample_count, round(avg(observed), 6) AS mean, round(var_pop(observed) * count(*), 4) AS m2, max(bucket_s) AS last_s FROM h GROUP BY 1, 2")
def baseline_merge(spark, d):
    """Baselines of both halves of the month put together."""
    hours = anomaly.hourly_volume(_cells(spark, d))
    old, new = (anomaly.baselines_after(hours.where(c)) for c in (F.col("bucket") < _at(_DAY15), F.col("bucket") >= _at(_DAY15)))
    rows = anomaly.merge_baselines(old, new)
    return rows.select("category", "grid_cell", "sample_count", F.round("mean", 6).alias("mean"), F.round("m2", 4).alias("m2"), F.unix_seconds("last_bucket_at").alias("last_s"))


_KEY = "'volume_spike:' || category || ':' || grid_cell || ':' || strftime(make_timestamp(bucket_s * 1000000), '%Y-%m-%dT%H:00:00.000Z')"


@query(f"WITH {_O}, {_VOLUME}, {_Z}, k AS (SELECT {_KEY} AS dedup_key FROM s WHERE prior_n >= 3 AND z >= 1.5 AND observed >= 2) SELECT dedup_key FROM k WHERE dedup_key NOT IN (SELECT 'volume_spike:' || category || ':' || grid_cell || ':' || strftime(bucket_at, '%Y-%m-%dT%H:00:00.000Z') FROM alerts WHERE category IS NOT NULL AND grid_cell IS NOT NULL AND bucket_at IS NOT NULL)")
def alerts_new(spark, d):
    """Signals of a low threshold that no alert of the store has yet."""
    found = anomaly.signals(anomaly.z_scores(anomaly.hourly_volume(_cells(spark, d))), 1.5, 2, 3)
    hour = F.date_format("bucket_at", "yyyy-MM-dd'T'HH:00:00.000'Z'")
    stored = load(spark, d, "alerts").where("category is not null and grid_cell is not null and bucket_at is not null").select(F.concat_ws(":", F.lit("volume_spike"), "category", "grid_cell", hour).alias("dedup_key"))
    return anomaly.new_alerts(found, stored).select("dedup_key")


# --- the store between the stages -------------------------------------------------------------------------


@query(f"WITH {_O} SELECT * FROM (SELECT 'enrich' AS queue, id FROM o WHERE coalesce(pipeline_stage, 0) = 0 ORDER BY ingested_at, id LIMIT 200) UNION ALL SELECT * FROM (SELECT 'assign', id FROM o WHERE pipeline_stage = 1 ORDER BY occurred_at, id LIMIT 150)")
def pending_rows(spark, d):
    """The next rows of both backlogs."""
    o = _observations(spark, d, "pipeline_stage", "ingested_at", "occurred_at")
    queue = lambda name, stage: stages.pending(o, stage).select(F.lit(name).alias("queue"), "id")
    return queue("enrich", stages.INGESTED).unionByName(queue("assign", stages.ENRICHED))


@query(f"WITH {_O} SELECT count(*) FILTER (WHERE coalesce(pipeline_stage, 0) = 0) AS n FROM o")
def backlog(spark, d):
    return stages.backlog(_observations(spark, d, "pipeline_stage"))


@query(f"WITH {_O}, n AS (SELECT observation_id, min(category) AS category, CAST(min(severity) AS SMALLINT) AS severity FROM enrichments GROUP BY 1) SELECT o.id, CASE WHEN n.observation_id IS NULL THEN o.category ELSE n.category END AS category, CASE WHEN n.observation_id IS NULL THEN o.severity ELSE n.severity END AS severity, CAST(greatest(coalesce(o.pipeline_stage, 0), CASE WHEN n.observation_id IS NULL THEN 0 ELSE 1 END) AS SMALLINT) AS pipeline_stage FROM o LEFT JOIN n ON n.observation_id = o.id")
def enrichment_update(spark, d):
    """Observations with their enrichment, one stage on."""
    new = load(spark, d, "enrichments").groupBy(F.col("observation_id").alias("id")).agg(F.min("category").alias("category"), F.min("severity").alias("severity"))
    return stages.apply_enrichment(_observations(spark, d, "category", "severity", "pipeline_stage"), new)


@query("WITH m AS (SELECT key, kind, min(surface) AS name, sum(mentions) AS n FROM observation_entities WHERE key IS NOT NULL AND kind IS NOT NULL GROUP BY 1, 2), s AS (SELECT key, kind, name, mention_count FROM entities) SELECT coalesce(s.key, m.key) AS entity_key, coalesce(s.kind, m.kind) AS kind, coalesce(s.name, m.name) AS name, CAST(coalesce(mention_count, 0) + coalesce(n, 0) AS BIGINT) AS mention_count FROM s FULL JOIN m ON s.key = m.key AND s.kind = m.kind")
def entity_upsert(spark, d):
    """Stored entities with all mentions of the log added in."""
    found = load(spark, d, "observation_entities").where("key is not null and kind is not null").select(F.col("key").alias("entity_key"), "kind", "surface", F.col("mentions").cast("bigint").alias("mentions"), _now().alias("seen"))
    stored = load(spark, d, "entities").select(F.col("key").alias("entity_key"), "kind", "name", F.col("mention_count").cast("bigint").alias("mention_count"), "first_seen_at", "last_seen_at")
    return entities.upsert_entities(stored, entities.merge_entities(found, "seen")).select("entity_key", "kind", "name", "mention_count")


@query("WITH l AS (SELECT DISTINCT observation_id, entity_id FROM observation_entities WHERE entity_id IS NOT NULL AND observation_id IS NOT NULL) SELECT entity_id, count(*) AS n FROM l GROUP BY 1")
def link_insert(spark, d):
    """Links of the first half of the observations, and those of all inserted where there is none."""
    links = load(spark, d, "observation_entities").where("entity_id is not null and observation_id is not null").select("observation_id", "entity_id", "mentions")
    stored = links.where(F.col("observation_id") < "ob-8").groupBy("observation_id", "entity_id").agg(F.max("mentions").alias("mentions"))
    return stages.insert_ignore(stored, links, ["observation_id", "entity_id"]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH a AS (SELECT least(source_entity_id, target_entity_id) AS s, greatest(source_entity_id, target_entity_id) AS t, co_occurrences AS c, pmi, last_seen_at, 0 AS new FROM entity_edges WHERE source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL
UNION ALL SELECT least(source_entity_id, target_entity_id), greatest(source_entity_id, target_entity_id), 1, 0.5, {_NOW}, 1 FROM (SELECT DISTINCT source_entity_id, target_entity_id FROM entity_edges WHERE co_occurrences >= 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY new DESC, last_seen_at DESC NULLS LAST, pmi DESC NULLS LAST) AS k, sum(c) OVER (PARTITION BY s, t) AS total FROM a)
SELECT s AS source_entity_id, t AS target_entity_id, CAST(total AS BIGINT) AS co_occurrences, CASE WHEN isnan(pmi) THEN NULL ELSE round(pmi, 6) END AS pmi, epoch_us(last_seen_at) AS seen_us FROM r WHERE k = 1"""
)
def edge_upsert(spark, d):
    """The stored edges with a window's edges (those of three and more, once each) merged in."""
    stored = load(spark, d, "entity_edges")
    new = stored.where("co_occurrences >= 3").select("source_entity_id", "target_entity_id").distinct().select("*", F.lit(1).alias("co_occurrences"), F.lit(0.5).alias("pmi"), _now().alias("last_seen_at"))
    rows = stages.upsert_edges(stored, new)
    return rows.select("source_entity_id", "target_entity_id", "co_occurrences", F.when(~F.isnan("pmi"), F.round("pmi", 6)).alias("pmi"), F.unix_micros("last_seen_at").alias("seen_us"))


@query(f"WITH {_O}, {_VOLUME} SELECT 'observations' AS name, count(*) AS n FROM o UNION ALL SELECT 'baselines', count(*) FROM (SELECT DISTINCT category, grid_cell FROM h) UNION ALL SELECT 'backlog', count(*) FROM o")
def rederived(spark, d):
    """Sizes of the tables made anew from the log."""
    o = _observations(spark, d, "category", "grid_cell", "occurred_at", "severity", "pipeline_stage")
    tables = stages.rederive(o, {"baselines": lambda x: anomaly.baselines_after(anomaly.hourly_volume(x)), "backlog": lambda x: stages.at_stage(x, stages.INGESTED)})
    size = lambda name: tables[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return size("observations").unionByName(size("baselines")).unionByName(size("backlog"))


@query(f"WITH {_O} SELECT id, CASE WHEN length(title) <= 200 THEN title ELSE rtrim(regexp_replace(substr(title, 1, 200), '\\s+\\S*$', '')) || '…' END AS title, CASE WHEN trim(body) <> '' THEN length(body) <= 600 END AS whole, status, severity, observation_count, epoch_us(occurred_at) AS first_us FROM (SELECT *, 'active' AS status, 1 AS observation_count FROM o)")
def event_creation(spark, d):
    """The event that every observation would begin."""
    o = _observations(spark, d, "title", "body", "category", "severity", "confidence", "lat", "lon", "geo_precision", "place_name", "country_code", "grid_cell", "occurred_at").withColumn("embedding", F.lit(None).cast("array<float>"))
    return events.created_events(o).select("id", "title", (~F.col("summary").endswith("…")).alias("whole"), "status", "severity", "observation_count", F.unix_micros("first_seen_at").alias("first_us"))


_USABLE = "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND abs(lat) <= 90 AND abs(lon) <= 360 AND NOT (lat = 0 AND lon = 0)"
_BEST = f"""WITH {_E}, v AS (SELECT id, category, geo_precision AS pr, country_code AS cc, centroid::DOUBLE[] AS c, CASE WHEN {_USABLE} THEN lat END AS lat, CASE WHEN {_USABLE} THEN lon END AS lon, epoch_us(first_seen_at) / 3.6e9 AS a, epoch_us(last_seen_at) / 3.6e9 AS b
 FROM e WHERE centroid IS NOT NULL AND len(list_filter(centroid, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(centroid, lambda x: x <> 0)) > 0),
p AS (SELECT s.id AS s, t.id AS t, list_cosine_similarity(s.c, t.c) AS sim, abs(s.a - t.b) AS gap, s.category IS NOT DISTINCT FROM t.category AND s.category IS NOT NULL AS same, s.pr IN ('country', 'unknown') OR t.pr IN ('country', 'unknown') AS coarse, s.cc = t.cc AS land, s.cc <> t.cc AS other,
 CASE WHEN s.lat + s.lon + t.lat + t.lon IS NOT NULL THEN {_HAV('s.lat', 's.lon', 't.lat', 't.lon')} END AS km, ({_RADIUS('s.pr')}) + ({_RADIUS('t.pr')}) AS budget FROM v s JOIN v t ON s.id <> t.id AND len(s.c) = len(t.c) AND abs(s.a - t.b) <= 72),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, t) AS k FROM p WHERE sim >= {MATCH_COSINE}),
f AS (SELECT *, sim * CASE WHEN gap <= 6 THEN 1.0 ELSE greatest(0.0, 1 - 0.45 * (gap - 6) / 66) END * CASE WHEN coarse AND coalesce(land, false) THEN 0.95 WHEN km IS NULL THEN 0.85 WHEN km <= budget THEN CASE WHEN coalesce(other, false) THEN 0.7 ELSE 1.0 END ELSE pow(budget / km, 1.5) * CASE WHEN coalesce(other, false) THEN 0.7 ELSE 1.0 END END * CASE WHEN same THEN 1.0 ELSE 0.8 END AS adjusted FROM n WHERE k <= 20),
z AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY adjusted DESC, t) AS r FROM f WHERE adjusted >= {MATCH_COSINE})
SELECT s AS subject_id, t AS event_id, round(sim, 5) AS similarity, round(adjusted, 5) AS adjusted FROM z WHERE r = 1"""


@query(_BEST)
def best_event_match(spark, d):
    """Best other event of every event by match_candidates, with its threshold and all its factors; impossible coordinates are no location."""
    columns = ["id", "centroid", "category", "lat", "lon", "geo_precision", "country_code"]
    e = _events(spark, d)
    located = (F.abs("lat") <= 90) & (F.abs("lon") <= 360) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    e = e.withColumns({c: F.when(located, F.col(c)) for c in ("lat", "lon")})
    subjects = e.select(*columns, F.col("first_seen_at").alias("occurred_at")).withColumnRenamed("centroid", "embedding")
    best = events.match_candidates(subjects, e.select(*columns, "last_seen_at"), others=True)
    return best.select("subject_id", "event_id", F.round("similarity", 5).alias("similarity"), F.round("adjusted", 5).alias("adjusted"))
