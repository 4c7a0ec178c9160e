"""Queries of the general data problems, each over its whole tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.late_events import hourly_counts, stale_records
from .operators.spatial import pairs_within, points_in_regions
from .operators.timestamps import normalised_records, stamped_records
from .tables import load

NEAR_KM = 12.0


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = stamped_records(*(load(spark, sf_dir, t) for t in ("feed_items", "reliefweb_items", "event_details")))
    return normalised_records(records, load(spark, sf_dir, "sources"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_kind, record_id, utc_us of every field that names an instant."""
    found = _stamped(spark, sf_dir).where("parsed.utc_us is not null and record_id is not null")
    return found.select("record_kind", "record_id", F.col("parsed.utc_us").alias("utc_us")).distinct()


def p1_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of values by kind and outcome (ok, ambiguous, nonexistent, no_zone, unparsed)."""
    return _stamped(spark, sf_dir).groupBy("record_kind", F.col("parsed.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts and baselines that contradict the corrected hourly counts."""
    return stale_records(*(load(spark, sf_dir, t) for t in ("observations", "alerts", "baselines")))


def p2_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected counts of every hour with its running state."""
    hours = hourly_counts(load(spark, sf_dir, "observations"))
    return hours.select("category", "grid_cell", "period", "count", "n_periods", "running", "sum_sq")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, geoname_id of events and places at most 12 km apart."""
    events = load(spark, sf_dir, "event_clusters").select(F.col("id").alias("event_id"), "lat", "lon")
    places = load(spark, sf_dir, "places").select("geoname_id", "lat", "lon")
    return pairs_within(events, places, "event_id", "geoname_id", NEAR_KM).select("event_id", "geoname_id")


def p3_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside the bounding box of each country's places."""
    events = load(spark, sf_dir, "event_clusters").select(F.col("id").alias("event_id"), "lat", "lon")
    box = load(spark, sf_dir, "places").groupBy("country_code").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    regions = box.select("country_code", F.array(corner("s", "w"), corner("s", "e"), corner("n", "e"), corner("n", "w")).alias("ring"))
    inside = points_in_regions(events, regions, "event_id", "country_code")
    return inside.groupBy("country_code").agg(F.count(F.lit(1)).alias("n_events"))


QUERIES = {"p1_found": p1_found, "p1_status": p1_status, "p2_found": p2_found, "p2_hours": p2_hours, "p3_found": p3_found, "p3_regions": p3_regions}

_ACCEPTED = """
once AS (
  SELECT category, grid_cell, occurred_at, ingested_at FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY ingested_at, occurred_at, category, grid_cell) AS k
    FROM observations)
  WHERE k = 1 AND grid_cell IS NOT NULL AND category IS NOT NULL),
hours AS (
  SELECT category, grid_cell, epoch_us(occurred_at) // 3600000000 * 3600000000 AS period, count(*) AS n
  FROM once
  WHERE epoch_us(ingested_at) <= epoch_us(occurred_at) // 3600000000 * 3600000000 + 25 * 3600000000
  GROUP BY ALL)"""

_USABLE = """
CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)
 AND abs(lat) <= 90 AND abs(lon) <= 360 AND NOT (lat = 0 AND lon = 0) THEN 1 ELSE 0 END = 1"""
_WRAPPED = "CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END"

SQL = {
    "p2_found": f"""WITH {_ACCEPTED}
SELECT DISTINCT 'alerts' AS record_kind, a.id AS record_id
FROM alerts a LEFT JOIN hours h ON a.category = h.category AND a.grid_cell = h.grid_cell AND epoch_us(a.bucket_at) = h.period
WHERE a.observed IS DISTINCT FROM coalesce(h.n, 0)
UNION ALL
SELECT 'baselines', category || '|' || grid_cell || '|' || strftime(period_start, '%Y-%m-%d')
FROM (
  SELECT b.category, b.grid_cell, b.period_start, b.last_bucket_at, max(h.period) AS latest
  FROM baselines b LEFT JOIN hours h ON b.category = h.category AND b.grid_cell = h.grid_cell
    AND h.period >= epoch_us(b.period_start) AND h.period < epoch_us(b.period_start) + 28 * 24 * 3600000000
  GROUP BY ALL)
WHERE epoch_us(last_bucket_at) IS DISTINCT FROM latest""",
    "p2_hours": f"""WITH {_ACCEPTED}
SELECT category, grid_cell, period, n AS count,
  row_number() OVER w AS n_periods,
  CAST(sum(n) OVER w AS BIGINT) AS running,
  CAST(sum(n * n) OVER w AS BIGINT) AS sum_sq
FROM hours WINDOW w AS (PARTITION BY category, grid_cell ORDER BY period ROWS UNBOUNDED PRECEDING)""",
    "p3_found": f"""WITH e AS (SELECT DISTINCT id AS event_id, lat, {_WRAPPED} AS lon FROM event_clusters WHERE {_USABLE}),
p AS (SELECT DISTINCT geoname_id, lat, {_WRAPPED} AS lon FROM places WHERE {_USABLE})
SELECT DISTINCT event_id, geoname_id FROM e JOIN p
ON p.lat BETWEEN e.lat - 0.2 AND e.lat + 0.2
AND 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(p.lat - e.lat) / 2), 2)
  + cos(radians(e.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - e.lon) / 2), 2)))) <= 12""",
    "p3_regions": f"""WITH e AS (SELECT DISTINCT id, lat, {_WRAPPED} AS lon FROM event_clusters WHERE {_USABLE}),
r AS (SELECT country_code, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM places GROUP BY 1)
SELECT r.country_code, count(DISTINCT e.id) AS n_events FROM e JOIN r
ON e.lat >= r.s AND e.lat < r.n AND e.lon >= r.w AND e.lon < r.e GROUP BY 1""",
}
