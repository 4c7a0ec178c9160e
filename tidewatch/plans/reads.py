"""Read queries over observations, events, alerts and the entity graph, as DataFrame plans."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score
from ..functions.time import floor_to
from ..functions.vector import cosine
from ..model import CATEGORIES, GROUPS, group_of

#: Events that are live for the dashboard, and those drawn at most.
LIST_DEFAULT, LIST_MOST = 200, 2000
# Windows in hours and least severities that the dashboard offers.
WINDOW_PRESETS, SEVERITY_PRESETS = [6, 24, 72, 168], [0, 30, 50, 70]


@dataclass(frozen=True)
class EventFilters:
    """Optional conditions on events, all of which must hold; None means no condition."""

    categories: list[str] | None = None
    statuses: list[str] | None = None
    min_severity: int | None = None
    min_confidence: int | None = None
    since: datetime | None = None
    until: datetime | None = None
    country: str | None = None
    located: bool = False
    #: west, south, east, north; west > east spans the antimeridian.
    box: tuple[float, float, float, float] | None = None
    search: str | None = None
    extra: list[Column] = field(default_factory=list)

    def conditions(self) -> list[Column]:
        out = list(self.extra)
        if self.categories:
            out.append(F.col("category").isin(self.categories))
        if self.statuses:
            out.append(F.col("status").isin(self.statuses))
        if self.min_severity is not None:
            out.append(F.col("severity") >= self.min_severity)
        if self.min_confidence is not None:
            out.append(F.col("confidence") >= self.min_confidence)
        # An event overlaps the interval if it was last seen after its start and first seen before its end.
        if self.since is not None:
            out.append(F.col("last_seen_at") >= F.lit(self.since))
        if self.until is not None:
            out.append(F.col("first_seen_at") <= F.lit(self.until))
        if self.country:
            out.append(F.col("country_code") == self.country.upper())
        if self.located:
            out.append(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        if self.box is not None:
            west, south, east, north = self.box
            out.append(F.col("lat").between(south, north))
            out.append(F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east))
        if self.search and self.search.strip():
            pattern = "%" + self.search.strip().replace("\\", "\\\\") + "%"
            out.append(functools.reduce(operator.or_, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in ("title", "summary", "place_name")]))
        return out


@dataclass(frozen=True)
class ReadParameters:
    """Parameters of a request, brought into their ranges."""

    hours: int = 24
    min_severity: int = 0
    limit: int = 300
    order: str = "hotness"
    groups: tuple[str, ...] = ()

    @staticmethod
    def parse(raw: dict[str, str]) -> ReadParameters:
        def number(name: str, low: int, high: int, default: int) -> int:
            try:
                return max(low, min(high, int(float(raw.get(name, default)))))
            except (TypeError, ValueError, OverflowError):
                return default

        groups = tuple(g for g in (raw.get("groups") or "").split(",") if g in GROUPS)
        order = raw.get("order") if raw.get("order") in ("hotness", "severity", "recent") else "hotness"
        return ReadParameters(number("hours", 1, 720, 24), number("minSeverity", 0, 100, 0), number("limit", 1, 1500, 300), order, groups)

    def categories(self) -> list[str] | None:
        """Categories of the groups; none or all groups mean no condition."""
        if not self.groups or len(set(self.groups)) == len(GROUPS):
            return None
        return [c for c in CATEGORIES if any(c in GROUPS[g] for g in self.groups)]


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return functools.reduce(lambda d, c: d.where(c), conditions, df)


def distinct_by(df: DataFrame, key: str) -> DataFrame:
    """One row per key of a table that delivers rows again; null keys are dropped."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def list_events(events: DataFrame, filters: EventFilters, now: Column, order: str = "hotness", limit: int | None = None, offset: int = 0, mode: str = "full") -> DataFrame:
    """Filtered events with ``hotness``, ordered and cut; ties are broken by last_seen_at and id."""
    rows = where_all(events, filters.conditions()).withColumn("hotness", score.hotness(F.col("severity"), F.col("category"), F.col("last_seen_at"), now, mode))
    by = {"hotness": [F.desc("hotness")], "severity": [F.desc("severity")], "recent": []}[order]
    return rows.orderBy(*by, F.desc("last_seen_at"), "id").offset(offset).limit(min(limit or LIST_DEFAULT, LIST_MOST))


def count_events(events: DataFrame, filters: EventFilters) -> DataFrame:
    return where_all(events, filters.conditions()).agg(F.count(F.lit(1)).alias("n"))


def timeline(observations: DataFrame, since: Column, minutes: int = 60, categories: list[str] | None = None) -> DataFrame:
    """bucket, category, count, avg_severity (rounded) and max_severity."""
    rows = observations.where(F.col("occurred_at") >= since)
    if categories:
        rows = rows.where(F.col("category").isin(categories))
    return rows.groupBy(floor_to(F.col("occurred_at"), minutes).alias("bucket"), "category").agg(
        F.count(F.lit(1)).alias("count"), score.round_half_up(F.avg("severity")).alias("avg_severity"), F.max("severity").cast("int").alias("max_severity")
    )


def bucket_minutes(hours: int) -> int:
    """Bucket width for a window of so many hours."""
    return 15 if hours <= 6 else 60 if hours <= 24 else 180 if hours <= 72 else 360


def grouped_timeline(observations: DataFrame, since: datetime, until: datetime, minutes: int) -> DataFrame:
    """bucket and a column per display group, a row for every bucket of the window; empty ones hold 0."""
    counts = (
        timeline(observations.where(F.col("occurred_at") < F.lit(until)), F.lit(since), minutes)
        .withColumn("group", group_of(F.col("category")))
        .groupBy("bucket")
        .pivot("group", list(GROUPS))
        .agg(F.sum("count"))
    )
    spark = observations.sparkSession
    first = floor_to(F.lit(since).cast("timestamp"), minutes)
    last = F.lit(until).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    spine = spark.range(1).select(F.explode(F.sequence(first, last, F.expr(f"INTERVAL {minutes} MINUTES"))).alias("bucket"))
    return spine.join(counts, "bucket", "left").na.fill(0, list(GROUPS))


def peak_bucket(grouped: DataFrame, groups: list[str]) -> DataFrame:
    """Largest bucket total (1 at least) and grand total of the chosen groups."""
    total = functools.reduce(operator.add, [F.col(g) for g in groups])
    return grouped.agg(F.greatest(F.lit(1), F.max(total)).alias("peak"), F.sum(total).alias("total"))


def dashboard_stats(events: DataFrame, observations: DataFrame, alerts: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """One row of counts; every table is read once."""
    day = now - F.expr("INTERVAL 24 HOURS")
    one = F.lit(1).alias("one")
    fresh = F.col("last_seen_at") >= day
    e = events.agg(
        F.count_if(fresh & (F.col("status") == "active")).alias("active_events"),
        F.count_if(fresh & (F.col("severity") >= 70)).alias("critical_events"),
        F.count_distinct(F.when(fresh, F.col("country_code"))).alias("countries_affected"),
        one,
    )
    o = observations.agg(F.count_if(F.col("ingested_at") >= day).alias("observations_24h"), one)
    a = alerts.agg(F.count_if(F.col("acknowledged_at").isNull()).alias("open_alerts"), one)
    s = sources.agg(F.count_if("enabled").alias("total_sources"), one)
    return e.join(o, "one").join(a, "one").join(s, "one").drop("one")


def top_categories(events: DataFrame, now: Column, k: int = 8) -> DataFrame:
    day = now - F.expr("INTERVAL 24 HOURS")
    return events.where(F.col("last_seen_at") >= day).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(k)


def list_alerts(alerts: DataFrame, open_only: bool = False, limit: int = 50) -> DataFrame:
    rows = alerts.where(F.col("acknowledged_at").isNull()) if open_only else alerts
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def graph_nodes(entities: DataFrame, limit: int = 60, since: Column | None = None) -> DataFrame:
    rows = entities if since is None else entities.where(F.col("last_seen_at") >= since)
    return rows.select("id", "name", "kind", "mention_count").orderBy(F.desc("mention_count"), "id").limit(limit)


def graph_edges(edges: DataFrame, nodes: DataFrame, limit: int = 240, min_weight: int = 2) -> DataFrame:
    """Edges between the nodes, strongest association first; NaN association counts as lowest."""
    # The nodes are limited, so they may be broadcast.
    ids = F.broadcast(nodes.select("id"))
    inner = edges.where(F.col("co_occurrences") >= min_weight)
    for side in ("source_entity_id", "target_entity_id"):
        inner = inner.join(ids.withColumnRenamed("id", side), side, "left_semi")
    rank = F.when(~F.isnan("pmi"), F.col("pmi"))
    return inner.orderBy(F.desc_nulls_last(rank), "source_entity_id", "target_entity_id").select("source_entity_id", "target_entity_id", "co_occurrences", "pmi").limit(limit)


def nearest_events(events: DataFrame, target_id: str, k: int = 8) -> DataFrame:
    """The k events whose centroid is most similar to the target's; without centroid none."""
    target = events.where(F.col("id") == target_id).limit(1).select(F.col("centroid").alias("target"), F.col("id").alias("target_id"))
    # One row, by the limit.
    usable = events.where(F.col("centroid").isNotNull() & (F.col("id") != target_id))
    both = usable.join(F.broadcast(target), F.size("centroid") == F.size("target"))
    return both.withColumn("similarity", cosine(F.col("centroid"), F.col("target"))).orderBy(F.desc("similarity"), "id").select("id", "title", "similarity").limit(k)


def members(links: DataFrame, observations: DataFrame, sources: DataFrame, limit: int = 200) -> DataFrame:
    """Newest observations of every event with the name of their source, ``limit`` an event."""
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    joined = links.join(observations, "observation_id").join(named, "source_id", "left")
    newest = Window.partitionBy("event_id").orderBy(F.desc("occurred_at"), "observation_id")
    return joined.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= limit).drop("k")


def top_entities(links: DataFrame, mentions: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """The k most mentioned entities of every event: event_id, entity_id, name, kind, mentions, k."""
    summed = links.join(mentions.where("entity_id is not null"), "observation_id").groupBy("event_id", "entity_id").agg(F.sum("mentions").alias("mentions"))
    named = summed.join(entities.select(F.col("id").alias("entity_id"), "name", "kind"), "entity_id")
    order = Window.partitionBy("event_id").orderBy(F.desc("mentions"), "name", "entity_id")
    return named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("event_id", "entity_id", "name", "kind", "mentions", "k")


def event_cards(listed: DataFrame, top: DataFrame) -> DataFrame:
    """Listed events with their entities as an array, in one plan."""
    arrays = top.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", "name", "kind"))).alias("entities"))
    return listed.join(arrays, "id", "left")


def source_health(runs: DataFrame, now: Column) -> DataFrame:
    """Adds ``health``: failing, never, stale (last success over 2 h ago) or healthy; from
    ``consecutive_failures`` and ``last_success_at``."""
    stale = F.col("last_success_at") < now - F.expr("INTERVAL 2 HOURS")
    return runs.withColumn("health", F.when(F.col("consecutive_failures") > 0, "failing").when(F.col("last_success_at").isNull(), "never").when(stale, "stale").otherwise("healthy")).orderBy("id")


def marker_size(severity: Column) -> Column:
    return 0.16 + 0.62 * F.sqrt(severity / 100)


def wire_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text with ISO timestamps in UTC."""
    return df.select(F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timeZone": "UTC"}).alias("json"))


def event_detail(events: DataFrame, event_id: str, links: DataFrame, observations: DataFrame, sources: DataFrame, mentions: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The event, its newest 200 members, its 25 most mentioned entities and 6 related events; no event, no rows.

    The event's links are few, so they are filtered before any join.
    """
    own = links.where(F.col("event_id") == event_id)
    return {
        "event": events.where(F.col("id") == event_id),
        "members": members(own, observations.withColumnRenamed("id", "observation_id"), sources),
        "entities": top_entities(own, mentions, entities, 25),
        "related": nearest_events(events, event_id, 6),
    }


def is_uuid(text: Column) -> Column:
    return F.lower(text).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def source_short_name(source_id: Column, labels: dict[str, str]) -> Column:
    """Label of the longest of the prefixes that a source id has, else its first part with a capital."""
    out = None
    for prefix in sorted(labels, key=len, reverse=True):
        hit = source_id.startswith(prefix)
        out = F.when(hit, labels[prefix]) if out is None else out.when(hit, labels[prefix])
    rest = F.initcap(F.split(source_id, r"\.")[0])
    return out.otherwise(rest) if out is not None else rest
