"""The store between the stages of the pipeline: pending rows, stage marks, and what is written when a row exists already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages of an observation: as it came in, enriched, assigned to an event.
INGESTED, ENRICHED, ASSIGNED = 0, 1, 2
#: Rows that a cycle takes from either backlog.
ENRICH_BATCH, ASSIGN_BATCH = 200, 150


def at_stage(observations: DataFrame, stage: int) -> DataFrame:
    """Rows that wait at a stage; a null stage counts as ingested."""
    return observations.where(F.coalesce("pipeline_stage", F.lit(INGESTED)) == stage)


def pending(observations: DataFrame, stage: int, limit: int | None = None) -> DataFrame:
    """The next rows of a backlog: to enrich by time of ingestion, to assign by time of the event; ties by id."""
    order, most = ("ingested_at", ENRICH_BATCH) if stage == INGESTED else ("occurred_at", ASSIGN_BATCH)
    return at_stage(observations, stage).orderBy(F.asc_nulls_last(order), "id").limit(limit or most)


def backlog(observations: DataFrame, stage: int = INGESTED) -> DataFrame:
    """``n``: how many rows wait."""
    return at_stage(observations, stage).agg(F.count(F.lit(1)).alias("n"))


def mark(observations: DataFrame, done: DataFrame, stage: int) -> DataFrame:
    """All observations, those of ``done`` (id) at ``stage``; a stage is never lowered."""
    reached = done.select("id", F.lit(stage).alias("__stage")).distinct()
    now = F.greatest(F.coalesce("pipeline_stage", F.lit(INGESTED)), F.coalesce("__stage", F.lit(INGESTED))).cast("smallint")
    return observations.join(reached, "id", "left").withColumn("pipeline_stage", now).drop("__stage")


def apply_enrichment(observations: DataFrame, enriched: DataFrame) -> DataFrame:
    """Observations with the columns of ``enriched`` (id and what it fills) in place of their own, at the enriched stage."""
    names = [c for c in enriched.columns if c != "id" and c in observations.columns]
    new = enriched.select("id", F.struct(*names).alias("__new")).dropDuplicates(["id"])
    joined = observations.join(new, "id", "left")
    kind = {f.name: f.dataType for f in observations.schema.fields}
    filled = joined.withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}").cast(kind[c])).otherwise(F.col(c)) for c in names})
    return mark(filled.drop("__new"), enriched, ENRICHED)


def insert_ignore(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and those new ones whose key isn't stored; of new rows with one key the first by all columns."""
    fresh = new.select(*stored.columns).groupBy(*key).agg(F.min(F.struct(*[c for c in stored.columns if c not in key])).alias("__r")) if set(stored.columns) - set(key) else new.select(*key).distinct()
    if "__r" in fresh.columns:
        fresh = fresh.select(*key, "__r.*")
    return stored.unionByName(fresh.join(stored.select(*key), key, "left_anti").select(*stored.columns))


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with a window's edges merged in: counts add up, association and time are those of the window.

    Both have source_entity_id, target_entity_id, co_occurrences, pmi and last_seen_at; each pair comes out once, smaller id first. Of
    several stored rows of a pair the counts add up and the latest association stays. Edges with a null end are dropped.
    """
    a, b = F.col("source_entity_id"), F.col("target_entity_id")
    side = lambda df, new_: df.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("s"), F.greatest(a, b).alias("t"), "co_occurrences", "pmi", "last_seen_at", F.lit(new_).alias("new"))
    both = side(stored, 0).unionByName(side(new, 1))
    latest = F.max_by(F.struct("pmi", "last_seen_at"), F.struct("new", "last_seen_at", "pmi")).alias("l")
    return both.groupBy("s", "t").agg(F.sum("co_occurrences").alias("co_occurrences"), latest).select(F.col("s").alias("source_entity_id"), F.col("t").alias("target_entity_id"), "co_occurrences", "l.pmi", "l.last_seen_at")


def rederive(observations: DataFrame, derived: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """The observations as ingested and every derived table made from them anew; nothing of the old ones is read."""
    reset = observations.withColumn("pipeline_stage", F.lit(INGESTED).cast("smallint"))
    return {"observations": reset, **{name: make(reset) for name, make in derived.items()}}


def events_of_impacts(impacts: DataFrame, events: DataFrame) -> DataFrame:
    """Impacts (id) with the row of their event, by an equi join; impacts without an event are left out."""
    return impacts.withColumnRenamed("id", "event_id").join(events.withColumnRenamed("id", "event_id"), "event_id")


def is_category(value: Column, categories: list[str]) -> Column:
    """Whether a text is one of the closed vocabulary; false for null."""
    return F.coalesce(value.isin(categories), F.lit(False))
