"""Entities of texts, their merging, and the co-occurrence graph of a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score, text

# Capitalised words that open sentences or name no entity.
NO_ENTITY = ["the", "this", "that", "these", "those", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DOCUMENT_CHARACTERS = 8000
DECLARED, CONFIRMED, GUESSED = 0.95, 0.85, 0.65


def declared_actors(raw: Column) -> Column:
    """Names of the two actors that a raw record states, longer than a letter."""
    return F.filter(F.array(F.get_json_object(raw, "$.actor1.name"), F.get_json_object(raw, "$.actor2.name")), lambda a: F.length(a) > 1)


def surfaces(column: Column) -> Column:
    """Runs of capitalised words of a text, trimmed of what is no letter or digit."""
    runs = F.regexp_extract_all(F.substring(column, 1, DOCUMENT_CHARACTERS), F.lit(r"\p{Lu}[\p{L}\p{N}'’-]*(?:\s+(?:of\s+|de\s+)?\p{Lu}[\p{L}\p{N}'’-]*)*"), F.lit(0))
    trimmed = F.transform(runs, lambda s: F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(trimmed, lambda s: (F.length(s) >= 3) & ~s.rlike(r"^\d+$") & ~F.lower(s).isin(NO_ENTITY))


def extract_entities(df: DataFrame, key: str, column: str, actors: str | None, known_places: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """key, entity_key, surface, kind, mentions, confidence: declared actors and capitalised names of a text.

    The default where no recognition model is at hand. ``known_places`` (norm) makes a name a place. Mentions of the same key are
    merged: the kind of the most certain one counts; ``limit`` entities a text by mentions times confidence.
    """
    guessed = df.select(key, F.explode(surfaces(F.col(column))).alias("surface"), F.lit("unknown").alias("kind"), F.lit(GUESSED).alias("confidence"))
    if actors:
        guessed = guessed.unionByName(df.select(key, F.explode(actors).alias("surface"), F.lit("organization").alias("kind"), F.lit(DECLARED).alias("confidence")))
    rows = guessed.withColumn("entity_key", text.normalize_key(F.col("surface"))).where("entity_key <> ''")
    if known_places is not None:
        places = known_places.select(F.col("norm").alias("entity_key"), F.lit(True).alias("placed")).distinct()
        rows = rows.join(places, "entity_key", "left").withColumns({"kind": F.when(F.col("placed"), "place").otherwise(F.col("kind")), "confidence": F.when(F.col("placed") & (F.col("confidence") < CONFIRMED), CONFIRMED).otherwise(F.col("confidence"))})
    merged = rows.groupBy(key, "entity_key").agg(
        F.min("surface").alias("surface"), F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.count(F.lit(1)).cast("int").alias("mentions"), F.max("confidence").alias("confidence")
    )
    order = Window.partitionBy(key).orderBy(F.desc(F.col("mentions") * F.col("confidence")), "entity_key")
    return merged.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


def merge_entities(found: DataFrame, seen_at: str) -> DataFrame:
    """entities from mentions: key, kind, name, mention_count, first and last seen."""
    return found.groupBy("entity_key", "kind").agg(
        F.min("surface").alias("name"), F.sum("mentions").alias("mention_count"), F.min(seen_at).alias("first_seen_at"), F.max(seen_at).alias("last_seen_at")
    )


def upsert_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored entities with the new ones added in: counts add up, the earlier name stays."""
    both = stored.select("*", F.lit(0).alias("__o")).unionByName(new.select("*", F.lit(1).alias("__o")))
    return both.groupBy("entity_key", "kind").agg(
        F.min_by("name", "__o").alias("name"), F.sum("mention_count").alias("mention_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def co_occurrence_edges(mentions: DataFrame, observations: DataFrame, since: Column, until: Column, top: int = 8) -> DataFrame:
    """source < target, co_occurrences and npmi of the entities of the observations of a window.

    Only the ``top`` most mentioned entities of an observation are paired, so an observation gives at most
    top * (top - 1) / 2 pairs; every observation counts once.
    """
    inside = observations.where((F.col("occurred_at") >= since) & (F.col("occurred_at") < until)).select(F.col("id").alias("observation_id")).distinct()
    merged = mentions.where("entity_id is not null").groupBy("observation_id", "entity_id").agg(F.max("mentions").alias("mentions"))
    order = Window.partitionBy("observation_id").orderBy(F.desc("mentions"), "entity_id")
    best = merged.join(inside, "observation_id", "left_semi").withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    lists = best.groupBy("observation_id").agg(F.sort_array(F.collect_list("entity_id")).alias("ids"))
    single = lists.select(F.explode("ids").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.lit(top)), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    counted = lists.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count(F.lit(1)).alias("co_occurrences"))
    total = lists.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("one"))
    side = lambda name: single.select(F.col("e").alias(name), F.col("n").alias(f"n_{name}"))
    joined = counted.join(side("source"), "source").join(side("target"), "target").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    return joined.select("source", "target", "co_occurrences", score.npmi(F.col("co_occurrences"), F.col("n_source"), F.col("n_target"), F.col("total")).alias("npmi"))
