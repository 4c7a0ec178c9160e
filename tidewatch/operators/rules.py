"""Exposures of events by a table of rules that the caller supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import round_half_up

RULES = "rule int, categories array<string>, keywords string, exposure string, label string, channel string, base double, specificity double"
#: Rules that a table may have; it is configuration and is broadcast.
MAX_RULES = 10_000
MIN_MATERIALITY, MIN_CONFIDENCE = 30, 20


def exposures(events: DataFrame, rules: DataFrame) -> DataFrame:
    """id, exposure, label, channel, materiality, confidence of the rules that events match.

    A rule matches by category and, if it has ``keywords``, by that pattern in title or summary. Of several rules for one exposure the most
    material counts, the earlier one on a tie. Weak exposures are left out.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    flat = rules.select("*", F.explode("categories").alias("category")).drop("categories")
    rows = events.select("id", "category", F.concat_ws(" ", "title", "summary").alias("__text"), F.col("severity").alias("s"), F.col("confidence").alias("c"), F.col("velocity").alias("v"))
    strength = F.least(F.lit(1.0), 0.3 + F.col("s") / 250 + F.col("c") / 500 + F.least(F.lit(2.0), "v") / 20)
    matched = rows.join(F.broadcast(flat), "category").where(F.col("keywords").isNull() | F.expr("__text rlike keywords"))
    clamp = lambda x: round_half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)))
    scored = matched.select("id", "rule", "exposure", "label", "channel", clamp(F.col("base") * strength).alias("materiality"), clamp(F.col("c") * F.col("specificity")).alias("confidence"))
    best = Window.partitionBy("id", "exposure").orderBy(F.desc("materiality"), "rule")
    kept = scored.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "rule")
    return kept.where((F.col("materiality") >= MIN_MATERIALITY) & (F.col("confidence") >= MIN_CONFIDENCE))


def impacts(found: DataFrame) -> DataFrame:
    """id, materiality (largest), confidence (rounded mean) and the exposures, strongest first."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("materiality")).alias("m"), (-F.col("confidence")).alias("c"), "exposure", "label", "channel")))
    return found.groupBy("id").agg(F.max("materiality").alias("materiality"), round_half_up(F.avg("confidence")).alias("confidence"), listed.alias("exposures"))


def channel_counts(found: DataFrame, channels: list[str]) -> DataFrame:
    """Events with an exposure in each channel, channels without any included."""
    spine = found.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    return spine.join(found.groupBy("channel").agg(F.count_distinct("id").alias("n")), "channel", "left").na.fill(0, ["n"])


def by_channel(impact: DataFrame, channel: str, min_confidence: int = 0) -> DataFrame:
    """Impacts with at least one exposure in the channel."""
    return impact.where(F.exists("exposures", lambda e: e["channel"] == channel) & (F.col("confidence") >= min_confidence))
