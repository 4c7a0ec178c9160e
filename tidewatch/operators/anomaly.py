"""Unusual hourly volume against the history of the same category and grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import round_half_up
from ..functions.time import floor_to
from ..model import ANOMALY_MIN_OBSERVED, ANOMALY_MIN_SAMPLES, ANOMALY_MIN_Z

KEYS = ["category", "grid_cell"]


def hourly_volume(observations: DataFrame, until: Column | None = None) -> DataFrame:
    """category, grid_cell, bucket, observed, max_severity of complete hours with a cell."""
    rows = observations.where("grid_cell is not null and category is not null")
    if until is not None:
        rows = rows.where(F.col("occurred_at") < floor_to(until, 60))
    return rows.groupBy(*KEYS, floor_to(F.col("occurred_at"), 60).alias("bucket")).agg(F.count(F.lit(1)).alias("observed"), F.max("severity").cast("int").alias("max_severity"))


def fill_gaps(volume: DataFrame) -> DataFrame:
    """Hours without observations between a key's first and last hour as zeros."""
    ends = volume.groupBy(*KEYS).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    spine = ends.select(*KEYS, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("bucket"))
    return spine.join(volume, [*KEYS, "bucket"], "left").na.fill(0, ["observed"])


def z_scores(volume: DataFrame) -> DataFrame:
    """Adds the prior distribution of every hour (prior_n, prior_mean, prior_sd), the mean after it and z.

    The prior leaves the hour itself out; z is 0 where the prior has fewer than two hours or no spread.
    """
    before = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    out = volume.select(
        "*",
        F.count("observed").over(before).alias("prior_n"),
        F.avg("observed").over(before).alias("prior_mean"),
        F.coalesce(F.stddev_samp("observed").over(before), F.lit(0.0)).alias("prior_sd"),
        F.avg("observed").over(upto).alias("expected"),
    )
    return out.withColumn("z", F.when(F.col("prior_sd") > 0, (F.col("observed") - F.col("prior_mean")) / F.col("prior_sd")).otherwise(0.0))


def signals(scored: DataFrame, min_z: float = ANOMALY_MIN_Z, min_observed: int = ANOMALY_MIN_OBSERVED, min_samples: int = ANOMALY_MIN_SAMPLES) -> DataFrame:
    """Hours that are unusual, with severity, key, title and detail."""
    hits = scored.where((F.col("prior_n") >= min_samples) & (F.col("z") >= min_z) & (F.col("observed") >= min_observed))
    hour = F.date_format("bucket", "yyyy-MM-dd'T'HH:00:00.000'Z'")
    label = F.regexp_replace("category", "_", " ")
    times = F.when(F.col("expected") > 0, F.format_string("%.1f×", F.col("observed") / F.col("expected"))).otherwise("∞")
    return hits.select(
        F.concat_ws(":", F.lit("volume_spike"), "category", "grid_cell", hour).alias("dedup_key"),
        *KEYS, "bucket", "observed", "expected", "prior_mean", "z",
        round_half_up(F.least(F.lit(100.0), 45 + 55 * (1 - F.exp(-(F.col("z") - 3) / 4)))).alias("severity"),
        F.concat(F.lit("Unusual "), label, F.lit(" volume")).alias("title"),
        F.concat(F.col("observed").cast("string"), F.lit(" reports against "), F.format_string("%.1f", "expected"), F.lit(" expected ("), times, F.lit(")")).alias("detail"),
    )


def new_alerts(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Signals whose key has no alert yet, each once."""
    return found.dropDuplicates(["dedup_key"]).join(existing.select("dedup_key"), "dedup_key", "left_anti")


def baselines_after(volume: DataFrame) -> DataFrame:
    """Welford state (sample_count, mean, m2) and last bucket of every key."""
    return volume.groupBy(*KEYS).agg(
        F.count("observed").alias("sample_count"), F.avg("observed").alias("mean"), (F.var_pop("observed") * F.count("observed")).alias("m2"), F.max("bucket").alias("last_bucket_at")
    )


def merge_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parallel combination of two states; keys of either side."""
    side = lambda df, s: df.select(*KEYS, *[F.col(c).alias(f"{c}_{s}") for c in ("sample_count", "mean", "m2", "last_bucket_at")])
    both = side(old, "a").join(side(new, "b"), KEYS, "full_outer").na.fill(0, [f"{c}_{s}" for c in ("sample_count", "mean", "m2") for s in "ab"])
    n, delta = F.col("sample_count_a") + F.col("sample_count_b"), F.col("mean_b") - F.col("mean_a")
    return both.select(
        *KEYS,
        n.alias("sample_count"),
        ((F.col("mean_a") * F.col("sample_count_a") + F.col("mean_b") * F.col("sample_count_b")) / n).alias("mean"),
        (F.col("m2_a") + F.col("m2_b") + delta * delta * F.col("sample_count_a") * F.col("sample_count_b") / n).alias("m2"),
        F.greatest("last_bucket_at_a", "last_bucket_at_b").alias("last_bucket_at"),
    )
