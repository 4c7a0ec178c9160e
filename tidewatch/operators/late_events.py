"""Per-period aggregates by event time, corrected as late records arrive.

The state of a key is ordered: per period the count, and along the periods a running count,
the latest period and a Welford accumulator of the counts. The on-time records give one state
per key, of which a *checkpoint* is kept every ``checkpoint_periods`` periods. Late records that
are still within the cut-off touch a key from their earliest period on: the preceding
checkpoint is restored, the sorted suffix (on-time and late periods together) is replayed, and
the replayed outputs replace the ones from the on-time pass. Keys without late records, and
the periods before the checkpoint, keep their outputs untouched.

Everything is a DataFrame plan. Records are aggregated to (key, period) before any window, so
the work on a hot key is bounded by the number of its periods, not of its records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

US = 1_000_000
HOUR_US = 3600 * US


@dataclass(frozen=True)
class Lateness:
    """When a record counts: periods of ``period_us``, accepted until ``cutoff_us`` after their end."""

    period_us: int = HOUR_US
    cutoff_us: int = 24 * HOUR_US
    checkpoint_periods: int = 24


def first_deliveries(df: DataFrame, identity: list[str], arrival: str) -> DataFrame:
    """One row per identity, the earliest delivery; ties are broken by the row's other values.

    Rows with a null in the identity can't be told to be repeats and are all kept; rows with
    a null arrival count as delivered last.
    """
    complete = df.dropna(subset=identity)
    rest = df.where(" or ".join(f"`{c}` is null" for c in identity))
    others = [c for c in df.columns if c not in identity]
    order = F.struct(F.col(arrival).isNull(), F.col(arrival), *[F.col(c) for c in sorted(others) if c != arrival])
    first = complete.groupBy(*identity).agg(F.min_by(F.struct(*others), order).alias("__first"))
    return first.select(*identity, "__first.*").select(*df.columns).unionByName(rest)


def period_of(at: Column, lateness: Lateness) -> Column:
    """Start of the period in microseconds since 1970-01-01 UTC."""
    us = F.unix_micros(at)
    return us - F.pmod(us, F.lit(lateness.period_us))


def period_counts(df: DataFrame, keys: list[str], event_time: str, arrival: str, lateness: Lateness) -> DataFrame:
    """keys, ``period`` and the counts ``on_time``, ``late``, ``rejected`` of its records.

    On time: arrived before the period's end. Late: at most ``cutoff_us`` after it. Rejected:
    later still, or with no arrival. Rows with a null key or event time count nowhere.
    """
    usable = df.dropna(subset=[*keys, event_time])
    end = F.col("period") + lateness.period_us
    arrived = F.unix_micros(F.col("__arrival"))
    return (
        usable.select(*keys, period_of(F.col(event_time), lateness).alias("period"), F.col(arrival).alias("__arrival"))
        .groupBy(*keys, "period")
        .agg(
            F.count_if(arrived < end).alias("on_time"),
            F.count_if((arrived >= end) & (arrived <= end + lateness.cutoff_us)).alias("late"),
            F.count_if(arrived.isNull() | (arrived > end + lateness.cutoff_us)).alias("rejected"),
        )
    )


#: What is kept of a key: number of periods, records, sum of squared counts, latest period.
STATE = ["n_periods", "running", "sum_sq", "last_period"]


def replay(counts: DataFrame, keys: list[str], value: str, restored: list[str] | None) -> DataFrame:
    """The state after each period, in order, starting from the restored one (or from nothing)."""
    along = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    start = {c: F.coalesce(F.col(r), F.lit(0)) for c, r in zip(STATE, restored)} if restored else {c: F.lit(0) for c in STATE}
    v = F.col(value)
    return counts.select(
        *keys,
        "period",
        v.alias("count"),
        (start["n_periods"] + F.count(F.lit(1)).over(along)).cast("bigint").alias("n_periods"),
        (start["running"] + F.sum(v).over(along)).cast("bigint").alias("running"),
        (start["sum_sq"] + F.sum(v * v).over(along)).cast("bigint").alias("sum_sq"),
        F.col("period").alias("last_period"),
    )


def corrected_periods(counts: DataFrame, keys: list[str], lateness: Lateness) -> DataFrame:
    """The state after every period with an accepted record, late ones included.

    Columns: keys, ``period``, ``count``, ``n_periods``, ``running``, ``sum_sq``,
    ``last_period`` and ``replayed`` (whether the output replaces one of the on-time pass). The counts, which are
    small against the records, are materialised: the passes look at them several times.
    """
    counts = cut_lineage(counts)
    step = lateness.period_us * lateness.checkpoint_periods
    block = F.floor(F.col("period") / step).cast("bigint")
    seen = counts.where("on_time + late > 0").withColumn("block", block)

    on_time = seen.where("on_time > 0")
    first_pass = replay(on_time, keys, "on_time", None).withColumn("block", block)
    checkpoints = first_pass.groupBy(*keys, "block").agg(F.max_by(F.struct(*STATE), "period").alias("state"))

    dirty = seen.where("late > 0").groupBy(*keys).agg(F.min("block").alias("from_block"))
    kept = first_pass.join(dirty, keys, "left").where("from_block is null or block < from_block")
    restored = (
        checkpoints.join(dirty, keys)
        .where("block < from_block")
        .groupBy(*keys)
        .agg(F.max_by("state", "block").alias("state"))
        .select(*keys, *[F.col(f"state.{c}").alias(f"r_{c}") for c in STATE])
    )
    suffix = seen.join(dirty, keys).where("block >= from_block").withColumn("accepted", F.col("on_time") + F.col("late"))
    replayed = replay(suffix.join(restored, keys, "left"), keys, "accepted", [f"r_{c}" for c in STATE])
    out = [*keys, "period", "count", *STATE]
    return kept.select(*out, F.lit(False).alias("replayed")).unionByName(replayed.select(*out, F.lit(True).alias("replayed")))


def hourly_counts(observations: DataFrame, lateness: Lateness = Lateness()) -> DataFrame:
    """Corrected hourly counts of observations by (category, grid_cell)."""
    slim = observations.select("source_id", "external_id", "occurred_at", "ingested_at", "category", "grid_cell")
    once = first_deliveries(slim, ["source_id", "external_id"], "ingested_at")
    return corrected_periods(period_counts(once, ["category", "grid_cell"], "occurred_at", "ingested_at", lateness), ["category", "grid_cell"], lateness)


def stale_records(observations: DataFrame, alerts: DataFrame, baselines: DataFrame, lateness: Lateness = Lateness()) -> DataFrame:
    """(record_kind, record_id) of alerts and baselines that the corrected counts contradict.

    An alert is stale if ``observed`` is not the count of its hour (0 if there is none; a null
    ``observed`` is stale too); a baseline if ``last_bucket_at`` is not the latest hour with an
    accepted record in the 28 days from ``period_start``. Repeated rows come out once.
    """
    keys = ["category", "grid_cell"]
    # Hours of the same key and day range as an alert or baseline are the only ones of use.
    hours = cut_lineage(hourly_counts(observations, lateness).select(*keys, "period", "count"))
    asked = alerts.select("id", *keys, F.unix_micros("bucket_at").alias("period"), "observed").distinct()
    alert = (
        asked.join(hours, [*keys, "period"], "left")
        .where(~F.col("observed").eqNullSafe(F.coalesce(F.col("count"), F.lit(0))))
        .select(F.lit("alerts").alias("record_kind"), F.col("id").alias("record_id"))
        .distinct()
    )
    span = 28 * 24 * HOUR_US
    asked = baselines.select(*keys, F.unix_micros("period_start").alias("start"), F.date_format("period_start", "yyyy-MM-dd").alias("day"), F.unix_micros("last_bucket_at").alias("last")).distinct()
    first = F.floor(F.col("start") / span)
    asked = asked.withColumn("part", F.explode(F.array_distinct(F.array(first, first + 1))))
    parts = hours.withColumn("part", F.floor(F.col("period") / span))
    inside = (F.col("period") >= F.col("start")) & (F.col("period") < F.col("start") + span)
    latest = (
        asked.join(parts.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("period")).alias("periods")), [*keys, "part"], "left")
        .withColumn("period", F.array_max(F.filter("periods", lambda p: (p >= F.col("start")) & (p < F.col("start") + span))))
        .groupBy(*keys, "start", "day", "last")
        .agg(F.max(F.when(inside, F.col("period"))).alias("latest"))
    )
    baseline = latest.where(~F.col("last").eqNullSafe(F.col("latest"))).select(
        F.lit("baselines").alias("record_kind"),
        F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("grid_cell", F.lit("")), "day").alias("record_id"),
    )
    return alert.unionByName(baseline.distinct())
