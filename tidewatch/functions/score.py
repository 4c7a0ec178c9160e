"""Scores of observations and events as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CATEGORY_WEIGHT, DEFAULT_INTENSITY, PRECISION_CONFIDENCE, half_life_h, lookup
from .time import age_hours


def clamp01(x: Column) -> Column:
    """Within 0 and 1; null, NaN and infinite become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(x + 0.5).cast("int")


# Strength by source, from 0 to 1, over the source's own magnitude scale.
INTENSITY_CURVES: dict[str, Callable[[Column], Column]] = {
    "usgs.quakes": lambda m: (m - 2.5) / 6.5,
    "gdelt.events": lambda m: 0.6 * clamp01((10 - m) / 20) + 0.4 * F.abs(m) / 10,
    "gdacs.alerts": lambda m: (m - 0.5) / 2.5,
    "nws.alerts": lambda m: (m - 0.5) / 3.5,
    "firms.fires": lambda m: F.log10(F.greatest(m, F.lit(1.0)) + 1) / 3.5,
    "nasa.eonet": lambda m: F.lit(0.5),
    "noaa.swpc": lambda m: (m - 0.5) / 4.5,
}


def intensity(source_id: Column, magnitude: Column, curves: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """0 to 1 from a source's own magnitude scale; the default without a magnitude or a curve.

    ``curves`` adds to or replaces the curves of INTENSITY_CURVES.
    """
    m = magnitude.cast("double")
    curve = F.lit(None).cast("double")
    for source, strength in {**INTENSITY_CURVES, **(curves or {})}.items():
        curve = F.when(source_id == source, strength(m)).otherwise(curve)
    return F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")) | curve.isNull(), DEFAULT_INTENSITY).otherwise(clamp01(curve))


def corroboration(n: Column) -> Column:
    """0 for one source, 1 from a hundred."""
    return clamp01(F.log10(F.greatest(F.lit(1.0), n.cast("double"))) / 2)


def severity(category: Column, strength: Column, tone: Column, reports: Column, sources: Column) -> Column:
    """0 to 100: the category's weight times intensity, corroboration and negative tone."""
    negativity = F.when(tone.isNull(), 0.3).otherwise(clamp01(-tone))
    support = corroboration(F.greatest(F.coalesce(reports, F.lit(1)), F.coalesce(sources, F.lit(1))))
    return round_half_up(100 * clamp01(category_weight(category) * (0.6 * strength + 0.25 * support + 0.15 * negativity)))


def confidence(precision: Column, category_confidence: Column, sources: Column) -> Column:
    """0 to 100: precision of the place, certainty of the category and number of sources."""
    place = lookup(precision, PRECISION_CONFIDENCE, PRECISION_CONFIDENCE["unknown"])
    return round_half_up(100 * clamp01(place * (0.5 + 0.5 * category_confidence) * clamp01(0.6 + 0.4 * corroboration(sources))))


def category_weight(category: Column) -> Column:
    """Weight of a category, that of ``other`` if unknown."""
    return lookup(category, CATEGORY_WEIGHT, CATEGORY_WEIGHT["other"])


def observation(source_id: Column, category: Column, category_confidence: Column, magnitude: Column, tone: Column, reports: Column, precision: Column, sources: Column | None = None, curves: dict | None = None) -> Column:
    """struct(severity, confidence) of an observation, or of an event by its peak and number of ``sources``."""
    n = F.lit(1) if sources is None else sources
    return F.struct(severity(category, intensity(source_id, magnitude, curves), tone, reports, n).alias("severity"), confidence(precision, category_confidence, n).alias("confidence"))


def recency(category: Column, seen: Column, now: Column, mode: str = "full") -> Column:
    """Weight that halves every half-life of the category; 1 for times to come."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_hours(seen, now)) / half_life_h(category, mode))


def hotness(severity_: Column, category: Column, seen: Column, now: Column, mode: str = "full") -> Column:
    """Severity times recency."""
    return severity_ * recency(category, seen, now, mode)


def band(severity_: Column) -> Column:
    """critical, serious, elevated or routine."""
    return F.when(severity_ >= 70, "critical").when(severity_ >= 50, "serious").when(severity_ >= 30, "elevated").otherwise("routine")


def level(value: Column, high: int = 70, middle: int = 45) -> Column:
    """High, Moderate or Low."""
    return F.when(value >= high, "High").when(value >= middle, "Moderate").otherwise("Low")


def velocity(recent: Column, total: Column, first_seen: Column, last_seen: Column) -> Column:
    """Recent rate of reports against the rate over the event's life, at most 10; recent is 3 hours."""
    life = F.greatest(age_hours(first_seen, last_seen), F.lit(0.25))
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(10.0), (recent / 3) / (total / life)))


def status(last_seen: Column, velocity_: Column, now: Column) -> Column:
    """closed after 168 h, dormant after 24 h, developing if fresh and accelerating, else active."""
    age = F.abs(age_hours(last_seen, now))
    return F.when(age > 168, "closed").when(age > 24, "dormant").when((velocity_ > 1.3) & (age < 6), "developing").otherwise("active")


def npmi(together: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """Normalised pointwise mutual information within ±1; 0 if a count isn't positive."""
    share = together / total
    value = F.log2(share / ((n_a / total) * (n_b / total))) / -F.log2(share)
    good = (together > 0) & (n_a > 0) & (n_b > 0) & (total > 0)
    return F.when(~good, 0.0).when(share >= 1, F.when((n_a >= total) & (n_b >= total), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def title_score(title: Column, severity_: Column, editorial: Column, synthetic: Column) -> Column:
    """How good a title is for the whole event."""
    n = F.length(title)
    return severity_ + F.when(editorial, 25).otherwise(0) - F.when(synthetic, 20).otherwise(0) + F.when(n.between(40, 140), 10).when(n < 20, -15).otherwise(0)
