"""Vocabularies, constants and schemas of the observation and event model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies.
CATEGORIES = (
    "armed_conflict civil_unrest terrorism political diplomacy natural_disaster severe_weather wildfire seismic "
    "health humanitarian cyber economy infrastructure maritime aviation space other"
).split()
GROUPS = {
    "governance": ["political", "diplomacy", "economy"],
    "security": ["armed_conflict", "terrorism", "civil_unrest", "cyber"],
    "human": ["humanitarian", "health"],
    "domain": ["infrastructure", "maritime", "aviation", "space", "other"],
    "hazard": ["seismic", "severe_weather", "wildfire", "natural_disaster"],
}
PRECISIONS = ["exact", "city", "admin1", "country", "unknown"]
STATUSES = ["active", "developing", "dormant", "closed"]

# The constants of scoring and matching.
CATEGORY_WEIGHT = {
    "terrorism": 1.0, "armed_conflict": 0.95, "natural_disaster": 0.9, "seismic": 0.85, "civil_unrest": 0.8, "humanitarian": 0.8, "severe_weather": 0.75, "wildfire": 0.75, "health": 0.75,
    "cyber": 0.7, "infrastructure": 0.65, "political": 0.6, "economy": 0.6, "maritime": 0.55, "aviation": 0.55, "diplomacy": 0.5, "space": 0.4, "other": 0.35,
}
PRECISION_CONFIDENCE = {"exact": 1.0, "city": 0.92, "admin1": 0.75, "country": 0.55, "unknown": 0.3}
PRECISION_RADIUS_KM = {"exact": 5.0, "city": 25.0, "admin1": 150.0, "country": 600.0, "unknown": 2000.0}
MEMBER_WEIGHT = {"exact": 8.0, "city": 4.0, "admin1": 2.0, "country": 1.0, "unknown": 0.5}
HALF_LIFE_H = {
    "seismic": 48.0, "severe_weather": 24.0, "wildfire": 72.0, "cyber": 48.0, "natural_disaster": 96.0, "armed_conflict": 96.0, "terrorism": 96.0, "humanitarian": 168.0, "health": 168.0, "economy": 120.0,
}
DEFAULT_HALF_LIFE_H = 36.0
#: Categories whose half-life the stored ranking knows; the others fall to the default there.
STORED_HALF_LIVES = ["seismic", "severe_weather", "wildfire", "cyber", "armed_conflict", "humanitarian", "health", "economy"]
DEFAULT_INTENSITY = 0.4
EARTH_RADIUS_KM = 6371.0088
GRID_DEGREES = 5
MATCH_COSINE, MATCH_MAX_GAP_H, MATCH_FREE_H, MATCH_TIME_DECAY, MATCH_OTHER_CATEGORY = 0.52, 72.0, 6.0, 0.45, 0.8
ANOMALY_MIN_SAMPLES, ANOMALY_MIN_Z, ANOMALY_MIN_OBSERVED = 12, 3.0, 4

# Event root codes with their labels and categories.
EVENT_ROOTS = {
    "01": ("Make public statement", "political"), "02": ("Appeal", "diplomacy"), "03": ("Express intent to cooperate", "diplomacy"), "04": ("Consult", "diplomacy"),
    "05": ("Engage in diplomatic cooperation", "diplomacy"), "06": ("Engage in material cooperation", "diplomacy"), "07": ("Provide aid", "humanitarian"), "08": ("Yield", "political"),
    "09": ("Investigate", "political"), "10": ("Demand", "political"), "11": ("Disapprove", "political"), "12": ("Reject", "political"), "13": ("Threaten", "political"),
    "14": ("Protest", "civil_unrest"), "15": ("Exhibit force posture", "armed_conflict"), "16": ("Reduce relations", "diplomacy"), "17": ("Coerce", "civil_unrest"),
    "18": ("Assault", "armed_conflict"), "19": ("Fight", "armed_conflict"), "20": ("Use unconventional mass violence", "terrorism"),
}
QUAD_CLASS = {1: "verbal_cooperation", 2: "material_cooperation", 3: "verbal_conflict", 4: "material_conflict"}

# Weighted terms of the lexical classifier.
LEXICON = {
    "armed_conflict": {"airstrike": 3.0, "air strike": 3.0, "shelling": 3.0, "artillery": 2.5, "offensive": 1.5, "ceasefire": 2.0, "troops": 1.5, "military": 1.0, "combat": 2.0, "insurgent": 2.0, "militant": 2.0, "drone strike": 3.0, "missile": 2.5, "war": 1.5},
    "civil_unrest": {"protest": 3.0, "demonstration": 2.5, "riot": 3.0, "strike action": 2.0, "unrest": 2.5, "clashes": 2.0, "crackdown": 2.0, "curfew": 2.0, "rally": 1.5},
    "terrorism": {"terrorist": 3.0, "suicide bomb": 3.5, "car bomb": 3.0, "ied": 2.5, "hostage": 2.0, "claimed responsibility": 2.5},
    "seismic": {"earthquake": 3.5, "magnitude": 2.5, "aftershock": 3.0, "tremor": 2.5, "epicenter": 3.0, "tsunami": 3.0, "volcan": 2.5},
    "severe_weather": {"hurricane": 3.0, "typhoon": 3.0, "cyclone": 3.0, "tornado": 3.0, "flood": 2.5, "blizzard": 2.5, "heatwave": 2.5, "heat wave": 2.5, "drought": 2.0, "storm surge": 3.0},
    "wildfire": {"wildfire": 3.5, "bushfire": 3.5, "forest fire": 3.0, "hectares burned": 3.0, "evacuation order": 1.5},
    "health": {"outbreak": 3.0, "epidemic": 3.0, "pandemic": 3.0, "cholera": 3.0, "measles": 3.0, "ebola": 3.5, "infection": 1.5, "vaccine": 1.5, "quarantine": 2.0},
    "cyber": {"ransomware": 3.5, "data breach": 3.0, "cyberattack": 3.5, "cyber attack": 3.5, "hacked": 2.5, "zero-day": 3.0, "ddos": 3.0, "malware": 3.0},
    "economy": {"inflation": 2.5, "recession": 3.0, "central bank": 2.0, "interest rate": 2.5, "sanctions": 2.0, "tariff": 2.5, "default on debt": 3.0, "stock market": 2.0},
    "infrastructure": {"power outage": 3.0, "blackout": 3.0, "pipeline": 2.0, "grid failure": 3.0, "bridge collapse": 3.0, "water supply": 2.0, "railway": 1.5},
    "maritime": {"vessel": 2.0, "tanker": 2.5, "shipping lane": 2.5, "piracy": 3.0, "strait": 1.5, "port closure": 2.5},
    "aviation": {"airspace": 2.5, "airport closed": 3.0, "flight diverted": 2.5, "plane crash": 3.5, "no-fly zone": 3.0},
    "humanitarian": {"refugee": 3.0, "displaced": 2.5, "famine": 3.5, "humanitarian": 2.5, "aid convoy": 3.0, "malnutrition": 3.0},
    "space": {"satellite launch": 3.0, "orbit": 2.0, "spacecraft": 2.5, "solar flare": 3.0, "geomagnetic storm": 3.0},
    "natural_disaster": {"landslide": 3.0, "avalanche": 3.0, "sinkhole": 2.5, "disaster declaration": 2.5},
    "diplomacy": {"summit": 2.0, "treaty": 2.5, "ambassador": 2.5, "negotiations": 2.0, "united nations": 1.5},
    "political": {"election": 2.5, "parliament": 2.0, "impeachment": 3.0, "coup": 3.5, "referendum": 2.5, "resigned": 2.0},
}


def lexicon_rows() -> list[tuple[str, str, float]]:
    """(category, term, weight) of the lexicon."""
    return [(category, term, weight) for category, terms in LEXICON.items() for term, weight in terms.items()]


def lookup(column: Column, table: dict, default=None) -> Column:
    """CASE over a small table; a null key gives the default."""
    out = None
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def group_of(category: Column) -> Column:
    """Display group of a category; unknown ones belong to ``domain``."""
    return lookup(category, {c: g for g, members in GROUPS.items() for c in members}, "domain")


def half_life_h(category: Column, mode: str = "full") -> Column:
    """Hours in which a score halves; ``stored`` knows only the categories of the stored ranking."""
    table = HALF_LIFE_H if mode == "full" else {c: HALF_LIFE_H[c] for c in STORED_HALF_LIVES}
    return lookup(category, table, DEFAULT_HALF_LIFE_H)
