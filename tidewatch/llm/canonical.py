"""Mapping of typed values to the entries of a canonical list.

Distinct values are normalised (accents, case, joined and reordered words, abbreviated qualifiers, words
that only describe a place, the country) and looked up in an inverted index of character n-grams
over the names of the list. The score is the cosine of the n-gram vectors weighted by inverse
document frequency; a value is accepted if its best name scores above a threshold, ahead of the next name by a margin,
and the edits between their words, each with the one it fits best, confirm it. Entries that share a name are told apart by the country.

Only n-grams that matter are looked up and listed: those of a name, rarest first, until what is left of the two names can't
reach the threshold (prefix filter on both sides), so no candidate above the threshold is lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, parallelism
from .names_text import edits, fold, grams, split_joined

THRESHOLD = 0.20
MARGIN = 0.05
#: Edits that a name may differ by; one in names of up to SHORT letters.
MOST_EDITS = 2
SHORT = 5
#: Countries that the list may name; more would make the parser's table unbounded.
MAX_COUNTRIES = 1_000
#: Pairs that one slice of a gram's list is joined to.
SLICE = 1_000_000

# Abbreviations of the qualifiers of place names.
QUALIFIERS = {
    "n": "north", "nth": "north", "no": "north", "sth": "south", "so": "south", "e": "east", "w": "west", "st": "saint", "ste": "saint", "mt": "mount", "mnt": "mount",
    "pt": "port", "prt": "port", "ft": "fort", "frt": "fort", "lk": "lake", "upr": "upper", "up": "upper", "lwr": "lower", "low": "lower", "nw": "new", "vly": "valley", "vall": "valley", "hts": "heights",
    "hgts": "heights", "jct": "junction", "jctn": "junction", "junc": "junction", "spgs": "springs", "sprs": "springs", "spr": "springs", "fls": "falls", "xing": "crossing", "crsg": "crossing", "cross": "crossing",
    "hbr": "harbour", "harb": "harbour", "hrbr": "harbour", "harbor": "harbour", "by": "bay",
}
# What people write around a place name.
_AROUND = re.compile(
    r"^(?:\d+(?:\.\d+)? ?(?:km|mi|miles|kilometers|kilometres) (?:[nsew]{1,3}|north|south|east|west)? ?(?:of|from) "
    r"|(?:near|around|outside|in|at|close to|outskirts of|suburbs of|city of|town of|village of|municipality of|district of|region of|area of|greater|central|downtown|the) )+"
)
_AFTER = re.compile(r"(?: (?:city centre|city center|centre|center|metro area|metropolitan area|metro|municipality|district|region|province|area|city|town|outskirts|suburbs))+$")


def parse_place(value: str, countries: dict[str, str]) -> tuple[list[str], str | None]:
    """(normalised names, country code named in the value or None); ([], code) for a country alone.

    There are two names where an abbreviation has two readings ("S." is South or Saint).

    ``countries`` has code and folded lower-case name, both to code.
    """
    text = split_joined(fold(value)).strip()
    text = re.sub(r"[()\[\]]", ",", text)
    country, parts = None, []
    for part in re.split(r"[,;/|]| - ", text):
        part = re.sub(r"[^\w' ]+", " ", part).replace("_", " ").lower()
        part = re.sub(r"'s\b|'", "", part)
        part = " ".join(part.split())
        if not part:
            continue
        if part in countries:
            country = country or countries[part]
        else:
            parts.append(part)
    name = _AFTER.sub("", _AROUND.sub("", " ".join(parts) + " ").strip())
    if name in countries:
        return [], country or countries[name]
    words = name.split()
    if len(words) > 1:
        words = [QUALIFIERS.get(w, w) for w in words]
    readings = [["south" if w == "s" else w for w in words], ["saint" if w == "s" else w for w in words]]
    return list(dict.fromkeys(" ".join(sorted(r)) for r in readings if r)), country


def name_edits(a: str, b: str, most: int) -> int:
    """Edits between two names, their words in any order; more than ``most`` counts as most + 1."""
    least = edits(a, b, most)
    mine, others = Counter(a.split()), Counter(b.split())
    # Equal words belong together. Each of the rest costs an edit at least, so there are few.
    left, right = list((mine - others).elements()), list((others - mine).elements())
    if least <= 1 or len(left) != len(right) or len(left) > most:
        return least
    return min(least, *(min(most + 1, sum(edits(x, y, most) for x, y in zip(left, order))) for order in permutations(right)))


def _name_table(entries: DataFrame) -> DataFrame:
    """``name`` (normalised), ``id`` and ``country`` of every name of every entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [parse_place(n, {})[0] for n in batch["name"]]
            yield batch.assign(name=[n[0] if n else "" for n in names])

    one = entries.select("geoname_id", "country_code", F.explode(F.concat(F.array("name", "asciiname"), F.coalesce(F.split("alternatenames", ","), F.array()))).alias("name"))
    usable = one.where("geoname_id is not null and trim(name) <> ''").select("name", F.col("geoname_id").alias("id"), F.col("country_code").alias("country"))
    return usable.mapInPandas(run, "name string, id bigint, country string").where("name <> ''").distinct()


def _weighted(names: DataFrame, weights: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Unit vectors (name, gram, w) of names, and the weights of the grams (gram, idf)."""
    split = F.pandas_udf(lambda column: column.map(grams), "array<string>")
    rows = names.select("name", F.explode(split("name")).alias("gram"))
    if weights is None:
        total = names.count()
        weights = rows.groupBy("gram").agg(F.log(1 + F.lit(max(1, total)) / F.count(F.lit(1))).alias("idf"))
        weights = cut_lineage(weights)
    # A gram that no entry has weighs as much as the rarest.
    rarest = weights.agg(F.max("idf")).first()[0] or 1.0
    weighed = rows.join(weights, "gram", "left").withColumn("idf", F.coalesce("idf", F.lit(rarest)))
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("name")))
    return weighed.select("name", "gram", (F.col("idf") / norm).alias("w")), weights


def map_places(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(value, country_code, geoname_id, score) of every distinct value; geoname_id 0 for unmatched.

    ``values`` has ``value`` and ``country_code`` (may be null), ``entries`` the columns of the list of
    places. Values that are null or blank are left out. A value that names only a country, no entry,
    or several entries that its country doesn't tell apart, is unmatched. Equal scores of different names
    are within any margin, so unmatched too. An empty list leaves every value unmatched.
    """
    rows = entries.where("country_code is not null").groupBy("country_code").agg(F.min("country_name").alias("n")).limit(MAX_COUNTRIES + 1).collect()
    if len(rows) > MAX_COUNTRIES:
        raise ValueError(f"more than {MAX_COUNTRIES} countries")
    countries = {r[0].lower(): r[0] for r in rows} | {" ".join(fold(r[1]).lower().split()): r[0] for r in rows if r[1]}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_place(v, countries) for v in batch["value"]]
            yield batch.assign(names=[p[0] for p in parsed], said=[p[1] for p in parsed])

    distinct = values.select("value", "country_code").where(F.col("value").rlike(r"(?U)\S")).distinct()
    parsed = distinct.mapInPandas(parse, "value string, country_code string, names array<string>, said string")
    parsed = cut_lineage(parsed.select("value", "country_code", "names", F.coalesce("said", "country_code").alias("country")))
    names = cut_lineage(_name_table(entries))
    listed = names.groupBy("name").agg(F.collect_set(F.struct("id", "country")).alias("entries"))
    # A name is looked for in the country that is known, else everywhere.
    wanted = cut_lineage(parsed.select(F.explode("names").alias("name"), "country").distinct())
    here = F.col("country").isNull() | F.exists("entries", lambda e: e["country"] == F.col("country"))
    exact = wanted.join(listed, "name").where(here).select("name", "country", F.col("name").alias("found"), F.lit(1.0).alias("score"), "entries")

    vectors, weights = _weighted(listed.select("name"), None)
    open_names = wanted.join(exact.select("name", "country"), (wanted["name"] == exact["name"]) & wanted["country"].eqNullSafe(exact["country"]), "left_anti")
    asked, _ = _weighted(open_names.select("name").distinct(), weights)
    rest = Window.partitionBy("name").orderBy(F.desc("w"), "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    with_tail = lambda df: df.withColumn("tail", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest)))
    asked = cut_lineage(with_tail(asked))
    index = cut_lineage(with_tail(vectors).select(F.col("name").alias("found"), "gram", F.col("w").alias("v"), F.col("tail").alias("rest")))
    # Both sides have one order of grams, the rarest first. From the first common gram on, two names share at most the product of their
    # tails; so grams of a small tail aren't looked up, nor listed, and no pair that reaches the threshold is lost.
    probes = asked.where(F.col("tail") >= threshold).select("name", "gram", "tail")
    lists = index.where(F.col("rest") >= threshold).select("found", "gram", "rest")
    n = parallelism(values.sparkSession)
    # The lists of a gram are cut into slices by what they meet, so that a common gram is no single task.
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(probes.groupBy("gram").agg(F.count(F.lit(1)).alias("p")), "gram")
    sizes = cut_lineage(sizes.select("gram", F.ceil(F.col("n").cast("double") * F.col("p") / SLICE).alias("slices")))
    cut = probes.join(sizes, "gram").withColumn("slice", F.pmod(F.xxhash64("name"), F.col("slices")))
    copies = lists.join(sizes, "gram").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))).drop("slices")
    near = (F.col("tail") * F.col("rest") >= threshold) & (F.abs(F.length("name") - F.length("found")) <= MOST_EDITS)
    candidates = cut.join(copies, ["gram", "slice"]).where(near).select("name", "found").repartition(n, "name", "found").distinct()
    # Words in any order have the same letters, and an edit changes two of the sorted letters at most: what differs in more can't be confirmed.
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    candidates = candidates.where(F.levenshtein(letters(F.col("name")), letters(F.col("found")), 2 * MOST_EDITS) >= 0)
    named = listed.withColumnRenamed("name", "found")
    candidates = candidates.join(open_names, "name").join(named, "found").where(here)
    own = asked.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("grams"))
    theirs = index.groupBy("found").agg(F.collect_list(F.struct("gram", "v")).alias("vector"))
    product = F.aggregate("vector", F.lit(0.0), lambda acc, g: acc + g["v"] * F.coalesce(F.try_element_at("grams", g["gram"]), F.lit(0.0)))
    scored = candidates.join(own, "name").join(theirs, "found").withColumn("score", product).where(F.col("score") >= threshold)

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([name_edits(x, y, MOST_EDITS) for x, y in zip(a, b)], dtype="int32")

    allowed = F.when(F.length("found") <= SHORT, 1).otherwise(MOST_EDITS)
    close = scored.where(distance("name", "found") <= allowed).select("name", "country", "found", "score", "entries")
    # All readings of a value compete, exact names first.
    value_names = parsed.select("value", "country_code", "country", F.explode("names").alias("name"))
    matches = exact.unionByName(close).withColumnRenamed("country", "c").withColumnRenamed("name", "n")
    held = value_names.join(matches, (F.col("name") == F.col("n")) & F.col("country").eqNullSafe(F.col("c")))
    best = Window.partitionBy("value", "country_code").orderBy(F.desc("score"), "found")
    ranked = held.withColumn("k", F.row_number().over(best)).withColumn("next", F.lead("score").over(best)).where("k = 1")
    clear = ranked.where(F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)
    there = F.filter("entries", lambda e: e["country"] == F.col("country"))
    chosen = F.when(F.size("entries") == 1, F.col("entries")[0]["id"]).when(F.size(there) == 1, there[0]["id"])
    resolved = clear.select(F.col("value").alias("v"), F.col("country_code").alias("cc"), chosen.alias("id"), "score")
    joined = parsed.join(resolved, (F.col("value") == F.col("v")) & F.col("country_code").eqNullSafe(F.col("cc")), "left")
    return joined.select("value", "country_code", F.coalesce("id", F.lit(0)).cast("bigint").alias("geoname_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def typed_places(geocode_inputs: DataFrame, alerts: DataFrame) -> DataFrame:
    """record_kind, record_id, value, country_code of the two tables with typed places."""
    inputs = geocode_inputs.select(F.lit("geocode_inputs").alias("record_kind"), F.col("input_id").alias("record_id"), F.col("place_hint").alias("value"), "country_code")
    return inputs.unionByName(alerts.select(F.lit("alerts").alias("record_kind"), F.col("id").alias("record_id"), F.col("place_name").alias("value"), "country_code"))


def map_records(records: DataFrame, entries: DataFrame) -> DataFrame:
    """record_kind, record_id, geoname_id of every record with a value; each row once."""
    usable = records.where(F.col("value").rlike(r"(?U)\S"))
    mapped = map_places(usable, entries).withColumnRenamed("country_code", "cc")
    joined = usable.join(mapped, (usable["value"] == mapped["value"]) & usable["country_code"].eqNullSafe(mapped["cc"]))
    return joined.select("record_kind", "record_id", "geoname_id").distinct()
