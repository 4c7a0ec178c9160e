"""Enrichment of drafts in one plan: place, vector, category, entities and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, score, text
from . import classify, entities, gazetteer
from .events import hashed_embedding

WIDTH = 384

# Our own wording: two sentences per category that a text of the category resembles.
PROTOTYPES = {
    "armed_conflict": ["Troops exchanged artillery fire along the front line.", "An air strike hit a military position."], "civil_unrest": ["Protesters marched and clashed with police.", "A strike and demonstrations blocked the streets."],
    "terrorism": ["A bomb exploded and a group claimed responsibility.", "Gunmen took hostages in an attack on civilians."], "political": ["Parliament voted after the election.", "The president resigned and a referendum was called."],
    "diplomacy": ["Ambassadors met for negotiations on a treaty.", "Leaders agreed at a summit."], "natural_disaster": ["A landslide buried houses.", "A volcano erupted and ash fell."], "severe_weather": ["A hurricane brought heavy rain and flooding.", "A storm warning was issued."],
    "wildfire": ["A wildfire burned through forest.", "Fire crews fought flames on dry hills."], "seismic": ["An earthquake shook the region.", "A tsunami warning followed the tremor."], "health": ["An outbreak of disease spread.", "Hospitals reported new infections."],
    "humanitarian": ["Refugees fled and need aid.", "Food shortages leave families hungry."], "cyber": ["Hackers breached a network.", "Ransomware encrypted the systems of a company."], "economy": ["The central bank raised interest rates.", "Inflation and tariffs hit the market."],
    "infrastructure": ["A power outage left the city dark.", "A bridge collapsed and a railway closed."], "maritime": ["A tanker was boarded in the strait.", "A port closed to shipping."], "aviation": ["A flight was diverted and airspace closed.", "A plane crashed on approach."],
    "space": ["A solar flare caused a geomagnetic storm.", "A satellite was launched to orbit."], "other": ["Something happened somewhere.", "A report without a particular subject."],
}


def prototype_vectors(spark, embed: Callable[[Column], Column]) -> dict[str, list[list[float]]]:
    """Vectors of the prototype sentences, a table of fixed size."""
    rows = spark.createDataFrame([(c, s) for c, sentences in PROTOTYPES.items() for s in sentences], "category string, sentence string")
    out: dict[str, list[list[float]]] = {}
    for r in rows.select("category", embed(F.col("sentence")).alias("v")).collect():
        out.setdefault(r["category"], []).append([float(x) for x in r["v"]])
    return out


def enrich(drafts: DataFrame, places: DataFrame, countries: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Drafts with id, location, grid_cell, content_hash, embedding, category with confidence, severity and confidence.

    ``drafts`` has the columns of the feed parsers. The id is derived from (source_id, external_id), so a replay gives
    the same rows; drafts without either are dropped, and of several the first by time is kept.
    """
    embed = embed or (lambda c: hashed_embedding(c, WIDTH))
    usable = drafts.where("source_id is not null and external_id is not null and trim(title) <> ''")
    usable = usable.withColumn("id", F.sha2(F.concat_ws("\u001f", "source_id", "external_id"), 256))
    first = usable.groupBy("id").agg(F.min_by(F.struct(*[c for c in usable.columns if c != "id"]), F.struct("occurred_at", "title")).alias("d")).select("id", "d.*")
    coded = first.withColumn("fips", F.get_json_object("raw", "$.actionGeo.fipsCountryCode"))
    located = gazetteer.name_precise(gazetteer.resolve_locations(coded, places, countries).drop("step"), places)
    located = located.select("id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("precision").alias("r_precision"), F.col("place_name").alias("r_place"), F.col("country_code").alias("r_country"))
    rows = first.join(located, "id", "left")
    rows = rows.withColumns(
        {"lat": F.col("r_lat"), "lon": F.col("r_lon"), "geo_precision": F.coalesce("r_precision", F.lit("unknown")), "place_name": F.coalesce("place_name", "r_place"), "country_code": F.coalesce("country_code", "r_country")}
    ).drop("r_lat", "r_lon", "r_precision", "r_place", "r_country")
    rows = rows.withColumns(
        {
            "grid_cell": F.when(F.col("lat").isNotNull(), geo.grid_cell(F.col("lat"), F.col("lon"))),
            "content_hash": text.content_hash(F.col("title"), F.col("body")),
            "embedding": embed(text.embedding_text(F.col("title"), F.col("body"), F.col("place_name"))),
            "__text": F.concat_ws(" ", "title", "body"),
        }
    )
    inferred = classify.classify(rows, "id", "__text", "embedding", prototype_vectors(drafts.sparkSession, embed)).select("id", F.col("category").alias("i_category"), F.col("category_confidence").alias("i_confidence"))
    blended = classify.blend_prior(F.col("category"), classify.prior_strength(F.col("source_id")), F.col("i_category"), F.col("i_confidence"))
    rows = rows.join(inferred, "id").withColumn("b", blended).withColumns({"category": F.col("b.category"), "category_confidence": F.col("b.confidence")}).drop("b", "__text", "i_category", "i_confidence")
    strength = score.intensity(F.col("source_id"), F.col("magnitude"))
    return rows.withColumns(
        {
            "severity": score.severity(F.col("category"), strength, F.col("tone"), F.col("report_count"), F.lit(1)),
            "confidence": score.confidence(F.col("geo_precision"), F.col("category_confidence"), F.lit(1)),
        }
    )


def link_entities(enriched: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links) of enriched drafts: merged entities, and observation_id, entity_key, kind, mentions, confidence."""
    rows = enriched.withColumns({"__text": F.concat_ws(". ", "title", "body"), "__actors": F.array_distinct(F.concat(F.coalesce("actors", F.array().cast("array<string>")), entities.declared_actors(F.coalesce("raw", F.lit("{}")))))})
    found = entities.extract_entities(rows, "id", "__text", "__actors", names)
    dated = found.join(enriched.select("id", "occurred_at"), "id")
    links = found.select(F.col("id").alias("observation_id"), "entity_key", "kind", "mentions", "confidence")
    return entities.merge_entities(dated, "occurred_at"), links
