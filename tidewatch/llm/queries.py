"""Queries of the corpus problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from . import abuse, canonical, cooccurrence, encode, mixing, variants, vectors


def _name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = load(spark, sf_dir, "entities").where("kind is null or kind <> 'place'")
    return variants.variant_sets(entities, "id", "name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id_a, entity_id_b of entities that name the same person, organisation or group."""
    return variants.pairs_of_sets(_name_sets(spark, sf_dir), "id", "entity_id_a", "entity_id_b")


def p4_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and set of every entity that has variants."""
    return _name_sets(spark, sf_dir)


def _vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    enrichments = load(spark, sf_dir, "enrichments").select(F.col("observation_id").alias("id"), F.col("embedding").alias("v"))
    return enrichments.unionByName(load(spark, sf_dir, "event_clusters").select("id", F.col("centroid").alias("v")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id_a, vec_id_b with cosine >= 0.9, one of them among the five most similar of the other."""
    return vectors.similar_pairs(vectors.similar_vectors(_vector_collection(spark, sf_dir), "id", "v"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector the number of its five most similar others at cosine >= 0.9, and the best one."""
    found = vectors.similar_vectors(_vector_collection(spark, sf_dir), "id", "v")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("sim"), 6).alias("best"))


def _pairs_together(spark: SparkSession, sf_dir: str, min_lift: float) -> DataFrame:
    return cooccurrence.pair_counts(load(spark, sf_dir, "observation_entities"), "observation_id", "entity_id", 5, min_lift)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities that meet at least 5 times and 3 times as often as chance explains."""
    return _pairs_together(spark, sf_dir, 3.0).select(F.col("item_a").alias("source_entity_id"), F.col("item_b").alias("target_entity_id"))


def p6_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that meet at least 5 times, with counts, lift and normalised mutual information."""
    pairs = cooccurrence.npmi(_pairs_together(spark, sf_dir, 0.0))
    return pairs.select(
        F.col("item_a").alias("source_entity_id"), F.col("item_b").alias("target_entity_id"), F.col("together").alias("co_occurrences"), F.round("lift", 6).alias("lift"), F.round("npmi", 6).alias("pmi")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_kind, record_id and geoname_id (0 for none) of every record with a typed place."""
    records = canonical.typed_places(load(spark, sf_dir, "geocode_inputs"), load(spark, sf_dir, "alerts"))
    return canonical.map_records(records, load(spark, sf_dir, "places"))


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that no entry of the list is meant by, with their number of records."""
    records = canonical.typed_places(load(spark, sf_dir, "geocode_inputs"), load(spark, sf_dir, "alerts"))
    mapped = canonical.map_records(records, load(spark, sf_dir, "places"))
    return records.join(mapped.where("geoname_id = 0"), ["record_kind", "record_id"]).groupBy("value").agg(F.count_distinct("record_kind", "record_id").alias("n_records"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document."""
    return encode.encode_texts(load(spark, sf_dir, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whether decoding its ids gives its text (an empty one for null) again."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = encode.decode_ids(encode.encode_texts(documents, "doc_id", "text"), "doc_id", "ids")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return documents.join(decoded.withColumnRenamed("text", "decoded"), "doc_id").select("doc_id", same.alias("same"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their number of copies."""
    targets = load(spark, sf_dir, "mix_targets")
    return mixing.mix(mixing.size_documents(load(spark, sf_dir, "documents"), targets), targets)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return mixing.shares(p9_mix(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def _abuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(load(spark, sf_dir, "documents"), "doc_id", "text", ["source"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of documents with at least one abusive passage."""
    return _abuse_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and kinds of abuse of every document."""
    return _abuse_scores(spark, sf_dir).select("doc_id", "score", "kinds")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents by source."""
    return abuse.rates(_abuse_scores(spark, sf_dir), "source")


QUERIES = {
    "p4_found": p4_found,
    "p4_sets": p4_sets,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_edges": p6_edges,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

_PAIRS = """
l AS (SELECT DISTINCT observation_id AS o, entity_id AS e FROM observation_entities WHERE entity_id IS NOT NULL AND observation_id IS NOT NULL),
t AS (SELECT count(DISTINCT o) AS total FROM l),
m AS (SELECT e, count(*) AS n FROM l GROUP BY e),
g AS (SELECT a.e AS x, b.e AS y, count(*) AS c FROM l a JOIN l b ON a.o = b.o AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 5),
p AS (SELECT x, y, c, total, c * total / (mx.n * my.n) AS lift FROM g JOIN m mx ON mx.e = x JOIN m my ON my.e = y, t)"""

_VECTORS = """
c AS (SELECT id, min(v) AS v FROM (
  SELECT observation_id AS id, embedding::FLOAT[] AS v FROM enrichments UNION ALL SELECT id, centroid::FLOAT[] FROM event_clusters)
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
  GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS sim FROM c a JOIN c b ON a.id <> b.id
  WHERE list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) >= 0.9)"""

SQL = {
    "p5_found": f"""WITH {_VECTORS}, k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM k WHERE k <= 5""",
    "p6_found": f"WITH {_PAIRS} SELECT x AS source_entity_id, y AS target_entity_id FROM p WHERE lift >= 3",
    "p6_edges": f"""WITH {_PAIRS} SELECT x AS source_entity_id, y AS target_entity_id, c AS co_occurrences, round(lift, 6) AS lift,
  round(CASE WHEN c >= total THEN CASE WHEN lift >= 1 THEN 1.0 ELSE 0.0 END
    ELSE greatest(-1, least(1, log2(lift) / -log2(c / total))) END, 6) AS pmi FROM p""",
    "p8_roundtrip": "SELECT doc_id, true AS same FROM documents",
}
