"""Category of a text: weighted terms, similarity to prototypes, and a prior of the source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..model import LEXICON, lexicon_rows

SEMANTIC, LEXICAL, FLOOR = 0.45, 0.55, 0.18
#: Length from which a term also counts inside a word.
INSIDE = 6
AUTHORITATIVE = ["usgs.quakes", "gdacs.alerts", "nasa.eonet", "nws.alerts", "firms.fires", "noaa.swpc", "us.ofac"]
WEAK = ["gdelt.events", "ocha.reliefweb"]


def searchable(text: Column) -> Column:
    """Normalised text with a blank around it; a column of its own, as every term looks into it."""
    return F.concat(F.lit(" "), normalize_key(text), F.lit(" "))


def lexical_score(norm: Column, category: str) -> Column:
    """0 to 1 for one category: 1.6 times the root of the share of term weight that occurs.

    ``norm`` is a ``searchable`` text. A whole word or phrase counts fully, a longer term inside a word by 0.8.
    """
    terms = [(t.replace("-", " "), w) for c, t, w in lexicon_rows() if c == category]
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in terms])
    hit = lambda x: (
        F.when(norm.contains(F.concat(F.lit(" "), x["t"], F.lit(" "))), x["w"]).when((F.length(x["t"]) > INSIDE) & norm.contains(x["t"]), 0.8 * x["w"]).otherwise(0.0)
    )
    total = sum(w for _, w in terms)
    return F.least(F.lit(1.0), 1.6 * F.sqrt(F.aggregate(table, F.lit(0.0), lambda acc, x: acc + hit(x)) / total))


def lexical_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, category, score of the categories with a term in the text."""
    df = df.select(key, searchable(F.col(text)).alias("__norm"))
    scores = F.array(*[F.struct(F.lit(c).alias("category"), lexical_score(F.col("__norm"), c).alias("score")) for c in LEXICON])
    return df.select(key, F.explode(F.filter(scores, lambda s: s["score"] > 0)).alias("s")).select(key, "s.category", "s.score")


def semantic_scores(vector: Column, prototypes: dict[str, list[list[float]]]) -> Column:
    """array<struct(category, score)>: the best cosine to each category's prototypes, 0 at least."""
    names = list(prototypes)
    flat = np.array([v for n in names for v in prototypes[n]], float)
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
    owner = np.repeat(np.arange(len(names)), [len(prototypes[n]) for n in names])

    @F.pandas_udf("array<double>")
    def best(column: pd.Series) -> pd.Series:
        out = []
        for v in column:
            if v is None or len(v) != flat.shape[1] or not np.any(v):
                out.append([0.0] * len(names))
                continue
            v = np.asarray(v, float)
            sims = flat @ (v / np.linalg.norm(v))
            out.append([max(0.0, float(sims[owner == i].max())) for i in range(len(names))])
        return pd.Series(out)

    return F.zip_with(F.array(*[F.lit(n) for n in names]), best(vector), lambda n, s: F.struct(n.alias("category"), s.alias("score")))


def classify(df: DataFrame, key: str, text: str, vector: str, prototypes: dict[str, list[list[float]]]) -> DataFrame:
    """key, category, category_confidence and the next three categories; ``other`` below the floor."""
    categories = list(LEXICON)
    lexical = F.array(*[F.struct(F.lit(c).alias("category"), lexical_score(F.col("__norm"), c).alias("score")) for c in categories])
    rows = df.select(key, searchable(F.col(text)).alias("__norm"), semantic_scores(F.col(vector), prototypes).alias("sem")).select(key, lexical.alias("lex"), "sem")
    lex_map, sem_map = F.map_from_entries("lex"), F.map_from_entries("sem")
    every = sorted({*categories, *prototypes})
    zero = F.lit(0.0)
    mixed = F.array(*[F.struct((SEMANTIC * F.coalesce(F.try_element_at(sem_map, F.lit(c)), zero) + LEXICAL * F.coalesce(F.try_element_at(lex_map, F.lit(c)), zero)).alias("score"), F.lit(c).alias("category")) for c in every])
    ranked = rows.select(key, F.reverse(F.array_sort(mixed)).alias("r"))
    top, second = F.col("r")[0]["score"], F.col("r")[1]["score"]
    margin = F.when(top > 0, (top - second) / top).otherwise(0.0)
    return ranked.select(
        key, F.when(top < FLOOR, "other").otherwise(F.col("r")[0]["category"]).alias("category"), F.least(F.lit(1.0), top * (0.55 + 0.45 * margin)).alias("category_confidence"), F.slice(F.transform("r", lambda x: x["category"]), 2, 3).alias("alternatives")
    )


def prior_strength(source_id: Column) -> Column:
    """How far the category that a source states itself is to be believed."""
    return F.when(source_id.isin(AUTHORITATIVE), "authoritative").when(source_id.isin(WEAK), "weak").otherwise("none")


def blend_prior(prior: Column, strength: Column, inferred: Column, confidence: Column) -> Column:
    """struct(category, confidence): authoritative priors stand, weak ones help or fill in, others don't count."""
    result = lambda c, p: F.struct(c.alias("category"), p.alias("confidence"))
    return (
        F.when(prior.isNull() | (strength == "none"), result(inferred, confidence))
        .when(strength == "authoritative", result(prior, F.greatest(confidence, F.lit(0.9))))
        .when(prior == inferred, result(inferred, F.least(F.lit(1.0), confidence + 0.15)))
        .when(confidence < 0.35, result(prior, F.lit(0.4)))
        .otherwise(result(inferred, confidence))
    )
