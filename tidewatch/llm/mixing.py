"""Mixing of sources to target shares of tokens, with a cap on repeats.

Hash-threshold histograms: every document has a hash that orders it within its source; tokens are
summed by source and hash bucket, the bucket in which a source's budget is reached is found on
the histogram, and only the documents of that bucket are summed again by finer buckets. The
result is one hash threshold per source: documents below it get one more copy. No document is
sorted, and a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .encode import count_tokens

#: Bits of the hash that each level of the histogram looks at; 4096 buckets a source.
LEVEL_BITS = 12
LEVELS = 4
#: Sources a mixture may have; the table of targets is configuration, not data.
MAX_SOURCES = 1_000


@dataclass(frozen=True)
class Budget:
    """What one source gives: whole passes, and a last pass over hashes below ``threshold``."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    budget: float
    passes: int
    threshold: int


def _prefix(level: int):
    """The first ``level * LEVEL_BITS`` bits of the hash as a number."""
    return F.shiftrightunsigned("hash", 64 - level * LEVEL_BITS)


def plan_mixture(sized: DataFrame, targets: DataFrame) -> list[Budget]:
    """Budgets of the sources, from ``sized`` (source, hash, n_tokens).

    The mixture is as large as the source that is scarcest for its share allows:
    total = min(max_repeats * tokens / target_share) over sources with tokens and a share. Sources with
    neither get a budget of 0 and are reported so.
    """
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    wanted = {r["source"]: (max(0.0, r["share"] or 0.0), max(0, r["cap"] or 0)) for r in rows}
    histogram = _histogram(sized, 1, None)
    available = {s: sum(histogram.get(s, {}).values()) for s in wanted}
    limits = [cap * available[s] / share for s, (share, cap) in wanted.items() if share and cap and available[s]]
    total = min(limits, default=0.0)

    budget = {s: share * total if cap and available[s] else 0.0 for s, (share, cap) in wanted.items()}
    passes = {s: min(wanted[s][1], int(budget[s] // available[s])) if available[s] else 0 for s in wanted}
    rest = {s: budget[s] - passes[s] * available[s] if passes[s] < wanted[s][1] else 0.0 for s in wanted}
    edges = {s: 0 for s in wanted if rest[s] > 0}
    for level in range(1, LEVELS + 1):
        if level > 1:
            histogram = _histogram(sized, level, edges)
        for source in edges:
            # The bucket in which the rest of the budget ends; tokens before it are taken.
            for prefix, tokens in sorted(histogram[source].items()):
                if tokens > rest[source]:
                    edges[source] = prefix
                    break
                rest[source] -= tokens
    return [Budget(s, *wanted[s], available[s], budget[s], passes[s], edges.get(s, 0)) for s in sorted(wanted)]


def _histogram(sized: DataFrame, level: int, edges: dict[str, int] | None) -> dict[str, dict[int, int]]:
    """Tokens by source and hash bucket of ``level``; with ``edges`` only inside those buckets.

    At most 2**LEVEL_BITS buckets a source reach the driver.
    """
    if edges is not None:
        if not edges:
            return {}
        frame = sized.sparkSession.createDataFrame(list(edges.items()), "source string, edge bigint")
        sized = sized.join(F.broadcast(frame), "source").where(_prefix(level - 1) == F.col("edge"))
    out: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", _prefix(level).alias("prefix")).agg(F.sum("n_tokens").alias("n")).collect():
        out.setdefault(r["source"], {})[r["prefix"]] = r["n"]
    return out


def size_documents(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens and hash of the documents of the sources to be mixed, kept."""
    names = targets.select("source").where("source is not null").distinct()
    if names.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    mixed = documents.select("doc_id", "source", "text").join(F.broadcast(names), "source")
    # A document that is delivered again counts once; of differing texts under one id the longest in tokens counts.
    rows = count_tokens(mixed.withColumn("__row", F.monotonically_increasing_id()), ["doc_id", "source", "__row"], "text", tokenizer)
    sized = rows.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    return cut_lineage(sized.withColumn("hash", F.xxhash64(F.lit("mix"), "doc_id")))


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and ``copies`` (1 to max_repeats) of every document that is used.

    Documents without tokens (null or empty text), without a source or of a source without a target are
    not used. The plan's table (one row a source) is broadcast; see MAX_SOURCES.
    """
    plans = [(b.source, b.passes, b.threshold) for b in plan_mixture(sized, targets)]
    frame = sized.sparkSession.createDataFrame(plans, "source string, passes int, threshold bigint")
    copies = F.col("passes") + (_prefix(LEVELS) < F.col("threshold")).cast("int")
    return sized.join(F.broadcast(frame), "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: target_share, actual_share, tokens and documents used, most copies."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    joined = wanted.join(used, "source", "left").na.fill(0, ["tokens", "documents", "most_copies"])
    total = joined.agg(F.sum("tokens").alias("total"), F.lit(1).alias("one"))
    return joined.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(
        "source", "target_share", F.round(F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0), 6).alias("actual_share"), "tokens", "documents", "most_copies"
    )
