"""Events from observations: matching, assignment, recomputation and titles."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, score, text
from ..functions.time import hours_between
from ..functions.vector import cosine
from ..model import MATCH_COSINE, MATCH_FREE_H, MATCH_MAX_GAP_H, MATCH_OTHER_CATEGORY, MATCH_TIME_DECAY, MEMBER_WEIGHT, PRECISION_RADIUS_KM, lookup
from ..session import cut_lineage

_COARSE = ["country", "unknown"]
#: Observations of a sequence after which the events that nothing can join are dropped.
FORGET_EVERY = 1_000
#: Subjects of a tile at least and at most, and rows of either side that are multiplied at a time.
TILE_ROWS, BLOCK_ROWS = (8_192, 262_144), (1_024, 2_048)
#: More than a product of unit vectors in single precision is wrong by; pairs that are confirmed at a time.
ROUNDING, CONFIRMED = 1e-5, 65_536


def time_factor(gap_h: Column) -> Column:
    """1 within the free window, then falling to 1 - decay at the largest gap."""
    excess = (gap_h - MATCH_FREE_H) / (MATCH_MAX_GAP_H - MATCH_FREE_H)
    return F.when(gap_h <= MATCH_FREE_H, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - MATCH_TIME_DECAY * excess))


def spatial_factor(a: str, b: str) -> Column:
    """How well the places of two sides (column prefixes with lat, lon, geo_precision, country_code) agree."""
    c = lambda side, name: F.col(f"{side}{name}")
    either_coarse = c(a, "geo_precision").isin(_COARSE) | c(b, "geo_precision").isin(_COARSE)
    same_country = c(a, "country_code") == c(b, "country_code")
    located = c(a, "lat").isNotNull() & c(a, "lon").isNotNull() & c(b, "lat").isNotNull() & c(b, "lon").isNotNull()
    # Impossible coordinates give no distance.
    mismatch = F.when(F.coalesce(c(a, "country_code") != c(b, "country_code"), F.lit(False)), 0.7).otherwise(1.0)
    km = geo.haversine_km(c(a, "lat"), c(a, "lon"), c(b, "lat"), c(b, "lon"))
    budget = sum((lookup(c(s, "geo_precision"), PRECISION_RADIUS_KM, 2000.0) for s in (a, b)), F.lit(0.0))
    beyond = F.pow(budget / km, F.lit(1.5))
    return F.when(either_coarse & F.coalesce(same_country, F.lit(False)), 0.95).when(~located | F.isnan(km), 0.85).when(km <= budget, mismatch).otherwise(beyond * mismatch)


def match_candidates(subjects: DataFrame, events: DataFrame, threshold: float = MATCH_COSINE, candidates: int = 20, others: bool = False) -> DataFrame:
    """Best event of every subject: subject_id, event_id, similarity, adjusted.

    ``subjects``: id, embedding, category, lat, lon, geo_precision, country_code, occurred_at. ``events``:
    id, centroid, category, lat, lon, geo_precision, country_code, last_seen_at. Candidates are at most the largest
    gap away in time, so both sides meet in day buckets; of those the ``candidates`` most similar are weighed. Products of
    matrices find them, the cosine confirms. Vectors that are null, all zero or not finite match nothing.
    ``others``: an event of the subject's own id is none of its candidates.
    """
    days = int(-(-MATCH_MAX_GAP_H // 24))
    s = subjects.select(*[F.col(c).alias(f"s_{c}") for c in subjects.columns])
    e = events.select(*[F.col(c).alias(f"e_{c}") for c in events.columns])
    side = lambda df, p, v, t: df.where(f"{v} is not null and {t} is not null").select(f"{p}_id", F.col(v).alias("v"), F.col(t).alias("t"), F.size(v).alias("width"), F.floor(F.unix_seconds(t) / 86_400).alias("day"))
    left = side(s, "s", "s_embedding", "s_occurred_at")
    right = side(e, "e", "e_centroid", "e_last_seen_at").withColumn("day", F.explode(F.sequence(F.col("day") - days, F.col("day") + days)))

    def unit(vectors: pd.Series) -> np.ndarray:
        v = np.array([np.asarray(x, float) for x in vectors])
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=np.isfinite(n) & (n > 0))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"s_id": [], "e_id": []}, dtype=object)]
        if len(a) and len(b) and a["width"].iloc[0]:
            x, y = unit(a["v"]), unit(b["v"])
            micros = lambda t: t.to_numpy("datetime64[us]").astype("int64")
            t, u = micros(a["t"]), micros(b["t"])
            for k in range(0, len(a), 512):
                sims = x[k : k + 512] @ y.T
                sims[np.abs(t[k : k + 512, None] - u) > MATCH_MAX_GAP_H * 3_600_000_000] = -2.0
                if others:
                    sims[a["s_id"].to_numpy()[k : k + 512, None] == b["e_id"].to_numpy()] = -2.0
                # Equal similarities at the last place are all kept; the slack is for rounding.
                last = np.partition(sims, -candidates, axis=1)[:, -candidates] if sims.shape[1] > candidates else np.full(len(sims), -2.0)
                i, j = np.nonzero(sims >= np.maximum(last, threshold)[:, None] - 1e-6)
                out.append(pd.DataFrame({"s_id": a["s_id"].to_numpy()[i + k], "e_id": b["e_id"].to_numpy()[j]}))
        return pd.concat(out)

    pairs = left.groupBy("day", "width").cogroup(right.groupBy("day", "width")).applyInPandas(near, "s_id string, e_id string")
    both = pairs.distinct().join(s, "s_id").join(e, "e_id").withColumn("gap", hours_between(F.col("s_occurred_at"), F.col("e_last_seen_at"))).where(F.col("gap") <= MATCH_MAX_GAP_H)
    both = both.withColumn("similarity", cosine(F.col("s_embedding"), F.col("e_centroid"))).where(F.col("similarity") >= threshold)
    nearest = Window.partitionBy("s_id").orderBy(F.desc("similarity"), "e_id")
    both = both.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= candidates)
    category = F.when(F.col("s_category") == F.col("e_category"), 1.0).otherwise(MATCH_OTHER_CATEGORY)
    both = both.withColumn("adjusted", F.col("similarity") * time_factor(F.col("gap")) * spatial_factor("s_", "e_") * category).where(F.col("adjusted") >= threshold)
    best = Window.partitionBy("s_id").orderBy(F.desc("adjusted"), "e_id")
    return both.withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("s_id").alias("subject_id"), F.col("e_id").alias("event_id"), "similarity", "adjusted")


class _Side:
    """Rows of one side in order of time: ids, times, vectors as they are and as unit vectors (``odd`` ones, which aren't finite, as zeros), squared lengths."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table["id"].to_numpy()
        self.at = table["at"].to_numpy()
        self.v = np.concatenate([c.flatten().to_numpy() for c in table["v"].chunks]).reshape(len(self.at), -1)
        self.squares = _dots(self.v, self.v)
        self.odd = ~(np.isfinite(self.squares) & (self.squares > 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.units = (self.v / np.sqrt(self.squares)[:, None]).astype(np.float32)
        self.units[self.odd] = 0


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from left to right in double precision, as SQL does."""
    total = np.zeros(len(x))
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(x.shape[1]):
            total += x[:, k].astype(float) * y[:, k]
    return total


class NearestEvents:
    """The most similar event so far of every subject of a tile; NaN counts as more than any number, as in SQL."""

    def __init__(self, subjects: list[pa.RecordBatch], floor: float, reach: int):
        self.s, self.floor, self.reach = _Side(subjects), floor, reach
        self.best = np.full(len(self.s.at), -np.inf)
        self.found = np.full(len(self.s.at), None, object)

    def meet(self, batch: pa.RecordBatch) -> None:
        """Compares all subjects with events in order of time."""
        e = _Side([batch])
        rank = np.empty(len(e.ids), int)
        rank[np.argsort(e.ids)] = np.arange(len(e.ids))
        for c in range(0, len(e.at), BLOCK_ROWS[1]):
            to = min(c + BLOCK_ROWS[1], len(e.at))
            within = np.searchsorted(self.s.at, e.at[c] - self.reach), np.searchsorted(self.s.at, e.at[to - 1] + self.reach, "right")
            for r in range(within[0], within[1], BLOCK_ROWS[0]):
                end = min(r + BLOCK_ROWS[0], within[1])
                sims = self.s.units[r:end] @ e.units[c:to].T
                # 2 for what may be NaN: it is looked at in any case.
                sims[self.s.odd[r:end]] = 2
                sims[:, e.odd[c:to]] = 2
                least = np.clip(self.best[r:end], self.floor, 1) - ROUNDING
                some = np.flatnonzero(sims.max(1) >= least)
                if len(some):
                    i, j = np.nonzero(sims[some] >= least[some, None])
                    i, j = some[i] + r, j + c
                    near = np.abs(self.s.at[i] - e.at[j]) <= self.reach
                    i, j = i[near], j[near]
                    for k in range(0, len(i), CONFIRMED):
                        self._confirm(e, rank, i[k : k + CONFIRMED], j[k : k + CONFIRMED])

    def _confirm(self, e: _Side, rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        other = self.s.ids[i] != e.ids[j]
        i, j = i[other], j[other]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            sims = np.clip(_dots(self.s.v[i], e.v[j]) / np.sqrt(self.s.squares[i] * e.squares[j]), -1, 1)
        sims[np.isnan(sims)] = np.inf
        order = np.lexsort((rank[j], -sims, i))
        order = order[sims[order] >= self.floor]
        order = order[np.append(True, np.diff(i[order]) > 0)[: len(order)]]
        i, j, sims = i[order], j[order], sims[order]
        better = sims > self.best[i]
        same = np.flatnonzero(sims == self.best[i])
        better[same] = e.ids[j[same]] < self.found[i[same]]
        self.best[i[better]], self.found[i[better]] = sims[better], e.ids[j[better]]

    def rows(self) -> pa.RecordBatch:
        """subject_id, event_id, similarity of the subjects that have an event."""
        has = np.flatnonzero(self.best > -np.inf)
        sims = np.where(np.isinf(self.best[has]), np.nan, self.best[has])
        return pa.RecordBatch.from_arrays([pa.array(self.s.ids[has], pa.string()), pa.array(self.found[has], pa.string()), pa.array(sims)], ["subject_id", "event_id", "similarity"])


def nearest_in_time(events: DataFrame, floor: float, hours: int) -> DataFrame:
    """The most similar other event of every event: subject_id, event_id and similarity, a cosine of ``floor`` and more; ties fall to the smaller id.

    ``events``: id (unique string), centroid (all of one width, not zero), first_seen_at, last_seen_at. A candidate was last seen at most
    ``hours`` before or after the subject was first seen. All such pairs are compared, as products of matrices, and the
    best are confirmed in double precision; no pair is ever a row. Subjects are cut by time into tiles that a task holds, and the
    events within reach of a tile stream through it, so memory follows the tile, and work the pairs within reach.
    """
    spark = events.sparkSession
    reach = hours * 3_600_000_000
    rows = events.where(~F.exists("centroid", lambda x: x.isNull())).select("id", F.col("centroid").alias("v"), F.unix_micros("first_seen_at").alias("t"), F.unix_micros("last_seen_at").alias("u"))
    fine = 1_024
    n, quantiles = rows.agg(F.count("t"), F.percentile_approx("t", [k / fine for k in range(1, fine)], 10_000)).first()
    size = min(max(n // (2 * spark.sparkContext.defaultParallelism), TILE_ROWS[0]), TILE_ROWS[1])
    tiles = min(max(1, -(-n // size)), fine)
    bounds = F.array(*[F.lit(quantiles[k * fine // tiles - 1]).cast("bigint") for k in range(1, tiles)]).cast("array<bigint>")
    below = lambda t: F.size(F.filter(bounds, lambda b: b < t))
    upto = lambda t: F.size(F.filter(bounds, lambda b: b <= t))
    place = lambda tile, side, at: F.struct(tile.cast("int").alias("tile"), F.lit(side).alias("side"), at.alias("at"))
    # Subjects of one time that is several bounds are spread over the tiles between them.
    own = below(F.col("t")) + F.pmod(F.xxhash64("id"), upto(F.col("t")) - below(F.col("t")) + 1)
    met = F.transform(F.sequence(below(F.col("u") - reach), upto(F.col("u") + reach)), lambda k: place(k, 1, F.col("u")))
    places = F.concat(F.when(F.col("t").isNull(), F.array()).otherwise(F.array(place(own, 0, F.col("t")))), F.when(F.col("u").isNull(), F.array()).otherwise(met))
    placed = rows.select("id", "v", F.inline(places)).repartitionById(tiles, "tile").sortWithinPartitions("tile", "side", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, subjects, nearest = None, [], None
        for batch in batches:
            tile, side = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.diff(tile) | np.diff(side)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tile)]):
                part = batch.slice(lo, hi - lo)
                if tile[lo] != at:
                    if nearest:
                        yield nearest.rows()
                    at, subjects, nearest = tile[lo], [], None
                if side[lo] == 0:
                    subjects.append(part)
                elif subjects:
                    nearest = nearest or NearestEvents(subjects, floor, reach)
                    nearest.meet(part)
        if nearest:
            yield nearest.rows()

    return placed.mapInArrow(run, "subject_id string, event_id string, similarity double")


def _haversine(a: np.ndarray, o: np.ndarray, lat: float, lon: float) -> np.ndarray:
    p1, p2 = np.radians(a), np.radians(lat)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon - o) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.minimum(1, np.sqrt(h)))


def _micros(at) -> int:
    return pd.Timestamp(at).as_unit("ns").value // 1000


class OnlineClusters:
    """Sequential assignment of observations to live events; state survives between batches."""

    def __init__(self, threshold: float = MATCH_COSINE, candidates: int = 20):
        self.threshold, self.candidates = threshold, candidates
        self.ids: list[str] = []
        self.rows: list[dict] = []
        #: By width: the vectors of the events, their lengths, last times and places in ``rows``; ``indexed`` rows are there.
        self.vectors: dict[int, dict] = {}
        self.indexed = 0

    def forget(self, at) -> None:
        """Drops the events that nothing from ``at`` on can join."""
        alive = [i for i, e in enumerate(self.rows) if (at - e["last"]).total_seconds() <= MATCH_MAX_GAP_H * 3600]
        self.ids, self.rows = [self.ids[i] for i in alive], [self.rows[i] for i in alive]
        self.vectors, self.indexed = {}, 0

    def _index(self) -> None:
        for i in range(self.indexed, len(self.rows)):
            total = self.rows[i]["sum"]
            if total is None:
                continue
            held = self.vectors.setdefault(len(total), {"n": 0, "sums": np.zeros((64, len(total))), "norms": np.zeros(64), "last": np.zeros(64, np.int64), "row": np.zeros(64, np.int64)})
            if held["n"] == len(held["row"]):
                held.update({k: np.concatenate([v, np.zeros_like(v)]) for k, v in held.items() if k != "n"})
            self.rows[i]["at"] = held["n"]
            held["row"][held["n"]] = i
            held["n"] += 1
            self._update(held, self.rows[i])
        self.indexed = len(self.rows)

    def _update(self, held: dict, event: dict) -> None:
        j = event["at"]
        held["sums"][j], held["norms"][j], held["last"][j] = event["sum"], np.linalg.norm(event["sum"]), _micros(event["last"])

    def assign(self, row: dict) -> tuple[str, float, bool]:
        """(event id, similarity, whether the event is new). Without a vector always a new event."""
        at, vector = row["occurred_at"], row.get("embedding")
        self._index()
        if vector is not None and len(vector):
            v = np.asarray(vector, float)
            length = np.linalg.norm(v)
            held = self.vectors.get(len(v))
            if held and length > 0:
                n = held["n"]
                norms = held["norms"][:n] * length
                sims = np.divide(held["sums"][:n] @ v, norms, out=np.zeros(n), where=norms > 0)
                near = np.flatnonzero((sims >= self.threshold) & (np.abs(held["last"][:n] - _micros(at)) <= MATCH_MAX_GAP_H * 3_600_000_000))
                usable, sims = held["row"][near].tolist(), sims[near]
                best, best_score, best_sim = None, -1.0, 0.0
                for j in np.lexsort(([self.ids[i] for i in usable], -sims))[: self.candidates]:
                    sim = float(sims[j])
                    adjusted = sim * self._factors(row, self.rows[usable[j]])
                    if adjusted >= self.threshold and adjusted > best_score:
                        best, best_score, best_sim = usable[j], adjusted, sim
                if best is not None:
                    event = self.rows[best]
                    event["sum"] = event["sum"] + v
                    event["n"] += 1
                    event["last"] = max(event["last"], at)
                    self._update(held, event)
                    return self.ids[best], best_sim, False
        self.ids.append(row["id"])
        self.rows.append({**{k: row.get(k) for k in ("category", "lat", "lon", "geo_precision", "country_code")}, "sum": None if vector is None else np.asarray(vector, float), "n": 1, "last": at})
        return row["id"], 1.0, True

    def _factors(self, row: dict, event: dict) -> float:
        gap = abs((row["occurred_at"] - event["last"]).total_seconds()) / 3600
        time = 1.0 if gap <= MATCH_FREE_H else max(0.0, 1 - MATCH_TIME_DECAY * (gap - MATCH_FREE_H) / (MATCH_MAX_GAP_H - MATCH_FREE_H))
        category = 1.0 if row.get("category") == event["category"] else MATCH_OTHER_CATEGORY
        a, b = row.get("geo_precision") or "unknown", event["geo_precision"] or "unknown"
        ca, cb = row.get("country_code"), event["country_code"]
        if (a in _COARSE or b in _COARSE) and ca and ca == cb:
            return time * category * 0.95
        places = (row.get("lat"), row.get("lon"), event["lat"], event["lon"])
        if any(p is None or p != p for p in places):
            return time * category * 0.85
        mismatch = 0.7 if ca and cb and ca != cb else 1.0
        km = float(_haversine(np.array(places[0]), np.array(places[1]), places[2], places[3]))
        budget = PRECISION_RADIUS_KM.get(a, 2000.0) + PRECISION_RADIUS_KM.get(b, 2000.0)
        return time * category * mismatch * (1.0 if km <= budget else (budget / km) ** 1.5)


def cluster_online(observations: DataFrame, block: list[str] | None = None) -> DataFrame:
    """(observation_id, event_id, similarity) by sequential assignment in order of (occurred_at, id).

    The order of arrival decides, so a sequence is split only where nothing can reach across, at days without rows that
    are more than the largest gap. Within it one task reads the rows in their order and holds no more than the events that
    are still alive. ``block`` names columns within which sequences are told to be independent; matches between blocks are
    lost then. An event's id is that of its first observation.
    """
    columns = ["id", "embedding", "category", "lat", "lon", "geo_precision", "country_code", "occurred_at"]
    keys = block or []
    rows = observations.select(*dict.fromkeys([*columns, *keys])).where("id is not null and occurred_at is not null").dropDuplicates(["id"])
    rows = rows.withColumn("__day", F.floor(F.unix_seconds("occurred_at") / 86_400))
    along = Window.orderBy("__day")
    apart = F.col("__day") - F.lag("__day").over(along) > -(-MATCH_MAX_GAP_H // 24)
    # One row a day that has any.
    days = rows.select("__day").distinct().withColumn("__new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("__sequence", F.sum("__new").over(along)).select("__day", "__sequence")
    sequences = rows.join(F.broadcast(days), "__day").select(*columns, F.to_json(F.struct(*keys, "__sequence")).alias("__key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, clusters, seen = None, OnlineClusters(), 0
        for batch in batches:
            out = []
            for r in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if r["__key"] != key:
                    key, clusters, seen = r["__key"], OnlineClusters(), 0
                seen += 1
                if seen % FORGET_EVERY == 0:
                    clusters.forget(r["occurred_at"])
                out.append((r["id"], *clusters.assign(r)[:2]))
            yield pd.DataFrame(out, columns=["observation_id", "event_id", "similarity"])

    ordered = sequences.repartition("__key").sortWithinPartitions("__key", "occurred_at", "id")
    return ordered.mapInPandas(run, "observation_id string, event_id string, similarity double")


def recompute(links: DataFrame, observations: DataFrame, now: Column, editorial: list[str] | None = None, synthetic: list[str] | None = None, curves: dict | None = None) -> DataFrame:
    """One row per event from its members; ties fall to the earlier, then the smaller id.

    ``links``: event_id, observation_id; ``observations``: id and the columns of the model. The peak, the member of the highest
    severity, is scored again as the event's: with the event's category, precision and number of sources. Members are materialised once,
    as several aggregates look at them.
    """
    members = cut_lineage(links.join(observations.withColumnRenamed("id", "observation_id"), "observation_id"))
    weight = lookup(F.col("geo_precision"), MEMBER_WEIGHT, 0.5)
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    sums = geo.unit_sums(F.col("lat"), F.col("lon"), weight)
    order = lambda *first: F.struct(*first, (-F.unix_micros("occurred_at")).alias("t"), F.col("observation_id").alias("i"))
    body = F.when(F.trim("body") != "", F.col("body"))
    base = members.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_distinct("source_id").alias("source_count"),
        F.min("occurred_at").alias("first_seen_at"),
        F.max("occurred_at").alias("last_seen_at"),
        F.count_if(F.col("occurred_at") >= now - F.expr("INTERVAL 3 HOURS")).alias("recent"),
        *[v.alias(k) for k, v in sums.items()],
        F.max_by(F.struct("geo_precision", "place_name"), F.when(located, order(weight))).alias("best_place"),
        F.max_by(F.struct("source_id", "category_confidence", "magnitude", "tone", "report_count"), order(F.coalesce("severity", F.lit(0)))).alias("peak"),
        F.max_by(body, F.when(body.isNotNull(), order(F.coalesce("severity", F.lit(0))))).alias("best_body"),
    )
    votes = members.groupBy("event_id", "category").agg(F.sum(F.greatest(F.coalesce("category_confidence", F.lit(0.0)), F.lit(0.1))).alias("v"))
    category = votes.groupBy("event_id").agg(F.max_by("category", F.struct(F.round("v", 9), F.col("category"))).alias("category"))
    places = members.where("country_code is not null").groupBy("event_id", "country_code").agg(F.count(F.lit(1)).alias("v"))
    country = places.groupBy("event_id").agg(F.max_by("country_code", F.struct("v", "country_code")).alias("country_code"))
    out = base.join(category, "event_id").join(country, "event_id", "left").join(pick_titles(members, editorial or [], synthetic or []), "event_id")
    speed = score.velocity(F.col("recent"), F.col("observation_count"), F.col("first_seen_at"), F.col("last_seen_at"))
    centre = geo.direction(F.col("x"), F.col("y"), F.col("z"), F.col("w"))
    peak = lambda c: F.col(f"peak.{c}")
    precision = F.coalesce("best_place.geo_precision", F.lit("unknown"))
    tone, magnitude = (F.when(~F.isnan(peak(c)), peak(c)) for c in ("tone", "magnitude"))
    rescored = score.observation(peak("source_id"), F.col("category"), F.coalesce(peak("category_confidence"), F.lit(0.0)), magnitude, tone, peak("report_count"), precision, F.col("source_count"), curves)
    return (
        out.withColumns({"velocity": speed, "centre": centre, "score": rescored})
        .withColumn("status", score.status(F.col("last_seen_at"), F.col("velocity"), now))
        .select(
            "event_id", "title", "category", "country_code", "status", "score.severity", "score.confidence", "velocity", F.col("centre.lat").alias("lat"), F.col("centre.lon").alias("lon"), precision.alias("geo_precision"),
            F.col("best_place.place_name").alias("place_name"), F.when(F.col("centre").isNotNull(), geo.grid_cell(F.col("centre.lat"), F.col("centre.lon"))).alias("grid_cell"), "observation_count", "source_count", "first_seen_at", "last_seen_at",
            text.truncate(F.col("best_body"), 500).alias("summary"),
        )
    )


def created_events(observations: DataFrame) -> DataFrame:
    """The row of a new event from its first observation, with the observation's vector as centroid (null if it has none)."""
    keep = lambda *names: [F.col(n) for n in names]
    body = F.when(F.trim("body") != "", text.truncate(F.col("body"), 600))
    return observations.select(
        F.col("id"), text.truncate(F.col("title"), 200).alias("title"), body.alias("summary"), *keep("category"), F.lit("active").alias("status"), *keep("severity", "confidence"), F.lit(0.0).alias("velocity"),
        *keep("lat", "lon", "geo_precision", "place_name", "country_code", "grid_cell"), F.lit(1).alias("observation_count"), F.lit(1).alias("source_count"), F.col("occurred_at").alias("first_seen_at"), F.col("occurred_at").alias("last_seen_at"),
        F.col("embedding").alias("centroid"),
    )


def pick_titles(members: DataFrame, editorial: list[str], synthetic: list[str]) -> DataFrame:
    """Best title of every event from event_id, observation_id, title, severity, source_id."""
    value = score.title_score(F.trim("title"), F.col("severity"), F.col("source_id").isin(editorial), F.col("source_id").isin(synthetic))
    titled = members.where(F.trim("title") != "").groupBy("event_id").agg(F.max_by(F.trim("title"), F.struct(value, F.col("observation_id"))).alias("title"))
    named = members.select("event_id").distinct().join(titled, "event_id", "left")
    return named.select("event_id", F.coalesce(text.truncate(F.col("title"), 200), F.lit("Unnamed event")).alias("title"))


def mmr_sentences(candidates: DataFrame, sentences: int = 3, characters: int = 600, most_alike: float = 0.65) -> DataFrame:
    """(event_id, summary): sentences that are relevant to the centroid and unlike those taken before.

    ``candidates``: event_id, sentence, embedding, centroid, severity; a group is one event's candidates.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack([np.asarray(v, float) for v in pdf["embedding"]])
        vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        centre = np.asarray(pdf["centroid"].iloc[0], float)
        relevance = vectors @ (centre / max(np.linalg.norm(centre), 1e-12)) + pdf["severity"].to_numpy(float) / 1000
        taken: list[int] = []
        length = 0
        for i in sorted(range(len(pdf)), key=lambda i: (-relevance[i], pdf["sentence"].iloc[i])):
            size = len(pdf["sentence"].iloc[i])
            if len(taken) == sentences or (taken and (length + size > characters or max(vectors[j] @ vectors[i] for j in taken) > most_alike)):
                continue
            taken.append(i)
            length += size
        return pd.DataFrame({"event_id": [pdf["event_id"].iloc[0]], "summary": [" ".join(pdf["sentence"].iloc[i] for i in taken)]})

    return candidates.groupBy("event_id").applyInPandas(run, "event_id string, summary string")


def summary_candidates(members: DataFrame) -> DataFrame:
    """event_id, observation_id, severity and sentence: titles of 25 characters and more, and up to four sentences of 40 to 400."""
    titles = members.where(F.length(F.trim("title")) >= 25).select("event_id", "observation_id", "severity", F.trim("title").alias("sentence"))
    some = F.slice(F.filter(text.sentences(text.clean_text(F.col("body"))), lambda s: F.length(s).between(40, 400)), 1, 4)
    bodies = members.select("event_id", "observation_id", "severity", F.explode(some).alias("sentence"))
    return titles.unionByName(bodies.withColumn("sentence", text.truncate(F.col("sentence"), 320)))


def hashed_embedding(column: Column, width: int = 384) -> Column:
    """Deterministic unit vector of hashed words; the default where no model is at hand."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for batch in batches:
            out = []
            for line in batch:
                v = np.zeros(width, np.float32)
                for word in (line or "").lower().split():
                    h = xxhash.xxh64_intdigest(word)
                    v[h % width] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            yield pd.Series(out)

    return embed(column)
