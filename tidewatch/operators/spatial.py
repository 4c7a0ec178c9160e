"""Points near other points, and the regions that contain points, on the sphere.

Plan: (1) a bounded sample of the locations of both sides builds a quadtree whose leaves hold
about equally many points; (2) every location of the probing side goes to its one leaf, every
location of the other side is replicated to all leaves that its search box touches; (3) in each
leaf an R-tree bulk-loaded over the replicated side (sort-tile-recursive packing) is probed; (4)
the exact distance decides; (5) a pair is reported only in the leaf that holds its reference
point, the probing location, so that replication yields no duplicates.

Equal coordinates are probed once and joined back, so copies of one location cost nothing. A leaf that is still
heavy, on either side, is cut into tiles: slices of the one side meet slices of the other, so that the memory of a task doesn't
follow the density; cells aren't split below the search radius, where splitting would only replicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

EARTH_RADIUS_KM = 6371.0088
#: Locations that the quadtree is fitted on, of both sides together; a bound, not a share.
SAMPLE_ROWS = 100_000
#: Locations a leaf should hold.
LEAF_ROWS = 20_000
MAX_DEPTH = 18


def usable_location(lat: Column, lon: Column) -> Column:
    """struct(lat, lon) with the longitude wrapped to ±180, or null.

    Null for coordinates that are missing, not finite, out of range (|lat| > 90, |lon| > 360)
    or exactly (0, 0). ±180 stay as they are.
    """
    good = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 360) & ~((lat == 0) & (lon == 0))
    wrapped = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
    return F.when(good, F.struct(lat.cast("double").alias("lat"), wrapped.cast("double").alias("lon")))


def haversine(lat1, lon1, lat2, lon2):
    """Kilometres; numpy arrays or numbers in degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def search_boxes(lat: np.ndarray, lon: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray]:
    """(position, box) of what lies within ``km`` of locations; rows lat low, lat high, lon low, lon high, two at the antimeridian."""
    lat, lon = np.atleast_1d(np.asarray(lat, float)), np.atleast_1d(np.asarray(lon, float))
    reach = math.degrees(km / EARTH_RADIUS_KM) * (1 + 1e-9) + 1e-9
    low, high = lat - reach, lat + reach
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = math.sin(math.radians(min(reach, 90.0))) / np.cos(np.radians(lat))
        wide = np.degrees(np.arcsin(np.clip(ratio, -1, 1))) * (1 + 1e-9) + 1e-9
    west, east = lon - wide, lon + wide
    # Around a pole, or all around the globe, every longitude is near.
    whole = (low <= -90) | (high >= 90) | (ratio >= 1) | ~np.isfinite(ratio) | ((west < -180) & (east > 180)) | (reach >= 90)
    low, high = np.maximum(low, -90.0), np.minimum(high, 90.0)
    first = np.column_stack([low, high, np.where(whole | (west < -180), -180.0, west), np.where(whole | (east > 180), 180.0, east)])
    over = ~whole & ((west < -180) | (east > 180))
    again = np.column_stack([low, high, np.where(west < -180, west + 360, -180.0), np.where(west < -180, 180.0, east - 360)])[over]
    return np.concatenate([np.arange(len(lat)), np.flatnonzero(over)]), np.concatenate([first, again])


class QuadTree:
    """Leaves of a quadtree over longitude and latitude; at most a few per sampled point."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, leaf_points: int, least_degrees: float = 0.0):
        self.least_degrees = least_degrees
        self.boxes: list[tuple[float, float, float, float]] = []
        self.weight: list[int] = []
        # node: (split lat, split lon, four children) or leaf number; children are found by arithmetic
        self.nodes: list[tuple] = []
        self._build(np.asarray(lat, float), np.asarray(lon, float), (-90.0, 90.0, -180.0, 180.0), max(1, leaf_points), 0)
        self._arrays()

    def _build(self, lat, lon, box, leaf_points, depth) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(lat) <= leaf_points or depth == MAX_DEPTH or (box[1] - box[0]) / 2 < self.least_degrees:
            self.nodes[at] = (-1, len(self.boxes), 0.0, 0.0)
            self.boxes.append(box)
            self.weight.append(len(lat))
            return at
        la, lo = (box[0] + box[1]) / 2, (box[2] + box[3]) / 2
        children = []
        for quarter in range(4):
            up, right = quarter >> 1, quarter & 1
            inside = ((lat >= la) if up else (lat < la)) & ((lon >= lo) if right else (lon < lo))
            part = (la if up else box[0], box[1] if up else la, lo if right else box[2], box[3] if right else lo)
            children.append(self._build(lat[inside], lon[inside], part, leaf_points, depth + 1))
        self.nodes[at] = (children, 0, la, lo)
        return at

    def _arrays(self) -> None:
        n = len(self.nodes)
        self.child = np.full((n, 4), -1, np.int64)
        self.leaf, self.la, self.lo = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n)
        for i, (children, leaf, la, lo) in enumerate(self.nodes):
            if children == -1:
                self.leaf[i] = leaf
            else:
                self.child[i], self.la[i], self.lo[i] = children, la, lo

    def locate(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Leaf number of each location."""
        node = np.zeros(len(lat), np.int64)
        for _ in range(MAX_DEPTH + 1):
            inner = self.leaf[node] < 0
            if not inner.any():
                break
            at = node[inner]
            node[inner] = self.child[at, (lat[inner] >= self.la[at]) * 2 + (lon[inner] >= self.lo[at])]
        return self.leaf[node]

    def touching(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of a box, leaf that it touches), each once."""
        boxes = np.asarray(boxes, float).reshape(-1, 4)
        at, node = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
        found = []
        while len(at):
            inner = self.leaf[node] < 0
            found.append((at[~inner], self.leaf[node[~inner]]))
            at, node = at[inner], node[inner]
            box, la, lo = boxes[at], self.la[node], self.lo[node]
            parts = []
            for quarter in range(4):
                up, right = quarter >> 1, quarter & 1
                hit = (box[:, 1] >= la if up else box[:, 0] < la) & (box[:, 3] >= lo if right else box[:, 2] < lo)
                parts.append((at[hit], self.child[node[hit], quarter]))
            at, node = (np.concatenate(x) for x in zip(*parts))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.array([], np.int64), np.array([], np.int64))


class RTree:
    """Sort-tile-recursive packed R-tree over boxes (rows: lat low, lat high, lon low, lon high)."""

    def __init__(self, boxes: np.ndarray, fanout: int = 16):
        self.fanout = fanout
        count = len(boxes)
        order = np.argsort(boxes[:, 0] + boxes[:, 1], kind="stable")
        slices = max(1, math.ceil(math.sqrt(count / fanout)))
        width = math.ceil(count / slices) if count else 1
        order = np.concatenate([part[np.argsort(boxes[part, 2] + boxes[part, 3], kind="stable")] for part in (order[i : i + width] for i in range(0, count, width))]) if count else order
        self.items = order
        self.levels = [boxes[order]]
        while len(self.levels[-1]) > fanout:
            below = self.levels[-1]
            starts = np.arange(0, len(below), fanout)
            self.levels.append(
                np.column_stack([np.minimum.reduceat(below[:, 0], starts), np.maximum.reduceat(below[:, 1], starts), np.minimum.reduceat(below[:, 2], starts), np.maximum.reduceat(below[:, 3], starts)])
            )

    def containing(self, lat: np.ndarray, lon: np.ndarray, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of points, positions of boxes that contain them), level by level, in chunks."""
        if not len(self.items):
            return
        for start in range(0, len(lat), max(1, chunk // 64)):
            stop = min(len(lat), start + max(1, chunk // 64))
            top = len(self.levels[-1])
            point = np.repeat(np.arange(start, stop), top)
            node = np.tile(np.arange(top), stop - start)
            for level in range(len(self.levels) - 1, -1, -1):
                box = self.levels[level][node]
                hit = (box[:, 0] <= lat[point]) & (lat[point] <= box[:, 1]) & (box[:, 2] <= lon[point]) & (lon[point] <= box[:, 3])
                point, node = point[hit], node[hit]
                if level:
                    size = len(self.levels[level - 1])
                    point = np.repeat(point, self.fanout)
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    inside = node < size
                    point, node = point[inside], node[inside]
            yield point, self.items[node]


class NearestTree:
    """Sort-tile-recursive packed tree over unit vectors, probed for the nearest entry with a shrinking bound.

    Boxes hold unit vectors, so a chord to a box bounds the distance from below everywhere, at poles and antimeridian too.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, fanout: int = 16):
        self.fanout = fanout
        self.points = unit_vectors(lat, lon)
        count = len(self.points)
        order = np.arange(count)
        width = count
        for axis in range(3):
            # Every run is sorted along the next axis and cut into as many runs as the axes left need.
            width_next = max(fanout, math.ceil(width / max(1, math.ceil((max(1, width) / fanout) ** (1 / (3 - axis))))))
            order = np.concatenate([part[np.argsort(self.points[part, axis], kind="stable")] for part in (order[i : i + width] for i in range(0, count, max(1, width)))]) if count else order
            width = width_next
        self.items = order
        low = high = self.points[order]
        self.levels = [(low, high)]
        while len(low) > fanout:
            starts = np.arange(0, len(low), fanout)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((low, high))

    def _gaps(self, level: int, nodes: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """Squared chords from probes to boxes."""
        low, high = (side[nodes] for side in self.levels[level])
        gap = np.maximum(0.0, np.maximum(low - probes, probes - high))
        return (gap * gap).sum(-1)

    def nearest(self, lat: np.ndarray, lon: np.ndarray, km: float, chunk: int = 8_192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position of a probe, position of an entry): the nearest entries within ``km``; those equally near all come out."""
        if not len(self.items):
            return
        farthest = (2 * math.sin(min(math.pi, km / EARTH_RADIUS_KM) / 2)) ** 2 * (1 + 1e-9) + 1e-18
        for start in range(0, len(lat), chunk):
            probes = unit_vectors(lat[start : start + chunk], lon[start : start + chunk])
            every = np.arange(len(probes))
            bound = np.full(len(probes), farthest)
            # One path down by the nearest child gives a first bound.
            node = np.argmin(self._gaps(len(self.levels) - 1, np.arange(len(self.levels[-1][0]))[None, :], probes[:, None, :]), axis=1)
            for level in range(len(self.levels) - 2, -1, -1):
                children = np.minimum(node[:, None] * self.fanout + np.arange(self.fanout), len(self.levels[level][0]) - 1)
                node = children[every, np.argmin(self._gaps(level, children, probes[:, None, :]), axis=1)]
            bound = np.minimum(bound, self._gaps(0, node, probes) * (1 + 1e-9) + 1e-18)
            who, node = np.repeat(every, len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), len(probes))
            for level in range(len(self.levels) - 1, -1, -1):
                gaps = self._gaps(level, node, probes[who])
                if not level:
                    np.minimum.at(bound, who, gaps * (1 + 1e-9) + 1e-18)
                near = gaps <= bound[who]
                who, node = who[near], node[near]
                if level:
                    size = len(self.levels[level - 1][0])
                    who = np.repeat(who, self.fanout)
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    who, node = who[node < size], node[node < size]
            yield who + start, self.items[node]


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere, one a row."""
    la, lo = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def _fit_quadtree(sides: list[DataFrame], boxes_of, sample_rows: int, leaf_rows: int, least_degrees: float) -> tuple[QuadTree, np.ndarray, np.ndarray]:
    """The tree, and for each leaf into how many slices the probing and the replicated side are cut.

    ``sides``: the probing locations (lat, lon) and the rows that are replicated, which have lat and lon of their centres too.
    """
    counts = [side.count() for side in sides]
    total = max(1, sum(counts))
    share = min(1.0, sample_rows / total)
    # limit() only guards the driver against an unlucky draw; the share already aims below it.
    rows = [(side if share == 1.0 else side.sample(False, share, seed=7)).limit(2 * sample_rows).toPandas() for side in sides]
    lat, lon = (np.concatenate([r[c].to_numpy(float) for r in rows]) for c in ("lat", "lon"))
    scale = total / max(1, len(lat))
    tree = QuadTree(lat, lon, int(max(1, leaf_rows / scale)), least_degrees)
    leaves = len(tree.boxes)
    mine = np.bincount(tree.locate(rows[0]["lat"].to_numpy(float), rows[0]["lon"].to_numpy(float)), minlength=leaves) * scale
    theirs = np.bincount(tree.touching(boxes_of(rows[1])[1])[1], minlength=leaves) * scale
    slices = lambda n: np.maximum(1, np.ceil(n / (4 * leaf_rows))).astype(np.int64)
    return tree, slices(mine), slices(theirs)


def _probe(refine, boxes_of, columns: list[str]):
    """Body of the per-leaf join: probe an R-tree of the right side with the left side's points."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            lat, lon = left["lat"].to_numpy(float), left["lon"].to_numpy(float)
            owner, boxes = boxes_of(right)
            for point, box in RTree(boxes).containing(lat, lon):
                out.append(refine(left, right, point, owner[box]))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    return run


def _leaf_join(points: DataFrame, others: DataFrame, boxes_of, run, schema: str, sample_rows: int, leaf_rows: int, least_degrees: float) -> DataFrame:
    """points(lat, lon) and others(lat, lon, ...), of which ``boxes_of`` gives the boxes, brought together leaf by leaf and tile by tile."""
    points, others = cut_lineage(points), cut_lineage(others)
    shared = points.sparkSession.sparkContext.broadcast(_fit_quadtree([points, others], boxes_of, sample_rows, leaf_rows, least_degrees))
    tile = ["leaf", "lp", "rp"]

    def spread(batch: pd.DataFrame, row: np.ndarray, leaf: np.ndarray, own: np.ndarray, across: np.ndarray, mine: str, theirs: str) -> pd.DataFrame:
        # A row lies in one slice of its own side and meets all slices of the other.
        salt = (np.abs(batch["lat"].to_numpy(float)) * 1e6 + np.abs(batch["lon"].to_numpy(float)) * 1e7).astype(np.int64)[row] % own[leaf]
        n = across[leaf]
        at = np.repeat(np.arange(len(row)), n)
        other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return batch.take(row[at]).assign(**{"leaf": leaf[at].astype("int32"), mine: salt[at].astype("int32"), theirs: other.astype("int32")})

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, lefts, rights = shared.value
        for batch in batches:
            yield spread(batch, np.arange(len(batch)), tree.locate(batch["lat"].to_numpy(float), batch["lon"].to_numpy(float)), lefts, rights, "lp", "rp")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, lefts, rights = shared.value
        for batch in batches:
            owner, boxes = boxes_of(batch)
            at, leaf = tree.touching(boxes)
            # Two boxes of one row may touch the same leaf.
            both = np.unique(np.column_stack([owner[at], leaf]), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            yield spread(batch, both[:, 0], both[:, 1], rights, lefts, "rp", "lp")

    typed = lambda df: ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c} int" for c in tile])
    left = points.mapInPandas(home, typed(points))
    right = others.mapInPandas(replicate, typed(others))
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(run, schema)


def _located(df: DataFrame, key: str) -> DataFrame:
    """key, lat, lon of the rows with a key and a usable location, each once."""
    at = usable_location(F.col("lat"), F.col("lon"))
    return df.where(F.col(key).isNotNull()).select(F.col(key), at.alias("__at")).where("__at is not null").select(key, "__at.lat", "__at.lon").distinct()


def _within(km: float):
    return lambda frame: search_boxes(frame["lat"].to_numpy(float), frame["lon"].to_numpy(float), km)


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(``left_id``, ``right_id``, distance_km): for each left location the nearest right one within ``km``, ties by ``right_id``.

    Every location is probed with a bound that shrinks to the nearest entry found, so entries within ``km`` aren't listed. The rules
    for rows and ids are those of ``pairs_within``; a left id with several locations has its nearest one; with none near it has no row.
    """
    left, right = cut_lineage(_located(left, left_id)), _located(right, right_id)
    # Of entries at one spot the least id is the nearest.
    spots = right.groupBy("lat", "lon").agg(F.min(right_id).alias(right_id))
    points = left.select("lat", "lon").distinct()
    kind = right.schema[right_id].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"lat": [], "lon": [], "distance_km": [], right_id: []})]
        if len(a) and len(b):
            lat, lon, y, x = a["lat"].to_numpy(float), a["lon"].to_numpy(float), b["lat"].to_numpy(float), b["lon"].to_numpy(float)
            for who, entry in NearestTree(y, x).nearest(lat, lon, km):
                out.append(pd.DataFrame({"lat": lat[who], "lon": lon[who], "distance_km": haversine(lat[who], lon[who], y[entry], x[entry]), right_id: b[right_id].to_numpy()[entry]}))
        found = pd.concat(out[1:] or out)
        return found[found["distance_km"] <= km].sort_values(["distance_km", right_id]).drop_duplicates(["lat", "lon"])

    near = _leaf_join(points, spots, _within(km), run, f"lat double, lon double, distance_km double, `{right_id}` {kind}", sample_rows, leaf_rows, math.degrees(km / EARTH_RADIUS_KM))
    best = near.join(left, ["lat", "lon"]).groupBy(left_id).agg(F.min(F.struct("distance_km", right_id)).alias("b"))
    return best.select(left_id, f"b.{right_id}", "b.distance_km")


def pairs_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(``left_id``, ``right_id``, distance_km) of every two locations at most ``km`` apart.

    Both frames have their id, ``lat`` and ``lon``; other columns are ignored. Rows without
    a usable location (see ``usable_location``) or with a null id are in no pair; repeated rows
    give a pair once; an empty side gives no pairs. Both ids come out under their own names,
    which must differ.
    """
    left, right = cut_lineage(_located(left, left_id)), cut_lineage(_located(right, right_id))
    points, others = left.select("lat", "lon").distinct(), right.select("lat", "lon").distinct()

    def refine(a: pd.DataFrame, b: pd.DataFrame, point: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        la, lo, ra, ro = (frame[c].to_numpy(float)[at] for frame, at in ((a, point), (b, other)) for c in ("lat", "lon"))
        d = haversine(la, lo, ra, ro)
        near = d <= km
        # A location whose two boxes (antimeridian) hold a point would be met twice.
        found = pd.DataFrame({"lat": la[near], "lon": lo[near], "lat2": ra[near], "lon2": ro[near], "distance_km": d[near]})
        return found.drop_duplicates(["lat", "lon", "lat2", "lon2"])

    columns = ["lat", "lon", "lat2", "lon2", "distance_km"]
    schema = ", ".join(f"{c} double" for c in columns)
    found = _leaf_join(points, others, _within(km), _probe(refine, _within(km), columns), schema, sample_rows, leaf_rows, math.degrees(km / EARTH_RADIUS_KM))
    named = right.withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
    return found.join(left, ["lat", "lon"]).join(named, ["lat2", "lon2"]).select(left_id, right_id, "distance_km")


def points_in_regions(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(``point_id``, ``region_id``) of every point and the regions that contain it.

    ``regions`` has its id and ``ring``: array<struct<lat, lon>>, a simple polygon in plane
    longitude and latitude that does not cross the antimeridian; points on the lower and left
    edges are inside. Null ids, unusable locations and rings of fewer than three corners are in
    no pair; repeated rows give a pair once.
    """
    located = cut_lineage(_located(points, point_id))
    spots = located.select("lat", "lon").distinct()
    rings = regions.where(F.col(region_id).isNotNull() & (F.size("ring") >= 3)).select(F.col(region_id), F.col("ring")).distinct()
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    limits = {"s": edge(F.array_min, "lat"), "n": edge(F.array_max, "lat"), "w": edge(F.array_min, "lon"), "e": edge(F.array_max, "lon")}
    boxed = rings.select(region_id, F.transform("ring", lambda p: p["lat"]).alias("ring_lat"), F.transform("ring", lambda p: p["lon"]).alias("ring_lon"), *[v.alias(f"__{k}") for k, v in limits.items()])
    boxed = boxed.withColumns({"lat": (F.col("__s") + F.col("__n")) / 2, "lon": (F.col("__w") + F.col("__e")) / 2})
    boxes_of = lambda frame: (np.arange(len(frame)), frame[["__s", "__n", "__w", "__e"]].to_numpy(float))
    kind = regions.schema[region_id].dataType.simpleString()

    def refine(a: pd.DataFrame, b: pd.DataFrame, point: np.ndarray, other: np.ndarray) -> pd.DataFrame:
        lat, lon = a["lat"].to_numpy(float)[point], a["lon"].to_numpy(float)[point]
        inside = np.zeros(len(point), bool)
        for region in np.unique(other):
            mine = other == region
            ys, xs = np.asarray(b["ring_lat"].iloc[region], float), np.asarray(b["ring_lon"].iloc[region], float)
            y, x, odd = lat[mine], lon[mine], np.zeros(mine.sum(), bool)
            for i in range(len(ys)):
                y1, x1, y2, x2 = ys[i], xs[i], ys[i - 1], xs[i - 1]
                crosses = (y1 > y) != (y2 > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    odd ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside[mine] = odd
        return pd.DataFrame({"lat": lat[inside], "lon": lon[inside], region_id: b[region_id].to_numpy()[other[inside]]})

    columns = ["lat", "lon", region_id]
    found = _leaf_join(spots, boxed, boxes_of, _probe(refine, boxes_of, columns), f"lat double, lon double, `{region_id}` {kind}", sample_rows, leaf_rows, 0.0)
    return found.join(located, ["lat", "lon"]).select(point_id, region_id).distinct()
