import random

import numpy as np
import pytest

from tidewatch.operators.spatial import NearestTree, QuadTree, RTree, haversine, nearest_within, pairs_within, points_in_regions, search_boxes

NAN = float("nan")


def usable(lat, lon):
    if lat is None or lon is None or lat != lat or lon != lon or abs(lat) > 90 or abs(lon) > 360 or (lat == 0 and lon == 0):
        return None
    return lat, lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon


def brute(left, right, km):
    out = set()
    for a, *p in left:
        for b, *q in right:
            p2, q2 = usable(*p), usable(*q)
            if a is not None and b is not None and p2 and q2 and haversine(*p2, *q2) <= km:
                out.add((a, b))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.gauss(50, 0.2), 89.99, -89.95]), rng.choice([rng.uniform(-180, 180), rng.gauss(8, 0.3), 179.99, -179.98, 181.0, -359.0]))
    left = [(f"e{i}", *spot()) for i in range(400)] + [("bad1", None, 1.0), ("bad2", NAN, 1.0), ("bad3", 91.0, 1.0), ("bad4", 0.0, 0.0), ("bad5", 1.0, 361.0), ("hot", 50.0, 8.0), ("hot", 50.0, 8.0), (None, 50.0, 8.0)]
    # A third of all rows at one location.
    left += [(f"same{i}", 50.1, 8.1) for i in range(200)]
    right = [(i, *spot()) for i in range(300)] + [(9999, float("inf"), 1.0)]
    l = spark.createDataFrame(left, "event_id string, lat double, lon double")
    r = spark.createDataFrame(right, "geoname_id bigint, lat double, lon double")
    for leaf in (3, 20_000):
        got = [(x[0], x[1]) for x in pairs_within(l, r, "event_id", "geoname_id", 12.0, leaf_rows=leaf).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(left, right, 12.0)


def test_nearest_against_brute_force(spark):
    rng = random.Random(6)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.gauss(50, 0.5), 89.9, -89.95]), rng.choice([rng.uniform(-180, 180), rng.gauss(8, 0.5), 179.9, -179.9]))
    left = [(f"e{i}", *spot()) for i in range(300)] + [(f"same{i}", 50.1, 8.1) for i in range(100)] + [("bad", NAN, 1.0), (None, 50.0, 8.0), ("e1", 50.0, 8.0)]
    # Entries at one spot, and two at equal distances: the smaller id is the nearest.
    right = [(i, *spot()) for i in range(200)] + [(900, 10.0, 10.0), (901, 10.0, 10.0), (902, 20.5, 20.0), (903, 19.5, 20.0)]
    left += [("tie", 10.1, 10.0), ("between", 20.0, 20.0)]
    l = spark.createDataFrame(left, "k string, lat double, lon double")
    r = spark.createDataFrame(right, "g bigint, lat double, lon double")
    want: dict = {}
    for k, *p in left:
        p = usable(*p)
        for g, *q in right:
            d = haversine(*p, *q) if p and k else 1e9
            if d <= 150 and (k not in want or (round(d, 9), g) < want[k]):
                want[k] = (round(d, 9), g)
    for leaf in (3, 20_000):
        got = {x["k"]: (round(x["distance_km"], 9), x["g"]) for x in nearest_within(l, r, "k", "g", 150.0, leaf_rows=leaf).collect()}
        assert got.keys() == want.keys() and got["tie"][1] == 900 and got["between"][1] in (902, 903)
        assert all(abs(got[k][0] - want[k][0]) < 1e-6 and (got[k][1] == want[k][1] or k == "between") for k in got)
    assert nearest_within(l.limit(0), r, "k", "g", 5.0).count() == 0 and nearest_within(l, r.limit(0), "k", "g", 5.0).count() == 0


def test_nearest_tree():
    rng = np.random.default_rng(3)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 5000))), rng.uniform(-180, 180, 5000)
    a, o = np.degrees(np.arcsin(rng.uniform(-1, 1, 500))), rng.uniform(-180, 180, 500)
    found = dict((p, e) for ps, es in NearestTree(lat, lon).nearest(a, o, 20_100.0) for p, e in zip(ps.tolist(), es.tolist()))
    assert len(found) == 500 and all(found[i] == np.argmin(haversine(a[i], o[i], lat, lon)) for i in range(500))


def test_empty_sides(spark):
    l = spark.createDataFrame([], "a string, lat double, lon double")
    r = spark.createDataFrame([(1, 1.0, 1.0)], "b bigint, lat double, lon double")
    assert pairs_within(l, r, "a", "b", 5.0).count() == 0
    assert pairs_within(r, l, "b", "a", 5.0).count() == 0


def test_regions(spark, rows):
    ring = lambda *p: [{"lat": float(a), "lon": float(b)} for a, b in p]
    regions = spark.createDataFrame([("square", ring((0, 0), (0, 10), (10, 10), (10, 0))), ("triangle", ring((5, 5), (5, 15), (15, 5))), ("line", ring((0, 0), (1, 1))), (None, ring((0, 0), (0, 9), (9, 0)))], "r string, ring array<struct<lat:double,lon:double>>")
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 6.0, 6.0), ("c", 12.0, 6.0), ("d", 20.0, 20.0), ("e", None, 1.0), ("a", 1.0, 1.0)], "p string, lat double, lon double")
    assert rows(points_in_regions(points, regions, "p", "r")) == [("a", "square"), ("b", "square"), ("b", "triangle"), ("c", "triangle")]


@pytest.mark.parametrize("lat,lon", [(0, 0), (89.999, 10), (-60, 179.99), (45, -179.9)])
def test_boxes_hold_the_circle(lat, lon):
    rng = np.random.default_rng(1)
    a, o = rng.uniform(lat - 1, min(90, lat + 1), 4000), rng.uniform(-180, 180, 4000)
    near = haversine(lat, lon, a, o) <= 50
    inside = np.zeros(4000, bool)
    for s, n, w, e in search_boxes(lat, lon, 50)[1]:
        inside |= (s <= a) & (a <= n) & (w <= o) & (o <= e)
    assert inside[near].all()


def test_trees():
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(-90, 90, 3000), rng.uniform(-180, 180, 3000)
    tree = QuadTree(lat, lon, 50)
    leaf = tree.locate(lat, lon)
    for i in range(0, 3000, 97):
        s, n, w, e = tree.boxes[leaf[i]]
        assert s <= lat[i] <= n and w <= lon[i] <= e
        assert leaf[i] in tree.touching(np.array([(lat[i], lat[i], lon[i], lon[i])]))[1]
    boxes = np.column_stack([lat - 2, lat + 2, lon - 2, lon + 2])
    found = {(p, b) for ps, bs in RTree(boxes).containing(lat[:200], lon[:200]) for p, b in zip(ps.tolist(), bs.tolist())}
    want = {(i, j) for i in range(200) for j in np.nonzero((boxes[:, 0] <= lat[i]) & (lat[i] <= boxes[:, 1]) & (boxes[:, 2] <= lon[i]) & (lon[i] <= boxes[:, 3]))[0]}
    assert found == want
