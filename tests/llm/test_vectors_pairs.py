import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidewatch.llm import cooccurrence, vectors

NAN = float("nan")


def brute(data, k, floor):
    ids = sorted(data)
    raw = np.array([data[i] for i in ids], np.float32).astype(float)
    u = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = {}
    for r, i in enumerate(ids):
        order = sorted((c for c in range(len(ids)) if s[r, c] >= floor), key=lambda c: (-round(s[r, c], 9), ids[c]))[:k]
        out[i] = [ids[c] for c in order]
    return out


@pytest.mark.parametrize("part_rows", [20_000, 30])
def test_neighbours_against_brute_force(spark, part_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    data = {f"v{i:04d}": centres[i % 60] + 0.12 * rng.normal(size=16) for i in range(500)}
    # A third of all vectors in one dense group.
    data |= {f"w{i:04d}": (centres[0] + 0.05 * rng.normal(size=16)) * rng.uniform(0.5, 2) for i in range(250)}
    rows = [(k, [float(np.float32(x)) for x in v], "clash") for k, v in data.items()]
    rows += [rows[0], ("n1", None, ""), ("n2", [1.0] * 15, ""), ("n3", [0.0] * 16, ""), ("n4", [NAN] * 16, ""), ("n5", [None] * 16, ""), ("n6", [float("inf")] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows, "id string, v array<float>, sim string")
    found = vectors.similar_vectors(df, "id", "v", width=16, k=5, floor=0.9, part_rows=part_rows, min_entries=400)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["other"])
    want = {k: set(v) for k, v in brute(data, 5, 0.9).items() if v}
    hits = sum(len(got.get(k, set()) & v) for k, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.97 and all(len(v) <= 5 for v in got.values()) and not set(got) & {f"n{i}" for i in range(1, 7)}


def test_a_query_sees_few_entries(spark, monkeypatch):
    """Of 6,000 vectors a query sees less than 5 % and still finds nine of ten neighbours."""
    monkeypatch.setattr(vectors, "SMALLEST_PART", 500)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(400, 16))
    data = {f"v{i:05d}": centres[i % 400] + 0.15 * rng.normal(size=16) for i in range(6_000)}
    seen = []
    index = vectors.MultiIndex
    original = index.visit

    def counting(self, units, min_entries):
        cells = original(self, units, min_entries)
        seen.extend(sum(int(self.counts[c]) for c in visited) for visited in cells)
        return cells

    df = spark.createDataFrame([(k, [float(np.float32(x)) for x in v]) for k, v in data.items()], "id string, v array<float>")
    got: dict = {}
    for r in vectors.similar_vectors(df, "id", "v", width=16, min_entries=150).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    want = {k: set(v) for k, v in brute(data, 5, 0.9).items() if v}
    assert sum(len(got.get(k, set()) & v) for k, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    # What a query sees is counted on an index of the same kind.
    units = np.array(list(data.values()))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    books = [vectors._kmeans(units[:, h], 11) for h in (slice(0, 8), slice(8, 16))]
    own = index(16, *books)
    first, second = own.split(units)
    np.add.at(own.counts, (first.argmin(1), second.argmin(1)), 1)
    counting(own, units[:500], 150)
    assert np.mean(seen) < 0.05 * len(data)


def test_partitions_are_runs_of_cells():
    own = vectors.MultiIndex(4, np.zeros((3, 2)), np.zeros((3, 2)))
    own.counts = np.array([[5, 0, 4], [30, 2, 2], [1, 1, 0]])
    part, slices = own.partitions(10)
    assert part[0, 0] == part[0, 2] and part[1, 0] not in (part[0, 2], part[1, 1]) and part[1, 1] == part[2, 1] and slices[part[1, 0]] == 3 and slices[part[0, 0]] == 1 == slices[part[2, 1]]


def test_copies_of_any_number(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [("near", [1.0, 2.0, 3.0, 4.1]), ("far", [-1.0, 2.0, -3.0, 0.0]), ("double", [2.0, 4.0, 6.0, 8.2])]
    got: dict = {}
    for r in vectors.similar_vectors(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v", width=4, k=3).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got["c000"] == {"c001", "c002", "c003"} and got["c039"] == {"c000", "c001", "c002"} and len(got["near"]) == 3 and "double" in got["near"] and "far" not in got


def test_few_vectors(spark):
    schema = "id string, v array<float>"
    assert vectors.similar_vectors(spark.createDataFrame([], schema), "id", "v", width=2).count() == 0
    assert vectors.similar_vectors(spark.createDataFrame([("a", [1.0, 0.0])], schema), "id", "v", width=2).count() == 0
    two = vectors.similar_vectors(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1])], schema), "id", "v", width=2)
    assert [tuple(r) for r in vectors.similar_pairs(two).collect()] == [("a", "b")]


def pairs(rows, least, lift):
    baskets: dict = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n, c = Counter(), Counter()
    for items in baskets.values():
        n.update(items)
        c.update(combinations(sorted(items), 2))
    return {(a, b, k): k * len(baskets) / (n[a] * n[b]) for (a, b), k in c.items() if k >= least and k * len(baskets) >= lift * n[a] * n[b]}


@pytest.mark.parametrize("wide", [2048, 3])
def test_pair_counts_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(cooccurrence, "WIDE", wide)
    monkeypatch.setattr(cooccurrence, "BLOCK", 8)
    monkeypatch.setattr(cooccurrence, "RECORD_BLOCK", 100)
    rng = np.random.default_rng(4)
    rows = []
    for b in range(400):
        group = b % 12
        for i in set(rng.integers(0, 4, 3).tolist()):
            rows.append((f"b{b}", f"i{group}-{i}"))
        # One item holds a third of all rows.
        rows.append((f"b{b}", "hot"))
        rows.append((f"b{b}", f"i{rng.integers(0, 12)}-{rng.integers(0, 4)}"))
    rows += rows[:100] + [(None, "x"), ("b1", None), (None, None), ("lonely", "hot")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "o string, e string, basket string")
    for least, lift in ((5, 3.0), (1, 0.0)):
        got = {(r["item_a"], r["item_b"], r["together"]): r["lift"] for r in cooccurrence.pair_counts(df, "o", "e", least, lift).collect()}
        want = pairs(rows, least, lift)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_empty_baskets_and_association(spark):
    schema = "o string, e string"
    assert cooccurrence.pair_counts(spark.createDataFrame([], schema), "o", "e", 1, 0.0).count() == 0
    df = spark.createDataFrame([(f"b{i}", x) for i in range(4) for x in ("p", "q")] + [("b9", "z")], schema)
    (r,) = cooccurrence.npmi(cooccurrence.pair_counts(df, "o", "e", 2, 1.0)).collect()
    assert (r["item_a"], r["item_b"], r["together"], r["n_baskets"]) == ("p", "q", 4, 5) and abs(r["npmi"] - 1) < 1e-9


@pytest.mark.parametrize("dense", [0, 1, 10**9])
def test_tiles_are_the_gram_matrix(monkeypatch, dense):
    """Both ways of multiplying a tile, with chunks of products that end within a row's entries."""
    monkeypatch.setattr(cooccurrence, "DENSE", dense)
    monkeypatch.setattr(cooccurrence, "CHUNK", 50 if dense < 10**9 else 10**6)
    rng = np.random.default_rng(8)
    codes = np.array([block * cooccurrence.BLOCK_CODES + c for block in range(3) for c in range(1, 20)])
    baskets = [rng.choice(codes, rng.integers(1, 25), replace=False) for _ in range(200)]
    x = np.array([np.isin(codes, b) for b in baskets], int)
    got: dict = {}
    for a, b, n in cooccurrence.RecordBlock(np.concatenate(baskets), np.array([len(b) for b in baskets])).products():
        for key in zip(a.tolist(), b.tolist(), n.tolist()):
            got[key[:2]] = got.get(key[:2], 0) + key[2]
    gram = x.T @ x
    assert got == {(int(codes[i]), int(codes[j])): int(gram[i, j]) for i in range(len(codes)) for j in range(i + 1, len(codes)) if gram[i, j]}


def test_memory_of_a_record_block_follows_its_entries():
    """Baskets of few items out of very many: nothing is held or gone through by item block and basket."""
    rng = np.random.default_rng(9)
    items = rng.integers(0, 1_500, 90_000) * cooccurrence.BLOCK_CODES + rng.integers(1, 500, 90_000)
    baskets = [np.unique(items[k : k + 3]) for k in range(0, len(items), 3)] + [items[:2], items[:2]]
    tracemalloc.start()
    got = Counter()
    for a, b, n in cooccurrence.RecordBlock(np.concatenate(baskets), np.array([len(b) for b in baskets])).products():
        got.update(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 150e6 and got == Counter(p for b in baskets for p in combinations(np.unique(b).tolist(), 2))


@pytest.mark.parametrize("work", [0, 10**9])
def test_tiles_or_baskets(monkeypatch, work):
    """Either way gives the Gram matrix, in as many portions as the bounds ask for."""
    monkeypatch.setattr(cooccurrence, "TILE_WORK", work)
    monkeypatch.setattr(cooccurrence, "EXPAND", 40)
    monkeypatch.setattr(cooccurrence, "DENSE", 0)
    monkeypatch.setattr(cooccurrence, "CHUNK", 40)
    rng = np.random.default_rng(10)
    codes = np.array([block * cooccurrence.BLOCK_CODES + c for block in range(4) for c in range(1, 9)])
    baskets = [rng.choice(codes, k, replace=False) for k in [1, *rng.integers(1, 16, 150), 32, 1]]
    got = Counter()
    portions = list(cooccurrence.RecordBlock(np.concatenate(baskets), np.array([len(b) for b in baskets], np.int32)).products())
    for a, b, n in portions:
        for pair in zip(a.tolist(), b.tolist(), n.tolist()):
            got[pair[:2]] += pair[2]
    assert got == Counter(p for b in baskets for p in combinations(sorted(b.tolist()), 2)) and all(n.sum() <= 40 for _, _, n in portions)


def test_counts_beyond_the_product_of_bigints(spark):
    rows = [("a", "b", 5_000_000_000, 6_000_000_000, 7_000_000_000, 90_000_000_000), ("a", "c", 5_000_000_000, 6_000_000_000, 70_000_000_000, 90_000_000_000), ("a", "d", 4, 5, 5, 90_000_000_000)]
    df = spark.createDataFrame(rows, "item_a string, item_b string, together bigint, n_a bigint, n_b bigint, n_baskets bigint")
    got = {r["item_b"]: (r["lift"], r["npmi"]) for r in cooccurrence.npmi(cooccurrence.normalise(df, 5, 3.0)).collect()}
    assert set(got) == {"b"} and abs(got["b"][0] - 5e9 * 9e10 / (6e9 * 7e9)) < 1e-9 and 0 < got["b"][1] < 1
