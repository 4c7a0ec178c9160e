"""Most similar vectors by an inverted multi-index.

Both halves of a unit vector are quantised by codebooks of their own (k-means on a bounded sample);
a cell is a pair of centroids and every vector is in one cell. A query visits cells in the order
of summed squared distance, by a heap over the two sorted centroid lists, until it has seen enough
entries; all entries of the visited cells are ranked by exact cosine similarity. Nothing
within a visited cell is cut.

Plan: exact copies are collapsed to one representative; cells that follow one another are grouped into partitions of the index of
about equal size, a query goes once to each partition that holds cells it visits, and the products are taken cell by cell. Only a
single cell that is larger than a partition is cut on both sides.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, parallelism

#: Vectors that the codebooks are fitted on; a bound.
SAMPLE_ROWS = 20_000
#: Entries a query sees at least in a collection of up to 100,000; in larger ones more, by the
#: square root of the size, as neighbours spread over more cells.
MIN_ENTRIES = 4_000
#: Centroids of a codebook at most: the table of cells has their square. Larger collections have fuller cells.
MAX_CENTROIDS = 1_024
#: Vectors of one partition of the index.
PART_ROWS = 20_000
SMALLEST_PART = 2_000


def usable_vector(vector: Column, width: int) -> Column:
    """True for vectors of the width without null, NaN or infinite values that aren't all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == width) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pd.Series, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column), np.float32).reshape(-1, width).astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_distances(p, centres).argmin(1) for p in np.array_split(points, max(1, len(points) // 5000))])
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T)


class MultiIndex:
    """Codebooks of the two halves and the number of entries of every cell."""

    def __init__(self, width: int, first: np.ndarray, second: np.ndarray):
        self.width, self.half, self.books = width, width // 2, (first, second)
        self.counts = np.zeros((len(first), len(second)), np.int64)

    def split(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(units[:, : self.half], self.books[0]), _distances(units[:, self.half :], self.books[1])

    def partitions(self, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(partition of every cell, slices of every partition): runs of cells with up to ``part_rows`` entries; a fuller cell is one by itself."""
        flat = self.counts.ravel()
        part, slices = np.zeros(len(flat), np.int32), [1]
        held = 0
        for cell in np.flatnonzero(flat):
            n = int(flat[cell])
            if held and held + n > part_rows:
                slices.append(1)
                held = 0
            part[cell] = len(slices) - 1
            slices[-1] = -(-n // part_rows) if n > part_rows else 1
            held += n
        return part.reshape(self.counts.shape), np.array(slices)

    def visit(self, units: np.ndarray, min_entries: int) -> list[list[tuple[int, int]]]:
        """For each vector the cells it visits, nearest first (multi-sequence traversal)."""
        out = []
        first, second = self.split(units)
        order1, order2 = first.argsort(1), second.argsort(1)
        sorted1, sorted2 = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
        for o1, o2, d1, d2 in zip(order1.tolist(), order2.tolist(), sorted1.tolist(), sorted2.tolist()):
            heap, pushed, cells, seen = [(d1[0] + d2[0], 0, 0)], {(0, 0)}, [], 0
            while heap and seen < min_entries:
                _, i, j = heapq.heappop(heap)
                n = self.counts[o1[i], o2[j]]
                if n:
                    cells.append((o1[i], o2[j]))
                    seen += n
                for a, b in ((i + 1, j), (i, j + 1)):
                    if a < len(d1) and b < len(d2) and (a, b) not in pushed:
                        pushed.add((a, b))
                        heapq.heappush(heap, (d1[a] + d2[b], a, b))
            out.append(cells)
        return out


def fit_index(vectors: DataFrame, width: int, total: int, sample_rows: int = SAMPLE_ROWS) -> MultiIndex:
    """Codebooks from a bounded sample of ``vectors`` (vec: binary of float32)."""
    share = min(1.0, sample_rows / max(1, total))
    rows = (vectors if share == 1.0 else vectors.sample(False, share, seed=5)).select("vec").limit(2 * sample_rows).toPandas()
    if not len(rows):  # an unlucky draw from few rows
        rows = vectors.select("vec").limit(sample_rows).toPandas()
    units = _unit(rows["vec"], width)
    k = int(min(MAX_CENTROIDS, max(1, round(math.sqrt(total / 48))), len(units)))
    half = width // 2
    return MultiIndex(width, _kmeans(units[:, :half], k), _kmeans(units[:, half:], k))


def _search(reps: DataFrame, width: int, k: int, floor: float, min_entries: int, part_rows: int) -> DataFrame:
    """(query, entry, sim): for each representative its ``k`` nearest others with sim >= floor."""
    total = reps.count()
    schema = "query string, entry string, sim double"
    if total < 2:
        return reps.sparkSession.createDataFrame([], schema)
    index = fit_index(reps, width, total)
    min_entries = int(min_entries * max(1.0, math.sqrt(total / 100_000)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, second = index.split(_unit(batch["vec"], width))
            yield batch.assign(c1=first.argmin(1).astype("int32"), c2=second.argmin(1).astype("int32"))

    entries = cut_lineage(reps.mapInPandas(assign, "id string, vec binary, c1 int, c2 int"))
    # The counts fill a table of k x k cells, whose size the codebooks bound.
    counted = entries.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).toArrow()
    index.counts[counted["c1"].to_numpy(), counted["c2"].to_numpy()] = counted["n"].to_numpy()
    # Small collections are cut finer, so that every core has some partitions.
    part_rows = min(part_rows, max(SMALLEST_PART, total // (3 * parallelism(reps.sparkSession))))
    shared = reps.sparkSession.sparkContext.broadcast((index, *index.partitions(part_rows)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, part_of, slices = shared.value
        for batch in batches:
            part = part_of[batch["c1"].to_numpy(), batch["c2"].to_numpy()]
            own = slices[part]
            salt = pd.util.hash_array(batch["id"].to_numpy(object)) % own.astype(np.uint64)
            # An entry is in one slice of its partition, and once in every slice of the queries; nearly all have one slice.
            copies = batch.assign(part=part, s=salt.astype("int32"), cell=batch["c1"] * np.int32(len(index.counts)) + batch["c2"]).loc[batch.index.repeat(own)]
            copies["q"] = np.concatenate([np.arange(n) for n in own]).astype("int32") if len(own) else []
            yield copies[["part", "s", "q", "cell", "id", "vec"]]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, part_of, slices = shared.value
        for batch in batches:
            rows = []
            salts = pd.util.hash_array(batch["id"].to_numpy(object), hash_key="tidewatch_query_")
            for name, vec, salt, cells in zip(batch["id"], batch["vec"], salts.tolist(), index.visit(_unit(batch["vec"], width), min_entries)):
                by_part: dict[int, list[int]] = {}
                for c1, c2 in cells:
                    by_part.setdefault(int(part_of[c1, c2]), []).append(c1 * len(index.counts) + c2)
                for part, asked in by_part.items():
                    n = int(slices[part])
                    rows += [(part, s, salt % n, name, vec, asked) for s in range(n)]
            yield pd.DataFrame(rows, columns=["part", "s", "q", "query", "qvec", "cells"])

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            queries, units = _unit(left["qvec"], width), _unit(right["vec"], width)
            asked = np.concatenate([np.asarray(c) for c in left["cells"]])
            asker = np.repeat(np.arange(len(left)), [len(c) for c in left["cells"]])
            by_cell = np.argsort(asked, kind="stable")
            asked, asker = asked[by_cell], asker[by_cell]
            held = right["cell"].to_numpy()
            order = np.argsort(held, kind="stable")
            for cell in np.unique(held):
                mine = order[slice(*np.searchsorted(held[order], [cell, cell + 1]))]
                who = asker[slice(*np.searchsorted(asked, [cell, cell + 1]))]
                for at in range(0, len(who), 4096):
                    some = who[at : at + 4096]
                    for lo in range(0, len(mine), 4096):
                        block = mine[lo : lo + 4096]
                        sims = queries[some] @ units[block].T
                        row, column = np.nonzero(sims >= floor)
                        found.append((some[row], block[column], sims[row, column]))
        if not found:
            return pd.DataFrame({"query": [], "entry": [], "sim": []})
        q, e, s = (np.concatenate(x) for x in zip(*found))
        out = pd.DataFrame({"query": left["query"].to_numpy()[q], "entry": right["id"].to_numpy()[e], "sim": s})
        out = out[out["query"] != out["entry"]].sort_values(["query", "sim", "entry"], ascending=[True, False, True])
        return out.groupby("query", sort=False).head(k)

    slots = ["part", "s", "q"]
    placed = entries.mapInPandas(place, "part int, s int, q int, cell int, id string, vec binary")
    asking = entries.select("id", "vec").mapInPandas(ask, "part int, s int, q int, query string, qvec binary, cells array<int>")
    local = asking.groupBy(*slots).cogroup(placed.groupBy(*slots)).applyInPandas(rank, schema)
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "entry")
    return local.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")


def similar_vectors(df: DataFrame, key: str, vector: str, width: int = 64, k: int = 5, floor: float = 0.9, min_entries: int = MIN_ENTRIES, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, other, sim): for each vector its ``k`` most similar others with cosine >= floor.

    Vectors that are null, of another width, all zero or hold null, NaN or infinite values are left
    out, as are null keys. A repeated key counts once (with differing vectors, the smallest one). Equal
    similarities are ordered by key. Copies of a vector are found through one representative, so a group
    of copies of any size gives k rows for each of its members.
    """
    packed = F.pandas_udf(lambda column: column.map(lambda v: np.asarray(v, np.float32).tobytes()), "binary")
    usable = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable_vector(F.col("v"), width))
    single = cut_lineage(usable.groupBy("id").agg(F.min("v").alias("v")).select("id", packed("v").alias("vec")))
    classes = single.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    reps = cut_lineage(classes)
    near = _search(reps.select("id", "vec"), width, k, floor, min_entries, part_rows)
    if reps.where("n > 1").isEmpty():
        return near.select(F.col("query").alias("id"), F.col("entry").alias("other"), "sim")

    # Of a class only the first k + 1 members can be anybody's k nearest, keys deciding ties.
    member = single.join(reps.select("vec", F.col("id").alias("rep")), "vec").select("id", "rep")
    firsts = member.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("k") <= k + 1).select("rep", F.col("id").alias("other"))
    own = firsts.select("rep", "other", F.lit(1.0).alias("sim"))
    others = near.select(F.col("query").alias("rep"), F.col("entry").alias("near"), "sim").join(firsts.withColumnRenamed("rep", "near"), "near").select("rep", "other", "sim")
    best = Window.partitionBy("rep").orderBy(F.desc("sim"), "other")
    listed = own.unionByName(others).withColumn("k", F.row_number().over(best)).where(F.col("k") <= k + 1)
    lists = listed.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("k", "other", "sim"))).alias("list"))
    mine = member.join(lists, "rep").select("id", F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k).alias("list"))
    return mine.select("id", F.explode("list").alias("x")).select("id", "x.other", "x.sim")


def similar_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs (vec_id_a < vec_id_b) of which one has the other among its most similar."""
    return found.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()
